"""Quality classification by co-training of two views.

The content view sees the text: classes of characters, function words, repetition of words, shingles and lines, lengths of sentences and lines.
The metadata view sees the columns beside it and nothing of the text: language, source and the recorded length. Each view is a boosted-tree
classifier. Over some rounds, each labels the unlabelled documents it is surest about and hands them to the other; then both
are calibrated on labelled rows that neither learnt from, and the calibrated views are combined, each in proportion to
how well it does there, to score all documents.

Bounds (parameters): ``ROWS`` labelled documents, those with the smallest hash of their id, are described on the driver as dense features;
each round scores all other documents where they lie and brings the surest, at most a tenth of the labelled rows, to each view (of equally sure ones those
with the smallest hash). Everything else covers all documents. Defined cases: a null text is an empty one; null metadata is a value of its own;
repeated rows are scored once each; labels that are null or of documents that are not there are left out, and of several labels of a document
the smallest counts; without both kinds of labels every score is the share of good ones (1 without any); an empty table gives an
empty result; other columns are kept by ``keep`` and ignored otherwise.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .features import STOPWORDS, byte_shares, distinct_share, hash_words, known, line_features, lowered_words, top_share
from .learn import BoostedTrees, Isotonic

ROWS = 8_000
ROUNDS = 3
SURE = 0.95
#: Documents rejected by ``keep`` score below this.
LEAST = 0.5


def content_features(column) -> np.ndarray:
    stop = hash_words(STOPWORDS)
    rows = []
    for w in lowered_words(column):
        n = np.diff(w.bounds)
        least = np.maximum(n, 1)
        doc = np.repeat(np.arange(len(n)), n)
        size = (w.ends - w.starts).astype(float)
        mean = np.bincount(doc, size, len(n)) / least
        spread = np.sqrt(np.maximum(0, np.bincount(doc, size**2, len(n)) / least - mean**2))
        common = np.bincount(doc, known(w.hashes, stop), len(n)) / least
        rows.append(np.stack([mean, spread, common, top_share(w), distinct_share(w, 1), distinct_share(w, 2), distinct_share(w, 5)], 1))
    words = np.concatenate(rows) if rows else np.zeros((0, 7))
    shares = byte_shares(column)
    sentence = shares[:, 3] / np.maximum(shares[:, 5], 1e-4)  # words by full stops
    return np.column_stack([words, shares, np.minimum(sentence, 100), line_features(column)])


def metadata_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    bits = np.zeros((len(lang), 8 + 16))
    for i, (a, b) in enumerate(zip(lang, source)):
        bits[i, zlib.crc32(str(a).encode()) % 8] = 1
        bits[i, 8 + zlib.crc32(str(b).encode()) % 16] = 1
    size = np.log1p(np.array([max(0, n or 0) for n in n_chars], float))
    return np.column_stack([size, bits])


def _views(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of the columns text, lang, source and n_chars, from column at on."""
    return content_features(batch.column(at)), metadata_features(*(batch.column(at + k).to_pylist() for k in (1, 2, 3)))


class View(NamedTuple):
    trees: BoostedTrees
    calibrated: Isotonic
    weight: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibrated(self.trees.margin(x)), 1e-4, 1 - 1e-4)


class Model(NamedTuple):
    views: tuple[View, View] | None
    base: float
    exchanged: tuple[int, ...] = ()

    def score(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(content), self.base)
        odds = sum(v.weight * np.log(p / (1 - p)) for v, p in zip(self.views, (v.probability(x) for v, x in zip(self.views, (content, metadata)))))
        return 1 / (1 + np.exp(-odds))


#: Of each view the margins' trees, calibration and keys already handed on, and how many at most: for each view both descriptions and chances of the surest.
Surest = Callable[[list[BoostedTrees], list[Isotonic], list[np.ndarray], int], list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]]]


def cotrain(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, surest: Surest, rounds: int = ROUNDS) -> Model:
    """fold 0 is held back for calibration."""
    train, held = fold > 0, fold == 0
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        train[:] = held[:] = True
    given = [(x[train], y[train]) for x in labelled]
    taken = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    most = max(1, int(train.sum()) // 10)
    exchanged = []
    fits = lambda: [BoostedTrees(trees=60).fit(x, t) for x, t in given]
    trees = fits()
    for _ in range(rounds):
        calibrated = [Isotonic().fit(trees[k].margin(labelled[k][held]), y[held]) for k in (0, 1)]
        added = 0
        for own, (keys, found, p) in enumerate(surest(trees, calibrated, taken, most)):
            other = 1 - own
            if not len(keys):
                continue
            x, t = given[other]
            given[other] = np.concatenate([x, found[other]]), np.concatenate([t, (p > 0.5).astype(float)])
            taken[own] = np.concatenate([taken[own], keys])
            added += len(keys)
        exchanged.append(added)
        if not added:
            break
        trees = fits()
    views, skill = [], []
    base = float(np.clip(y[held].mean(), 1e-3, 1 - 1e-3))
    loss = lambda p: -float((y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean())
    for k in (0, 1):
        v = View(trees[k], Isotonic().fit(trees[k].margin(labelled[k][held]), y[held]), 1.0)
        views.append(v)
        skill.append(max(1e-6, loss(np.full(held.sum(), base)) - loss(v.probability(labelled[k][held]))))
    return Model(tuple(v._replace(weight=s / sum(skill)) for v, s in zip(views, skill)), float(y.mean()), tuple(exchanged))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _described(docs: DataFrame, keys: str) -> DataFrame:
    """Both views a and b of docs, whose two first columns, keys, are kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _views(batch, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(a), _lists(b)], [*names, "a", "b"])

    names = [k.split()[0] for k in keys.split(", ")]
    return docs.select(*names, "text", "lang", "source", "n_chars").mapInArrow(work, f"{keys}, a array<double>, b array<double>")


def _surest(others: DataFrame, sure: float) -> Surest:
    """Finds the surest among all rows of others (key, a, b) on the executors."""

    def find(trees, calibrated, taken, most):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = np.asarray(batch.column(0))
                for k in (0, 1):
                    p = calibrated[k](trees[k].margin(_matrix(batch.column(1 + k)))) if len(keys) else np.zeros(0)
                    good = ((p >= sure) | (p <= 1 - sure)) & ~np.isin(keys, taken[k])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[good]), pa.array(np.full(int(good.sum()), k, np.int32)), pa.array(p[good])], ["key", "view", "p"])

        scored = storage.keep(others.select("key", "a", "b").mapInArrow(work, "key long, view int, p double").dropDuplicates(["key", "view"]), "sure")
        best = [scored.where(F.col("view") == k).orderBy(F.abs(F.col("p") - 0.5).desc(), "key").limit(most) for k in (0, 1)]
        best = storage.keep(best[0].unionByName(best[1]), "surest")
        rows = others.join(F.broadcast(best), "key").dropDuplicates(["key", "view"]).select("key", "view", "p", "a", "b").toArrow()
        keys, view, p = (np.asarray(rows[c]) for c in ("key", "view", "p"))
        a, b = (_matrix(rows[c]) if len(keys) else np.zeros((0, 0)) for c in ("a", "b"))
        out = []
        for k in (0, 1):
            own = np.flatnonzero(view == k)
            own = own[np.argsort(keys[own])]
            out.append((keys[own], (a[own], b[own]), p[own]))
        return out

    return find


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, sure: float = SURE) -> Model:
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    chosen = storage.keep(storage.sample(usable, "doc_id", rows), "labels")  # at most ``rows`` ids and labels
    inputs = docs.select("doc_id", *_inputs(docs))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).cast("int")
    sample = inputs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).withColumn("fold", fold)
    table = _described(sample, "fold int, y int").toArrow()
    y = np.asarray(table["y"]).astype(float)
    if len(np.unique(y)) < 2:
        return Model(None, float(y.mean()) if len(y) else 1.0)
    a, b, fold = _matrix(table["a"]), _matrix(table["b"]), np.asarray(table["fold"])
    order = np.lexsort((*np.column_stack([a, b]).T, y, fold))
    others = inputs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    # Repeated rows have one key. Rows without an id count as documents.
    content = F.xxhash64(F.col("doc_id"), *(F.col(c) for c in ("text", "lang", "source", "n_chars")))
    others = others.withColumn("key", content).withColumn("none", F.lit(0))
    others = storage.keep(_described(others, "key long, none int").drop("none"), "described")
    return cotrain((a[order], b[order]), y[order], fold[order], _surest(others, sure))


def _inputs(docs: DataFrame) -> list:
    """The inputs of both views; metadata that the table lacks is null."""
    there = {"text": F.col("text")} | {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("lang", "source", "n_chars")}
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return [c.cast(kinds[n]).alias(n) for n, c in there.items()]


def _scored(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    schema = T.StructType([*(T.StructField(n, docs.schema[k].dataType) for n, k in zip(names, keys)), T.StructField("_score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.score(*_views(batch, len(keys))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(value)], [*names, "_score"])

    return docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)), *_inputs(docs)).mapInArrow(work, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (the chance of good quality) and keep of every document."""
    return _scored(docs, model, ["doc_id"]).select(F.col("_k0").alias("doc_id"), F.col("_score").alias("score"), (F.col("_score") >= LEAST).alias("keep"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rejected ones."""
    found = _scored(docs, model, docs.columns).where(F.col("_score") >= LEAST)
    return found.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
