"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features of a document are rates over its whole text: how dense words of a lexicon are, how near they stand to words that
address the reader, capitals, kinds of punctuation, and signs of obfuscation, among them lexicon words that only show once
look-alike characters are undone. The lexicon is a short fixed list plus units (words, and beginnings of words of
4 to 6 bytes, so that inflected forms count) whose share of toxic documents in the training rows is far above
the base rate. The trees are fitted on the driver to at most ``ROWS`` labelled documents (a documented bound; those with the smallest hash of
their id), of which a quarter is held back to fit the calibration. Every document is scored.

``labels``, ``lang``, ``source`` and ``doc_id`` are never inputs of a score. Rows for which ``may_learn`` is false are never learnt from.
Defined cases: a null text is an empty one and scored as such; repeated rows are scored once each; labels that are null, or of documents that are not there, are left
out, and of several labels of a document the largest counts; without both kinds of labels every score is the share of toxic ones (0 without any); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .features import NOT_ALNUM, SECOND_PERSON, SPACE, buffers, byte_shares, hash_words, known, lower, lowered_words
from .learn import BoostedTrees, Isotonic
from .text import U64, Words, constants, mix, words

ROWS = 20_000
UNITS = 4096
#: Evidence (log-likelihood ratio) from which on a unit is in the lexicon.
EVIDENCE = 12.0
NEAR = 5
#: Units that a task holds before it sums them up.
GATHERED = 1_000_000
# Insults, and characters that stand for letters.
SEED = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb fool fools jerk"
    " imbecile retard bastard bitch asshole shit fuck fucking crap garbage filth vermin pig ugly hate kill"
    " arschloch dumm dummkopf trottel abschaum schwein wichser scheisse scheiße hure spast"
    " imbécile crétin connard salope merde ordure pute débile abruti"
    " imbécil estúpido estúpida gilipollas mierda puta basura escoria asqueroso cabrón"
).split()
LOOKALIKE = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t"}
PREFIXES = (4, 5, 6)

_KINDS = constants(len(PREFIXES) + 1, 91)


class Lexicon(NamedTuple):
    units: np.ndarray
    weights: np.ndarray


def _units(w: Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings."""
    return [mix(w.hashes ^ _KINDS[0]), *(mix(w.prefix_hashes(n) ^ _KINDS[k + 1]) for k, n in enumerate(PREFIXES))]


def _seed_units() -> np.ndarray:
    return np.sort(mix(hash_words(SEED) ^ _KINDS[0]))


def _weights(units: list[np.ndarray], lexicon: Lexicon) -> np.ndarray:
    """The largest weight of each word's units, 0 for words outside the lexicon."""
    out = np.zeros(len(units[0]))
    if len(lexicon.units):
        for u in units:
            at = np.minimum(np.searchsorted(lexicon.units, u), len(lexicon.units) - 1)
            out = np.maximum(out, np.where(lexicon.units[at] == u, lexicon.weights[at], 0))
    return out


def _undone(column) -> pa.Array:
    """Lower-case text with look-alikes undone and other signs inside words dropped."""
    raw, offsets = buffers(lower(column))
    data, offs = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    table = np.arange(256, dtype=np.uint8)
    for a, b in LOOKALIKE.items():
        table[ord(a)] = ord(b)
    drop = NOT_ALNUM & ~SPACE
    drop[[ord(a) for a in LOOKALIKE]] = False
    kept = ~drop[data]
    moved = np.concatenate([[0], np.cumsum(kept)])[offs]
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(moved.astype(np.int64).tobytes()), pa.py_buffer(table[data[kept]].tobytes())])


def features(column, lexicon: Lexicon) -> np.ndarray:
    """A row of features per document."""
    you, seed = hash_words(SECOND_PERSON), _seed_units()
    rows = []
    for w in lowered_words(column):
        n = np.diff(w.bounds)
        least = np.maximum(n, 1)
        doc = np.repeat(np.arange(len(n)), n)
        units = _units(w)
        weight = _weights(units, lexicon)
        hit = weight > 0
        strong = np.zeros(len(n))
        np.maximum.at(strong, doc, weight)
        total, hits = np.bincount(doc, weight, len(n)), np.bincount(doc, hit, len(n))
        at, address = np.flatnonzero(hit), np.flatnonzero(known(w.hashes, you))
        near = np.zeros(len(at), bool)
        if len(address):
            for side in (-1, 0):
                other = address[np.clip(np.searchsorted(address, at) + side, 0, len(address) - 1)]
                near |= (np.abs(other - at) <= NEAR) & (doc[other] == doc[at])
        near_hits = np.bincount(doc[at[near]], minlength=len(n))
        addressed = np.bincount(doc[address], minlength=len(n))
        seeds = np.bincount(doc, known(units[0], seed), len(n))
        size = np.bincount(doc, w.ends - w.starts, len(n)) / least
        rows.append(np.stack([np.log1p(n), np.log1p(hits), hits / least, strong, total / least, np.log1p(near_hits), near_hits / least, addressed / least, np.log1p(seeds), seeds / least, size], 1))
    plain = np.concatenate(rows) if rows else np.zeros((0, 11))
    hidden = []
    for w in words(_undone(column).cast(pa.large_string(), safe=False) if len(column) else column, lower=False):
        n = np.diff(w.bounds)
        hits = known(mix(w.hashes ^ _KINDS[0]), np.union1d(seed, lexicon.units))
        hidden.append(np.bincount(np.repeat(np.arange(len(n)), n), hits, len(n)))
    more = np.concatenate(hidden) if hidden else np.zeros(0)
    extra = np.maximum(0, more - np.expm1(np.maximum(plain[:, 1], plain[:, 8]))) if len(more) else np.zeros(len(plain))
    return np.column_stack([plain, np.log1p(extra), byte_shares(column)]).astype(np.float64)


class Model(NamedTuple):
    lexicon: Lexicon
    trees: BoostedTrees | None
    calibrated: Isotonic | None
    base: float

    def score(self, column) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        if self.trees is None:
            return np.full(len(column), self.base)
        return np.clip(self.calibrated(self.trees.margin(features(column, self.lexicon))), 0, 1)


def _lexicon(sample: DataFrame, positives: int, total: int) -> Lexicon:
    """Units whose documents are toxic far more often than the others; pos and neg count documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(1)).astype(bool)
            found, flags, held = [], [], 0
            for w in lowered_words(batch.column(0)):
                doc = np.repeat(np.arange(w.lo, w.hi), np.diff(w.bounds))
                for u in _units(w):
                    order = np.lexsort((u, doc))
                    unit, owner = u[order].view(np.int64), doc[order]
                    new = np.ones(len(unit), bool)  # a document counts once for a unit
                    new[1:] = (unit[1:] != unit[:-1]) | (owner[1:] != owner[:-1])
                    found.append(unit[new])
                    flags.append(toxic[owner[new]])
                    held += int(new.sum())
                if held > GATHERED:
                    yield tally(found, flags)
                    found, flags, held = [], [], 0
            if held:
                yield tally(found, flags)

    def tally(found: list[np.ndarray], flags: list[np.ndarray]) -> pa.RecordBatch:
        unit, inverse = np.unique(np.concatenate(found), return_inverse=True)
        pos = np.bincount(inverse, np.concatenate(flags), len(unit)).astype(np.int64)
        all_of = np.bincount(inverse, minlength=len(unit))
        return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(pos), pa.array(all_of - pos)], ["unit", "pos", "neg"])

    counted = sample.select("text", "y").mapInArrow(count, "unit long, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = positives / total
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    evidence = part(F.col("pos"), share, F.lit(rate)) + part(F.col("neg"), 1 - share, F.lit(1 - rate))
    chosen = counted.where((F.col("pos") >= 3) & (share > max(0.5, 2 * rate) if rate < 0.5 else share > rate)).withColumn("evidence", evidence)
    weight = F.log((F.col("pos") + 0.5) / (positives + 1)) - F.log((F.col("neg") + 0.5) / (total - positives + 1))
    best = chosen.where(F.col("evidence") >= EVIDENCE).withColumn("weight", weight).orderBy(F.desc("evidence"), "unit").limit(UNITS).select("unit", "weight").toArrow()
    unit, weights = np.asarray(best["unit"]).view(U64), np.asarray(best["weight"])
    order = np.argsort(unit)
    return Lexicon(unit[order], weights[order])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", may_learn: Column | None = None, rows: int = ROWS) -> Model:
    """labels: doc_id and a 0/1 column."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable if may_learn is None else usable.where(may_learn)
    usable = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    usable = storage.sample(usable, "doc_id", rows)  # at most ``rows`` ids and labels
    sample = storage.keep(docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))), "labelled")
    total, positives = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positives < total:
        return Model(Lexicon(np.zeros(0, U64), np.zeros(0)), None, None, positives / total if total else 0.0)
    # Units are chosen without the rows that fit the calibration, else these would look too easy.
    inner = sample.where("fold > 0")
    n, p = inner.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    lexicon = _lexicon(inner, p, n) if 0 < p < n else Lexicon(np.zeros(0, U64), np.zeros(0))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features(batch.column(0), lexicon)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "fold"])

    table = sample.select("text", "y", F.col("fold").cast("int")).mapInArrow(describe, "x array<double>, y int, fold int").toArrow()
    x, y, fold = np.array(table["x"].to_pylist()), np.asarray(table["y"]).astype(float), np.asarray(table["fold"])
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    train = fold > 0
    if len(np.unique(y[train])) < 2:
        train[:] = True
    trees = BoostedTrees().fit(x[train], y[train])
    held = ~train if len(np.unique(y[~train])) == 2 else train
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[held]), y[held]), positives / total)


def score(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and score (0 to 1) of every document."""
    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(model.score(batch.column(len(keys))))], [*keys, "score"])

    return docs.select(*keys, "text").mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, "toxic", ~held_out(F.col("doc_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
