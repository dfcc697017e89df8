"""Benchmark decontamination: MinHash containment search, size-partitioned, verified by exact containment.

An item is contained in a document when at least ``threshold`` of its distinct word shingles occur there. Items and
documents are partitioned by their number of shingles, in powers of two; an item meets only partitions whose
documents are large enough to contain that share of it. Within its size an item of m shingles is represented
by its bottom-k MinHash sketch with k = floor((1 - threshold) m) + 1: as a document that contains the item lacks at most k - 1 of
its shingles, it holds at least one of any k, so unlike banded signatures of long documents the search loses no pair. A fixed-size filter of all
item shingles keeps other shingles from leaving the task that reads the document. The few that pass are joined with the sketches of items that are not too large for
the document; only the candidates found so are verified, by counting the item's shingles that the document holds (64-bit hashes of whole shingles).

Words are runs of letters, digits and non-ASCII characters, in lower case. Defined cases: an item of fewer words than ``words`` is one shingle, its whole
sequence, and is contained where that sequence occurs; null and empty texts hold nothing and are contained nowhere. Every row is a document of its own text: rows without a doc_id are
searched and cleaned like others, rows that share one but differ in text are judged each by itself, and rows repeated in both are one. Copies of an item are items of
their own; other columns are ignored by ``matches`` and kept, whatever their names, by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, storage
from .text import NOT_ALNUM, SPACE, grams, lowered_words, shingles

WORDS = 5
THRESHOLD = 0.8
#: Parts that documents with the same shingle are dealt into, if the sketches are too many to be sent to all tasks.
SALTS = 16
#: Text of a document, as two hashes of 64 bits; with doc_id it tells documents apart.
_KEY = ("doc_id", "text_a", "text_b")
_SEPARATORS = NOT_ALNUM | SPACE


def _words(column):
    return lowered_words(column, _SEPARATORS)


def item_shingles(items: DataFrame, k: int = WORDS) -> DataFrame:
    """item_id, size (its distinct shingles), span (words of a shingle), hash and place, its rank by hash within the item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for w in _words(batch.column(1)):
                for d in range(w.hi - w.lo):
                    h = w.hashes[w.bounds[d] : w.bounds[d + 1]]
                    span = min(k, len(h))
                    if span:
                        own = np.unique(grams(h, span))
                        out += [(ids[w.lo + d], len(own), span, x, i) for i, x in enumerate(own.view(np.int64).tolist())]
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "size", "span", "hash", "place"), x)) for x in out], schema)

    schema = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("span", pa.int32()), ("hash", pa.int64()), ("place", pa.int32())])
    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(work, "item_id long, size int, span int, hash long, place int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_key(), "text")


def _text_key(names: tuple[str, ...] = _KEY[1:]) -> list:
    return [F.xxhash64("text").alias(names[0]), F.xxhash64(F.lit(7), F.col("text")).alias(names[1])]


def hits(docs: DataFrame, parts: DataFrame, k: int, bits: int) -> DataFrame:
    """Distinct doc_id, text_a, text_b, n (shingles of the document), span and hash of all shingles that documents (may) share with items."""
    spans = sorted(r[0] for r in parts.select("span").distinct().collect())  # 1..k at most
    known = sketch.bloom(parts.select("hash"), bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w in _words(batch.column(3)):
                own = np.arange(w.lo, w.hi)
                for span in spans:
                    if span == k:
                        values, at = shingles(w, k)
                        doc = np.repeat(np.arange(len(own)), np.diff(at))
                        size = np.repeat(np.diff(at), np.diff(at))
                    else:
                        values = grams(w.hashes, span)
                        doc = np.repeat(np.arange(len(own)), np.diff(w.bounds))
                        same = doc[: len(values)] == doc[span - 1 :]
                        values, doc = values[same], doc[: len(values)][same]
                        size = np.ones(len(values), np.int64)
                    hit = known.test(values)
                    out.append((own[doc[hit]], size[hit], np.full(int(hit.sum()), span), values[hit].view(np.int64)))
            if out:
                row, *columns = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(3)), *(pa.array(c).cast(t) for c, t in zip(columns, kinds))], [*_KEY, "n", "span", "hash"])

    kinds = (pa.int32(), pa.int32(), pa.int64())
    return _keyed(docs).mapInArrow(work, "doc_id long, text_a long, text_b long, n int, span int, hash long").distinct()


def _level(size):
    """The size partition of a number of shingles."""
    return F.floor(F.log2(size)).cast("int")


def candidates(found: DataFrame, parts: DataFrame, k: int, few: int = storage.FEW) -> DataFrame:
    """Pairs of a document and an item that share a member of the item's sketch, where the document's size partition isn't below the item's."""
    # Of short items' spans a document has no set, so its size says nothing.
    parts = parts.withColumn("from", F.when(F.col("span") < k, 0).otherwise(_level("least")))
    sketches = parts.where(F.col("place") <= F.col("size") - F.col("least")).select("span", "hash", "from", "item_id", "size", "least")
    documents = found.withColumn("level", _level("n"))
    if sketches.count() <= few:
        met = documents.join(F.broadcast(sketches), ["span", "hash"])
    else:  # a shingle of very many documents goes to several tasks
        documents = documents.withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(SALTS)).cast("int"))
        met = documents.join(sketches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["span", "hash", "salt"])
    return met.where("level >= `from`").select(*_KEY, "item_id", "size", "least").distinct()


def verified(pairs: DataFrame, found: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, item_id, shared and size of those pairs whose document holds enough of the item. Pairs meet their item's shingles first, then those of their own document."""
    named = [F.col(c).alias(f"d_{c}") for c in _KEY]
    wanted = pairs.join(storage.few(parts.select("item_id", "span", "hash")), "item_id").select(*named, "item_id", "size", "least", "span", "hash")
    same = [F.col(f"d_{c}").eqNullSafe(F.col(c)) for c in _KEY] + [wanted["span"] == found["span"], wanted["hash"] == found["hash"]]
    met = wanted.join(found, same).select(*(f"d_{c}" for c in _KEY), "item_id", "size", "least")
    counted = met.groupBy(*(F.col(f"d_{c}").alias(c) for c in _KEY), "item_id", "size", "least").agg(F.count("*").alias("shared"))
    return counted.where("shared >= least").drop("least")


def _search(docs: DataFrame, items: DataFrame, k: int, threshold: float, bits: int, few: int) -> DataFrame:
    parts = storage.keep(item_shingles(items, k), "items")
    parts = parts.withColumn("least", F.ceil(F.round(F.col("size") * threshold, 9)).cast("int"))
    found = storage.keep(hits(docs, parts, k, bits), "hits")
    return verified(candidates(found, parts, k, few), found, parts)


def matches(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, bits: int = sketch.BITS, few: int = storage.FEW) -> DataFrame:
    """doc_id, item_id, shared and containment of every document that contains an item."""
    return _search(docs, items, k, threshold, bits, few).select("doc_id", "item_id", "shared", (F.col("shared") / F.col("size")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, bits: int = sketch.BITS, few: int = storage.FEW) -> DataFrame:
    """docs without those that contain an item."""
    bad = storage.keep(_search(docs, items, k, threshold, bits, few).select(*_KEY).distinct(), "leaks")
    own = storage.unused([*docs.columns, *_KEY], "a", "b")
    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *_text_key(tuple(own)))
    bad = bad.select(*(F.col(c).alias(f"{own[1]}_bad_{c}") for c in _KEY))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(bad.columns[0]))
    for c, d in zip(own, bad.columns[1:]):
        same &= F.col(c) == F.col(d)
    return keyed.join(storage.few(bad, few), same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
