"""Language-model scores of documents by stupid backoff, computed relationally.

The model is three count tables, of the words, word pairs and word triples of all documents, partitioned by hash. A word scores
c(a, b, word) / c(a, b) if the triple with the two words before it was counted ``min_count`` times at least (one counted once is the scored document's own), else
``ALPHA`` c(b, word) / c(b) if the pair was, else ``ALPHA``^2 c(word) / N; a document's first word scores c(word) / N, its second by pairs. Logarithms are summed per document.

1. Words are counted; the ``CODES`` most frequent ones travel as three-byte codes whose counts every task holds (a table of fixed size).
2. Pairs and triples that are frequent in some half million words are candidates; of these the ``HOT`` with the highest counts are counted over all documents and held by every task (a
   table of fixed size). They never travel, so no key of what travels fills a task: a hot n-gram is split among all tasks.
3. Each other triple occurrence goes once, with its document, to the partition of its first pair (or, if that pair is hot, of the triple). There the pair
   and triple tables are counted, and occurrences of counted triples are scored.
4. Occurrences that back off go, once, to the partition of their second pair and meet the pair table there. What needs the count of a word without a code goes to the
   partition of that word, where the word table is.
5. Each step adds up what it has of a document; these sums meet in the document's partition.

An n-gram with a word that was counted less than ``min_count`` times was so itself. Such words are known from the word table, by a filter that says of each other word
whether it may be frequent enough; what needs only them is scored where it stands. All else travels coded, never left out: columns of code bytes, runs of documents,
compressed. A task holds about ``OCCURRENCES`` of them, however large the input, and the hashes of one in ``PARTS`` at a time. N-grams are told apart by 64-bit hashes.

Words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case. Defined cases: rows without doc_id take no part;
rows that share a doc_id are parts of one document whose scores add up; null or empty texts have no words, score 0 and no perplexity; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, storage
from .text import U64, constants, mix, words

ALPHA = 0.4
MIN_COUNT = 2
CODES = 1 << 20
HOT = 1 << 16
#: How often an n-gram occurs in some half million words to be a candidate for the hot ones.
LOCAL = 64
#: Words that a task gathers before it sends what they give.
CHUNK = 1 << 19
#: Occurrences that a partition holds, about.
OCCURRENCES = 2_000_000
#: Parts of these whose hashes a task holds at once.
PARTS = 4
_GRAM = constants(3, 71)
_END = U64(0x9D39247E33776D41)  # what follows a document's last pair


def unigrams(docs: DataFrame) -> DataFrame:
    """word (a hash) and n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [w.hashes for w in words(batch.column(0))]
            word, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(table: DataFrame, rows: int) -> DataFrame:
    """The rows with the highest n. A histogram of counts, of a few hundred bars whatever the table's size, tells first which counts can be among them."""
    bar = F.floor(F.log2("n") * 8).cast("int")
    bars = table.groupBy(bar.alias("bar")).agg(F.count("*").alias("rows")).orderBy(F.desc("bar")).collect()
    least, held = 0, 0
    for b in bars:
        least, held = b.bar, held + b.rows
        if held >= rows:
            break
    return table.where(bar >= least).orderBy(F.desc("n"), table.columns[0]).limit(rows)


class Table:
    """Counts of some hashes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the table, and where."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, at

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each hash, 0 if it has none."""
        known, at = self.places(hashes)
        return np.where(known, self.counts[at], 0) if len(self.keys) else np.zeros(len(hashes), np.int64)


class Coder:
    """Codes of the most frequent words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, min_count: int):
        self.min_count = min_count
        self.table = Table(keys, counts)
        n = len(keys)
        rank = np.argsort(np.argsort(-self.table.counts, kind="stable"), kind="stable")  # frequent words get small codes, which compress
        self.code = rank.astype(np.int32)
        self.none, self.end = n, n + 1
        self.hashes = np.zeros(n + 2, U64)
        self.hashes[rank] = self.table.keys
        self.hashes[self.end] = _END
        self.log = np.zeros(n + 2)
        self.log[rank] = np.log(np.maximum(self.table.counts, 1))
        self.rare = np.zeros(n + 2, bool)
        self.rare[rank] = self.table.counts < min_count

    def __reduce__(self):
        return Coder, (self.table.keys, self.table.counts, self.min_count)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        known, at = self.table.places(hashes)
        return np.where(known, self.code[at], self.none).astype(np.int32) if len(self.code) else np.full(len(hashes), self.none, np.int32)


def _gram(*hashes: np.ndarray) -> np.ndarray:
    out = np.full(len(hashes[0]), U64(len(hashes)), U64)
    for h, c in zip(hashes, _GRAM):
        out += h * c
    return mix(out)


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often the hash at each place occurs; each hash once, and how often it does."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(ordered)))
    count = np.empty(len(hashes), np.int64)
    count[order] = np.repeat(n, n)
    return count, ordered[begin], n


class Chunk(NamedTuple):
    """Words of some documents on end: hashes, the document each word is in (a place in ids), and its number in it."""

    ids: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    counts: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Batches of doc_id and text, cut between documents after about ``CHUNK`` words."""
    for batch in batches:
        ids, held, size = np.asarray(batch.column(0)), [], 0
        for w in words(batch.column(1)):
            held.append((ids[w.lo : w.hi], w.hashes, np.diff(w.bounds)))
            size += len(w.hashes)
            if size >= CHUNK:
                yield _chunk(held)
                size = 0
        if held:
            yield _chunk(held)


def _chunk(held: list[tuple]) -> Chunk:
    ids, hashes, n = (np.concatenate(x) for x in zip(*held))
    held.clear()  # or everything is there twice
    first = np.cumsum(n) - n
    return Chunk(ids, hashes, np.repeat(np.arange(len(ids)), n), np.arange(len(hashes)) - np.repeat(first, n), n)


def _maybe(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Those hashes, and their places, that may occur least times: as often at least as others with the same 21 bits."""
    slot = (hashes >> U64(43)).astype(np.int64)
    at = np.flatnonzero(np.bincount(slot, minlength=1 << 21)[slot] >= least)
    return hashes[at], at


def _candidates(docs: DataFrame, local: int) -> DataFrame:
    """gram, prefix (of a triple: its first pair) and n of pairs and triples that are frequent in some chunk, added up over those chunks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            h = c.hashes
            two, three = np.flatnonzero(c.place >= 1), np.flatnonzero(c.place >= 2)
            gram, n = np.unique(_maybe(_gram(h[two - 1], h[two]), local)[0], return_counts=True)
            often = n >= local
            yield pa.RecordBatch.from_arrays([pa.array(gram[often].view(np.int64)), pa.nulls(int(often.sum()), pa.int64()), pa.array(n[often])], names)
            gram, kept = _maybe(_gram(h[three - 2], h[three - 1], h[three]), local)
            gram, first, n = np.unique(gram, return_index=True, return_counts=True)
            often = n >= local
            at = three[kept[first[often]]]
            yield pa.RecordBatch.from_arrays([pa.array(gram[often].view(np.int64)), pa.array(_gram(h[at - 2], h[at - 1]).view(np.int64)), pa.array(n[often])], names)

    names = ["gram", "prefix", "n"]
    return docs.mapInArrow(work, "gram long, prefix long, n long").groupBy("gram", "prefix").agg(F.sum("n").alias("n"))


def _hot(docs: DataFrame, rows: int, local: int) -> tuple[Table, Table]:
    """The most frequent pairs and triples with their counts over all documents; a triple's first pair is among the pairs."""
    found = storage.keep(_candidates(docs, local), "candidates")
    two = np.sort(np.asarray(_most_frequent(found.where("prefix IS NULL").select("gram", "n"), rows).toArrow()["gram"]).astype(np.int64).view(U64))
    triples = _most_frequent(found.where("prefix IS NOT NULL").select("gram", "n", "prefix"), rows).toArrow()
    three = np.asarray(triples["gram"]).astype(np.int64).view(U64)
    three = np.sort(three[np.isin(np.asarray(triples["prefix"]).astype(np.int64).view(U64), two)])
    keys = [Table(x, np.zeros(len(x), np.int64)) for x in (two, three)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(k.keys) + 1, np.int64) for k in keys]
        for c in _chunks(batches):
            h = c.hashes
            for k, (table, sums) in enumerate(zip(keys, total)):
                at = np.flatnonzero(c.place >= k + 1)
                known, cell = table.places(_gram(*(h[at - j] for j in range(k + 1, -1, -1))))
                sums += np.bincount(cell[known], minlength=len(sums))
        for k, sums in enumerate(total):
            cell = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(sums[cell])], ["k", "cell", "n"])

    rows_found = docs.mapInArrow(count, "k int, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    k, cell, n = (np.asarray(rows_found[c]).astype(np.int64) for c in ("k", "cell", "n"))
    for i, table in enumerate(keys):
        table.counts[cell[k == i]] = n[k == i]
    return keys[0], keys[1]


# What travels: occurrences of two or three words as codes or hashes, counts of pairs, and parts of documents' sums.
PAIRS_CODED, PAIRS, FIRST_CODED, FIRST, TRIPLES_CODED, TRIPLES, COUNTS, SUMS, WORDS = range(9)
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("runs", pa.int32()), ("data", pa.binary()), ("docs", pa.binary())])
_DDL = "bucket int, kind int, n int, runs int, data binary, docs binary"
Sums = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # documents, parts of their scores, and words
#: Sums that a task holds before it adds them up.
HELD = 1 << 21


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Codes by their bytes, three planes a column; hashes as they are."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes() if c.dtype == np.int32 else c.tobytes() for c in columns)
    return _zstd().compress(raw, asbytes=True)


def _unpacked(data: bytes, n: int, columns: int, coded: bool) -> list[np.ndarray]:
    width = 3 if coded else 8
    raw = np.frombuffer(_zstd().decompress(data, n * columns * width, asbytes=True), np.uint8).reshape(columns, n * width)
    if not coded:
        return [c.view(U64) for c in raw]
    out = np.zeros((columns, n, 4), np.uint8)
    out[:, :, :3] = raw.reshape(columns, 3, n).transpose(0, 2, 1)
    return [np.ascontiguousarray(c).view(np.int32).reshape(-1) for c in out]


def _sent(bucket: np.ndarray, buckets: int, kind: int, columns: list[np.ndarray], owner: np.ndarray | None) -> pa.RecordBatch:
    """A row for each bucket that occurs; owner: the documents' ids, in runs."""
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows: list[tuple] = []
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        docs, m = b"", 0
        if owner is not None:
            own = owner[order[s]]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            m = len(new)
            docs = _zstd().compress(own[new].tobytes() + np.diff(np.append(new, len(own))).astype(np.uint32).tobytes(), asbytes=True)
        rows.append((int(b), kind, s.stop - s.start, m, _packed([c[s] for c in columns]), docs))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 6, _SENT)], schema=_SENT)


def _owners(docs: bytes, runs: int) -> np.ndarray:
    raw = _zstd().decompress(docs, 12 * runs, asbytes=True)
    return np.repeat(np.frombuffer(raw[: 8 * runs], np.int64), np.frombuffer(raw[8 * runs :], np.uint32))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, int]]:
    """Kind, packed columns and bucket of each row."""
    for batch in batches:
        for bucket, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
            yield kind, row, bucket


def _summed(sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner, part, n = (np.concatenate(x) for x in zip(*sums))
    ids, inverse = np.unique(owner, return_inverse=True)
    return ids, np.bincount(inverse, weights=part, minlength=len(ids)), np.bincount(inverse, weights=n, minlength=len(ids)).astype(np.int64)


def _sums(row: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, part, n = _unpacked(row[2], row[0], 3, False)
    return ids.view(np.int64), part.view(np.float64), n.view(np.int64)


class Occurrences:
    """Words of rows that travelled, as codes; those that came as hashes, the last ones, as hashes too."""

    def __init__(self, coder: Coder, rows: list[tuple[int, list]], columns: int, coded: int):
        self.coder = coder
        codes, hashes, owner = [[] for _ in range(columns)], [[np.zeros(0, U64)] for _ in range(columns)], [np.zeros(0, np.int64)]
        for kind, (n, runs, data, docs) in sorted(rows, key=lambda r: r[0] != coded):
            for i, c in enumerate(_unpacked(data, n, columns, kind == coded)):
                codes[i].append(c if kind == coded else coder.codes(c))
                if kind != coded:
                    hashes[i].append(c)
            owner.append(_owners(docs, runs))

        def join(parts: list) -> np.ndarray:
            out = np.concatenate(parts)
            parts.clear()  # or everything is there twice
            return out

        self.codes, self.hashes, self.owner = [join(c) if c else np.zeros(0, np.int32) for c in codes], [join(h) for h in hashes], join(owner)
        self.coded = len(self.owner) - len(self.hashes[0])

    def words(self, column: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and codes of a column at some places, which are in order."""
        code = self.codes[column][at]
        out, first = self.coder.hashes[code], np.searchsorted(at, self.coded)
        out[first:] = self.hashes[column][at[first:] - self.coded]
        return out, code


class Scorer(NamedTuple):
    """What every task knows of the model."""

    coder: Coder
    often: sketch.Bloom
    pairs: Table
    triples: Table
    log_n: float
    back: float
    min_count: int
    buckets: int
    doc_buckets: int

    @staticmethod
    def add(sums: Sums, owner: np.ndarray, part: np.ndarray) -> None:
        if len(owner):
            sums.append(_summed([(owner, part, np.zeros(len(owner), np.int64))]))

    def sent_sums(self, sums: Sums) -> Iterator[pa.RecordBatch]:
        """Sums, to their documents' partitions; each of these is spread over some of the others on the way."""
        if sums:
            columns, width = [x.view(U64) for x in _summed(sums)], self.buckets // self.doc_buckets
            yield _sent(_bucket(mix(columns[0]), self.doc_buckets) * np.int32(width) + np.int32(int(columns[0][0]) % width), self.buckets, SUMS, columns, None)

    def passed(self, kind: int, row: list, bucket: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bucket, kind, *row), _SENT)], schema=_SENT)

    def rare(self, word: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Words that were certainly counted less than min_count times."""
        out = self.coder.rare[code]
        other = np.flatnonzero(code == self.coder.none)
        out[other] = ~self.often.test(word[other])
        return out

    def single(self, word: np.ndarray, code: np.ndarray, owner: np.ndarray, more: float | np.ndarray, sign: int, sums: Sums) -> Iterator[pa.RecordBatch]:
        """Adds more + sign log c(word) to sums, or sends it where the count isn't known."""
        known, more = code != self.coder.none, more + np.zeros(len(word))
        if self.min_count == 2:  # what was counted less often was counted once
            known |= self.rare(word, code)
        self.add(sums, owner[known], more[known] + sign * self.coder.log[code[known]])
        if not known.all():
            columns = [owner[~known].view(U64), word[~known], more[~known].view(U64), np.full(int((~known).sum()), sign, np.int64).view(U64)]
            yield _sent(_bucket(mix(columns[1]), self.buckets), self.buckets, WORDS, columns, None)

    def by_pair(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], count: np.ndarray, owner: np.ndarray, more: float, sums: Sums) -> Iterator[pa.RecordBatch]:
        """Parts of words b (hashes, codes) after a, by the count of the pair, or by the word's own."""
        seen = count >= self.min_count
        yield from self.single(a[0][seen], a[1][seen], owner[seen], more + np.log(count[seen]), -1, sums)
        yield from self.single(b[0][~seen], b[1][~seen], owner[~seen], more + self.back - self.log_n, 1, sums)

    def pairs_or_later(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], owner: np.ndarray, first: bool, sums: Sums) -> Iterator[pa.RecordBatch]:
        """Scores words b after a by hot pairs, and sends the others to their pairs. first: a document's second words, which don't back off from a triple."""
        rare = self.rare(*a) | self.rare(*b)
        if rare.any():
            yield from self.single(b[0][rare], b[1][rare], owner[rare], self.back * (1 if first else 2) - self.log_n, 1, sums)
            a, b, owner = (a[0][~rare], a[1][~rare]), (b[0][~rare], b[1][~rare]), owner[~rare]
        gram = _gram(a[0], b[0])
        hot, at = self.pairs.places(gram)
        if hot.any():
            yield from self.by_pair(*((x[hot], c[hot]) for x, c in (a, b)), self.pairs.counts[at[hot]], owner[hot], 0.0 if first else self.back, sums)
        coded = (a[1] != self.coder.none) & (b[1] != self.coder.none)
        for kind, take, k in ((FIRST_CODED if first else PAIRS_CODED, ~hot & coded, 1), (FIRST if first else PAIRS, ~hot & ~coded, 0)):
            if take.any():
                yield _sent(_bucket(gram[take], self.buckets), self.buckets, kind, [a[k][take], b[k][take]], owner[take])

    def explode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Triples, sent to where they are counted; what needs no further count is scored here."""
        for c in _chunks(batches):
            yield from self.exploded(c)
            del c  # before the next one is made

    def exploded(self, c: Chunk) -> Iterator[pa.RecordBatch]:
        """The same of one chunk."""
        h, code, owner = c.hashes, self.coder.codes(c.hashes), c.ids[c.doc]
        sums: Sums = [(c.ids, np.zeros(len(c.ids)), c.counts.astype(np.int64))] if len(c.ids) else []
        at = np.flatnonzero(c.place == 0)
        yield from self.single(h[at], code[at], owner[at], -self.log_n, 1, sums)
        at = np.flatnonzero(c.place == 1)
        yield from self.pairs_or_later((h[at - 1], code[at - 1]), (h[at], code[at]), owner[at], True, sums)
        if not len(h):
            yield from self.sent_sums(sums)
            return
        # Triples, and each document's last pair with nothing after it.
        ends = np.cumsum(c.counts)[c.counts >= 2]
        third = np.concatenate([np.flatnonzero(c.place >= 2), ends])
        is_end = np.arange(len(third)) >= len(third) - len(ends)
        order = np.argsort(third - is_end, kind="stable")
        third, is_end = third[order], is_end[order]
        del at, order
        # Where a word of the first pair is rare, nothing counts the pair; where the last one is, the pair alone is counted.
        rare = self.rare(h, code)
        last, first = ~is_end & rare[np.minimum(third, len(h) - 1)], rare[third - 2] | rare[third - 1]
        later = third[~is_end & (first | last)]
        if len(later):
            yield from self.pairs_or_later((h[later - 1], code[later - 1]), (h[later], code[later]), owner[later - 1], False, sums)
        third, is_end = third[~first], (is_end | last)[~first]
        del rare, last, first, later
        go, coded, bucket = np.zeros(len(third), bool), np.zeros(len(third), bool), np.zeros(len(third), np.int32)
        step = max(1, -(-len(third) // PARTS))
        for lo in range(0, len(third), step):
            part = slice(lo, lo + step)
            (h1, h2, h3), (c1, c2, c3) = self.triple(h, third[part], is_end[part], _END), self.triple(code, third[part], is_end[part], self.coder.end)
            pair, gram, own = _gram(h1, h2), _gram(h1, h2, h3), owner[third[part] - 1]
            hot, _ = self.pairs.places(pair)
            known, cell = self.triples.places(gram)
            known &= hot & ~is_end[part]
            if known.any():
                counted = self.triples.counts[cell[known]]
                seen = counted >= self.min_count
                self.add(sums, own[known][seen], np.log(counted[seen]) - np.log(self.pairs.get(pair[known][seen])))
                rest = np.flatnonzero(known)[~seen]
                yield from self.pairs_or_later((h2[rest], c2[rest]), (h3[rest], c3[rest]), own[rest], False, sums)
            go[part] = ~known & ~(hot & is_end[part])
            coded[part] = (c1 != self.coder.none) & (c2 != self.coder.none) & (c3 != self.coder.none)
            bucket[part] = _bucket(np.where(hot, gram, pair), self.buckets)
            del h1, h2, h3, c1, c2, c3, pair, gram, own, hot, known, cell
        for kind, take, words_of, end in ((TRIPLES_CODED, go & coded, code, self.coder.end), (TRIPLES, go & ~coded, h, _END)):
            if take.any():
                yield _sent(bucket[take], self.buckets, kind, list(self.triple(words_of, third[take], is_end[take], end)), owner[third[take] - 1])
        yield from self.sent_sums(sums)

    @staticmethod
    def triple(words_of: np.ndarray, third: np.ndarray, is_end: np.ndarray, end: int | np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes or codes of the three words up to each of third, of which the last may be an end."""
        last = words_of[np.minimum(third, len(words_of) - 1)]
        last[is_end] = end
        return words_of[third - 2], words_of[third - 1], last

    def triples_counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts triples and their first pairs, scores what was counted, and sends on the pair table and what backs off."""
        own, sums = [], []
        for kind, row, bucket in _rows(batches):
            if kind in (TRIPLES_CODED, TRIPLES):
                own.append((kind, row))
            else:  # on its way; the bucket stays
                yield self.passed(kind, row, bucket)
        if not own:
            return
        held = Occurrences(self.coder, own, 3, TRIPLES_CODED)
        own.clear()
        # All occurrences of a pair are in one part.
        part = np.zeros(len(held.owner), np.uint8)
        step = max(1, -(-len(part) // PARTS))
        for lo in range(0, len(part), step):
            at = np.arange(lo, min(len(part), lo + step))
            part[at] = _gram(held.words(0, at)[0], held.words(1, at)[0]) % U64(PARTS)
        to, counted = np.full(len(part), PARTS, np.uint8), []  # parts of the partitions that what backs off goes to
        for p in range(PARTS):
            at = np.flatnonzero(part == p)
            a, b, c = (held.words(i, at)[0] for i in range(3))
            pair, word = _gram(a, b), c != _END
            count = _counted(_gram(a, b, c))[0]
            del a
            seen = word & (count >= self.min_count)
            later = np.flatnonzero(word & ~seen)
            to[at[later]] = _bucket(_gram(b[later], c[later]), PARTS)
            del b, c, later
            hot, place = self.pairs.places(pair)
            of_pair = np.where(hot, self.pairs.counts[place] if len(self.pairs.keys) else 0, 0)
            del place
            of_pair[~hot], keys, counts = _counted(pair[~hot])
            counted.append((keys[counts >= self.min_count], counts[counts >= self.min_count].astype(U64)))
            self.add(sums, held.owner[at[seen]], np.log(count[seen]) - np.log(of_pair[seen]))
            del at, pair, word, count, seen, hot, of_pair, keys, counts
        del part
        keys, counts = (np.concatenate(x) for x in zip(*counted))
        if len(keys):
            yield _sent(_bucket(keys, self.buckets), self.buckets, COUNTS, [keys, counts], None)
        del keys, counts, counted
        for p in range(PARTS):
            at = np.flatnonzero(to == p)
            yield from self.pairs_or_later(held.words(1, at), held.words(2, at), held.owner[at], False, sums)
        yield from self.sent_sums(sums)

    def pairs_counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins what backed off with the pair table."""
        keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        own: dict[bool, list] = {True: [], False: []}
        sums: Sums = []
        for kind, row, bucket in _rows(batches):
            if kind in (SUMS, WORDS):
                yield self.passed(kind, row, bucket)
            elif kind == COUNTS:
                k, c = _unpacked(row[2], row[0], 2, False)
                keys.append(k)
                counts.append(c.astype(np.int64))
            else:
                own[kind in (FIRST_CODED, FIRST)].append((kind, row))
        table = Table(np.concatenate(keys), np.concatenate(counts))
        for first, rows in own.items():
            held = Occurrences(self.coder, rows, 2, FIRST_CODED if first else PAIRS_CODED)
            rows.clear()
            step = max(1, -(-len(held.owner) // PARTS))
            for lo in range(0, len(held.owner), step):
                at = np.arange(lo, min(len(held.owner), lo + step))
                a, b = (held.words(i, at) for i in range(2))
                yield from self.by_pair(a, b, table.get(_gram(a[0], b[0])), held.owner[at], 0.0 if first else self.back, sums)
        yield from self.sent_sums(sums)

    def words_sent(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word table's rows of words without a code."""
        for batch in batches:
            word, n = np.asarray(batch.column(0)).astype(np.int64).view(U64), np.asarray(batch.column(1)).astype(np.int64)
            other = ~self.coder.table.places(word)[0]
            if other.any():
                yield _sent(_bucket(mix(word[other]), self.buckets), self.buckets, COUNTS, [word[other], n[other].view(U64)], None)

    def words_counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins what needs a word's count with the word table, which has those of more than one."""
        keys, counts, own = [np.zeros(0, U64)], [np.zeros(0, np.int64)], []
        for kind, row, _ in _rows(batches):
            columns = _unpacked(row[2], row[0], 2 if kind == COUNTS else 4, False)
            if kind == COUNTS:
                keys.append(columns[0])
                counts.append(columns[1].astype(np.int64))
            else:
                own.append(columns)
        table = Table(np.concatenate(keys), np.concatenate(counts))
        sums: Sums = []
        for owner, word, more, sign in own:
            self.add(sums, owner.view(np.int64), more.view(np.float64) + sign.view(np.int64) * np.log(np.maximum(table.get(word), 1)))
        yield from self.sent_sums(sums)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's sums, added up."""
    sums: Sums = []
    held = 0
    for _, row, _ in _rows(batches):
        sums.append(_sums(row))
        held += row[0]
        if held > HELD:
            sums = [_summed(sums)]
            held = len(sums[0][0])
    if sums:
        ids, part, n = _summed(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(part)], ["doc_id", "n_words", "score"])


def score(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, codes: int = CODES, hot: int = HOT, local: int = LOCAL, occurrences: int = OCCURRENCES) -> DataFrame:
    """doc_id, n_words, score (sum of natural logarithms) and perplexity."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = storage.keep(unigrams(docs), "unigrams")
    total = table.agg(F.sum("n")).first()[0] or 1
    pairs, triples = _hot(docs, hot, local)
    buckets = max(storage.partitions(spark), -(-total // occurrences))
    top = _most_frequent(table, codes).toArrow()
    coder = Coder(np.asarray(top["word"]).astype(np.int64).view(U64), np.asarray(top["n"]).astype(np.int64), min_count)
    often = table.where(F.col("n") >= min_count).select("word")
    # One copy for each executor, of fixed size, whichever step asks for it.
    model = spark.sparkContext.broadcast(Scorer(coder, sketch.bloom(often, sketch.fitting(often.count())), pairs, triples, math.log(total), math.log(alpha), min_count, buckets, min(buckets, max(8, -(-total // (16 * occurrences))))))
    sent = docs.mapInArrow(lambda b: model.value.explode(b), _DDL).repartitionById(buckets, "bucket").mapInArrow(lambda b: model.value.triples_counted(b), _DDL)
    parts = storage.keep(sent.repartitionById(buckets, "bucket").mapInArrow(lambda b: model.value.pairs_counted(b), _DDL), "scores")
    counts = table.where("n > 1").select("word", "n").mapInArrow(lambda b: model.value.words_sent(b), _DDL)
    tail = parts.where(F.col("kind") == WORDS).unionByName(counts).repartitionById(buckets, "bucket").mapInArrow(lambda b: model.value.words_counted(b), _DDL)
    sums = parts.where(F.col("kind") == SUMS).unionByName(tail).withColumn("bucket", F.expr(f"bucket div {buckets // model.value.doc_buckets}").cast("int"))
    sums = sums.repartitionById(model.value.doc_buckets, "bucket").mapInArrow(_documents, "doc_id long, n_words long, score double")
    return sums.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("score") / F.col("n_words"))))
