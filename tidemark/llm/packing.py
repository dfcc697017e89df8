"""Best-fit packing of documents into training sequences, by large-item matching.

Token lengths are at most ``capacity``, so the whole packing problem is a histogram of at most ``capacity`` counts,
whatever the number of documents. ``plan`` packs the histogram on the driver with multiplicities: lengths above a
third of the capacity (two of them fit a bin at most) are paired greedily, the longest with the longest that still
fits; then the shorter lengths, longest first, go into the smallest gap that holds them, and open bins when
none does. Its result is a list of runs ("ranks a to b of length n go to sequences s.. at this offset") whose number
depends on the capacity alone. Executors tokenise once, rank the pieces within their length in salted groups (a
length shared by a third of all rows is spread over all tasks), and look their place up in the runs.

Defined cases: a null text is an empty one; every document ends with ``end_id``, so an empty text is one
piece of one token; repeated rows are packed once each; an empty table gives an empty result; columns besides
``doc_id`` and ``text`` are ignored. A document longer than the capacity is cut into full pieces with the remainder first.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 2048
END_ID = 0
#: Letters, digits and signs on which every Unicode version agrees: such texts may take the quicker of the two libraries.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
_cache: dict[str, object] = {}


def encoder(tokenizer: str = TOKENIZER, ranks: str | None = RANKS):
    """A function from text to a uint32 array of ids, as the tokenizers library gives them for the file
    ``tokenizer``. With ``ranks``, the same vocabulary as a rank file, plain texts are encoded by tiktoken."""
    key = f"{tokenizer}|{ranks}"
    if key not in _cache:
        import base64

        import public_tokenizers
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        quick = None
        if ranks:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
            quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if quick and _PLAIN.fullmatch(text) and not any(s in text for s in special):
                return quick.encode_to_numpy(text)
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

        _cache[key] = encode
    return _cache[key]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                start, k = 0, 0
                while start < len(ids):
                    stop = start + ((len(ids) - start) % capacity or capacity)
                    part = ids[start:stop].tobytes()
                    for column, value in zip(out, (doc, k, start, stop - start, zlib.crc32(part), part)):
                        column.append(value)
                    held += len(part)
                    start, k = stop, k + 1
                if with_ids and held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset) that place every item of the histogram."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError(f"lengths outside 1..{capacity}")
    rows: list[tuple[int, int, int, int, int]] = []
    given: dict[int, int] = defaultdict(int)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, number)
    mask = 0  # bit g is set while gaps[g] has runs

    def place(length: int, number: int, sequence: int, offset: int) -> None:
        rows.append((length, given[length], number, sequence, offset))
        given[length] += number
        left[length] -= number

    def put_back(gap: int, sequence: int, number: int) -> None:
        nonlocal mask
        if gap and number:
            gaps[gap].append((sequence, number))
            mask |= 1 << gap

    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            m = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            t = left[n] if m is None else left[n] // 2 if m == n else min(left[n], left[m])
            place(n, t, bins, 0)
            if m is not None:
                place(m, t, bins, n)
            put_back(capacity - n - (m or 0), bins, t)
            bins += t
    for n in sorted((n for n in left if n <= third), reverse=True):
        while left[n]:
            fitting = mask >> n
            if fitting:
                gap = n + (fitting & -fitting).bit_length() - 1
                sequence, number = gaps[gap].pop()
                if not gaps[gap]:
                    mask &= ~(1 << gap)
                t = min(number, left[n])
                put_back(gap, sequence + t, number - t)
            else:
                gap, sequence = capacity, bins
                t = max(1, left[n] // (capacity // n))
                bins += t
            place(n, t, sequence, capacity - gap)
            put_back(gap - n, sequence, t)
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = storage.keep(pieces(docs, capacity, end_id, tokenizer, ranks, with_ids), "pieces")
    salts = 4 * storage.partitions(spark)
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = cut.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # At most capacity x salts rows: where in its length each salted group begins.
    w = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = storage.keep(groups.withColumn("_first", F.coalesce(F.sum("_n").over(w), F.lit(0))), "lengths")
    counts = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("_n")).collect()}
    runs = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1).join(groups.drop("_n"), ["length", "_salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*names, (F.col("_first") + F.col("_rank")).cast("long").alias("_rank"))
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence, offset = runs[at, 3] + rank - runs[at, 1], runs[at, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return ranked.mapInArrow(locate, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids (little-endian unsigned 32-bit), of a result of ``pack`` with ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
