"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Candidates are dealt into blocks; each block is an index: per dimension, its vectors' components are quantised
and the vectors form posting segments of equal quantised impact. A query visits the segments of all dimensions
in descending order of impact (weight times level, counted from the dimension's lowest, so never negative) and
adds the impact to the segment's accumulators. At any time a vector's final score lies between its
accumulator and that plus the largest impacts still to come plus the quantisation remainder. The walk stops only when this
proves that all but a few vectors are out of the best k; those left are rescored with the exact integers. Each block gives its k
best for a query, and the k best of those are the answer, which is exact by construction.

Queries are blocked too: a task holds one block of queries and one of candidates, both of fixed size, so memory
does not depend on the tables, and a lost task is redone from the shuffle files.

Defined cases: vectors that are null or hold null or non-finite components take no part; a query is compared with vectors of its
own length only; rows that share the query's id count as its own; repeated rows of a query are one query (those that share an id but differ are ranked together), and
repeated candidates are candidates each; equal scores go to the smaller id; a query with fewer than
k candidates gets all of them; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 8192
QUERIES = 4096
LEVELS = 16
FEW = 64
#: Segments between two looks for a proof, as a share of all.
LOOK = 0.1


class Index:
    """Posting segments of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, dims = vectors.shape
        low, high = (self.vectors.min(0), self.vectors.max(0)) if n and dims else (np.zeros(dims, np.int64),) * 2
        self.low = low
        self.width = np.maximum(1, (high - low) // LEVELS + 1)
        level = (self.vectors - low) // self.width
        self.top = level.max(0) if n and dims else low
        dim, segments, starts = [], [], [0]
        lists = []
        for d in range(dims):
            by = np.argsort(level[:, d], kind="stable")
            values, first = np.unique(level[by, d], return_index=True)
            for v, a, b in zip(values, first, [*first[1:], n]):
                dim.append(d)
                segments.append(v)
                starts.append(starts[-1] + b - a)
                lists.append(by[a:b])
        self.dim, self.level, self.starts = np.array(dim, np.int64), np.array(segments, np.int64), np.array(starts)
        self.lists = lists

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best other vectors; ties to smaller ids."""
        n = len(self.ids)
        weight = np.abs(query)
        up = query >= 0
        # Impacts counted from the least that the dimension can give; what quantisation hides is at most slack.
        step = weight * self.width
        impact = step[self.dim] * np.where(up[self.dim], self.level, self.top[self.dim] - self.level)
        slack = int((weight * (self.width - 1)).sum())
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        scores = np.zeros(n, np.int64)
        others = self.ids != own
        members = np.flatnonzero(others)
        if len(members) > FEW + k:
            look = max(1, int(len(order) * LOOK))
            for a in range(0, len(order), look):
                for s in order[a : a + look]:
                    scores[self.lists[s]] += impact[s]
                rest = order[a + look :]
                ahead = np.zeros(len(query), np.int64)
                np.maximum.at(ahead, self.dim[rest], impact[rest])
                now = scores[members]
                least = np.partition(now, len(now) - k)[len(now) - k]  # k vectors have this much at least
                possible = members[now + int(ahead.sum()) + slack >= least]
                if len(possible) <= FEW + k or len(rest) == 0:
                    members = possible
                    break
        exact = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members][best], exact[best]


def search(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors, the components turned into floor(scale * x)."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(key).cast("long").alias("id"), is_query.alias("q"), F.col(vector).cast("array<double>").alias("v"))

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, queries, blobs, dims = [], [], [], []
            for i, q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values, float)
                if np.isfinite(x).all():
                    ids.append(i)
                    queries.append(bool(q))
                    blobs.append(np.floor(scale * x).astype("<i8").tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(queries, pa.bool_()), pa.array(blobs, pa.binary()), pa.array(dims, pa.int32())], ["id", "q", "v", "dims"])

    ints = source.mapInArrow(integers, "id long, q boolean, v binary, dims int")
    total, asked = ints.agg(F.count("*"), F.count_if("q")).first()
    n_blocks, q_blocks = max(1, -(-total // CANDIDATES)), max(1, -(-asked // QUERIES))
    deal = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = ints.where("q").dropDuplicates(["id", "v"]).withColumn("qb", deal(1, q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = ints.withColumn("cb", deal(2, n_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    names = ["dims", "qb", "cb"]

    def block(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(candidates):
            unpack = lambda f: np.frombuffer(b"".join(f["v"]), "<i8").reshape(len(f), -1)
            index = Index(candidates["id"].to_numpy(), unpack(candidates))
            for own, query in zip(queries["id"].tolist(), unpack(queries)):
                ids, scores = index.search(query, own, k)
                out += zip([own] * len(ids), ids.tolist(), scores.tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(block, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
