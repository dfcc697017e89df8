"""Intermediate tables, written once where the driver and all executors can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (local tests) a
temporary folder of this machine is taken. A table read from there needs none of the work before it, so a lost
executor costs no more than the stage it was in. The folder goes when the application ends; ``discard`` deletes one table before, ``sweep`` all of them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
#: Rows of ids or counters, some tens of bytes each, up to which a table is sent to all tasks.
FEW = 200_000
_leaving: set[str] = set()


def folder(spark: SparkSession) -> str:
    root = spark.conf.get(KEY, None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {KEY} to a folder that driver and executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set(KEY, root)
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder(spark) not in _leaving:
        _leaving.add(folder(spark))
        fs, own = _hadoop(spark, folder(spark))
        fs.deleteOnExit(own)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discard(df: DataFrame) -> None:
    """Deletes a table that ``keep`` has returned and that nothing reads any more."""
    fs, p = _hadoop(df.sparkSession, df._kept)
    fs.delete(p, True)


def sweep(spark: SparkSession) -> None:
    fs, p = _hadoop(spark, folder(spark))
    fs.delete(p, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """These names, each with underscores before it until columns has none like it."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def hot_join(many: DataFrame, one: DataFrame, key: str, weight: str) -> DataFrame:
    """many with the columns of one, or nulls; one, which ``keep`` has written, has a row for each key and how many rows of many have it, in the column weight. Keys
    with a thousandth of these rows or more, a thousand keys at most, are broadcast, so that none of them fills a task."""
    total = one.agg(F.sum(weight)).first()[0] or 0
    large = F.col(weight) * 1000 >= max(total, 100_000)
    hot = F.broadcast(one.where(large).drop(weight))
    rest = many.join(F.broadcast(one.where(large).select(key)), key, "left_anti").join(one.where(~large).drop(weight), key, "left")
    return many.join(hot, key).unionByName(rest)


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df; marked for broadcast only if a count says that it has at most rows rows."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """At most rows rows, those whose key has the smallest hash. Before they are ordered, rows that can't be among them are left out by
    their hash alone, so that no task sorts more than a little above rows, however large df is."""
    total = df.count()
    span = 1 << 40
    least = min(span, int(span * (rows + 6 * rows**0.5 + 100) / max(1, total)))
    place = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(span))
    return df.where(place < least).orderBy(place, key).limit(rows)
