"""Queries that are maintained, not evaluated: a result is registered over an altered copy of the tables, and then brought up to date
by transactions that repair the copy. In the end the sources equal the tables, so the plain query tells whether it was maintained right."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streaming.engine import Engine, EngineConfig

FACT = "(SELECT o_orderkey AS id, o_custkey % 40 AS k, nullif(o_custkey % 6, 0) AS g, CAST(o_totalprice AS BIGINT) AS v, o_orderstatus AS st FROM orders)"
DIM = "(SELECT c_custkey AS id, nullif(c_custkey % 45, 0) AS k, c_nationkey AS n, c_mktsegment AS seg FROM customer)"

# name -> (query over fact and dim, also run by the checking SQL; what that runs where it differs)
MAINTAINED: dict[str, tuple[str, str | None]] = {
    "ivm_filter": ("SELECT id, v * 2 AS w, upper(st) AS st FROM fact WHERE g IS DISTINCT FROM 3 AND v > 20000", None),
    "ivm_join": ("SELECT f.id, d.id AS did, f.v + d.n AS x FROM fact f JOIN dim d ON f.k = d.k AND f.v > d.n * 1000", None),
    "ivm_outer_join": ("SELECT f.id AS a, d.id AS b FROM fact f FULL JOIN dim d ON f.k = d.k AND d.n > 5", None),
    "ivm_left_join": ("SELECT d.id, d.seg, f.id AS fid FROM dim d LEFT JOIN fact f ON d.k = f.k", None),
    "ivm_semi_anti": ("SELECT id, v FROM fact f WHERE EXISTS (SELECT 1 FROM dim d WHERE d.k = f.k AND d.n > 3) AND NOT EXISTS (SELECT 1 FROM dim e WHERE e.n = f.g)", None),
    "ivm_not_in": ("SELECT id, g FROM fact WHERE g NOT IN (SELECT n FROM dim WHERE n < 4)", None),
    "ivm_theta_join": ("SELECT f.id, d.id AS did FROM fact f JOIN dim d ON f.v BETWEEN d.n * 4000 AND d.n * 4000 + 300", None),
    "ivm_aggregate": ("SELECT g, st, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, min(v) AS a, max(v) FILTER (WHERE k > 10) AS b, count(DISTINCT k) AS c FROM fact GROUP BY g, st", None),
    "ivm_aggregate_global": ("SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM fact WHERE v > 1000", None),
    "ivm_distinct": ("SELECT DISTINCT k, st FROM fact", None),
    "ivm_window": ("SELECT id, g, rank() OVER (PARTITION BY g ORDER BY v DESC, id) AS r, CAST(sum(v) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM fact", None),
    "ivm_topn": ("SELECT id, v FROM fact ORDER BY v DESC, id LIMIT 15 OFFSET 2", None),
    "ivm_topn_ties": ("SELECT id, k FROM fact ORDER BY k FETCH FIRST 10 ROWS WITH TIES", "SELECT id, k FROM (SELECT id, k, rank() OVER (ORDER BY k) AS rk FROM fact) t WHERE rk <= 10"),
    "ivm_bag_duplicates": ("SELECT st, k % 3 AS k FROM fact", None),
    "ivm_union_all": ("SELECT k FROM fact UNION ALL SELECT k FROM dim", None),
    "ivm_except_all": ("SELECT k FROM fact EXCEPT ALL SELECT k FROM dim", None),
    "ivm_self_join": ("SELECT a.id AS a, b.id AS b FROM dim a JOIN dim b ON a.k = b.k AND a.id < b.id", None),
    "ivm_chain": ("SELECT seg, total, r FROM (SELECT seg, total, rank() OVER (ORDER BY total DESC, seg) AS r FROM (SELECT seg, CAST(sum(v) AS BIGINT) AS total FROM fact f JOIN dim d ON f.k = d.k GROUP BY seg) a) b ORDER BY r LIMIT 4", None),
}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on a cluster it has to be named in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{root.rstrip('/')}/engine-{uuid.uuid4().hex}"


def altered(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A copy with missing, superfluous and changed rows, and what repairs it: rows to insert, to delete, and old and new rows of the changes."""
    part = F.pmod(F.xxhash64("id"), F.lit(10))
    missing = df.where(part == 0)
    changed = df.where(part == 1)
    wrong = changed.withColumn("k", F.col("k") + 3)
    extra = df.where(part == 2).withColumn("id", -F.col("id"))
    start = df.where(part > 1).unionByName(wrong).unionByName(extra).unionByName(extra.where("id % 2 = 0"))
    return start, missing, extra.unionByName(extra.where("id % 2 = 0")), wrong


def maintained(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .registry import run

        engine = Engine(spark, scratch(spark), EngineConfig(buckets=4))
        engine.start()
        tables = {"fact": run(spark, sf_dir, f"SELECT * FROM {FACT} t"), "dim": run(spark, sf_dir, f"SELECT * FROM {DIM} t")}
        repairs = {}
        for name, df in tables.items():
            start, *repairs[name] = altered(df)
            engine.register_source(name, start)
        engine.create("result", sql)
        used = [n for n in tables if n in engine.plan("result").sources]
        for name in used:
            missing, _, _ = repairs[name]
            engine.begin().insert(name, missing).abort()
            txn = engine.begin()
            mark = txn.savepoint()
            txn.insert(name, missing)
            txn.rollback_to(mark)
            txn.insert(name, missing)
            txn.commit()
        engine.run_available()
        for name in used:
            _, extra, wrong = repairs[name]
            right = tables[name].join(wrong.select("id"), "id", "left_semi").select(*tables[name].columns)
            engine.begin().delete(name, extra).update(name, wrong, right).commit()
        engine.run_available()
        return engine.read("result")

    return query


def late_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several writers: the transaction that began first is committed last, when what came after it has been applied, and two are open at once."""
    from .registry import run

    root = scratch(spark)
    engine, other = Engine(spark, root, EngineConfig(buckets=4)), Engine(spark, root, EngineConfig(buckets=4))
    engine.start()
    whole = run(spark, sf_dir, f"SELECT * FROM {FACT} t")
    start, missing, extra, wrong = altered(whole)
    engine.register_source("fact", start)
    engine.create("result", LATE)
    right = whole.join(wrong.select("id"), "id", "left_semi").select(*whole.columns)
    first = engine.begin().insert("fact", missing)
    second, third = other.begin().delete("fact", extra), engine.begin().update("fact", wrong, right)
    third.commit()
    second.commit()
    engine.run_available()
    first.commit()
    engine.run_available()
    return engine.read("result")


LATE = "SELECT st, k, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM fact GROUP BY st, k"
QUERIES = {name: maintained(sql) for name, (sql, _) in MAINTAINED.items()} | {"ivm_late_commit": late_commit}
ORACLE = {name: f"WITH fact AS {FACT}, dim AS {DIM} {oracle or sql}" for name, (sql, oracle) in MAINTAINED.items()} | {"ivm_late_commit": f"WITH fact AS {FACT} {LATE}"}
