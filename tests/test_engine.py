"""Maintained results against fresh evaluation, after every epoch, under the operations and accidents that a source can see."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.ivm_queries import MAINTAINED
from tidemark.plans.parser import SqlError
from tidemark.sources.changelog import ChangeLogError
from tidemark.streaming.engine import Engine, EngineConfig, EngineError

LEFT = "id int, group_id int, amount int, label string"
RIGHT = "id int, group_id int, amount int"
RESULTS = {
    "filtered": "SELECT id, amount, label FROM l WHERE amount IS NOT NULL AND group_id IS DISTINCT FROM 2",
    "joined": "SELECT l.id, r.id AS rid, l.amount + r.amount AS total FROM l LEFT JOIN r ON l.group_id = r.group_id",
    "grouped": "SELECT group_id, count(*) AS n, sum(amount) AS s, max(label) AS m FROM l GROUP BY group_id",
    "summed": "SELECT group_id, count(*) AS n, count(amount) AS c, sum(amount) FILTER (WHERE id > 3) AS s, avg(amount) AS a FROM l GROUP BY group_id",
    "summed_all": "SELECT count(*) AS n, sum(amount) AS s FROM l WHERE amount > 4",
    "distinct_groups": "SELECT DISTINCT group_id FROM l",
    "bag": "SELECT group_id FROM l UNION ALL SELECT group_id FROM r",
    "ranked": "SELECT id, rank() OVER (PARTITION BY group_id ORDER BY amount, id) AS k FROM l",
    "best": "SELECT id, amount FROM l ORDER BY amount DESC, id LIMIT 3",
    "open_set": "SELECT id FROM l WHERE group_id NOT IN (SELECT group_id FROM r)",
}


def same(a, b):
    b = b.toDF(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine", EngineConfig(buckets=2, compact_after=3))
    e.register_source("l", rows(spark, LEFT, (1, 1, 5, "a"), (2, None, 7, None), (3, 2, None, "c"), (4, 1, 5, "a"), (4, 1, 5, "a")))
    e.register_source("r", rows(spark, RIGHT, (1, 1, 10), (2, 3, 20), (3, 1, None)))
    e.start()
    return e


def test_differential(spark, engine):
    """Random inserts, updates and deletes with nulls; every result equals recomputation after each epoch."""
    for name, sql in RESULTS.items():
        engine.create(name, sql)
        assert same(engine.read(name), engine.recompute(name)), name
    seed = 7919

    def draw(n):
        nonlocal seed
        seed = (seed * 1103515245 + 12345) % 2147483647
        return seed % n

    held = {"l": [(1, 1, 5, "a"), (2, None, 7, None), (3, 2, None, "c"), (4, 1, 5, "a"), (4, 1, 5, "a")], "r": [(1, 1, 10), (2, 3, 20), (3, 1, None)]}
    schemas = {"l": LEFT, "r": RIGHT}

    def fresh(t):
        row = (1 + draw(12), None if draw(7) == 0 else draw(4), None if draw(5) == 0 else draw(25) - 12)
        return (*row, f"x{draw(3)}") if t == "l" else row

    rounds = int(os.environ.get("FUZZ_ROUNDS", "6"))
    for _ in range(rounds):
        for _ in range(2):
            txn = engine.begin()
            for _ in range(2):
                t = "lr"[draw(2)]
                op = draw(3)
                if op == 0 or not held[t]:
                    new = fresh(t)
                    txn.insert(t, rows(spark, schemas[t], new))
                    held[t].append(new)
                elif op == 1:
                    old = held[t].pop(draw(len(held[t])))
                    txn.delete(t, rows(spark, schemas[t], old))
                else:
                    old, new = held[t].pop(draw(len(held[t]))), fresh(t)
                    txn.update(t, rows(spark, schemas[t], old), rows(spark, schemas[t], new))
                    held[t].append(new)
            txn.commit()
        assert engine.run_available() >= 1
        for t in "lr":
            assert same(engine.table(t), rows(spark, schemas[t], *held[t])), t
        for name in RESULTS:
            assert same(engine.read(name), engine.recompute(name)), name
    assert {r.name: r.value for r in engine.runtime_metrics().collect()}["transactions_committed"] == 2 * rounds


def test_transactions(spark, engine):
    engine.create("c", "SELECT count(*) AS n FROM l")
    new = rows(spark, LEFT, (9, 9, 9, "z"))
    count = lambda: engine.read("c").first()[0]
    assert count() == 5
    engine.begin().insert("l", new).abort()
    left_open = engine.begin().insert("l", new)
    engine.run_available()
    assert count() == 5
    txn = engine.begin().insert("l", new)
    a = txn.savepoint()
    txn.insert("l", new)
    b = txn.savepoint()
    txn.insert("l", new)
    txn.release(b)
    txn.rollback_to(a)
    txn.insert("l", new)
    txn.commit()
    engine.run_available()
    assert count() == 7
    left_open.commit()
    assert engine.progress("c")["pending_transactions"] == 1
    engine.run_available()
    assert count() == 8 and engine.progress("c")["pending_transactions"] == 0
    with pytest.raises(ChangeLogError):
        left_open.commit()
    with pytest.raises(ChangeLogError):
        engine.begin().truncate("l")
    with pytest.raises(ChangeLogError):
        engine.begin().rollback_to(3)


@pytest.mark.parametrize("when", ["before", "after"])
def test_crash_around_the_commit_point(spark, engine, when):
    """What dies before the manifest leaves the old result; what dies after it is not applied twice."""
    engine.create("s", "SELECT group_id, count(*) AS n FROM l GROUP BY group_id")
    old = engine.read("s").collect()
    engine.begin().insert("l", rows(spark, LEFT, (20, 1, 1, "q"))).commit()

    def crash(at, name):
        if at == when:
            raise RuntimeError("crash")

    engine.at_commit = crash
    with pytest.raises(Exception, match="crash"):
        engine.run_available()
    if when == "before":
        assert sorted(map(str, engine.read("s").collect())) == sorted(map(str, old))
    again = Engine(spark, engine.root, engine.config)
    again.start()
    again.run_available()
    assert same(again.read("s"), again.recompute("s"))
    assert again.progress("s")["pending_transactions"] == 0


def test_lifecycle(spark, engine):
    engine.execute("CREATE TABLE results.t AS SELECT id FROM l WHERE id > 1;")
    assert engine.results() == ["t"] and sorted(engine.sources()) == ["l", "r"]
    explained = engine.explain("t")
    assert [s["operator"] for s in explained["stages"]] == ["Scan", "Filter", "Project", "Sink"]
    assert engine.snapshot()["runtime"]["active"] and engine.dataflow_status().first().result == "t"
    with pytest.raises(EngineError):
        engine.create("t", "SELECT id FROM l")
    with pytest.raises(EngineError):
        engine.drop_source("l")
    engine.execute("DROP TABLE t")
    assert engine.results() == []
    with pytest.raises(SqlError):
        engine.execute("DELETE FROM l")
    with pytest.raises(EngineError):
        engine.read("t")
    engine.stop()
    with pytest.raises(EngineError):
        engine.run_available()


def test_negative_multiplicity_is_an_error(spark, engine):
    engine.create("d", "SELECT DISTINCT id FROM l")
    engine.begin().delete("l", rows(spark, LEFT, (77, 7, 7, "n"))).commit()
    with pytest.raises(Exception, match="below zero"):
        engine.run_available()


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT now() AS t FROM l", "SELECT rand() AS x FROM l", "SELECT 1", "SELECT id FROM l LIMIT 3", "SELECT DISTINCT ON (id) id FROM l", "SELECT id, id FROM l",
        "SELECT id FROM missing", "SELECT nothing FROM l", "SELECT id FROM l FOR UPDATE", "SELECT group_id, id FROM l GROUP BY group_id", "SELECT count(count(*)) FROM l",
        "SELECT id FROM l, LATERAL (SELECT 1) x", "SELECT (SELECT 1 FROM r) AS x FROM l", "SELECT group_id FROM l GROUP BY ROLLUP (group_id)", "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY id) FROM l",
        "INSERT INTO l VALUES (1)", "SELECT id FROM l WHERE EXISTS (SELECT 1 FROM r) OR id = 1",
    ],
)
def test_rejected(engine, sql):
    with pytest.raises(SqlError):
        engine.create("x", sql)


@pytest.mark.parametrize("name", ["ivm_not_in", "ivm_chain"])
def test_maintained_queries_parse(name):
    from tidemark.plans.parser import parse

    assert parse(MAINTAINED[name][0]).items


@pytest.mark.parametrize(("written", "limit", "offset"), [("LIMIT 1+1", 2, 0), ("LIMIT CAST(7 AS BIGINT) / 2 OFFSET 2 * 3 - 5", 3, 1), ("LIMIT 17 % 10 OFFSET 1", 7, 1), ("OFFSET 4 LIMIT 5", 5, 4), ("FETCH FIRST 3 ROWS ONLY", 3, 0)])
def test_limits_are_constant_expressions(written, limit, offset):
    from tidemark.plans.parser import parse

    q = parse(f"SELECT id FROM l ORDER BY id {written}")
    assert (q.limit, q.offset) == (limit, offset)
    for bad in ("LIMIT -1", "LIMIT 1 - 2", "LIMIT 1/0", "LIMIT id", "LIMIT 1.5"):
        with pytest.raises(SqlError):
            parse(f"SELECT id FROM l ORDER BY id {bad}")


def test_index(spark, engine):
    engine.create("g", "SELECT group_id, amount, id FROM l")
    engine.create_index("g", "by_group", ["group_id"])
    look = lambda *v: sorted(r.id for r in engine.lookup("g", "by_group", *v).collect())
    assert look(1) == [1, 4, 4] and look(None) == [2] and look(9) == []
    engine.begin().insert("l", rows(spark, LEFT, (30, 9, 1, "i"))).delete("l", rows(spark, LEFT, (4, 1, 5, "a"))).commit()
    engine.run_available()
    assert look(1) == [1, 4] and look(9) == [30] and same(engine.read("g"), engine.recompute("g"))
    for bad in (["nothing"], [], ["id"] * 9):
        with pytest.raises(EngineError):
            engine.create_index("g", "other", bad)
    engine.drop_index("g", "by_group")
    with pytest.raises(EngineError):
        engine.lookup("g", "by_group", 1)


def test_range_join_has_every_pair_once(spark):
    """Bins against plain comparison, with null, reversed, huge and non-finite bounds."""
    from tidemark import operators
    from tidemark.plans.lowering import lower

    nan, inf = float("nan"), float("inf")
    points = rows(spark, "id int, x double", *enumerate([0.0, -0.0, 1.5, 2.0, -7.25, 1e12, None, nan, inf, -inf, 3.0, 3.0]))
    ranges = rows(spark, "k int, lo double, hi double", *((i, *b) for i, b in enumerate([(0.0, 2.0), (2.0, 2.0), (3.0, 1.0), (None, 5.0), (-1e13, 1e13), (-10.0, nan), (-inf, 0.0), (inf, inf), (2.5, 3.5), (-8.0, -7.0)])))
    tables = {"p": points, "r": ranges}
    schemas = {n: tuple(t.columns) for n, t in tables.items()}
    for where in ("p.x BETWEEN r.lo AND r.hi", "p.x >= r.lo AND r.hi > p.x", "r.lo < p.x AND p.x <= r.hi AND p.id <> r.k"):
        for source in ("p JOIN r", "r JOIN p"):
            got = operators.evaluate(lower(f"SELECT p.id, r.k FROM {source} ON {where}", schemas), tables.__getitem__)
            want = points.alias("p").crossJoin(ranges.alias("r")).where(where).selectExpr("p.id", "r.k")
            assert same(got, want), (where, source)


def test_continuous_run(spark, engine):
    engine.create("c", "SELECT count(*) AS n FROM l")
    running = engine.run_continuously()
    try:
        for i in range(2):
            engine.wait_for("c", engine.begin().insert("l", rows(spark, LEFT, (50 + i, 1, 1, "s"))).commit())
            assert engine.read("c").first()[0] == 6 + i
        with pytest.raises(EngineError):
            engine.wait_for("c", engine.log.latest() + 1, 0.1)
    finally:
        running.stop()


def test_commits_of_several_writers_in_any_order(spark, engine):
    """A transaction that began first and is published last, writers that claim numbers at the same time, and a stream that sees a later file first: nothing is lost or done twice."""
    from concurrent.futures import ThreadPoolExecutor

    engine.create("c", "SELECT count(*) AS n FROM l")
    others = [Engine(spark, engine.root, engine.config) for _ in range(3)]
    first = others[0].begin().insert("l", rows(spark, LEFT, (60, 1, 1, "a")))
    second = others[1].begin().insert("l", rows(spark, LEFT, (61, 1, 1, "a")))
    assert second.commit() < first.commit()
    engine.run_available()
    assert engine.read("c").first()[0] == 7
    open_ones = [e.begin().insert("l", rows(spark, LEFT, (70 + i, 1, 1, "a"))) for i, e in enumerate(others * 2)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda t: t.commit(), open_ones))
    assert sorted(numbers) == list(range(3, 9)) and len({engine.log.record(n)["txn_id"] for n in numbers}) == 6
    engine._epoch(spark.createDataFrame([(f"{8:020}.json",)], "name string"), 0)  # one file of six
    assert engine.read("c").first()[0] == 13 and engine.progress("c")["pending_transactions"] == 0
    engine.run_available()
    assert engine.read("c").first()[0] == 13 and same(engine.read("c"), engine.recompute("c"))


def test_rows_that_do_not_fit_are_refused(spark, engine):
    engine.create("c", "SELECT id, amount FROM l")
    bad = ["id int, group_id int, amount int", "id int, group_id int, amount int, label string, more int", "id string, group_id int, amount int, label string", "id long, group_id int, amount int, label string"]
    for schema in bad:
        txn = engine.begin()
        for write in (txn.insert, txn.delete, lambda t, df, txn=txn: txn.update(t, df, df)):
            with pytest.raises(ChangeLogError):
                write("l", spark.createDataFrame([], schema))
        txn.abort()
    with pytest.raises(EngineError):
        engine.begin().insert("unknown", rows(spark, "id int", (1,)))
    fits = spark.sql("SELECT 'z' AS label, CAST(5 AS SMALLINT) AS amount, NULL AS group_id, 80 AS id")  # other order, a smaller type, a typed null
    engine.begin().insert("l", fits).commit()
    engine.run_available()
    assert [tuple(r) for r in engine.read("c").where("id = 80").collect()] == [(80, 5)]


def test_a_failing_result_does_not_stop_the_others(spark, engine):
    engine.create("healthy", "SELECT count(*) AS n FROM l")
    engine.create("poisoned", "SELECT DISTINCT id FROM l")
    engine.create("elsewhere", "SELECT count(*) AS n FROM r")
    engine.begin().delete("l", rows(spark, LEFT, (77, 7, 7, "n"))).insert("l", rows(spark, LEFT, (78, 7, 7, "n"), (79, 7, 7, "n"))).commit()
    with pytest.raises(EngineError, match="poisoned.*below zero"):
        engine.run_available()
    assert engine.read("healthy").first()[0] == 6 and engine.read("poisoned").count() == 4
    engine.begin().insert("r", rows(spark, RIGHT, (9, 9, 9))).commit()
    with pytest.raises(EngineError, match="poisoned"):
        engine.run_available()
    assert engine.read("elsewhere").first()[0] == 4
    status = {r.result: r for r in engine.dataflow_status().collect()}
    assert status["poisoned"].state == "failed" and status["poisoned"].failures == 2 and status["poisoned"].lag == 2 and status["healthy"].state == "current"
    assert engine.alerts()[0]["result"] == "poisoned" and not engine.runtime_status().first().healthy
    engine.begin().insert("l", rows(spark, LEFT, (77, 7, 7, "n"))).commit()  # the row whose deletion came too early
    with pytest.raises(EngineError):
        Engine(spark, engine.root, EngineConfig(buckets=2, files_per_epoch=1)).run_available()  # not started
    engine.run_available()
    assert same(engine.read("poisoned"), engine.recompute("poisoned")) and engine.alerts() == [] and engine.progress("poisoned")["state"] == "current"


def test_epochs_are_bounded_by_transactions_and_bytes(spark, engine):
    from dataclasses import replace

    engine.create("c", "SELECT count(*) AS n FROM l")
    for i in range(4):
        engine.begin().insert("l", rows(spark, LEFT, (90 + i, 1, 1, "b"))).commit()
    size = engine.log.record(1)["bytes"]
    assert [len(engine.log.records(0, 4, *most)) for most in ((None, None), (3, None), (64, size), (64, 2 * size + 9), (64, 1))] == [4, 3, 1, 2, 1]
    engine.config = replace(engine.config, bytes_per_epoch=size)
    engine.run_available()
    assert engine.progress("c")["epoch"] == 4 and engine.read("c").first()[0] == 9 and engine.snapshot()["history"][-1]["upto"] == 4


def test_vacuum_forgets_what_all_results_have(spark, engine):
    engine.create("s", "SELECT l.id, r.id AS rid FROM l JOIN r ON l.group_id = r.group_id")
    for i in range(3):
        engine.begin().insert("l", rows(spark, LEFT, (100 + i, 1, 1, "v"))).delete("l", rows(spark, LEFT, (4, 1, 5, "a")) if i < 2 else rows(spark, LEFT, (100, 1, 1, "v"))).commit()
        if i == 1:
            engine.run_available()
    before = sorted(map(str, engine.table("l").collect()))
    assert engine.vacuum() == 2 and engine.log.numbers() == [3]
    assert sorted(map(str, engine.table("l").collect())) == before
    engine.run_available()
    assert engine.vacuum() == 0 and engine.vacuum() == 0 and engine.log.numbers() == [3]
    assert engine.begin().insert("l", rows(spark, LEFT, (110, 1, 1, "v"))).commit() == 4
    again = Engine(spark, engine.root, engine.config)
    again.start()
    again.run_available()
    assert same(again.read("s"), again.recompute("s")) and again.progress("s")["applied_lsn"] == 4


def test_large_and_small_changes_are_applied_alike(spark, engine):
    from dataclasses import replace

    for name, sql in RESULTS.items():
        engine.create(name, sql)
    for small in (0, 10_000):
        engine.config = replace(engine.config, small_rows=small)
        engine.begin().insert("l", rows(spark, LEFT, (120, 3, 9, "q"), (121, None, None, None))).update("r", rows(spark, RIGHT, (2, 3, 20)), rows(spark, RIGHT, (2, 1, 21))).commit()
        engine.begin().delete("l", rows(spark, LEFT, (120, 3, 9, "q"))).update("r", rows(spark, RIGHT, (2, 1, 21)), rows(spark, RIGHT, (2, 3, 20))).commit()
        engine.run_available()
        for name in RESULTS:
            assert same(engine.read(name), engine.recompute(name)), (small, name)


MANY = {
    "inner": "SELECT l.id, r.id AS rid, l.amount + r.amount AS x FROM l JOIN r ON l.group_id = r.group_id AND l.amount > r.amount WHERE r.id <> 7",
    "left": "SELECT l.label, l.id, r.id AS rid FROM l LEFT JOIN r ON l.group_id = r.group_id",
    "right": "SELECT l.id, r.id AS rid FROM l RIGHT JOIN r ON l.group_id = r.group_id AND l.amount > 4",
    "whole": "SELECT l.id, r.id AS rid FROM l FULL JOIN r ON l.group_id = r.group_id AND r.amount > 5",
    "ranges": "SELECT l.id, r.id AS rid FROM l JOIN r ON l.amount BETWEEN r.amount - 9 AND r.amount + 9",
    "itself": "SELECT a.id, b.id AS bid FROM l a JOIN l b ON a.group_id = b.group_id AND a.id < b.id",
}


def test_results_of_many_pairs_are_not_written(spark, tmp_path):
    """Joins that make far more pairs than they have rows keep their inputs only; a reader gets every pair after each epoch."""
    e = Engine(spark, f"file://{tmp_path}/engine", EngineConfig(buckets=2, compact_after=3, pairs_written=100, small_rows=10))
    many = lambda f, n: [f(i) for i in range(n)]
    e.register_source("l", rows(spark, LEFT, *many(lambda i: (i, 1 if i % 9 else None, i % 13, f"x{i % 2}"), 40), (3, 1, 3, "x1"), (90, 2, 5, None)))
    e.register_source("r", rows(spark, RIGHT, *many(lambda i: (i, 1 if i % 8 else None, i % 11), 40), (91, 3, 9)))
    e.create("started_small", "SELECT l.id, r.id AS rid FROM l JOIN r ON l.group_id = r.group_id AND l.group_id > 4")
    e.create("few", "SELECT l.id, r.id AS rid FROM l JOIN r ON l.id = r.id")
    for name, sql in MANY.items():
        e.create(name, sql)
    e.start()

    def check():
        for name in [*MANY, "started_small", "few"]:
            assert same(e.read(name), e.recompute(name)), name
        assert all(e._manifest(n)["tables"]["result"] == [] and e._manifest(n)["factored"] for n in MANY) and e._manifest("few")["tables"]["result"]

    check()
    e.begin().delete("l", rows(spark, LEFT, (3, 1, 3, "x1"), (90, 2, 5, None))).update("r", rows(spark, RIGHT, (1, 1, 1)), rows(spark, RIGHT, (1, 3, 1))).commit()
    e.begin().insert("l", rows(spark, LEFT, (92, 3, 6, "n"), (92, 3, 6, "n"))).commit()
    e.run_available()
    check()
    e.begin().insert("l", rows(spark, LEFT, *many(lambda i: (100 + i, 5, i, None), 30))).insert("r", rows(spark, RIGHT, *many(lambda i: (100 + i, 5, i), 30))).commit()  # a large change
    e.run_available()
    check()
    e.create_index("left", "by_id", ["id"])
    assert sorted(map(str, e.lookup("left", "by_id", 92).collect())) == sorted(map(str, e.read("left").where("id = 92").collect())) and e._manifest("left")["tables"]["result"]
    e.drop("left")
    e.begin().delete("r", rows(spark, RIGHT, (500, 1, 1))).commit()
    with pytest.raises(EngineError, match="inner: .*below zero"):
        e.run_available()
    e.begin().insert("r", rows(spark, RIGHT, (500, 1, 1))).commit()
    e.run_available()
    assert same(e.read("whole"), e.recompute("whole")) and same(e.read("inner"), e.recompute("inner"))


def test_a_join_of_many_pairs_deals_a_large_key(spark):
    """One key with most rows, nulls and unmatched rows on both sides: the same bag as the plain join, from more than one task."""
    from tidemark import operators
    from tidemark.plans.lowering import lower
    from tidemark.streaming.delta import last_join

    tables = {"p": rows(spark, "id int, k long", *((i, 1 if i < 90 else None if i < 95 else i) for i in range(100)), (1, 1)), "q": rows(spark, "n int, k int", *((i, 1 if i < 80 else None if i < 85 else i - 3) for i in range(100)))}
    schemas = {n: tuple(t.columns) for n, t in tables.items()}
    for kind in ("JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN"):
        plan = lower(f"SELECT p.id, q.n FROM p {kind} q ON p.k = q.k AND q.n % 5 <> 2", schemas)
        join, _ = last_join(plan.top)
        left, right = (operators.apply(s, tables[s.table]) for s in join.inputs)
        got = operators.join_many(join, left, right, 2e8, (101, 100))
        assert same(operators.apply_above(plan.top, join, got), operators.evaluate(plan, tables.__getitem__)), kind
        if kind != "FULL JOIN":
            large = got.where(f"{left.columns[1]} = 1 AND {right.columns[1]} = 1")
            assert large.select(F.spark_partition_id()).distinct().count() > 1, kind


def test_joins_below_a_sum_keep_only_what_it_needs(spark, engine):
    """Rows of a join's side that differ only in columns nobody reads are one row of its state."""
    engine.register_source("many", rows(spark, RIGHT, *((i, i % 2, i % 4) for i in range(200))))
    engine.create("c", "SELECT m.amount, count(*) AS n, sum(l.amount) AS s FROM l JOIN many m ON l.group_id = m.group_id WHERE m.amount < 9 GROUP BY m.amount")
    held = engine._manifest("c")["rows"]
    assert sorted(n for k, n in held.items() if k.endswith(("_l", "_r"))) == [3, 4]  # 5 rows in 3 kinds, 200 in 4 (group and amount)
    engine.begin().delete("many", rows(spark, RIGHT, (3, 1, 3), (7, 1, 3))).insert("l", rows(spark, LEFT, (50, 0, 2, "p"))).commit()
    engine.run_available()
    assert same(engine.read("c"), engine.recompute("c"))
