"""Registered queries cover whole tables, on small tables whose ids no bound or modulo lets through."""

from collections import Counter

import pytest

from tidemark import ivm_queries, registry

ORDERS = [(i, i % 7, 1000.0 * i, "FOP"[i % 3]) for i in (1, 2, 3, 5, 8, 301, 302, 350)]
CUSTOMERS = [(i, i % 4, f"s{i % 2}") for i in (1, 2, 15, 101, 102)]
SUPPLIERS = [(i, i % 5) for i in (2, 40, 61, 101)]
NATIONS = [(0, 0), (0, 3), (1, 4), (2, 2), (3, 3), (7, 1)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(CUSTOMERS, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(NATIONS, "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_maintained_tables_are_whole(spark, folder):
    ids = lambda sql: sorted(r.id for r in registry.run(spark, folder, f"SELECT * FROM {sql} t").collect())
    assert ids(ivm_queries.FACT) == sorted(o[0] for o in ORDERS)
    assert ids(ivm_queries.DIM) == sorted(c[0] for c in CUSTOMERS)


def test_maintained_result_of_whole_tables(spark, folder):
    got = bag(ivm_queries.QUERIES["ivm_bag_duplicates"](spark, folder))
    assert got == Counter((st, c % 40 % 3) for _, c, _, st in ORDERS)


def test_full_joins_of_whole_tables(spark, folder):
    left, right = [(o[0], o[0] % 50 or None) for o in ORDERS], {s[0] for s in SUPPLIERS}
    expect = Counter((k, k if k in right else None, i) for i, k in left) + Counter((None, k, None) for k in right - {k for _, k in left})
    assert bag(registry.QUERIES["join_full"](spark, folder)) == expect
    x, y = {c[0]: c[1] for c in CUSTOMERS}, dict(SUPPLIERS)
    assert bag(registry.QUERIES["join_using_full"](spark, folder)) == Counter((k, x.get(k), y.get(k)) for k in x.keys() | y.keys())


def test_not_in_over_whole_table(spark, folder):
    keys = [(n, None if n % 5 == 1 else n % 5) for _, n, _ in CUSTOMERS]
    might = lambda a, b: a[0] == b[0] and b[1] in (None, a[1])
    assert bag(registry.QUERIES["anti_not_in_multi"](spark, folder)) == Counter((n[0],) for n in NATIONS if not any(might(n, k) for k in keys))
