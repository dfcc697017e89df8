"""Joins. Equal keys and the rest of the condition are given apart, so that Catalyst sees an equi-join wherever there is one.

An inner join whose only condition is that a number lies in a range would pair all rows with all. It is made an equi-join by bins: a range
is given to each bin it touches, a number to its one bin, so every pair meets exactly once. The width of the bins comes
from the ranges' lengths, so that a range touches ``BINS`` bins at most, and about two in the middle.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rendering import Renderer
from ..functions.tree import Between, Binary, Node, Slot, conjuncts, walk
from ..plans.model import Join

BINS = 64
#: Pairs that one task of a join of many pairs makes, more or less, and the most shares that a key's rows are dealt into.
TASK_PAIRS, SHARES = 4_000_000, 64
#: Columns of a NOT IN up to which each set of them gets a join of its own.
KEYS = 4
HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def on(stage: Join, left: DataFrame, right: DataFrame) -> Column:
    both = Renderer(left.limit(0).join(right.limit(0)))
    terms = [both(Binary("=", a, b)) for a, b in stage.keys] + ([both(stage.condition)] if stage.condition else [])
    return F.expr(" AND ".join(terms) or "true")


def join(stage: Join, left: DataFrame, right: DataFrame) -> DataFrame:
    if stage.kind == "null_aware_anti":
        return not_in(stage, left, right)
    if stage.kind == "inner" and not stage.keys and stage.condition is None:
        return left.crossJoin(right)  # asked for as such
    if stage.kind == "inner" and not stage.keys:
        bounds = range_bounds(stage.condition, set(left.columns), set(right.columns))
        if bounds and (binned := range_join(stage, left, right, *bounds)) is not None:
            return binned
    return left.join(right, on(stage, left, right), HOW[stage.kind])


def join_many(stage: Join, left: DataFrame, right: DataFrame, pairs: float, rows: tuple[int, int]) -> DataFrame:
    """The same rows as ``join``, for keys that each have many rows: tasks are as many as the pairs need, and one key is worked on by several. One side's rows are dealt into
    shares, the other side's are repeated for each. rows: of left and right."""
    if stage.kind not in ("inner", "left", "right", "full") or not stage.keys:
        return join(stage, left, right)
    if stage.kind == "full":
        # Left rows with and without partners, then right rows without: those ask for the values of left rows only.
        met = join_many(replace(stage, kind="left"), left, right, pairs, rows)
        named = _slots(*(x for k in stage.keys for x in k), *([stage.condition] if stage.condition else []))
        asked = [c for c in left.columns if c in named]
        alone = right.join(left.select(*asked).distinct(), on(stage, left, right), "left_anti")
        return met.unionByName(alone, allowMissingColumns=True)
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
    dealt_left = stage.kind == "left" or stage.kind == "inner" and rows[0] >= rows[1]
    shares = int(min(SHARES, max(1, tasks // 16), max(1, pairs // (8 * max(1, rows[dealt_left])))))
    r, s = Renderer(left), Renderer(right)
    sides = []
    for df, keys, dealt in ((left, [r(a) for a, _ in stage.keys], dealt_left), (right, [s(b) for _, b in stage.keys], not dealt_left)):
        own = "l" if df is left else "r"
        share = f"pmod(xxhash64({', '.join(f'`{c}`' for c in df.columns)}), {shares})" if dealt else f"explode(sequence(0L, {shares - 1}L))"
        df = df.selectExpr("*", *(f"{k} AS __{own}{i}" for i, k in enumerate(keys)), f"{share} AS __{own}")
        sides.append(df.repartition(tasks, f"__{own}", *(f"__{own}{i}" for i in range(len(keys)))))
    equal = replace(stage, keys=((Slot("__l"), Slot("__r")), *((Slot(f"__l{i}"), Slot(f"__r{i}")) for i in range(len(stage.keys)))))
    return sides[0].join(sides[1].hint("merge"), on(equal, *sides), HOW[stage.kind]).select(*left.columns, *right.columns)


def not_in(stage: Join, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left whose keys are IN right neither truly nor possibly (null)."""
    r, s = Renderer(left), Renderer(right)
    if len(stage.keys) == 1 and stage.condition is None:
        # A null on the right, or a null key and any row on the right, leaves the answer open; two counts tell, and the rest is an equi-join.
        (a, b) = stage.keys[0]
        counts = right.selectExpr("count(*) AS __rows", f"count(CASE WHEN {s(b)} IS NULL THEN 1 END) AS __nulls")
        kept = left.join(F.broadcast(counts), F.expr(f"__rows = 0 OR (__nulls = 0 AND {r(a)} IS NOT NULL)")).select(*left.columns)
        return kept.join(right, F.expr(f"{r(a)} = {s(b)}"), "left_anti")
    if stage.condition is None and len(stage.keys) <= KEYS:
        return _not_in_rows(stage, left, right, r, s)
    both = Renderer(left.limit(0).join(right.limit(0)))
    equal = " AND ".join(both(Binary("=", a, b)) for a, b in stage.keys)
    open_or_equal = f"coalesce({equal}, true)"
    return left.join(right, F.expr(open_or_equal + (f" AND {both(stage.condition)}" if stage.condition else "")), "left_anti")


def _not_in_rows(stage: Join, left: DataFrame, right: DataFrame, r: Renderer, s: Renderer) -> DataFrame:
    """NOT IN of several columns. Two rows meet if they agree in all columns that neither has as null; for each set of such columns that is an equi-join, with
    which columns the left row knows as one more key."""
    places = range(len(stage.keys))
    known = lambda side: " + ".join(f"CASE WHEN __{side}{i} IS NULL THEN 0 ELSE {1 << i} END" for i in places)
    kept = left.selectExpr("*", *(f"{r(a)} AS __a{i}" for i, (a, _) in enumerate(stage.keys))).selectExpr("*", f"{known('a')} AS __known")
    rows = right.selectExpr(*(f"{s(b)} AS __b{i}" for i, (_, b) in enumerate(stage.keys))).distinct().selectExpr("*", f"{known('b')} AS __seen")
    for common in reversed(range(1 << len(stage.keys))):
        columns = [i for i in places if common >> i & 1]
        lefts = ", ".join(str(m) for m in range(1 << len(stage.keys)) if m & common == common)
        met = rows.selectExpr(*(f"__b{i}" for i in columns), "__seen", f"explode(array({lefts})) AS __for").where(f"(__for & __seen) = {common}").drop("__seen").distinct()
        equal = " AND ".join(["__known = __for", *(f"__a{i} = __b{i}" for i in columns)])
        # Without columns in common, met has a row for each set of columns at most.
        kept = kept.join(met if columns else F.broadcast(met), F.expr(equal), "left_anti")
    return kept.select(*left.columns)


def _slots(*nodes: Node) -> set[str]:
    return {x.name for n in nodes for x in walk(n) if isinstance(x, Slot)}


def range_bounds(condition: Node | None, left: set[str], right: set[str]) -> tuple[bool, Node, Node, Node] | None:
    """(whether the number is on the left, number, low, high), if the condition says that a number of one side lies between two of the other."""

    def across(x: Node, low: Node, high: Node) -> tuple[bool, Node, Node, Node] | None:
        own, ends = _slots(x), [_slots(low), _slots(high)]
        for number_left, a, b in ((True, left, right), (False, right, left)):
            if own and own <= a and all(e and e <= b for e in ends):
                return number_left, x, low, high
        return None

    least: list[tuple[Node, Node]] = []
    most: list[tuple[Node, Node]] = []
    for t in conjuncts(condition):
        if isinstance(t, Between) and not t.negated:
            if found := across(t.x, t.low, t.high):
                return found
        elif isinstance(t, Binary) and t.op in (">=", ">", "<=", "<"):
            (least if t.op[0] == ">" else most).append((t.a, t.b))
            (most if t.op[0] == ">" else least).append((t.b, t.a))
    for x, low in least:
        for y, high in most:
            if x == y and (found := across(x, low, high)):
                return found
    return None


def range_join(stage: Join, left: DataFrame, right: DataFrame, number_left: bool, x: Node, low: Node, high: Node) -> DataFrame | None:
    """None if the bounds aren't numbers."""
    points, ranges = (left, right) if number_left else (right, left)
    p, r = Renderer(points), Renderer(ranges)
    kinds = {p.kind(x), r.kind(low), r.kind(high)}
    if not all(k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal") for k in kinds):
        return None
    number, a, b = (f"CAST({e} AS DOUBLE)" for e in (p(x), r(low), r(high)))
    finite = lambda e: f"({e} > double('-Infinity') AND {e} < double('Infinity'))"
    inside, odd = ranges.where(f"{finite(a)} AND {finite(b)}"), ranges.where(f"NOT ({finite(a)} AND {finite(b)})")
    longest, middle = inside.selectExpr(f"max({b} - {a})", f"percentile_approx({b} - {a}, 0.5)").first()
    if longest is None:
        longest = middle = 0.0
    width = max(longest / (BINS - 1), middle, 1e-12) or 1.0
    width = width if longest > 0 else 1.0
    cell = lambda e: f"CAST(floor({e} / {width!r}D) AS BIGINT)"
    dealt = inside.where(f"{a} <= {b}").selectExpr("*", f"explode(sequence({cell(a)}, {cell(b)})) AS __bin_r")
    placed = points.where(finite(number)).selectExpr("*", f"{cell(number)} AS __bin_p")
    sides = (placed, dealt) if number_left else (dealt, placed)
    columns = [*left.columns, *right.columns]
    condition = on(stage, left, right)
    met = sides[0].join(sides[1], (F.col("__bin_p") == F.col("__bin_r")) & condition).select(*columns)
    # NaN and the infinities have no bin; there are few, if any.
    strange = points.where(f"NOT {finite(number)}")
    both = lambda u, v: (u.join(v, condition) if number_left else v.join(u, condition)).select(*columns)
    if not any(k in ("float", "double") for k in kinds):
        return met
    return met.unionByName(both(strange, ranges)).unionByName(both(points.where(finite(number)), odd))
