"""Window functions, with what Spark lacks built from what it has.

GROUPS frames are RANGE frames over the peers' number (dense_rank). EXCLUDE splits a frame around what it leaves out and
combines the parts; where they would need bounds that differ by row, the frame is collected
and filtered. FILTER becomes a CASE in the argument. Row-wise lag and lead offsets, row-wise numbers of nth_value, and value functions with EXCLUDE are joins on row numbers; ntile with a row-wise number follows the
first number in the partition that isn't null.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rendering import Renderer
from ..functions.tree import Call, Frame, Literal, Node, Star
from ..functions.windows import OFFSET, RANKING, VALUE
from ..plans.model import Window
from ..plans.parser import SqlError
from .frames import Held, Kept, Over, Own, Part, arguments, combine


def window(stage: Window, df: DataFrame) -> DataFrame:
    r = Renderer(df)
    partition = [r(p) for p in stage.over.partition]
    order = r.order(stage.over.order)
    base = (f"PARTITION BY {', '.join(partition)} " if partition else "") + (f"ORDER BY {order}" if order else "")
    out = df
    frame = stage.frame
    needs_groups = frame.mode == "GROUPS" or frame.exclude in ("GROUP", "TIES") or frame.exclude == "CURRENT ROW" and frame.mode != "ROWS"
    if needs_groups and not order:
        if frame.mode == "GROUPS":
            raise SqlError("GROUPS frames need ORDER BY")
        out = out.withColumn("__g", F.lit(1).cast("bigint"))
    elif needs_groups:
        out = out.selectExpr("*", f"CAST(dense_rank() OVER ({base}) AS BIGINT) AS __g")
    if frame.exclude != "NO OTHERS":
        out = out.selectExpr("*", f"CAST(row_number() OVER ({base if order else base + 'ORDER BY 1'}) AS BIGINT) AS __n")
    made, held = [], Held()
    for call, slot in zip(stage.functions, stage.outputs[len(df.columns) :]):
        if call.where is not None and (call.name in RANKING | OFFSET or call.name == "nth_value"):
            raise SqlError(f"FILTER is not supported for {call.name}")
        if call.distinct:
            raise SqlError("DISTINCT is not supported in window functions")
        if call.name in OFFSET and len(call.args) > 1 and not _constant(call.args[1]):
            out = _moved(stage, call, out, r, base, f"__m{len(made)}")
            made.append(f"__m{len(made)} AS `{slot}`")
        elif call.name == "ntile" and not _constant(call.args[0]):
            out = _ntile(call, out, r, base, partition, f"__m{len(made)}")
            made.append(f"__m{len(made)} AS `{slot}`")
        elif call.name in VALUE and (frame.exclude != "NO OTHERS" or len(call.args) > 1 and not _constant(call.args[1])):
            out = _picked(stage, call, out, r, partition, order, f"__m{len(made)}")
            made.append(f"__m{len(made)} AS `{slot}`")
        elif call.name in RANKING:
            kind = "DOUBLE" if call.name in ("percent_rank", "cume_dist") else "BIGINT"
            made.append(f"CAST({call.name}({', '.join(map(r, call.args))}) OVER ({base or 'ORDER BY 1'}) AS {kind}) AS `{slot}`")
        elif call.name in OFFSET:
            made.append(f"{call.name}({', '.join(map(r, call.args))}) OVER ({base or 'ORDER BY 1'}) AS `{slot}`")
        else:
            made.append(f"{_framed(call, frame, r, partition, order, held)} AS `{slot}`")
    if held:
        out = out.selectExpr("*", *(f"{e} AS {name}" for e, name in held.items()))
    return out.selectExpr(*(f"`{c}`" for c in df.columns), *made)


def _constant(node: Node) -> bool:
    from ..functions.tree import Slot, walk

    return not any(isinstance(x, Slot) for x in walk(node))


def _argument(call: Call, r: Renderer) -> list[str]:
    """Arguments, with FILTER folded in."""
    args = ["1" if isinstance(a, Star) else r(a) for a in call.args] or ["1"]
    if call.where is None:
        return args
    return [f"CASE WHEN {r(call.where)} THEN {args[0]} END", *args[1:]]


def _over(partition: list[str], order: str, mode: str, start: str, end: str) -> str:
    parts = ([f"PARTITION BY {', '.join(partition)}"] if partition else []) + ([f"ORDER BY {order}"] if order else [])
    return f"OVER ({' '.join(parts)} {mode} BETWEEN {start} AND {end})"


def _bound(b, r: Renderer) -> str:
    if b.kind == "unbounded":
        return f"UNBOUNDED {'PRECEDING' if b.before else 'FOLLOWING'}"
    if b.kind == "current":
        return "CURRENT ROW"
    if not _constant(b.offset):
        raise SqlError("frame offsets that differ by row are not supported")
    if isinstance(b.offset, Literal) and b.offset.text.isdigit():
        return f"{b.offset.text} {'PRECEDING' if b.before else 'FOLLOWING'}"
    return f"{r(b.offset)} {'PRECEDING' if b.before else 'FOLLOWING'}"


def _place(b) -> float | None:
    """A bound as a signed distance."""
    if b.kind == "unbounded":
        return float("-inf") if b.before else float("inf")
    if b.kind == "current":
        return 0
    if isinstance(b.offset, Literal) and b.offset.text.isdigit():
        return int(b.offset.text) * (-1 if b.before else 1)
    return None


def _side(place: float) -> str:
    if place in (float("-inf"), float("inf")):
        return f"UNBOUNDED {'PRECEDING' if place < 0 else 'FOLLOWING'}"
    return "CURRENT ROW" if place == 0 else f"{abs(int(place))} {'PRECEDING' if place < 0 else 'FOLLOWING'}"


def _framed(call: Call, frame: Frame, r: Renderer, partition: list[str], order: str, held: Held) -> str:
    args = _argument(call, r)
    name = {"every": "bool_and", "some": "bool_or"}.get(call.name, call.name)
    nulls = " IGNORE NULLS" * call.ignore_nulls
    mode, by = (frame.mode, order) if frame.mode != "GROUPS" else ("RANGE", "__g")
    whole = not order and frame.mode == "RANGE"
    over = _over(partition, "", "ROWS", "UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING") if whole else _over(partition, by, mode, _bound(frame.start, r), _bound(frame.end, r))
    keeps_nulls = name in ("array_agg", "string_agg")
    if frame.exclude == "NO OTHERS" and not keeps_nulls:
        return f"{name}({', '.join(args)}){nulls} {over}"
    if call.ignore_nulls:
        raise SqlError("IGNORE NULLS is not supported with EXCLUDE")
    where = r(call.where) if keeps_nulls and call.where is not None else None
    asked = arguments(name, [r(a) for a in call.args] if keeps_nulls else args)
    value = asked if where is None else [f"struct({asked[0]} AS v, coalesce({where}, false) AS k)"]
    parts = [Over(over, held)] if frame.exclude == "NO OTHERS" else _parts(frame, r, partition, order, over, tuple(value), held)
    return combine(name, [*asked, *(args[1:] if name == "string_agg" else [])], parts, where)


def _parts(frame: Frame, r: Renderer, partition: list[str], order: str, over: str, values: tuple[str, ...], held: Held) -> list[Part]:
    """What EXCLUDE leaves of a frame, in its order."""
    low, high = _place(frame.start), _place(frame.end)
    fields = ", ".join([f"{x} AS v{i}" for i, x in enumerate(values)])

    def kept(of: str) -> Kept:
        keep = {"CURRENT ROW": "x.n <> __n", "GROUP": "x.g <> __g", "TIES": "x.g <> __g OR x.n = __n"}[frame.exclude]
        number = "__n" if frame.exclude != "GROUP" else "__g"
        rows = held.column(f"collect_list(named_struct('n', {number}, 'g', {'__g' if frame.exclude != 'CURRENT ROW' else '__n'}, 'row', struct({fields}))) {of}")
        return Kept(f"filter({rows}, x -> {keep})", values)

    def spans(mode: str, by: str) -> tuple[list[Part], list[Part]]:
        sides = ((low, min(high, -1)), (max(low, 1), high))
        return tuple([Over(_over(partition, by, mode, _side(a), _side(b)), held)] if a <= b else [] for a, b in sides)

    if low is None or high is None or frame.mode == "RANGE" and not {low, high} <= {float("-inf"), 0, float("inf")}:
        return [kept(over)]
    inside = low <= 0 <= high
    if frame.mode == "ROWS" and frame.exclude == "CURRENT ROW":
        before, after = spans("ROWS", order or "__n")
        return before + after
    if frame.mode != "ROWS":
        before, after = spans("RANGE", "__g")
        if not inside or frame.exclude == "GROUP":
            return before + after
        if frame.exclude == "TIES":
            return [*before, Own(), *after]
        peers = [*partition, "__g"]
        return [*before, Over(_over(peers, "__n", "ROWS", "UNBOUNDED PRECEDING", "1 PRECEDING"), held), Over(_over(peers, "__n", "ROWS", "1 FOLLOWING", "UNBOUNDED FOLLOWING"), held), *after]
    if not inside:
        return [kept(over)]
    # Sides without a bound end at the group; of the others a number of rows is collected that the query states.
    rows = lambda a, b: [kept(_over(partition, order or "__n", "ROWS", _side(a), _side(b)))] if a <= b else []
    groups = spans("RANGE", "__g")
    before = groups[0] if low == float("-inf") else rows(low, -1)
    after = groups[1] if high == float("inf") else rows(1, high)
    return [*before, *([Own()] if frame.exclude == "TIES" else []), *after]


def _picked(stage: Window, call: Call, df: DataFrame, r: Renderer, partition: list[str], order: str, name: str) -> DataFrame:
    """first_value, last_value and nth_value where EXCLUDE leaves holes in the frame or the number differs by row: the place of the row asked for is
    computed, and a join on row numbers fetches its value. A frame, and each hole, is a run of row numbers."""
    if call.ignore_nulls:
        raise SqlError(f"IGNORE NULLS is not supported for {call.name} with this frame")
    frame, value = stage.frame, r(call.args[0])
    n = f"CAST({r(call.args[1])} AS BIGINT)" if call.name == "nth_value" else "1L"
    plain = ", ".join(f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString() and not f.name.startswith("__"))
    numbered = f"{order}, xxhash64({plain})" if order else f"xxhash64({plain})"  # equal keys in the same order wherever they are numbered
    keys = [f"{p} AS __p{i}" for i, p in enumerate(partition)]
    at = f"CAST(row_number() OVER ({f'PARTITION BY {', '.join(partition)} ' if partition else ''}ORDER BY {numbered}) AS BIGINT) AS __at"
    rows = df.selectExpr("*", at, *keys)
    if frame.mode == "ROWS":
        over = _over(partition, "__at", "ROWS", _bound(frame.start, r), _bound(frame.end, r))
    elif frame.mode == "RANGE" and not order:
        over = _over(partition, "", "ROWS", "UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING")
    else:
        over = _over(partition, "__g" if frame.mode == "GROUPS" else order, "RANGE", _bound(frame.start, r), _bound(frame.end, r))
    rows = rows.selectExpr("*", f"min(__at) {over} AS __from", f"max(__at) {over} AS __till", f"{n} AS __nth")
    holes = {"NO OTHERS": [], "CURRENT ROW": [("__at", "__at")], "GROUP": [("__first", "__last")], "TIES": [("__first", "__at - 1"), ("__at + 1", "__last")]}[frame.exclude]
    if frame.exclude in ("GROUP", "TIES"):
        peers = f"OVER (PARTITION BY {', '.join([*partition, '__g'])})"
        rows = rows.selectExpr("*", f"min(__at) {peers} AS __first", f"max(__at) {peers} AS __last")
    backwards = call.name == "last_value"
    place = "__till - __nth + 1" if backwards else "__from + __nth - 1"
    rows = rows.selectExpr("*", f"CASE WHEN __nth <= 0 THEN raise_error('the argument of nth_value must be greater than zero') ELSE {place} END AS __to")
    for low, high in reversed(holes) if backwards else holes:
        a, b = f"greatest({low}, __from)", f"least({high}, __till)"
        met = f"{a} <= {b} AND {f'__to <= {b}' if backwards else f'__to >= {a}'}"
        rows = rows.withColumn("__to", F.expr(f"CASE WHEN {met} THEN __to {'-' if backwards else '+'} ({b} - {a} + 1) ELSE __to END"))
    rows = rows.withColumn("__to", F.expr("CASE WHEN __to BETWEEN __from AND __till THEN __to END"))
    others = df.selectExpr(f"{value} AS __v", at.replace(" AS __at", " AS __at2"), *(f"{p} AS __q{i}" for i, p in enumerate(partition)))
    on = F.col("__to") == F.col("__at2")
    for i in range(len(partition)):
        on &= F.col(f"__p{i}").eqNullSafe(F.col(f"__q{i}"))
    return rows.join(others, on, "left").selectExpr(*(f"`{c}`" for c in df.columns), f"__v AS {name}")


def _ntile(call: Call, df: DataFrame, r: Renderer, base: str, partition: list[str], name: str) -> DataFrame:
    """Buckets of the rows from the first one on whose number isn't null; sizes go by the whole partition."""
    n = r(call.args[0])
    whole = f"OVER ({f'PARTITION BY {", ".join(partition)}' if partition else ''})"
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    counted = df.selectExpr("*", f"CAST(row_number() OVER ({base}) AS BIGINT) AS __rn", f"first_value({n}) IGNORE NULLS OVER ({base} {rows}) AS __b", f"count(*) {whole} AS __total")
    # Rows before the first number have none; row k from there on is placed as in a partition of all rows.
    placed = counted.selectExpr("*", f"__rn - min(CASE WHEN {n} IS NOT NULL THEN __rn END) {whole} + 1 AS __k", "__total div __b AS __small", "__total % __b AS __extra")
    place = "CASE WHEN __k <= __extra * (__small + 1) THEN (__k - 1) div (__small + 1) + 1 ELSE __extra + (__k - __extra * (__small + 1) - 1) div __small + 1 END"
    checked = f"CASE WHEN __b IS NULL OR __k < 1 THEN NULL WHEN __b <= 0 THEN raise_error('the argument of ntile must be greater than zero') ELSE {place} END"
    return placed.selectExpr(*(f"`{c}`" for c in df.columns), f"CAST({checked} AS BIGINT) AS {name}")


def _moved(stage: Window, call: Call, df: DataFrame, r: Renderer, base: str, name: str) -> DataFrame:
    """lag or lead by an offset that differs by row: a join on row numbers."""
    value, offset = r(call.args[0]), r(call.args[1])
    default = r(call.args[2]) if len(call.args) > 2 else "NULL"
    sign = "-" if call.name == "lag" else "+"
    keys = [f"{r(p)} AS __p{i}" for i, p in enumerate(stage.over.partition)]
    rows = df.selectExpr("*", f"CAST(row_number() OVER ({base}) AS BIGINT) AS __at", *keys).selectExpr("*", f"__at {sign} {offset} AS __to")
    others = rows.selectExpr(f"{value} AS __v", "__at AS __at2", *(f"__p{i} AS __q{i}" for i in range(len(keys))), "true AS __there")
    same = [F.col(f"__p{i}").eqNullSafe(F.col(f"__q{i}")) for i in range(len(keys))]
    on = F.col("__to") == F.col("__at2")
    for s in same:
        on &= s
    joined = rows.join(others, on, "left")
    moved = f"CASE WHEN __to IS NULL THEN NULL WHEN __there THEN __v ELSE {default} END AS {name}"
    return joined.selectExpr(*(f"`{c}`" for c in df.columns), moved)


