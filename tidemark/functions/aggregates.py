"""Aggregate calls as Spark SQL: FILTER, DISTINCT and local ORDER BY."""

from __future__ import annotations

from .rendering import Renderer
from .tree import Call, SortKey, Star

# Aggregate functions; those whose result depends on the order of rows; those that Spark has under another form.
NAMES = set(
    "count sum avg min max bool_and bool_or every some any_value bit_and bit_or bit_xor var_pop var_samp variance stddev_pop stddev_samp stddev corr covar_pop covar_samp"
    " regr_count regr_avgx regr_avgy regr_sxx regr_syy regr_sxy regr_slope regr_intercept regr_r2 array_agg string_agg collect_list collect_set first last"
    " first_value last_value mode median approx_count_distinct count_if max_by min_by".split()
)
ORDERED = {"array_agg", "string_agg", "first", "last", "first_value", "last_value", "collect_list"}


def is_aggregate(name: str) -> bool:
    return name in NAMES


def comparator(keys: tuple[SortKey, ...], field: str = "k") -> str:
    """Of array_sort, for structs whose fields k0, k1, ... are the keys."""
    tests = []
    for i, k in enumerate(keys):
        a, b = f"l.{field}{i}", f"r.{field}{i}"
        first, last = (-1, 1) if k.nulls_first else (1, -1)
        tests.append(f"WHEN {a} IS NULL AND {b} IS NOT NULL THEN {first} WHEN {a} IS NOT NULL AND {b} IS NULL THEN {last}")
        low, high = (1, -1) if k.descending else (-1, 1)
        tests.append(f"WHEN {a} < {b} THEN {low} WHEN {a} > {b} THEN {high}")
    return f"(l, r) -> CASE {' '.join(tests)} ELSE 0 END"


def sorted_values(value: str, keys: str, order: tuple[SortKey, ...], where: str, distinct: bool) -> str:
    """Array of the values of the rows, in order."""
    collected = f"{'collect_set' if distinct else 'collect_list'}(struct({keys}, {value} AS v)){where}"
    return f"transform(array_sort({collected}, {comparator(order)}), x -> x.v)"


def render(call: Call, r: Renderer) -> str:
    where = f" FILTER (WHERE {r(call.where)})" if call.where else ""
    args = call.args
    order = call.order
    if call.name in ("sum", "avg") and order and not call.distinct and r.kind(args[0]) in ("double", "float"):
        # Floating-point sums depend on the order: fold in it.
        keys = ", ".join(f"{r(k.expr)} AS k{i}" for i, k in enumerate(order))
        values = f"filter({sorted_values(r(args[0]), keys, order, where, False)}, x -> x IS NOT NULL)"
        total = f"CASE WHEN size({values}) > 0 THEN aggregate({values}, 0D, (a, x) -> a + x) END"
        return total if call.name == "sum" else f"({total}) / nullif(size({values}), 0)"
    if call.name in ORDERED and order:
        keys = ", ".join(f"{r(k.expr)} AS k{i}" for i, k in enumerate(order))
        values = sorted_values(r(args[0]), keys, order, where, call.distinct)
        if call.name == "string_agg":
            kept = f"filter({values}, x -> x IS NOT NULL)"
            return f"CASE WHEN size({kept}) > 0 THEN array_join({kept}, {r(args[1])}) END"
        if call.name in ("array_agg", "collect_list"):
            return f"CASE WHEN size({values}) > 0 THEN {values} END"
        return f"try_element_at({values}, {1 if 'first' in call.name else -1})"
    if call.name == "string_agg":
        return f"listagg({'DISTINCT ' * call.distinct}{r(args[0])}, {r(args[1])}){where}"
    if call.name == "regr_count" and call.distinct:
        y, x = map(r, args)
        both = f"{y} IS NOT NULL AND {x} IS NOT NULL"
        return f"count(DISTINCT {y}, {x}) FILTER (WHERE {both}{f' AND {r(call.where)}' if call.where else ''})"
    if call.name in ("array_agg", "collect_list") and not call.distinct:
        # Null elements stay.
        return f"transform(collect_list(struct({r(args[0])} AS v)){where}, x -> x.v)"
    name = {"some": "bool_or", "array_agg": "collect_set"}.get(call.name)
    inner = r(Call(name or call.name, args or (Star(),), call.distinct))
    return inner + where
