"""Aggregates over a frame that EXCLUDE has split in parts.

A part is a frame that Spark has (``Over``), the row itself (``Own``) or, where bounds would differ by row, a frame that is collected and filtered (``Kept``). Each aggregate
is computed by part and combined: counts and sums add up; variances and covariances go by the parts' counts, means and central moments, which keeps their digits.
"""

from __future__ import annotations

from typing import NamedTuple

from ..plans.parser import SqlError


class Held(dict[str, str]):
    """Window expressions by the columns that are made of them before the parts are combined; equal ones are one."""

    def column(self, expression: str) -> str:
        return self.setdefault(expression, f"__w{len(self)}")


class Over(NamedTuple):
    over: str
    held: Held

    def call(self, name: str, *xs: str) -> str:
        return self.held.column(f"{name}({', '.join(xs)}) {self.over}")

    def array(self, x: str) -> str:
        return f"transform({self.held.column(f'collect_list(struct({x} AS v)) {self.over}')}, e -> e.v)"


class Own(NamedTuple):
    def call(self, name: str, *xs: str) -> str:
        match name:
            case "count":
                return f"CASE WHEN {xs[0]} IS NULL THEN 0 ELSE 1 END"
            case "var_pop" | "covar_pop":
                return f"CASE WHEN {xs[0]} IS NOT NULL THEN 0D END"
        return xs[0]

    def array(self, x: str) -> str:
        return f"array({x})"


class Kept(NamedTuple):
    """rows: an array of structs whose field row has the arguments, v0, v1, ...."""

    rows: str
    arguments: tuple[str, ...]

    def _values(self, x: str) -> str:
        v = f"e.row.v{self.arguments.index(x)}"
        return f"transform(filter({self.rows}, e -> {v} IS NOT NULL), e -> {v})"

    def call(self, name: str, *xs: str) -> str:
        values = self._values(xs[0])
        size = f"nullif(size({values}), 0)"
        fold = lambda f: f"CASE WHEN size({values}) > 0 THEN aggregate(slice({values}, 2, size({values})), {f('element_at(' + values + ', 1)')}, (a, v) -> {f('a')} {sign} {f('v')}) END"
        match name:
            case "count":
                return f"size({values})"
            case "min" | "max":
                return f"array_{name}({values})"
            case "bool_and":
                return f"CASE WHEN size({values}) > 0 THEN forall({values}, v -> v) END"
            case "bool_or":
                return f"CASE WHEN size({values}) > 0 THEN exists({values}, v -> v) END"
            case "bit_and" | "bit_or" | "bit_xor":
                sign = {"bit_and": "&", "bit_or": "|", "bit_xor": "^"}[name]
                return fold(lambda v: v)
            case "sum":
                sign = "+"
                return fold(lambda v: f"({v} + 0)")
            case "avg":
                return f"aggregate({values}, 0D, (a, v) -> a + v) / {size}"
        # Moments about the first value.
        ys = values if len(xs) == 1 else self._values(xs[1])
        d = [f"transform({v}, (v, i) -> v - element_at({v}, 1))" for v in (values, ys)]
        total = lambda v: f"aggregate({v}, 0D, (a, v) -> a + v)"
        return f"({total(f'zip_with({d[0]}, {d[1]}, (p, q) -> p * q)')} / {size} - {total(d[0])} / {size} * {total(d[1])} / {size})"

    def array(self, x: str) -> str:
        return f"transform({self.rows}, e -> e.row.v{self.arguments.index(x)})"


Part = Over | Own | Kept
# Aggregates of one number, and of two, that are computed from moments.
MOMENTS = set("var_pop var_samp variance stddev_pop stddev_samp stddev".split())
PAIRS = set("corr covar_pop covar_samp regr_count regr_avgx regr_avgy regr_sxx regr_syy regr_sxy regr_slope regr_intercept regr_r2".split())
SIGNS = {"bool_and": ("AND", "true"), "bool_or": ("OR", "false"), "bit_and": ("&", "-1"), "bit_or": ("|", "0"), "bit_xor": ("^", "0")}


def arguments(name: str, args: list[str]) -> list[str]:
    """What the parts are asked for."""
    if name in MOMENTS:
        return [f"CAST({args[0]} AS DOUBLE)"]
    if name in PAIRS:
        y, x = (f"CAST({a} AS DOUBLE)" for a in args)
        return [f"CASE WHEN {x} IS NOT NULL THEN {y} END", f"CASE WHEN {y} IS NOT NULL THEN {x} END"]
    return args[:1]


def combine(name: str, args: list[str], parts: list[Part], kept_if: str | None = None) -> str:
    """The aggregate of all parts; args are those that ``arguments`` gave, but for a separator. kept_if: the FILTER, for aggregates that keep nulls."""
    x = args[0]
    if name in ("array_agg", "string_agg"):
        value = x if kept_if is None else f"struct({x} AS v, coalesce({kept_if}, false) AS k)"
        values = f"concat({', '.join([*(p.array(value) for p in parts), 'array()'])})" if parts else "array()"
        if kept_if is not None:
            values = f"transform(filter({values}, e -> e.k), e -> e.v)"
        if name == "string_agg":
            values = f"filter({values}, e -> e IS NOT NULL)"
            return f"CASE WHEN size({values}) > 0 THEN array_join({values}, {args[-1]}) END"
        return f"CASE WHEN size({values}) > 0 THEN {values} END"
    count = f"({' + '.join(p.call('count', x) for p in parts) or '0'})"
    if name == "count":
        return f"CAST({count} AS BIGINT)"
    if name in ("sum", "avg"):
        total = f"({' + '.join(f'coalesce({p.call("sum", x)}, 0)' for p in parts) or '0'})"
        return f"CASE WHEN {count} > 0 THEN {total}{f' / {count}' if name == 'avg' else ''} END"
    if name in ("min", "max"):
        return f"{'least' if name == 'min' else 'greatest'}({', '.join([*(p.call(name, x) for p in parts), 'NULL', 'NULL'])})" if parts else "NULL"
    if name in SIGNS:
        sign, neutral = SIGNS[name]
        return f"CASE WHEN {count} > 0 THEN {f' {sign} '.join(f'coalesce({p.call(name, x)}, {neutral})' for p in parts)} END" if parts else "NULL"
    if name in MOMENTS:
        return _moment(name, x, x, parts, count)
    if name in PAIRS:
        return _moment(name, *args[:2], parts, count)
    raise SqlError(f"EXCLUDE is not supported for {name}")


def _moment(name: str, y: str, x: str, parts: list[Part], count: str) -> str:
    n = [f"({p.call('count', x)})" for p in parts]
    whole = f"nullif({count}, 0)"

    def mean(v: str) -> str:
        return f"(({' + '.join(f'{m} * coalesce({p.call("avg", v)}, 0D)' for m, p in zip(n, parts)) or '0D'}) / {whole})"

    def central(v: str, w: str) -> str:
        terms = []
        for m, p in zip(n, parts):
            own = p.call("var_pop", v) if v == w else p.call("covar_pop", v, w)
            off = f"({p.call('avg', v)} - {mean(v)}) * ({p.call('avg', w)} - {mean(w)})"
            terms.append(f"{m} * coalesce({own} + {off}, 0D)")
        return f"CASE WHEN {count} > 0 THEN {' + '.join(terms) or '0D'} END"

    less = f"nullif({count} - 1, 0)"
    match name:
        case "var_pop":
            return f"({central(x, x)}) / {whole}"
        case "stddev_pop":
            return f"sqrt(({central(x, x)}) / {whole})"
        case "var_samp" | "variance":
            return f"({central(x, x)}) / {less}"
        case "stddev_samp" | "stddev":
            return f"sqrt(({central(x, x)}) / {less})"
        case "regr_count":
            return f"CAST({count} AS BIGINT)"
        case "regr_avgx":
            return mean(x)
        case "regr_avgy":
            return mean(y)
        case "regr_sxx":
            return central(x, x)
        case "regr_syy":
            return central(y, y)
        case "regr_sxy":
            return central(y, x)
        case "covar_pop":
            return f"({central(y, x)}) / {whole}"
        case "covar_samp":
            return f"({central(y, x)}) / {less}"
    sxx, syy, sxy = f"({central(x, x)})", f"({central(y, y)})", f"({central(y, x)})"
    if name == "corr":
        return f"{sxy} / nullif(sqrt({sxx} * {syy}), 0D)"
    slope = f"{sxy} / nullif({sxx}, 0D)"
    if name == "regr_slope":
        return slope
    if name == "regr_intercept":
        return f"{mean(y)} - {slope} * {mean(x)}"
    return f"CASE WHEN {sxx} = 0 THEN NULL WHEN {syy} = 0 THEN 1D ELSE {sxy} * {sxy} / ({sxx} * {syy}) END"
