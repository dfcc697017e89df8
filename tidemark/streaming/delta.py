"""Delta rules: from what changed in a stage's inputs and what it remembers of them, to what changed in its output.

Filter, Project, Scan and UNION ALL map the change itself. An inner join is bilinear: it joins each side's change with the other side.
Aggregates that are sums (count, and sum and avg of whole numbers or sum of decimals) keep their sums per group and add the change's, whatever the
size of a group. A top-N keeps its rows and reads its whole input again only when one of them goes. All others recompute what the change can have affected (the keys, groups or partitions that occur in it) before and after, with the same operators that
run full queries, and take the difference; so Catalyst plans every rule. State is read by the buckets of the affected keys only.

A result whose last join makes far more pairs than its inputs have rows is not written out, as such a product can be larger than any disk: it is kept *factored*, as that
join's two inputs, which are maintained like any state and published by the same manifest, and is joined when it is read. Once it is, changes stop at the join.

A change of at most ``small_rows`` rows is brought to the driver once, where it is a local table: what it touches is known without a further job, joins with it need no
shuffle, and the state it is written to is written while later stages already go on. A larger one is written first and read back. Either way nothing
counts before the manifest that names it.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators
from ..functions.rendering import Renderer
from ..functions.tree import Slot, Star, walk
from ..operators.linear import WEIGHT, filtered, projected, scan
from ..plans.model import Aggregate, Distinct, Filter, Join, Project, Scan, SetOperation, Stage, TopN, Window
from . import zset
from .store import BUCKET, Store


@dataclass
class Epoch:
    """One application of changes: the store, what its tables are made of, and what the sources' changes are (None: none). Leaving it waits for all writes."""

    store: Store
    tables: dict[str, list[dict]]
    deltas: dict[str, DataFrame]
    first: bool
    buckets: int
    small_rows: int = 0
    last: str | None = None  # the place of the join whose pairs may be left to the reader
    factored: dict | None = None  # how many pairs that join makes of how many rows, if they are left to the reader
    pairs_written: int = 1_000_000
    rows: dict[str, int] = field(default_factory=dict)

    def __enter__(self) -> Epoch:
        self._pool = ThreadPoolExecutor(4)
        self._writes: list[Future] = []
        if not self.first:
            for name, delta in self.deltas.items():
                self.deltas[name] = self.few(delta)
        return self

    def __exit__(self, kind, *_) -> None:
        self._pool.shutdown(wait=True)
        if kind is None:
            for w in self._writes:
                w.result()

    def local(self, df: DataFrame) -> tuple[DataFrame, pa.Table] | None:
        """A frame of few rows as a local table, and its rows; None if it has more, or if this is a first fill, which is large as a rule."""
        if self.first or not self.small_rows:
            return None
        found = df.limit(self.small_rows + 1).toArrow()
        if found.num_rows > self.small_rows:
            return None
        out = df.sparkSession.createDataFrame(found, df.schema) if found.num_rows else df.sparkSession.createDataFrame([], df.schema)
        return out, found

    def few(self, df: DataFrame) -> DataFrame:
        """df; if it has few rows, as a local table in one partition, which needs no shuffle from there on."""
        found = self.local(df)
        return df if found is None else found[0].coalesce(1)

    def later(self, work: Callable[[], object]) -> None:
        self._writes.append(self._pool.submit(work))

    def save(self, name: str, df: DataFrame, dealt: list | None, few: bool, buckets: int | None = None) -> dict:
        """A new part of a table; few: df is local, and is written while the epoch goes on."""
        part = self.store.part(name, df)
        work = lambda: self.store.fill(part, df, dealt, buckets or self.buckets, few)
        if few:
            self.later(work)
        else:
            work()
        return part

    def touched(self, df: DataFrame, dealt: list | None) -> list[int]:
        """Buckets that a local table has rows in; no job is needed to tell."""
        return sorted({r[0] for r in df.select(self.store.bucket(dealt, self.buckets)).collect()})

    def remember(self, name: str, delta: DataFrame, keys: list[str] | None) -> Memory | None:
        """Adds a change to a table of state and gives the table before and after; None if nothing changed."""
        before = list(self.tables.get(name, []))
        dealt = [F.expr(k) for k in keys] if keys else None
        found = self.local(zset.consolidated(delta))
        if found is not None:
            own, table = found
            n, negative = table.num_rows, sum(w < 0 for w in table.column(WEIGHT).to_pylist())
            part = self.save(name, own, dealt, True) if n else None
            memory = Memory(self.store, before, part, delta, n, negative, self.touched(own, dealt) if n else [], own.coalesce(1))
        else:
            part = self.save(name, zset.consolidated(delta), dealt, False)
            read = self.store.read([part], delta.schema)
            n, negative = read.agg(F.count("*"), F.count_if(F.col(WEIGHT) < 0)).first()
            memory = Memory(self.store, before, part if n else None, delta, n, negative)
        self.rows[name] = n
        if n:
            self.tables[name] = [*before, part]
        elif name not in self.tables:
            self.tables[name] = []
        return memory if n or self.first else None


@dataclass
class Memory:
    """A table of state before and after a change."""

    store: Store
    before: list[dict]
    part: dict | None
    like: DataFrame
    n: int
    negative: int = 0
    _touched: list[int] | None = None
    own: DataFrame | None = None

    @property
    def delta(self) -> DataFrame:
        return self.own if self.own is not None else self.store.read([self.part] if self.part else [], self.like.schema)

    def touched(self) -> list[int]:
        """Buckets that the change has rows in, by the names of its folders."""
        if self._touched is None:
            self._touched = self.store.buckets(self.part) if self.part else []
        return self._touched

    def old(self, only: list[int] | None = None) -> DataFrame:
        return self.store.read(self.before, self.like.schema, only)

    def new(self, only: list[int] | None = None) -> DataFrame:
        if self.own is not None:  # its part may still be being written
            old = self.old(only)
            return self.own if not self.before else old.unionByName(self.own)
        return self.store.read([*self.before, *([self.part] if self.part else [])], self.like.schema, only)


def _keys(expressions: list[str], df: DataFrame) -> DataFrame:
    return df.selectExpr(*(f"{e} AS __k{i}" for i, e in enumerate(expressions))).distinct()


def _restricted(df: DataFrame, expressions: list[str], keys: DataFrame) -> DataFrame:
    """Rows whose keys are among keys; nulls are equal."""
    if not expressions:
        return df
    own = df.selectExpr("*", *(f"{e} AS __o{i}" for i, e in enumerate(expressions)))
    on = F.lit(True)
    for i in range(len(expressions)):
        on = on & F.col(f"__o{i}").eqNullSafe(F.col(f"__k{i}"))
    return own.join(keys, on, "left_semi").select(*df.columns)


def _before_and_after(epoch: Epoch, memory: Memory, expressions: list[str], keys: DataFrame | None, only: list[int] | None) -> tuple[DataFrame | None, DataFrame]:
    """What the change can have affected of a table of state, before (None on a first fill) and after it, as weighted bags."""
    part = lambda df: _restricted(df, expressions, keys) if keys is not None else df
    if epoch.first:
        return None, zset.consolidated(part(memory.new(only)))
    old = epoch.few(part(memory.old(only)))
    return zset.consolidated(old), zset.consolidated(old.unionByName(part(memory.delta)))


def _recomputed(stage: Stage, epoch: Epoch, memory: Memory, expressions: list[str]) -> DataFrame:
    """The difference of the stage over the affected rows, after and before."""
    keys = _keys(expressions, memory.delta) if expressions else None
    old, new = _before_and_after(epoch, memory, expressions, keys, memory.touched() if expressions else None)
    made = zset.weighted(operators.apply(stage, zset.expanded(new)))
    return made if old is None else zset.difference(made, zset.weighted(operators.apply(stage, zset.expanded(old))))


def changed(stage: Stage, epoch: Epoch, at: str = "s") -> DataFrame | None:
    """The weighted change of the stage's output, None if there is none."""
    inputs = [changed(s, epoch, f"{at}_{i}") for i, s in enumerate(stage.inputs)]
    match stage:
        case Scan():
            delta = epoch.deltas.get(stage.table)
            return None if delta is None else scan(stage, delta)
        case Filter():
            return None if inputs[0] is None else filtered(stage, inputs[0])
        case Project():
            return None if inputs[0] is None else projected(stage, inputs[0])
        case Join():
            return _join(stage, epoch, at, *inputs)
        case SetOperation():
            return _set_operation(stage, epoch, at, *inputs)
    (delta,) = inputs
    if delta is None:
        return None
    r = Renderer(delta.drop(WEIGHT))
    match stage:
        case Distinct():
            keys = [r(Slot(s)) for s in stage.outputs]
        case Aggregate():
            if (sums := _sums(stage, r)) is not None:
                return _added_up(stage, epoch, at, delta, r, sums)
            keys = [r(g) for g in stage.groups]
        case Window():
            keys = [r(p) for p in stage.over.partition]
        case TopN():
            keys = []
    memory = epoch.remember(at, delta, keys)
    if memory is None:
        return None
    if isinstance(stage, TopN) and stage.limit:
        return _top(stage, epoch, at, memory)
    return _recomputed(stage, epoch, memory, keys)


def _top(stage: TopN, epoch: Epoch, at: str, memory: Memory) -> DataFrame:
    """Keeps the first offset + limit rows beside the whole input, which is read again only when one of them is deleted: until then the new ones are among the kept
    and the inserted rows."""
    name, whole = f"{at}_head", replace(stage, limit=stage.offset + stage.limit, offset=0)
    store, schema = epoch.store, memory.like.schema
    old = epoch.few(store.read(epoch.tables.get(name, []), schema))
    rows = memory.new()
    if not epoch.first:
        every = [f"`{s}`" for s in zset.columns(memory.like)]
        gone = memory.delta.where(F.col(WEIGHT) < 0)
        if not memory.negative or _restricted(old, every, _keys(every, gone)).isEmpty():
            rows = zset.added(old, memory.delta.where(F.col(WEIGHT) > 0))
    head = zset.consolidated(zset.weighted(operators.apply(whole, zset.expanded(zset.consolidated(rows)))))
    found = epoch.local(head)
    epoch.tables[name] = [epoch.save(name, found[0] if found else head, None, found is not None, 1)]
    out = lambda df: zset.weighted(operators.apply(stage, zset.expanded(df)))
    new = out(found[0].coalesce(1) if found else store.read(epoch.tables[name], schema))
    return new if epoch.first else zset.difference(new, out(old))


def _sums(stage: Aggregate, r: Renderer) -> list[tuple[str, str | None]] | None:
    """For each aggregate: when a row counts, and what it adds; None if they aren't all sums."""
    found: list[tuple[str, str | None]] = []
    for call in stage.aggregates:
        if call.name not in ("count", "sum", "avg") or call.distinct or len(call.args) > 1:
            return None
        where = [f"({r(call.where)}) IS TRUE"] if call.where is not None else []
        value = None
        if call.args and not isinstance(call.args[0], Star):
            value = r(call.args[0])
            where.append(f"{value} IS NOT NULL")
        if call.name == "count":
            value = None
        else:
            kind = r.kind(call.args[0])
            if kind not in ("tinyint", "smallint", "int", "bigint") and not (call.name == "sum" and kind.startswith("decimal")):
                return None
        found.append((" AND ".join(where) or "true", value))
    return found


def _added_up(stage: Aggregate, epoch: Epoch, at: str, delta: DataFrame, r: Renderer, sums: list[tuple[str, str | None]]) -> DataFrame | None:
    groups = list(stage.outputs[: len(stage.groups)])
    grouped = delta.selectExpr("*", *(f"{r(g)} AS `{s}`" for g, s in zip(stage.groups, groups)))
    total = [F.sum(WEIGHT).alias("__n")]
    for i, (where, value) in enumerate(sums):
        total.append(F.expr(f"sum(CASE WHEN {where} THEN {WEIGHT} ELSE 0 END)").alias(f"__c{i}"))
        if value is not None:
            total.append(F.expr(f"sum(CASE WHEN {where} THEN {WEIGHT} * {value} ELSE 0 END)").alias(f"__s{i}"))
    own = [F.col(f"`{g}`") for g in groups]
    change = (grouped.groupBy(*own).agg(*total) if own else grouped.agg(*total)).na.fill(0, [f"__c{i}" for i in range(len(sums))] + ["__n"])
    before = list(epoch.tables.get(at, []))
    schema = change.schema
    found = epoch.local(change)
    if found is not None:
        change, epoch.rows[at] = found[0].coalesce(1), found[1].num_rows
        if not epoch.rows[at]:
            return None
        only = epoch.touched(found[0], own)
        part = epoch.save(at, found[0], own, True) | {"groups": len(groups)}
    else:
        part = epoch.save(at, change, own, False) | {"groups": len(groups)}
        change = epoch.store.read([part], schema)
        epoch.rows[at] = change.count()
        if not epoch.rows[at]:
            return None
        only = epoch.store.buckets(part)
    epoch.tables[at] = [*before, part]
    rest = [c for c in schema.names if c not in groups]

    def summed(df: DataFrame) -> DataFrame:
        added = [F.sum(c).cast(schema[c].dataType).alias(c) for c in rest]
        return df.groupBy(*own).agg(*added) if own else df.agg(*added)

    expressions = [f"`{g}`" for g in groups]
    old = epoch.few(_restricted(epoch.store.read(before, schema, only), expressions, _keys(expressions, change)))
    like = operators.apply(stage, delta.drop(WEIGHT).limit(0)).schema

    def rows(df: DataFrame) -> DataFrame:
        checked = df.where(F.when(F.col("__n") < 0, F.raise_error(F.lit("a group's multiplicity fell below zero")).cast("boolean")).otherwise(F.lit(True) if not own else F.col("__n") > 0))
        made = []
        for i, (call, slot) in enumerate(zip(stage.aggregates, stage.outputs[len(groups) :])):
            value = {"count": f"__c{i}", "sum": f"CASE WHEN __c{i} > 0 THEN __s{i} END", "avg": f"CASE WHEN __c{i} > 0 THEN CAST(__s{i} AS DOUBLE) / __c{i} END"}[call.name]
            made.append(F.expr(value).cast(like[slot].dataType).alias(slot))
        return zset.weighted(checked.select(*own, *made))

    new = rows(summed(old.unionByName(change)))
    if epoch.first:
        return new
    if not own:
        return zset.difference(new, rows(summed(old).na.fill(0, [c for c in rest if c[:3] in ("__n", "__c")])))
    return zset.difference(new, rows(summed(old)))


def last_join(top: Stage) -> tuple[Join, str] | None:
    """The join whose rows are the result, filtered and projected at most, and its place."""
    at = "s"
    while isinstance(top, (Filter, Project)):
        top, at = top.child, f"{at}_0"
    return (top, at) if isinstance(top, Join) and top.kind in ("inner", "left", "right", "full") else None


def sides(store: Store, tables: dict[str, list[dict]], at: str) -> list[DataFrame]:
    """Plain rows of both inputs of a join, of its state."""
    from pyspark.sql.types import StructType

    found = []
    for k in "lr":
        parts = tables[f"{at}_{k}"]
        found.append(zset.expanded(zset.consolidated(store.read(parts, StructType.fromJson(_own(parts[0]["schema"]))))))
    return found


def _factored(stage: Join, epoch: Epoch, l: Memory, r: Memory) -> dict | None:  # noqa: E741
    """Whether the join's pairs are left to the reader: what is kept about that, or None. Decided by large changes only; once it is so it stays so."""
    every = [[f"`{c}`" for c in zset.columns(m.like)] for m in (l, r)]
    if epoch.factored:
        for m, own in zip((l, r), every):
            if m.negative:
                gone = _keys(own, m.delta.where(F.col(WEIGHT) < 0))
                if not zset.consolidated(_restricted(m.new(m.touched()), own, gone)).where(F.col(WEIGHT) < 0).isEmpty():
                    raise ValueError("a row's multiplicity fell below zero")
        return epoch.factored
    if not epoch.first and max(l.n, r.n) <= epoch.small_rows:
        return None
    # Pairs are counted by key (an upper bound, if there is a condition besides), without keys by the values that the condition speaks of.
    counted = replace(stage, kind="inner", condition=None if stage.keys else stage.condition)
    asked = {x.name for n in [*(x for k in counted.keys for x in k), *([counted.condition] if counted.condition else [])] for x in walk(n) if isinstance(x, Slot)}
    rows = [m.new().agg(F.sum(WEIGHT)).first()[0] or 0 for m in (l, r)]
    by = [m.new().groupBy(*(c for c in zset.columns(m.like) if c in asked)).agg(F.sum(WEIGHT).cast("double").alias(w)) for m, w in ((l, "__wl"), (r, "__wr"))]
    pairs = operators.apply(counted, *by).agg(F.sum(F.col("__wl") * F.col("__wr"))).first()[0] or 0
    if pairs <= max(epoch.pairs_written, 4 * sum(rows)):
        return None
    if not epoch.first and any(not zset.consolidated(m.new()).where(F.col(WEIGHT) < 0).isEmpty() for m in (l, r)):
        return None
    return {"pairs": pairs, "rows": rows}


def _empty(stage: Stage, epoch: Epoch, at: str) -> DataFrame:
    """An input without change, with the schema of its state."""
    from pyspark.sql.types import StructType

    parts = epoch.tables.get(at)
    if not parts:
        return None
    return epoch.store.read([], StructType.fromJson(_own(parts[0]["schema"])))


def _own(schema: dict) -> dict:
    return {**schema, "fields": [f for f in schema["fields"] if f["name"] != BUCKET]}


def _sides(stage: Stage, epoch: Epoch, at: str, left: DataFrame | None, right: DataFrame | None):
    """Memories of both inputs; an unchanged one has an empty change."""
    found = []
    for k, delta in (("l", left), ("r", right)):
        name = f"{at}_{k}"
        if delta is None:
            delta = _empty(stage, epoch, name)
        found.append((name, delta))
    return found


def _weights(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(WEIGHT, name)


def _joined(stage: Join, left: DataFrame, right: DataFrame) -> DataFrame:
    """The join of weighted bags: a pair has the product of the weights, a row without partner its own."""
    out = operators.apply(stage, _weights(left, "__wl"), _weights(right, "__wr"))
    own = [c for c in ("__wl", "__wr") if c in out.columns]
    total = F.lit(1)
    for c in own:
        total = total * F.coalesce(F.col(c), F.lit(1))
    return out.withColumn(WEIGHT, total.cast("long")).drop(*own).select(*stage.outputs, WEIGHT)


def _checked(df: DataFrame) -> DataFrame:
    """A consolidated bag, with an error for a negative weight."""
    return df.where(F.when(F.col(WEIGHT) < 0, F.raise_error(F.lit("a row's multiplicity fell below zero")).cast("boolean")).otherwise(True))


def _join(stage: Join, epoch: Epoch, at: str, left: DataFrame | None, right: DataFrame | None) -> DataFrame | None:
    if left is None and right is None:
        return None
    (ln, ld), (rn, rd) = _sides(stage, epoch, at, left, right)
    rl, rr = Renderer(ld.drop(WEIGHT)), Renderer(rd.drop(WEIGHT))
    aware = stage.kind == "null_aware_anti"
    lk, rk = ([] if aware else [rl(a) for a, _ in stage.keys]), ([] if aware else [rr(b) for _, b in stage.keys])
    memories = []
    for name, delta, given, keys in ((ln, ld, left, lk), (rn, rd, right, rk)):
        m = epoch.remember(name, delta, keys) if given is not None else None
        memories.append(m or Memory(epoch.store, list(epoch.tables.get(name, [])), None, delta, 0))
    l, r = memories  # noqa: E741
    if not l.n and not r.n and not epoch.first:
        return None
    if at == epoch.last and (found := _factored(stage, epoch, l, r)):
        epoch.factored, epoch.rows["result"] = found, l.n + r.n
        return None
    if stage.kind == "inner":
        parts = []
        if l.n:
            parts.append(_joined(stage, l.delta, r.new(l.touched() if lk else None)))
        if r.n:
            parts.append(_joined(stage, l.old(r.touched() if rk else None), r.delta))
        return zset.added(*parts) if parts else None
    if aware and not r.n:
        # With an unchanged right side every left row is judged by itself.
        return _joined(stage, l.delta, zset.consolidated(r.new()))
    whole = not lk
    only = None if whole else sorted({*l.touched(), *r.touched()})
    keys = None if whole else _keys(lk, l.delta).unionByName(_keys(rk, r.delta)).distinct()
    sides = [_before_and_after(epoch, m, e, keys, only) for m, e in ((l, lk), (r, rk))]
    new = _joined(stage, *(_checked(after) for _, after in sides))
    if epoch.first:
        return new
    return zset.difference(new, _joined(stage, *(_checked(before) for before, _ in sides)))


def _set_operation(stage: SetOperation, epoch: Epoch, at: str, left: DataFrame | None, right: DataFrame | None) -> DataFrame | None:
    named = lambda df: None if df is None else df.toDF(*stage.outputs, WEIGHT)
    left, right = named(left), named(right)
    if left is None and right is None:
        return None
    if stage.kind == "union all":
        return zset.added(*(x for x in (left, right) if x is not None))
    (ln, ld), (rn, rd) = _sides(stage, epoch, at, left, right)
    expressions = [f"`{s}`" for s in stage.outputs]
    memories = []
    for name, delta, given in ((ln, ld, left), (rn, rd, right)):
        m = epoch.remember(name, delta, expressions) if given is not None else None
        memories.append(m or Memory(epoch.store, list(epoch.tables.get(name, [])), None, delta, 0))
    l, r = memories  # noqa: E741
    keys = _keys(expressions, l.delta.unionByName(r.delta))
    only = sorted({*l.touched(), *r.touched()})
    sides = [_before_and_after(epoch, m, expressions, keys, only) for m in (l, r)]
    new = zset.weighted(operators.apply(stage, *(zset.expanded(after) for _, after in sides)))
    if epoch.first:
        return new
    return zset.difference(new, zset.weighted(operators.apply(stage, *(zset.expanded(before) for before, _ in sides))))
