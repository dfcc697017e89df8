"""The engine: sources, maintained results, and the loop that brings results up to date with committed transactions."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__, operators
from ..operators.linear import WEIGHT
from ..plans.lowering import lower
from ..plans.model import Plan, stages
from ..plans.parser import SqlError
from ..sources import files
from ..sources.changelog import RECORD, ChangeLog, Transaction, number
from . import zset
from .delta import Epoch, _keys, _restricted, changed, last_join, sides
from .store import BUCKET, Store


class EngineError(RuntimeError):
    pass


@dataclass(frozen=True)
class EngineConfig:
    """buckets: folders a table of state is dealt into. pairs_written: a result whose last join makes more pairs than this, and more than four for each row of its inputs,
    is not written but joined when it is read. files_per_epoch, bytes_per_epoch: ended transactions, and bytes of their changes, that one epoch of a result
    takes at most (one transaction at least). small_rows: changes up to this size are held by the driver during an epoch. compact_after: parts from which on a table is
    rewritten as one. keep_versions: manifests kept for readers. workers: results that are brought forward at the same time. retry_after: epochs that a
    failed result rests at first; twice as many after each further failure. history: epochs that ``snapshot`` remembers. stall_seconds: age of a pending transaction that is an alert."""

    buckets: int = 8
    files_per_epoch: int = 64
    bytes_per_epoch: int = 1 << 30
    small_rows: int = 10_000
    pairs_written: int = 1_000_000
    compact_after: int = 8
    keep_versions: int = 2
    workers: int = 4
    retry_after: int = 1
    history: int = 48
    stall_seconds: float = 300.0


@dataclass
class Failure:
    """A result that could not be brought forward: it stays as it was, the others go on."""

    error: str
    since: float
    times: int = 1
    rest: int = 0


class Engine:
    """All state is under root, which driver and executors share; an engine made again on the same root goes on where it was."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig = EngineConfig()):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.log = ChangeLog(spark, f"{self.root}/log")
        self.log.prepare()
        self._plans: dict[str, Plan] = {}
        self._failures: dict[str, Failure] = {}
        self._history: list[dict] = []
        self.active = False
        #: Called with ("before" | "after", result) around an epoch's commit point; tests raise here.
        self.at_commit: Callable[[str, str], None] = lambda when, result: None
        self._epochs = self._errors = 0
        self._seconds = 0.0
        self._last_error: str | None = None

    # Sources.
    def register_source(self, name: str, table: DataFrame | str) -> None:
        """A table that results may read: a Parquet path, or rows that are copied under root."""
        self._check_name(name)
        if name in self.sources():
            raise EngineError(f"source {name} exists")
        if isinstance(table, str):
            path, schema = table, self.spark.read.parquet(table).schema
        else:
            path, schema = f"{self.root}/base/{name}-{uuid.uuid4().hex}", table.schema
            if table.isStreaming:
                raise EngineError("a source is a table, not a stream")
        if not schema.names:
            raise EngineError(f"source {name} has no columns")
        if any(isinstance(f.dataType, T.MapType) for f in schema):
            raise EngineError("map columns cannot be compared and are not supported in sources")
        if len({n.lower() for n in schema.names}) != len(schema.names) or any(n.startswith("__") for n in schema.names):
            raise EngineError("source columns need distinct names that don't begin with __")
        if not isinstance(table, str):
            table.write.parquet(path)
        self._source(name).publish({"number": 0, "path": path, "schema": schema.jsonValue(), "lsn": self.log.latest(), "tables": {}})

    def _source(self, name: str) -> Store:
        return Store(self.spark, f"{self.root}/sources/{name}")

    def sources(self) -> dict[str, dict]:
        return {n: m for n in self._names("sources") if (m := self._source(n).manifest()) is not None}

    def drop_source(self, name: str) -> None:
        readers = [r for r in self.results() if name in self.plan(r).sources]
        if readers:
            raise EngineError(f"source {name} is read by {', '.join(readers)}")
        self._source(name).delete()

    def _info(self, source: str) -> dict:
        info = self._source(source).manifest()
        if info is None:
            raise EngineError(f"source {source} does not exist")
        return info

    def schema(self, source: str) -> T.StructType:
        return T.StructType.fromJson(self._info(source)["schema"])

    def table(self, source: str, lsn: int | None = None) -> DataFrame:
        """A source's rows with all changes committed up to lsn."""
        info = self._info(source)
        schema = T.StructType.fromJson(info["schema"])
        base = zset.weighted(self.spark.read.schema(schema).parquet(info["path"]))
        delta = self.log.changes(source, schema, self.log.records(info["lsn"], self.log.latest() if lsn is None else lsn))
        return base.drop(WEIGHT) if delta is None else zset.expanded(zset.consolidated(zset.added(base, delta)))

    def _check_files(self, source: str) -> None:
        """The registered files still have the registered columns and types."""
        info = self._info(source)
        found, known = self.spark.read.parquet(info["path"]).schema, T.StructType.fromJson(info["schema"])
        kinds = lambda schema: {f.name: f.dataType.simpleString() for f in schema}
        if kinds(found) != kinds(known):
            raise EngineError(f"the files of source {source} have other columns than when it was registered")

    def begin(self) -> Transaction:
        return Transaction(self.log, self.schema)

    def vacuum(self) -> int:
        """Writes what all results have applied into new copies of the sources and deletes it from the log; returns how many transactions were forgotten."""
        low = min([self._manifest(r)["lsn"] for r in self.results()], default=self.log.latest())
        for name, info in self.sources().items():
            records = self.log.records(info["lsn"], low)
            if not any(t == name for _, r in records for t, _ in r["writes"]):
                self._source(name).publish(info | {"number": info["number"] + 1, "lsn": max(low, info["lsn"])})
                continue
            path = f"{self.root}/base/{name}-{uuid.uuid4().hex}"
            self.table(name, low).write.parquet(path)
            self._source(name).publish(info | {"number": info["number"] + 1, "path": path, "lsn": low, "before": info["path"]})
            if (old := info.get("before", "")).startswith(f"{self.root}/base/"):  # readers of the last copy may still be at work
                files.delete(self.spark, old)
        return self.log.forget(low)

    # Results.
    def create(self, name: str, sql: str) -> None:
        """Registers a SELECT and fills its result from the sources as they are now."""
        self._check_name(name)
        if name in self.results() or name in self.sources():
            raise EngineError(f"{name} exists")
        plan = self._lower(sql)
        self.check(plan)
        for s in plan.sources:
            self._check_files(s)
        lsn = self.log.latest()
        store = self._store(name)
        manifest = {"number": 0, "lsn": lsn, "sql": sql, "names": list(plan.names), "tables": {}, "rows": {}, "seconds": 0.0}
        deltas = {s: zset.weighted(self.table(s, lsn)) for s in plan.sources}
        self._apply(name, plan, store, manifest, deltas, lsn, True)

    def execute(self, statement: str) -> None:
        """CREATE TABLE name AS SELECT ..., or DROP TABLE name; a schema before the name is ignored."""
        if m := re.fullmatch(r"(?is)\s*create\s+table\s+(?:\w+\.)?(\w+)\s+as\s+(.*?);?\s*", statement):
            return self.create(m[1].lower(), m[2])
        if m := re.fullmatch(r"(?is)\s*drop\s+table\s+(?:\w+\.)?(\w+)\s*;?\s*", statement):
            return self.drop(m[1].lower())
        raise SqlError("only CREATE TABLE ... AS SELECT and DROP TABLE are supported")

    # Indexes: copies of a result that are dealt by some of its columns, so that a lookup opens one bucket.
    def create_index(self, name: str, index: str, columns: list[str]) -> None:
        self._check_name(index)
        m, store = self._manifest(name), self._store(name)
        indexes = m.get("indexes", {})
        if index in indexes:
            raise EngineError(f"index {index} exists")
        if not 1 <= len(columns) <= 8 or len(indexes) >= 8:
            raise EngineError("an index has 1 to 8 columns, and a result 8 indexes at most")
        if m.get("factored"):  # an index needs the rows written, and every later change of them
            if unknown := [c for c in columns if c not in m["names"]]:
                raise EngineError(f"{name} has no column {unknown[0]}")
            whole = zset.weighted(self._plain(name, m))
            part = store.write("result", zset.consolidated(whole), [F.col(f"`{s}`") for s in zset.columns(whole)], self.config.buckets)
            m |= {"factored": None, "schema": whole.schema.jsonValue(), "tables": m["tables"] | {"result": [part]}}
        schema = T.StructType.fromJson(m["schema"])
        slots = dict(zip(m["names"], schema.names))
        for c in columns:
            if c not in slots:
                raise EngineError(f"{name} has no column {c}")
            if isinstance(schema[slots[c]].dataType, (T.ArrayType, T.StructType)):
                raise EngineError(f"column {c} cannot be indexed")
        whole = zset.consolidated(store.read(m["tables"]["result"], schema))
        part = store.write(f"index_{index}", whole, [F.col(slots[c]) for c in columns], self.config.buckets)
        store.publish(m | {"number": m["number"] + 1, "indexes": indexes | {index: columns}, "tables": m["tables"] | {f"index_{index}": [part]}})

    def drop_index(self, name: str, index: str) -> None:
        m = self._manifest(name)
        if index not in m.get("indexes", {}):
            raise EngineError(f"index {index} does not exist")
        indexes = {k: v for k, v in m["indexes"].items() if k != index}
        self._store(name).publish(m | {"number": m["number"] + 1, "indexes": indexes, "tables": {k: v for k, v in m["tables"].items() if k != f"index_{index}"}})

    def lookup(self, name: str, index: str, *values: object) -> DataFrame:
        """The result's rows whose indexed columns have these values."""
        m = self._manifest(name)
        columns = m.get("indexes", {}).get(index)
        if columns is None or len(columns) != len(values):
            raise EngineError(f"index {index} does not exist or has other columns")
        schema = T.StructType.fromJson(m["schema"])
        slots = [schema[schema.names[m["names"].index(c)]] for c in columns]
        given = [F.lit(v).cast(s.dataType) for v, s in zip(values, slots)]
        bucket = self.spark.range(1).select(F.pmod(F.hash(*given), F.lit(self.config.buckets)).alias("b")).first()[0]
        rows = self._store(name).read(m["tables"][f"index_{index}"], schema, [bucket])
        for v, s in zip(given, slots):
            rows = rows.where(F.col(s.name).eqNullSafe(v))
        return zset.expanded(zset.consolidated(rows)).toDF(*m["names"])

    def check(self, plan: Plan) -> None:
        """Lets Catalyst analyse the plan over empty tables, and refuses what isn't a function of the tables."""
        empty = operators.evaluate(plan, lambda s: self.spark.createDataFrame([], self.schema(s)))
        if not empty._jdf.queryExecution().analyzed().deterministic():
            raise SqlError("a nondeterministic expression cannot be maintained")

    def drop(self, name: str) -> None:
        if name not in self.results():
            raise EngineError(f"result {name} does not exist")
        self._store(name).delete()
        self._plans.pop(name, None)
        self._failures.pop(name, None)

    def results(self) -> list[str]:
        return self._names("results")

    def plan(self, name: str) -> Plan:
        if name not in self._plans:
            self._plans[name] = self._lower(self._manifest(name)["sql"])
        return self._plans[name]

    def read(self, name: str) -> DataFrame:
        """The result as of its last commit, a bag of rows."""
        m = self._manifest(name)
        if m.get("factored"):
            return self._plain(name, m).toDF(*m["names"])
        parts = m["tables"]["result"]
        schema = T.StructType.fromJson(m["schema"])
        whole = self._store(name).read(parts, schema)
        rows = zset.expanded(zset.consolidated(whole) if len(parts) > 1 else whole)
        return rows.toDF(*m["names"])

    def _plain(self, name: str, m: dict) -> DataFrame:
        """The rows of a result that is kept as the inputs of its last join, by slots."""
        top = self.plan(name).top
        join, at = last_join(top)
        left, right = sides(self._store(name), m["tables"], at)
        return operators.apply_above(top, join, operators.join_many(join, left, right, m["factored"]["pairs"], m["factored"]["rows"])).select(*top.outputs)

    def recompute(self, name: str) -> DataFrame:
        """The same query over the sources as they are now, from scratch."""
        return operators.evaluate(self.plan(name), self.table)

    # Maintenance.
    def start(self) -> None:
        self.active = True

    def stop(self) -> None:
        self.active = False

    def run_available(self) -> int:
        """Applies all transactions that have ended to all results; returns how many epochs that took. A result that fails stays as it was, is named in the error
        raised once the others are done, and is tried again by the next call."""
        if not self.active:
            raise EngineError("the engine is not started")
        before = self._epochs
        for f in self._failures.values():
            f.rest = 0
        tried = {n: f.times for n, f in self._failures.items()}
        query = self._writer().trigger(availableNow=True).start()
        query.awaitTermination()
        self._advance(self.log.latest())  # results that were left behind without anything new in the log
        failed = {n: f for n, f in self._failures.items() if f.times > tried.get(n, 0)}
        if failed:
            raise EngineError("; ".join(f"{n}: {f.error}" for n, f in sorted(failed.items())))
        return self._epochs - before

    def _writer(self):
        stream = self.spark.readStream.schema(RECORD).option("maxFilesPerTrigger", self.config.files_per_epoch).option("ignoreMissingFiles", "true").json(self.log.transactions_path)
        named = stream.select(F.col("_metadata.file_name").alias("name"))
        return named.writeStream.foreachBatch(self._epoch).option("checkpointLocation", f"{self.root}/checkpoint")

    def run_continuously(self, interval: str = "0 seconds"):
        """A running StreamingQuery that applies transactions as they end; stop() it before run_available is used again."""
        if not self.active:
            raise EngineError("the engine is not started")
        return self._writer().trigger(processingTime=interval).start()

    def wait_for(self, name: str, lsn: int, seconds: float = 60.0) -> None:
        """Returns when a result shows what was committed at lsn."""
        until = time.time() + seconds
        while self._manifest(name)["lsn"] < lsn:
            if time.time() > until:
                raise EngineError(f"{name} did not reach {lsn} in {seconds} s")
            time.sleep(0.01)

    def _epoch(self, ended: DataFrame, _: int) -> None:
        """What the stream has seen says how far to go; what to apply follows from each result's own number, so neither a late file nor a repeated batch matters."""
        newest = ended.agg(F.max("name")).first()[0]
        for f in self._failures.values():
            f.rest -= 1
        if newest is not None:
            self._advance(number(newest))

    def _advance(self, upto: int) -> None:
        """Brings all results forward to a transaction, in turns of one epoch each, several at a time."""
        began, waiting = time.time(), [n for n in self.results() if n not in self._failures or self._failures[n].rest <= 0]
        worked = 0
        with ThreadPoolExecutor(max(1, self.config.workers)) as pool:
            while waiting:
                found = list(pool.map(lambda n: self._step(n, upto), waiting))
                worked += sum(x != "done" for x in found)
                waiting = [n for n, x in zip(waiting, found) if x == "more"]
        if worked:
            self._epochs += 1
            self._seconds += time.time() - began
            self._history = [*self._history, {"at": began, "seconds": round(time.time() - began, 3), "upto": upto, "steps": worked, "failed": sorted(self._failures)}][-self.config.history :]

    def _step(self, name: str, upto: int) -> str:
        """One epoch of a result: whether there is "more" to apply, it is "last", there was nothing ("done") or it "failed"."""
        try:
            store, m = self._store(name), self._manifest(name)
            if m["lsn"] >= upto:
                return "done"
            new = self.log.records(m["lsn"], upto, self.config.files_per_epoch, self.config.bytes_per_epoch)
            plan, deltas = self.plan(name), {}
            for s in plan.sources:
                d = self.log.changes(s, self.schema(s), new)
                if d is not None:
                    deltas[s] = d
            self._apply(name, plan, store, m | {"number": m["number"] + 1}, deltas, new[-1][0], False)
            self._failures.pop(name, None)
            return "more" if new[-1][0] < upto else "last"
        except Exception as e:
            known = self._failures.get(name)
            times = known.times + 1 if known else 1
            said = str(e).strip().splitlines() or [type(e).__name__]
            error = next((x for x in said if "below zero" in x), said[0])[:300]
            self._failures[name] = Failure(error, known.since if known else time.time(), times, self.config.retry_after * 2 ** min(times - 1, 10))
            self._errors += 1
            self._last_error = f"{name}: {error}"
            return "failed"

    def _apply(self, name: str, plan: Plan, store: Store, manifest: dict, deltas: dict[str, DataFrame], lsn: int, first: bool) -> None:
        began = time.time()
        with Epoch(store, {k: list(v) for k, v in manifest["tables"].items()}, deltas, first, self.config.buckets, self.config.small_rows) as epoch:
            if (found := last_join(plan.top)) and not manifest.get("indexes"):
                epoch.last, epoch.factored, epoch.pairs_written = found[1], manifest.get("factored"), self.config.pairs_written
            delta = changed(plan.top, epoch)
            if delta is not None:
                delta = delta.select(*plan.top.outputs, WEIGHT)
                keys = [f"`{s}`" for s in plan.top.outputs]
                memory = epoch.remember("result", delta, keys)
                manifest["schema"] = delta.schema.jsonValue()
                for index, columns in manifest.get("indexes", {}).items():
                    slots = dict(zip(plan.names, plan.top.outputs))
                    if memory:
                        epoch.remember(f"index_{index}", memory.delta, [f"`{slots[c]}`" for c in columns])
                if memory and memory.negative:
                    self._check_result(memory, keys)
        for table, parts in list(epoch.tables.items()):
            if len(parts) >= self.config.compact_after:
                epoch.tables[table] = [self._compacted(store, table, parts)]
        epoch.tables.setdefault("result", [])
        if epoch.factored:
            epoch.tables["result"] = []
        manifest["factored"] = epoch.factored
        now = time.time()
        manifest |= {"tables": epoch.tables, "lsn": lsn, "rows": epoch.rows, "seconds": round(now - began, 3), "updated_at": now, "total_seconds": round(manifest.get("total_seconds", 0.0) + now - began, 3)}
        self.at_commit("before", name)
        store.publish(manifest)
        self.at_commit("after", name)
        store.collect_garbage(manifest, self.config.keep_versions)

    def _check_result(self, memory, keys: list[str]) -> None:
        now = zset.consolidated(_restricted(memory.new(memory.touched()), keys, _keys(keys, memory.delta)))
        if not now.where(F.col(WEIGHT) < 0).isEmpty():
            raise EngineError("a result row's multiplicity fell below zero")

    def _compacted(self, store: Store, table: str, parts: list[dict]) -> dict:
        """One part with the same rows; buckets stay as they are."""
        schema = T.StructType([f for f in T.StructType.fromJson(parts[0]["schema"]) if f.name != BUCKET])
        whole = None
        for p in parts:
            df = self.spark.read.schema(T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{store.path}/{p['folder']}")
            whole = df if whole is None else whole.unionByName(df)
        if "groups" in parts[0]:  # sums by group, not weighted rows
            own = [f"`{c}`" for c in schema.names[: parts[0]["groups"]]]
            total = whole.groupBy(*own, BUCKET).agg(*(F.sum(c).cast(schema[c].dataType).alias(c) for c in schema.names[len(own) :]))
        else:
            own = [f"`{c}`" for c in whole.columns if c != WEIGHT]
            total = whole.groupBy(*own).agg(F.sum(WEIGHT).cast("long").alias(WEIGHT)).where(F.col(WEIGHT) != 0)
        folder = f"{table}/{uuid.uuid4().hex}"
        total.select(*schema.names, BUCKET).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{store.path}/{folder}")
        return parts[0] | {"folder": folder, "schema": schema.jsonValue()}

    # Introspection. All of it reads manifests and the records of the log, none of the data.
    def progress(self, name: str) -> dict:
        m = self._manifest(name)
        waiting = [r for _, r in self.log.records(m["lsn"], self.log.latest()) if r["status"] == "committed"]
        failure = self._failures.get(name)
        return {
            "result": name, "epoch": m["number"], "applied_lsn": m["lsn"], "latest_lsn": self.log.latest(), "pending_transactions": len(waiting), "pending_bytes": sum(r["bytes"] for r in waiting),
            "oldest_pending_seconds": round(time.time() - min(r["ended_at"] for r in waiting), 3) if waiting else 0.0, "updated_at": m["updated_at"],
            "state": "failed" if failure else "behind" if waiting else "current", "error": failure.error if failure else None,
        }

    def explain(self, name: str) -> dict:
        """The plan's stages, inputs first, with what each remembers."""
        m, plan = self._manifest(name), self.plan(name)
        listed = []

        def walk(stage, at: str) -> None:
            for i, s in enumerate(stage.inputs):
                walk(s, f"{at}_{i}")
            state = {k: len(v) for k, v in m["tables"].items() if k in (at, f"{at}_l", f"{at}_r")}
            listed.append({"stage": at, "operator": type(stage).__name__, "outputs": list(stage.outputs), "inputs": [f"{at}_{i}" for i in range(len(stage.inputs))], "state_parts": state})

        walk(plan.top, "s")
        listed.append({"stage": "sink", "operator": "Sink", "outputs": list(plan.names), "inputs": ["s"], "state_parts": {"result": len(m["tables"]["result"])}})
        return {"result": name, "sql": m["sql"], "sources": list(plan.sources), "stages": listed}

    def _log_records(self) -> list[dict]:
        return [self.log.record(n) for n in self.log.numbers()]

    def runtime_status(self) -> DataFrame:
        """One row on the health of the whole engine."""
        found, records = [self.progress(n) for n in self.results()], self._log_records()
        manifests = [self._manifest(n) for n in self.results()]
        last = self._history[-1] if self._history else {}
        values: list[tuple[str, str, object]] = [
            ("active", "boolean", self.active), ("version", "string", __version__), ("results", "int", len(found)), ("sources", "int", len(self.sources())),
            ("results_current", "int", sum(p["state"] == "current" for p in found)), ("results_behind", "int", sum(p["state"] == "behind" for p in found)),
            ("results_failed", "int", sum(p["state"] == "failed" for p in found)), ("healthy", "boolean", not self._failures), ("epochs", "int", self._epochs), ("errors", "int", self._errors),
            ("last_error", "string", self._last_error), ("latest_lsn", "long", self.log.latest()), ("least_applied_lsn", "long", min((p["applied_lsn"] for p in found), default=None)),
            ("lag", "long", max((p["latest_lsn"] - p["applied_lsn"] for p in found), default=0)), ("pending_transactions", "long", max((p["pending_transactions"] for p in found), default=0)),
            ("pending_bytes", "long", max((p["pending_bytes"] for p in found), default=0)), ("oldest_pending_seconds", "double", max((p["oldest_pending_seconds"] for p in found), default=0.0)),
            ("log_transactions", "int", len(records)), ("log_committed", "int", sum(r["status"] == "committed" for r in records)), ("log_aborted", "int", sum(r["status"] == "aborted" for r in records)),
            ("log_bytes", "long", sum(r["bytes"] for r in records)), ("state_tables", "int", sum(len(m["tables"]) for m in manifests)), ("state_parts", "int", sum(len(v) for m in manifests for v in m["tables"].values())),
            ("epoch_seconds", "double", round(self._seconds, 3)), ("last_epoch_seconds", "double", last.get("seconds")), ("last_epoch_at", "double", last.get("at")),
            ("buckets", "int", self.config.buckets), ("files_per_epoch", "int", self.config.files_per_epoch), ("bytes_per_epoch", "long", self.config.bytes_per_epoch),
            ("small_rows", "int", self.config.small_rows), ("workers", "int", self.config.workers), ("root", "string", self.root),
        ]
        return self.spark.createDataFrame([tuple(v for *_, v in values)], ", ".join(f"{n} {kind}" for n, kind, _ in values))

    def dataflow_status(self) -> DataFrame:
        """A row per result: how far it is, what waits for it, and what it keeps. last_changed_rows are rows of the last join's inputs, if those are what it keeps."""
        rows = []
        for n in self.results():
            m, p, f = self._manifest(n), self.progress(n), self._failures.get(n)
            rows.append((
                n, p["state"], p["epoch"], p["applied_lsn"], p["latest_lsn"] - p["applied_lsn"], p["pending_transactions"], p["pending_bytes"], p["oldest_pending_seconds"], len(stages(self.plan(n).top)) + 1,
                len(m["tables"]), sum(map(len, m["tables"].values())), m["rows"].get("result", 0), m["seconds"], m.get("total_seconds", 0.0), f.times if f else 0, max(0, f.rest) if f else 0, p["error"], float(m["updated_at"]),
            ))
        return self.spark.createDataFrame(rows, "result string, state string, epoch int, applied_lsn long, lag long, pending_transactions int, pending_bytes long, oldest_pending_seconds double, stages int, state_tables int, parts int, last_changed_rows long, last_seconds double, total_seconds double, failures int, epochs_until_retry int, error string, updated_at double")

    def runtime_metrics(self) -> DataFrame:
        status = self.runtime_status().first().asDict()
        manifests = [self._manifest(n) for n in self.results()]
        rows = [
            *((k, float(status[k])) for k in ("epochs", "errors", "results", "sources", "results_failed", "results_behind", "pending_transactions", "pending_bytes", "log_bytes", "state_parts", "epoch_seconds")),
            ("transactions_committed", float(status["log_committed"])), ("transactions_aborted", float(status["log_aborted"])),
            ("changed_rows", float(sum(m["rows"].get("result", 0) for m in manifests))),
        ]
        return self.spark.createDataFrame(rows, "name string, value double")

    def alerts(self) -> list[dict]:
        """What needs attention: failed results, and transactions that have waited too long."""
        found = [{"level": "error", "result": n, "text": f"failed {f.times} times: {f.error}", "since": f.since} for n, f in sorted(self._failures.items())]
        for n in self.results():
            p = self.progress(n)
            if p["oldest_pending_seconds"] > self.config.stall_seconds:
                found.append({"level": "warning", "result": n, "text": f"a transaction waits for {p['oldest_pending_seconds']:.0f} s", "since": time.time() - p["oldest_pending_seconds"]})
        return found

    def snapshot(self) -> dict:
        """What a dashboard shows."""
        rows = lambda df: [r.asDict() for r in df.collect()]
        return {
            "runtime": rows(self.runtime_status())[0], "dataflows": rows(self.dataflow_status()), "metrics": rows(self.runtime_metrics()), "dags": [self.explain(n) for n in self.results()],
            "alerts": self.alerts(), "history": list(self._history), "config": asdict(self.config),
        }

    # Files.
    def _lower(self, sql: str) -> Plan:
        return lower(sql, {n: tuple(T.StructType.fromJson(s["schema"]).names) for n, s in self.sources().items()})

    def _check_name(self, name: str) -> None:
        if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
            raise EngineError(f"{name!r} is no name: lower-case letters, digits and underscores")

    def _store(self, name: str) -> Store:
        return Store(self.spark, f"{self.root}/results/{name}")

    def _manifest(self, name: str) -> dict:
        m = self._store(name).manifest()
        if m is None:
            raise EngineError(f"result {name} does not exist")
        return m

    def _names(self, folder: str) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.root}/{folder}") if Store(self.spark, f"{self.root}/{folder}/{n}").manifest() is not None]
