"""Secret scans with an incremental ledger of blobs. DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds which rule versions each blob has been scanned with; a
scan takes one representative of each blob, runs only the rules whose version that blob has not seen, and joins the findings back to
all paths that hold the blob. Re-running over known content therefore scans nothing, and a raised rule version rescans with that rule only.

Where a match lies comes from the lengths of the text's pieces between matches and of the matches, summed up in order,
so positions count code points. A text without a match of a rule costs that rule's search alone.

Skew: copies of one text are one blob; only (path, blob) pairs of them are shuffled, pre-aggregated before the shuffle. The join back deals the copies
of a blob into ``SALTS`` parts by path; findings, of which a blob has few, go to each part. Empty texts have no part in it. Defined cases: a null text is an empty
one; rows without a path are scanned, reported and redacted like others; repeated rows are reported once each; rules may overlap, and each reports its
own spans; an empty table gives an empty result; other columns are ignored by ``digest`` and kept, whatever their names, by ``redact``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

#: Parts that the copies of a blob are dealt into.
SALTS = 16


class Rule(NamedTuple):
    """A kind of secret: matches of pattern whose group has at least ``least`` characters. Raise version on any change."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, and well-known token formats that the method adds.
BASE = (
    Rule("assign", 1, """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),  # the whole run of capitals and digits, 16 characters at least
    Rule("hex", 1, "[0-9a-f]{32,}"),
)
ADDED = (
    Rule("pem", 1, "-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:[A-Za-z0-9+/=\\s]*-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", 1, "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
LEDGER = "blob_id string, rule string"
FINDINGS = "blob_id string, kind string, version int, start long, `end` long"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(rule: Rule, k: int) -> Column:
    """Array of what each match needs to be placed: rule number, ordinal, characters before it since the last match, its
    length, and the length that decides."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    made = F.transform(
        F.arrays_zip(found.alias("m"), group.alias("g"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("p")),
        lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.length(x["p"]).alias("lead"), F.length(x["m"]).alias("size"), F.length(x["g"]).alias("counts")),
    )
    return F.when((F.shiftright("pending", k) % 2 == 1) & text.rlike(rule.pattern), made)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings (blob_id, kind, version, start, end) and ledger rows (blob_id, rule) that are new against the ledger.

    versions: path and text, one row for each version of each path."""
    every_rule = (1 << len(rules)) - 1
    blobs = versions.select("path", blob_id(F.col("text")).alias("blob_id")).groupBy("blob_id").agg(F.min("path").alias("path"))
    if ledger is None:
        blobs = blobs.withColumn("pending", F.lit(every_rule))
    else:
        # Rules that a blob has seen, and those still pending, as bits.
        bit = reduce(lambda a, k: a.when(F.col("rule") == rules[k].key, 1 << k), range(len(rules)), F).otherwise(0)
        seen = ledger.groupBy("blob_id").agg(F.bit_or(bit).alias("seen"))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("pending", F.lit(every_rule).bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0))))).drop("seen")
        blobs = blobs.where("pending > 0")
    named = F.array(*(F.lit(r.key) for r in rules))
    done = blobs.select("blob_id", F.explode(F.filter(named, lambda _, k: F.expr("pending").bitwiseAND(F.call_function("shiftleft", F.lit(1), k)) > 0)).alias("rule"))
    # A blob without any path is represented by its rows without one.
    texts = versions.select(F.col("path").alias("_path"), blob_id(F.col("text")).alias("_blob"), "text")
    texts = texts.join(blobs.hint("shuffle_hash"), F.expr("_path <=> path AND _blob = blob_id"))
    every = F.filter(F.array(*(_matches(r, k) for k, r in enumerate(rules))), lambda x: x.isNotNull())
    hits = texts.select("blob_id", F.explode(F.flatten(every)).alias("x")).select("blob_id", "x.*")
    order = Window.partitionBy("blob_id", "k").orderBy("i")
    hits = hits.repartition("blob_id").dropDuplicates(["blob_id", "k", "i"])
    end = F.sum(F.col("lead") + F.col("size")).over(order).cast("long")
    hits = hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    table = lambda f: F.array(*(F.lit(f(r)) for r in rules))[F.col("k")]
    hits = hits.where(F.col("counts") >= table(lambda r: r.least))
    return hits.select("blob_id", table(lambda r: r.kind).alias("kind"), table(lambda r: r.version).alias("version"), "start", "end"), done


class Ledger:
    """A ledger and its findings, kept as Parquet under a path that driver and executors share."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else None

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is new in versions and returns the findings of the current rule versions, for all paths."""
        found, done = (storage.keep(x, "scan") for x in scan(versions, self._read("ledger", LEDGER), rules))
        found.write.mode("append").parquet(f"{self.path}/findings")
        # Last: if the job dies before this, the same pairs are scanned again and their findings read once below.
        done.write.mode("append").parquet(f"{self.path}/ledger")
        now = [r.key for r in rules]
        known = self._read("findings", FINDINGS).where(F.concat("kind", F.lit("@"), "version").isin(now)).distinct()
        return by_path(versions, known)


def by_path(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """path, kind, version, start and end for every path that holds a blob with findings."""
    return versions.select("path", blob_id(F.col("text")).alias("blob_id")).join(findings, "blob_id").drop("blob_id")


def _spans(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id and its spans, by start, then kind in the order of the rules."""
    place = reduce(lambda a, k: a.when(F.col("kind") == rules[k].kind, k), range(1, len(rules)), F.when(F.col("kind") == rules[0].kind, 0))
    return findings.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "kind", "end"))).alias("spans"))


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    found, _ = scan(versions, None, rules)
    base = [r.kind for r in BASE]
    of = lambda kind: lambda s: s["kind"] == kind
    words = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    per = _spans(found, rules).select(
        "blob_id",
        *(F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(words(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        words(F.col("spans")).alias("spans"),
    )
    every = _with_blob(docs.select("doc_id", blob_id(F.col("text")).alias("blob_id"), (F.coalesce(F.length("text"), F.lit(0)) == 0).alias("none")), per, "blob_id", "salt", F.col("none"))
    filled = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base]
    return every.select("doc_id", *filled, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _with_blob(docs: DataFrame, per: DataFrame, blob: str, salt: str, none: Column) -> DataFrame:
    """docs with what per, one row for each blob with findings, says of their blob (null: nothing). Rows that are none hold nothing, and meet nothing."""
    parts = per.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Where a row without findings goes doesn't matter; empty texts are many, so they are dealt by their path alone.
    left = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    left = left.withColumn(blob, F.when(none, F.concat(F.lit("none-"), F.xxhash64("doc_id"))).otherwise(F.col(blob)))
    return left.join(parts, [blob, salt], "left")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in ``text`` replaced by mark (overlapping ones by one), and ``n_chars``, if there, recounted."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    found, _ = scan(versions, None, rules)
    cut, blob, salt = storage.unused(docs.columns, "cut", "blob", "salt")
    spans = _spans(found, rules).withColumnRenamed("spans", cut).withColumnRenamed("blob_id", blob)
    joined = _with_blob(docs.withColumn(blob, blob_id(F.col("text"))), spans, blob, salt, F.coalesce(F.length("text"), F.lit(0)) == 0)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.when(s["start"] >= a["at"], F.concat(F.col("text").substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], between).alias("out"))

    def rest(a: Column) -> Column:
        return F.concat(a["out"], F.col("text").substr((a["at"] + 1).cast("int"), F.length("text")))

    cleaned = joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.aggregate(cut, start, step, rest)))
    if "n_chars" in docs.columns:
        n = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(n)))
    return cleaned.select(*(F.col(f"`{c}`") for c in docs.columns))
