"""Versioned weighted tables under one folder, published by one manifest.

A table is a list of folders of Parquet files whose rows add up. An epoch writes new folders and then a manifest that names all folders that count; a
reader takes the manifest with the largest number. A manifest's number is claimed in one atomic step (``sources.files``), which either happens or
doesn't, so an epoch that dies before leaves nothing that is read, and one that is run again after it finds it done. Rows of a table are
dealt into ``buckets`` folders by the hash of its key, so that reading what belongs to a few keys opens few files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

BUCKET = "__bucket"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and n[0].isdigit())

    def manifest(self) -> dict | None:
        while numbers := self._numbers():
            try:
                return files.read_json(self.spark, f"{self.path}/manifests/{numbers[-1]}.json")
            except Exception:
                if self._numbers()[-1:] == numbers[-1:]:  # else it was superseded and deleted meanwhile
                    raise
        return None

    def publish(self, manifest: dict) -> None:
        """The commit point of an epoch."""
        if not files.claim_json(self.spark, f"{self.path}/manifests", f"{manifest['number']}.json", manifest):
            raise RuntimeError(f"manifest {manifest['number']} exists already")

    def part(self, name: str, df: DataFrame) -> dict:
        """The name of a new part of a table, still to be filled."""
        return {"folder": f"{name}/{uuid.uuid4().hex}", "schema": df.schema.jsonValue()}

    @staticmethod
    def bucket(keys: list | None, buckets: int):
        """The bucket of a row; keys: expressions to deal by."""
        return (F.pmod(F.hash(*keys), F.lit(buckets)) if keys else F.lit(0)).cast("int").alias(BUCKET)

    def fill(self, part: dict, df: DataFrame, keys: list | None, buckets: int, few: bool = False) -> None:
        """few: df is a local table, which one task writes."""
        dealt = df.withColumn(BUCKET, self.bucket(keys, buckets))
        # Few files: each bucket together, unless it is large.
        dealt = dealt.coalesce(1) if few else dealt.hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{part['folder']}")

    def write(self, name: str, df: DataFrame, keys: list | None, buckets: int) -> dict:
        """A new part of a table, written at once."""
        part = self.part(name, df)
        self.fill(part, df, keys, buckets)
        return part

    def buckets(self, part: dict) -> list[int]:
        found = files.names(self.spark, f"{self.path}/{part['folder']}")
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith(f"{BUCKET}="))

    def read(self, parts: list[dict], schema: T.StructType, only: list[int] | None = None) -> DataFrame:
        """The parts' rows together, not consolidated; only: buckets to read."""
        out = self.spark.createDataFrame([], schema)
        for part in parts:
            full = T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])
            df = self.spark.read.schema(full).parquet(f"{self.path}/{part['folder']}")
            if only is not None:
                df = df.where(F.col(BUCKET).isin(only))
            df = df.drop(BUCKET)
            out = df if out.isLocal() else out.unionByName(df)
        return out

    def collect_garbage(self, manifest: dict, keep: int = 2) -> int:
        """Deletes folders that neither this manifest nor the ones right before name; returns how many."""
        numbers = self._numbers()
        live = {x["folder"] for n in numbers[-keep:] for t in files.read_json(self.spark, f"{self.path}/manifests/{n}.json")["tables"].values() for x in t}
        gone = 0
        for name in manifest["tables"]:
            for own in files.names(self.spark, f"{self.path}/{name}"):
                if f"{name}/{own}" not in live:
                    files.delete(self.spark, f"{self.path}/{name}/{own}")
                    gone += 1
        for n in numbers[:-keep]:
            files.delete(self.spark, f"{self.path}/manifests/{n}.json")
        return gone

    def delete(self) -> None:
        files.delete(self.spark, self.path)
