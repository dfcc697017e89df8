"""Small files on the store that driver and executors share, and the one atomic step that all of them rest on: a name is claimed once.

``claim`` gives a written draft its final name unless another writer has it: a hard link on local and mounted disks, a rename that refuses an existing
target elsewhere (HDFS and stores with its semantics). Object stores without an atomic rename are refused, as a claim there could be made twice.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

#: Schemes of stores that copy instead of renaming.
COPYING = {"s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cos"}


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = hadoop(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def claim_json(spark: SparkSession, folder: str, name: str, value: dict) -> bool:
    """Whether folder/name is now this value; False, and nothing changed, if the name was taken."""
    fs, final = hadoop(spark, f"{folder}/{name}")
    if str(fs.getScheme()) in COPYING:
        raise RuntimeError(f"{fs.getScheme()} has no atomic rename; keep the engine's folder on HDFS, a mounted disk or a store with its semantics")
    fs.mkdirs(final.getParent())
    _, draft = hadoop(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    try:
        if str(fs.getScheme()) == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        return bool(fs.rename(draft, final))
    except FileExistsError:
        return False
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)


def size(spark: SparkSession, path: str) -> int:
    fs, p = hadoop(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)
