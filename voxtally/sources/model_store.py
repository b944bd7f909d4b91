"""Versions of a model's tables in one folder, each visible only when it is complete.

A version's tables are written under a name of their own; its manifest, a small file that lists them
with their schemas and row counts, appears last and in one step. Readers go by manifests alone, so a
writer that stops halfway leaves nothing that could be read. Manifests are named by a count and an
id of the writer's, so writers that finish at the same time do not meet; the later name counts as newer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS, VERSIONS = "manifests", "versions"
_DIGITS = 10


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(path: str, version: str) -> str:
    return f"{path}/{MANIFESTS}/{version}.json"


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Write the file under another name first, so that it appears with all of its text."""
    target, files = _path(spark, path)
    draft, _ = _path(spark, f"{path}.draft")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not files.rename(draft, target):
        raise OSError(f"{path} could not be written")


def _read(spark: SparkSession, path: str) -> str:
    target, files = _path(spark, path)
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions in ``path``, oldest first."""
    folder, files = _path(spark, f"{path}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))


def save_version(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], note: str = "") -> str:
    """Write all tables as a new version of the model in ``path``; the name of the version."""
    writer = uuid.uuid4().hex
    place, listed = f"{VERSIONS}/{writer}", {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{place}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{path}/{place}/{name}")
        listed[name] = {"schema": json.loads(df.schema.json()), "rows": written.count()}
    text = json.dumps({"folder": place, "note": note, "tables": listed}, ensure_ascii=False)
    last = max(versions(spark, path), default="0")
    version = f"{int(last.split('-')[0]) + 1:0{_DIGITS}d}-{writer}"
    _publish(spark, _manifest(path, version), text)
    return version


def load_version(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default the last complete one, with the schemas they were saved with."""
    there = versions(spark, path)
    number = version if version is not None else max(there, default=None)
    if number not in there:
        raise FileNotFoundError(f"{path} has no complete version{'' if version is None else f' {version}'}")
    listed = manifest(spark, path, number)
    return {
        name: spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{path}/{listed['folder']}/{name}")
        for name, entry in listed["tables"].items()
    }


def manifest(spark: SparkSession, path: str, version: str) -> dict:
    """What a version's manifest says: ``folder``, ``note`` and ``tables`` with schema and rows."""
    return json.loads(_read(spark, _manifest(path, version)))
