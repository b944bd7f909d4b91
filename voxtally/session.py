"""Session settings and the shared work folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "voxtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; extra ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()
_local_folders: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, as ``--py-files`` would, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="voxtally-")) / package.name),
        "zip",
        root_dir=package.parent,
        base_dir=package.name,
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may run without the setting; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="voxtally-")
    return _local_folders[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path inside the work folder that nothing has written to yet."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


_open_scratches: list[list[str]] = []


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries of the block delete their shuffle files when they end, not when the driver collects its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the work folder and read it back.

    The written table cuts the lineage, survives lost executors, and gives Catalyst file sizes and
    column pruning for whatever reads it next. The shuffle files it came from are deleted at once.
    """
    path = new_folder(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    if _open_scratches:
        _open_scratches[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["_folder"] = path
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that :func:`materialize` writes inside, once the block ends.

    The block gets a function that marks a table as still needed; a table that an enclosing block
    marks is kept by it in turn.
    """
    written: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.__dict__["_folder"])
        return table

    _open_scratches.append(written)
    try:
        yield keep
    finally:
        _open_scratches.remove(written)
        if _open_scratches:
            _open_scratches[-1].extend(p for p in written if p in kept)
        for path in written:
            if path not in kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
