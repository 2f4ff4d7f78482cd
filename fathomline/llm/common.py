"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text; an empty array where it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import os
        import tempfile

        root = "file://" + os.path.join(tempfile.gettempdir(), "fathomline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:  # a path alone is one of the cluster's default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = root.replace("file:/", "file:///", 1) if not root.startswith("file://") else root
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run meanwhile: an executor holds each batch several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(had)) if int(had) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, had)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go when it ends; for results that are stored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, had)


def give_back() -> None:
    """Free memory of this process goes back to the system, where the C library can do so."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_shipped: set[str] = set()


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors, wherever the driver found it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        import shutil
        import tempfile
        from pathlib import Path

        package = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as scratch:
            bare = Path(scratch, "tree")
            shutil.copytree(package, bare / package.name, ignore=shutil.ignore_patterns("__pycache__"))
            kept = Path(tempfile.mkdtemp(), package.name)  # the driver serves it as long as the application lives
            context.addPyFile(shutil.make_archive(str(kept), "zip", bare))
        _shipped.add(context.applicationId)
    return df.mapInArrow(fn, schema)
