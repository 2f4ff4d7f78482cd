"""Sends this package to the executors, wherever the driver found it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, with the package added to its application once, so that Python tasks can import it."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        with tempfile.TemporaryDirectory() as scratch:
            bare = Path(scratch, "tree")
            shutil.copytree(package, bare / package.name, ignore=shutil.ignore_patterns("__pycache__"))
            # the driver serves the archive as long as the application lives
            context.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp(), package.name)), "zip", bare))
        _shipped.add(context.applicationId)
    return df
