"""Make the package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's application, once."""
    context = spark.sparkContext
    if getattr(context, "_eqspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    where = tempfile.mkdtemp(prefix="eqspark-ship-")  # of the driver alone, which serves the archive until it ends
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    staged = os.path.join(where, "src")
    shutil.copytree(here, os.path.join(staged, os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(where, "eqspark"), "zip", staged))
    context._eqspark_shipped = True
