"""The package on every executor, whether or not it is installed there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors of this session, once; Python workers import them from there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    where = os.path.join(tempfile.mkdtemp(prefix="concordat-"), "concordat.zip")
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    archive.write(whole, os.path.relpath(whole, os.path.dirname(PACKAGE)))
    context.addPyFile(where)  # Spark's own file server hands it out
    _shipped.add(context.applicationId)
