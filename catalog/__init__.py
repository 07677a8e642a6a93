"""Registered queries with their SQL, grouped by area."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from . import basics, clustering, learning

QUERIES = {**basics.QUERIES, **clustering.QUERIES, **learning.QUERIES}
SQL = {**basics.SQL, **clustering.SQL, **learning.SQL}


def ship(spark: SparkSession) -> None:
    """Send both packages to the Python workers once per session (also when only the root is on sys.path)."""
    context = spark.sparkContext
    if getattr(context, "_stringloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "stringloom_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("stringloom", "catalog"):
            for folder, _, files in os.walk(os.path.join(root, package)):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._stringloom_shipped = True
