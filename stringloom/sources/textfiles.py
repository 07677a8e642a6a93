"""Line scans over directory trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str], file_glob: str | None = None,
               exclude: str | None = None) -> DataFrame:
    """(file, value): every line below ``paths``, sub-directories included.

    ``file_glob`` keeps matching file names at listing time; ``exclude`` is a glob of names to leave out.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    listed = [paths] if isinstance(paths, str) else list(paths)
    lines = reader.text(listed).select(F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_name").alias("file_name"), "value")
    if exclude:
        regex = "^" + "".join({"*": ".*", "?": "."}.get(ch, "\\Q" + ch + "\\E") for ch in exclude) + "$"
        lines = lines.where(~F.col("file_name").rlike(regex))
    return lines
