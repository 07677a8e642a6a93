"""Delimited-file scans: dialects, tolerant line handling, newest-file selection."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..operators.clean import MissingColumns
from ..plans.scratch import written

BOM = "﻿"


class NoInputFiles(FileNotFoundError):
    """The given path or pattern matches no file."""


def _require_files(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        pattern = hadoop.Path(path)
        found = pattern.getFileSystem(conf).globStatus(pattern)
        if found is None or len(found) == 0:
            raise NoInputFiles(f"no files at {path}")


def _first_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """(path, line): the first line of every file that has one, read by the executors; nothing but its beginning is read.

    Paths of Spark's listing are opened through pyarrow's file systems, so a compressed file is opened by its suffix too.
    """
    def read(batches):
        import io
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            names, lines = [], []
            for path in batch.column(0).to_pylist():
                scheme, _, rest = path.partition(":")
                if scheme == "file":
                    files, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    files, name = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest)}")
                with files.open_input_stream(name) as stream, io.TextIOWrapper(io.BufferedReader(stream), encoding=encoding) as text:
                    line = text.readline()
                if line:
                    names.append(path)
                    lines.append(line.rstrip("\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["path", "line"])

    return spark.read.format("binaryFile").load(paths).select("path").mapInArrow(read, "path string, line string")


def _files_by_header(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> dict[tuple[str, ...], list[str]]:
    """What to scan under each different first line; empty files have none.

    Executors read the lines and only the different ones come back. With a single one the given paths stand as they are. With several, the files of each are
    named, as the planner's own listing of a scan names them. A name left blank becomes ``_c`` and its position.
    """
    lines = written(_first_lines(spark, paths, encoding), "headers")
    groups: dict[tuple[str, ...], list[str]] = {}
    different = [r["line"] for r in lines.select("line").distinct().orderBy("line").collect()]
    for line in different:
        names = next(csv.reader([line.removeprefix(BOM)], delimiter=sep), [])
        files = paths
        if len(different) > 1:
            files = [_as_pattern(r["path"]) for r in lines.where(F.col("line") == line).select("path").orderBy("path").collect()]
        groups.setdefault(tuple(n or f"_c{i}" for i, n in enumerate(names)), []).extend(files)
    return groups


def _file_schema(header: tuple[str, ...], schema: T.StructType, files: list[str]) -> T.StructType:
    """The columns of a file in its own order, typed as declared; a declared column that the file lacks is an error."""
    kinds = {f.name: f.dataType for f in schema.fields}
    if missing := [name for name in kinds if header.count(name) != 1]:
        raise MissingColumns(f"{files[0]} (and {len(files) - 1} more) has the columns {list(header)}, without one {missing}")
    return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in header])


def _declared(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema


def read_delimited(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",",
                   encoding: str = "UTF-8", na_step: bool = True) -> DataFrame:
    """Header-first delimited scan: the declared columns by name, whatever their order in each file; a leading BOM is ignored."""
    paths = [path] if isinstance(path, str) else list(path)
    _require_files(spark, paths)
    wanted = _declared(spark, schema)
    rows = spark.createDataFrame([], wanted)
    for header, files in _files_by_header(spark, paths, sep, encoding).items():
        part = (
            spark.read.schema(_file_schema(header, wanted, files))
            .options(header=True, sep=sep, encoding=encoding, escape='"', enforceSchema=True)
            .csv(files)
        )
        rows = rows.unionByName(part.select(*(F.col(f"`{f.name}`") for f in wanted.fields)))
    return blank_to_null(rows) if na_step else rows


def read_semicolon(spark: SparkSession, path: str | list[str], schema: T.StructType | str,
                   encoding: str = "UTF-8") -> DataFrame:
    return read_delimited(spark, path, schema, sep=";", encoding=encoding)


def _field_count(line: F.Column, sep: str) -> F.Column:
    unquoted = F.regexp_replace(line, '"([^"]|"")*"', "q")
    return F.size(F.split(unquoted, f"\\Q{sep}\\E", -1))


def split_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType,
                   sep: str = ",", encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): lines with more fields than their file's header are set aside, short lines end in NULLs.

    Works on whole lines, so the outcome does not depend on which columns a query selects. A quoted field must not span lines. The first line of
    each file is its header and binds the declared columns by name; a later line equal to it is data.
    """
    paths = [path] if isinstance(path, str) else list(path)
    _require_files(spark, paths)
    good = spark.createDataFrame([], schema)
    rejected = spark.createDataFrame([], "file string, value string, fields int")
    for header, files in _files_by_header(spark, paths, sep, encoding).items():
        own = _file_schema(header, schema, files)
        lines = (
            # every line but the first of each file, as it stands: no quote, and a line that holds the separator is kept whole as malformed
            spark.read.schema("value string, whole string")
            .options(header=True, sep="\x01", quote="", escape="", encoding=encoding, enforceSchema=True, columnNameOfCorruptRecord="whole")
            .csv(files)
            .select(F.coalesce("whole", "value").alias("value"), F.col("_metadata.file_path").alias("file"))
            .where(F.length("value") > 0)
            .withColumn("fields", _field_count(F.col("value"), sep))
        )
        fits = F.col("fields") <= len(header)
        parsed = F.from_csv("value", F.lit(_ddl(own)), {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})
        named = lines.where(fits).select(parsed.alias("r")).select(*(F.col(f"r.`{f.name}`") for f in schema.fields))
        good = good.unionByName(blank_to_null(named))
        rejected = rejected.unionByName(lines.where(~fits).select("file", "value", "fields"))
    return good, rejected


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _as_pattern(path: str) -> str:
    """A file name as a glob that matches only itself."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def newest_file(spark: SparkSession, pattern: str) -> str:
    """Path of the most recently modified file matching ``pattern``; ties go to the greater path."""
    _require_files(spark, [pattern])
    listing = (
        spark.read.format("binaryFile").load(pattern)
        .select("path", "modificationTime")
        .agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
    )
    return listing.first()["path"]


def newest_folder(spark: SparkSession, pattern: str) -> str:
    """Folder of the most recently modified file matching ``pattern``: a drop of many part files; ties go to the greater path."""
    return newest_file(spark, pattern).rsplit("/", 1)[0]
