"""Given tables, and inputs in other formats that Spark derives from them."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.plans.scratch import scratch_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """(id, string) from documents or part."""
    id_col, text = {"documents": ("doc_id", "text"), "part": ("p_partkey", "p_name")}[name]
    return table(spark, sf_dir, name).select(F.col(id_col).alias("id"), F.col(text).alias("string"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet-shaped records from customer and orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_mktsegment").alias("DataSourceName"), F.col("o_orderpriority").alias("Dimension Value"),
        F.col("c_name").alias("Owner"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("NCM"),
        F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"))


RECORDS_SQL = """
  SELECT c_mktsegment AS "DataSourceName", o_orderpriority AS "Dimension Value", c_name AS "Owner",
         lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS "NCM", year(o_orderdate) AS "Year", month(o_orderdate) AS "Month"
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def disregard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion list: second column names the company."""
    return (table(spark, sf_dir, "customer").where("c_acctbal < 0")
            .select(F.col("c_custkey").alias("Code"), F.col("c_name").alias("Company")))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value): each document as a file of lines."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file"), F.explode(F.split("text", "\n")).alias("value"))


DOCUMENT_LINES_SQL = "SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS value FROM documents"


def saved_csv(df: DataFrame, sep: str = ",", encoding: str = "UTF-8") -> str:
    path = scratch_path(df.sparkSession, "csv")
    df.write.options(header=True, sep=sep, encoding=encoding, emptyValue="", escape='"').csv(path)
    return path


def saved_text(lines: DataFrame, suffix: str) -> str:
    """Write a one-column frame as text files named ``*.suffix``."""
    spark = lines.sparkSession
    path = scratch_path(spark, "text")
    lines.write.text(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.endswith(".txt") and suffix != "txt":
            files.rename(status.getPath(), hadoop.Path(root, name[:-3] + suffix))
    return path


def saved_lines(lines: DataFrame, header: str) -> str:
    """Write a one-column frame as files of lines, each with ``header`` as its first line."""
    path = scratch_path(lines.sparkSession, "lines")
    lines.toDF(header).write.options(header=True, sep="\x01", quote="", escape="", escapeQuotes=False).csv(path)
    return path


def text_tree(spark: SparkSession, sf_dir: str) -> list[str]:
    """Three directories of lines: pages (.html), documents (.txt) and events (.log)."""
    def split_lines(df, col):
        return df.select(F.explode(F.split(col, "\n")).alias("value"))
    pages = saved_text(split_lines(table(spark, sf_dir, "pages"), "html"), "html")
    docs = saved_text(split_lines(table(spark, sf_dir, "documents"), "text"), "txt")
    events = table(spark, sf_dir, "events").select(
        F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props").alias("value"))
    return [pages, docs, saved_text(events, "log")]


TEXT_TREE_SQL = """
  SELECT 'html' AS kind, unnest(string_split(html, chr(10))) AS value FROM pages
  UNION ALL SELECT 'txt', unnest(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT 'log', concat_ws(' ', CAST(event_id AS VARCHAR), event_type, props) FROM events"""


def _book(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A minimal workbook with inline strings, as input for the workbook reader."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names, links = [], []
        for at, (name, rows) in enumerate(sheets.items(), start=1):
            names.append(f'<sheet name="{escape(name)}" sheetId="{at}" r:id="r{at}"/>')
            links.append(f'<Relationship Id="r{at}" Target="worksheets/sheet{at}.xml"/>')
            lines = [list(rows.columns)] + rows.values.tolist()
            body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for v in line)
                           + "</row>" for line in lines)
            book.writestr(f"xl/worksheets/sheet{at}.xml",
                          f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        book.writestr("xl/workbook.xml",
                      f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(names)}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{"".join(links)}</Relationships>')
    return out.getvalue()


def packed_workbooks(df: DataFrame, sheet_of: str) -> DataFrame:
    """(path, content): workbooks packed on the executors, one sheet per value of ``sheet_of``."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            books = {str(k): g.drop(columns=[sheet_of]) for k, g in part.groupby(sheet_of)}
            if books:
                content = _book(books)
                yield pd.DataFrame({"path": [f"book-{zlib.crc32(content):08x}.xlsx"], "content": [content]})

    return written(df.mapInPandas(pack, "path string, content binary"), "books")
