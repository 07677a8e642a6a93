"""Queries over sources, sinks, cleansing, search and tables, each with its SQL."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.functions.text import blank_to_null, joined, line_of, three_decimals
from stringloom.operators import clean, report, search, tabular
from stringloom.plans.scratch import scratch_path
from stringloom.sources import delimited, sinks, textfiles, workbook

from .tables import (DOCUMENT_LINES_SQL, RECORDS_SQL, TEXT_TREE_SQL, disregard, document_lines, records, saved_csv, saved_lines,
                     saved_text, packed_workbooks, table, text_tree)

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
KEPT = "BUILDING"
RECORD_STRINGS = "DataSourceName string, `Dimension Value` string, Owner string, NCM string, Year int, Month int"


# ---- sources -------------------------------------------------------------------------------------------------

@query("csv_scan", CUSTOMER_SQL)
def csv_scan(spark, sf):
    # two files with their columns in other orders and one column more than declared
    customer = table(spark, sf, "customer")
    turned = customer.where("c_custkey % 2 = 0").select("c_mktsegment", F.lit("x").alias("extra"), "c_acctbal", "c_name", "c_nationkey", "c_custkey")
    paths = [saved_csv(customer.where("c_custkey % 2 = 1")), saved_csv(turned)]
    return delimited.read_delimited(spark, paths, CUSTOMER)


@query("csv_skip_bad_lines", """
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END AS string
  FROM orders WHERE o_orderkey % 5 <> 0""")
def csv_skip_bad_lines(spark, sf):
    key = F.col("o_orderkey").cast("string")
    # every fifth line has one field too many, every fifth is short, one in five is quoted
    line = (F.when(F.col("o_orderkey") % 5 == 0, F.concat_ws(",", key, "o_orderpriority", "o_orderstatus"))
            .when(F.col("o_orderkey") % 5 == 1, key)
            .when(F.col("o_orderkey") % 5 == 2, F.concat(key, F.lit(',"'), "o_orderpriority", F.lit('"')))
            .otherwise(F.concat_ws(",", key, "o_orderpriority")))
    lines = table(spark, sf, "orders").select(line.alias("value"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("string", T.StringType())])
    return delimited.split_tolerant(spark, saved_lines(lines, '"id","string"'), schema)[0]


@query("csv_rejected_lines", """
  SELECT concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus) AS value, 3 AS fields
  FROM orders WHERE o_orderkey % 5 = 0""")
def csv_rejected_lines(spark, sf):
    line = F.when(F.col("o_orderkey") % 5 == 0,
                  F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus")
                  ).otherwise(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority"))
    path = saved_lines(table(spark, sf, "orders").select(line.alias("value")), "id,string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("string", T.StringType())])
    return delimited.split_tolerant(spark, path, schema)[1].select("value", "fields")


@query("csv_semicolon_bom", CUSTOMER_SQL)
def csv_semicolon_bom(spark, sf):
    path = scratch_path(spark, "bom")
    sinks.write_semicolon(table(spark, sf, "customer"), path)
    return delimited.read_semicolon(spark, path, CUSTOMER)


@query("csv_latin1", "SELECT c_custkey AS id, 'São ' || c_name || ' Açaí' AS name FROM customer")
def csv_latin1(spark, sf):
    named = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("São "), "c_name", F.lit(" Açaí")).alias("name"))
    path = saved_csv(named, sep=";", encoding="ISO-8859-1")
    return delimited.read_semicolon(spark, path, "id long, name string", encoding="ISO-8859-1")


@query("newest_file", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def newest_file(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    root = scratch_path(spark, "drops")
    for status in ("O", "F", "P"):
        orders.where(F.col("o_orderstatus") == status).write.options(header=True).csv(f"{root}/{status}")
        time.sleep(0.05)
    newest = delimited.newest_folder(spark, f"{root}/*/*.csv")
    return delimited.read_delimited(spark, newest, "o_orderkey long, o_orderstatus string")


@query("na_tokens", """
  SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1, 2, 3) THEN NULL WHEN p_partkey % 6 = 4 THEN 'none' ELSE p_brand END AS brand
  FROM part""")
def na_tokens(spark, sf):
    part = table(spark, sf, "part")
    cell = F.element_at(F.array(F.lit("NA"), F.lit("null"), F.lit(""), F.lit("#N/A"), F.lit("none"), F.col("p_brand")),
                        (F.col("p_partkey") % 6 + 1).cast("int"))
    return blank_to_null(part.select("p_partkey", cell.alias("brand")))


WORKBOOK_COLUMNS = ["Owner", "NCM", "Dimension Value", "DataSourceName", "Year", "Month"]


def _workbook_rows(spark, sf):
    sheets = records(spark, sf).select(
        F.when(F.col("Year") % 2 == 0, "TRADEMARK").otherwise("OTHER").alias("sheet"),
        *[F.col(c).cast("string").alias(c) for c in WORKBOOK_COLUMNS])
    return workbook.parse_workbooks(packed_workbooks(sheets, "sheet"))


@query("workbook_ingest", f"""
  SELECT CASE WHEN "Year" % 2 = 0 THEN 'TRADEMARK' ELSE 'OTHER' END AS sheet, "NCM" AS ncm, "Owner" AS owner
  FROM ({RECORDS_SQL})""")
def workbook_ingest(spark, sf):
    record = F.col("record")
    return _workbook_rows(spark, sf).select("sheet", record["NCM"].alias("ncm"), record["Owner"].alias("owner"))


@query("worksheet_select", f"""
  SELECT "Owner", "NCM", "Dimension Value", "DataSourceName", CAST("Year" AS VARCHAR) AS "Year", CAST("Month" AS VARCHAR) AS "Month"
  FROM ({RECORDS_SQL}) WHERE "Year" % 2 = 0""")
def worksheet_select(spark, sf):
    rows = _workbook_rows(spark, sf)
    workbook.require_sheet(rows, "TRADEMARK")
    return workbook.pick_sheet(rows, "TRADEMARK", WORKBOOK_COLUMNS).drop("path", "row_no")


@query("worksheet_names", f"""
  SELECT DISTINCT CASE WHEN "Year" % 2 = 0 THEN 'TRADEMARK' ELSE 'OTHER' END AS sheet FROM ({RECORDS_SQL})""")
def worksheet_names(spark, sf):
    return _workbook_rows(spark, sf).select("sheet").distinct()


def _kind():
    return F.regexp_extract("file_name", r"\.([a-z]+)$", 1).alias("kind")


@query("text_tree_search", f"SELECT kind, value FROM ({TEXT_TREE_SQL}) WHERE regexp_matches(value, 'the')")
def text_tree_search(spark, sf):
    lines = textfiles.read_lines(spark, text_tree(spark, sf))
    return search.search_lines(lines, "the").select(_kind(), "value")


@query("text_paths_search", f"""
  SELECT kind, value FROM ({TEXT_TREE_SQL}) WHERE kind IN ('html', 'log') AND regexp_matches(value, 'click|div')""")
def text_paths_search(spark, sf):
    pages, _, events = text_tree(spark, sf)
    return search.search_lines(textfiles.read_lines(spark, [pages, events]), "click|div").select(_kind(), "value")


@query("text_type_filter", f"SELECT value FROM ({TEXT_TREE_SQL}) WHERE kind = 'html' AND regexp_matches(value, '<p')")
def text_type_filter(spark, sf):
    lines = textfiles.read_lines(spark, text_tree(spark, sf), file_glob="*.html")
    return search.search_lines(lines, "<p").select("value")


@query("text_exclude_files", f"SELECT kind, value FROM ({TEXT_TREE_SQL}) WHERE kind <> 'log' AND regexp_matches(value, 'er')")
def text_exclude_files(spark, sf):
    lines = textfiles.read_lines(spark, text_tree(spark, sf), exclude="*.log")
    return search.search_lines(lines, "er").select(_kind(), "value")


# ---- sinks ---------------------------------------------------------------------------------------------------

PREPARED_SQL = f"""SELECT "Owner", "NCM", '' AS blank, "Dimension Value" FROM ({RECORDS_SQL}) WHERE "DataSourceName" = '{KEPT}'"""


@query("csv_sink_bom", f"""SELECT "Owner", "NCM", "Dimension Value", true AS blank FROM ({RECORDS_SQL}) WHERE "DataSourceName" = '{KEPT}'""")
def csv_sink_bom(spark, sf):
    path = scratch_path(spark, "prepared")
    sinks.write_semicolon(clean.prepare_records(records(spark, sf), KEPT), path)
    back = delimited.read_semicolon(spark, path, "Owner string, NCM string, _c2 string, `Dimension Value` string")
    return back.select("Owner", "NCM", "Dimension Value", F.col("_c2").isNull().alias("blank"))


@query("csv_sink_latin1", "SELECT s_suppkey, 'Pão ' || s_name AS name, s_acctbal FROM supplier")
def csv_sink_latin1(spark, sf):
    path = scratch_path(spark, "latin")
    named = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Pão "), "s_name").alias("name"), "s_acctbal")
    sinks.write_semicolon(named, path, encoding="ISO-8859-1", bom=False)
    return delimited.read_semicolon(spark, path, "s_suppkey long, name string, s_acctbal double", "ISO-8859-1")


@query("reencode_file", "SELECT c_custkey AS id, 'São ' || c_name AS name FROM customer")
def reencode_file(spark, sf):
    named = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("São "), "c_name").alias("name"))
    source = saved_csv(named, sep=";", encoding="ISO-8859-1")
    target, backup = scratch_path(spark, "utf8"), scratch_path(spark, "backup")
    done = sinks.reencode(spark, source, target, "id long, name string", backup=backup)
    return delimited.read_semicolon(spark, done.path, "id long, name string")


# ---- projections, filters, counts ----------------------------------------------------------------------------

@query("source_filter", f"""SELECT * FROM ({RECORDS_SQL}) WHERE "DataSourceName" = '{KEPT}'""")
def source_filter(spark, sf):
    return clean.keep_source(records(spark, sf), KEPT)


@query("drop_columns", f"""SELECT "Dimension Value", "Owner", "NCM" FROM ({RECORDS_SQL})""")
def drop_columns(spark, sf):
    return clean.drop_columns(records(spark, sf))


@query("arrange_columns", PREPARED_SQL)
def arrange_columns(spark, sf):
    # SQL has no empty column name, so the blank column is renamed for the comparison
    return clean.prepare_records(records(spark, sf), KEPT).withColumnRenamed("", "blank")


_REQUIRED = ", ".join(sorted(clean.REQUIRED))


@query("required_columns", f"""
  SELECT 'records' AS "table", count(*) AS rows, true AS ok, '' AS missing, '' AS extra FROM ({RECORDS_SQL})
  UNION ALL SELECT 'customer', count(*), false, '{_REQUIRED}', 'c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey' FROM customer""")
def required_columns(spark, sf):
    checks = [clean.column_report(records(spark, sf), "records"), clean.column_report(table(spark, sf, "customer"), "customer")]
    return checks[0].unionByName(checks[1])


@query("column_list", "SELECT CAST(cid + 1 AS INTEGER) AS index, name FROM pragma_table_info('customer')")
def column_list(spark, sf):
    return tabular.headers(table(spark, sf, "customer")).select(F.col("index").cast("int").alias("index"), "name")


@query("kept_row_counts", f"""
  SELECT count(*) AS rows_before, count(*) FILTER ("DataSourceName" = '{KEPT}') AS rows_after,
         count(*) FILTER ("DataSourceName" <> '{KEPT}') AS rows_removed FROM ({RECORDS_SQL})""")
def kept_row_counts(spark, sf):
    return clean.kept_counts(records(spark, sf), F.col("DataSourceName") == KEPT)


@query("drop_missing_label", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS \"Trademark\" FROM orders WHERE o_orderpriority <> '5-LOW'")
def drop_missing_label(spark, sf):
    labelled = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("Trademark"))
    return clean.drop_missing(labelled, "Trademark")


@query("column_select", "SELECT c_name, c_acctbal FROM customer")
def column_select(spark, sf):
    return tabular.select_columns(table(spark, sf, "customer"), ["c_name", "c_acctbal"])


@query("column_search", "SELECT * FROM customer WHERE regexp_matches(c_name, '0+1[0-9]$')")
def column_search(spark, sf):
    return search.search_column(table(spark, sf, "customer"), "c_name", "0+1[0-9]$")


@query("whole_line_search", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
  WHERE regexp_matches(concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority), '7,F|URGENT')""")
def whole_line_search(spark, sf):
    return search.search_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "7,F|URGENT")


@query("ignore_case_search", f"SELECT file, value FROM ({DOCUMENT_LINES_SQL}) WHERE regexp_matches(value, 'THE[a-z]+', 'i')")
def ignore_case_search(spark, sf):
    return search.search_lines(document_lines(spark, sf), "THE[a-z]+", ignore_case=True)


ORDER_LINE_SQL = """SELECT concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, strftime(o_orderdate, '%Y-%m-%d')) AS value FROM orders"""


@query("date_pattern_search", f"""SELECT value, regexp_extract(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS "match" FROM ({ORDER_LINE_SQL})
  WHERE regexp_matches(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')""")
def date_pattern_search(spark, sf):
    lines = table(spark, sf, "orders").select(F.concat_ws(
        ",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("value"))
    pattern = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
    return search.extract_matches(search.search_lines(lines, pattern), "value", pattern)


@query("select_then_search", """SELECT c_name, c_mktsegment FROM customer
  WHERE regexp_matches(concat_ws(',', c_name, c_mktsegment), 'MACHINERY|99$')""")
def select_then_search(spark, sf):
    return search.search_rows(table(spark, sf, "customer"), "MACHINERY|99$", ["c_name", "c_mktsegment"])


@query("phone_pattern_search", """SELECT name, phone FROM (SELECT c_name AS name,
    substr(right(c_name, 9), 1, 3) || CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE ' ' END || substr(right(c_name, 9), 4, 3)
    || '-' || right(c_name, 4) AS phone FROM customer)
  WHERE regexp_matches(concat_ws(',', name, phone), '[0-9]{3}-[0-9]{3}-[0-9]{4}')""")
def phone_pattern_search(spark, sf):
    digits = F.right("c_name", F.lit(9))
    phone = F.concat(F.substring(digits, 1, 3), F.when(F.col("c_custkey") % 2 == 0, "-").otherwise(" "),
                     F.substring(digits, 4, 3), F.lit("-"), F.right("c_name", F.lit(4)))
    staff = table(spark, sf, "customer").select(F.col("c_name").alias("name"), phone.alias("phone"), "c_acctbal")
    return search.search_rows(staff, "[0-9]{3}-[0-9]{3}-[0-9]{4}", ["name", "phone"])


@query("exclude_owners", f"""
  SELECT r.* FROM ({RECORDS_SQL}) r WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal < 0 AND c.c_name = r."Owner")""")
def exclude_owners(spark, sf):
    return clean.exclude_listed(records(spark, sf), disregard(spark, sf))


@query("exclude_owners_nulls", """
  SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS "Owner" FROM orders
  WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def exclude_owners_nulls(spark, sf):
    # a NULL on the list also removes rows whose owner is NULL
    owners = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("Owner"))
    listed = (table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
              .select("o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("Company")))
    return clean.exclude_listed(owners, listed)


@query("exclusion_counts", f"""
  SELECT (SELECT count(*) FROM ({RECORDS_SQL})) AS rows_before, count(*) AS rows_after,
         (SELECT count(*) FROM ({RECORDS_SQL})) - count(*) AS rows_removed
  FROM ({RECORDS_SQL}) r WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal < 0 AND c.c_name = r."Owner")""")
def exclusion_counts(spark, sf):
    return clean.exclusion_counts(records(spark, sf), disregard(spark, sf))


# ---- aggregates ----------------------------------------------------------------------------------------------

@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark, sf):
    return tabular.row_count(table(spark, sf, "lineitem"))


@query("text_description", """
  WITH sizes AS (SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", (SELECT value FROM sizes ORDER BY n DESC, value LIMIT 1) AS top,
         max(n) AS freq FROM sizes""")
def text_description(spark, sf):
    return clean.describe_text(table(spark, sf, "part"), "p_type")


@query("column_stats", """
  SELECT 'l_quantity' AS field, round(sum(l_quantity), 4) AS sum, min(length(CAST(l_quantity AS VARCHAR))) AS min_length,
         max(length(CAST(l_quantity AS VARCHAR))) AS max_length, round(avg(l_quantity), 6) AS mean,
         round(stddev_pop(l_quantity), 6) AS stddev, CAST(min(l_quantity) AS VARCHAR) AS min, CAST(max(l_quantity) AS VARCHAR) AS max
  FROM lineitem
  UNION ALL
  SELECT 'l_returnflag', NULL, min(length(l_returnflag)), max(length(l_returnflag)), NULL, NULL, min(l_returnflag), max(l_returnflag)
  FROM lineitem""")
def column_stats(spark, sf):
    stats = tabular.column_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_returnflag"])
    return stats.select("field", F.round("sum", 4).alias("sum"), F.col("min_length").cast("long").alias("min_length"),
                        F.col("max_length").cast("long").alias("max_length"), F.round("mean", 6).alias("mean"),
                        F.round("stddev", 6).alias("stddev"), "min", "max")


@query("matching_lines_per_file", f"""
  SELECT file, count(*) AS matching_lines, CAST(sum(len(regexp_extract_all(value, 'tion'))) AS BIGINT) AS occurrences
  FROM ({DOCUMENT_LINES_SQL}) WHERE regexp_matches(value, 'tion') GROUP BY file""")
def matching_lines_per_file(spark, sf):
    return search.count_matches(document_lines(spark, sf), "tion")


@query("files_with_matches", f"SELECT DISTINCT file FROM ({DOCUMENT_LINES_SQL}) WHERE regexp_matches(value, 'shble')")
def files_with_matches(spark, sf):
    return search.files_matching(document_lines(spark, sf), "shble")


@query("filter_and_count", "SELECT count(*) AS matches FROM customer WHERE regexp_matches(c_mktsegment, 'FURN')")
def filter_and_count(spark, sf):
    return search.count_rows_matching(table(spark, sf, "customer"), "FURN", ["c_mktsegment"])


# ---- order, slices, sets -------------------------------------------------------------------------------------

@query("sort_as_text", """
  SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR), o_orderkey) - 1 AS sorted_position FROM orders""")
def sort_as_text(spark, sf):
    return tabular.sort_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("sort_as_number", """
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS sorted_position FROM orders""")
def sort_as_number(spark, sf):
    return tabular.sort_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", numeric=True)


@query("slice_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10")
def slice_rows(spark, sf):
    return tabular.slice_rows(table(spark, sf, "customer"), ["c_custkey"], 10, 5)


@query("preview_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def preview_rows(spark, sf):
    return tabular.preview(table(spark, sf, "customer"), ["c_custkey"])


@query("concat_files", """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def concat_files(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    paths = [saved_csv(a), saved_csv(b)]
    return tabular.concat_rows([delimited.read_delimited(spark, p, "id long, name string") for p in paths])


# ---- confidence reports over a derived probability -----------------------------------------------------------

SCORED_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE (o_orderkey % 101) / 100.0::DOUBLE END AS "Confidence" FROM orders"""


def _scored(spark, sf):
    value = F.when(F.col("o_orderkey") % 50 != 0, (F.col("o_orderkey") % 101) / F.lit(100.0))
    return table(spark, sf, "orders").select("o_orderkey", value.alias("Confidence"))


BUCKET_SQL = """CASE WHEN "Confidence" >= 0.9 THEN 'high' WHEN "Confidence" < 0.9 THEN 'review' ELSE 'unrouted' END"""


@query("confidence_split", f"""SELECT o_orderkey, "Confidence", {BUCKET_SQL} AS bucket FROM ({SCORED_SQL})""")
def confidence_split(spark, sf):
    return report.route(_scored(spark, sf))


@query("confidence_split_counts", f"""SELECT {BUCKET_SQL} AS bucket, count(*) AS rows FROM ({SCORED_SQL}) GROUP BY 1""")
def confidence_split_counts(spark, sf):
    return report.bucket_counts(report.route(_scored(spark, sf)))


@query("routed_sink", f"""SELECT o_orderkey, "Confidence", {BUCKET_SQL} AS bucket FROM ({SCORED_SQL})""")
def routed_sink(spark, sf):
    path = scratch_path(spark, "routed")
    sinks.write_routed(report.route(_scored(spark, sf)), path)
    return spark.read.schema("o_orderkey long, Confidence double, bucket string").parquet(path)


HISTOGRAM_SQL = f"""
  WITH s AS ({SCORED_SQL})
  SELECT r AS "Confidence_Range", (SELECT count(*) FROM s WHERE "Confidence" >= lo AND "Confidence" < hi) AS "Count"
  FROM (VALUES ('0-0.2', -1, 0.2), ('0.2-0.4', 0.2, 0.4), ('0.4-0.6', 0.4, 0.6), ('0.6-0.8', 0.6, 0.8), ('0.8-1.0', 0.8, 2)) t(r, lo, hi)"""


@query("confidence_histogram", HISTOGRAM_SQL)
def confidence_histogram(spark, sf):
    return report.confidence_histogram(_scored(spark, sf))


@query("summary_sink", HISTOGRAM_SQL)
def summary_sink(spark, sf):
    path = scratch_path(spark, "summary")
    sinks.write_summary(report.confidence_histogram(_scored(spark, sf)), path)
    return delimited.read_delimited(spark, path, "Confidence_Range string, Count long")


@query("three_decimal_text", """SELECT o_orderkey, printf('%.3f', (o_orderkey % 101) / 100.0::DOUBLE / 8) AS text FROM orders""")
def three_decimal_text(spark, sf):
    p = (F.col("o_orderkey") % 101) / F.lit(100.0) / F.lit(8)
    return table(spark, sf, "orders").select("o_orderkey", three_decimals(p).alias("text"))


@query("joined_list_text", """SELECT o_orderkey, concat_ws(', ', o_orderstatus, o_orderpriority) AS text FROM orders""")
def joined_list_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", joined(F.array("o_orderstatus", "o_orderpriority")).alias("text"))
