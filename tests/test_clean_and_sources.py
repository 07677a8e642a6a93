import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.functions.text import NA_TOKENS, blank_to_null, three_decimals
from stringloom.operators import clean, report, search, tabular
from stringloom.plans.scratch import scratch_path
from stringloom.sources import delimited, sinks, textfiles, workbook
from catalog.tables import _book

ID_STRING = T.StructType([T.StructField("id", T.StringType()), T.StructField("string", T.StringType())])


def saved(spark, lines, name="in.csv", encoding="utf-8"):
    path = scratch_path(spark, "fixture")
    import os
    os.makedirs(path)
    with open(f"{path}/{name}", "w", encoding=encoding, newline="") as out:
        out.write("\n".join(lines) + "\n")
    return path


def test_short_and_long_lines(spark):
    path = saved(spark, ["id,string", "1,aa", "2", "3,cc,dd", "4,ee", '5,"a,b"', '6,"say ""hi"""', "7,NA"])
    rows, rejected = delimited.split_tolerant(spark, path, ID_STRING)
    got = {r["id"]: r["string"] for r in rows.collect()}
    assert got == {"1": "aa", "2": None, "4": "ee", "5": "a,b", "6": 'say "hi"', "7": None}
    assert rows.count() == 6 and rows.select("string").count() == 6
    assert [r["value"] for r in rejected.collect()] == ["3,cc,dd"]


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(delimited.NoInputFiles):
        delimited.read_delimited(spark, f"{tmp_path}/*.csv", "id long")


def test_exclusion_with_nulls(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "Owner string")
    def kept(names):
        listed = spark.createDataFrame([("x", n) for n in names], "Code string, Company string")
        return {r["Owner"] for r in clean.exclude_listed(rows, listed).collect()}
    assert kept(["a"]) == {"b", None}
    assert kept(["a", None]) == {"b"}


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "Owner int")
    check = clean.check_columns(df)
    assert not check.ok and "NCM" in check.missing and check.extra == set()
    with pytest.raises(clean.MissingColumns):
        clean.require_columns(df)


def test_bom_starts_every_part_file(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("Owner"), F.lit("x").alias("NCM"), F.lit("").alias(""), F.lit("d").alias("Dimension Value"))
    path = scratch_path(spark, "bom")
    sinks.write_semicolon(df.repartition(3), path)
    import glob
    parts = glob.glob(path + "/*.csv")
    assert len(parts) == 3
    for part in parts:
        with open(part, "rb") as stream:
            head = stream.readline()
        assert head == b"\xef\xbb\xbfOwner;NCM;;Dimension Value\n"


def test_reencoding_keeps_letters(spark):
    path = saved(spark, ["id;name", "1;São", "2;Açaí"], encoding="iso-8859-1")
    done = sinks.reencode(spark, path, scratch_path(spark, "out"), "id long, name string")
    assert (done.rows, done.columns) == (2, 2)
    assert {r["name"] for r in delimited.read_semicolon(spark, done.path, "id long, name string").collect()} == {"São", "Açaí"}
    with pytest.raises(ValueError):
        sinks.reencode(spark, path, path, "id long, name string")


def test_missing_value_texts(spark):
    rows = spark.createDataFrame([(t,) for t in NA_TOKENS] + [("na",), ("none",)], "Trademark string")
    kept = clean.drop_missing(blank_to_null(rows), "Trademark")
    assert {r["Trademark"] for r in kept.collect()} == {"na", "none"}


def test_three_decimals_match_python(spark):
    values = [i / 8192 for i in range(0, 8193)] + [0.0005, 0.1235, 0.0625, 0.9995]
    df = spark.createDataFrame([(v,) for v in values], "p double").select("p", three_decimals(F.col("p")).alias("t"))
    assert all(r["t"] == f"{r['p']:.3f}" for r in df.collect())


def test_bucket_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.2, 0.4, 0.6, 0.8, 0.9, None)], "Confidence double")
    assert [r["Count"] for r in report.confidence_histogram(df).collect()] == [0, 1, 1, 1, 2]
    counts = {r["bucket"]: r["rows"] for r in report.bucket_counts(report.route(df)).collect()}
    assert counts == {"high": 1, "review": 4, "unrouted": 1}
    empty = report.confidence_histogram(df.where("Confidence > 2"))
    assert [r["Count"] for r in empty.collect()] == [0] * 5


def test_top_classes_with_ties_and_few_classes(spark):
    schema = "id int, classes array<struct<label:string,prob:double>>"
    df = spark.createDataFrame([(1, [("a", 0.25), ("b", 0.5), ("c", 0.25), ("d", 0.0)]), (2, [("x", 0.3), ("y", 0.7)])], schema)
    got = {r["id"]: (r["Top_3_Predictions"], r["Top_3_Probabilities"], r["Predicted_t"]) for r in report.report_columns(df, "t").collect()}
    assert got[1] == ("b, a, c", "0.500, 0.250, 0.250", "b")
    assert got[2] == ("y, x", "0.700, 0.300", "y")


def test_workbooks_from_files(spark):
    import os
    import pandas as pd
    path = scratch_path(spark, "xlsx")
    os.makedirs(path)
    sheet = pd.DataFrame({"Owner": ["a", "b & c"], "NCM": ["001", "NA"]})
    with open(f"{path}/one.xlsx", "wb") as out:
        out.write(_book({"TRADEMARK": sheet, "OTHER": sheet.head(1)}))
    rows = workbook.read_workbooks(spark, f"{path}/*.xlsx")
    picked = workbook.pick_sheet(rows, "TRADEMARK", ["Owner", "NCM"]).orderBy("row_no")
    assert [(r["Owner"], r["NCM"]) for r in picked.collect()] == [("a", "001"), ("b & c", None)]
    with pytest.raises(workbook.MissingWorksheet, match="OTHER"):
        workbook.require_sheet(rows, "ABSENT")


def test_newest_file_wins(spark):
    import os
    path = saved(spark, ["id", "1"], "a.csv")
    with open(f"{path}/b.csv", "w") as out:
        out.write("id\n2\n")
    os.utime(f"{path}/a.csv", (2_000_000_000, 2_000_000_000))
    assert delimited.newest_file(spark, f"{path}/*.csv").endswith("/a.csv")


def test_text_tree_filters(spark):
    import os
    path = saved(spark, ["needle one", "hay"], "a.txt")
    os.makedirs(f"{path}/deep")
    for name in ("b.log", "c.html"):
        with open(f"{path}/deep/{name}", "w") as out:
            out.write("Needle needle\n")
    def names(**kw):
        return sorted(r["file_name"] for r in search.search_lines(textfiles.read_lines(spark, path, **kw), "needle").collect())
    assert names() == ["a.txt", "b.log", "c.html"]
    assert names(exclude="*.log") == ["a.txt", "c.html"]
    assert names(file_glob="*.html") == ["c.html"]
    lines = textfiles.read_lines(spark, path)
    assert {r["occurrences"] for r in search.count_matches(lines, "needle", ignore_case=True).collect()} == {1, 2}


def test_headers_and_stats(spark):
    df = spark.createDataFrame([(1, "a"), (3, "bb")], "n int, s string")
    assert [(r["index"], r["name"]) for r in tabular.headers(df).collect()] == [(1, "n"), (2, "s")]
    stats = {r["field"]: r for r in tabular.column_stats(df, ["n", "s"]).collect()}
    assert stats["n"]["mean"] == 2.0 and stats["n"]["stddev"] == 1.0 and stats["s"]["max_length"] == 2 and stats["s"]["sum"] is None


def test_row_counter_fills_with_the_action(spark):
    rows, counter = clean.observed(spark.range(7).toDF("x"), "seen")
    rows.collect()
    assert counter.get["rows"] == 7


def test_columns_are_bound_by_name_in_every_file(spark):
    one, two = saved(spark, ["string,id", "hello,1"]), saved(spark, ["\ufeffid,more,string", "2,x,bye"])
    got = {(r["id"], r["string"]) for r in delimited.read_delimited(spark, [one, two], "id long, string string").collect()}
    assert got == {(1, "hello"), (2, "bye")}
    with pytest.raises(clean.MissingColumns):
        delimited.read_delimited(spark, one, "id long, other string")


def test_tolerant_reader_takes_each_files_own_header(spark):
    one = saved(spark, ['"id","string"', "1,aa", "id,string", '"id","string"', "2,b,c"])
    two = saved(spark, ["string,more,id", "x,y,3", "z", "p,q,4,r"])
    rows, rejected = delimited.split_tolerant(spark, [one, two], ID_STRING)
    got = sorted((str(r["id"]), r["string"]) for r in rows.collect())
    assert got == sorted([("1", "aa"), ("id", "string"), ("id", "string"), ("3", "x"), ("None", "z")])
    assert sorted((r["value"], r["fields"]) for r in rejected.collect()) == [("2,b,c", 3), ("p,q,4,r", 4)]


def test_lines_with_control_characters_stay_whole(spark):
    path = saved(spark, ["id,string", "1,a\x01b\x01c", "2,d", "3,\x01,x"])
    rows, rejected = delimited.split_tolerant(spark, path, ID_STRING)
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "a\x01b\x01c"), ("2", "d")]
    assert [(r["value"], r["fields"]) for r in rejected.collect()] == [("3,\x01,x", 3)]


def test_headers_of_many_files_are_read_by_tasks(spark):
    import gzip
    import os
    path = scratch_path(spark, "many [1]")
    os.makedirs(path)
    for i in range(3_000):
        with open(f"{path}/{i}.csv", "w") as out:
            out.write("" if i % 100 == 0 else f"id,string\r\n{i},a\r\n" if i % 2 else f"string,id\nb,{i}\n")
    with gzip.open(f"{path}/z.csv.gz", "wt") as out:
        out.write("id,string\n-1,z\n")
    rows = delimited.read_delimited(spark, path.replace("[", "\\[").replace("]", "\\]"), "id long, string string")
    got = dict(tuple(r) for r in rows.collect())
    assert got == {**{i: "a" if i % 2 else "b" for i in range(3_000) if i % 100}, -1: "z"}


def test_exclusion_counts_follow_the_exclusion(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "Owner string")
    listed = spark.createDataFrame([("x", "a"), ("y", None)], "Code string, Company string")
    assert tuple(clean.exclusion_counts(rows, listed).first()) == (3, 1, 2)


def test_batch_lists_empty_outputs(spark):
    from stringloom import batch
    records = spark.createDataFrame([("S", "dv", f"o{i}", str(i), 2020, 1) for i in range(4)], "DataSourceName string, `Dimension Value` string, Owner string, NCM string, Year int, Month int")
    sure = lambda r: r.withColumn("classes", F.array(F.struct(F.lit("k").alias("label"), F.lit(0.95).alias("prob"))))
    got = batch.run_batch(records, records.select("NCM", F.lit("z").alias("Company")), {"Ingredient": sure, "Trademark": sure}, "S", scratch_path(spark, "batch"))
    assert {r["output"]: r["rows"] for r in got.collect()} == {
        f"{b}_{t}": n for t in ("ingredient", "trademark") for b, n in (("high", 4), ("review", 0), ("summary", 4))}
