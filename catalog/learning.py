"""Queries over classifiers and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stringloom import batch
from stringloom.learn import candidates, naive_bayes
from stringloom.operators import clean, report
from stringloom.plans.scratch import scratch_path

from .tables import RECORDS_SQL, disregard, records, strings, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def _words_sql(train: str, score: str, p: str = "") -> str:
    """CTEs ending in probs(id, label, prob) for a word model; ``p`` prefixes the names."""
    word = "regexp_extract_all(lower(string), '[\\p{L}\\p{N}_]{2,}')"
    return f"""
  {p}train AS ({train}), {p}score AS ({score}),
  {p}counts AS (SELECT label, term, count(*) AS c FROM (SELECT label, unnest({word}) AS term FROM {p}train) GROUP BY ALL),
  {p}vocab AS (SELECT count(DISTINCT term) AS v FROM {p}counts),
  {p}cls AS (SELECT label, ln(count(*) / (SELECT count(*) FROM {p}train)::DOUBLE) AS prior FROM {p}train GROUP BY label),
  {p}said AS (SELECT label, sum(c) AS n FROM {p}counts GROUP BY label),
  {p}tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({word}) AS term FROM {p}score) WHERE term IN (SELECT term FROM {p}counts) GROUP BY ALL),
  {p}len AS (SELECT id, sum(tf) AS n FROM {p}tf GROUP BY id),
  {p}sums AS (SELECT id, label, sum(tf * ln(c + 1.0)) AS x FROM {p}tf JOIN {p}counts USING (term) GROUP BY ALL),
  {p}logs AS (SELECT s.id, c.label, c.prior - coalesce(l.n, 0) * ln(coalesce(d.n, 0) + v.v) + coalesce(x.x, 0.0) AS s
    FROM {p}score s CROSS JOIN {p}cls c CROSS JOIN {p}vocab v LEFT JOIN {p}said d ON d.label = c.label
    LEFT JOIN {p}len l ON l.id = s.id LEFT JOIN {p}sums x ON x.id = s.id AND x.label = c.label),
  {p}probs AS (SELECT id, label, exp(s - max(s) OVER (PARTITION BY id)) / sum(exp(s - top)) OVER (PARTITION BY id) AS prob
    FROM (SELECT *, max(s) OVER (PARTITION BY id) AS top FROM {p}logs)),
  {p}ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, label) AS place FROM {p}probs),
  {p}report AS (SELECT id, max(CASE WHEN place = 1 THEN label END) AS predicted,
    string_agg(label, ', ' ORDER BY place) AS labels, string_agg(printf('%.3f', prob), ', ' ORDER BY place) AS probs, max(prob) AS confidence
    FROM {p}ranked WHERE place <= 3 GROUP BY id)"""


LANG_SQL = _words_sql("SELECT lang AS label, text AS string FROM documents", "SELECT doc_id AS id, text AS string FROM documents")
TYPE_SQL = _words_sql("SELECT p_type AS label, p_name AS string FROM part", "SELECT p_partkey AS id, p_name AS string FROM part")
BRAND_SQL = _words_sql("SELECT p_brand AS label, p_name AS string FROM part", "SELECT p_partkey AS id, p_name AS string FROM part", "b_")


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("string"), F.col("lang").alias("label"))


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("string"), "p_type", "p_brand")


def _scored_documents(spark, sf):
    rows = _documents(spark, sf)
    return naive_bayes.score_words(naive_bayes.fit_word_model(rows, "label"), rows)


def _scored_parts(spark, sf, label="p_type"):
    rows = _parts(spark, sf)
    return naive_bayes.score_words(naive_bayes.fit_word_model(rows, label), rows)


@query("training_rows", """SELECT doc_id, nullif(lang, 'es') AS "Trademark" FROM documents WHERE lang <> 'es'""")
def training_rows(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("Trademark"))
    return clean.drop_missing(rows, "Trademark")


@query("scoring_rows", f"""SELECT "Owner", "NCM", "Dimension Value" FROM ({RECORDS_SQL}) r WHERE "DataSourceName" = 'BUILDING'
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal < 0 AND c.c_name = r."Owner")""")
def scoring_rows(spark, sf):
    prepared = clean.prepare_records(records(spark, sf), "BUILDING")
    return clean.exclude_listed(prepared, disregard(spark, sf)).select("Owner", "NCM", "Dimension Value")


@query("predict_label", f"WITH {LANG_SQL} SELECT id, predicted FROM report")
def predict_label(spark, sf):
    return report.report_columns(_scored_documents(spark, sf), "lang").select("id", F.col("Predicted_lang").alias("predicted"))


@query("predict_probabilities", f"WITH {TYPE_SQL} SELECT id, label, round(prob, 6) AS prob FROM probs")
def predict_probabilities(spark, sf):
    return _scored_parts(spark, sf).select("id", F.explode("classes").alias("c")).select("id", "c.label", F.round("c.prob", 6).alias("prob"))


@query("top_classes", f"WITH {TYPE_SQL} SELECT id, place, label FROM ranked WHERE place <= 3")
def top_classes(spark, sf):
    top = _scored_parts(spark, sf).select("id", F.posexplode(report.top_classes(F.col("classes"))).alias("at", "c"))
    return top.select("id", (F.col("at") + 1).alias("place"), "c.label")


def _report_sql(base: str) -> str:
    return f"""WITH {base} SELECT id, predicted AS "Predicted_Trademark", labels AS "Top_3_Predictions", probs AS "Top_3_Probabilities",
  round(confidence, 6) AS "Confidence" FROM report"""


def _report(scored):
    return report.report_columns(scored, "Trademark").select(
        "id", "Predicted_Trademark", "Top_3_Predictions", "Top_3_Probabilities", F.round("Confidence", 6).alias("Confidence"))


@query("prediction_report_documents", _report_sql(LANG_SQL))
def prediction_report_documents(spark, sf):
    return _report(_scored_documents(spark, sf))


@query("prediction_report_parts", _report_sql(TYPE_SQL))
def prediction_report_parts(spark, sf):
    return _report(_scored_parts(spark, sf))


@query("row_confidence", f"WITH {TYPE_SQL} SELECT id, round(confidence, 6) AS confidence FROM report")
def row_confidence(spark, sf):
    return report.report_columns(_scored_parts(spark, sf), "t").select("id", F.round("Confidence", 6).alias("confidence"))


@query("confidence_routing", f"""WITH {LANG_SQL} SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence < 0.9 THEN 'review'
  ELSE 'unrouted' END AS bucket, count(*) AS rows FROM report GROUP BY 1""")
def confidence_routing(spark, sf):
    return report.bucket_counts(report.route(report.report_columns(_scored_documents(spark, sf), "lang")))


@query("prediction_histogram", f"""WITH {TYPE_SQL}
  SELECT r AS "Confidence_Range", (SELECT count(*) FROM report WHERE confidence >= lo AND confidence < hi) AS "Count"
  FROM (VALUES ('0-0.2', -1, 0.2), ('0.2-0.4', 0.2, 0.4), ('0.4-0.6', 0.4, 0.6), ('0.6-0.8', 0.6, 0.8), ('0.8-1.0', 0.8, 2)) t(r, lo, hi)""")
def prediction_histogram(spark, sf):
    return report.confidence_histogram(report.report_columns(_scored_parts(spark, sf), "t"))


HELD_SQL = _words_sql("SELECT lang AS label, text AS string FROM documents WHERE doc_id % 5 <> 0",
                      "SELECT doc_id AS id, text AS string FROM documents WHERE doc_id % 5 = 0", "h_")


@query("prediction_accuracy", f"""WITH {HELD_SQL} SELECT round(avg(CASE WHEN predicted = lang THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS rows
  FROM h_report JOIN documents ON doc_id = id""")
def prediction_accuracy(spark, sf):
    # fitted on four fifths of the rows, measured on the others
    rows = _documents(spark, sf)
    model = naive_bayes.fit_word_model(rows.where("id % 5 <> 0"), "label")
    scored = report.report_columns(naive_bayes.score_words(model, rows.where("id % 5 = 0")), "lang")
    return report.accuracy(scored, "Predicted_lang", "label").select(F.round("accuracy", 6).alias("accuracy"), "rows")


@query("multi_target_scoring", f"""WITH {TYPE_SQL}, {BRAND_SQL}
  SELECT id, 'Ingredient' AS target, predicted, round(confidence, 6) AS confidence FROM report
  UNION ALL SELECT id, 'Trademark', predicted, round(confidence, 6) FROM b_report""")
def multi_target_scoring(spark, sf):
    rows = _parts(spark, sf)
    models = {"Ingredient": naive_bayes.fit_word_model(rows, "p_type"), "Trademark": naive_bayes.fit_word_model(rows, "p_brand")}
    scored = batch.score_targets(rows, {t: (lambda r, m=m: naive_bayes.score_words(m, r)) for t, m in models.items()})
    frames = [f.select("id", F.lit(t).alias("target"), F.col(f"Predicted_{t}").alias("predicted"), F.round("Confidence", 6).alias("confidence"))
              for t, f in scored.items()]
    return frames[0].unionByName(frames[1])


NAME_SQL = _words_sql("SELECT p_type AS label, p_brand AS string FROM part", "SELECT p_partkey AS id, p_brand AS string FROM part", "n_")


@query("weighted_ensemble", f"""WITH {TYPE_SQL}, {NAME_SQL}
  SELECT a.id, a.label, round(0.75 * a.prob + 0.25 * b.prob, 6) AS prob FROM probs a JOIN n_probs b ON a.id = b.id AND a.label = b.label""")
def weighted_ensemble(spark, sf):
    rows = _parts(spark, sf)
    by_name = naive_bayes.score_words(naive_bayes.fit_word_model(rows, "p_type"), rows).withColumnRenamed("classes", "by_name")
    model = naive_bayes.fit_word_model(rows, "p_type", "p_brand")
    both = naive_bayes.score_words(model, by_name, text="p_brand")
    mixed = candidates.mixed_classes([F.col("by_name"), F.col("classes")], [3.0, 1.0])
    return both.select("id", F.explode(mixed).alias("c")).select("id", "c.label", F.round("c.prob", 6).alias("prob"))


_KEPT_SQL = f"""SELECT "NCM" AS id, "Dimension Value" AS string FROM ({RECORDS_SQL}) r
  WHERE "DataSourceName" = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal < 0 AND c.c_name = r."Owner")"""
_BATCH = {t: _words_sql(f"SELECT {c} AS label, o_orderpriority AS string FROM orders", _KEPT_SQL, p)
          for t, c, p in (("ingredient", "o_orderstatus", "i_"), ("trademark", "'Q' || quarter(o_orderdate)", "t_"))}


@query("batch_run", f"""WITH {_BATCH['ingredient']}, {_BATCH['trademark']},
  routed AS (SELECT 'ingredient' AS t, CASE WHEN confidence >= 0.9 THEN 'high' ELSE 'review' END AS bucket FROM i_report
             UNION ALL SELECT 'trademark', CASE WHEN confidence >= 0.9 THEN 'high' ELSE 'review' END FROM t_report)
  SELECT b || '_' || t AS output, (SELECT count(*) FROM routed r WHERE r.t = x.t AND r.bucket = b) AS rows
  FROM (VALUES ('ingredient'), ('trademark')) x(t) CROSS JOIN (VALUES ('high'), ('review')) y(b)
  UNION ALL SELECT 'summary_' || t, count(*) FROM routed GROUP BY ALL""")
def batch_run(spark, sf):
    quarter = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", quarter.alias("quarter"))
    models = {t: naive_bayes.fit_word_model(orders, c, "o_orderpriority")
              for t, c in (("Ingredient", "o_orderstatus"), ("Trademark", "quarter"))}
    scorers = {t: (lambda r, m=m: naive_bayes.score_words(m, r, text="Dimension Value")) for t, m in models.items()}
    return batch.run_batch(records(spark, sf), disregard(spark, sf), scorers, "BUILDING", scratch_path(spark, "batch"))


def _trained(spark, sf):
    return candidates.train_candidates(_documents(spark, sf), "label", ["string"])


@query("model_leaderboard")
def model_leaderboard(spark, sf):
    return _trained(spark, sf).leaderboard(spark).select("model", "score", "fit_time", "pred_time")


@query("ensemble_report")
def ensemble_report(spark, sf):
    trained = _trained(spark, sf)
    return report.report_columns(trained.score(_documents(spark, sf)), "lang").select(
        "id", "Predicted_lang", "Top_3_Predictions", "Top_3_Probabilities", F.round("Confidence", 6).alias("Confidence"))


@query("saved_model_report")
def saved_model_report(spark, sf):
    path = scratch_path(spark, "models")
    _trained(spark, sf).save(path)
    loaded = candidates.load_models(spark, path)
    return report.report_columns(loaded.score(_documents(spark, sf), "LogisticRegression"), "lang").select("id", "Predicted_lang", "Confidence")
