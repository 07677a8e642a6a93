"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, html, languages, minhash, neighbours, pieces, pii, rules, simhash, substrings, toxicity, vector_codes
from .runtime import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.with_decoded(pieces.encoded(docs))
    return back.select("doc_id", "n_tokens", "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, at its nearest place."""
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.article_texts(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier documents."""
    return substrings.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return neighbours.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages.languages(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    got = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", *rules.COUNTS, "base_failed", "kept", "anomaly")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending spans of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    return alignment.alignment_digest(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_pii": op4_pii,
    "op5_html_extraction": op5_html_extraction,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_vector_codes": op13_vector_codes,
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
with recursive w as materialized (
  select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as words from documents),
s as materialized (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles from w),
e as materialized (select doc_id, unnest(shingles) as shingle from s),
n as materialized (select doc_id, len(shingles) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as materialized (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 75 * (x.n + y.n - p.c)),
both_ways as materialized (select a, b from links union all select b, a from links),
reach as (
  select a as doc_id, a as root from both_ways
  union
  select l.b, r.root from reach r join both_ways l on l.a = r.doc_id where r.root < l.b),
least as (select doc_id, min(root) as root from reach group by 1)
select n.doc_id, cast(n.n as bigint) as n_shingles, coalesce(least(l.root, n.doc_id), n.doc_id) as component_id,
  coalesce(least(l.root, n.doc_id), n.doc_id) = n.doc_id as kept
from n left join least l using (doc_id)""",
    "op6_substring_dedup": f"""
with w as materialized (select doc_id, {_WORDS.format("coalesce(text, '')")} as words from documents),
p as materialized (
  select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
f as (select h, min(doc_id) as low from p group by h),
c as (select distinct p.doc_id, unnest(range(p.i, p.i + 50)) as i from p join f using (h) where p.doc_id > f.low),
g as (select doc_id, list(i) as gone from c group by 1)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i: not coalesce(list_contains(gone, i), false)), ' '), '')) as kept_sha256
from w left join g using (doc_id)""",
}


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Full search of every codebook, round by round."""
    steps = [f"""
kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] as part from kept, range({parts}) r(p)),
c0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as k, part as entry from parts
  where vec_id in (select vec_id from kept order by vec_id limit {entries}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select vec_id, p, any_value(part) as part,
    min({entries} * list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i]))) + k) as best
  from parts join c{i} using (p) group by vec_id, p)""")
        if i < rounds:
            steps.append(f"""
m{i} as (select p, k, i, cast(floor(sum(x) / count(*)) as bigint) as x from (
  select p, best % {entries} as k, unnest(range(1, len(part) + 1)) as i, unnest(part) as x from a{i}) group by p, k, i),
c{i + 1} as materialized (
  select c{i}.p, c{i}.k, coalesce(any_value(n.entry), any_value(c{i}.entry)) as entry
  from c{i} left join (select p, k, list(x order by i) as entry from m{i} group by p, k) n on n.p = c{i}.p and n.k = c{i}.k group by 1, 2)""")
    return f"""
with {",".join(steps)},
coded as (
  select vec_id, string_agg(printf('%02x', cast(best % {entries} as integer)), '' order by p) as code, cast(sum(best // {entries}) as bigint) as error
  from a{rounds} group by vec_id),
digest as (select sha256(string_agg(cast(x as varchar), ',' order by p, k, i)) as h from (
  select p, k, unnest(range(1, len(entry) + 1)) as i, unnest(entry) as x from c{rounds}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from coded join kept using (vec_id), digest"""


SQL["op13_vector_codes"] = _codes_sql()
