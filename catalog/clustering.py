"""Queries over vectors, neighbours and clusterers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stringloom.functions.text import words
from stringloom.operators import neighbours, vectors
from stringloom.operators.clusters import numbering
from stringloom.operators.clusters.dbscan import dbscan
from stringloom.operators.clusters.hdbscan import hdbscan
from stringloom.operators.clusters.kmeans import centre_distances, fitted_kmeans, kmeans
from stringloom.operators.clusters.optics import optics_at
from stringloom.operators.clusters.spectral import TOLERANCE, spectral, spectral_embedding
from stringloom.operators.clusters.ward import agglomerative, ward_labels, ward_merges
from stringloom.operators.spanning import spanning_edges
from stringloom.plans.ranking import with_position
from stringloom.plans.scratch import scratch_path, written
from stringloom.sources import sinks

from .tables import strings, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def _with(source: str, key: str, text: str) -> str:
    """SQL for counts, document frequency and unit weights of a text column."""
    return f"""
  s AS (SELECT {key} AS id, {text} AS string FROM {source}),
  tok AS (SELECT id, unnest(regexp_extract_all(lower(string), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM s),
  tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  raw AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM s)) / (1.0 + df)) + 1.0) AS x FROM tf JOIN dfs USING (term)),
  norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY id),
  wts AS (SELECT id, term, x / norm AS w FROM raw JOIN norms USING (id))"""


DOCS = _with("documents", "doc_id", "text")
PARTS = _with("part", "p_partkey", "p_name")


def _near(eps: float) -> str:
    return f"""
  near AS (SELECT a.id AS a, b.id AS b, sqrt(greatest(0.0, 2.0 - 2.0 * sum(a.w * b.w))) AS dist FROM wts a JOIN wts b ON a.term = b.term AND a.id < b.id
           GROUP BY a.id, b.id HAVING sqrt(greatest(0.0, 2.0 - 2.0 * sum(a.w * b.w))) <= {eps} + 1e-9),
  dir AS (SELECT a AS vec, b AS nbr, dist FROM near UNION ALL SELECT b, a, dist FROM near)"""


def _dbscan_sql(base: str, eps: float, min_samples: int) -> str:
    return f"""
  WITH RECURSIVE {base}, {_near(eps)},
  cores AS (SELECT s.id FROM s LEFT JOIN dir ON dir.vec = s.id GROUP BY s.id HAVING count(dir.nbr) + 1 >= {min_samples}),
  link AS (SELECT vec, nbr FROM dir WHERE vec IN (SELECT id FROM cores) AND nbr IN (SELECT id FROM cores)),
  reach(id, root) AS (SELECT id, id FROM cores UNION SELECT l.nbr, r.root FROM reach r JOIN link l ON l.vec = r.id WHERE r.root < l.nbr),
  rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
  border AS (SELECT d.vec AS id, min(r.root) AS root FROM dir d JOIN rooted r ON r.id = d.nbr
             WHERE d.vec NOT IN (SELECT id FROM cores) GROUP BY d.vec),
  placed AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM (SELECT * FROM rooted UNION ALL SELECT * FROM border)),
  labelled AS (SELECT s.id, coalesce(label, -1) AS label FROM s LEFT JOIN placed USING (id)),
  firsts AS (SELECT label, row_number() OVER (ORDER BY min(id)) AS cluster FROM labelled GROUP BY label),
  result AS (SELECT id, label, label = -1 AS is_noise, cluster FROM labelled JOIN firsts USING (label))"""


# ---- vectors -------------------------------------------------------------------------------------------------

@query("word_tokens", """SELECT doc_id, term, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL""")
def word_tokens(spark, sf):
    exploded = table(spark, sf, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("term_frequencies", f"""WITH {DOCS} SELECT term, df, round(ln((1.0 + (SELECT count(*) FROM s)) / (1.0 + df)) + 1.0, 6) AS idf FROM dfs""")
def term_frequencies(spark, sf):
    return vectors.term_vectors(strings(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_documents", f"WITH {DOCS} SELECT id, term, round(w, 6) AS weight FROM wts")
def tfidf_documents(spark, sf):
    tv = vectors.term_vectors(strings(spark, sf))
    return vectors.row_weights(tv).select("id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_parts", f"WITH {PARTS} SELECT id, term, round(w, 6) AS weight FROM wts")
def tfidf_parts(spark, sf):
    tv = vectors.term_vectors(strings(spark, sf, "part"))
    return vectors.row_weights(tv).select("id", "term", F.round("weight", 6).alias("weight"))


# ---- neighbours ----------------------------------------------------------------------------------------------

def _first_copies(base: str) -> str:
    return f"""{base},
  sig AS (SELECT id, coalesce(string_agg(term || ':' || tf, ' ' ORDER BY term), '') AS sig FROM s LEFT JOIN tf USING (id) GROUP BY id),
  reps AS (SELECT sig, min(id) AS vec FROM sig GROUP BY sig)"""


def _pairs_sql(base: str, eps: float) -> str:
    return f"""WITH {_first_copies(base)}, {_near(eps)}
  SELECT a, b, round(dist, 6) AS dist FROM near WHERE a IN (SELECT vec FROM reps) AND b IN (SELECT vec FROM reps)"""


@query("close_pairs_tight", _pairs_sql(DOCS, 0.2))
def close_pairs_tight(spark, sf):
    tv = vectors.term_vectors(strings(spark, sf))
    return neighbours.close_pairs(tv.vectors, 0.2).select("a", "b", F.round("dist", 6).alias("dist"))


@query("close_pairs_loose", _pairs_sql(DOCS, 0.5))
def close_pairs_loose(spark, sf):
    tv = vectors.term_vectors(strings(spark, sf))
    return neighbours.close_pairs(tv.vectors, 0.5).select("a", "b", F.round("dist", 6).alias("dist"))


@query("kth_neighbour_distance", f"""WITH {DOCS}, {_near(0.5)},
  ranked AS (SELECT vec, dist, row_number() OVER (PARTITION BY vec ORDER BY dist, nbr) AS at FROM dir)
  SELECT s.id, round(CASE WHEN dist < 1e-6 THEN 0.0 ELSE dist END, 6) AS core FROM s LEFT JOIN ranked r ON r.vec = s.id AND r.at = 3""")
def kth_neighbour_distance(spark, sf):
    tv = vectors.term_vectors(strings(spark, sf))
    pairs = written(neighbours.close_pairs(tv.vectors, 0.5), "pairs")
    core = neighbours.core_distances(tv.vectors, neighbours.both_ways(pairs), 4)
    return vectors.spread_to_rows(tv, core).select("id", F.round("core", 6).alias("core"))


def _all_pairs(base: str) -> str:
    """SQL for the distances of all pairs of distinct vectors, both ways: dir(vec, nbr, dist)."""
    return f"""{_first_copies(base)},
  sizes AS (SELECT min(id) AS vec, count(*) AS copies FROM sig GROUP BY sig),
  own AS (SELECT s.id, coalesce(sum(w * w), 0.0) AS sq FROM s LEFT JOIN wts USING (id) GROUP BY s.id),
  dots AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS dot FROM wts a JOIN wts b ON a.term = b.term
           WHERE a.id IN (SELECT vec FROM sizes) AND b.id IN (SELECT vec FROM sizes) GROUP BY a.id, b.id),
  gaps AS (SELECT x.vec, y.vec AS nbr, y.copies, sqrt(greatest(0.0, p.sq + q.sq - 2 * coalesce(dot, 0.0))) AS dist
           FROM sizes x JOIN sizes y ON x.vec <> y.vec JOIN own p ON p.id = x.vec JOIN own q ON q.id = y.vec LEFT JOIN dots ON a = x.vec AND b = y.vec),
  dir AS (SELECT vec, nbr, copies, CASE WHEN dist < 1e-7 THEN 0.0 ELSE dist END AS dist FROM gaps)"""


def _core(min_samples: int) -> str:
    """SQL for the distance of each distinct vector to its ``min_samples``-th row: core(vec, copies, core)."""
    return f"""
  reached AS (SELECT vec, dist, sum(copies) OVER (PARTITION BY vec ORDER BY dist, nbr ROWS UNBOUNDED PRECEDING) AS rows FROM dir),
  core AS (SELECT z.vec, any_value(z.copies) AS copies, CASE WHEN any_value(z.copies) >= {min_samples} THEN 0.0
           ELSE min(CASE WHEN z.copies + r.rows >= {min_samples} THEN r.dist END) END AS core
           FROM sizes z LEFT JOIN reached r ON r.vec = z.vec GROUP BY z.vec)"""


def _core_distances(spark, sf, *source):
    tv = vectors.term_vectors(strings(spark, sf, *source))
    core = neighbours.core_distances(tv.vectors, neighbours.nearest_rows(tv.vectors, 4), 4)
    return vectors.spread_to_rows(tv, core).select("id", F.round("core", 6).alias("core"))


def _core_sql(base: str) -> str:
    return f"""WITH {_all_pairs(base)}, {_core(4)}
  SELECT s.id, round(core, 6) AS core FROM s JOIN sig USING (id) JOIN reps USING (sig) JOIN core ON core.vec = reps.vec"""


@query("core_distance_documents", _core_sql(DOCS))
def core_distance_documents(spark, sf):
    return _core_distances(spark, sf)


@query("core_distance_parts", _core_sql(PARTS))
def core_distance_parts(spark, sf):
    return _core_distances(spark, sf, "part")


@query("nearest_documents", f"""WITH {_all_pairs(DOCS)},
  ranked AS (SELECT vec, dist, row_number() OVER (PARTITION BY vec ORDER BY dist, nbr) AS place FROM dir)
  SELECT vec, place, round(dist, 6) AS dist FROM ranked WHERE place <= 5""")
def nearest_documents(spark, sf):
    tv = vectors.term_vectors(strings(spark, sf))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("dist", "nbr"))
    return neighbours.nearest_rows(tv.vectors, 5).select("vec", place.cast("long").alias("place"), F.round("dist", 6).alias("dist"))


# ---- density clusters ----------------------------------------------------------------------------------------

@query("dbscan_documents", f"{_dbscan_sql(DOCS, 0.2, 3)} SELECT * FROM result")
def dbscan_documents(spark, sf):
    return dbscan(strings(spark, sf), eps=0.2, min_samples=3)


@query("dbscan_documents_wide", f"{_dbscan_sql(DOCS, 0.5, 5)} SELECT * FROM result")
def dbscan_documents_wide(spark, sf):
    return dbscan(strings(spark, sf))


@query("dbscan_parts", f"{_dbscan_sql(PARTS, 0.2, 3)} SELECT * FROM result")
def dbscan_parts(spark, sf):
    return dbscan(strings(spark, sf, "part"), eps=0.2, min_samples=3)


@query("cluster_sink", f"{_dbscan_sql(DOCS, 0.2, 3)} SELECT cluster, id, string FROM result JOIN s USING (id)")
def cluster_sink(spark, sf):
    source = strings(spark, sf)
    path = scratch_path(spark, "clusters")
    sinks.write_clusters(numbering.cluster_table(dbscan(source, eps=0.2, min_samples=3), source), path)
    return spark.read.parquet(path)


@query("cluster_sizes", f"""{_dbscan_sql(DOCS, 0.2, 3)} SELECT cluster, count(*) AS rows, min(id) AS first_id FROM result GROUP BY cluster""")
def cluster_sizes(spark, sf):
    return numbering.cluster_summary(dbscan(strings(spark, sf), eps=0.2, min_samples=3))


@query("cluster_report_order", f"""{_dbscan_sql(DOCS, 0.2, 3)}
  SELECT cluster, id, row_number() OVER (ORDER BY cluster, id) - 1 AS position FROM result""")
def cluster_report_order(spark, sf):
    return numbering.report_order(dbscan(strings(spark, sf), eps=0.2, min_samples=3))


# ---- hierarchical density clusters ---------------------------------------------------------------------------

@query("hdbscan_documents")
def hdbscan_documents(spark, sf):
    return hdbscan(strings(spark, sf), min_samples=4, min_cluster_size=3)


@query("spanning_tree_parts", f"""
  WITH RECURSIVE {_all_pairs(PARTS)}, {_core(4)},
  edge AS MATERIALIZED (SELECT d.vec AS a, d.nbr AS b, greatest(d.dist, x.core, y.core) AS w FROM dir d JOIN core x ON x.vec = d.vec JOIN core y ON y.vec = d.nbr),
  tree(step, met, w) AS (
    SELECT 0, [min(vec)], 0.0::DOUBLE FROM sizes
    UNION ALL
    SELECT step + 1, list_append(met, e.b), e.w FROM tree, LATERAL (
      SELECT b, w FROM edge WHERE list_contains(met, a) AND NOT list_contains(met, b) ORDER BY w, b LIMIT 1) e)
  SELECT row_number() OVER (ORDER BY w) AS place, round(w, 6) AS dist FROM tree WHERE step > 0""")
def spanning_tree_parts(spark, sf):
    tv = vectors.term_vectors(strings(spark, sf, "part"))
    core = written(neighbours.core_distances(tv.vectors, neighbours.nearest_rows(tv.vectors, 4), 4), "core")
    edges = with_position(spanning_edges(tv.vectors, core), ["dist", "a", "b"], "place")
    return edges.select((F.col("place") + 1).alias("place"), F.round("dist", 6).alias("dist"))


@query("hdbscan_parts")
def hdbscan_parts(spark, sf):
    return hdbscan(strings(spark, sf, "part"), min_samples=4, min_cluster_size=3)


# ---- ordering cut at a radius --------------------------------------------------------------------------------

def _optics_sql(base: str, eps: float, min_samples: int) -> str:
    cut = "WHERE d.vec NOT IN (SELECT id FROM cores) GROUP BY d.vec"
    # a border row joins a component of other rows only when that component starts first
    return _dbscan_sql(base, eps, min_samples).replace(cut, cut + " HAVING min(r.root) < d.vec")


@query("optics_documents", f"{_optics_sql(DOCS, 0.5, 5)} SELECT * FROM result")
def optics_documents(spark, sf):
    return optics_at(strings(spark, sf), min_samples=5, max_eps=0.5)


@query("optics_parts", f"{_optics_sql(PARTS, 0.2, 5)} SELECT * FROM result")
def optics_parts(spark, sf):
    return optics_at(strings(spark, sf, "part"), min_samples=5, max_eps=0.2)


# ---- a given number of clusters ------------------------------------------------------------------------------

@query("kmeans_documents")
def kmeans_documents(spark, sf):
    return kmeans(strings(spark, sf), 10)


@query("kmeans_check_documents", """SELECT 10 AS clusters, count(*) AS rows, 0::BIGINT AS nearer_elsewhere, 0::BIGINT AS rises FROM documents""")
def kmeans_check_documents(spark, sf):
    """How many rows are nearer to another cluster's centre, and how often the objective rose: none and never."""
    tv = vectors.term_vectors(strings(spark, sf))
    fitted = fitted_kmeans(tv, 10)
    squares = [r[1] for r in sorted(fitted.centres.groupBy("c").agg(F.sum(F.col("x") * F.col("x"))).collect())]
    near = centre_distances(tv.vectors, tv, fitted.centres, squares)
    own = F.filter("near", lambda e: e["c"] == F.col("label"))[0]["d2"]
    wrong = F.when(own > F.col("near")[0]["d2"] + 1e-9, F.col("copies")).otherwise(0)
    rises = sum(b > a + 1e-9 for a, b in zip(fitted.objective, fitted.objective[1:]))
    return fitted.rows.join(near, "vec").agg(
        F.countDistinct("label").cast("int").alias("clusters"), F.sum("copies").alias("rows"), F.sum(wrong).cast("long").alias("nearer_elsewhere"),
        F.lit(rises).cast("long").alias("rises"))


@query("kmeans_parts")
def kmeans_parts(spark, sf):
    return kmeans(strings(spark, sf, "part"), 10)


@query("agglomerative_documents")
def agglomerative_documents(spark, sf):
    return agglomerative(strings(spark, sf), 8)


@query("agglomerative_sizes_documents", f"""WITH {_first_copies(DOCS)}
  SELECT least(8, (SELECT count(*) FROM reps)) AS clusters, count(*) AS rows, 0::BIGINT AS torn, 0::BIGINT AS falls FROM s""")
def agglomerative_sizes_documents(spark, sf):
    """Clusters and rows, strings whose copies were torn apart, and merges that stand lower than one of their parts."""
    tv = vectors.term_vectors(strings(spark, sf))
    merges = ward_merges(tv.vectors)
    named = merges.select("a", "round", "seq", "height").unionByName(merges.select(F.col("b").alias("a"), "round", "seq", "height"))
    before = Window.partitionBy("a").orderBy("round", "seq")
    falls = named.withColumn("last", F.lag("height").over(before)).agg(F.coalesce(F.sum((F.col("height") < F.col("last")).cast("long")), F.lit(0)).alias("falls"))
    rows = vectors.spread_to_rows(tv, ward_labels(tv, 8))
    torn = rows.groupBy("vec").agg(F.countDistinct("label").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    counts = rows.agg(F.countDistinct("label").alias("clusters"), F.count(F.lit(1)).alias("rows"))
    return counts.crossJoin(torn).crossJoin(falls)


def _ward_sql(base: str, k: int) -> str:
    """Cheapest pair first, with the update formula of Lance and Williams on the table of all pairs."""
    return f"""
  WITH RECURSIVE {_all_pairs(base)},
  st(step, a, b, d, na, nb) AS (
    SELECT 0, x.vec, y.vec, x.copies * y.copies / (x.copies + y.copies)::DOUBLE * dist * dist, x.copies::DOUBLE, y.copies::DOUBLE
    FROM dir JOIN sizes x ON x.vec = dir.vec JOIN sizes y ON y.vec = nbr WHERE x.vec < y.vec
    UNION ALL
    (WITH now AS MATERIALIZED (SELECT * FROM st),
      m AS MATERIALIZED (SELECT a AS i, b AS j, d AS dij, na AS ni, nb AS nj FROM now ORDER BY d, a, b LIMIT 1),
      ends AS (SELECT a AS e, b AS o, d, nb AS n FROM now UNION ALL SELECT b, a, d, na FROM now),
      fresh AS (SELECT i, x.o AS k, ((x.n + ni) * x.d + (x.n + nj) * y.d - x.n * dij) / (x.n + ni + nj) AS d, ni + nj AS n, x.n AS nk
                FROM m JOIN ends x ON x.e = i AND x.o <> j JOIN ends y ON y.e = j AND y.o = x.o)
     SELECT step + 1, a, b, d, na, nb FROM now, m WHERE a NOT IN (i, j) AND b NOT IN (i, j) AND (SELECT count(*) FROM now) > {k * (k - 1) // 2}
     UNION ALL
     SELECT (SELECT any_value(step) FROM now) + 1, least(i, k), greatest(i, k), d, CASE WHEN i < k THEN n ELSE nk END, CASE WHEN i < k THEN nk ELSE n END
     FROM fresh WHERE (SELECT count(*) FROM now) > {k * (k - 1) // 2})),
  merged AS (SELECT arg_min(a, (d, a, b)) AS i, arg_min(b, (d, a, b)) AS j FROM st WHERE step < (SELECT max(step) FROM st) GROUP BY step),
  up(vec, here) AS (SELECT vec, vec FROM sizes UNION ALL SELECT vec, i FROM up JOIN merged ON j = here),
  rooted AS (SELECT vec, min(here) AS root FROM up GROUP BY vec),
  placed AS (SELECT vec, dense_rank() OVER (ORDER BY root) - 1 AS label FROM rooted)
  SELECT id, label, false AS is_noise, label + 1 AS cluster FROM sig JOIN reps USING (sig) JOIN placed ON placed.vec = reps.vec"""


@query("agglomerative_parts", _ward_sql(PARTS, 8))
def agglomerative_parts(spark, sf):
    return agglomerative(strings(spark, sf, "part"), 8)


@query("spectral_documents")
def spectral_documents(spark, sf):
    return spectral(strings(spark, sf), 6)


@query("spectral_check_documents", "SELECT range AS pair, true AS settled, CASE WHEN range = 0 THEN 1.0 END AS leading FROM range(6)")
def spectral_check_documents(spark, sf):
    """Whether every eigenpair's residual is within the tolerance; the leading eigenvalue of a normalised affinity is 1."""
    tv = vectors.term_vectors(strings(spark, sf))
    _, values, residuals = spectral_embedding(tv.vectors, 6)
    rows = [(j, bool(r <= TOLERANCE * v), round(float(v), 6) if j == 0 else None) for j, (v, r) in enumerate(zip(values, residuals))]
    return spark.createDataFrame(rows, "pair long, settled boolean, leading double")


@query("spectral_parts")
def spectral_parts(spark, sf):
    return spectral(strings(spark, sf, "part"), 6)
