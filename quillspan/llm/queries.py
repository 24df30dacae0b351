"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import grouping, leaks, mixture, near_copies, neighbours, reading, splitting


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark, sf):
    return grouping.similarity_clusters(_t(spark, sf, "chunk_embeddings"), _t(spark, sf, "embedding_spaces"), _t(spark, sf, "stock_passages"))


def p1_profiles(spark, sf):
    return grouping.cluster_profiles(p1_found(spark, sf), _t(spark, sf, "chunk_embeddings"), _t(spark, sf, "embedding_spaces"))


def p1_kmeans(spark, sf):
    return grouping.kmeans_groups(_t(spark, sf, "chunk_embeddings"), _t(spark, sf, "embedding_spaces"))


def p3_found(spark, sf):
    near = neighbours.vector_neighbours(_t(spark, sf, "chunk_embeddings"), _t(spark, sf, "embedding_spaces"), _t(spark, sf, "stock_passages"), min_similarity=0.85)
    return near.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).distinct()


def p3_neighbours(spark, sf):
    near = neighbours.vector_neighbours(_t(spark, sf, "chunk_embeddings"), _t(spark, sf, "embedding_spaces"), queries=lambda c: c % 20 == 0, probes=16, search_beam=48)
    return near.withColumn("cosine", F.round("cosine", 6))


def p2_found(spark, sf):
    return splitting.split_oversized(_t(spark, sf, "chunks"))


def p2_cohesion(spark, sf):
    return splitting.split_oversized(_t(spark, sf, "chunks"), method="cohesion")


def p4_found(spark, sf):
    return near_copies.near_copies(_t(spark, sf, "chunks"), _t(spark, sf, "stock_passages"), shingle_words=3, similarity=0.5)


def p4_groups(spark, sf):
    return near_copies.near_copy_groups(_t(spark, sf, "chunks"))


def p6_found(spark, sf):
    return leaks.leaked_documents(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p6_spans(spark, sf):
    return leaks.leaked_spans(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def p7_found(spark, sf):
    return mixture.short_sources(_t(spark, sf, "documents"), _t(spark, sf, "source_targets"))


def p7_report(spark, sf):
    return mixture.Mixture(_t(spark, sf, "documents"), _t(spark, sf, "source_targets")).report()


def p7_copies(spark, sf):
    return mixture.Mixture(_t(spark, sf, "documents"), _t(spark, sf, "source_targets")).rates()


def p8_found(spark, sf):
    return reading.reading_bands(reading.graded(_t(spark, sf, "documents")))


def p8_profile(spark, sf):
    docs = _t(spark, sf, "documents")
    return reading.reading_profile(reading.reading_levels(docs), docs)


def p8_quality(spark, sf):
    return reading.ranker_quality(_t(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_profiles, p1_kmeans, p2_found, p2_cohesion, p3_found, p3_neighbours, p4_found, p4_groups, p6_found, p6_spans, p7_found, p7_report, p7_copies, p8_found, p8_profile, p8_quality)
}

_VECTORS = """
vecs AS (
  SELECT DISTINCT e.chunk_id, e.embedding::DOUBLE[] AS e FROM chunk_embeddings e
  JOIN embedding_spaces s ON s.model = e.embedding_model AND s.version = e.embedding_version AND s.status = 'active'
  WHERE e.embedding IS NOT NULL AND len(e.embedding) = s.dimension AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0
    AND e.embedding NOT IN (SELECT embedding FROM stock_passages WHERE embedding IS NOT NULL)),
links AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM vecs a JOIN vecs b ON a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.e, b.e) >= 0.85)
"""

# p3_found is approximate by nature, so its recall is measured in the tests instead.
SQL: dict[str, str] = {
    "p1_found": f"""
WITH RECURSIVE {_VECTORS},
ends AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT DISTINCT x, x FROM ends UNION SELECT r.x, b.y FROM reach r JOIN ends b ON b.x = r.y),
label AS (SELECT x AS chunk_id, min(y) AS cluster_id FROM reach GROUP BY x)
SELECT cluster_id, chunk_id FROM label WHERE cluster_id IN (SELECT cluster_id FROM label GROUP BY cluster_id HAVING count(*) >= 3)
""",
    "p2_found": r"""
WITH RECURSIVE big AS (SELECT DISTINCT id, text FROM chunks WHERE length(text) > 1200),
pieces(id, text, s, e) AS (
  SELECT id, text, 0, 0 + cut FROM (SELECT id, text, (__CUT0__) AS cut FROM big)
  UNION ALL
  SELECT id, text, s, s + cut FROM (SELECT id, text, e - 150 AS s, (__CUT__) AS cut FROM pieces WHERE e < length(text)))
SELECT id AS chunk_id, CAST(s AS INTEGER) AS piece_start, CAST(e AS INTEGER) AS piece_end FROM pieces WHERE NOT regexp_full_match(substring(text, s + 1, e - s), '\s*')
""",
    "p4_found": r"""
WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM stock_passages WHERE text IS NOT NULL)),
w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c),
sh AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.5 * (x.n + y.n - k)
""",
    # Any tokenizer gives the same rows, and so do characters.
    "p7_found": r"""
WITH d AS (SELECT lower(trim(source)) AS source, length(text) AS n FROM documents WHERE length(trim(source)) > 0 AND regexp_matches(text, '\S')),
t AS (SELECT source, sum(n) AS n FROM d GROUP BY 1)
SELECT lower(trim(g.source)) AS source FROM source_targets g LEFT JOIN t ON t.source = lower(trim(g.source))
WHERE g.target_share * (SELECT sum(n) FROM t) > g.max_repeats * coalesce(t.n, 0)
""",
}


def _cut(start: str) -> str:
    """Length of the piece from ``start``, 0-based, as SQL."""
    window = f"substring(text, {start} + 1, 1200)"
    at = lambda sep: f"CASE WHEN contains({window}, {sep}) THEN length(regexp_extract({window}, '(?s)^(.*)' || {sep.replace(chr(39) + '. ' + chr(39), chr(39) + chr(92) + '. ' + chr(39))}, 1)) ELSE -1 END"
    tests = " ".join(f"WHEN ({at(sep)}) > 720 THEN ({at(sep)}) + {n}" for sep, n in (("chr(10) || chr(10)", 2), ("'. '", 2), ("chr(10)", 1)))
    return f"CASE WHEN length(text) - ({start}) <= 1200 THEN length(text) - ({start}) {tests} ELSE 1200 END"


SQL["p2_found"] = SQL["p2_found"].replace("__CUT0__", _cut("0")).replace("__CUT__", _cut("(e - 150)"))
