"""Queries of problem 5 and their SQL."""

from __future__ import annotations

from quillspan.operators import skew


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p5_found(spark, sf):
    return skew.heavy_tenants_and_vectors(_t(spark, sf, "chunks"), _t(spark, sf, "chunk_embeddings"), _t(spark, sf, "embedding_spaces"), _t(spark, sf, "stock_passages"))


def p5_tenant_profile(spark, sf):
    return skew.tenant_profile(_t(spark, sf, "chunks"), _t(spark, sf, "tenants"))


def p5_vector_counts(spark, sf):
    """Each distinct vector, named by its first chunk, with the number of chunks that carry it."""
    return skew.vector_shares(_t(spark, sf, "chunk_embeddings"), _t(spark, sf, "embedding_spaces")).select("first_chunk", "chunks")


QUERIES = {f.__name__: f for f in (p5_found, p5_tenant_profile, p5_vector_counts)}

_USABLE = """
usable AS (
  SELECT DISTINCT e.chunk_id, e.embedding FROM chunk_embeddings e
  JOIN embedding_spaces s ON s.model = e.embedding_model AND s.version = e.embedding_version AND s.status = 'active'
  WHERE e.embedding IS NOT NULL AND len(e.embedding) = s.dimension AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0)
"""

SQL = {
    "p5_found": f"""
WITH {_USABLE},
ids AS (SELECT DISTINCT id, tenant_id FROM chunks)
SELECT 'tenant_id' AS key_field, tenant_id AS key_value FROM ids
GROUP BY tenant_id HAVING count(DISTINCT id) > 0.05 * (SELECT count(DISTINCT id) FROM chunks)
UNION ALL
SELECT 'embedding', p.stock_id FROM stock_passages p JOIN usable u ON u.embedding = p.embedding
GROUP BY p.stock_id HAVING count(DISTINCT u.chunk_id) > 0.015 * (SELECT count(DISTINCT chunk_id) FROM usable)
""",
    "p5_tenant_profile": """
WITH c AS (
  SELECT id, tenant_id, coalesce(length(text), 0) AS chars,
         row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, coalesce(length(text), 0) DESC) AS r FROM chunks)
SELECT t.id AS tenant_id, t.name, count(*) AS chunks, CAST(sum(chars) AS BIGINT) AS chars, max(chars) AS longest
FROM c JOIN tenants t ON t.id = c.tenant_id WHERE r = 1 GROUP BY t.id, t.name
""",
    "p5_vector_counts": f"""
WITH {_USABLE} SELECT min(chunk_id) AS first_chunk, count(DISTINCT chunk_id) AS chunks FROM usable GROUP BY embedding
""",
}
