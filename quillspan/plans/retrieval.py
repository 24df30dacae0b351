"""Queries of retrieval, vector spaces and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.core.workspace import stored
from quillspan.functions import text, vector
from quillspan.operators import evaluate, retrieval, vectors
from quillspan.plans.accounts import TENANT, secure
from quillspan.plans.fixtures import CTES, Fixtures, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Function words left out of questions.
STOP = frozenset("the a an of in on for to and or is it by at be was which what when where who that rule says does apply written decides if le la les de du des el los las del der die das dem den und im en".split())
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP))


def query(body: str | None, *names: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Fixtures(spark, sf))
        if body:
            SQL[f.__name__] = sql(body, *names)
        return f

    return register


# -- questions --------------------------------------------------------------
def questions(x):
    """Held-out items as questions; the vector of a question is that of the first chunk in its residue class."""
    first = x.embeddings.groupBy((F.col("chunk_id") % 240).alias("r")).agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    q = x.raw("eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"), "kind", ((F.col("item_id") - 1) % 240).alias("r"))
    return q.join(first, "r", "left").select("query_id", "text", "kind", "embedding")


def probes(x):
    """Every twentieth chunk's vector as a question."""
    return x.embeddings.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


_Q = """qs AS (SELECT i.item_id AS query_id, i.question AS text, i.kind, f.embedding FROM eval_items i
  LEFT JOIN (SELECT chunk_id % 240 AS r, arg_min(embedding, chunk_id) AS embedding FROM vecs GROUP BY 1) f ON f.r = (i.item_id - 1) % 240),
lex AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM qs),
lexemes AS (SELECT * FROM lex WHERE token NOT IN (""" + _STOP + """)),
post AS (SELECT id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM chk WHERE text IS NOT NULL),
lexical AS (SELECT query_id, chunk_id, count(*) * 0.1::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id) AS rank
  FROM post JOIN lexemes USING (token) GROUP BY 1, 2 QUALIFY rank <= 50),
need AS (SELECT query_id, count(*) AS need FROM lexemes WHERE regexp_matches(token, '\\p{Nd}') GROUP BY 1),
ident AS (SELECT l.query_id, c.id AS chunk_id, l.token, c.position FROM (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS position FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM chk WHERE text IS NOT NULL)) c
  JOIN (SELECT * FROM lexemes WHERE regexp_matches(token, '\\p{Nd}')) l USING (token)),
held AS (SELECT i.*, n.need FROM ident i JOIN need n USING (query_id) JOIN (SELECT query_id, chunk_id FROM ident JOIN need USING (query_id) GROUP BY query_id, chunk_id, need HAVING count(DISTINCT token) = need) USING (query_id, chunk_id)),
lasts AS (SELECT e.query_id, e.chunk_id, e.need, e.position AS pos, f.token, max(f.position) AS p FROM held e JOIN held f ON f.query_id = e.query_id AND f.chunk_id = e.chunk_id AND f.position <= e.position GROUP BY ALL),
cover AS (SELECT query_id, chunk_id, need, low, min(pos) AS high FROM (SELECT query_id, chunk_id, need, pos, min(p) AS low FROM lasts GROUP BY query_id, chunk_id, need, pos HAVING count(*) = need) GROUP BY ALL),
exact AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + high - low + 1 - need)), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(0.1::DOUBLE / (1 + high - low + 1 - need)), 9) DESC, chunk_id) AS rank FROM cover GROUP BY 1, 2 QUALIFY rank <= 10),
densed AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  (SELECT q.query_id, v.chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM qs q, vecs v WHERE q.embedding IS NOT NULL) QUALIFY rank <= 50),
halves3 AS (SELECT query_id, chunk_id, rank FROM lexical UNION ALL SELECT query_id, chunk_id, rank FROM densed UNION ALL SELECT query_id, chunk_id, rank FROM exact),
fusedall AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM halves3 GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fusedall QUALIFY rank <= 8)"""
_SEATS = """leads AS (SELECT query_id, chunk_id, 0 AS half FROM lexical WHERE rank = 1 UNION ALL SELECT query_id, chunk_id, 1 FROM densed WHERE rank = 1 UNION ALL SELECT query_id, chunk_id, 2 FROM exact WHERE rank = 1),
    absent AS (SELECT * FROM leads l WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = l.query_id AND f.chunk_id = l.chunk_id)),
    kept AS (SELECT f.* FROM fused f LEFT JOIN (SELECT query_id, count(*) AS missing FROM absent GROUP BY 1) m USING (query_id) WHERE rank <= greatest(1, 8 - coalesce(missing, 0))),
    seated AS (SELECT query_id, chunk_id, score, rank FROM kept UNION ALL
      SELECT a.query_id, a.chunk_id, k.score, k.at + row_number() OVER (PARTITION BY a.query_id ORDER BY half) FROM absent a JOIN (SELECT query_id, max(rank) AS at, min(score) AS score FROM kept GROUP BY 1) k USING (query_id))"""
_NEED = ("vecs", "chk")


def _lexemes(x):
    return retrieval.question_lexemes(questions(x), "query_id", "text", STOP)


@query("SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token, count(*) AS tf FROM chk WHERE text IS NOT NULL GROUP BY 1, 2", "chk")
def term_frequencies(x):
    return text.term_frequencies(x.chunks, "id", "text")


@query(f"WITH {_Q} SELECT query_id, token FROM lexemes", *_NEED)
def question_lexemes(x):
    return _lexemes(x)


@query(f"WITH {_Q} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM lexical", *_NEED)
def lexical_topk(x):
    return retrieval.lexical_or(_lexemes(x), x.chunks).select("query_id", "chunk_id", F.col("rank").cast("bigint"), F.round("score", 6).alias("score"))


@query(f"WITH {_Q} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM exact", *_NEED)
def exact_topk(x):
    return retrieval.exact_identifiers(_lexemes(x), x.chunks).select("query_id", "chunk_id", F.col("rank").cast("bigint"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_Q}, sizes AS (SELECT id AS chunk_id, coalesce(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), 0) AS len FROM chk),
    corpus AS (SELECT count(*) AS n, avg(len) AS a FROM sizes), tf AS (SELECT chunk_id, token, count(*) AS tf FROM post WHERE token IN (SELECT token FROM lexemes) GROUP BY 1, 2),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT l.query_id, tf.chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / a))), 9) AS score
      FROM tf JOIN df USING (token) JOIN lexemes l USING (token) JOIN sizes USING (chunk_id), corpus GROUP BY 1, 2)
    SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    *_NEED,
)
def bm25_topk(x):
    return retrieval.bm25(_lexemes(x), x.chunks, k=10).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_Q} SELECT query_id, chunk_id, rank FROM fused", *_NEED)
def rrf_fusion(x):
    lex = _lexemes(x)
    f = retrieval.fuse([retrieval.lexical_or(lex, x.chunks), retrieval.dense(questions(x), x.embeddings), retrieval.exact_identifiers(lex, x.chunks)], 8)
    return f.select("query_id", "chunk_id", F.col("rank").cast("bigint"))


@query(f"WITH {_Q}, {_SEATS} SELECT query_id, chunk_id, rank AS position FROM seated", *_NEED)
def leader_floor(x):
    lex = _lexemes(x)
    f = retrieval.leader_floor([retrieval.lexical_or(lex, x.chunks), retrieval.dense(questions(x), x.embeddings), retrieval.exact_identifiers(lex, x.chunks)], 8)
    return f.select("query_id", "chunk_id", F.col("position").cast("bigint"))


@query(
    f"""WITH {_Q}, {_SEATS} SELECT f.query_id, f.rank, f.chunk_id, c.document_id, d.filename, d.media_type, c.page_num, c.char_start, c.char_end, c.text, array_to_string(list_sort(d.label_ids), ',') AS labels,
      l.rank AS lexical_rank, v.rank AS dense_rank, round(f.score, 6) AS score, round(l.score, 6) AS lexical_score, round(v.score, 6) AS dense_score, q.embedding IS NULL AS degraded
    FROM seated f JOIN chk c ON c.id = f.chunk_id JOIN qs q USING (query_id) LEFT JOIN docs d ON d.id = c.document_id LEFT JOIN lexical l USING (query_id, chunk_id) LEFT JOIN densed v USING (query_id, chunk_id)""",
    *_NEED, "docs",
)
def hybrid_search(x):
    h = retrieval.hybrid_search(questions(x), x.chunks, x.embeddings, stop=STOP, documents=x.documents)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    six = lambda c: F.round(c, 6).alias(c)
    labels = F.array_join(F.transform(F.sort_array("label_ids"), lambda v: v.cast("string")), ",").alias("labels")
    return h.select("query_id", big("rank"), "chunk_id", "document_id", "filename", "media_type", "page_num", "char_start", "char_end", "text", labels, big("lexical_rank"), big("dense_rank"), six("score"), six("lexical_score"), six("dense_score"), "degraded")


@query(
    f"""WITH {_Q}, {_SEATS}, r AS (SELECT f.query_id, avg(CASE WHEN l.rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS share, max(coalesce(d.score, 0)) AS best
      FROM seated f LEFT JOIN lexical l USING (query_id, chunk_id) LEFT JOIN densed d USING (query_id, chunk_id) GROUP BY 1)
    SELECT query_id, CASE WHEN share < 1.0::DOUBLE / 3 THEN 'NONE' WHEN best < 0.02 THEN 'NONE' WHEN best < 0.15 THEN 'WEAK' ELSE 'CONFIDENT' END AS relevance FROM r""",
    *_NEED,
)
def relevance_bands(x):
    h = retrieval.hybrid_search(questions(x), x.chunks, x.embeddings, stop=STOP)
    return retrieval.relevance(h.withColumn("rerank", F.coalesce("dense_score", F.lit(0.0))))


@query(None)
def lexical_or_topk(x):
    """The lexical half on the English analyser."""
    lex = retrieval.question_lexemes(questions(x), "query_id", "text", analyser="english")
    return retrieval.lexical_or(lex, x.chunks, analyser="english").select("query_id", "chunk_id", F.col("rank").cast("bigint"), F.round("score", 6).alias("score"))


# -- dense ------------------------------------------------------------------
def _knn(condition: str = "true", k: int = 10) -> str:
    return f"""knn AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  (SELECT p.chunk_id AS query_id, v.chunk_id, round(list_cosine_similarity(p.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM vecs p, vecs v
   WHERE p.chunk_id % 20 = 0 AND p.chunk_id <> v.chunk_id AND {condition}) QUALIFY rank <= {k})"""


def _out(df):
    return df.select("query_id", "chunk_id", F.col("rank").cast("bigint"), F.round("score", 6).alias("score"))


@query(f"WITH {_knn()} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM knn", "vecs")
def knn_batch(x):
    return _out(retrieval.dense(probes(x), x.embeddings, 10, exclude_self=True))


@query(f"WITH {_knn(f'v.tenant_id = {TENANT} AND v.chunk_id IN (SELECT id FROM chk WHERE tenant_id = {TENANT} AND len(label_ids) = 0)')} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM knn", "vecs", "chk")
def knn_secured(x):
    return _out(retrieval.dense(probes(x), secure(x).embeddings(), 10, exclude_self=True))


_PDF = "v.chunk_id IN (SELECT c.id FROM chk c JOIN docs d ON d.id = c.document_id WHERE d.media_type = 'pdf')"


@query(f"WITH {_knn(_PDF)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM knn", "vecs", "chk", "docs")
def knn_scoped(x):
    pdf = x.documents.where("media_type = 'pdf'").select(F.col("id").alias("document_id"))
    scope = x.chunks.join(pdf, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return _out(retrieval.dense(probes(x), x.embeddings.join(scope, "chunk_id", "left_semi"), 10, exclude_self=True))


@query(f"WITH {_knn()} SELECT query_id, round(1 - score, 6) AS distance FROM knn WHERE rank = 10", "vecs")
def knn_10th_density(x):
    return retrieval.dense(probes(x), x.embeddings, 10, exclude_self=True).where("rank = 10").select("query_id", F.round(1 - F.col("score"), 6).alias("distance"))


_BITS = "list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END)"


@query(f"SELECT chunk_id, array_to_string({_BITS}, '') AS bits FROM vecs", "vecs")
def sign_bits(x):
    return x.embeddings.select("chunk_id", vector.sign_bits(F.col("embedding")).alias("bits"))


_HAM = f"""b AS (SELECT chunk_id, embedding, {_BITS} AS bits FROM vecs),
  near AS (SELECT p.chunk_id AS query_id, v.chunk_id, p.embedding AS q, v.embedding AS e, len(list_filter(list_zip(p.bits, v.bits), lambda z: z[1] <> z[2])) AS apart,
    row_number() OVER (PARTITION BY p.chunk_id ORDER BY len(list_filter(list_zip(p.bits, v.bits), lambda z: z[1] <> z[2])), v.chunk_id) AS r FROM b p, b v WHERE p.chunk_id % 20 = 0 QUALIFY r <= 50),
  ham AS (SELECT query_id, chunk_id, round(list_cosine_similarity(q::DOUBLE[], e::DOUBLE[]), 9) AS score FROM near),
  hamming AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ham QUALIFY rank <= 10)"""


def _hamming(x):
    return vectors.hamming_rescored(probes(x), x.embeddings, 50, 10)


@query(f"WITH {_HAM} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hamming", "vecs")
def hamming_rescore(x):
    return _out(_hamming(x))


_EXACT = """ex AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  (SELECT p.chunk_id AS query_id, v.chunk_id, round(list_cosine_similarity(p.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM vecs p, vecs v WHERE p.chunk_id % 20 = 0) QUALIFY rank <= 10)"""


def _exact(x):
    return retrieval.dense(probes(x), x.embeddings, 10)


@query(
    f"""WITH {_HAM}, {_EXACT}, o AS (SELECT e.query_id, round(count(h.rank) / count(*), 9) AS recall, count(*) FILTER (WHERE e.rank = 1 AND h.rank = 1) > 0 AS top1 FROM ex e LEFT JOIN hamming h USING (query_id, chunk_id) GROUP BY 1)
    SELECT round(avg(recall), 9) AS recall, min(recall) AS worst, count(*) FILTER (WHERE recall < 0.9) AS below, count(*) FILTER (WHERE top1) AS top1_kept FROM o""",
    "vecs",
)
def index_overlap(x):
    return evaluate.overlap_summary(evaluate.overlap(_exact(x), _hamming(x), 10))


@query(
    f"""WITH {_HAM}, {_EXACT} SELECT count(e.rank) AS rows_a, count(h.rank) AS rows_b, count(*) FILTER (WHERE (e.rank IS NOT NULL AND e.score IS NULL) OR (h.rank IS NOT NULL AND h.score IS NULL)) AS null_scores,
      count(*) FILTER (WHERE e.rank IS NOT NULL AND h.rank IS NOT NULL) AS in_both, count(*) FILTER (WHERE e.rank <> h.rank) AS moved, round(max(abs(e.score - h.score)), 6) AS max_delta
    FROM ex e FULL JOIN hamming h ON e.query_id = h.query_id AND e.chunk_id = h.chunk_id""",
    "vecs",
)
def ranking_equivalence(x):
    return evaluate.ranking_equivalence(_exact(x), _hamming(x))


_GROUPS = "g AS (SELECT id AS chunk_id, document_id, (row_number() OVER (PARTITION BY document_id ORDER BY page_num NULLS FIRST, char_start, id) - 1) // {n} AS gid FROM chk)"


@query(f"WITH {_GROUPS.format(n=16)} SELECT * FROM g", "chk")
def chunk_groups16(x):
    return vectors.chunk_groups(x.chunks, 16)


@query(f"WITH {_GROUPS.format(n=64)} SELECT * FROM g", "chk")
def chunk_groups64(x):
    return vectors.chunk_groups(x.chunks, 64)


_POOL = "SELECT document_id, CAST(i - 1 AS INTEGER) AS position, round({f}(v), 6) AS value FROM (SELECT c.document_id, unnest(e.embedding)::DOUBLE AS v, generate_subscripts(e.embedding, 1) AS i FROM vecs e JOIN chk c ON c.id = e.chunk_id) GROUP BY 1, 2"


def _by_document(x):
    return x.embeddings.join(x.chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")


@query(_POOL.format(f="avg"), "vecs", "chk")
def pooled_mean(x):
    return vectors.pooled(_by_document(x), ["document_id"]).select("document_id", "position", F.round("value", 6).alias("value"))


@query(_POOL.format(f="max"), "vecs", "chk")
def pooled_max(x):
    return vectors.pooled(_by_document(x), ["document_id"], "max").select("document_id", "position", F.round("value", 6).alias("value"))


@query(
    """WITH m AS (SELECT c.document_id AS gid, e.chunk_id, e.embedding::DOUBLE[] AS e FROM vecs e JOIN chk c ON c.id = e.chunk_id),
    comp AS (SELECT gid, i, avg(v) AS v FROM (SELECT gid, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM m) GROUP BY 1, 2), mean AS (SELECT gid, list(v ORDER BY i) AS e FROM comp GROUP BY 1),
    q AS (SELECT chunk_id AS query_id, embedding::DOUBLE[] AS q FROM vecs WHERE chunk_id % 20 = 0),
    p AS (SELECT query_id, q, gid, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, e), 9) DESC, gid) AS r FROM q, mean QUALIFY r <= 8),
    h AS (SELECT p.query_id, m.chunk_id, round(list_cosine_similarity(p.q, m.e), 9) AS score FROM p JOIN m USING (gid))
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, round(score, 6) AS score FROM h QUALIFY rank <= 10""",
    "vecs", "chk",
)
def coarse_to_fine(x):
    members = _by_document(x).select(F.col("document_id").alias("gid"), "chunk_id", "embedding")
    return _out(vectors.coarse_to_fine(probes(x), members, 8, 10))


@query("SELECT id FROM chk ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 500", "chk")
def md5_sample(x):
    return vectors.md5_order(x.chunks.select("id"), "id", 500)


@query("SELECT id FROM chk WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.25", "chk")
def md5_selectivity(x):
    return x.chunks.select("id").where(vectors.md5_uniform(F.col("id")) < 0.25)


@query("SELECT tenant_id, owned, CAST(sum(owned) OVER (PARTITION BY tenant_id % 16) AS BIGINT) AS in_bucket, count(*) OVER (PARTITION BY tenant_id % 16) AS sharing FROM (SELECT tenant_id, count(*) AS owned FROM chk GROUP BY 1)", "chk")
def bucket_widening(x):
    return vectors.bucket_widening(x.chunks, 16)


_ZIPF = "z AS (SELECT i, w / sum(w) OVER () AS weight FROM (SELECT i, pow(i, -1.1) AS w FROM generate_series(1, 50) t(i))), zc AS (SELECT i, weight, sum(weight) OVER (ORDER BY i) AS cum FROM z)"


@query(f"WITH {_ZIPF} SELECT i, round(weight, 9) AS weight, round(cum, 9) AS cum, CAST(ceil((1 - weight) / (0.1 * weight)) AS BIGINT) AS modulus FROM zc")
def zipf_shares(x):
    z = vectors.zipf_weights(x.spark, 50, 1.1)
    return z.select("i", F.round("weight", 9).alias("weight"), F.round("cum", 9).alias("cum"), F.ceil((1 - F.col("weight")) / (0.1 * F.col("weight"))).alias("modulus"))


@query(
    f"""WITH {_ZIPF}, d AS (SELECT id, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS r FROM chk)
    SELECT coalesce((SELECT min(i) FROM zc WHERE cum >= d.r), 50) AS tenant_rank, count(*) AS chunks FROM d GROUP BY 1""",
    "chk",
)
def zipf_assignment(x):
    draws = x.chunks.select("id", vectors.md5_uniform(F.col("id")).alias("r"))
    return vectors.inverse_cdf(draws, vectors.zipf_weights(x.spark, 50, 1.1)).groupBy("tenant_rank").agg(F.count(F.lit(1)).alias("chunks"))


@query(None)
def svd_basis(x):
    axes, share = vectors.basis(x.embeddings, 16)
    rows = [(i, round(float(s), 6)) for i, s in enumerate(share)]
    return x.spark.createDataFrame(rows, "component int, explained double")


@query(None)
def svd_projected(x):
    axes, _ = vectors.basis(x.embeddings, 32)
    return vectors.project(x.embeddings, axes)


# Rounding to eleven significant bits, ties to even; below 2^-14 the steps stay those of 2^-24.
_HALF = "(CASE WHEN v = 0 THEN 0::DOUBLE ELSE round_even(v / pow(2, greatest(floor(log2(abs(v))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(v))), -14) - 10) END)"


@query(f"SELECT chunk_id, count(*) AS width, round(sum({_HALF}), 6) AS total, round(max({_HALF}), 9) AS most FROM (SELECT chunk_id, unnest(embedding)::DOUBLE AS v FROM vecs) GROUP BY 1", "vecs")
def half_precision(x):
    h = vectors.half_precision(x.embeddings).select("chunk_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return h.select("chunk_id", F.size("e").cast("bigint").alias("width"), F.round(F.aggregate("e", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.round(F.array_max("e"), 9).alias("most"))


# -- evaluation -------------------------------------------------------------
_TRUTH = "truth AS (SELECT i.item_id AS query_id, c.id AS chunk_id FROM eval_items i JOIN chk c ON (c.id % 240) = (i.item_id - 1) % 240 AND c.id % 7 < 3)"


def _truth(x):
    i = x.raw("eval_items").select(F.col("item_id").alias("query_id"), ((F.col("item_id") - 1) % 240).alias("r"))
    return x.chunks.where(F.col("id") % 7 < 3).select(F.col("id").alias("chunk_id"), (F.col("id") % 240).alias("r")).join(i, "r").select("query_id", "chunk_id")


@query(
    f"""WITH {_Q}, {_TRUTH}, f AS (SELECT query_id, min(rank) AS first FROM densed JOIN truth USING (query_id, chunk_id) WHERE rank <= 8 GROUP BY 1)
    SELECT q.kind, count(*) AS questions, round(avg(CASE WHEN f.first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall, round(avg(coalesce(1.0::DOUBLE / f.first, 0)), 9) AS mrr
    FROM (SELECT DISTINCT query_id FROM truth) t JOIN qs q USING (query_id) LEFT JOIN f USING (query_id) GROUP BY 1""",
    *_NEED,
)
def recall_mrr_by_type(x):
    return evaluate.recall_mrr(retrieval.dense(questions(x), x.embeddings), _truth(x), questions(x).select("query_id", "kind"))


@query(
    f"""WITH {_Q}, {_TRUTH}, l AS (SELECT DISTINCT query_id FROM lexical JOIN truth USING (query_id, chunk_id) WHERE rank <= 8), d AS (SELECT DISTINCT query_id FROM densed JOIN truth USING (query_id, chunk_id) WHERE rank <= 8)
    SELECT CASE WHEN l.query_id IS NOT NULL AND d.query_id IS NOT NULL THEN 'both' WHEN l.query_id IS NOT NULL THEN 'lexical' WHEN d.query_id IS NOT NULL THEN 'dense' ELSE 'neither' END AS found_by, count(*) AS questions
    FROM (SELECT DISTINCT query_id FROM truth) t LEFT JOIN l USING (query_id) LEFT JOIN d USING (query_id) GROUP BY 1""",
    *_NEED,
)
def recall_halves(x):
    return evaluate.halves(retrieval.lexical_or(_lexemes(x), x.chunks), retrieval.dense(questions(x), x.embeddings), _truth(x))


@query(
    f"""WITH {_Q}, s AS (SELECT 'lexical' AS signal, q.kind, l.score FROM lexical l JOIN qs q USING (query_id) WHERE l.rank <= 5 UNION ALL SELECT 'dense', q.kind, d.score FROM densed d JOIN qs q USING (query_id) WHERE d.rank <= 5)
    SELECT signal, kind, round(min(score), 9) AS low, round(quantile_cont(score, 0.5), 9) AS median, round(max(score), 9) AS high FROM s GROUP BY 1, 2""",
    *_NEED,
)
def separation_bands(x):
    kinds = questions(x).select("query_id", "kind")
    part = lambda r, name: r.where("rank <= 5").join(kinds, "query_id").select(F.lit(name).alias("signal"), "kind", "score")
    return evaluate.separation_bands(part(retrieval.lexical_or(_lexemes(x), x.chunks), "lexical").unionByName(part(retrieval.dense(questions(x), x.embeddings), "dense")))


@query("SELECT round(regr_slope(log10(y), log10(x)), 6) AS slope, round(regr_intercept(log10(y), log10(x)), 6) AS intercept FROM (SELECT count(*) AS x, count(DISTINCT document_id) AS y FROM chk GROUP BY tenant_id)", "chk")
def density_fit(x):
    p = x.chunks.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("x"), F.countDistinct("document_id").alias("y"))
    return evaluate.log_fit(p)


@query(
    """WITH r AS (SELECT event_type, latency_retrieval_ms AS v, row_number() OVER (PARTITION BY event_type ORDER BY latency_retrieval_ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM queries WHERE latency_retrieval_ms IS NOT NULL)
    SELECT event_type, v AS percentile FROM r WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))""",
    "queries",
)
def latency_p95(x):
    return evaluate.nearest_rank(x.queries, "event_type", "latency_retrieval_ms", 0.95)


@query(
    """SELECT event_type, quantile_disc(latency_retrieval_ms, 0.5) AS median, quantile_disc(latency_retrieval_ms, 0.99) AS p99, round(avg(latency_retrieval_ms) FILTER (WHERE user_id % 1000 = 1), 9) AS first_avg FROM queries GROUP BY 1""",
    "queries",
)
def latency_summary(x):
    return evaluate.latency_summary(x.queries.withColumn("i", F.col("user_id") % 1000), "event_type", "latency_retrieval_ms")


_SPACED = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_SQUASHED = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(
    f"""WITH s AS (SELECT stock_id, text AS t, split_part(text, '. ', 1) AS anchor FROM stock_passages)
    SELECT s.stock_id, c.id AS chunk_id FROM s JOIN chk c ON c.text IS NOT NULL AND length({_SPACED.format(c='s.anchor')}) > 0 AND
      (contains({_SPACED.format(c='c.text')}, {_SPACED.format(c='s.anchor')}) OR (NOT regexp_matches(s.anchor, '\\p{{Nd}}') AND contains({_SQUASHED.format(c='c.text')}, {_SQUASHED.format(c='s.anchor')})))""",
    "chk",
)
def anchor_containment(x):
    s = x.raw("stock_passages").select("stock_id", F.substring_index("text", ". ", 1).alias("anchor"))
    c = x.chunks.where("text is not null").select(F.col("id").alias("chunk_id"), "text")
    return c.crossJoin(retrieval.bounded(s)).where(text.anchor_found(F.col("text"), F.col("anchor"))).select("stock_id", "chunk_id")


_FOLD = "lower(strip_accents(w))"


@query(
    f"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}]+'))) AS w FROM chk WHERE text IS NOT NULL)
    SELECT {_FOLD} AS folded, count(*) AS forms, count(*) FILTER (WHERE w = {_FOLD}) AS plain FROM w GROUP BY 1 HAVING count(*) FILTER (WHERE w <> {_FOLD}) > 0""",
    "chk",
)
def accented_vocabulary(x):
    return text.accented_vocabulary(x.chunks, "text")


@query("SELECT document_id, tenant_id, CAST(k AS BIGINT) AS chunks, round(k / sum(k) OVER (PARTITION BY tenant_id), 9) AS of_tenant, round(sum(k) OVER (PARTITION BY tenant_id ORDER BY document_id) / sum(k) OVER (PARTITION BY tenant_id), 9) AS cumulative FROM (SELECT document_id, tenant_id, count(*) AS k FROM chk GROUP BY 1, 2)", "chk")
def document_shares(x):
    per = x.chunks.groupBy("document_id", "tenant_id").agg(F.count(F.lit(1)).alias("chunks"))
    return vectors.shares(per, "tenant_id", "document_id", "chunks")


_SHORT = """lab AS (SELECT id AS label_id, arg_min(e, cid) AS l FROM (SELECT l.id, v.embedding::DOUBLE[] AS e, v.chunk_id AS cid FROM access_labels l JOIN chk c ON list_contains(c.label_ids, l.id) JOIN vecs v ON v.chunk_id = c.id) GROUP BY 1),
    comp AS (SELECT document_id, i, avg(v) AS v FROM (SELECT c.document_id, unnest(e.embedding)::DOUBLE AS v, generate_subscripts(e.embedding, 1) AS i FROM vecs e JOIN chk c ON c.id = e.chunk_id) GROUP BY 1, 2), d AS (SELECT document_id, list(v ORDER BY i) AS d FROM comp GROUP BY 1),
    r AS (SELECT document_id, label_id, row_number() OVER (PARTITION BY document_id ORDER BY round(list_cosine_similarity(d, l), 9) DESC, label_id) AS rank FROM d, lab),
    short AS (SELECT r.document_id, min(rank) AS rank FROM r JOIN doc_labels b ON b.document_id = r.document_id AND b.label_id = r.label_id GROUP BY 1)"""


def _shortlist(x):
    e = x.chunks.select(F.col("id").alias("chunk_id"), F.explode(F.array_distinct("label_ids")).alias("label_id")).join(x.embeddings, "chunk_id").join(x.labels.select(F.col("id").alias("label_id")), "label_id", "left_semi")
    labels = e.groupBy("label_id").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    docs = vectors.as_vectors(vectors.pooled(_by_document(x), ["document_id"]), ["document_id"])
    return evaluate.label_shortlist(docs, labels, x.document_labels).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {_SHORT} SELECT document_id, rank FROM short", "vecs", "chk", "doc_labels")
def label_shortlist(x):
    return _shortlist(x)


@query(f"WITH {_SHORT} SELECT k, count(*) AS documents, count(*) FILTER (WHERE rank <= k) AS found FROM short, (VALUES (1), (3), (10), (30)) t(k) GROUP BY 1", "vecs", "chk", "doc_labels")
def label_shortlist_recall(x):
    return evaluate.shortlist_recall(_shortlist(x), [1, 3, 10, 30])


@query(f"WITH {_SHORT} SELECT min(k) AS k FROM (SELECT rank AS k, sum(count(*)) OVER (ORDER BY rank) AS upto FROM short GROUP BY rank) WHERE upto >= 0.95 * (SELECT count(*) FROM short)", "vecs", "chk", "doc_labels")
def label_shortlist_length(x):
    return evaluate.shortlist_length(_shortlist(x))


@query(
    f"""WITH {_EXACT}, shares(reach) AS (VALUES (1.0::DOUBLE), (0.2::DOUBLE), (0.05::DOUBLE)), part AS (SELECT reach, query_id, chunk_id, row_number() OVER (PARTITION BY reach, query_id ORDER BY score DESC, chunk_id) AS rank FROM
      (SELECT r.reach, p.chunk_id AS query_id, v.chunk_id, round(list_cosine_similarity(p.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM vecs p, vecs v, shares r
       WHERE p.chunk_id % 20 = 0 AND CAST('0x' || substr(md5(CAST(v.chunk_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < r.reach) QUALIFY rank <= 10)
    SELECT r.reach, f.query_id, round(count(p.rank) / count(*), 9) AS recall, count(*) FILTER (WHERE f.rank = 1 AND p.rank = 1) > 0 AS top1 FROM ex f CROSS JOIN shares r LEFT JOIN part p ON p.reach = r.reach AND p.query_id = f.query_id AND p.chunk_id = f.chunk_id GROUP BY 1, 2""",
    "vecs",
)
def recall_partial_reach(x):
    """What a searcher who reaches all, a fifth or a twentieth of the vectors finds of the exact top ten."""
    exact, out = _exact(x), None
    for share in (1.0, 0.2, 0.05):
        reach = x.embeddings.where(vectors.md5_uniform(F.col("chunk_id")) < share)
        one = evaluate.overlap(exact, retrieval.dense(probes(x), reach, 10), 10).select(F.lit(share).alias("reach"), "query_id", "recall", "top1")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {_EXACT} SELECT e.query_id AS a, e.chunk_id AS b, w.weight, round(list_sum(list_transform(list_zip(p.embedding, v.embedding), lambda z: z[1]::DOUBLE * (1 - w.weight) + z[2]::DOUBLE * w.weight)), 6) AS total
    FROM ex e JOIN vecs p ON p.chunk_id = e.query_id JOIN vecs v ON v.chunk_id = e.chunk_id, (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) w(weight) WHERE e.rank BETWEEN 2 AND 4""",
    "vecs",
)
def interpolated_corpus(x):
    near = _exact(x).where("rank between 2 and 4").select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"))
    e = lambda i, v: x.embeddings.select(F.col("chunk_id").alias(i), F.col("embedding").alias(v))
    pairs = near.join(e("a", "va"), "a").join(e("b", "vb"), "b")
    return vectors.interpolated(pairs, [0.1, 0.25, 0.5, 0.75, 0.9], scaled=False).select("a", "b", "weight", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(None)
def bm25_secured(x):
    return retrieval.bm25(_lexemes(x), secure(x).table("chunks"), k=10).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


# The same SQL over the chunks that the policy shows.
SQL["bm25_secured"] = SQL["bm25_topk"].replace(CTES["chk"][1], f"{CTES['chk'][1]} WHERE tenant_id = {TENANT} AND len(coalesce(label_ids, [])) = 0")


@query(None)
def ivf_search(x):
    lists = vectors.inverted_lists(x.embeddings, 16)
    return _out(vectors.list_search(probes(x), lists, [8], 10)[8])


@query(None)
def ivf_recall(x):
    """What the inverted lists find of the exact top ten, for one to all sixteen lists opened."""
    exact, out = stored(_exact(x), "exact"), None
    for n, found in vectors.list_search(probes(x), vectors.inverted_lists(x.embeddings, 16), [1, 2, 4, 8, 16], 10).items():
        one = evaluate.overlap_summary(evaluate.overlap(exact, found, 10)).withColumn("opened", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query(None)
def projection_recall(x):
    """What the exact search in the first 16, 32 and 48 axes finds of the exact top ten in all."""
    axes, _ = vectors.basis(x.embeddings, 48)
    exact, out = stored(_exact(x), "exact"), None
    for n in (16, 32, 48):
        q = vectors.project(probes(x).withColumnRenamed("query_id", "chunk_id"), axes[:, :n]).withColumnRenamed("chunk_id", "query_id")
        one = evaluate.overlap_summary(evaluate.overlap(exact, retrieval.dense(q, vectors.project(x.embeddings, axes[:, :n]), 10), 10)).withColumn("axes", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query(None)
def knn_projected(x):
    axes, _ = vectors.basis(x.embeddings, 32)
    q = vectors.project(probes(x).withColumnRenamed("query_id", "chunk_id"), axes).withColumnRenamed("chunk_id", "query_id")
    return _out(retrieval.dense(q, vectors.project(x.embeddings, axes), 10, exclude_self=True))


@query("SELECT model, version, CASE WHEN model = 'quill-embed' AND version = '2' THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status FROM embedding_spaces")
def space_switched(x):
    return vectors.activated(x.spaces, "quill-embed", "2").select("model", "version", "status")
