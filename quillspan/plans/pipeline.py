"""Queries of ingestion, generation and streaming, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import generation, ingest
from quillspan.plans.fixtures import Fixtures, sql
from quillspan.streaming import ingestion, limiter

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(body: str | None, *names: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Fixtures(spark, sf))
        if body:
            SQL[f.__name__] = sql(body, *names)
        return f

    return register


@query("SELECT doc_id AS id, CAST(start AS INTEGER) AS start, substring(text, start + 1, 1200) AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS start FROM documents WHERE length(text) > 0) WHERE start = 0 OR start < length(text) - 200")
def chunks_fixed(x):
    return ingest.fixed_windows(x.raw("documents"), "doc_id", "text")


def _natural_cut(start: str) -> str:
    """Length of the chunk from ``start``, 0-based: after the last blank line, sentence or line end beyond 720 characters, else 1200."""
    window = f"substring(text, {start} + 1, 1200)"
    ends = [("chr(10) || chr(10)", r"\n\n", 2), ("'. '", r"\. ", 2), ("chr(10)", r"\n", 1)]
    tests = " ".join(f"WHEN contains({window}, {sep}) AND length(regexp_extract({window}, '(?s)^(.*){pattern}', 1)) > 720 THEN length(regexp_extract({window}, '(?s)^(.*){pattern}', 1)) + {n}" for sep, pattern, n in ends)
    return f"CASE WHEN length(text) - ({start}) <= 1200 THEN length(text) - ({start}) {tests} ELSE 1200 END"


@query(
    rf"""WITH RECURSIVE page AS (SELECT doc_id AS id, text FROM documents WHERE length(regexp_replace(text, '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g')) >= 100),
    piece(id, text, s, e) AS (SELECT id, text, 0, {_natural_cut("0")} FROM page UNION ALL SELECT id, text, s, s + n FROM (SELECT id, text, e - 150 AS s, {_natural_cut("(e - 150)")} AS n FROM piece WHERE e < length(text)))
    SELECT id, CAST(s AS INTEGER) AS char_start, CAST(e AS INTEGER) AS char_end, regexp_replace(substring(text, s + 1, e - s), '^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$', '', 'g') AS text FROM piece
    WHERE NOT regexp_full_match(substring(text, s + 1, e - s), '[\s\x0b\x1c-\x1f]*')"""
)
def chunks_natural(x):
    return ingest.natural_chunks(x.raw("documents"), "doc_id", "text")


@query(
    """SELECT doc_id AS id, CASE WHEN length(trim(coalesce(text, ''))) < 100 THEN 'UNREADABLE' ELSE 'FAST' END AS route,
    coalesce(len(list_filter(w, lambda t: length(t) >= 30)) / nullif(len(w), 0), 0) > 0.02 AS broken_spacing
    FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '') AS w FROM documents)"""
)
def page_routing(x):
    return ingest.page_route(x.raw("documents"), "doc_id", "text")


@query("SELECT id, media_type, CASE WHEN lower(filename) LIKE '%.txt' OR lower(filename) LIKE '%.text' THEN 'plain' WHEN lower(filename) LIKE '%.md' OR lower(filename) LIKE '%.markdown' THEN 'markdown' ELSE 'pdf' END AS by_name FROM docs", "docs")
def media_type_by_suffix(x):
    return x.documents.select("id", "media_type", ingest.media_type(F.col("filename")).alias("by_name"))


_LABELS = "array_to_string(list_sort(list_distinct(list(b.label_id) FILTER (WHERE {f}))), ',')"


@query(
    f"""WITH q AS (SELECT tenant_id, id AS label_id FROM access_labels WHERE is_quarantine)
    SELECT d.tenant_id, d.sha256, min(d.id) AS id, count(DISTINCT d.id) AS copies,
      coalesce(nullif({_LABELS.format(f='b.label_id IS NOT NULL AND q.label_id IS NULL')}, ''), {_LABELS.format(f='b.label_id IS NOT NULL')}, '') AS labels
    FROM docs d LEFT JOIN doc_labels b ON b.document_id = d.id LEFT JOIN q ON q.tenant_id = d.tenant_id AND q.label_id = b.label_id GROUP BY 1, 2""",
    "docs", "doc_labels",
)
def dedup_by_hash(x):
    q = x.labels.where("is_quarantine").select("tenant_id", F.col("id").alias("label_id"))
    d = ingest.deduplicated(x.documents, q)
    return d.select("tenant_id", "sha256", "id", "copies", F.array_join(F.transform("label_ids", lambda v: v.cast("string")), ",").alias("labels"))


@query(
    """SELECT chunk_id, page, round(least(1, greatest(0, min(b.x0)::DOUBLE)), 6) AS x0, round(least(1, greatest(0, min(b.y0)::DOUBLE)), 6) AS y0, round(least(1, greatest(0, max(b.x1)::DOUBLE)), 6) AS x1, round(least(1, greatest(0, max(b.y1)::DOUBLE)), 6) AS y1
    FROM (SELECT id AS chunk_id, b.page, b FROM (SELECT DISTINCT id, unnest(bboxes) AS b FROM chunks)) GROUP BY 1, 2"""
)
def chunk_highlight(x):
    return ingest.highlight(x.chunks)


@query(
    """SELECT document_id, array_to_string(list(coalesce(text, '') ORDER BY r), chr(10)) AS excerpt FROM
    (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_num NULLS FIRST, char_start, id) AS r FROM chk) WHERE r <= 6 GROUP BY 1""",
    "chk",
)
def first_n_chunks_excerpt(x):
    return ingest.excerpt(x.chunks)


_REPLY = "CASE WHEN id % 5 = 0 THEN 'None of these' ELSE 'Folders ' || (id % 13) || ', ' || (id % 7) || ' and ' || (id % 13) || ' or ' || (id % 11) || '.' END"


def _reply():
    s = lambda k: (F.col("id") % k).cast("string")
    return F.when(F.col("id") % 5 == 0, "None of these").otherwise(F.concat(F.lit("Folders "), s(13), F.lit(", "), s(7), F.lit(" and "), s(13), F.lit(" or "), s(11), F.lit(".")))


@query(
    f"""WITH r AS (SELECT id, {_REPLY} AS reply FROM docs), n AS (SELECT id, reply, list_filter(list_transform(regexp_extract_all(reply, '\\d+'), lambda s: CAST(s AS BIGINT)), lambda v: v BETWEEN 1 AND 8) AS v FROM r),
    u AS (SELECT id, reply, list_filter(v, lambda e, i: list_position(v, e) = i) AS v FROM n)
    SELECT id, CASE WHEN upper(ltrim(reply)) LIKE 'NONE%' THEN '' ELSE array_to_string(v[1:3], ',') END AS chosen FROM u""",
    "docs",
)
def filing_numbers(x):
    d = x.documents.select("id", _reply().alias("reply"))
    return d.select("id", F.array_join(F.transform(ingest.filing_numbers(F.col("reply"), 8), lambda v: v.cast("string")), ",").alias("chosen"))


@query("SELECT id, CASE status WHEN 'pending' THEN 'parsing' WHEN 'parsing' THEN 'chunking' WHEN 'chunking' THEN CASE WHEN n = 0 THEN 'failed' ELSE 'embedding' END WHEN 'embedding' THEN 'classifying' WHEN 'classifying' THEN 'ready' ELSE status END AS next FROM (SELECT d.id, d.status, count(k.id) AS n FROM docs d LEFT JOIN chk k ON k.document_id = d.id GROUP BY 1, 2)", "docs", "chk")
def next_states(x):
    n = x.chunks.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    d = x.documents.join(n, "id", "left")
    return d.select("id", ingest.next_state(F.col("status"), F.coalesce("n", F.lit(0))).alias("next"))


@query("SELECT tenant_id, CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN CAST(round(b / 1e3) AS BIGINT) || ' kB' WHEN b < 1000000000 THEN CAST(round(b / 1e6) AS BIGINT) || ' MB' ELSE round(b / 1e9, 1) || ' GB' END AS size FROM (SELECT tenant_id, CAST(sum(size_bytes) AS BIGINT) AS b FROM docs GROUP BY 1)", "docs")
def storage_sizes(x):
    return x.documents.groupBy("tenant_id").agg(F.sum("size_bytes").alias("b")).select("tenant_id", ingest.byte_size(F.col("b")).alias("size"))


_CELL = "trim(replace(replace(coalesce(c, ''), chr(10), ' '), '|', chr(92) || '|'), ' ' || chr(9) || chr(13))"


@query(
    rf"""WITH t AS (SELECT doc_id AS id, list_transform(list_filter(string_split(text, chr(10)), lambda s: starts_with(s, '|') AND NOT regexp_full_match(s, '[|\s-]+')),
      lambda s: list_transform(string_split(regexp_replace(s, '^\||\|\s*$', '', 'g'), '|'), lambda c: trim(c))) AS grid FROM documents WHERE text LIKE '%|%|%'),
    k AS (SELECT id, list_max(list_transform(grid, lambda r: len(r))) AS wide, list_transform(grid, lambda r: list_transform(r, lambda c: {_CELL})) AS grid FROM t
      WHERE len(grid) >= 2 AND len(list_filter(grid, lambda r: len(r) < 2)) = 0 AND len(list_filter(flatten(grid), lambda c: trim(c) <> '')) > 0),
    l AS (SELECT id, list_transform(grid, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(wide - len(r)), lambda i: '')), ' | ') || ' |') AS l, '| ' || array_to_string(list_transform(range(wide), lambda i: '---'), ' | ') || ' |' AS rule FROM k)
    SELECT id, array_to_string(list_concat([l[1], rule], l[2:]), chr(10)) AS markdown FROM l"""
)
def table_markdown(x):
    """The Markdown tables of the corpus, parsed into cells and rendered again."""
    t = x.raw("documents").where("text like '%|%|%'")
    rows = F.transform(F.filter(F.split("text", "\n"), lambda s: s.startswith("|") & ~s.rlike("^[|\\s-]+$")), lambda s: F.transform(F.split(F.regexp_replace(s, "^\\||\\|\\s*$", ""), "\\|"), F.trim))
    return ingest.tables_markdown(t.select("doc_id", rows.alias("rows")), "doc_id", "rows").where("markdown is not null")


# -- generation -------------------------------------------------------------
_ANSWER = """CASE WHEN id % 11 = 0 THEN 'the documents do not answer this question' WHEN id % 13 = 0 THEN 'Nobody knows.' WHEN id % 7 = 0 THEN 'It holds [' || (id % 6) || '] , see [' || (id % 90) || '].'
  ELSE event_type || ' holds [' || (id % 6) || '] and [' || (id % 4) || ' , ' || (id % 9) || '] so [not] here.' END"""


def _answers(x):
    """Model replies with markers that name passages, or none, or nothing at all."""
    return x.queries.select("id", F.expr(_ANSWER).alias("answer"), F.lit(4).alias("passages"))


# The text is taken apart at its markers, and every number read from it.
_BOUND = f"""WITH a AS (SELECT id, {_ANSWER} AS answer FROM queries),
    g AS (SELECT id, regexp_split_to_array(answer, '\\[[0-9]+(?:\\s*,\\s*[0-9]+)*\\]') AS parts,
      list_transform(regexp_extract_all(answer, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda m: list_transform(string_split(m, ','), lambda n: CAST(trim(n) AS INTEGER))) AS nums FROM a),
    k AS (SELECT id, parts, flatten(nums) AS every, list_transform(nums, lambda l: list_filter(l, lambda n: n BETWEEN 1 AND 4)) AS kept FROM g),
    j AS (SELECT id, every, flatten(kept) AS good, array_to_string(list_transform(list_zip(parts, list_transform(kept, lambda l: array_to_string(list_transform(l, lambda n: '[' || n || ']'), ''))), lambda z: z[1] || coalesce(z[2], '')), '') AS t FROM k),
    o AS (SELECT id, list_sort(list_distinct(good)) AS cited, len(every) - len(good) AS fabricated, len(good) = 0 OR lower(rtrim(trim(t), '.')) = 'the documents do not answer this question' AS abstained,
      trim(regexp_replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), ' +([.,;:])', '\\1', 'g')) AS text FROM j)"""


@query(f"{_BOUND} SELECT id, CASE WHEN abstained THEN 0 ELSE len(cited) END AS valid, fabricated, abstained FROM o", "queries")
def citation_validity(x):
    return generation.citation_validity(_answers(x))


@query(
    f"{_BOUND} SELECT id, CASE WHEN abstained THEN 'The documents do not answer this question.' ELSE text END AS text, CASE WHEN abstained THEN '' ELSE array_to_string(cited, ',') END AS cited, CAST(fabricated AS INTEGER) AS fabricated, abstained FROM o",
    "queries",
)
def citations_bound(x):
    a = _answers(x).withColumn("b", generation.bound("answer", "passages"))
    return a.select("id", "b.text", F.array_join(F.transform("b.cited", lambda v: v.cast("string")), ",").alias("cited"), "b.fabricated", "b.abstained")


@query(
    """WITH p AS (SELECT c.query_id, c.rank, '[' || c.rank || '] ' || d.filename || CASE WHEN k.page_num IS NOT NULL THEN ' — page ' || k.page_num ELSE '' END || chr(10) || '\"\"\"' || chr(10) || coalesce(k.text, '') || chr(10) || '\"\"\"' AS b
      FROM citations c JOIN chk k ON k.id = c.chunk_id JOIN docs d ON d.id = k.document_id)
    SELECT q.id AS query_id, array_to_string(list(p.b ORDER BY p.rank), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || q.question AS prompt FROM queries q JOIN p ON p.query_id = q.id GROUP BY q.id, q.question""",
    "queries", "citations", "chk", "docs",
)
def prompt_built(x):
    k = x.chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_num", "text")
    p = x.citations.join(k, "chunk_id").join(x.documents.select(F.col("id").alias("document_id"), "filename"), "document_id").select("query_id", "rank", "filename", "page_num", "text")
    return generation.prompts(x.queries.select(F.col("id").alias("query_id"), F.col("question").alias("text")), p)


@query(
    """SELECT user_id AS thread_id, id AS turn, CASE WHEN length(question) > 30 THEN rtrim(substring(question, 1, 29)) || '…' ELSE question END AS question, CASE WHEN length(event_type) > 6 THEN rtrim(substring(event_type, 1, 5)) || '…' ELSE event_type END AS answer
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM queries) WHERE r <= 6""",
    "queries",
)
def thread_bounded(x):
    t = x.queries.select(F.col("user_id").alias("thread_id"), F.col("id").alias("turn"), "question", F.col("event_type").alias("answer"))
    return generation.bounded_threads(t, 6, 30, 6)


_SAID = "CASE WHEN id % 3 = 0 THEN ' chat.' || chr(10) || 'more' WHEN id % 3 = 1 THEN 'search: ' || question || chr(10) || 'noise' WHEN id % 5 = 0 THEN 'Chatting! ' || question ELSE question END"


@query(
    f"""WITH r AS (SELECT id, trim(split_part(ltrim({_SAID}), chr(10), 1)) AS line FROM queries)
    SELECT id, CASE WHEN regexp_full_match(upper(line), 'CHAT[.!]*') THEN 'CHAT' ELSE 'SEARCH' END AS kind,
      CASE WHEN regexp_full_match(upper(line), 'CHAT[.!]*') THEN NULL WHEN starts_with(upper(line), 'SEARCH:') THEN trim(substring(line, 8)) ELSE line END AS query FROM r""",
    "queries",
)
def intent_parsed(x):
    return x.queries.select("id", generation.intent(F.expr(_SAID.replace("chr(10)", "char(10)"))).alias("i")).select("id", "i.kind", "i.query")


# Pages of one to three columns whose words lie where the order lines put them.
_WORDS = """SELECT l_orderkey % 12 AS page, ((l_partkey * 7 + l_linenumber) % (1 + l_orderkey % 3) + 0.06 + 0.88 * ((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % 997) / 997.0) / (1 + l_orderkey % 3) * 0.86 + 0.05 AS x0 FROM {}"""


@query(
    f"""WITH w AS (SELECT page, CAST(floor((x0 + x0 + 0.01) / 2 * 60) AS INTEGER) AS bin FROM ({_WORDS.format("lineitem")})), b AS (SELECT page, greatest(0, least(59, bin)) AS bin, count(*) AS n FROM w GROUP BY ALL),
    c AS (SELECT p.page, i.i, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT page FROM b) p CROSS JOIN range(60) i(i) LEFT JOIN b ON b.page = p.page AND b.bin = i.i),
    k AS (SELECT page, max(n) AS peak, sum(n) AS words FROM c GROUP BY 1),
    s AS (SELECT page, min(i) AS f, max(i) AS l, count(*) AS body FROM c JOIN k USING (page) WHERE n > 0.1 * peak GROUP BY 1),
    m AS (SELECT page, f, l, median(n) AS typical FROM c JOIN s USING (page) JOIN k USING (page) WHERE i BETWEEN f AND l AND body >= 10 AND words >= 250 GROUP BY ALL),
    low AS (SELECT page, i, i - row_number() OVER (PARTITION BY page ORDER BY i) AS run FROM c JOIN m USING (page) WHERE i BETWEEN f + floor((l - f + 1) * 0.3) AND f + floor((l - f + 1) * 0.7) AND n < 0.25 * typical),
    g AS (SELECT page, (min(i) + max(i) + 1) / 2 / 60 AS at FROM low GROUP BY page, run)
    SELECT k.page, count(g.at) AS gutters, coalesce(round(sum(g.at), 6), 0) AS total FROM k LEFT JOIN g USING (page) GROUP BY 1"""
)
def column_gutters(x):
    x.raw("lineitem").createOrReplaceTempView("_lineitem")
    w = x.spark.sql(_WORDS.format("_lineitem")).select("page", F.col("x0").cast("double").alias("x0")).withColumn("x1", F.col("x0") + 0.01)
    g = ingest.column_gutters(w)
    return g.select("page", F.size("gutters").cast("bigint").alias("gutters"), F.round(F.aggregate("gutters", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


# -- streaming --------------------------------------------------------------
@query(None)
def rate_limit_user(x):
    return limiter.limited(x.raw("events"), "user_id", limit=3, window=86_400.0)


@query(None)
def rate_limit_two_level(x):
    e = x.raw("events").withColumn("tenant_id", 1 + F.col("user_id") % 10)
    return limiter.limited_two_levels(e, user_limit=3, tenant_limit=40, window=86_400.0)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(x):
    w = ingestion.windowed_counts(x.raw("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))
