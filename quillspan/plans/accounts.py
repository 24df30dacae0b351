"""Queries of analytics, access and listings, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import access, analytics, ingest, pagination, security
from quillspan.plans.fixtures import AS_OF, Fixtures, sql
from quillspan.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
TENANT = 4
CTX = security.Context(TENANT, (), 4003, True)
SINCE = "TIMESTAMP '2024-01-01 00:00:00'"


def query(body: str | None, *names: str):
    """Registers a function (fixtures) -> DataFrame under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf: f(Fixtures(spark, sf))
        if body:
            SQL[f.__name__] = sql(body, *names)
        return f

    return register


def secure(x: Fixtures, ctx: security.Context = CTX) -> security.SecureTables:
    return security.SecureTables(x.tables(), ctx)


def text(values: str) -> str:
    return f"coalesce(array_to_string(list_sort(list_distinct(list(CAST({values} AS VARCHAR)) FILTER (WHERE {values} IS NOT NULL))), ','), '')"


# -- query log --------------------------------------------------------------
@query(
    f"""WITH answered AS (SELECT query_id, true AS cites FROM citations GROUP BY query_id),
    month AS (SELECT * FROM queries LEFT JOIN answered ON query_id = id WHERE tenant_id = {TENANT} AND created_at >= {SINCE}),
    people AS (SELECT count(*) AS users FROM (SELECT user_id FROM month WHERE user_id IS NOT NULL GROUP BY user_id))
    SELECT count(id) AS queries, (SELECT users FROM people) AS users, CAST(sum(CASE WHEN prompt_tokens > 0 THEN prompt_tokens ELSE 0 END) AS BIGINT) AS prompt_tokens,
      count(id) - count(prompt_tokens) AS no_usage, CAST(round(CASE WHEN count(latency_retrieval_ms) = 0 THEN 0 ELSE sum(latency_retrieval_ms) / count(latency_retrieval_ms) END) AS BIGINT) AS avg_retrieval_ms,
      count(id) - count(cites) AS abstentions FROM month""",
    "queries", "citations",
)
def analytics_totals(x):
    s = secure(x)
    return analytics.totals(analytics.in_window(s.table("queries"), AS_OF), s.table("query_citations"))


@query(
    f"""WITH asked AS (SELECT user_id, count(*) AS n FROM queries WHERE tenant_id = {TENANT} GROUP BY user_id),
    seated AS (SELECT user_id, email, n, row_number() OVER (ORDER BY n DESC, email ASC NULLS LAST, user_id) AS seat FROM asked LEFT JOIN users ON users.id = asked.user_id)
    SELECT user_id, email, n AS queries FROM seated WHERE seat <= 10""",
    "queries", "users",
)
def analytics_top_users(x):
    s = secure(x)
    return analytics.top_users(s.table("queries"), s.table("users"))


@query(
    f"""SELECT k.document_id, count(DISTINCT c.query_id) AS answers FROM citations c JOIN queries q ON q.id = c.query_id JOIN chk k ON k.id = c.chunk_id
    WHERE q.tenant_id = {TENANT} AND len(k.label_ids) = 0 GROUP BY 1 ORDER BY answers DESC, document_id LIMIT 10""",
    "queries", "citations", "chk",
)
def analytics_top_cited(x):
    s = secure(x)
    return analytics.top_cited(s.table("queries"), s.table("query_citations"), s.table("chunks"))


_LOG = """named AS (SELECT DISTINCT c.query_id, d.filename FROM docs d JOIN chk k ON k.document_id = d.id JOIN citations c ON c.chunk_id = k.id),
  shelf AS (SELECT query_id, string_agg(filename, ',' ORDER BY filename) AS documents FROM named GROUP BY query_id),
  log AS (SELECT q.id, q.created_at, u.email, s.query_id IS NULL AS abstained, CASE WHEN q.latency_retrieval_ms IS NULL THEN 0 ELSE q.latency_retrieval_ms END + CASE WHEN q.latency_generation_ms IS NULL THEN 0 ELSE q.latency_generation_ms END AS latency_ms,
    CASE WHEN s.documents IS NULL THEN '' ELSE s.documents END AS documents FROM users u RIGHT JOIN queries q ON u.id = q.user_id LEFT JOIN shelf s ON s.query_id = q.id)"""
_PAGE = datetime(2024, 1, 20, 12, 0, 0)


def _log(x) -> DataFrame:
    return analytics.question_log(x.queries, x.users, x.citations, x.chunks, x.documents)


@query(f"WITH {_LOG} SELECT * FROM log ORDER BY created_at DESC, id DESC LIMIT 11", "queries", "users", "citations", "chk", "docs")
def question_log_page(x):
    return pagination.newest_first(_log(x), 10)


@query(f"WITH {_LOG} SELECT * FROM log WHERE (created_at, id) < (TIMESTAMP '2024-01-20 12:00:00', 5000) ORDER BY created_at DESC, id DESC LIMIT 11", "queries", "users", "citations", "chk", "docs")
def question_log_page2(x):
    return pagination.newest_first(_log(x), 10, (_PAGE, 5000))


_HIST = "hist AS (SELECT q.id, q.created_at, q.question, q.user_id, q.tenant_id, count(c.query_id) AS citations FROM queries q LEFT JOIN citations c ON c.query_id = q.id GROUP BY ALL)"


def _history(x, ctx=CTX):
    s = secure(x, ctx)
    h = analytics.history(s.table("queries"), s.table("query_citations"))
    return h.select("id", "created_at", "question", "citations")


@query(f"WITH {_HIST} SELECT id, created_at, question, citations FROM hist WHERE tenant_id = {TENANT} ORDER BY created_at DESC, id DESC LIMIT 51", "queries", "citations")
def history_page(x):
    return pagination.newest_first(_history(x), 50)


@query(f"WITH {_HIST} SELECT id, created_at, question, citations FROM hist WHERE tenant_id = {TENANT} AND contains(lower(question), 'click 100% of item_1') ORDER BY created_at DESC, id DESC LIMIT 51", "queries", "citations")
def history_search(x):
    return pagination.newest_first(_history(x).where(pagination.contains_text("question", " CLICK 100% of item_1")), 50)


@query(f"WITH {_HIST} SELECT id, created_at, question, citations FROM hist WHERE tenant_id = {TENANT} AND user_id = 4003 ORDER BY created_at DESC, id DESC LIMIT 51", "queries", "citations")
def history_mine(x):
    return pagination.newest_first(_history(x, security.Context(TENANT, (), 4003)), 50)


@query(f"SELECT id, created_at, question FROM queries q WHERE tenant_id = {TENANT} AND NOT EXISTS (SELECT 1 FROM citations c WHERE c.query_id = q.id) ORDER BY created_at DESC, id DESC LIMIT 51", "queries", "citations")
def history_unanswered(x):
    s = secure(x)
    return pagination.newest_first(analytics.unanswered(s.table("queries"), s.table("query_citations")).select("id", "created_at", "question"), 50)


# -- documents --------------------------------------------------------------
_DOC = "SELECT id, created_at, status FROM docs"
_PAGE_ORDER = "ORDER BY created_at DESC, id DESC LIMIT 51"


def _docs(x):
    return x.documents.select("id", "created_at", "status", "label_ids", "filename", "tenant_id")


@query(f"{_DOC} {_PAGE_ORDER}", "docs")
def documents_page(x):
    return pagination.newest_first(_docs(x).select("id", "created_at", "status"), 50)


@query(f"{_DOC} WHERE (created_at, id) < (TIMESTAMP '2025-06-01 00:00:00', 100) {_PAGE_ORDER}", "docs")
def documents_page2(x):
    return pagination.newest_first(_docs(x).select("id", "created_at", "status"), 50, (datetime(2025, 6, 1), 100))


@query(f"{_DOC} WHERE list_contains(label_ids, (SELECT min(label_id) FROM doc_labels)) AND status = 'ready' {_PAGE_ORDER}", "docs", "doc_labels")
def documents_by_label(x):
    first = x.document_labels.agg(F.min("label_id").alias("first"))
    d = _docs(x).crossJoin(F.broadcast(first)).where(F.array_contains("label_ids", F.col("first")) & (F.col("status") == "ready"))
    return pagination.newest_first(d.select("id", "created_at", "status"), 50)


@query(f"{_DOC} WHERE len(label_ids) = 0 {_PAGE_ORDER}", "docs")
def documents_unlabelled(x):
    return pagination.newest_first(_docs(x).where(F.size("label_ids") == 0).select("id", "created_at", "status"), 50)


@query(f"{_DOC} WHERE contains(lower(filename), '_scan.') {_PAGE_ORDER}", "docs")
def documents_search(x):
    return pagination.newest_first(_docs(x).where(pagination.contains_text("filename", "_SCAN.")).select("id", "created_at", "status"), 50)


_STATES = """count(*) AS documents, count(*) FILTER (WHERE status = 'ready') AS ready,
  count(*) FILTER (WHERE status IN ('pending', 'parsing', 'chunking', 'embedding', 'classifying')) AS processing, count(*) FILTER (WHERE status = 'failed') AS failed"""


@query(
    f"""SELECT l.id AS label_id, l.name, l.is_default, {_STATES} FROM docs d JOIN doc_labels b ON b.document_id = d.id JOIN access_labels l ON l.id = b.label_id GROUP BY 1, 2, 3
    UNION ALL SELECT NULL, NULL, false, {_STATES} FROM docs WHERE len(label_ids) = 0 HAVING count(*) > 0""",
    "docs", "doc_labels",
)
def folder_tree(x):
    return analytics.folder_tree(x.documents, x.labels)


_USAGE = """usage AS (SELECT l.id, l.name, l.created_at, coalesce(u.documents, 0) AS documents, u.last_used FROM access_labels l LEFT JOIN
  (SELECT b.label_id, count(*) AS documents, max(d.created_at) AS last_used FROM doc_labels b JOIN docs d ON d.id = b.document_id GROUP BY 1) u ON u.label_id = l.id)"""
SORTS = {"name": pagination.Sort("name"), "usage": pagination.Sort("documents", True), "created": pagination.Sort("created_at", True), "last_used": pagination.Sort("last_used", True)}


def _usage(x):
    return analytics.label_usage(x.labels, x.documents)


@query(f"WITH {_USAGE} SELECT * FROM usage ORDER BY name ASC, id ASC LIMIT 21", "docs", "doc_labels")
def label_usage_by_name(x):
    return pagination.sorted_page(_usage(x), SORTS["name"], 20)


@query(f"WITH {_USAGE} SELECT * FROM usage ORDER BY documents DESC, id DESC LIMIT 21", "docs", "doc_labels")
def label_usage_by_usage(x):
    return pagination.sorted_page(_usage(x), SORTS["usage"], 20)


@query(f"WITH {_USAGE} SELECT * FROM usage ORDER BY created_at DESC, id DESC LIMIT 21", "docs", "doc_labels")
def label_usage_by_created(x):
    return pagination.sorted_page(_usage(x), SORTS["created"], 20)


@query(f"WITH {_USAGE} SELECT * FROM usage ORDER BY last_used DESC NULLS LAST, id DESC LIMIT 21", "docs", "doc_labels")
def label_usage_by_last_used(x):
    return pagination.sorted_page(_usage(x), SORTS["last_used"], 20)


@query(f"WITH {_USAGE} SELECT * FROM usage WHERE last_used IS NULL AND id < 500 ORDER BY id DESC LIMIT 21", "docs", "doc_labels")
def label_usage_null_tail(x):
    return pagination.sorted_page(_usage(x), SORTS["last_used"], 20, (None, 500))


@query("SELECT status, count(*) AS n, status IN ('pending', 'parsing', 'chunking', 'embedding', 'classifying') AS in_flight FROM docs GROUP BY 1", "docs")
def status_counts(x):
    return x.documents.groupBy("status").agg(analytics.n()).withColumn("in_flight", F.col("status").isin(*analytics.IN_FLIGHT))


@query(f"SELECT status, count(*) AS documents, (SELECT count(*) FROM chk WHERE tenant_id = {TENANT}) AS chunks, (SELECT count(*) FROM chk WHERE tenant_id = {TENANT}) > 0 AS searchable FROM docs WHERE tenant_id = {TENANT} GROUP BY 1", "docs", "chk")
def tenant_status(x):
    return analytics.tenant_status(x.documents.where(F.col("tenant_id") == TENANT), x.chunks.where(F.col("tenant_id") == TENANT))


_ORG = """orgs AS (SELECT t.id AS tenant_id, t.name, t.status, coalesce(u.n, 0) AS users, coalesce(d.n, 0) AS documents, CAST(coalesce(d.b, 0) AS BIGINT) AS storage_bytes FROM tenants t
  LEFT JOIN (SELECT tenant_id, count(*) AS n FROM users GROUP BY 1) u ON u.tenant_id = t.id LEFT JOIN (SELECT tenant_id, count(*) AS n, sum(size_bytes) AS b FROM docs GROUP BY 1) d ON d.tenant_id = t.id)"""


@query(f"WITH {_ORG} SELECT * FROM orgs", "users", "docs")
def organisations(x):
    return analytics.organisations(x.tenants, x.users, x.documents)


@query(
    f"""WITH {_ORG}, b AS (SELECT *, CASE WHEN status IN ('active', 'purging') THEN 1 WHEN status = 'suspended' THEN 2 ELSE 3 END AS band FROM orgs)
    SELECT CAST(band AS BIGINT) AS band, row_number() OVER (PARTITION BY band ORDER BY documents DESC, users DESC, name, tenant_id) AS position, tenant_id, documents, users FROM b""",
    "users", "docs",
)
def organisation_board(x):
    return analytics.organisation_board(analytics.organisations(x.tenants, x.users, x.documents))


@query(
    """SELECT d.id AS document_id, coalesce(k.n, 0) AS chunks, coalesce(a.n, 0) AS answers, u.email AS uploader FROM docs d
    LEFT JOIN (SELECT document_id, count(*) AS n FROM chk GROUP BY 1) k ON k.document_id = d.id
    LEFT JOIN (SELECT k.document_id, count(DISTINCT c.query_id) AS n FROM citations c JOIN chk k ON k.id = c.chunk_id GROUP BY 1) a ON a.document_id = d.id
    LEFT JOIN users u ON u.id = d.uploaded_by""",
    "docs", "chk", "citations", "users",
)
def document_insights(x):
    return analytics.document_insights(x.documents, x.chunks, x.citations, x.users)


@query("SELECT tenant_id, count(DISTINCT document_id) AS documents, count(*) AS passages, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM chk GROUP BY 1", "chk")
def tenant_distribution(x):
    return analytics.tenant_distribution(x.chunks)


@query("SELECT lower(email) AS email, count(*) AS accounts FROM users GROUP BY 1 HAVING count(*) > 1", "users")
def duplicate_emails(x):
    return analytics.duplicate_emails(x.users)


@query("SELECT id AS tenant_id FROM tenants t WHERE NOT EXISTS (SELECT 1 FROM access_labels l WHERE l.tenant_id = t.id AND l.is_quarantine)")
def tenants_missing_quarantine(x):
    return analytics.tenants_missing(x.tenants, x.labels, "is_quarantine")


@query(
    """SELECT t.id AS tenant_id FROM tenants t WHERE NOT EXISTS (SELECT 1 FROM access_labels l WHERE l.tenant_id = t.id AND l.is_default AND l.created_at < TIMESTAMP '2025-04-01 00:00:00')"""
)
def tenants_missing_default(x):
    """As of a day on which some tenants had no default label yet."""
    return analytics.tenants_missing(x.tenants, x.labels.where("created_at < timestamp_ntz '2025-04-01 00:00:00'"), "is_default").select(F.col("tenant_id"))


# Markdown files filed by a second tenant as well.
@query(
    """WITH f AS (SELECT id, tenant_id, sha256 FROM docs UNION ALL SELECT id + 1000000000, tenant_id % 164 + 1, sha256 FROM docs WHERE media_type = 'markdown')
    SELECT sha256, count(DISTINCT tenant_id) AS tenants, count(*) AS records FROM f GROUP BY 1 HAVING count(DISTINCT tenant_id) > 1""",
    "docs",
)
def shared_files(x):
    d = x.documents.select("id", "tenant_id", "sha256", "media_type")
    again = d.where("media_type = 'markdown'").select((F.col("id") + 1_000_000_000).alias("id"), (F.col("tenant_id") % 164 + 1).alias("tenant_id"), "sha256", "media_type")
    return analytics.shared_files(d.unionByName(again))


@query(
    """SELECT id, status, array_to_string(list_sort(list_distinct(label_ids)), ',') AS labels FROM docs
    WHERE status IN ('pending', 'parsing', 'chunking', 'embedding', 'classifying', 'failed') AND len(label_ids) > 0 AND NOT (id % 3 = 0 AND id % 2 <> 0)""",
    "docs",
)
def stranded(x):
    return analytics.stranded(x.documents, x.jobs)


@query("SELECT l.id AS label_id, count(*) AS chunks FROM (SELECT DISTINCT id, tenant_id, unnest(label_ids) AS label_id FROM chk) c JOIN access_labels l ON l.id = c.label_id AND l.tenant_id = c.tenant_id GROUP BY 1", "chk")
def label_census(x):
    return analytics.label_census(x.chunks, x.labels)


# -- access -----------------------------------------------------------------
@query(f"SELECT r.id AS role_id, r.name, r.priority_level, {text('p.permission_code')} AS permissions, {text('l.label_id')} AS labels, count(DISTINCT u.user_id) AS users FROM roles r LEFT JOIN role_permissions p ON p.role_id = r.id LEFT JOIN role_labels l ON l.role_id = r.id LEFT JOIN user_roles u ON u.role_id = r.id GROUP BY 1, 2, 3", "roles", "role_permissions", "role_labels", "user_roles")
def roles_overview(x):
    return analytics.roles_overview(x.roles, x.role_permissions, x.role_labels, x.user_roles).withColumn("priority_level", F.col("priority_level").cast("bigint"))


@query(f"SELECT u.id AS user_id, coalesce(u.name, u.email) AS listed_as, {text('r.role_id')} AS roles, {text('g.group_id')} AS groups FROM users u LEFT JOIN user_roles r ON r.user_id = u.id LEFT JOIN user_groups g ON g.user_id = u.id GROUP BY 1, 2", "users", "user_roles", "user_groups")
def directory(x):
    return analytics.directory(x.users, x.user_roles, x.user_groups)


@query(f"SELECT g.id AS group_id, g.name, {text('l.label_id')} AS labels, count(DISTINCT u.user_id) AS members FROM grps g LEFT JOIN group_labels l ON l.group_id = g.id LEFT JOIN user_groups u ON u.group_id = g.id GROUP BY 1, 2", "grps", "group_labels", "user_groups")
def groups_overview(x):
    return analytics.groups_overview(x.groups, x.group_labels, x.user_groups)


_REACH = """reach AS (SELECT ur.user_id, rl.label_id FROM user_roles ur JOIN role_labels rl ON rl.role_id = ur.role_id
  UNION SELECT ug.user_id, gl.label_id FROM user_groups ug JOIN group_labels gl ON gl.group_id = ug.group_id JOIN access_labels l ON l.id = gl.label_id
  JOIN (SELECT ur.user_id, max(r.priority_level) AS c FROM user_roles ur JOIN roles r ON r.id = ur.role_id GROUP BY 1) c ON c.user_id = ug.user_id AND l.priority_level <= c.c)"""


@query(f"WITH {_REACH} SELECT user_id, label_id FROM reach", "user_roles", "role_labels", "user_groups", "group_labels", "roles")
def user_label_reach(x):
    return access.label_reach(x.user_roles, x.roles, x.role_labels, x.user_groups, x.group_labels, x.labels)


@query("SELECT ur.user_id, CAST(max(r.priority_level) AS BIGINT) AS clearance FROM user_roles ur JOIN roles r ON r.id = ur.role_id GROUP BY 1", "user_roles", "roles")
def user_clearance(x):
    return access.clearance(x.user_roles, x.roles).withColumn("clearance", F.col("clearance").cast("bigint"))


@query("SELECT DISTINCT ur.user_id, p.permission_code FROM user_roles ur JOIN role_permissions p ON p.role_id = ur.role_id", "user_roles", "role_permissions")
def user_permissions(x):
    return access.user_permissions(x.user_roles, x.role_permissions)


def _visible(labels: str) -> str:
    return f"SELECT id FROM docs WHERE tenant_id = {TENANT} AND (len(label_ids) = 0 OR list_has_any(label_ids, {labels}))"


def _tenant_labels(x, n: int) -> tuple[int, ...]:
    """The n lowest label ids in use in the tenant: a context, so it is known before anything is read."""
    rows = x.labels.where(F.col("tenant_id") == TENANT).orderBy("id").limit(n).select("id").collect()
    return tuple(r["id"] for r in rows)


@query("SELECT id FROM docs WHERE false", "docs")
def visible_documents_none(x):
    return secure(x, security.Context()).table("documents").select("id")


@query(f"SELECT id FROM docs WHERE tenant_id = {TENANT} AND len(label_ids) = 0", "docs")
def visible_documents_unlabelled(x):
    return secure(x, security.Context(TENANT)).table("documents").select("id")


@query(_visible(f"(SELECT list(id) FROM (SELECT id FROM access_labels WHERE tenant_id = {TENANT} ORDER BY id LIMIT 2))"), "docs")
def visible_documents_two(x):
    return secure(x, security.Context(TENANT, _tenant_labels(x, 2))).table("documents").select("id")


@query(f"SELECT id FROM docs WHERE tenant_id = {TENANT} AND (len(label_ids) = 0 OR (uploaded_by = 4003 AND status <> 'ready'))", "docs")
def visible_documents_uploader(x):
    return secure(x, security.Context(TENANT, (), 4003)).table("documents").select("id")


@query(f"SELECT id FROM chk WHERE tenant_id = {TENANT} AND (len(label_ids) = 0 OR list_has_any(label_ids, (SELECT list(id) FROM (SELECT id FROM access_labels WHERE tenant_id = {TENANT} ORDER BY id LIMIT 5))))", "chk")
def visible_chunks(x):
    return secure(x, security.Context(TENANT, _tenant_labels(x, 5))).table("chunks").select("id")


@query(f"SELECT id FROM queries WHERE tenant_id = {TENANT} AND user_id = 4003", "queries")
def visible_queries_own(x):
    return secure(x, security.Context(TENANT, (), 4003)).table("queries").select("id")


@query(f"SELECT id FROM queries WHERE tenant_id = {TENANT}", "queries")
def visible_queries_all(x):
    return secure(x).table("queries").select("id")


@query(f"SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank FROM citations WHERE query_id IN (SELECT id FROM queries WHERE tenant_id = {TENANT} AND user_id = 4003)", "citations", "queries")
def visible_citations(x):
    return secure(x, security.Context(TENANT, (), 4003)).table("query_citations").select("query_id", "chunk_id", "rank")


@query(f"SELECT id FROM docs WHERE tenant_id <> {TENANT} OR len(label_ids) > 0", "docs")
def scope_beyond(x):
    return secure(x, security.Context(TENANT)).beyond(x.documents)


@query("SELECT d.id AS document_id, coalesce(array_to_string(list_sort(list(b.label_id) FILTER (WHERE b.label_id IS NOT NULL)), ','), '') AS labels FROM docs d LEFT JOIN doc_labels b ON b.document_id = d.id GROUP BY 1", "docs", "doc_labels")
def label_ids_sync(x):
    s = access.synced_labels(x.documents, x.document_labels)
    return s.select("document_id", F.array_join(F.transform("label_ids", lambda v: v.cast("string")), ",").alias("labels"))


_LAST = "(SELECT list(id) FROM (SELECT id FROM access_labels WHERE tenant_id = 4 ORDER BY id LIMIT 2 OFFSET 1))"
_MERGE = f"""t AS (SELECT (SELECT min(id) FROM access_labels WHERE tenant_id = 4) AS target, {_LAST} AS sources),
  rs AS (SELECT r.id AS role_id, coalesce(list(l.label_id) FILTER (WHERE l.label_id IS NOT NULL), []) AS s FROM roles r LEFT JOIN role_labels l ON l.role_id = r.id WHERE r.tenant_id = 4 GROUP BY 1),
  r2 AS (SELECT role_id, s, CASE WHEN list_has_any(s, sources) THEN list_append(list_filter(s, lambda v: NOT list_contains(sources, v)), target) ELSE s END AS s2 FROM rs, t),
  d2 AS (SELECT id, label_ids AS s, CASE WHEN list_has_any(label_ids, sources) THEN list_append(list_filter(label_ids, lambda v: NOT list_contains(sources, v)), target) ELSE label_ids END AS s2 FROM docs, t WHERE tenant_id = 4)"""


def _merge_sets(x):
    ids = _tenant_labels(x, 3)
    sets = x.roles.where(F.col("tenant_id") == TENANT).select(F.col("id").alias("role_id")).join(x.role_labels.groupBy("role_id").agg(F.collect_set("label_id").alias("l")), "role_id", "left")
    return ids[0], ids[1:], sets.select("role_id", F.coalesce("l", F.array().cast("array<bigint>")).alias("label_ids"))


@query(
    f"""WITH {_MERGE} SELECT (SELECT count(*) FROM docs, t WHERE tenant_id = 4 AND list_has_any(label_ids, sources)) AS documents_relabelled,
    (SELECT count(*) FROM d2 WHERE EXISTS (SELECT 1 FROM r2 WHERE NOT (len(d2.s) = 0 OR list_has_any(d2.s, r2.s)) AND (len(d2.s2) = 0 OR list_has_any(d2.s2, r2.s2)))) AS visibility_widening""",
    "docs", "roles", "role_labels",
)
def merge_preview(x):
    target, sources, sets = _merge_sets(x)
    return access.merge_preview(x.documents.where(F.col("tenant_id") == TENANT), sets, sources, target).withColumn("visibility_widening", F.col("visibility_widening").cast("bigint"))


@query("WITH t AS (SELECT (SELECT min(id) FROM access_labels WHERE tenant_id = 4) AS target, " + _LAST + " AS sources) SELECT DISTINCT document_id, CASE WHEN list_contains(sources, label_id) THEN target ELSE label_id END AS label_id FROM doc_labels, t", "doc_labels")
def merge_apply(x):
    target, sources, _ = _merge_sets(x)
    return access.merge_apply(x.document_labels, "document_id", sources, target)


@query(
    """SELECT r.id AS role_id, (SELECT count(DISTINCT p.permission_code) FROM role_permissions p JOIN roles o ON o.id = p.role_id
      WHERE o.tenant_id = r.tenant_id AND o.id <> r.id AND p.permission_code IN ('users.manage', 'roles.manage') AND p.role_id IN (SELECT role_id FROM user_roles)) = 2 AS safe FROM roles r""",
    "roles", "role_permissions", "user_roles",
)
def last_admin_guard(x):
    return access.last_admin_guard(x.roles, x.role_permissions, x.user_roles)


@query("SELECT role_id, label_id FROM role_labels rl WHERE NOT (label_id IN (SELECT id FROM access_labels WHERE is_quarantine) AND role_id % 10 <> 0)", "role_labels")
def revoked_grants(x):
    return access.revoked(x.role_labels, x.labels, x.roles.where("is_system"))


@query(f"SELECT id, name FROM access_labels WHERE tenant_id = {TENANT} AND NOT is_quarantine AND NOT is_default")
def offerable_labels(x):
    return access.offerable_labels(secure(x).table("access_labels")).select("id", "name")


@query(f"SELECT 'documents' AS \"table\", count(*) AS rows FROM docs WHERE tenant_id = {TENANT} UNION ALL SELECT 'chunks', count(*) FROM chk WHERE tenant_id = {TENANT} UNION ALL SELECT 'users', count(*) FROM users WHERE tenant_id = {TENANT}", "docs", "chk", "users")
def purge_preview(x):
    return access.purge_preview({"documents": x.documents, "chunks": x.chunks, "users": x.users}, TENANT)


@query(f"SELECT id FROM chk WHERE tenant_id <> {TENANT}", "chk")
def purged_chunks(x):
    return access.without_tenant(x.chunks, TENANT).select("id")


@query("SELECT tenant_id, name FROM access_labels WHERE is_quarantine UNION ALL SELECT t.id, 'quarantine' FROM tenants t WHERE NOT EXISTS (SELECT 1 FROM access_labels l WHERE l.tenant_id = t.id AND l.is_quarantine)")
def ensured_quarantine(x):
    return access.ensured_labels(x.tenants, x.labels, "is_quarantine", "quarantine")


# -- labels, uploads and diagnostics ------------------------------------------
@query("SELECT tenant_id, id AS label_id FROM access_labels WHERE is_quarantine AND id IN (SELECT label_id FROM doc_labels)", "doc_labels")
def reserved_labels(x):
    return access.reserved_labels(x.labels, x.document_labels)


@query(
    """SELECT l.id AS label_id, count(DISTINCT b.document_id) AS documents, count(b.document_id) = 0 AND NOT l.is_quarantine AS deletable
    FROM access_labels l LEFT JOIN doc_labels b ON b.label_id = l.id GROUP BY l.id, l.is_quarantine""",
    "doc_labels",
)
def label_deletion(x):
    return access.label_deletion(x.labels, x.document_labels)


@query("SELECT id AS label_id, CASE WHEN split_part(trim(name), '/', 1) = 'people' THEN true ELSE false END AS inside FROM (SELECT id, lower(trim(name)) || CASE WHEN is_default THEN '/inbox' WHEN is_quarantine THEN '-hold' ELSE '' END AS name FROM access_labels)")
def namespace_descendants(x):
    n = F.concat(F.lower(F.trim("name")), F.when(F.col("is_default"), "/inbox").when(F.col("is_quarantine"), "-hold").otherwise(""))
    return x.labels.withColumn("name", n).select(F.col("id").alias("label_id"), access.in_namespace("name", "people").alias("inside"))


_CASCADE = {"documents": "docs WHERE status <> 'failed'", "document_labels": "doc_labels WHERE document_id NOT IN (SELECT id FROM gone)", "chunks": "chk WHERE document_id NOT IN (SELECT id FROM gone)",
            "chunk_embeddings": "vecs WHERE chunk_id NOT IN (SELECT c.id FROM chk c JOIN gone ON gone.id = c.document_id)", "query_citations": "citations WHERE chunk_id NOT IN (SELECT c.id FROM chk c JOIN gone ON gone.id = c.document_id)"}


@query("WITH gone AS (SELECT id FROM docs WHERE status = 'failed') " + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {b}" for n, b in _CASCADE.items()), "docs", "doc_labels", "chk", "vecs", "citations")
def delete_cascade(x):
    """Rows that each table keeps after the failed records are deleted."""
    t = x.tables()
    return analytics.content_counts(ingest.cascaded({n: t[n] for n in _CASCADE}, x.documents.where("status = 'failed'")))


@query(
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, sha256 ORDER BY id) AS nth FROM docs), u AS (SELECT * FROM ranked WHERE nth > 1 OR media_type = 'markdown'),
    e AS (SELECT * FROM docs WHERE id NOT IN (SELECT id FROM u)), f AS (SELECT tenant_id, sha256, min(id) AS id FROM e GROUP BY ALL), q AS (SELECT tenant_id, min(id) AS q FROM access_labels WHERE is_quarantine GROUP BY 1),
    j AS (SELECT u.id AS upload_id, e.id AS document_id, q.q, list_sort(list_distinct(list_concat(u.label_ids, coalesce(e.label_ids, [])))) AS l FROM u LEFT JOIN f ON f.tenant_id = u.tenant_id AND f.sha256 = u.sha256 LEFT JOIN e ON e.id = f.id LEFT JOIN q ON q.tenant_id = u.tenant_id)
    SELECT upload_id, coalesce(document_id, upload_id) AS document_id, array_to_string(CASE WHEN document_id IS NOT NULL AND len(l) > 1 THEN list_filter(l, lambda v: q IS NULL OR v <> q) ELSE l END, ',') AS labels, document_id IS NOT NULL AS deduplicated FROM j""",
    "docs",
)
def uploads_merged(x):
    """Markdown files and second records of the same bytes as uploads to a library that holds the rest."""
    nth = F.row_number().over(Window.partitionBy("tenant_id", "sha256").orderBy("id"))
    d = x.documents.withColumn("late", (nth > 1) | (F.col("media_type") == "markdown"))
    q = x.labels.where("is_quarantine").select("tenant_id", F.col("id").alias("label_id"))
    m = ingest.uploaded_again(d.where("not late"), d.where("late"), q)
    return m.select("upload_id", "document_id", F.array_join(F.transform("label_ids", lambda v: v.cast("string")), ",").alias("labels"), "deduplicated")


@query("SELECT t.name AS \"table\", t.n AS rows FROM (SELECT 'chunks' AS name, count(*) AS n FROM chk UNION ALL SELECT 'documents', count(*) FROM docs UNION ALL SELECT 'queries', count(*) FROM queries UNION ALL SELECT 'query_citations', count(*) FROM citations) t", "chk", "docs", "queries", "citations")
def content_counts(x):
    t = x.tables()
    return analytics.content_counts({n: t[n] for n in ("documents", "chunks", "queries", "query_citations")})


@query("SELECT tenant_id, count(*) AS documents FROM docs WHERE status NOT IN ('ready', 'failed') AND NOT (id % 3 = 0 AND id % 2 <> 0) GROUP BY 1", "docs")
def in_flight(x):
    return analytics.unscheduled(x.documents, x.jobs)


@query("SELECT id, tenant_id, sha256 FROM docs WHERE sha256 NOT IN (SELECT sha256 FROM docs WHERE status = 'ready')", "docs")
def missing_files(x):
    """Records whose bytes no ready record has, as if only those were stored."""
    return analytics.missing_files(x.documents, x.documents.where("status = 'ready'"))


@query(
    """WITH RECURSIVE p AS (SELECT 'r' || r_regionkey AS name, NULL AS parent, 0 AS n FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier),
    t AS (SELECT name, name AS root, 0 AS depth, n FROM p WHERE parent IS NULL UNION ALL SELECT p.name, t.root, t.depth + 1, p.n FROM p JOIN t ON p.parent = t.name) SELECT root, depth, count(*) AS parts, CAST(sum(n) AS BIGINT) AS rows FROM t GROUP BY 1, 2"""
)
def partition_tree(x):
    part = lambda t, k, up, n: x.raw(t).select(k.alias("name"), up.alias("parent"), F.lit(n).alias("rows"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = part("region", key("r", "r_regionkey"), F.lit(None).cast("string"), 0).unionByName(part("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), 0)).unionByName(part("supplier", key("s", "s_suppkey"), key("n", "s_nationkey"), 1))
    return analytics.partition_tree(parts).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"))


@query(
    f"""SELECT event_id AS id, ts AS created_at, 'query.' || event_type AS action, user_id AS actor_user_id, '{{"value":' || CAST(floor(value) AS BIGINT) || '}}' AS details FROM events
    WHERE ts < TIMESTAMP '2024-01-20 12:00:00' OR (ts = TIMESTAMP '2024-01-20 12:00:00' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 21"""
)
def audit_page(x):
    """The second page of the audit events, twenty and the one that tells of more."""
    e = x.raw("events")
    columns = tables.audit_event(F.concat(F.lit("query."), "event_type"), F.col("user_id"), F.lit("query"), F.col("event_id"), value=F.floor("value").cast("bigint"))
    audit = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), *columns)
    return pagination.newest_first(audit, 20, (_PAGE, 5000)).select("id", "created_at", "action", "actor_user_id", "details")
