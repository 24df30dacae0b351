"""The driver's tables as the tables that the operators expect, in Spark and in SQL.

Domain tables are used as they are, one row per id (repeated deliveries
dropped). Accounts come from customers, the query log from events: user
``1000 * tenant + n`` of tenant ``1 + key % 10``; roles are the market segments
of a tenant, groups its nations. Both halves of this file state the same rules.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
PERMISSIONS = ("documents.read", "query.execute", "roles.manage", "users.manage")
RESIDUES = 97


class Fixtures:
    """Reference-shaped tables of one test directory; every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    @property
    def tenants(self):
        return self.raw("tenants")

    @property
    def labels(self):
        return self.raw("access_labels")

    @property
    def spaces(self):
        return self.raw("embedding_spaces")

    @property
    def documents(self):
        d = self.raw("document_records").withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<bigint>")))
        return d.drop("loaded_at").dropDuplicates(["id"])

    @property
    def chunks(self):
        c = self.raw("chunks").withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<bigint>")))
        return c.drop("loaded_at").dropDuplicates(["id"])

    @property
    def document_labels(self):
        return self.documents.select(F.col("id").alias("document_id"), F.explode(F.array_distinct("label_ids")).alias("label_id"))

    @property
    def embeddings(self):
        """Usable vectors of the active space, one a chunk."""
        from quillspan.operators.skew import vector_rows

        e = self.raw("chunk_embeddings")
        return vector_rows(e, self.spaces).join(e.select("chunk_id", "tenant_id").distinct(), "chunk_id").select("chunk_id", "tenant_id", "embedding").dropDuplicates(["chunk_id"])

    @property
    def users(self):
        c = self.raw("customer")
        t = 1 + F.col("c_custkey") % 10
        name = F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
        email = F.concat(F.lower(F.when(F.col("c_custkey") % 50 == 7, F.lit("shared")).otherwise(F.col("c_name"))), F.lit("@example.org"))
        return c.select((t * 1000 + F.floor(F.col("c_custkey") / 10)).alias("id"), t.alias("tenant_id"), email.alias("email"), name.alias("name"), "c_mktsegment", "c_nationkey")

    @property
    def roles(self):
        u = self.users.select("tenant_id", F.col("c_mktsegment").alias("name")).distinct()
        k = self._segment("name")
        return u.select((F.col("tenant_id") * 10 + k).alias("id"), "tenant_id", "name", (k == 0).alias("is_system"), (1 + 2 * k).alias("priority_level"))

    def _segment(self, column: str):
        k = F.lit(0)
        for i, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")):
            k = F.when(F.col(column) == s, i).otherwise(k)
        return k.cast("bigint")

    @property
    def user_roles(self):
        return self.users.select(F.col("id").alias("user_id"), (F.col("tenant_id") * 10 + self._segment("c_mktsegment")).alias("role_id"))

    @property
    def role_permissions(self):
        codes = F.explode(F.array(*[F.lit(p) for p in PERMISSIONS]))
        r = self.roles.select(F.col("id").alias("role_id"), codes.alias("permission_code"))
        return r.where((F.col("permission_code") == "query.execute") | (F.col("role_id") % 5 == F.length("permission_code") % 5) | (F.col("role_id") % 10 == 4))

    @property
    def role_labels(self):
        lab = self.labels.select(F.col("id").alias("label_id"), "tenant_id")
        r = self.roles.select(F.col("id").alias("role_id"), "tenant_id")
        return r.join(lab, "tenant_id").where(F.col("label_id") % 5 == F.col("role_id") % 10).select("role_id", "label_id")

    @property
    def groups(self):
        n = self.raw("nation").select("n_nationkey", F.col("n_name").alias("name"))
        u = self.users.select("tenant_id", F.col("c_nationkey").alias("n_nationkey")).distinct()
        return u.join(n, "n_nationkey").select((F.col("tenant_id") * 100 + F.col("n_nationkey")).alias("id"), "tenant_id", "name")

    @property
    def user_groups(self):
        return self.users.select(F.col("id").alias("user_id"), (F.col("tenant_id") * 100 + F.col("c_nationkey")).alias("group_id"))

    @property
    def group_labels(self):
        lab = self.labels.select(F.col("id").alias("label_id"), "tenant_id")
        g = self.groups.select(F.col("id").alias("group_id"), "tenant_id")
        return g.join(lab, "tenant_id").where(F.col("label_id") % 25 == F.col("group_id") % 100).select("group_id", "label_id")

    @property
    def queries(self):
        e = self.raw("events")
        t = 1 + F.col("user_id") % 10
        tokens = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("bigint"))
        return e.select(
            F.col("event_id").alias("id"),
            t.alias("tenant_id"),
            (t * 1000 + F.floor(F.col("user_id") / 10)).alias("user_id"),
            F.concat(F.lit("What about "), "event_type", F.lit(" 100% of item_"), (F.col("event_id") % 50).cast("string"), F.lit("?")).alias("question"),
            F.floor("value").cast("bigint").alias("latency_retrieval_ms"),
            F.when(F.col("event_type") != "view", F.col("event_id") % 900).alias("latency_generation_ms"),
            tokens.alias("prompt_tokens"),
            F.col("ts").alias("created_at"),
            "event_type",
        )

    @property
    def citations(self):
        """Clicks and purchases cite the first chunk of their tenant in a residue class, purchases of a second one too."""
        first = self.chunks.groupBy("tenant_id", (F.col("id") % RESIDUES).alias("residue")).agg(F.min("id").alias("chunk_id"))
        q = self.queries.where(F.col("event_type").isin("click", "purchase"))
        one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
        seat = F.explode(F.when(F.col("event_type") == "purchase", F.array(one, two)).otherwise(F.array(one)))
        q = q.select(F.col("id").alias("query_id"), "tenant_id", seat.alias("rank")).withColumn("residue", (F.col("query_id") + (F.col("rank") - 1) * 13) % RESIDUES)
        return q.join(first, ["tenant_id", "residue"]).select("query_id", "tenant_id", "chunk_id", "rank")

    @property
    def jobs(self):
        """A queue entry for every third record, done for every sixth."""
        d = self.documents.where(F.col("id") % 3 == 0)
        return d.select(F.when(F.col("id") % 2 == 0, "done").otherwise("todo").alias("status"), F.to_json(F.struct(F.col("tenant_id"), F.col("id").alias("document_id"))).alias("args"))

    def tables(self) -> Mapping[str, DataFrame]:
        return _Tables(self)


class _Tables(Mapping):
    """The tables by the names of the security policy; each is planned when it is asked for."""

    NAMES = {
        "tenants": "tenants", "access_labels": "labels", "embedding_spaces": "spaces", "documents": "documents", "document_labels": "document_labels", "chunks": "chunks", "chunk_embeddings": "embeddings",
        "users": "users", "roles": "roles", "user_roles": "user_roles", "role_permissions": "role_permissions", "role_labels": "role_labels", "groups": "groups", "user_groups": "user_groups",
        "group_labels": "group_labels", "queries": "queries", "query_citations": "citations",
    }

    def __init__(self, fixtures: Fixtures):
        self._fixtures = fixtures

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self._fixtures, self.NAMES[name])

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self):
        return len(self.NAMES)


_SEGMENT = "CASE {c} WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 0 END"

#: Name of a fixture table -> (the fixture tables it needs, its SQL).
CTES = {
    "docs": ((), "SELECT DISTINCT id, tenant_id, filename, sha256, media_type, status, coalesce(label_ids, []) AS label_ids, page_count, size_bytes, uploaded_by, created_at FROM document_records"),
    "chk": ((), "SELECT DISTINCT id, document_id, tenant_id, coalesce(label_ids, []) AS label_ids, page_num, char_start, char_end, section, text FROM chunks"),
    "doc_labels": (("docs",), "SELECT DISTINCT id AS document_id, unnest(label_ids) AS label_id FROM docs"),
    "vecs": ((), """SELECT DISTINCT e.chunk_id, e.tenant_id, e.embedding FROM chunk_embeddings e JOIN embedding_spaces s
        ON s.model = e.embedding_model AND s.version = e.embedding_version AND s.status = 'active'
        WHERE e.embedding IS NOT NULL AND len(e.embedding) = s.dimension AND len(list_filter(e.embedding, lambda x: x <> 0)) > 0"""),
    "users": ((), """SELECT (1 + c_custkey % 10) * 1000 + c_custkey // 10 AS id, 1 + c_custkey % 10 AS tenant_id,
        lower(CASE WHEN c_custkey % 50 = 7 THEN 'shared' ELSE c_name END) || '@example.org' AS email,
        CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, c_mktsegment, c_nationkey FROM customer"""),
    "roles": (("users",), f"""SELECT DISTINCT tenant_id * 10 + {_SEGMENT.format(c="c_mktsegment")} AS id, tenant_id, c_mktsegment AS name,
        1 + 2 * {_SEGMENT.format(c="c_mktsegment")} AS priority_level FROM users"""),
    "user_roles": (("users",), f"SELECT id AS user_id, tenant_id * 10 + {_SEGMENT.format(c='c_mktsegment')} AS role_id FROM users"),
    "role_permissions": (("roles",), """SELECT r.id AS role_id, p.code AS permission_code FROM roles r, (VALUES ('documents.read'), ('query.execute'), ('roles.manage'), ('users.manage')) p(code)
        WHERE p.code = 'query.execute' OR r.id % 5 = length(p.code) % 5 OR r.id % 10 = 4"""),
    "role_labels": (("roles",), "SELECT r.id AS role_id, l.id AS label_id FROM roles r JOIN access_labels l ON l.tenant_id = r.tenant_id AND l.id % 5 = r.id % 10"),
    "grps": (("users",), "SELECT DISTINCT u.tenant_id * 100 + n.n_nationkey AS id, u.tenant_id, n.n_name AS name FROM users u JOIN nation n ON n.n_nationkey = u.c_nationkey"),
    "user_groups": (("users",), "SELECT id AS user_id, tenant_id * 100 + c_nationkey AS group_id FROM users"),
    "group_labels": (("grps",), "SELECT g.id AS group_id, l.id AS label_id FROM grps g JOIN access_labels l ON l.tenant_id = g.tenant_id AND l.id % 25 = g.id % 100"),
    "queries": ((), """SELECT event_id AS id, 1 + user_id % 10 AS tenant_id, (1 + user_id % 10) * 1000 + user_id // 10 AS user_id,
        'What about ' || event_type || ' 100% of item_' || CAST(event_id % 50 AS VARCHAR) || '?' AS question,
        CAST(floor(value) AS BIGINT) AS latency_retrieval_ms, CASE WHEN event_type <> 'view' THEN event_id % 900 END AS latency_generation_ms,
        CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS prompt_tokens, ts AS created_at, event_type FROM events"""),
    "citations": (("chk", "queries"), f"""SELECT q.id AS query_id, q.tenant_id, f.chunk_id, s.rank FROM queries q
        JOIN (VALUES (1), (2)) s(rank) ON q.event_type = 'purchase' OR (q.event_type = 'click' AND s.rank = 1)
        JOIN (SELECT tenant_id, id % {RESIDUES} AS residue, min(id) AS chunk_id FROM chk GROUP BY ALL) f
          ON f.tenant_id = q.tenant_id AND f.residue = (q.id + (s.rank - 1) * 13) % {RESIDUES}"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the fixture tables it names, and those they need, as common table expressions."""
    seen: list[str] = []

    def need(name: str) -> None:
        for d in CTES[name][0]:
            need(d)
        if name not in seen:
            seen.append(name)

    for n in names:
        need(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in seen)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}" if head else body
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
