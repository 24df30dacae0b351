"""Aggregates over the query log, documents, labels and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IN_FLIGHT = ("pending", "parsing", "chunking", "embedding", "classifying")


def n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def in_window(queries: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``, which stands for the clock."""
    start = F.expr(f"timestamp_ntz '{as_of}' - interval {int(days)} days")
    return queries.where(F.col("created_at") >= start)


def totals(queries: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: questions, users, tokens, questions without usage, mean latency, abstentions (questions no passage answers)."""
    cited = citations.select(F.col("query_id").alias("cited")).distinct()
    q = queries.join(cited, queries["id"] == F.col("cited"), "left")
    return q.agg(
        n("queries"),
        F.countDistinct("user_id").alias("users"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.count_if(F.col("prompt_tokens").isNull()).alias("no_usage"),
        F.coalesce(F.round(F.avg(F.col("latency_retrieval_ms").cast("double"))), F.lit(0)).cast("bigint").alias("avg_retrieval_ms"),
        F.count_if(F.col("cited").isNull()).alias("abstentions"),
    )


def top_users(queries: DataFrame, users: DataFrame, limit: int = 10) -> DataFrame:
    per = queries.groupBy("user_id").agg(n("queries"))
    named = per.join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left")
    return named.orderBy(F.col("queries").desc(), F.col("email").asc_nulls_last(), "user_id").limit(limit).select("user_id", "email", "queries")


def top_cited(queries: DataFrame, citations: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Documents by the number of answers, not of passages, that cite them."""
    c = citations.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi").join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
    per = c.groupBy("document_id").agg(F.countDistinct("query_id").alias("answers"))
    return per.orderBy(F.col("answers").desc(), "document_id").limit(limit)


def question_log(queries: DataFrame, users: DataFrame, citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Per question: e-mail (NULL for deleted users), distinct cited files, whether it abstained, total latency."""
    files = citations.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    per = files.groupBy("query_id").agg(F.sort_array(F.collect_set("filename")).alias("files"))
    u = users.select(F.col("id").alias("user_id"), "email")
    q = queries.join(u, "user_id", "left").join(per, queries["id"] == per["query_id"], "left")
    latency = F.coalesce(F.col("latency_retrieval_ms"), F.lit(0)) + F.coalesce(F.col("latency_generation_ms"), F.lit(0))
    return q.select("id", "created_at", "email", F.col("query_id").isNull().alias("abstained"), latency.cast("bigint").alias("latency_ms"), F.array_join(F.coalesce("files", F.array().cast("array<string>")), ",").alias("documents"))


def history(queries: DataFrame, citations: DataFrame) -> DataFrame:
    """Per question the number of citations, 0 for an abstention."""
    per = citations.groupBy("query_id").agg(n("citations"))
    q = queries.join(per, queries["id"] == per["query_id"], "left")
    return q.select(*queries.columns, F.coalesce("citations", F.lit(0)).alias("citations"))


def unanswered(queries: DataFrame, citations: DataFrame) -> DataFrame:
    return queries.join(citations.select(F.col("query_id").alias("id")), "id", "left_anti")


def _states() -> list[Column]:
    return [n("documents"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status").isin(*IN_FLIGHT)).alias("processing"), F.count_if(F.col("status") == "failed").alias("failed")]


def folder_tree(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by label and state; documents without a label form one more row, if there are any.

    A document with several labels counts under each. Labels without visible
    documents have no row; a label id of another tenant has none either.
    """
    tagged = documents.select("status", F.explode(F.array_distinct("label_ids")).alias("label_id"))
    named = tagged.join(labels.select(F.col("id").alias("label_id"), "name", "is_default"), "label_id")
    rows = named.groupBy("label_id", "name", "is_default").agg(*_states())
    bare = documents.where(F.size("label_ids") == 0).agg(*_states()).where("documents > 0")
    none = bare.select(F.lit(None).cast("bigint").alias("label_id"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("is_default"), "documents", "ready", "processing", "failed")
    return rows.unionByName(none)


def label_usage(labels: DataFrame, documents: DataFrame, uploaded_by: int | None = None) -> DataFrame:
    """Labels with the number of documents and the latest of them; unused labels have 0 and NULL."""
    d = documents if uploaded_by is None else documents.where(F.col("uploaded_by") == uploaded_by)
    use = d.select(F.explode(F.array_distinct("label_ids")).alias("label_id"), "created_at").groupBy("label_id").agg(n("documents"), F.max("created_at").alias("last_used"))
    return labels.join(use, labels["id"] == use["label_id"], "left").select("id", "name", labels["created_at"], F.coalesce("documents", F.lit(0)).alias("documents"), "last_used")


def _set(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_set(F.col(value).cast("string"))).alias(name))


def roles_overview(roles: DataFrame, role_permissions: DataFrame, role_labels: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Roles with their permissions, labels and number of users. Each side is aggregated before it is joined, so nothing fans out."""
    p, lab = _set(role_permissions, "role_id", "permission_code", "p"), _set(role_labels, "role_id", "label_id", "l")
    u = user_roles.groupBy("role_id").agg(F.countDistinct("user_id").alias("u"))
    r = roles.withColumnRenamed("id", "role_id").join(p, "role_id", "left").join(lab, "role_id", "left").join(u, "role_id", "left")
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    return r.select("role_id", "name", F.col("priority_level").cast("bigint").alias("priority_level"), text("p").alias("permissions"), text("l").alias("labels"), F.coalesce("u", F.lit(0)).alias("users"))


def directory(users: DataFrame, user_roles: DataFrame, user_groups: DataFrame) -> DataFrame:
    """Users with their role and group ids; listed under the name, or the e-mail where there is none."""
    r, g = _set(user_roles, "user_id", "role_id", "r"), _set(user_groups, "user_id", "group_id", "g")
    u = users.withColumnRenamed("id", "user_id").join(r, "user_id", "left").join(g, "user_id", "left")
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    return u.select("user_id", F.coalesce("name", "email").alias("listed_as"), text("r").alias("roles"), text("g").alias("groups"))


def groups_overview(groups: DataFrame, group_labels: DataFrame, user_groups: DataFrame) -> DataFrame:
    lab = _set(group_labels, "group_id", "label_id", "l")
    m = user_groups.groupBy("group_id").agg(F.countDistinct("user_id").alias("members"))
    g = groups.withColumnRenamed("id", "group_id").join(lab, "group_id", "left").join(m, "group_id", "left")
    return g.select("group_id", "name", F.array_join(F.coalesce("l", F.array().cast("array<string>")), ",").alias("labels"), F.coalesce("members", F.lit(0)).alias("members"))


def tenant_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents by state, each row with the tenant's chunk count and whether anything can be searched."""
    total = chunks.agg(n("chunks"))
    return documents.groupBy("status").agg(n("documents")).crossJoin(F.broadcast(total)).withColumn("searchable", F.col("chunks") > 0)


def organisations(tenants: DataFrame, users: DataFrame, documents: DataFrame) -> DataFrame:
    """Tenants with users, documents and stored bytes; 0 where there are none."""
    u = users.groupBy("tenant_id").agg(n("users"))
    d = documents.groupBy("tenant_id").agg(n("documents"), F.sum("size_bytes").alias("storage_bytes"))
    t = tenants.join(u, tenants["id"] == u["tenant_id"], "left").drop("tenant_id").join(d, tenants["id"] == d["tenant_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return t.select(tenants["id"].alias("tenant_id"), "name", "status", zero("users"), zero("documents"), zero("storage_bytes"))


def organisation_board(orgs: DataFrame) -> DataFrame:
    """Organisations in three bands (in use, suspended, destroyed), each by documents, users, name; position counts within the band."""
    band = F.when(F.col("status").isin("active", "purging"), 1).when(F.col("status") == "suspended", 2).otherwise(3).cast("bigint")
    order = Window.partitionBy("band").orderBy(F.col("documents").desc(), F.col("users").desc(), "name", "tenant_id")
    return orgs.withColumn("band", band).select("band", F.row_number().over(order).cast("bigint").alias("position"), "tenant_id", "documents", "users")


def document_insights(documents: DataFrame, chunks: DataFrame, citations: DataFrame, users: DataFrame) -> DataFrame:
    """Per visible document: chunks, distinct answers that cite it, uploader's e-mail."""
    c = chunks.groupBy("document_id").agg(n("chunks"))
    a = citations.join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id").groupBy("document_id").agg(F.countDistinct("query_id").alias("answers"))
    u = users.select(F.col("id").alias("uploaded_by"), F.col("email").alias("uploader"))
    d = documents.withColumnRenamed("id", "document_id").join(c, "document_id", "left").join(a, "document_id", "left").join(u, "uploaded_by", "left")
    return d.select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("answers", F.lit(0)).alias("answers"), "uploader")


def tenant_distribution(chunks: DataFrame) -> DataFrame:
    """Distinct documents, passages and share of all passages of each tenant."""
    per = chunks.groupBy("tenant_id").agg(F.countDistinct("document_id").alias("documents"), n("passages"))
    total = per.agg(F.sum("passages").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("tenant_id", "documents", "passages", F.round(F.col("passages") / F.col("total"), 9).alias("share"))


def duplicate_emails(users: DataFrame) -> DataFrame:
    return users.groupBy(F.lower("email").alias("email")).agg(n("accounts")).where("accounts > 1")


def tenants_missing(tenants: DataFrame, labels: DataFrame, flag: str) -> DataFrame:
    """Tenants without a label that carries ``flag`` (is_default, is_quarantine)."""
    return tenants.select(F.col("id").alias("tenant_id")).join(labels.where(F.col(flag)).select("tenant_id"), "tenant_id", "left_anti")


def shared_files(documents: DataFrame) -> DataFrame:
    """Files, by hash, that more than one tenant holds."""
    return documents.groupBy("sha256").agg(F.countDistinct("tenant_id").alias("tenants"), n("records")).where("tenants > 1")


def stranded(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents neither ready nor waiting for a job: (id, status, labels); the job's payload is JSON."""
    waiting = jobs.where(F.col("status").isin("todo", "doing")).select(F.get_json_object("args", "$.document_id").cast("bigint").alias("id"))
    left = documents.where(F.col("status").isin(*IN_FLIGHT, "failed")).join(waiting, "id", "left_anti")
    return left.where(F.size("label_ids") > 0).select("id", "status", F.array_join(F.transform(F.array_sort(F.array_distinct("label_ids")), lambda x: x.cast("string")), ",").alias("labels"))


def label_census(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks per label through array membership, over labels of the chunk's tenant: (label_id, chunks)."""
    e = chunks.select("tenant_id", F.explode(F.array_distinct("label_ids")).alias("label_id"))
    return e.join(labels.select(F.col("id").alias("label_id"), "tenant_id"), ["label_id", "tenant_id"]).groupBy("label_id").agg(n("chunks"))


def census_ladder(census: list[tuple[int, int]], step: float = 0.5) -> list[tuple[int, int]]:
    """Labels from the largest down, each at most ``step`` of the one kept before."""
    kept: list[tuple[int, int]] = []
    for label, size in sorted(census, key=lambda r: (-r[1], r[0])):
        if not kept or size <= kept[-1][1] * step:
            kept.append((label, size))
    return kept


def content_counts(tables) -> DataFrame:
    """(table, rows) of named tables, in the order of their names."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def unscheduled(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """(tenant_id, documents): records on their way that no open job names."""
    todo = jobs.where("status <> 'done'").select(F.get_json_object("args", "$.document_id").cast("bigint").alias("id")).distinct()
    waiting = documents.where(~F.col("status").isin("ready", "failed"))
    return waiting.join(todo, "id", "left_anti").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("documents"))


def missing_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(id, tenant_id, sha256) of records whose bytes are not among the stored files (sha256)."""
    return documents.join(files.select("sha256").distinct(), "sha256", "left_anti").select("id", "tenant_id", "sha256")


def partition_tree(parts: DataFrame) -> DataFrame:
    """(name, root, depth, rows) of a catalogue of partitions (name, parent, rows), a root having no parent.

    A catalogue has as many rows as there are partitions; the walk goes down
    one level a round and ends with the deepest.
    """
    tree = parts.where("parent is null").select("name", F.col("name").alias("root"), F.lit(0).alias("depth"), "rows")
    level, whole = tree, tree
    for depth in range(1, 33):
        level = parts.join(level.select(F.col("name").alias("parent"), "root"), "parent").select("name", "root", F.lit(depth).alias("depth"), "rows")
        if not level.limit(1).count():
            return whole
        whole = whole.unionByName(level)
    raise ValueError("the partitions are nested more than 32 deep, or in a circle")
