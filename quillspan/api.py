"""The capabilities as calls: a library bound to tables and a context.

``tables`` maps the names of the security policy to DataFrames. Everything is
read through the context's policy; what it does not show cannot be reached.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import access, analytics, generation, ingest, pagination, retrieval
from quillspan.operators.security import AccessDenied, Context, SecureTables

Embedder = Callable[[DataFrame], DataFrame]
"""(query_id, text) to (query_id, embedding); rows may be missing, and their questions are then answered by words alone."""
Model = Callable[[DataFrame], DataFrame]
"""(query_id, prompt) to (query_id, answer)."""
Judge = Callable[[DataFrame], DataFrame]
"""(query_id, question, chunk_id, text) to (query_id, chunk_id, rerank); a question with rows missing keeps its fused order."""
LABEL_SORTS = {"name": pagination.Sort("name"), "usage": pagination.Sort("documents", True), "created": pagination.Sort("created_at", True), "last_used": pagination.Sort("last_used", True)}


@dataclass(frozen=True)
class Library:
    tables: Mapping[str, DataFrame]
    ctx: Context
    embedder: Embedder | None = None
    model: Model | None = None
    stop: frozenset[str] = frozenset()
    judge: Judge | None = None
    analyser: str = "simple"

    @property
    def secure(self) -> SecureTables:
        return SecureTables(self.tables, self.ctx)

    # -- search and answers ---------------------------------------------------
    def search(self, questions: DataFrame, limit: int | None = None, labels=None, documents=None, engine: str = "occurrences") -> DataFrame:
        """Hits of many questions (query_id, text); ``labels`` narrow the reach, ``documents`` the scope. Either beyond reach is an error."""
        s = self.secure.with_context(self.ctx.narrowed(labels))
        if documents:
            spark = questions.sparkSession
            beyond = self.secure.beyond(spark.createDataFrame([(int(d),) for d in documents], "id bigint")).collect()
            if beyond:
                raise AccessDenied(r["id"] for r in beyond)
        chunks = s.scoped("chunks", documents)
        vectors = s.embeddings()
        if documents:
            vectors = vectors.where(F.col("document_id").isin(list(documents)))
        embedded = self.embedder(questions) if self.embedder else None
        empty = F.lit(None).cast("array<double>").alias("embedding")
        q = questions.select("query_id", "text", empty) if embedded is None else questions.select("query_id", "text").join(embedded.select("query_id", F.col("embedding").cast("array<double>")), "query_id", "left")
        hits = retrieval.hybrid_search(q, chunks, vectors, pagination.clamp(limit, retrieval.DEFAULT_LIMIT, retrieval.MAX_LIMIT), self.stop, engine, self.analyser, self.secure.table("documents"))
        if self.judge is None:
            return hits
        asked = hits.select("query_id", "chunk_id", "text").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
        return retrieval.reranked(hits, self.judge(asked.select("query_id", "question", "chunk_id", "text")))

    def answer(self, questions: DataFrame, **options) -> DataFrame:
        """(query_id, text, cited chunk ids, fabricated, abstained); questions without hits abstain and never reach the model."""
        if self.model is None:
            raise ValueError("no model")
        hits = self.search(questions, **options)
        p = hits.select("query_id", "rank", "chunk_id", "document_id", "page_num", "text", "filename")
        prompts = generation.prompts(questions.select("query_id", "text"), p.withColumn("filename", F.coalesce("filename", F.lit("document"))))
        seats = p.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("int"), "chunk_id"))).alias("seat"), F.max(F.col("rank").cast("int")).alias("passages"))
        said = self.model(prompts).join(seats, "query_id").withColumn("b", generation.bound("answer", "passages"))
        found = said.select("query_id", "b.text", F.transform("b.cited", lambda n: F.element_at(F.col("seat"), n)).alias("cited"), "b.fabricated", "b.abstained")
        silent = questions.select("query_id").join(found.select("query_id"), "query_id", "left_anti")
        none = silent.select("query_id", F.lit(generation.ABSTENTION).alias("text"), F.array().cast(found.schema["cited"].dataType).alias("cited"), F.lit(0).alias("fabricated"), F.lit(True).alias("abstained"))
        return found.unionByName(none)

    # -- log and analytics ------------------------------------------------------
    def overview(self, as_of: str, days: int = 30) -> DataFrame:
        return analytics.totals(analytics.in_window(self.secure.table("queries"), as_of, days), self.secure.table("query_citations"))

    def question_log(self, limit: int | None = None, cursor: str | None = None) -> DataFrame:
        s = self.secure
        log = analytics.question_log(s.table("queries"), s.table("users"), s.table("query_citations"), s.table("chunks"), s.table("documents"))
        return pagination.newest_first(log, pagination.clamp(limit, 10), cursor and pagination.decode_time_cursor(cursor))

    def history(self, limit: int | None = None, cursor: str | None = None, search: str | None = None, unanswered: bool = False) -> DataFrame:
        s = self.secure
        h = analytics.history(s.table("queries"), s.table("query_citations")).where(pagination.contains_text("question", search))
        h = h.where("citations = 0") if unanswered else h
        return pagination.newest_first(h, pagination.clamp(limit, 50), cursor and pagination.decode_time_cursor(cursor))

    # -- documents and labels -----------------------------------------------------
    def documents(self, limit: int | None = None, cursor: str | None = None, status: str | None = None, label: int | None = None, unlabelled: bool = False, search: str | None = None) -> DataFrame:
        if status is not None and status not in ingest.STATES:
            raise ValueError(f"unknown status {status!r}")
        if unlabelled and label is not None:
            raise ValueError("unlabelled documents have no label")
        d = self.secure.table("documents").where(pagination.contains_text("filename", search))
        d = d if status is None else d.where(F.col("status") == status)
        d = d.where(F.size("label_ids") == 0) if unlabelled else d if label is None else d.where(F.array_contains("label_ids", label))
        return pagination.newest_first(d, pagination.clamp(limit), cursor and pagination.decode_time_cursor(cursor))

    def folders(self) -> DataFrame:
        return analytics.folder_tree(self.secure.table("documents"), self.secure.table("access_labels"))

    def insights(self) -> DataFrame:
        s = self.secure
        return analytics.document_insights(s.table("documents"), s.table("chunks"), s.table("query_citations"), s.table("users"))

    def labels(self, sort: str = "name", limit: int | None = None, after: tuple | None = None, search: str | None = None, manages: bool = False) -> DataFrame:
        s = self.secure
        visible = access.visible_labels(s.table("access_labels"), self.ctx.label_ids, manages).where(pagination.contains_text("name", search))
        return pagination.sorted_page(analytics.label_usage(visible, s.table("documents")), LABEL_SORTS[sort], pagination.clamp(limit, 20, 100), after)

    def merge_labels(self, sources: set[int], target: int, reserved: set[int]) -> tuple[DataFrame, DataFrame]:
        """(preview, document_labels after the merge); refused as ``access.check_merge`` says."""
        access.check_merge(set(sources), target, set(self.ctx.label_ids), reserved)
        s = self.secure
        sets = s.table("roles").select(F.col("id").alias("role_id")).join(s.table("role_labels").groupBy("role_id").agg(F.collect_set("label_id").alias("l")), "role_id", "left")
        sets = sets.select("role_id", F.coalesce("l", F.array().cast("array<bigint>")).alias("label_ids"))
        return access.merge_preview(s.table("documents"), sets, sources, target), access.merge_apply(s.table("document_labels"), "document_id", sources, target)

    def delete_label(self, label_id: int) -> DataFrame:
        """The labels without one; refused beyond reach, if reserved, and while a document carries it."""
        self._reaches(label_id)
        return access.without_label(self.secure.table("access_labels"), self.tables["document_labels"], label_id)

    def rename_label(self, label_id: int, name: str) -> DataFrame:
        self._reaches(label_id)
        return access.renamed_label(self.secure.table("access_labels"), label_id, name)

    def default_label(self, label_id: int) -> DataFrame:
        self._reaches(label_id)
        return access.with_default(self.secure.table("access_labels"), label_id)

    def _reaches(self, label_id: int) -> None:
        if label_id not in self.ctx.label_ids:
            raise AccessDenied([label_id])

    def delete_documents(self, ids: DataFrame) -> dict[str, DataFrame]:
        """The tables after documents (id) were deleted with all that hangs on them; an error if any is beyond reach."""
        beyond = self.secure.beyond(ids).limit(20).collect()
        if beyond:
            raise AccessDenied(r["id"] for r in beyond)
        names = ("documents", "document_labels", "chunks", "chunk_embeddings", "query_citations")
        return ingest.cascaded({n: self.tables[n] for n in names}, ids)

    def uploads(self, files: DataFrame) -> DataFrame:
        """Where uploads (id, sha256, label_ids) end up: documents of their own, or those whose bytes the tenant already holds."""
        own = self.tables["documents"].where(F.col("tenant_id") == self.ctx.tenant_id)
        q = access.reserved_labels(self.tables["access_labels"])
        return ingest.uploaded_again(own, files.withColumn("tenant_id", F.lit(self.ctx.tenant_id).cast("bigint")), q)

    def audit(self, events: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
        """A page of the tenant's audit events (id, tenant_id, created_at, ...), newest first."""
        own = events.where(F.col("tenant_id") == self.ctx.tenant_id)
        return pagination.newest_first(own, pagination.clamp(limit, 20), cursor and pagination.decode_time_cursor(cursor))

    # -- accounts -------------------------------------------------------------------
    def roles(self) -> DataFrame:
        s = self.secure
        return analytics.roles_overview(s.table("roles"), s.table("role_permissions"), s.table("role_labels"), s.table("user_roles"))

    def users(self) -> DataFrame:
        s = self.secure
        return analytics.directory(s.table("users"), s.table("user_roles"), s.table("user_groups"))

    def groups(self) -> DataFrame:
        s = self.secure
        return analytics.groups_overview(s.table("groups"), s.table("group_labels"), s.table("user_groups"))

    def status(self) -> DataFrame:
        return analytics.tenant_status(self.secure.table("documents"), self.secure.table("chunks"))
