"""Row security: a context, and tables that can only be read through it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AccessDenied(Exception):
    """What was asked for is beyond the caller's reach; ``missing`` names it."""

    def __init__(self, missing):
        self.missing = sorted(missing)
        super().__init__(f"beyond reach: {self.missing}")


@dataclass(frozen=True)
class Context:
    """Who reads: a tenant, the labels within reach, the user, and whether all history may be read. The empty context sees nothing."""

    tenant_id: int | None = None
    label_ids: tuple[int, ...] = ()
    user_id: int | None = None
    reads_all_history: bool = False

    def narrowed(self, requested) -> "Context":
        """The context reduced to some of its labels; None or an empty request changes nothing."""
        if not requested:
            return self
        beyond = set(requested) - set(self.label_ids)
        if beyond:
            raise AccessDenied(beyond)
        return replace(self, label_ids=tuple(sorted(set(requested))))


# Policies are filters: where they are NULL the row is hidden. Plain comparisons, so that they reach the scan.
def tenant_policy(ctx: Context, column: str = "tenant_id") -> Column:
    return F.lit(False) if ctx.tenant_id is None else F.col(column) == ctx.tenant_id


def label_policy(ctx: Context, labels: str = "label_ids") -> Column:
    """No labels (visible to the whole tenant), or one within reach. NULL labels count as hidden."""
    reach = F.array(*[F.lit(i).cast("bigint") for i in ctx.label_ids]).cast("array<bigint>")
    return F.coalesce((F.size(labels) == 0) | F.arrays_overlap(F.array_compact(F.col(labels)), reach), F.lit(False))


def uploader_policy(ctx: Context) -> Column:
    """A document is shown to its uploader until it is ready."""
    if ctx.user_id is None:
        return F.lit(False)
    return F.coalesce((F.col("uploaded_by") == ctx.user_id) & (F.col("status") != "ready"), F.lit(False))


def history_policy(ctx: Context) -> Column:
    if ctx.reads_all_history:
        return F.lit(True)
    return F.lit(False) if ctx.user_id is None else F.col("user_id") == ctx.user_id


#: Tables whose rows are visible if their parent row is: name -> (parent table, own key, parent key).
DERIVED = {
    "pages": ("documents", "document_id", "id"),
    "document_labels": ("documents", "document_id", "id"),
    "query_citations": ("queries", "query_id", "id"),
    "role_permissions": ("roles", "role_id", "id"),
    "role_labels": ("roles", "role_id", "id"),
    "user_roles": ("users", "user_id", "id"),
    "user_groups": ("users", "user_id", "id"),
    "group_labels": ("groups", "group_id", "id"),
}
TENANT_ONLY = frozenset({"users", "roles", "access_labels", "groups", "audit_events", "chunk_embeddings", "llm_config"})
PUBLIC = frozenset({"permissions", "embedding_spaces", "embedding_space_axes"})


class SecureTables:
    """Reads of named tables with the context's policy already applied.

    The policy is an ordinary filter or left-semi join, so Catalyst pushes it
    into the scan. Unknown tables and an empty context fail closed.
    """

    def __init__(self, tables: Mapping[str, DataFrame], ctx: Context):
        self._tables, self.ctx = tables, ctx

    def table(self, name: str) -> DataFrame:
        df = self._tables[name]
        ctx = self.ctx
        if name in PUBLIC:
            return df
        if name == "tenants":
            return df.where(tenant_policy(ctx, "id"))
        if name in TENANT_ONLY:
            return df.where(tenant_policy(ctx))
        if name == "chunks":
            return df.where(tenant_policy(ctx) & label_policy(ctx))
        if name == "documents":
            return df.where(tenant_policy(ctx) & (label_policy(ctx) | uploader_policy(ctx)))
        if name == "queries":
            return df.where(tenant_policy(ctx) & history_policy(ctx))
        if name in DERIVED:
            parent, key, parent_key = DERIVED[name]
            seen = self.table(parent).select(F.col(parent_key).alias(key))
            return df.join(seen, key, "left_semi")
        raise AccessDenied([name])

    def owner(self, name: str) -> DataFrame:
        """The table without policy; for the owner's maintenance only."""
        return self._tables[name]

    def with_context(self, ctx: Context) -> "SecureTables":
        return SecureTables(self._tables, ctx)

    def scoped(self, name: str, document_ids, column: str = "document_id") -> DataFrame:
        """``table(name)`` narrowed to some documents; None or an empty list narrows nothing."""
        df = self.table(name)
        return df.where(F.col(column).isin(list(document_ids))) if document_ids else df

    def beyond(self, requested: DataFrame) -> DataFrame:
        """The requested document ids (id) that are not visible."""
        return requested.select("id").distinct().join(self.table("documents").select("id"), "id", "left_anti")

    def embeddings(self) -> DataFrame:
        """Vectors of visible chunks. Embeddings carry no labels, so this join is the label control of dense search."""
        seen = self.table("chunks").select(F.col("id").alias("chunk_id"), "tenant_id", "document_id")
        return self.table("chunk_embeddings").join(seen, ["chunk_id", "tenant_id"])
