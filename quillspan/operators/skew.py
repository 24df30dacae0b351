"""Problem 5: per-key results when a few keys hold most rows.

Method: a frequent-items sketch finds the keys that may hold more than a share
of the rows; rows of these keys are recognised by a broadcast join (there are
at most ``1 / share`` of them, times a small factor, whatever the data) and
processed in salted parts; the other keys go through an ordinary shuffle; the
two results are united.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.vector import usable

SALTS = 32
MOST_COUNTERS = 1 << 19


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """The keys that may hold more than ``share`` of the rows: (key), at most 4 / share of them.

    A mergeable frequent-items sketch with 16 / share counters misses no key
    above the share; keys whose estimate is below half the share are dropped.
    NULL keys are not reported. No rows give no keys. A share so small that the
    sketch would need more than 2^19 counters is refused, since it could not
    keep that promise.
    """
    most, counters = math.ceil(4 / share), 1 << math.ceil(math.log2(16 / share))
    if counters > MOST_COUNTERS:
        raise ValueError(f"a share below {16 / MOST_COUNTERS:.2g} needs more counters than the sketch has")
    named = df.where(F.col(key).isNotNull())
    top = named.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {counters})").alias("top"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.col("n") * share / 2).select(F.col("t.item").alias(key))


def balanced_counts(df: DataFrame, key: str, id_col: str, share: float = 0.01) -> DataFrame:
    """Rows, distinct ids and smallest id of every key: (key, rows, ids, first).

    Heavy keys are counted in ``SALTS`` parts by a hash of the id, so no task
    sees more than a part of one, and the parts are added; each id falls in one
    part, so the distinct counts add up. NULL keys and NULL ids are left out;
    an empty table gives no rows; further columns are not read.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(id_col).isNotNull()).select(key, F.col(id_col).alias("__id"))
    heavy = heavy_keys(rows, key, share)
    salted = rows.join(F.broadcast(heavy), key, "left_semi").groupBy(key, F.pmod(F.xxhash64("__id"), F.lit(SALTS)).alias("salt"), "__id").agg(F.count(F.lit(1)).alias("n"))
    first = salted.groupBy(key, "salt").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"), F.min("__id").alias("first"))
    hot = first.groupBy(key).agg(F.sum("rows").alias("rows"), F.sum("ids").alias("ids"), F.min("first").alias("first"))
    rest = rows.join(F.broadcast(heavy), key, "left_anti").groupBy(key, "__id").agg(F.count(F.lit(1)).alias("n"))
    cold = rest.groupBy(key).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"), F.min("__id").alias("first"))
    return hot.unionByName(cold)


def balanced_join(facts: DataFrame, other: DataFrame, key: str, share: float = 0.01, rows_per_key: int = 1000) -> DataFrame:
    """Inner join on ``key`` in which no task receives all rows of a heavy key.

    The other side's rows for the heavy keys of ``facts`` are broadcast after a
    check that there are at most ``rows_per_key`` of each; a heavy key with
    more stays with the ordinary join, which AQE splits. NULL keys match
    nothing. Both sides keep their columns, the key once; other columns must
    differ in name. Empty sides give no rows.
    """
    heavy = heavy_keys(facts, key, share)
    few = other.join(F.broadcast(heavy), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rows_per_key).select(key)
    lone = heavy.join(other.select(key), key, "left_anti")
    hot = few.unionByName(lone)
    small = other.join(F.broadcast(hot), key, "left_semi")
    fast = facts.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(small), key)
    slow = facts.join(F.broadcast(hot), key, "left_anti").join(other.join(F.broadcast(hot), key, "left_anti").hint("merge"), key)
    return fast.unionByName(slow)


def tenant_shares(chunks: DataFrame) -> DataFrame:
    """Distinct chunks of every tenant and their share of all: (tenant_id, chunks, share)."""
    per = balanced_counts(chunks, "tenant_id", "id")
    total = chunks.where("id is not null").agg(F.countDistinct("id").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("tenant_id", F.col("ids").alias("chunks"), (F.col("ids") / F.col("total")).alias("share"))


def vector_rows(embeddings: DataFrame, spaces: DataFrame) -> DataFrame:
    """Usable vectors of the active space: (chunk_id, embedding, vector), vector being a 64-bit hash of the values."""
    active = spaces.where("status = 'active'").orderBy(F.col("created_at").desc_nulls_last(), F.col("version").desc()).limit(1)
    e = embeddings.join(F.broadcast(active.select("model", "version", "dimension")), (F.col("embedding_model") == F.col("model")) & (F.col("embedding_version") == F.col("version")))
    return e.where(usable(F.col("embedding"), F.col("dimension")) & F.col("chunk_id").isNotNull()).select("chunk_id", "embedding", F.xxhash64("embedding").alias("vector"))


def vector_shares(embeddings: DataFrame, spaces: DataFrame) -> DataFrame:
    """Chunks that carry each distinct vector and their share of all chunks with a usable vector: (vector, first_chunk, chunks, share)."""
    rows = vector_rows(embeddings, spaces)
    total = rows.agg(F.countDistinct("chunk_id").alias("total"))
    return balanced_counts(rows, "vector", "chunk_id").crossJoin(F.broadcast(total)).select("vector", F.col("first").alias("first_chunk"), F.col("ids").alias("chunks"), (F.col("ids") / F.col("total")).alias("share"))


def heavy_tenants_and_vectors(chunks: DataFrame, embeddings: DataFrame, spaces: DataFrame, stock: DataFrame, tenant_share: float = 0.05, vector_share: float = 0.015) -> DataFrame:
    """Keys above their share: (key_field, key_value).

    ('tenant_id', tenant_id) for tenants with more than ``tenant_share`` of all
    distinct chunks; ('embedding', stock_id) for stock vectors carried by more
    than ``vector_share`` of all distinct chunks with a usable vector. Stock
    rows that hold the same vector are all reported. Repeated deliveries count
    once; NULL ids, tenants and vectors do not count.
    """
    tenants = tenant_shares(chunks).where(F.col("share") > tenant_share).select(F.lit("tenant_id").alias("key_field"), F.col("tenant_id").cast("bigint").alias("key_value"))
    named = stock.where(F.col("embedding").isNotNull()).select("stock_id", F.xxhash64("embedding").alias("vector"))
    vectors = vector_shares(embeddings, spaces).where(F.col("share") > vector_share).join(named, "vector").select(F.lit("embedding").alias("key_field"), F.col("stock_id").cast("bigint").alias("key_value"))
    return tenants.unionByName(vectors)


def tenant_profile(chunks: DataFrame, tenants: DataFrame, text_length: Column | None = None) -> DataFrame:
    """Per tenant, through the balanced join: (tenant_id, name, chunks, chars, longest).

    A chunk counts once, with the length of its latest delivery; a NULL text
    has length 0. Tenants without chunks have no row.
    """
    length = F.coalesce(F.length("text"), F.lit(0)) if text_length is None else text_length
    rows = chunks.where("id is not null and tenant_id is not null").select("id", "tenant_id", length.cast("bigint").alias("chars"), "loaded_at")
    once = rows.groupBy("id").agg(F.max_by(F.struct("tenant_id", "chars"), F.struct("loaded_at", "chars")).alias("c")).select("id", "c.tenant_id", "c.chars")
    joined = balanced_join(once, tenants.select(F.col("id").alias("tenant_id"), "name"), "tenant_id")
    return joined.groupBy("tenant_id", "name").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))
