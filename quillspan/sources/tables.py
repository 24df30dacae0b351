"""Tables written in a layout that prunes by tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 128


def bucket(tenant_id, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(tenant_id), F.lit(buckets)).cast("int")


def write_by_tenant(df: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Partitions by a hash of tenant_id; only the partitions that ``df`` has are replaced. Rows of a large tenant are spread over several files by id."""
    b = df.withColumn("tenant_bucket", bucket(F.col("tenant_id"), buckets))
    spread = F.pmod(F.xxhash64(*[c for c in ("id", "chunk_id") if c in df.columns] or ["tenant_id"]), F.lit(8))
    b.repartition("tenant_bucket", spread).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("tenant_bucket").parquet(path)


def read_tenant(spark: SparkSession, path: str, tenant_id: int, buckets: int = BUCKETS) -> DataFrame:
    """One tenant's rows; the literal partition filter leaves one folder to read."""
    value = spark.range(1).select(bucket(F.lit(tenant_id).cast("bigint"), buckets).alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("tenant_bucket") == value) & (F.col("tenant_id") == tenant_id)).drop("tenant_bucket")


def append_log(df: DataFrame, path: str, batch: str | int) -> None:
    """Adds rows to an append-only log (queries, citations, audit events) as the batch of that name; the same batch written again replaces itself and nothing else, so a repeated write adds no row twice."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def answered(answers: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, citations) to log of answers (query_id, tenant_id, user_id, question, cited array<int>) and the hits (query_id, rank, chunk_id, scores) they were given.

    Only cited passages are logged, each with its place in the answer's
    passages and its four scores, NULL where a half did not find it.
    """
    queries = answers.select(F.col("query_id").alias("id"), "tenant_id", "user_id", "question")
    seats = answers.select("query_id", "tenant_id", F.explode("cited").alias("rank"))
    score = lambda c: (F.col(c) if c in hits.columns else F.lit(None)).cast("double").alias(c)
    scores = hits.select("query_id", "rank", "chunk_id", *map(score, ("score", "lexical_score", "dense_score", "rerank")))
    return queries, seats.join(scores, ["query_id", "rank"]).select("query_id", "tenant_id", "chunk_id", "rank", "score", "lexical_score", "dense_score", F.col("rerank").alias("rerank_score"))


def audit_event(action, actor, target_type, target_id, **details):
    """Columns of one audit event: (action, actor_user_id, target_type, target_id, details as JSON).

    An event that a rule caused has a NULL actor, and one of the system itself
    a NULL target too; pass a NULL literal of the column's type for either.
    """
    body = F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])) if details else F.lit("{}")
    return [action.alias("action"), actor.alias("actor_user_id"), target_type.alias("target_type"), target_id.alias("target_id"), body.alias("details")]
