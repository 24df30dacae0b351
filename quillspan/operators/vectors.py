"""Vector spaces: projection, quantisation, pooling, coarse search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.core.workspace import stored
from quillspan.operators.retrieval import bounded, dense, near_topk, pair_cosines, ranked, scan_topk, width_guard


def second_moment(vectors: DataFrame, column: str = "embedding", centred: bool = False) -> tuple[np.ndarray, int]:
    """X'X / n of all rows, or the covariance; summed per task, so width * width numbers a task travel."""

    def part(batches):
        m, s, n = None, None, 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            if len(x):
                m = x.T @ x if m is None else m + x.T @ x
                s = x.sum(0) if s is None else s + x.sum(0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([m.tobytes()]), pa.array([s.tobytes()]), pa.array([n])], ["g", "m", "s", "n"])

    def join(t):
        out = {"g": [1], "n": [sum(t["n"].to_pylist())]}
        for c in ("m", "s"):
            total = np.frombuffer(t[c][0].as_py(), np.float64).copy()
            for v in t[c][1:]:
                total += np.frombuffer(v.as_py(), np.float64)
            out[c] = [total.tobytes()]
        return pa.table({c: out[c] for c in ("g", "m", "s", "n")})

    kind = "g bigint, m binary, s binary, n bigint"
    # In two steps: 32 workers merge the tasks' sums, one merges theirs.
    first = vectors.select(F.col(column).cast("array<double>")).where(F.col(column).isNotNull()).mapInArrow(part, kind).withColumn("h", F.spark_partition_id() % 32).groupBy("h").applyInArrow(lambda t: join(t), kind)
    row = first.groupBy("g").applyInArrow(join, kind).first()
    if row is None:
        return np.zeros((0, 0)), 0
    n = row["n"]
    m = np.frombuffer(row["m"], np.float64)
    m = m.reshape(int(len(m) ** 0.5), -1) / n
    if centred:
        mean = np.frombuffer(row["s"], np.float64) / n
        m = m - np.outer(mean, mean)
    return m, n


def basis(vectors: DataFrame, k: int, column: str = "embedding", centred: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(width x k axes, explained share of each): the leading eigenvectors, nested, so fewer axes are the first of more. Signs: the largest element is positive."""
    m, _ = second_moment(vectors, column, centred)
    values, axes = np.linalg.eigh(m)
    order = np.argsort(values)[::-1]
    values, axes = np.maximum(values[order], 0), axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes[:, :k], values[:k] / max(values.sum(), 1e-300)


def random_basis(width: int, k: int, seed: int = 0) -> np.ndarray:
    """A random orthonormal control for ``basis``."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))
    return q * np.sign(np.diag(r))


def project(vectors: DataFrame, axes: np.ndarray, id_col: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """(id, embedding) in the space of the axes; queries and passages go through the same map. NULL vectors have no row; a vector of another width than the axes fails the query, and so do no axes."""
    if not axes.size:
        raise ValueError("the space has no axes")
    known = vectors.sparkSession.sparkContext.broadcast(axes)
    vectors = width_guard(vectors.where(F.col(column).isNotNull()), column, len(axes))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            y = (x @ known.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))], [id_col, column])

    return vectors.select(F.col(id_col).cast("bigint").alias(id_col), F.col(column).cast("array<double>").alias(column)).mapInArrow(run, f"{id_col} bigint, {column} array<float>")


def half_precision(vectors: DataFrame, id_col: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """(id, embedding) with every element rounded to 16 bits."""

    def run(batches):
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(b.column(1).offsets if b.column(1).offset == 0 else pa.array(np.r_[0, np.cumsum(b.column(1).value_lengths().to_numpy())].astype(np.int32)), pa.array(values))], [id_col, column])

    return vectors.select(F.col(id_col).cast("bigint").alias(id_col), F.col(column).cast("array<float>").alias(column)).mapInArrow(run, f"{id_col} bigint, {column} array<float>")


def chunk_groups(chunks: DataFrame, size: int) -> DataFrame:
    """(chunk_id, document_id, gid): runs of ``size`` chunks of a document in reading order, unpaginated first."""
    order = Window.partitionBy("document_id").orderBy(F.col("page_num").asc_nulls_first(), "char_start", "id")
    return chunks.select(F.col("id").alias("chunk_id"), "document_id", F.floor((F.row_number().over(order) - 1) / size).alias("gid"))


def pooled(vectors: DataFrame, keys: list[str], how: str = "mean", column: str = "embedding") -> DataFrame:
    """One vector per group as rows (keys, position, value), positions from 0; partial aggregates, so a group of any size is never gathered."""
    e = vectors.select(*keys, F.posexplode(column).alias("position", "x"))
    value = F.avg(F.col("x").cast("double")) if how == "mean" else F.max(F.col("x").cast("double"))
    return e.groupBy(*keys, "position").agg(value.alias("value"))


def as_vectors(components: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, position, value) as (keys, embedding)."""
    return components.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]).alias("embedding"))


def coarse_to_fine(questions: DataFrame, members: DataFrame, open_groups: int, k: int) -> DataFrame:
    """Top k of the members of the ``open_groups`` nearest groups: (query_id, chunk_id, score, rank).

    ``members`` has (gid, chunk_id, embedding); groups are compared by the mean
    of their members, in one scan of the means.
    """
    means = as_vectors(pooled(members, ["gid"]), ["gid"]).withColumnRenamed("gid", "chunk_id")
    picked = dense(questions, means, open_groups).select("query_id", F.col("chunk_id").alias("gid"))
    asked = picked.join(bounded(questions.select("query_id", F.col("embedding").alias("q"))), "query_id")
    return ranked(pair_cosines(members.join(asked, "gid")), "score", k)


def hamming_rescored(questions: DataFrame, vectors: DataFrame, shortlist: int, k: int) -> DataFrame:
    """Shortlist by Hamming distance of sign bits, then exact cosine: (query_id, chunk_id, score, rank).

    The scan compares packed bits; the vectors are looked up for the shortlist only.
    """

    def scores(q, x, qid, cid):
        pack = lambda v: np.packbits(v > 0, axis=1)
        a, b = pack(q), pack(x)
        pad = (-a.shape[1]) % 8
        a, b = (np.ascontiguousarray(np.pad(v, ((0, 0), (0, pad)))).view(np.uint64) for v in (a, b))
        apart = np.zeros((len(a), len(b)), np.int32)
        for i in range(a.shape[1]):
            apart += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
        return -apart.astype(np.float32)

    near = ranked(scan_topk(questions, vectors, shortlist, scores), "score", shortlist).select("query_id", "chunk_id")
    full = near.join(vectors.select("chunk_id", "embedding"), "chunk_id").join(bounded(questions.select("query_id", F.col("embedding").alias("q"))), "query_id")
    return ranked(pair_cosines(full), "score", k)


def md5_order(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """A deterministic sample: the n rows whose id has the smallest md5; a larger sample contains a smaller one."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(n)


def md5_uniform(column):
    """A draw from [0, 1) by the first 32 bits of the md5 of a value."""
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def shares(df: DataFrame, whole: str, part: str, value: str) -> DataFrame:
    """(part, whole, value, of_<whole>, cumulative): each part's share of its whole, and the running share in the order of the parts."""
    w = Window.partitionBy(whole)
    total = F.sum(value).over(w)
    name = f"of_{whole.removesuffix('_id')}"
    return df.select(part, whole, value, F.round(F.col(value) / total, 9).alias(name), F.round(F.sum(value).over(w.orderBy(part)) / total, 9).alias("cumulative"))


def interpolated(pairs: DataFrame, weights: list[float], scaled: bool = True) -> DataFrame:
    """Points between neighbours: (a, b, weight, embedding) from pairs (a, b, va, vb), scaled to unit length unless told otherwise."""
    from quillspan.functions.vector import l2_normalised

    w = F.explode(F.array(*[F.lit(float(x)) for x in weights]))
    p = pairs.select("a", "b", "va", "vb", w.alias("weight"))
    mix = F.zip_with("va", "vb", lambda x, y: x.cast("double") * (1 - F.col("weight")) + y.cast("double") * F.col("weight"))
    return p.select("a", "b", "weight", (l2_normalised(mix) if scaled else mix).alias("embedding"))


def zipf_weights(spark, n: int, z: float) -> DataFrame:
    """(i, weight, cum): Zipf weights of n ranks, scaled to 1, with their running sum."""
    r = spark.range(1, n + 1).select(F.col("id").alias("i"), F.pow(F.col("id").cast("double"), F.lit(-float(z))).alias("w"))
    total = r.agg(F.sum("w").alias("t"))
    s = r.crossJoin(F.broadcast(total)).select("i", (F.col("w") / F.col("t")).alias("weight"))
    # n ranks, a parameter, form one running sum.
    return s.withColumn("cum", F.sum("weight").over(Window.orderBy("i")))


def inverse_cdf(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """Each draw (id, r) assigned the first rank whose running sum reaches it: a range join against the small side of ranks. Draws above the last sum get the last rank."""
    w = weights.select("i", "cum", F.lag("cum", 1, 0.0).over(Window.orderBy("i")).alias("low"), F.max("i").over(Window.partitionBy()).alias("top"))
    inside = (F.col("r") > F.col("low")) & ((F.col("r") <= F.col("cum")) | (F.col("i") == F.col("top"))) | ((F.col("i") == 1) & (F.col("r") <= 0))
    return draws.join(bounded(w), inside).select("id", F.col("i").alias("tenant_rank"))


def bucket_widening(chunks: DataFrame, buckets: int, key: str = "tenant_id") -> DataFrame:
    """How much a tenant's hash bucket holds beyond the tenant: (tenant_id, owned, in_bucket, sharing)."""
    per = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("owned")).withColumn("bucket", F.col(key) % buckets)
    b = per.groupBy("bucket").agg(F.sum("owned").alias("in_bucket"), F.count(F.lit(1)).alias("sharing"))
    return per.join(b, "bucket").select(key, "owned", "in_bucket", "sharing")


def widening(share: float, buckets: int) -> float:
    """The share of all rows that a tenant with ``share`` of them is expected to read from its bucket of ``buckets``."""
    return share + (1 - share) / buckets


def required_modulus(share: float, epsilon: float) -> int:
    """Hash buckets so that others add at most ``epsilon`` times what a tenant with that share of the rows owns."""
    return int(np.ceil((1 - share) / (epsilon * share)))


def inverted_lists(vectors: DataFrame, lists: int, seed: int = 1, column: str = "embedding") -> DataFrame:
    """(gid, chunk_id, embedding): vectors in k-means lists, as members for ``coarse_to_fine``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.select("chunk_id", F.col(column).cast("array<double>").alias("embedding")).withColumn("_v", array_to_vector("embedding"))
    model = KMeans(k=lists, seed=seed, maxIter=5, featuresCol="_v", predictionCol="gid").fit(v)
    return model.transform(v).select("gid", "chunk_id", "embedding")


def list_means(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, means) of the lists of (gid, embedding), by id; summed per task, so one row a list and task travels."""

    def part(batches):
        total: dict[int, tuple] = {}
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                of = b.column(0).to_numpy()
                for g in np.unique(of):
                    s, n = total.get(g, (0.0, 0))
                    total[g] = s + x[of == g].sum(0), n + int((of == g).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([s.tobytes() for s, _ in total.values()], pa.binary()), pa.array([n for _, n in total.values()], pa.int64())], ["gid", "s", "n"])

    def join(t):
        s = np.sum([np.frombuffer(v.as_py(), np.float64) for v in t["s"]], axis=0)
        return pa.table({"gid": t["gid"][:1], "s": pa.array([s.tobytes()], pa.binary()), "n": [sum(t["n"].to_pylist())]})

    kind = "gid bigint, s binary, n bigint"
    # In two steps, as in ``second_moment``.
    first = members.select(F.col("gid").cast("bigint"), F.col("embedding").cast("array<double>")).where("gid is not null and embedding is not null").mapInArrow(part, kind).withColumn("h", F.spark_partition_id() % 32)
    first = first.groupBy("gid", "h").applyInArrow(lambda t: join(t), kind)
    rows = sorted(first.groupBy("gid").applyInArrow(join, kind).collect(), key=lambda r: r["gid"])
    return np.array([r["gid"] for r in rows], np.int64), np.array([np.frombuffer(r["s"], np.float64) / r["n"] for r in rows])


def list_search(questions: DataFrame, members: DataFrame, opened: list[int], k: int) -> dict[int, DataFrame]:
    """Top k of the members of each number of nearest lists in ``opened``: (query_id, chunk_id, score, rank), as of ``coarse_to_fine``.

    For few lists of any length: the members are scanned once, by products of
    blocks, where ``coarse_to_fine`` joins each question with each member.
    """
    members = stored(members.select("gid", "chunk_id", "embedding"), "lists")
    means = list_means(members)
    near = stored(near_topk(questions, members, k, opened=opened, means=means), "near")
    return {n: ranked(near.where(F.col("opened") <= n).drop("opened"), "score", k) for n in opened}


def reprojected(embeddings: DataFrame, axes: np.ndarray, model: str, version: str) -> DataFrame:
    """Rows of a new space beside the old one: (chunk_id, embedding_model, embedding_version, embedding)."""
    return project(embeddings, axes).select("chunk_id", F.lit(model).alias("embedding_model"), F.lit(version).alias("embedding_version"), "embedding")


def activated(spaces: DataFrame, model: str, version: str) -> DataFrame:
    """The catalogue after a switch: the named space is active, the one active before is retired."""
    chosen = (F.col("model") == model) & (F.col("version") == version)
    return spaces.withColumn("status", F.when(chosen, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status")))
