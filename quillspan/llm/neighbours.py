"""Problem 3: the most similar vectors of every vector.

Method: all vectors are divided into shards of a bounded number of rows by
nearest centre; each shard holds a robust-pruned directed graph
(``graph_index.ShardGraph``) built by greedy searches and relaxed distance
pruning; every query beam-searches its own shard and those of the next nearest
centres, and the shards' answers are merged. The similarities that come out
are exact, computed in double precision on the stored values; what may be lost
is a neighbour that no beam reached.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.core.workspace import stored
from quillspan.llm.graph_index import ShardGraph
from quillspan.llm.vectors import MORE, compact, counts, kmeans, nearest, packed, uniform, unit, unpacked

FIT_ROWS_PER_SHARD = 64


def vector_neighbours(
    embeddings: DataFrame,
    spaces: DataFrame,
    stock: DataFrame | None = None,
    top: int = 5,
    min_similarity: float | None = None,
    queries: Callable[[Column], Column] | None = None,
    shard_rows: int = 2000,
    probes: int = 3,
    degree: int = 48,
    beam: int = 20,
    search_beam: int = 16,
    alpha: float = 1.1,
) -> DataFrame:
    """For each usable vector its ``top`` most similar others: (chunk_id, neighbour_id, cosine, rank).

    Usable vectors are those of ``vectors.compact``; every one is indexed.
    ``queries`` turns an id column into a predicate that chooses the chunks
    answered for (default: all). ``min_similarity`` leaves out neighbours below
    it before anything is shuffled. Equal cosines go to the smaller
    neighbour_id; chunks with equal vectors are each other's nearest. A chunk
    is never its own neighbour. NULL ids, unusable vectors and extra columns
    are ignored; with fewer than two usable vectors there are no rows.

    Shards have about max(shard_rows, 4 sqrt(n)) rows. Their centres are fitted
    by k-means on a sample of ``FIT_ROWS_PER_SHARD`` rows a shard, chosen by a
    hash of the vector; a shard that receives more than twice its share is cut
    into parts by a hash of the vector, and queries visit all parts, so a
    region that holds a third of all rows makes more tasks, not longer ones.
    """
    more = max(MORE, top)
    rows, width = compact(embeddings, spaces, stock, more)
    rows = stored(rows, "vectors")
    spark = rows.sparkSession
    n = rows.where("v is not null").count()
    size = max(shard_rows, 4 * math.isqrt(n))
    k = max(1, math.ceil(n / size))
    share = min(1.0, FIT_ROWS_PER_SHARD * k / max(n, 1))
    fitted = kmeans(rows.where((F.col("v").isNotNull()) & (F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)), width, k, seeding_rounds=2, lloyd_rounds=3)
    if not len(fitted):
        return spark.createDataFrame([], "chunk_id bigint, neighbour_id bigint, cosine double, rank int")
    parts = np.maximum(1, np.ceil(counts(rows, fitted, width)[:, 0] / (2 * size))).astype(np.int32)
    known = spark.sparkContext.broadcast((fitted, parts))

    def send(batches):
        c, cut = known.value
        for b in batches:
            x = unpacked(b.column(1), width)
            asked = b.column(3).to_numpy(zero_copy_only=False)
            near = nearest(unit(x), c, probes)
            own = (uniform(x, 5) * cut[near[:, 0]]).astype(np.int32) if (cut[near] > 1).any() else np.zeros(len(x), np.int32)
            r, place = (a.ravel() for a in np.indices(near.shape))
            shard = near.ravel()
            go = asked[r] | (place == 0)
            r, place, shard = r[go], place[go], shard[go]
            times = np.where(asked[r], cut[shard], 1)
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            r, place, shard = np.repeat(r, times), np.repeat(place, times), np.repeat(shard, times)
            part = np.where(asked[r], part, own[r]).astype(np.int32)
            home = (place == 0) & (part == own[r])
            at = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part), pa.array(home), b.column(0).take(at), packed(x[r]), b.column(2).take(at), pa.array(asked[r])], ["shard", "part", "home", "id", "v", "more", "asked"])

    def answer(table):
        raw = unpacked(table["v"], width)
        home, asked = table["home"].to_numpy(), table["asked"].to_numpy()
        _, first, cls = np.unique(raw.view(np.dtype((np.void, width * 4))).ravel(), return_index=True, return_inverse=True)
        # The ids of each distinct vector, smallest first.
        more = table["more"].combine_chunks()
        extra = np.diff(more.offsets.to_numpy())
        pairs = np.concatenate([np.stack([cls, table["id"].to_numpy()], 1), np.stack([np.repeat(cls, extra), more.flatten().to_numpy()], 1)])
        pairs = np.unique(pairs, axis=0)
        begin = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
        many = np.diff(np.r_[begin, len(pairs)])
        wide = min(int(many.max()), top + 1)
        ids = np.full((len(first), wide), -1, np.int64)
        place = np.arange(len(pairs)) - np.repeat(begin, many)
        ids[pairs[place < wide, 0], place[place < wide]] = pairs[place < wide, 1]
        has = np.arange(wide) < many[:, None]

        is_home, is_query = np.zeros(len(first), bool), np.zeros(len(first), bool)
        is_home[cls[home]] = True
        is_query[cls[asked]] = True
        base, q = np.flatnonzero(is_home), np.flatnonzero(is_query)
        x = unit(raw[first])
        got, sim = ShardGraph(x[base], degree, beam, alpha).search(x[q], top + 1, max(search_beam, top + 1))
        y = raw[first].astype(np.float64)
        y /= np.sqrt((y * y).sum(1, keepdims=True))
        hit = base[np.where(got >= 0, got, 0)] if len(base) else np.zeros(got.shape, int)
        cos = np.clip(np.einsum("qd,qkd->qk", y[q], y[hit]), -1, 1) if len(base) else np.zeros(got.shape)
        ok = got >= 0
        if min_similarity is not None:
            ok &= cos >= min_similarity
        # One row per asked id and per id of the vectors found.
        qi, ki = np.nonzero(ok)
        c, found, score = q[qi], hit[qi, ki], np.where(q[qi] == hit[qi, ki], 1.0, cos[qi, ki])
        rep = np.repeat(np.arange(len(c)), many[c])
        src = pairs[np.repeat(begin[c], many[c]) + (np.arange(len(rep)) - np.repeat(np.cumsum(many[c]) - many[c], many[c])), 1]
        e, s = np.nonzero(has[found[rep]])
        a, b, w = src[e], ids[found[rep[e]], s], score[rep[e]]
        keep = a != b
        a, b, w = a[keep], b[keep], w[keep]
        order = np.lexsort((b, -w, a))
        a, b, w = a[order], b[order], w[order]
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
        nth = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
        keep = nth < top
        return pa.table({"chunk_id": a[keep], "neighbour_id": b[keep], "cosine": w[keep]})

    asked = F.lit(True) if queries is None else queries(F.col("id")) | F.exists("more", queries) | (F.size("more") == more)
    sent = rows.where("v is not null").select("id", "v", "more", asked.alias("asked")).mapInArrow(send, "shard int, part int, home boolean, id bigint, v binary, more array<bigint>, asked boolean").repartition(max(12, int(parts.sum())), "shard", "part")
    found = sent.groupBy("shard", "part").applyInArrow(answer, "chunk_id bigint, neighbour_id bigint, cosine double")
    # A batch's ids beyond those its vector lists have other copies as neighbours: the listed ones.
    spare = rows.where("spare").select("id", "rep")
    if spare.limit(1).count():
        found = stored(found, "found")
        equal = spare.join(found.where("cosine >= 1"), spare["rep"] == F.col("chunk_id")).select("id", "neighbour_id", "cosine")
        own = spare.select("id", F.col("rep").alias("neighbour_id"), F.lit(1.0).alias("cosine"))
        found = found.unionByName(equal.unionByName(own).where("id <> neighbour_id").withColumnRenamed("id", "chunk_id")).distinct()
    if queries is not None:
        found = found.where(queries(F.col("chunk_id")))
    best = Window.partitionBy("chunk_id").orderBy(F.col("cosine").desc(), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("chunk_id", "neighbour_id", "cosine", "rank")
