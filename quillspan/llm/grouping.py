"""Problem 1: clusters of mutually similar vectors.

Method: vectors become weighted features (embeddings as they are; texts by
signed feature hashing of their words, ``hashed_features``), k-means with
parallel oversampled seeding divides all of them into about sqrt(n) cells, and
every vector is compared, exactly, with all vectors at home in one of its
``probes`` nearest cells. Links at or above the threshold are merged into
components. A pair is missed only if the nearest cell of neither is among the
nearest of the other; components hide nearly all of these misses, since a
member needs one link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.core.components import connected_components
from quillspan.core.workspace import stored
from quillspan.llm.vectors import compact, counts, kmeans, merged_sums, nearest, packed, uniform, unit, unpacked

TASK_BYTES, TASK_PAIRS = 4 << 20, 4_000_000_000
HALF = 1.1e-3
BROADCAST_PAIRS = 500_000


def hashed_features(texts: DataFrame, id_col: str, text_col: str, width: int = 64, weights: DataFrame | None = None) -> DataFrame:
    """Texts as unit vectors (id, features array<float>) by signed feature hashing.

    Each word (a run of letters or digits, lower case) adds +-(1 + ln tf) times
    its weight to one of ``width`` slots, both chosen by its hash; ``weights``
    (word, weight) may give inverse document frequencies and is joined, not
    broadcast by hand. NULL, empty and wordless texts have no row.
    """
    words = texts.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.expr(f"regexp_extract_all(lower({text_col}), '[\\\\p{{L}}\\\\p{{N}}]+', 0)")).alias("word"))
    tf = words.groupBy("id", "word").agg((1 + F.log(F.count(F.lit(1)))).alias("w"))
    if weights is not None:
        tf = tf.join(weights, "word").withColumn("w", F.col("w") * F.col("weight"))
    h = F.xxhash64("word")
    slots = tf.groupBy("id", F.pmod(h, F.lit(width)).cast("int").alias("slot")).agg(F.sum(F.when(F.shiftrightunsigned(h, 32) % 2 == 0, F.col("w")).otherwise(-F.col("w"))).alias("w"))
    rows = slots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return rows.where("n > 0").select("id", F.expr(f"transform(sequence(0, {width - 1}), i -> cast(coalesce(m[i], 0) / n as float))").alias("features"))


def _links(rows: DataFrame, width: int, centres: np.ndarray, held: np.ndarray, min_similarity: float, cell_limit: int) -> DataFrame:
    """Edges (src, dst) that join all rows with a link in which one's nearest cell is among the probed cells of the other.

    ``held`` has, for each cell, how many rows have it at each place among
    their nearest (``vectors.counts``). A cell compares the rows at home in it
    with each other and with its visitors; visitors are not compared among
    themselves, so a cell that all rows have as their second nearest costs no
    more than its few residents. Residents and visitors beyond ``cell_limit``
    are cut into parts by a hash of the vector, and every part of the residents
    meets every part of both, so no task holds more than about twice the limit.
    Unit vectors travel in half precision, whose cosine is off by less than
    ``HALF``; what lies nearer the threshold and joins two clusters is decided
    in double precision on the stored values.
    """
    spark = rows.sparkSession
    probes = held.shape[1]
    parts = np.maximum(1, np.ceil(np.stack([held[:, 0], held.sum(1)], 1) / cell_limit)).astype(np.int32)
    known = spark.sparkContext.broadcast((centres, parts))
    tasks = int(max(12, math.ceil(held.sum() * width * 2 / TASK_BYTES), math.ceil((held[:, 0] * held.sum(1).astype(float)).sum() / TASK_PAIRS)))

    def send(batches):
        c, cut = known.value
        for b in batches:
            x = unpacked(b.column(1), width)
            near = nearest(unit(x), c, probes)
            u = uniform(x, 99) if (cut[near] > 1).any() else np.zeros(len(x))
            r, place = (a.ravel() for a in np.indices(near.shape))
            cell = near.ravel()
            # A row in part i of the residents goes to (i, j) for every part j; any row, in part j of all, goes to (i, j) for every i.
            own_i, own_j = (u[r] * cut[cell, 0]).astype(np.int32), (u[r] * cut[cell, 1]).astype(np.int32)
            times = cut[cell, 0]
            rr, cc, pp, jj, home = (np.repeat(v, times) for v in (r, cell, place, own_j, own_i))
            ii = np.arange(len(rr)) - np.repeat(np.cumsum(times) - times, times)
            resident = (pp == 0) & (ii == home)
            out = [(rr, cc, ii, jj, resident)]
            at_home = place == 0
            times = cut[cell, 1] * at_home
            r2, c2, i2, j2 = (np.repeat(v, times) for v in (r, cell, own_i, own_j))
            j_all = np.arange(len(r2)) - np.repeat(np.cumsum(times) - times, times)
            far = j_all != j2
            out.append((r2[far], c2[far], i2[far], j_all[far], np.ones(int(far.sum()), bool)))
            rr, cc, ii, jj, resident = (np.concatenate(v) for v in zip(*out))
            visits = np.ones(len(rr), bool)
            visits[len(out[0][0]) :] = False
            yield pa.RecordBatch.from_arrays([pa.array(cc.astype(np.int32)), pa.array(ii.astype(np.int32)), pa.array(jj.astype(np.int32)), b.column(0).take(pa.array(rr)), packed(unit(x)[rr], np.float16), pa.array(resident), pa.array(visits)], ["cell", "a", "b", "id", "v", "resident", "visits"])

    def compare(table):
        ids = table["id"].to_numpy()
        x = unpacked(table["v"], width, np.float16).astype(np.float32)
        home, others = np.flatnonzero(table["resident"].to_numpy()), np.flatnonzero(table["visits"].to_numpy())
        label = np.arange(len(x))
        unsure = [np.zeros((0, 2), np.int64)]
        for a in range(0, len(home), 512):
            s = x[home[a : a + 512]] @ x[others].T
            i, j = np.nonzero(s >= min_similarity - HALF)
            sure = s[i, j] >= min_similarity + HALF
            i, j = home[i + a], others[j]
            unsure.append(np.stack([i[~sure], j[~sure]], 1))
            label = _merge(label, i[sure], j[sure])
        label = _flat(label)
        near = np.concatenate(unsure)
        near = np.unique(np.sort(ids[near[label[near[:, 0]] != label[near[:, 1]]]], axis=1), axis=0)
        near = near[near[:, 0] != near[:, 1]]
        smallest = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, ids)
        root = smallest[label]
        out = root != ids
        return pa.table({"src": np.r_[ids[out], near[:, 0]], "dst": np.r_[root[out], near[:, 1]], "sure": np.r_[np.ones(int(out.sum()), bool), np.zeros(len(near), bool)]})

    def decide(batches):
        for b in batches:
            p, q = (unpacked(b.column(i), width).astype(np.float64) for i in (2, 3))
            ok = (p * q).sum(1) >= min_similarity * np.sqrt((p * p).sum(1) * (q * q).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(ok))

    full = rows.where("v is not null").select("id", "v")
    cells = full.mapInArrow(send, "cell int, a int, b int, id bigint, v binary, resident boolean, visits boolean").repartition(tasks, "cell", "a", "b")
    found = stored(cells.groupBy("cell", "a", "b").applyInArrow(compare, "src bigint, dst bigint, sure boolean"), "links")
    open_ = found.where("not sure").select("src", "dst").distinct()
    ends = open_.select(F.col("src").alias("id")).union(open_.select(F.col("dst").alias("id"))).distinct()
    # Ends are sent to the vectors while they are few, so that the vectors stay where they are.
    vector = full.join(F.broadcast(ends) if open_.count() <= BROADCAST_PAIRS else ends, "id", "left_semi").groupBy("id").agg(F.first("v").alias("v"))
    pairs = open_.join(vector.select(F.col("id").alias("src"), F.col("v").alias("p")), "src").join(vector.select(F.col("id").alias("dst"), F.col("v").alias("q")), "dst")
    decided = pairs.select("src", "dst", "p", "q").mapInArrow(decide, "src bigint, dst bigint")
    copies = rows.where("v is null").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    return found.where("sure").select("src", "dst").unionByName(decided).unionByName(copies)


def _flat(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the pairs (i, j) into a forest of smallest labels."""
    label = _flat(label)
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        label = _flat(label)
    return label


def similarity_clusters(embeddings: DataFrame, spaces: DataFrame, stock: DataFrame | None = None, min_similarity: float = 0.85, min_size: int = 3, probes: int = 8, cell_limit: int = 20_000) -> DataFrame:
    """Members of all clusters of linked vectors: (cluster_id, chunk_id).

    Two usable vectors (see ``vectors.compact``) are linked if their cosine is
    at least ``min_similarity``; a cluster is a component of at least
    ``min_size`` chunks and is named by its smallest chunk_id. Repeated
    deliveries count once; chunks with equal vectors are linked, however many.
    The cosine is decided in double precision on the stored values wherever
    half precision is near the threshold. NULL or unusable vectors, NULL ids
    and extra columns are ignored; an empty table gives no rows.
    """
    rows, width = compact(embeddings, spaces, stock)
    rows = stored(rows, "vectors")
    n = rows.where("v is not null").count()
    centres = kmeans(rows, width, max(1, math.isqrt(n)))
    spark = rows.sparkSession
    if not len(centres):
        return spark.createDataFrame([], "cluster_id bigint, chunk_id bigint")
    members = connected_components(_links(rows, width, centres, counts(rows, centres, width, probes), min_similarity, cell_limit))
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return members.join(sized, "component").select(F.col("component").alias("cluster_id"), F.col("node").alias("chunk_id"))


def cluster_profiles(members: DataFrame, embeddings: DataFrame, spaces: DataFrame, typical: int = 3) -> DataFrame:
    """Each cluster's size and its ``typical`` members nearest its centroid: (cluster_id, size, rank, chunk_id, cosine).

    The centroid is the normalised mean of the members' unit vectors, summed
    per batch first, so a cluster of any size is never gathered. Ties in the
    cosine, rounded to six digits, go to the smaller chunk_id.
    """
    rows, width = compact(embeddings, spaces)
    rows = stored(rows, "vectors")
    full = rows.select("id", "rep").join(rows.where("v is not null").select(F.col("id").alias("rep"), "v").groupBy("rep").agg(F.first("v").alias("v")), "rep").groupBy("id").agg(F.first("v").alias("v"))
    m = stored(members.select("cluster_id", F.col("chunk_id").alias("id")).join(full, "id").select("cluster_id", "id", "v"), "members")
    return _profiles(m, width, typical)


def _profiles(m: DataFrame, width: int, typical: int) -> DataFrame:
    def partial(batches):
        for b in batches:
            c = b.column(0).to_numpy()
            x = unit(unpacked(b.column(2), width)).astype(np.float64)
            order = np.argsort(c, kind="stable")
            u, begin = np.unique(c[order], return_index=True)
            if len(u):
                s = np.add.reduceat(x[order], begin, axis=0)
                n = np.diff(np.r_[begin, len(c)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array([r.tobytes() for r in np.c_[s, n]])], ["cluster_id", "s"])

    def centred(batches):
        for b in batches:
            s = np.stack([np.frombuffer(r, np.float64) for r in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, width + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), packed(unit(s[:, :width])), pa.array(s[:, width].astype(np.int64))], ["cluster_id", "centre", "size"])

    def score(batches):
        for b in batches:
            x, c = unit(unpacked(b.column(2), width)), unpacked(b.column(3), width)
            cos = np.round((x.astype(np.float64) * c).sum(1), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(cos)], ["cluster_id", "chunk_id", "size", "cosine"])

    # A cluster's sums come from as many batches as it has rows in, a hot one from all: merged in two steps.
    sums = merged_sums(m.mapInArrow(partial, "cluster_id bigint, s binary"), "cluster_id", {"s": np.float64})
    centre = sums.mapInArrow(centred, "cluster_id bigint, centre binary, size bigint")
    scored = m.join(centre, "cluster_id").select("cluster_id", "id", "v", "centre", "size").mapInArrow(score, "cluster_id bigint, chunk_id bigint, size bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("cosine").desc(), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= typical).select("cluster_id", "size", "rank", "chunk_id", "cosine")


def kmeans_groups(embeddings: DataFrame, spaces: DataFrame, k: int | None = None, typical: int = 3) -> DataFrame:
    """The k-means division itself: every usable vector in its nearest cell, each cell with size and typical members.

    Returns (cluster_id, size, rank, chunk_id, cosine) with cluster_id the
    position of the centre. All usable vectors count, stock included; copies
    of a vector are counted as often as chunks carry it. k defaults to
    sqrt(n). An empty table gives no rows.
    """
    rows, width = compact(embeddings, spaces)
    rows = stored(rows, "vectors")
    centres = kmeans(rows, width, k or max(1, math.isqrt(rows.where("v is not null").count())))
    if not len(centres):
        return rows.sparkSession.createDataFrame([], "cluster_id bigint, size bigint, rank int, chunk_id bigint, cosine double")
    known = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            x = unpacked(b.column(1), width)
            yield pa.RecordBatch.from_arrays([pa.array(nearest(unit(x), known.value)[:, 0].astype(np.int64)), b.column(0), b.column(1)], ["cluster_id", "rep", "v"])

    # One vector per rep: the same chunk may have arrived in two batches.
    cells = rows.where("v is not null").select("id", "v").mapInArrow(assign, "cluster_id bigint, rep bigint, v binary").groupBy("rep").agg(F.first("cluster_id").alias("cluster_id"), F.first("v").alias("v"))
    m = rows.select("id", "rep").distinct().join(cells, "rep").groupBy("id").agg(F.first("cluster_id").alias("cluster_id"), F.first("v").alias("v")).select("cluster_id", "id", "v")
    return _profiles(stored(m, "cells"), width, typical)



