"""Vectors as compact rows: which are usable, how they travel, and k-means over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "id bigint, rep bigint, v binary, more array<bigint>, spare boolean"
MORE = 10  # default of compact's ``more``
NAMES = ["id", "rep", "v", "more", "spare"]


def packed(x: np.ndarray, kind=np.float32) -> pa.Array:
    """Rows of a matrix as an Arrow binary column."""
    x = np.ascontiguousarray(x, dtype=kind)
    width = x.shape[1] * x.itemsize if x.ndim == 2 else 0
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def unpacked(column, width: int, kind=np.float32) -> np.ndarray:
    """The inverse of ``packed`` (no nulls in the column)."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            o = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[o[0] : o[-1]].view(kind).reshape(-1, width))
    return np.concatenate(parts) if parts else np.empty((0, width), kind)


def unit(x: np.ndarray) -> np.ndarray:
    x64 = x.astype(np.float64)
    n = np.sqrt((x64 * x64).sum(1, keepdims=True))
    return (x64 / np.where(n > 0, n, 1)).astype(np.float32)


def active_space(spaces: DataFrame) -> tuple[str, str, int]:
    """(model, version, dimension) of the newest active space. The catalogue has a few rows; one reaches the driver."""
    row = spaces.where("status = 'active'").orderBy(F.col("created_at").desc_nulls_last(), F.col("version").desc()).select("model", "version", "dimension").first()
    if row is None:
        raise ValueError("no embedding space is active")
    return row[0], row[1], int(row[2])


def compact(embeddings: DataFrame, spaces: DataFrame, stock: DataFrame | None = None, more: int = MORE) -> tuple[DataFrame, int]:
    """Usable vectors as (id, rep, v, more, spare) and their dimension.

    A vector is usable if it belongs to the active space, is not NULL, has the
    space's dimension, no NULL, NaN or infinite element, and is not all zeros;
    rows with a NULL id are dropped. With ``stock``, vectors equal value for
    value to a stock vector are left out. Copies of one vector within an Arrow
    batch travel once: the row with ``rep = id`` carries the vector, the other
    ids follow as rows without one, and a repeated delivery of the same id
    disappears. The column ``more`` lists the next smallest ids of the batch
    with that vector, as many as the argument says; rows of ids beyond these
    have ``spare`` set. A
    vector that a third of all rows repeat is thus one row per batch wherever
    vectors are compared. Empty input gives no rows.
    """
    model, version, width = active_space(spaces)
    e = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_version") == version) & F.col("embedding").isNotNull() & (F.size("embedding") == width) & F.col("chunk_id").isNotNull())
    e = e.select(F.col("chunk_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("e"))
    if stock is not None:
        s = stock.where(F.col("embedding").isNotNull()).select(F.col("embedding").cast("array<float>").alias("s"), F.xxhash64(F.col("embedding").cast("array<float>")).alias("h"))
        # The second condition is evaluated only where the hashes agree.
        e = e.withColumn("g", F.xxhash64("e")).join(s, (F.col("g") == F.col("h")) & ~((F.col("e") < F.col("s")) | (F.col("e") > F.col("s"))), "left_anti")

    def rows(batches):
        for b in batches:
            col = b.column(1)
            values = col.flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            x, ids = x[ok] + np.float32(0), ids[ok]
            if not len(x):
                continue
            _, first, back = np.unique(x.view(np.dtype((np.void, width * 4))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([back, ids], 1), axis=0)
            begin = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
            rep = pairs[begin, 1]
            place = np.arange(len(pairs)) - np.repeat(begin, np.diff(np.r_[begin, len(pairs)]))
            listed = pairs[(place > 0) & (place <= more)]
            offsets = np.r_[0, np.cumsum(np.bincount(listed[:, 0], minlength=len(rep)))].astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(listed[:, 1].copy()))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rep), packed(x[first]), others, pa.array(np.zeros(len(rep), bool))], NAMES)
            p, at = pairs[place > 0], place[place > 0]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 1].copy()), pa.array(rep[p[:, 0]]), pa.nulls(len(p), pa.binary()), pa.nulls(len(p), pa.list_(pa.int64())), pa.array(at > more)], NAMES)

    return e.select("id", "e").mapInArrow(rows, ROW), width


def nearest(x: np.ndarray, centres: np.ndarray, m: int = 1) -> np.ndarray:
    """The m nearest centres of each row, nearest first, by Euclidean distance."""
    m = min(m, len(centres))
    half = 0.5 * (centres * centres).sum(1)
    out = np.empty((len(x), m), np.int32)
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ centres.T - half
        if m == 1:
            out[a : a + 4096, 0] = s.argmax(1)
        else:
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
            out[a : a + 4096] = np.take_along_axis(top, order, 1)
    return out


def uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """A draw from [0, 1) per row that depends on the vector's value only."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), salt) for r in raw), np.uint64, len(x)) / 2.0**64


def kmeans(rows: DataFrame, width: int, k: int, seeding_rounds: int = 3, lloyd_rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Centres of spherical k-means over all vectors of ``rows`` (id, rep, v).

    Seeding is k-means|| (Bahmani et al. 2012): each round passes once over the
    data and draws rows independently with probability proportional to their
    squared distance from the candidates so far, about ``k`` a round; the
    candidates, weighted by the rows nearest to them, are then reduced to k by
    weighted k-means++ on the driver. Lloyd rounds sum per partition and merge
    the partial sums by blocks of centres, so the driver receives the k new
    centres only: k * width floats, whatever the number of rows. Draws depend
    on a vector's value, so the result is the same for any partitioning. Fewer
    distinct vectors than k give fewer centres; no vectors give none.
    """
    data = rows.where("v is not null").select("v")
    spark = rows.sparkSession
    start = data.select("v", F.xxhash64("v", F.lit(seed)).alias("h")).orderBy("h", "v").limit(1).collect()
    if not start:
        return np.empty((0, width), np.float32)
    centres = unit(np.frombuffer(start[0]["v"], np.float32).reshape(1, -1))
    total = float(data.count())
    cost = 2.0 * total
    for r in range(seeding_rounds):
        known = spark.sparkContext.broadcast(centres)

        def draw(batches, r=r, known=known, cost=cost):
            spent = 0.0
            for b in batches:
                x = unit(unpacked(b.column(0), width))
                c = known.value
                d = np.empty(len(x))
                for a in range(0, len(x), 4096):
                    d[a : a + 4096] = np.maximum(0, 2 - 2 * (x[a : a + 4096] @ c.T).max(1))
                spent += d.sum()
                hit = uniform(x, seed + 1 + r) < k * d / max(cost, 1e-12)
                yield pa.RecordBatch.from_arrays([packed(x[hit]), pa.nulls(int(hit.sum()), pa.float64())], ["v", "cost"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([spent])], ["v", "cost"])

        got = data.mapInArrow(draw, "v binary, cost double").groupBy("v").agg(F.sum("cost").alias("cost")).collect()
        new = [np.frombuffer(g["v"], np.float32) for g in got if g["v"] is not None]
        cost = sum(g["cost"] for g in got if g["v"] is None) or 0.0
        known.unpersist()
        if new:
            centres = np.concatenate([centres, np.stack(sorted(new, key=lambda v: v.tobytes()))])
        if cost <= 1e-9 * total:
            break
    _, weight = _moments(data, centres, width)
    centres = _reduced(centres, weight, k, seed)
    for _ in range(lloyd_rounds):
        sums, count = _moments(data, centres, width)
        centres = unit(np.where(count[:, None] > 0, sums, centres))
    return centres


MERGED_PARTS = 32


def merged_sums(partial: DataFrame, key: str, columns: dict[str, np.dtype]) -> DataFrame:
    """Sums of packed arrays (key, columns) over all tasks: (key, columns).

    Merged in two steps, tasks modulo 32 first, so a key's last merge reads at
    most 32 arrays and its first a thirty-second of the tasks' arrays.
    """

    def add(t):
        out = {key: t[key][:1]}
        for c, kind in columns.items():
            total = np.frombuffer(t[c][0].as_py(), kind).copy()
            for x in t[c][1:]:
                total += np.frombuffer(x.as_py(), kind)
            out[c] = pa.array([total.tobytes()], pa.binary())
        return pa.table(out)

    kind = f"{key} bigint, " + ", ".join(f"{c} binary" for c in columns)
    some = partial.withColumn("_part", F.spark_partition_id() % MERGED_PARTS)
    first = some.groupBy(key, "_part").applyInArrow(lambda t: add(t), kind)
    return first.groupBy(key).applyInArrow(add, kind)


def _moments(data: DataFrame, centres: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per centre the sum of its rows and their number."""
    known = data.sparkSession.sparkContext.broadcast(centres)
    k, block = len(centres), 256

    def part(batches):
        c = known.value
        sums, count = np.zeros((k, width)), np.zeros(k, np.int64)
        for b in batches:
            x = unit(unpacked(b.column(0), width))
            home = nearest(x, c)[:, 0]
            order = np.argsort(home, kind="stable")
            at, begin = np.unique(home[order], return_index=True)
            if len(at):
                sums[at] += np.add.reduceat(x[order].astype(np.float64), begin, axis=0)
                count += np.bincount(home, minlength=k)
        for a in range(0, k, block):
            if count[a : a + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([sums[a : a + block].tobytes()]), pa.array([count[a : a + block].tobytes()])], ["a", "s", "n"])

    sums, count = np.zeros((k, width)), np.zeros(k, np.int64)
    for g in merged_sums(data.mapInArrow(part, "a bigint, s binary, n binary"), "a", {"s": np.float64, "n": np.int64}).collect():
        sums[g["a"] : g["a"] + block] = np.frombuffer(g["s"], np.float64).reshape(-1, width)
        count[g["a"] : g["a"] + block] = np.frombuffer(g["n"], np.int64)
    known.unpersist()
    return sums, count


def counts(rows: DataFrame, centres: np.ndarray, width: int, probes: int = 1) -> np.ndarray:
    """For each centre and each of the first ``probes`` places, the rows that have the centre there among their nearest: (centres x probes)."""
    known = rows.sparkSession.sparkContext.broadcast(centres)
    k = len(centres)
    m = min(probes, k)

    def part(batches):
        n = np.zeros((k, m), np.int64)
        for b in batches:
            near = nearest(unit(unpacked(b.column(0), width)), known.value, m)
            for j in range(m):
                n[:, j] += np.bincount(near[:, j], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([n.tobytes()])], ["a", "n"])

    got = merged_sums(rows.where("v is not null").select("v").mapInArrow(part, "a bigint, n binary"), "a", {"n": np.int64}).collect()
    known.unpersist()
    return np.frombuffer(got[0]["n"], np.int64).reshape(k, m) if got else np.zeros((k, m), np.int64)


def _reduced(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the candidates, which number a few times k."""
    keep = weight > 0
    c, w = candidates[keep], weight[keep].astype(float)
    if len(c) <= k:
        return c
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(c), p=w / w.sum()))]
    d = np.maximum(0, 2 - 2 * (c @ c[chosen[0]]))
    for _ in range(k - 1):
        p = d * w
        if p.sum() <= 0:
            break
        nxt = int(rng.choice(len(c), p=p / p.sum()))
        chosen.append(nxt)
        d = np.minimum(d, np.maximum(0, 2 - 2 * (c @ c[nxt])))
    return c[chosen]
