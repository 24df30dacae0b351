"""Similarity clusters (p1) and neighbours (p3)."""

import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import grouping, neighbours, vectors
from quillspan.llm.graph_index import ShardGraph

RNG = np.random.default_rng(5)


def clumps(centres=30, members=8, noise=200, width=8, spread=0.08):
    c = RNG.standard_normal((centres, width))
    x = np.concatenate([np.repeat(c, members, 0) * RNG.uniform(0.5, 2, (centres * members, 1)) + spread * RNG.standard_normal((centres * members, width)), RNG.standard_normal((noise, width))])
    return x.astype(np.float32)


def brute_clusters(ids, x, limit=0.85, least=3):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= limit
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), set()).add(ids[i])
    return {(min(g), m) for g in groups.values() if len(g) >= least for m in g}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_packed_round_trip():
    x = RNG.standard_normal((7, 8)).astype(np.float32)
    col = vectors.packed(x)
    assert np.array_equal(vectors.unpacked(col, 8), x)
    assert np.array_equal(vectors.unpacked(col.slice(2, 3), 8), x[2:5])
    assert vectors.unpacked(pa.chunked_array([col, col]), 8).shape == (14, 8)


def test_clusters_equal_brute_force(spark, embedded, spaces):
    x = clumps()
    ids = [int(i) for i in RNG.permutation(5000)[: len(x)]]
    got = rows(grouping.similarity_clusters(embedded(list(zip(ids, x))), spaces))
    assert got == brute_clusters(ids, x)


def test_cells_over_the_limit_are_cut_without_losing_links(spark, embedded, spaces):
    x = clumps(centres=10, members=10, noise=30)
    ids = list(range(len(x)))
    got = rows(grouping.similarity_clusters(embedded(list(zip(ids, x))), spaces, cell_limit=15))
    assert got == brute_clusters(ids, x)


def test_unusable_vectors_copies_and_stock(spark, embedded, spaces, stock):
    a, b = [1, 0, 0, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0]
    data = [(10, a), (11, a), (12, a), (12, a), (13, None), (14, [0] * 8), (15, a[:7]), (16, [float("nan")] + a[1:]), (17, [None] + a[1:]), (None, a)] + [(i, b) for i in range(20, 60)]
    found = rows(grouping.similarity_clusters(embedded(data), spaces, stock([(1, "t", b), (2, "u", None)])))
    assert found == {(10, 10), (10, 11), (10, 12)}
    everything = rows(grouping.similarity_clusters(embedded(data).repartition(3), spaces))
    assert everything == found | {(20, i) for i in range(20, 60)}
    assert rows(grouping.similarity_clusters(embedded([(1, a)] * 3, version="0"), spaces)) == set()


def test_clusters_of_nothing(spark, embedded, spaces):
    empty = embedded([(1, [1.0] * 8)]).where("false")
    assert grouping.similarity_clusters(empty, spaces).collect() == []
    assert neighbours.vector_neighbours(empty, spaces).collect() == []
    assert grouping.kmeans_groups(empty, spaces).collect() == []
    with pytest.raises(ValueError):
        vectors.active_space(spaces.where("false"))


def test_extra_columns_with_clashing_names(spark, embedded, spaces):
    from pyspark.sql import functions as F

    e = embedded([(i, [1, 0, 0, 0, 0, 0, 0, i / 100]) for i in range(4)]).withColumns({"id": F.lit(7), "rep": F.lit("x"), "v": F.lit(1), "cell": F.lit(0), "h": F.lit(1), "s": F.lit(2)})
    assert rows(grouping.similarity_clusters(e, spaces)) == {(0, i) for i in range(4)}
    assert neighbours.vector_neighbours(e, spaces, top=1).count() == 4


def test_profiles_list_members_nearest_the_centroid(spark, embedded, spaces):
    e = embedded([(1, [1, 0, 0, 0, 0, 0, 0, 0]), (2, [1, 0.1, 0, 0, 0, 0, 0, 0]), (3, [1, -0.1, 0, 0, 0, 0, 0, 0]), (4, [1, 0.4, 0, 0, 0, 0, 0, 0]), (4, [1, 0.4, 0, 0, 0, 0, 0, 0])])
    p = grouping.cluster_profiles(grouping.similarity_clusters(e, spaces), e, spaces, typical=2).orderBy("rank").collect()
    assert [(r["cluster_id"], r["size"], r["chunk_id"]) for r in p] == [(1, 4, 2), (1, 4, 1)]


def test_kmeans_groups_hold_every_vector(spark, embedded, spaces):
    x = clumps()
    p = grouping.kmeans_groups(embedded(list(enumerate(x))), spaces, k=12, typical=1).collect()
    assert len(p) <= 12 and sum(r["size"] for r in p) == len(x)


def test_kmeans_does_not_depend_on_partitions(spark, embedded, spaces):
    e = embedded(list(enumerate(clumps())))
    one, two = (vectors.kmeans(vectors.compact(d, spaces)[0], 8, 10) for d in (e.coalesce(1), e.repartition(5)))
    assert np.allclose(one, two, atol=1e-5)


def test_hashed_features(spark):
    t = spark.createDataFrame([(1, "alpha beta beta"), (2, "Beta, BETA alpha!"), (3, "gamma"), (4, None), (5, "  ")], "id bigint, text string")
    f = {r["id"]: np.array(r["features"]) for r in grouping.hashed_features(t, "id", "text", 32).collect()}
    assert set(f) == {1, 2, 3}
    assert np.allclose(f[1], f[2]) and abs(np.linalg.norm(f[1]) - 1) < 1e-6 and abs(f[1] @ f[3]) < 0.99


def brute_top(x, k):
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], -np.sort(-s, axis=1)[:, :k]


def test_graph_recall():
    x = RNG.standard_normal((3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, sims = ShardGraph(x).search(x, 6, 40)
    want, _ = brute_top(x, 5)
    assert np.mean([len(set(g) & set(w)) / 5 for g, w in zip(got, want)]) > 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 40])
def test_small_graphs_are_exact(n):
    x = RNG.standard_normal((n, 8)).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    got, _ = ShardGraph(x).search(x, 3)
    for i in range(n):
        want = np.argsort(-(x @ x[i]), kind="stable")[: min(3, n)]
        assert list(got[i][: len(want)]) == list(want) and (got[i][len(want) :] == -1).all()


def test_neighbours_recall_over_shards(spark, embedded, spaces):
    x = clumps(centres=150, members=7, noise=900)
    near = neighbours.vector_neighbours(embedded(list(enumerate(x))), spaces, top=5, shard_rows=200).collect()
    want, sim = brute_top(x, 5)
    got = {}
    for r in near:
        got.setdefault(r["chunk_id"], {})[r["rank"]] = (r["neighbour_id"], r["cosine"])
    close = [(i, j) for i in range(len(x)) for j, s in zip(want[i], sim[i]) if s >= 0.85]
    hit = sum(j in {v[0] for v in got[i].values()} for i, j in close)
    assert hit / len(close) >= 0.95
    assert all(i not in {v[0] for v in d.values()} and len(d) == 5 for i, d in got.items()) and len(got) == len(x)


def test_equal_vectors_are_neighbours_by_id(spark, embedded, spaces):
    a = [1, 0, 0, 0, 0, 0, 0, 0]
    data = [(i, a) for i in range(100, 140)] + [(1, [0.9, 0.3, 0, 0, 0, 0, 0, 0]), (1, [0.9, 0.3, 0, 0, 0, 0, 0, 0])]
    for e in (embedded(data).coalesce(1), embedded(data).repartition(4)):
        got = {}
        for r in neighbours.vector_neighbours(e, spaces, top=3).orderBy("rank").collect():
            got.setdefault(r["chunk_id"], []).append(r["neighbour_id"])
        assert got[1] == [100, 101, 102]
        assert got[100] == [101, 102, 103] and got[139] == [100, 101, 102] and got[101] == [100, 102, 103]
        assert len(got) == 41


def test_chosen_queries_against_all_rows(spark, embedded, spaces):
    x = clumps()
    e = embedded(list(enumerate(x)))
    some = neighbours.vector_neighbours(e, spaces, queries=lambda c: c % 20 == 0)
    every = neighbours.vector_neighbours(e, spaces).where("chunk_id % 20 = 0")
    assert rows(some.select("chunk_id", "neighbour_id", "rank")) == rows(every.select("chunk_id", "neighbour_id", "rank"))


def test_regions_over_their_share_are_cut(spark, embedded, spaces):
    x = np.concatenate([clumps(centres=1, members=300, noise=0, spread=0.02), clumps(centres=4, members=30, noise=0)])
    near = neighbours.vector_neighbours(embedded(list(enumerate(x))), spaces, shard_rows=60, min_similarity=0.9)
    want, sim = brute_top(x, 5)
    got = {(r["chunk_id"], r["neighbour_id"]) for r in near.collect()}
    close = {(i, int(j)) for i in range(len(x)) for j, s in zip(want[i], sim[i]) if s >= 0.9}
    assert len(close & got) / len(close) > 0.9


def test_neighbours_below_any_floor_are_found(spark, embedded, spaces, tmp_path):
    from quillspan.llm import queries

    x = np.random.default_rng(8).standard_normal((14_000, 8)).astype(np.float32)
    x[:, 6:] *= 1.5
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8, dtype=np.int32)), pa.array(x.ravel()))
    from pyspark.sql import functions as F

    table = pa.table({"chunk_id": np.arange(len(x)), "embedding": flat})
    e = spark.createDataFrame(table).withColumns({"tenant_id": F.lit(1).cast("bigint"), "embedding_model": F.lit("m"), "embedding_version": F.lit("1")})
    e.write.parquet(f"{tmp_path}/chunk_embeddings.parquet")
    spaces.write.parquet(f"{tmp_path}/embedding_spaces.parquet")
    got = {}
    for r in queries.p3_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r["chunk_id"], set()).add(r["neighbour_id"])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y[::20] @ y.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -9
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got[20 * i] & set(w.tolist())) / 5 for i, w in enumerate(want)]) >= 0.98
