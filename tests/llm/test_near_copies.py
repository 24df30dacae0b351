"""Near copies (p4)."""

import re

import numpy as np
import pytest

from quillspan.llm import near_copies as nc

RNG = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RNG.choice(WORDS, n))


def edited(t, changes, move=False):
    w = t.split()
    for i in RNG.choice(len(w), changes, replace=False):
        w[i] = f"new{RNG.integers(10**6)}"
    if move:
        k = len(w) // 2
        w = w[k:] + w[:k]
    return " ".join(w)


def shingles(t, k):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= 20 else set()


def brute(rows, k=3, limit=0.5, stock=()):
    s = {i: shingles(t, k) for i, t in rows if i is not None and t is not None and t not in stock}
    ids = sorted(i for i in s if s[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) >= limit * len(s[a] | s[b])}


def corpus():
    rows = []
    for g in range(25):
        t = text(int(RNG.integers(25, 260)))
        rows += [(len(rows) + i, edited(t, c, m)) for i, (c, m) in enumerate([(0, False), (1, False), (3, True), (2, False)])]
    rows += [(1000 + i, text(80)) for i in range(60)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    assert pairs(nc.near_copies(frame(spark, rows).repartition(3), shingle_words=3, similarity=0.5)) == brute(rows)


def test_defaults_are_five_words_and_four_fifths(spark):
    rows = corpus()
    assert pairs(nc.near_copies(frame(spark, rows))) == brute(rows, 5, 0.8)


def test_sizes_across_bands(spark):
    rows = []
    for n in (30, 120, 250, 300, 520, 1000, 1030, 2100, 4200):
        t = text(n)
        w = t.split()
        rows += [(len(rows), t), (len(rows) + 1, " ".join(w[: int(n * 0.7)])), (len(rows) + 2, edited(t, max(1, n // 60)))]
    assert pairs(nc.near_copies(frame(spark, rows), shingle_words=3, similarity=0.5)) == brute(rows)


def test_copies_nulls_stock_and_short_texts(spark, stock):
    t, s = text(60), text(40)
    rows = [(1, t), (2, t), (2, t), (3, t.upper()), (4, s), (5, s), (6, None), (7, ""), (8, "   "), (9, "too few words"), (10, "too few words"), (None, t), (11, edited(t, 1))]
    df = frame(spark, rows).repartition(3)
    assert pairs(nc.near_copies(df, stock([(1, s, None), (2, None, None)]), shingle_words=3, similarity=0.5)) == {(a, b) for a in (1, 2, 3, 11) for b in (1, 2, 3, 11) if a < b}
    assert nc.near_copies(df.where("false")).collect() == []
    assert nc.near_copy_groups(df.where("false")).collect() == []


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    t = text(50)
    df = frame(spark, [(1, t), (2, t)]).withColumns({"num": F.lit(1), "a": F.lit("x"), "b": F.lit(2), "stock_text": F.lit("y"), "shingles": F.lit(0)})
    assert pairs(nc.near_copies(df)) == {(1, 2)}


def test_many_near_copies_of_one_text(spark):
    t = text(100)
    rows = [(i, edited(t, 2)) for i in range(60)] + [(100 + i, t) for i in range(80)] + [(500 + i, text(70)) for i in range(40)]
    assert pairs(nc.near_copies(frame(spark, rows), shingle_words=3, similarity=0.5)) == brute(rows)


def test_groups_are_components_of_links_and_copies(spark):
    rows = corpus() + [(2000, "x " + text(50))] * 2
    linked = brute(rows, 3, 0.5)
    label = {i: i for p in linked for i in p}
    for _ in range(10):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    got = nc.near_copy_groups(frame(spark, rows), shingle_words=3, similarity=0.5).collect()
    assert {(r["chunk_id"], r["group_id"]) for r in got} == set(label.items())
    assert len(got) == len(label)
    one = next(r for r in got if r["chunk_id"] == 0)
    assert one["links"] == sum(0 in p for p in linked)


def test_parity_sketch_bounds_the_difference():
    a = RNG.choice(2**32, 150, replace=False).astype(np.uint32)
    b = np.concatenate([a[:120], RNG.choice(2**32, 25, replace=False).astype(np.uint32)])
    s = nc.parity_sketch(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= 55


@pytest.mark.parametrize("texts", [[], [None], ["", "a b"], ["a b c", None, "A-b_c"]])
def test_shingles_of_odd_texts(texts):
    own, sh, many = nc.shingle_sets(texts, 3)
    assert len(own) == len(sh) == sum(m >= 3 for m in many)


def common(groups=60, members=3):
    """Records made of phrases that a large share of all records holds, so that nothing in them is rare."""
    rng = np.random.default_rng(4)
    phrases = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(24)]
    rows = []
    for _ in range(groups):
        own = rng.permutation(24)[:8]
        for _ in range(members):
            kept = [int(p) for p in own]
            kept[int(rng.integers(8))] = int(rng.integers(24))
            rows.append((len(rows), " ".join(phrases[i] for i in kept)))
    return rows


@pytest.mark.parametrize("long_run", [5, 1000])
@pytest.mark.parametrize("words, similarity", [(3, 0.5), (5, 0.8), (3, 0.3)])
def test_pairs_whose_every_shingle_is_common(spark, monkeypatch, words, similarity, long_run):
    monkeypatch.setattr(nc, "LONG_RUN", long_run)
    rows = common()
    want = brute(rows, words, similarity)
    assert want and pairs(nc.near_copies(frame(spark, rows).repartition(3), shingle_words=words, similarity=similarity)) == want


def test_short_pairs_of_shared_words_at_the_threshold(spark):
    # 18 shingles each that a third of the records hold; one word apart.
    t = [f"c{i}" for i in range(20)]
    rows = [(i, " ".join([*t[:-1], f"end{i}"])) for i in range(40)] + [(100 + i, text(60)) for i in range(80)]
    assert pairs(nc.near_copies(frame(spark, rows), shingle_words=3, similarity=0.5)) == brute(rows)


@pytest.mark.parametrize("texts", [["Aé-B_c 12", "İstanbul ǅ", None, "", "x\ny"], ["one"], ["a\n\nb", "c"]])
def test_words_are_those_of_the_pattern(texts):
    h, many = nc.word_hashes(texts)
    want = [re.findall(r"[^\W_]+", t.lower()) if t else [] for t in texts]
    assert many.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    seen = {}
    assert all(seen.setdefault(w, v) == v for w, v in zip(flat, h.tolist())) and len(set(seen.values())) == len(seen)


def test_one_text_in_many_batches_is_one_record(spark):
    t, other = text(60), text(60)
    rows = [(i, t) for i in range(400)] + [(1000, edited(t, 1)), (1001, other), (1002, edited(other, 1))]
    got = nc.near_copy_groups(frame(spark, rows).repartition(16), shingle_words=3, similarity=0.5).collect()
    links = {r["chunk_id"]: r["links"] for r in got}
    assert len(got) == 403 and set(links.values()) == {1}


@pytest.mark.parametrize("bits", [2, 6, 10])
def test_a_full_rarity_table_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(nc, "LEAST_TABLE_BITS", bits)
    monkeypatch.setattr(nc, "MOST_TABLE_BITS", bits)
    rows = corpus() + [(3000 + i, t) for i, t in common()]
    assert pairs(nc.near_copies(frame(spark, rows).repartition(3), shingle_words=3, similarity=0.5)) == brute(rows)


def test_rounds_find_all_and_leave_no_candidates(spark, monkeypatch):
    from pathlib import Path

    from quillspan.core import workspace

    monkeypatch.setattr(nc, "RECORDS_A_ROUND", 40)
    folder = Path(workspace.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    rows = corpus() + [(3000 + i, t) for i, t in common()]
    assert pairs(nc.near_copies(frame(spark, rows).repartition(3), shingle_words=3, similarity=0.5)) == brute(rows)
    made = [p.name.rsplit("-", 1)[1] for p in set(folder.iterdir()) - before]
    assert made.count("links") == nc.MOST_ROUNDS and "candidates" not in made and "closer" not in made and made.count("close") == 1


def test_sets_are_read_again_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nc, "SHINGLES_AT_ONCE", 6)
    sets = [np.arange(n, dtype=np.uint32) for n in (1, 4, 2, 9, 1, 1)]
    b = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["num", "shingles"])
    got = list(nc._kept([b.slice(1), b.slice(6)]))
    assert [n.tolist() for _, n, *_ in got] == [[1, 2], [3], [4, 5]]
    assert all(np.array_equal(sh, np.concatenate([sets[i] for i in n])) and np.array_equal(own, np.repeat(np.arange(len(n)), size)) for _, n, _, own, sh, size in got)


@pytest.mark.parametrize("held, long_run, closes", [(12, 20_000, {1}), (0, 20_000, {5}), (12, 5, {1, 3, 4, 5})])
def test_pairs_of_all_rounds_are_checked_at_once_unless_they_are_many(spark, monkeypatch, held, long_run, closes):
    from quillspan.core import workspace

    monkeypatch.setattr(nc, "RECORDS_A_ROUND", 40)
    monkeypatch.setattr(nc, "CANDIDATES_A_SET", held)
    monkeypatch.setattr(nc, "LONG_RUN", long_run)
    before = len(workspace._MADE.get(spark.sparkContext.applicationId, []))
    rows = corpus() + [(3000 + i, t) for i, t in common()]
    assert pairs(nc.near_copies(frame(spark, rows).repartition(3), shingle_words=3, similarity=0.5)) == brute(rows)
    made = [t.path.rsplit("-", 1)[1] for t in workspace._MADE[spark.sparkContext.applicationId][before:]]
    assert made.count("candidates") == nc.MOST_ROUNDS and made.count("close") in closes


@pytest.mark.parametrize("similarity", [1e-10, 0.3, 0.5, 1.0])
@pytest.mark.parametrize("piece", [1, 40, 10**6])
def test_prefixes_by_range_are_those_of_the_definition(monkeypatch, similarity, piece):
    monkeypatch.setattr(nc, "SHINGLES_A_SORT", piece)
    rng = np.random.default_rng(5)
    size = np.array([1, 7, 30, 2, 64])
    sets = [np.unique(rng.integers(0, 2**32, n, dtype=np.uint32)) for n in size]
    own, sh, level = np.repeat(np.arange(len(size)), size), np.concatenate(sets), rng.integers(0, 3, size.sum()).astype(np.uint8)
    want = []
    for r in range(len(size)):
        order = sorted(zip(level[own == r].tolist(), sh[own == r].tolist()))
        for place, (common, s) in enumerate(order[: int(size[r] - np.ceil(similarity * size[r] - 1e-9)) + 1]):
            rest = [0] * nc.WORDS
            for _, o in order[place + 1 :]:
                h = int(nc._mix(np.array([o + 47], np.uint64))[0])
                rest[h % 2**32 % nc.WORDS] ^= 1 << (h >> 58)
            want += [(r, s, place, *rest)] * bool(common)
    cuts = [0, 1 << 30, 3 << 30, 1 << 32]
    got = [nc.prefixes(own, sh, size, level, similarity, a, b) for a, b in zip(cuts, cuts[1:])]
    assert all(((a <= g[1]) & (g[1] < b)).all() for g, a, b in zip(got, cuts, cuts[1:]))
    rows = [(r, s, p, *w) for g in got for r, s, p, w in zip(g[0].tolist(), g[1].tolist(), g[2].tolist(), g[3].tolist())]
    assert sorted(rows) == sorted(want) and [x.tolist() for x in nc.prefixes(own, sh, size, level, similarity)][:3] == [list(c) for c in list(zip(*want))[:3]]
