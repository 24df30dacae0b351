"""Retrieval, ingestion, generation, limits, sources."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions import chunking, text
from quillspan.operators import evaluate, generation, ingest, retrieval, vectors
from quillspan.sources import files, tables
from quillspan.streaming import ingestion, limiter


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- analysers ------------------------------------------------------------------
@pytest.mark.parametrize(
    "word, want",
    [
        ("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("knack", "knack"), ("knitting", "knit"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("kiwis", "kiwi"),
        ("luxuriated", "luxuri"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("happy", "happi"), ("enjoy", "enjoy"), ("relational", "relat"), ("conditional", "condit"), ("generalization", "general"), ("skies", "sky"),
        ("dying", "die"), ("proceed", "proceed"), ("generate", "generat"), ("communication", "communic"), ("by", "by"), ("say", "say"), ("controlling", "control"), ("rate", "rate"), ("falling", "fall"), ("replacement", "replac"),
    ],
)
def test_stems(word, want):
    assert text.stem(word) == want


def test_english_keeps_identifiers_and_drops_stop_words():
    assert text.english_lexemes("The controllers of Form 1545-0074 réviewed v2.1 and www.site.org") == ["control", "form", "1545-0074", "review", "v2.1", "www.site.org"]
    assert text.english_lexemes(None) == [] and text.english_lexemes("of the and") == []


def test_english_column(spark):
    assert rows(spark.createDataFrame([("Running dogs",), (None,)], "t string").select(text.english("t"))) == [(["run", "dog"],), ([],)]


def test_anchors(spark):
    d = spark.createDataFrame([("Data  Protection\nact", "data protection ACT"), ("data-protection", "data protection"), ("form 15-45", "form 1545"), ("x", ""), (None, "a")], "t string, a string")
    assert [r[0] for r in rows(d.select(text.anchor_found(F.col("t"), F.col("a"))))] == [True, True, False, False, False]


# -- ranking --------------------------------------------------------------------
def ranking(spark, ids, query=1):
    return spark.createDataFrame([(query, i, r + 1) for r, i in enumerate(ids)], "query_id bigint, chunk_id bigint, rank int")


def test_a_lone_leader_loses_to_two_middling_ranks(spark):
    lex = ranking(spark, [1, 2, 3, 4, 5])
    den = ranking(spark, [6, 7, 8, 9, 5])
    f = retrieval.fuse([lex, den], 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in f] == [5, 1, 6]
    assert f[0]["score"] == pytest.approx(2 / 65) and f[1]["score"] == pytest.approx(1 / 61)


def test_leaders_have_seats(spark):
    both = list(range(10, 20))
    lex, den = ranking(spark, [1] + both), ranking(spark, [2] + both)
    got = retrieval.leader_floor([lex, den], 4).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == [10, 11, 1, 2] and got[2]["score"] == got[1]["score"]
    assert [r["chunk_id"] for r in retrieval.leader_floor([lex, den], 1).collect()] == [10]
    same = ranking(spark, [1] + both)
    twice = retrieval.leader_floor([same, same.where("rank = 1"), ranking(spark, both), ranking(spark, both)], 2).orderBy("position").collect()
    assert [r["chunk_id"] for r in twice].count(1) in (1, 2)


def test_fusion_ignores_scores_and_empty_rankings(spark):
    lex = ranking(spark, [3, 1, 2])
    assert rows(retrieval.fuse([lex, ranking(spark, [9]).where("false")], 3).orderBy("rank").select("chunk_id")) == [(3,), (1,), (2,)]


@pytest.mark.parametrize("positions, want", [([[1], [2]], 0.1), ([[1], [4]], 0.1 / 3), ([[1, 10], [2, 11]], 0.2 + 0.1 / 8), ([[5], []], 0.0), ([], 0.0), ([[1, 3], [2]], 0.2), ([[1, 2, 9], [3]], 0.1 + 0.1 / 6)])
def test_cover_density(positions, want):
    assert retrieval.cover_density(positions) == pytest.approx(want)


def test_dense_ties_self_and_blocks(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 1.0]), (10, [0.0, 0.0])], "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 0.1]), (3, None)], "query_id bigint, embedding array<double>")
    for block in (1, 100):
        got = retrieval.dense(q, v.repartition(3), 3, exclude_self=True, block=block)
        assert [r["chunk_id"] for r in got.where("query_id = 1").orderBy("rank").collect()] == [0, 2, 3]
        assert got.count() == 6
    assert retrieval.dense(q.where("false"), v, 3).count() == 0 and retrieval.dense(q, v.where("false"), 3).count() == 0


def test_hamming_and_coarse_search(spark):
    x = np.random.default_rng(4).normal(size=(300, 20))
    v = spark.createDataFrame([(i, [float(e) for e in r]) for i, r in enumerate(x)], "chunk_id bigint, embedding array<double>").repartition(3)
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    ham = {}
    for r in vectors.hamming_rescored(q, v, 25, 5).orderBy("query_id", "rank").collect():
        ham.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i in range(0, 300, 50):
        apart = ((x > 0) != (x[i] > 0)).sum(1)
        short = sorted(range(300), key=lambda j: (apart[j], j))[:25]
        assert ham[i] == sorted(short, key=lambda j: -round(float(y[i] @ y[j]), 9))[:5]
    members = v.withColumn("gid", F.col("chunk_id") % 10)
    means = np.stack([x[np.arange(300) % 10 == g].mean(0) for g in range(10)])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    got = {}
    for r in vectors.coarse_to_fine(q, members, 3, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for i in range(0, 300, 50):
        opened = np.argsort(-(means @ y[i]))[:3]
        inside = [j for j in range(300) if j % 10 in opened]
        assert got[i] == sorted(inside, key=lambda j: -(y[i] @ y[j]))[:5]


def test_width_guard(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    with pytest.raises(PySparkException):
        retrieval.width_guard(df, "embedding", 2).collect()
    assert retrieval.width_guard(df.limit(1), "embedding", 2).count() == 1


def test_rerank_falls_back_as_a_whole(spark):
    hits = spark.createDataFrame([(q, c, c) for q in (1, 2, 3) for c in (1, 2, 3)], "query_id bigint, chunk_id bigint, rank bigint")
    s = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.1), (2, 1, 0.1), (2, 2, 0.9), (3, 1, 0.5), (3, 2, float("nan")), (3, 3, 0.9)], "query_id bigint, chunk_id bigint, rerank double")
    got = {q: [r["chunk_id"] for r in retrieval.rerank(hits, s).where(f"query_id = {q}").orderBy("position").collect()] for q in (1, 2, 3)}
    assert got == {1: [2, 1, 3], 2: [1, 2, 3], 3: [1, 2, 3]}


def test_relevance(spark):
    data = [(1, 1, 0.0272), (2, 1, 0.011), (3, None, 0.1841), (4, 1, 0.2), (5, 1, None), (6, 1, 0.15)]
    got = dict(rows(retrieval.relevance(spark.createDataFrame(data, "query_id bigint, lexical_rank int, rerank double"))))
    assert got == {1: "WEAK", 2: "NONE", 3: "NONE", 4: "CONFIDENT", 5: "CONFIDENT", 6: "CONFIDENT"}


def test_token_batches():
    assert retrieval.token_batches([30, 30, 300, 3], 25, 9) == [[0, 1], [2], [3]]
    assert retrieval.token_batches([3] * 5, 1000, 2) == [[0, 1], [2, 3], [4]] and retrieval.token_batches([], 10, 2) == []


# -- vectors ----------------------------------------------------------------------
def test_basis_is_the_uncentred_svd(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 1
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id bigint, embedding array<double>").repartition(3)
    axes, share = vectors.basis(df, 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs((axes * vt[:3].T).sum(0)), 1, atol=1e-6) and np.allclose(share, (s**2 / (s**2).sum())[:3])
    got = {r["chunk_id"]: r["embedding"] for r in vectors.project(df, axes).collect()}
    assert np.allclose([got[i] for i in range(200)], x @ axes, atol=1e-4)
    assert np.allclose(vectors.random_basis(6, 3).T @ vectors.random_basis(6, 3), np.eye(3))


def test_half_precision_rounds(spark):
    df = spark.createDataFrame([(1, [0.1, 2.0]), (2, [1 / 3, 1e-9])], "chunk_id bigint, embedding array<float>")
    got = {r["chunk_id"]: r["embedding"] for r in vectors.half_precision(df).collect()}
    assert got[1] == [float(np.float16(0.1)), 2.0] and got[2] == [float(np.float16(1 / 3)), 0.0]


def test_inverse_cdf_edges(spark):
    w = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.3, 0.8), (3, 0.2, 0.9999999)], "i bigint, weight double, cum double")
    d = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.500001), (4, 0.9999999), (5, 0.99999999)], "id bigint, r double")
    assert dict(rows(vectors.inverse_cdf(d, w))) == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3}


def test_interpolation_is_unit_length(spark):
    p = spark.createDataFrame([(1, 2, [1.0, 0.0], [0.0, 1.0])], "a int, b int, va array<double>, vb array<double>")
    got = vectors.interpolated(p, [0.5, 0.0]).orderBy("weight").collect()
    assert got[0]["embedding"] == [1.0, 0.0] and got[1]["embedding"] == pytest.approx([0.5**0.5] * 2)
    assert vectors.required_modulus(0.5, 0.1) == 10


# -- evaluation -------------------------------------------------------------------
def test_nearest_rank_rules(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 21)] + [("b", 7), ("b", None)], "k string, v int")
    assert dict(rows(evaluate.nearest_rank(df, "k", "v", 0.95))) == {"a": 20, "b": 7}
    assert dict(rows(evaluate.nearest_rank(df, "k", "v", 0.95, "less"))) == {"a": 19, "b": 7}


def test_separation(spark):
    s = spark.createDataFrame([("x", "good", 0.9), ("x", "bad", 0.5), ("y", "good", 0.4), ("y", "bad", 0.5)], "signal string, kind string, score double")
    assert dict(rows(evaluate.separates(evaluate.separation_bands(s), "good", "bad"))) == {"x": True, "y": False}


def test_label_shortlist(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "document_id bigint, embedding array<double>")
    labels = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.1, 1.0])], "label_id bigint, embedding array<double>")
    truth = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "document_id bigint, label_id bigint")
    assert dict(rows(evaluate.label_shortlist(d, labels, truth))) == {1: 1, 2: 1}
    assert dict(rows(evaluate.label_shortlist(d, labels, truth.where("label_id = 10"), block=1))) == {1: 1, 2: 2}
    assert evaluate.label_shortlist(d, labels.where("false"), truth).collect() == []
    assert rows(evaluate.shortlist_length(spark.createDataFrame([(i, 1 + i // 10) for i in range(40)], "document_id bigint, rank bigint"), 0.7)) == [(3,)]


# -- ingestion --------------------------------------------------------------------
@given(st.text(alphabet="ab. \né\U0001f600", max_size=700))
@settings(max_examples=80, deadline=None)
def test_chunks_cover_and_index_the_source(t):
    got = chunking.chunk_text(t, 100, 20, 10)
    assert bool(got) == (len(t.strip()) >= 10)
    assert all(t[a:b].strip() == body and b - a <= 100 for a, b, body in got)
    covered = {i for a, b, _ in got for i in range(a, b)}
    assert not got or all(t[i].isspace() for i in set(range(len(t))) - covered)


def test_boundary_preference():
    base = "x" * 800
    assert chunking.boundary(base + "\n\n" + "y" * 100 + ". " + "z" * 900, 0) == 802
    assert chunking.boundary(base + "y" * 100 + ". " + "z" * 900, 0) == 902
    assert chunking.boundary("x" * 600 + "\n\n" + "y" * 900, 0) == 1200


def test_media_and_staging(spark):
    f = [(1, "a.PDF", b"%PDF-1.7 x"), (1, "b.txt", "é".encode()), (1, "c.md", b"\xff\xfe"), (1, "d.text", b"a\x00b"), (1, "noext", b"plain"), (1, "big.txt", b"x" * 50)]
    got = {r["filename"]: r for r in ingest.staged(spark.createDataFrame(f, "tenant_id bigint, filename string, content binary"), 40).collect()}
    assert {n: (r["media_type"], r["accepted"]) for n, r in got.items()} == {"a.PDF": ("pdf", True), "b.txt": ("plain", True), "c.md": ("markdown", False), "d.text": ("plain", False), "noext": ("pdf", False), "big.txt": ("plain", False)}


def test_lines_merge(spark):
    b = [(1, 1, 0.1, 0.1, 0.2, 0.12), (1, 1, 0.22, 0.1001, 0.3, 0.12), (1, 1, 0.5, 0.1, 0.6, 0.12), (1, 1, 0.1, 0.2, 0.2, 0.22), (1, 2, 0.1, 0.1, 0.2, 0.12)]
    got = ingest.merged_lines(spark.createDataFrame(b, "id int, page int, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r["page"], r["x0"], r["x1"]) for r in got.collect()) == [(1, 0.1, 0.2), (1, 0.1, 0.3), (1, 0.5, 0.6), (2, 0.1, 0.2)]


def test_gutters(spark):
    rng = np.random.default_rng(0)
    pages = {1: [(0.1, 0.9)], 2: [(0.08, 0.44), (0.55, 0.92)], 3: [(0.05, 0.33), (0.37, 0.62), (0.66, 0.95)]}
    rows_ = [(p, float(x), float(x) + 0.001) for p, spans in pages.items() for a, b in spans for x in rng.uniform(a, b, 600)] + [(4, 0.2, 0.3)] * 249 + [(5, 0.2, 0.2)] * 400 + [(None, 0.1, 0.2), (6, None, 0.2)]
    words = spark.createDataFrame(rows_, "page int, x0 double, x1 double")
    got = {r["page"]: r["gutters"] for r in ingest.column_gutters(words).collect()}
    assert [len(got[p]) for p in (1, 2, 3, 4, 5)] == [0, 1, 2, 0, 0] and 6 not in got
    assert 0.45 < got[2][0] < 0.54 and 0.33 < got[3][0] < 0.38 and 0.61 < got[3][1] < 0.67
    pages = spark.createDataFrame([(1, "x" * 200), (2, "x y " * 60), (3, "short"), (9, None)], "id int, text string")
    route = {r["id"]: r["route"] for r in ingest.page_route(pages, "id", "text", ingest.column_gutters(words)).collect()}
    assert route == {1: "FAST", 2: "LAYOUT", 3: "UNREADABLE", 9: "UNREADABLE"}


def test_columns_are_read_one_after_the_other(spark):
    w = [(1, 0.1, 0.2, 0.1, "a"), (1, 0.3, 0.4, 0.1, "b"), (1, 0.6, 0.7, 0.1, "x"), (1, 0.1, 0.2, 0.2, "c"), (1, 0.6, 0.7, 0.2, "y"), (2, 0.6, 0.7, 0.1, "z")]
    words = spark.createDataFrame(w, "page int, x0 double, x1 double, y0 double, word string")
    gutters = spark.createDataFrame([(1, [0.5]), (2, [])], "page int, gutters array<double>")
    assert dict(rows(ingest.column_texts(words, gutters))) == {1: "a b\nc\n\nx\ny", 2: "z"}


def test_spacing_is_accepted_when_it_helps(spark):
    thin, better, same = "x" * 240 + " " * 10, ("xxxx " * 60)[:250], "x" * 239 + " " * 11
    d = spark.createDataFrame([(thin, better), (thin, same), (better, thin), (thin, None)], "a string, b string")
    assert [r[0] for r in rows(d.select(ingest.respaced(F.col("a"), F.col("b"))))] == [better, thin, better, thin]


def test_tables(spark):
    cases = [[["a", "b|c"], ["1\n2", None], ["", " x "]], [["a", "b"]], [["a"], ["b", "c"]], [["", None], [" ", ""]], [["a", "b"], ["c", "d", "e"]], [], [["a  \n b", "c"], ["d", "e"]]]
    want = ["| a | b\\|c |\n| --- | --- |\n| 1 2 |  |\n|  | x |", None, None, None, "| a | b |  |\n| --- | --- | --- |\n| c | d | e |", None, "| a    b | c |\n| --- | --- |\n| d | e |"]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id bigint, rows array<array<string>>")
    assert [r["markdown"] for r in ingest.tables_markdown(d, "id", "rows").orderBy("id").collect()] == want
    df = spark.createDataFrame([(1, [["a", "b"], ["c", "d"]]), (2, [["a"]]), (3, None)], "id bigint, rows array<array<string>>")
    assert dict(rows(ingest.tables_markdown(df, "id", "rows")))[2] is None


def test_filing(spark):
    d = spark.createDataFrame([("1, 9 and 2, 2, 3, 4",), ("none",), ("nothing here",), ("999999999999",), ("12 3",)], "r string")
    assert [r[0] for r in rows(d.select(ingest.filing_numbers(F.col("r"), 8)))] == [[1, 2, 3], [], [], [], [3]]


def test_notes_and_sizes(spark):
    d = spark.createDataFrame([([3, 1],), (list(range(1, 12)),), ([],)], "p array<int>")
    assert [r[0] for r in rows(d.select(ingest.omission_note(F.col("p"))))] == ["Pages left out: 1, 3", "Pages left out: 1, 2, 3, 4, 5, 6, 7, 8 and 3 more", None]
    n = spark.createDataFrame([(999,), (104857600,), (2_500_000_000,)], "b bigint")
    assert [r[0] for r in rows(n.select(ingest.byte_size(F.col("b"))))] == ["999 B", "105 MB", "2.5 GB"]


def test_upload_labels():
    f = lambda req: ingest.resolve_upload_labels(req, {1, 2, 3}, {1, 2}, 1, 9)
    assert f(set()) == {9} and f({1}) == {9} and f({1, 2}) == {1, 2}
    with pytest.raises(KeyError):
        f({7})
    with pytest.raises(PermissionError):
        f({3})


def test_writes_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "document_id bigint, t string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "document_id bigint, t string")
    once = ingest.replaced(old, new)
    assert sorted(rows(once)) == sorted(rows(ingest.replaced(once, new))) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(ingest.without_documents(once, spark.createDataFrame([(1,), (3,)], "id bigint"))) == [(2, "c")]


def test_upsert_keeps_old_keys(spark):
    s = "tenant bigint, key string, model string"
    got = ingest.upsert(spark.createDataFrame([(1, "k", "m"), (2, "x", "y")], s), spark.createDataFrame([(1, None, None), (3, "n", "z")], s), "tenant", ["key"])
    assert sorted(rows(got)) == [(1, "k", None), (2, "x", "y"), (3, "n", "z")]


# -- generation -------------------------------------------------------------------
def test_citations(spark):
    gone = generation.ABSTENTION
    cases = [
        ("See [1].", 4, "See [1].", [1], 0, False), ("See [9].", 4, gone, [], 1, True), ("A [1, 9] b", 4, "A [1] b", [1], 1, False), ("A [2][1].", 4, "A [2][1].", [1, 2], 0, False),
        ("None", 4, gone, [], 0, True), (None, 4, gone, [], 0, True), ("", 4, gone, [], 0, True), (gone.upper(), 4, gone, [], 0, True), ("  " + gone[:-1] + " ", 4, gone, [], 0, True), (gone + " [1]", 4, gone + " [1]", [1], 0, False),
        ("x [0] y [2, 2]", 4, "x y [2][2]", [2], 1, False), ("As stated [9] in [3 , 1] it applies [7].", 4, "As stated in [3][1] it applies.", [1, 3], 2, False), ("[1] a", 0, gone, [], 1, True),
        ("[99999999999999999999999999999999999999999999] [1]", 2, "[1]", [1], 1, False), ("\n[1] a\tb\n", 1, "[1] a\tb", [1], 0, False), ("[a] [1 2] [] [[1]]", 1, "[a] [1 2] [] [[1]]", [1], 0, False),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "id int, answer string, passages int")
    got = df.select("id", generation.bound("answer", "passages").alias("b")).orderBy("id").collect()
    assert [tuple(r["b"]) for r in got] == [c[2:] for c in cases]


@given(st.lists(st.sampled_from(["a", " ", "[", "]", "1", "9", ", ", "[1]", " [9]", "[1, 9]", "x."]), max_size=25), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_streamed_markers_do_not_depend_on_the_cut(parts, size):
    whole = "".join(parts)
    one = generation.MarkerFilter(4)
    want = one.feed(whole) + one.end()
    f = generation.MarkerFilter(4)
    assert "".join(f.feed(whole[i : i + size]) for i in range(0, len(whole), size)) + f.end() == want
    for found in generation._MARKER.finditer(want):
        assert all(1 <= int(n) <= 4 for n in found.group(1).split(",")), want
    assert f.cited == one.cited and f.fabricated == one.fabricated


def test_marker_filter_examples():
    def run(s):
        f = generation.MarkerFilter(2)
        return f.feed(s) + f.end()

    assert run("a [1] b") == "a [1] b" and run("a [7] b") == "a b" and run("a [1, 7] b") == "a [1] b" and run("[9[9]]") == "" and run("[1[9]] x") == "[1] x" and run("[1[2]") == "[1[2]" and run("a [9 b [7]c") == "a [9 b c" and run("[not one]") == "[not one]" and run("a [12") == "a [12" and run("[" + "1" * 40 + "]") == "[" + "1" * 40 + "]"


def test_threads_and_intent(spark):
    t = spark.createDataFrame([(1, i, "q" * 500, "a" * 10) for i in range(9)], "thread_id int, turn int, question string, answer string")
    got = generation.bounded_threads(t).orderBy("turn").collect()
    assert [r["turn"] for r in got] == [3, 4, 5, 6, 7, 8] and len(got[0]["question"]) == 400 and got[0]["question"].endswith("…")
    d = spark.createDataFrame([("CHAT",), ("Chat.\nhello",), ("search: pump valves\nx",), ("pump valves",)], "r string")
    assert [tuple(r[0]) for r in rows(d.select(generation.intent(F.col("r"))))] == [("CHAT", None), ("CHAT", None), ("SEARCH", "pump valves"), ("SEARCH", "pump valves")]


def test_mentions(spark):
    d = spark.createDataFrame([("see @man",), ("mail@host",), ("@",), ("@a\nb",), ("no",)], "t string")
    assert [r[0] for r in rows(d.select(generation.mention(F.col("t"))))] == ["man", None, "", None, None]


# -- limits and streams -------------------------------------------------------------
def brute_limit(events, limit, window):
    out, kept = {}, {}
    for e, t, k in sorted(events, key=lambda r: (r[1], r[0])):
        kept[k] = [x for x in kept.get(k, []) if (t - x).total_seconds() <= window]
        out[e] = len(kept[k]) < limit
        if out[e]:
            kept[k].append(t)
    return out


@pytest.fixture(scope="module")
def hits():
    rng = np.random.default_rng(3)
    return [(i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=int(s)), int(k)) for i, (s, k) in enumerate(zip(rng.integers(0, 600, 400), rng.integers(0, 4, 400)))]


def test_limiter_equals_a_fold(spark, hits):
    df = spark.createDataFrame(hits + [(9999, None, 1), (9998, hits[0][1], None)], "event_id bigint, ts timestamp_ntz, user_id bigint")
    assert dict(rows(limiter.limited(df, "user_id", 5, 60.0))) == brute_limit(hits, 5, 60)


def test_two_levels_use_both_or_none(spark):
    t = dt.datetime(2025, 1, 1)
    e = [(i, t + dt.timedelta(seconds=i), 1, 1 if i < 4 else 2) for i in range(8)]
    got = dict(rows(limiter.limited_two_levels(spark.createDataFrame(e, "event_id bigint, ts timestamp_ntz, tenant_id bigint, user_id bigint"), user_limit=3, tenant_limit=5)))
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_streamed_limiter(spark, hits, tmp_path):
    df = spark.createDataFrame(hits, "event_id bigint, ts timestamp, user_id bigint").orderBy("ts")
    for i, (lo, hi) in enumerate(((0, 300), (300, 600))):
        start = dt.datetime(2025, 1, 1)
        df.where((F.col("ts") >= start + dt.timedelta(seconds=lo)) & (F.col("ts") < start + dt.timedelta(seconds=hi))).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
        q = limiter.limited_stream(src, "user_id", 5, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = dict(rows(spark.table("limited")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == brute_limit(hits, 5, 60)


def test_streamed_two_levels(spark, hits, tmp_path):
    every = [(i, t, u, 1 + u % 2) for i, t, u in hits]
    df = spark.createDataFrame(every, "event_id bigint, ts timestamp, user_id bigint, tenant_id bigint").orderBy("ts")
    start = dt.datetime(2025, 1, 1)
    for i, (lo, hi) in enumerate(((0, 200), (200, 10_000))):
        df.where((F.col("ts") >= start + dt.timedelta(seconds=lo)) & (F.col("ts") < start + dt.timedelta(seconds=hi))).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
        q = limiter.limited_two_levels_stream(src, user_limit=3, tenant_limit=5, window=60.0).writeStream.format("memory").queryName("two").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = dict(rows(spark.table("two")))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == dict(rows(limiter.limited_two_levels(df, user_limit=3, tenant_limit=5, window=60.0)))


def test_logs_are_written_once_a_batch(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "id bigint, q string")
    for batch in ("b1", "b1", "b2"):
        tables.append_log(one, str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    answers = spark.createDataFrame([(7, 1, 2, "why", [1, 3]), (8, 1, 2, "none", [])], "query_id bigint, tenant_id bigint, user_id bigint, question string, cited array<int>")
    hits = spark.createDataFrame([(7, r, 100 + r, 0.5 / r) for r in (1, 2, 3)], "query_id bigint, rank int, chunk_id bigint, score double")
    q, c = tables.answered(answers, hits)
    assert q.count() == 2 and sorted((r["chunk_id"], r["rank"], r["dense_score"]) for r in c.collect()) == [(101, 1, None), (103, 3, None)]


def test_ingest_stream_writes_once(spark, tmp_path):
    schema = "doc_id bigint, text string"
    body = "A sentence of some length. " * 60
    spark.createDataFrame([(1, body), (1, body), (2, "short")], schema).write.parquet(str(tmp_path / "in" / "a"))
    run = lambda: ingestion.ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    run()
    spark.createDataFrame([(3, body)], schema).write.parquet(str(tmp_path / "in" / "b"))
    run()
    run()
    spark.createDataFrame([(1, body), (4, body), (None, body)], schema).write.parquet(str(tmp_path / "in" / "again"))
    run()
    got = rows(spark.read.parquet(str(tmp_path / "out" / "chunks")).where("id < 4").groupBy("id").count().orderBy("id"))
    assert got == [(1, len(chunking.chunk_text(body))), (3, len(chunking.chunk_text(body)))]


# -- sources ------------------------------------------------------------------------
def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "c.pdf").write_bytes(b"one|two")
    f = files.binary_files(spark, str(tmp_path))
    assert [(r["text"], r["page_num"]) for r in files.text_units(f).collect()] == [("héllo", None)]
    parse = lambda b: b.decode().split("|")
    assert sorted((r["text"], r["page_num"]) for r in files.pdf_units(f, parse).collect()) == [("one", 1), ("two", 2)]
    assert [(r["text"], r["page_num"]) for r in files.pdf_units(f, parse, 1).collect()] == [(None, None)]


def test_manifest(spark):
    m = files.manifest(spark, '[[doc]]\nfilename = "a"\nsha256 = "00"\nextra = 1\n[[doc]]\nfilename = "b"\n', "doc", "filename string, sha256 string")
    assert rows(m) == [("a", "00"), ("b", None)]
    f = spark.createDataFrame([("a", b"x")], "filename string, content binary")
    assert [r[0] for r in rows(files.checksum_mismatches(f, m))] == ["a"]


def test_tenant_layout_prunes(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 7, f"t{i}") for i in range(70)], "id bigint, tenant_id bigint, t string")
    path = str(tmp_path / "t")
    tables.write_by_tenant(df, path, 16)
    tables.write_by_tenant(df.where("tenant_id = 3").withColumn("t", F.lit("new")), path, 16)
    one = tables.read_tenant(spark, path, 3, 16)
    assert {r["t"] for r in one.collect()} == {"new"} and one.count() == 10
    assert "PartitionFilters: [isnotnull(tenant_bucket" in one._jdf.queryExecution().executedPlan().toString()
    tables.append_log(df.limit(1), str(tmp_path / "log"), 1)
    tables.append_log(df.limit(1), str(tmp_path / "log"), 2)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2




def test_lists_are_scanned_as_coarse_to_fine_joins_them(spark):
    x = np.random.default_rng(6).normal(size=(400, 12))
    x[7] = 0
    x[11:15] = x[10]  # ties go to the smaller id
    members = spark.createDataFrame([(i % 5, i, [float(e) for e in r]) for i, r in enumerate(x)], "gid int, chunk_id bigint, embedding array<double>").repartition(3)
    q = members.where("chunk_id % 40 = 0 or chunk_id = 10").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = vectors.list_search(q, members, [1, 2, 5], 6)
    order = ["query_id", "rank"]
    for n in (1, 2, 5):
        want = vectors.coarse_to_fine(q, members.where("chunk_id <> 7"), n, 6).orderBy(order).collect()
        assert [tuple(r[c] for c in ("query_id", "chunk_id", "score", "rank")) for r in got[n].orderBy(order).collect()] == [tuple(r[c] for c in ("query_id", "chunk_id", "score", "rank")) for r in want]


def test_single_precision_loses_no_near_row():
    rng = np.random.default_rng(8)
    y = retrieval.unit_rows(rng.normal(size=(1, 16)) + 1e-5 * rng.normal(size=(3000, 16)))  # apart by less than single precision tells
    s = np.round(y[:40] @ y.T, 9)
    r, c, v = retrieval.near_rows(y[:40], y, np.full(40, -np.inf), 5)
    for i in range(40):
        best = set(np.flatnonzero(s[i] >= np.partition(s[i], -5)[-5]))
        assert best <= set(c[r == i]) and np.allclose(v[r == i], s[i][c[r == i]], atol=2e-9)
