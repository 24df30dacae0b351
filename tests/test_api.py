"""The library as a whole, over the smallest test tables."""

import pytest
from pyspark.sql import functions as F

from quillspan.api import Library
from quillspan.core import workspace
from quillspan.operators import access, generation, ingest, vectors
from quillspan.operators.security import AccessDenied, Context
from quillspan.plans.fixtures import Fixtures

TENANT = 4


@pytest.fixture(scope="module")
def lib(spark, small):
    x = Fixtures(spark, small)
    reach = tuple(r["id"] for r in x.labels.where(F.col("tenant_id") == TENANT).select("id").collect())
    embed = lambda q: q.crossJoin(x.embeddings.where("tenant_id = 4").orderBy("chunk_id").limit(1).select("embedding")).select("query_id", "embedding")
    say = lambda p: p.select("query_id", F.concat(F.lit("It is so [1] and [99]. "), F.length("prompt").cast("string")).alias("answer"))
    return Library(x.tables(), Context(TENANT, reach, 4003, True), embed, say, frozenset({"the"}))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "the manual and the pump"), (2, "xyzzyplugh")], "query_id bigint, text string")


def test_search_stays_within_reach(lib, questions):
    hits = lib.search(questions, 5)
    seen = {r["id"] for r in lib.secure.table("chunks").select("id").collect()}
    rows = hits.collect()
    assert rows and {r["chunk_id"] for r in rows} <= seen and {r["degraded"] for r in rows} == {False}
    assert max(r["rank"] for r in rows) <= 5


def test_search_without_embedder_is_degraded(lib, questions):
    bare = Library(lib.tables, lib.ctx)
    rows = bare.search(questions).collect()
    assert all(r["degraded"] and r["dense_rank"] is None and r["query_id"] == 1 for r in rows)


def test_scope_and_labels_beyond_reach_are_refused(lib, questions):
    with pytest.raises(AccessDenied):
        lib.search(questions, labels=[-1])
    with pytest.raises(AccessDenied):
        lib.search(questions, documents=[-5])
    one = lib.secure.table("documents").orderBy("id").first()["id"]
    assert {r["document_id"] for r in lib.search(questions, documents=[one]).collect()} <= {one}


def test_answers_cite_hits_or_abstain(lib, questions):
    bare = Library(lib.tables, lib.ctx, model=lib.model)
    got = {r["query_id"]: r for r in bare.answer(questions).collect()}
    first = bare.search(questions).where("query_id = 1 and rank = 1").first()
    assert got[2]["abstained"] and got[2]["text"] == generation.ABSTENTION
    if first is not None:
        assert got[1]["cited"] == [first["chunk_id"]] and got[1]["fabricated"] == 1 and not got[1]["abstained"]
    with pytest.raises(ValueError):
        Library(lib.tables, lib.ctx).answer(questions)


def test_nothing_is_shown_without_a_context(lib, questions):
    none = Library(lib.tables, Context())
    assert none.search(questions).count() == 0 and none.documents().count() == 0 and none.users().count() == 0 and none.folders().count() == 0
    assert none.overview("2024-01-31").first()["queries"] == 0


def test_listings(lib):
    docs = lib.documents(2).collect()
    assert len(docs) <= 3 and lib.documents(status="ready", search=".").count() >= 0
    for bad in ({"status": "odd"}, {"unlabelled": True, "label": 1}):
        with pytest.raises(ValueError):
            lib.documents(**bad)
    assert lib.question_log().count() == 11 and lib.history(unanswered=True).where("citations > 0").count() == 0
    assert lib.labels("usage", manages=True).count() > 0 and lib.roles().count() == 5 and lib.groups().count() > 0 and lib.users().count() > 0
    assert lib.status().count() >= 0 and lib.insights().count() == lib.secure.table("documents").count()


def test_merge(lib):
    a, b, c = lib.ctx.label_ids[:3]
    preview, bridge = lib.merge_labels({a, b}, c, set())
    assert preview.first()["documents_relabelled"] >= 0 and bridge.where(F.col("label_id").isin(a, b)).count() == 0
    with pytest.raises(ValueError):
        lib.merge_labels({a}, b, {a})


def test_written_tables_can_be_cleared(spark):
    workspace.clear(spark)
    kept = workspace.stored(spark.range(5))
    assert kept.count() == 5 and workspace.clear(spark) == 1 and workspace.clear(spark) == 0


def test_insert_absent_and_ensured(spark):
    old = spark.createDataFrame([(1, 1)], "a int, b int")
    new = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "a int, b int")
    assert sorted(map(tuple, access.insert_absent(old, new, ["a", "b"]).collect())) == [(1, 1), (2, 2)]
    t = spark.createDataFrame([(1,), (2,)], "id int")
    lab = spark.createDataFrame([(1, "Q", True), (2, "x", False)], "tenant_id int, name string, is_quarantine boolean")
    assert sorted(map(tuple, access.ensured_labels(t, lab, "is_quarantine", "quarantine").collect())) == [(1, "Q"), (2, "quarantine")]


def test_boxes_in_slice():
    words = [("one", 1), ("two", 2), ("three", 3), ("two", 4)]
    text = "one two three two"
    assert ingest.boxes_in_slice(text, words, 4, 9) == [2, 3] and ingest.boxes_in_slice(text, words, 0, 100) == [1, 2, 3, 4] and ingest.boxes_in_slice(text, words, 14, 17) == [4]
    assert ingest.boxes_in_slice(text, [("absent", 9), *words], 0, 3) == [1]


def test_new_space_beside_the_old(spark):
    import numpy as np

    e = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "chunk_id bigint, embedding array<double>")
    rows = vectors.reprojected(e, np.array([[1.0], [1.0]]), "m", "2").orderBy("chunk_id").collect()
    assert [(r["embedding_version"], r["embedding"]) for r in rows] == [("2", [3.0]), ("2", [7.0])]
    lists = vectors.inverted_lists(e, 2)
    assert sorted(r["chunk_id"] for r in lists.collect()) == [1, 2]


def test_a_judge_reorders_or_is_missed(spark, lib, questions):
    score = lambda h: h.select("query_id", "chunk_id", (F.col("chunk_id") % 1000 / 1000.0).alias("rerank"))
    judged = Library(lib.tables, lib.ctx, judge=score).search(questions).collect()
    order = sorted(judged, key=lambda r: r["rank"])
    assert judged and [r["rerank"] for r in order] == sorted((r["rerank"] for r in judged), reverse=True) and all(r["reasons"] == ["embedding"] for r in judged)
    part = lambda h: score(h).where("rerank > 2")
    missed = Library(lib.tables, lib.ctx, judge=part).search(questions).collect()
    assert all(r["reasons"] == ["embedding", "reranker"] and r["degraded"] for r in missed)
    plain = Library(lib.tables, lib.ctx).search(questions).collect()
    assert {(r["chunk_id"], r["rank"]) for r in missed} == {(r["chunk_id"], r["rank"]) for r in plain}
    assert {"filename", "media_type", "char_start", "char_end", "text", "bboxes", "label_ids", "lexical_score", "dense_score"} <= set(plain[0].asDict())


def test_labels_in_use_are_kept(spark, lib):
    mine = set(lib.ctx.label_ids)
    used = {r["label_id"] for r in lib.tables["document_labels"].select("label_id").distinct().collect()} & mine
    reserved = {r["label_id"] for r in access.reserved_labels(lib.tables["access_labels"]).collect()} & mine
    for bad in (*sorted(used)[:1], *sorted(reserved)[:1]):
        with pytest.raises(ValueError):
            lib.delete_label(bad)
    with pytest.raises(AccessDenied):
        lib.delete_label(-1)
    labels = spark.createDataFrame([(1, 4, "a", True, False), (2, 4, "B ", False, False), (3, 4, "q", False, True), (4, 5, "c", True, False)], "id bigint, tenant_id bigint, name string, is_default boolean, is_quarantine boolean")
    bridge = spark.createDataFrame([(9, 2), (8, 2)], "document_id bigint, label_id bigint")
    assert {r["id"] for r in access.without_label(labels, bridge, 1).collect()} == {2, 3, 4}
    for bad, error in ((2, ValueError), (3, ValueError), (7, KeyError)):
        with pytest.raises(error):
            access.without_label(labels, bridge, bad)
    with pytest.raises(ValueError):
        access.renamed_label(labels, 1, " b")
    assert {r["id"]: r["name"] for r in access.renamed_label(labels, 1, " new ").collect()}[1] == "new"
    assert {r["id"] for r in access.with_default(labels, 2).where("is_default").collect()} == {2, 4}


def test_deletes_and_uploads(spark, lib):
    one = lib.secure.table("documents").orderBy("id").select("id").limit(1)
    left = lib.delete_documents(one)
    gone = one.first()["id"]
    assert left["chunks"].where(F.col("document_id") == gone).count() == 0 and left["documents"].count() == lib.tables["documents"].count() - 1
    with pytest.raises(AccessDenied):
        lib.delete_documents(spark.createDataFrame([(-3,)], "id bigint"))
    known = lib.tables["documents"].where("tenant_id = 4").orderBy("id").first()
    up = spark.createDataFrame([(10**9, known["sha256"], []), (10**9 + 1, "new", None)], "id bigint, sha256 string, label_ids array<bigint>")
    got = {r["upload_id"]: r for r in lib.uploads(up).collect()}
    assert got[10**9]["document_id"] == known["id"] and got[10**9]["deduplicated"] and not got[10**9 + 1]["deduplicated"]
