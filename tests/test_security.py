
import pytest
from pyspark.sql import functions as F

from quillspan.operators import access
from quillspan.operators.security import AccessDenied, Context, SecureTables

DOC = "id bigint, tenant_id bigint, label_ids array<bigint>, status string, uploaded_by bigint"


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(1, 1, [], "ready", 5), (2, 1, [10], "ready", 5), (3, 1, [11], "embedding", 5), (4, 1, [10, 11], "ready", None), (5, 2, [], "ready", 5), (6, 1, None, "ready", 5), (7, 1, [None], "ready", 5)]
    d = spark.createDataFrame(docs, DOC)
    c = d.select((F.col("id") * 10).alias("id"), F.col("id").alias("document_id"), "tenant_id", "label_ids")
    q = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 2, 5)], "id bigint, tenant_id bigint, user_id bigint")
    cit = spark.createDataFrame([(1, 10), (2, 20), (3, 50)], "query_id bigint, chunk_id bigint")
    e = c.select(F.col("id").alias("chunk_id"), "tenant_id", F.array(F.lit(1.0)).alias("embedding"))
    return {"documents": d, "chunks": c, "queries": q, "query_citations": cit, "chunk_embeddings": e, "embedding_spaces": q.limit(1)}


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


@pytest.mark.parametrize(
    "ctx, seen",
    [
        (Context(), []), (Context(None, (10,), 5, True), []), (Context(1), [1]), (Context(1, (10,)), [1, 2, 4]), (Context(1, (11,)), [1, 3, 4]), (Context(1, (10, 11)), [1, 2, 3, 4]),
        (Context(1, (), 5), [1, 3]), (Context(2, (10, 11)), [5]), (Context(1, (999,)), [1]),
    ],
)
def test_isolation_matrix(tables, ctx, seen):
    s = SecureTables(tables, ctx)
    assert ids(s.table("documents")) == seen
    if ctx.user_id is None:
        assert ids(s.table("chunks")) == [10 * i for i in seen]
        assert ids(s.embeddings()) == [10 * i for i in seen]


def test_a_reach_never_shows_less_when_it_grows(tables):
    small, large = (set(ids(SecureTables(tables, Context(1, r)).table("documents"))) for r in ((10,), (10, 11)))
    assert small <= large <= set(ids(SecureTables(tables, Context(1)).owner("documents")))


def test_history_and_derived_rows(tables):
    s = lambda c: SecureTables(tables, c)
    assert ids(s(Context(1, (), 5)).table("queries")) == [1] and ids(s(Context(1, (), 5, True)).table("queries")) == [1, 2] and ids(s(Context(1)).table("queries")) == []
    assert ids(s(Context(1, (), 6)).table("query_citations")) == [2] and ids(s(Context()).table("query_citations")) == []


def test_unknown_tables_fail_closed(tables):
    with pytest.raises(AccessDenied):
        SecureTables({**tables, "secrets": tables["queries"]}, Context(1)).table("secrets")
    with pytest.raises(KeyError):
        SecureTables(tables, Context(1)).table("nothing")
    assert SecureTables(tables, Context()).table("embedding_spaces").count() == 1


def test_narrowing():
    ctx = Context(1, (1, 2, 3))
    assert ctx.narrowed([2]).label_ids == (2,) and ctx.narrowed([]) is ctx and ctx.narrowed(None) is ctx
    with pytest.raises(AccessDenied) as e:
        ctx.narrowed([2, 9])
    assert e.value.missing == [9]


def test_scope(spark, tables):
    s = SecureTables(tables, Context(1, (10,)))
    assert ids(s.scoped("chunks", [1, 3])) == [10] and ids(s.scoped("chunks", [])) == [10, 20, 40]
    assert ids(s.beyond(spark.createDataFrame([(1,), (3,), (5,), (5,)], "id bigint"))) == [3, 5]


def test_policy_is_pushed_into_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "d")
    tables["documents"].write.parquet(path)
    plan = SecureTables({"documents": spark.read.parquet(path)}, Context(1)).table("documents").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant_id,1)" in plan


# -- access -------------------------------------------------------------------
def brute_widening(docs, roles, sources, target):
    after = lambda s: (s - sources) | {target} if s & sources else s
    sees = lambda d, r: not d or bool(d & r)
    return sum(any(not sees(d, r) and sees(after(d), after(r)) for r in roles) for d in docs)


@pytest.mark.parametrize("sources, target", [({1}, 2), ({1, 3}, 2), ({2}, 9), ({7}, 1)])
def test_merge_preview_equals_sets(spark, sources, target):
    docs = [set(), {1}, {2}, {1, 3}, {3}, {1, 2}, {4}]
    roles = [set(), {1}, {2}, {3}, {2, 4}, {9}]
    d = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(docs)], "id bigint, label_ids array<bigint>")
    r = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(roles)], "role_id bigint, label_ids array<bigint>")
    row = access.merge_preview(d, r, sources, target).first()
    assert row["documents_relabelled"] == sum(bool(x & sources) for x in docs)
    assert row["visibility_widening"] == brute_widening(docs, roles, sources, target)


def test_merge_apply_and_guards(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 5)], "document_id bigint, label_id bigint")
    assert {tuple(r) for r in access.merge_apply(b, "document_id", [1], 2).collect()} == {(1, 2), (2, 2), (3, 5)}
    for bad in (({1}, 1, {1, 2}, set()), (set(), 1, {1}, set()), ({1}, 2, {1, 2}, {1})):
        with pytest.raises(ValueError):
            access.check_merge(*bad)
    with pytest.raises(AccessDenied):
        access.check_merge({1}, 2, {1}, set())
    access.check_merge({1}, 2, {1, 2}, {3})


def test_reach_needs_clearance(spark):
    ur = spark.createDataFrame([(1, 1), (2, 2)], "user_id bigint, role_id bigint")
    roles = spark.createDataFrame([(1, 1), (2, 5)], "id bigint, priority_level int")
    rl = spark.createDataFrame([(1, 100)], "role_id bigint, label_id bigint")
    ug = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "user_id bigint, group_id bigint")
    gl = spark.createDataFrame([(7, 200), (7, 201)], "group_id bigint, label_id bigint")
    labels = spark.createDataFrame([(100, 9), (200, 0), (201, 5)], "id bigint, priority_level int")
    got = {tuple(r) for r in access.label_reach(ur, roles, rl, ug, gl, labels).collect()}
    assert got == {(1, 100), (1, 200), (2, 200), (2, 201)}


def test_replace_set_and_creator_grant(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "role_id bigint, label_id bigint")
    new = spark.createDataFrame([(1, 9), (2, None)], "role_id bigint, label_id bigint")
    assert {tuple(r) for r in access.replace_set(b, "role_id", "label_id", new).collect()} == {(1, 9)}
    ur = spark.createDataFrame([(5, 2), (5, 3)], "user_id bigint, role_id bigint")
    assert {tuple(r) for r in access.granted_to_creator(b, ur, 5, 8).collect()} == {(1, 1), (1, 2), (2, 3), (2, 8), (3, 8)}


def test_lifecycle_and_namespace(spark):
    assert access.transition("active", "suspended") == "suspended"
    for a, b in (("active", "purging"), ("purged", "active"), ("suspended", "purged")):
        with pytest.raises(ValueError):
            access.transition(a, b)
    d = spark.createDataFrame([("legal",), ("legal/eu",), ("legal-hold",), ("other/legal",), (None,)], "name string")
    assert [r[0] for r in d.where(access.in_namespace("name", "legal")).collect()] == ["legal", "legal/eu"]


def test_visible_labels(spark):
    d = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert access.visible_labels(d, [], False).count() == 0 and access.visible_labels(d, [2], False).count() == 1 and access.visible_labels(d, [], True).count() == 2


