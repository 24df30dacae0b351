"""Source mixtures (p7)."""

import os

import pytest

from quillspan.llm import mixture
from quillspan.llm.mixture import Mixture

VOCABULARY = os.path.join(mixture.TOKENIZERS, "byte_bpe_multi_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
DOCS, TARGETS = "doc_id bigint, source string, text string", "source string, target_share double, max_repeats int"


def docs(spark, spec):
    rows, n = [], 0
    for source, count, words in spec:
        for i in range(count):
            rows.append((n, source, "word " * (words + i % 7)))
            n += 1
    return spark.createDataFrame(rows, DOCS)


def test_token_counts():
    special = "<|endoftext|> and é 漢字"
    enc = mixture.encoding(VOCABULARY)
    assert enc.decode(enc.encode_ordinary(special)) == special
    long = "lorem ipsum " * 9000
    whole, cut = len(enc.encode_ordinary(long)), mixture.token_counts([long, "", "a"], VOCABULARY)
    assert cut == [whole, 0, 1]


def test_shares_are_reached(spark):
    d = docs(spark, [("a", 400, 20), (" B ", 300, 60), ("c", 200, 10), ("untargeted", 50, 30)])
    t = spark.createDataFrame([("A", 0.5, 5), ("b", 0.3, 2), ("c", 0.2, 9)], TARGETS)
    m = Mixture(d, t)
    total = sum(r["tokens"] for r in m.docs.collect())
    for r in m.rates().groupBy("source").agg({"rate": "max"}).collect():
        assert r[1] <= {"a": 5, "b": 2, "c": 9}[r["source"]]
    want = {r["source"]: r["target_share"] for r in m.report().collect()}
    for r in m.rates().selectExpr("source", "rate * tokens as x").groupBy("source").sum("x").collect():
        assert abs(r[1] / total - want[r["source"]]) < 1e-6
    for r in m.report().collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.03 and not r["short"]


def test_rates_are_the_nearest_in_entropy(spark):
    """Rates exp(m * tokens) are stationary: their logarithm is linear in the tokens, below the cap."""
    import math

    m = Mixture(docs(spark, [("a", 50, 10), ("b", 50, 100)]), spark.createDataFrame([("a", 0.3, 50), ("b", 0.5, 3)], TARGETS))
    for s in ("a", "b"):
        ratio = {round(math.log(r["rate"]) / r["tokens"], 9) for r in m.rates().where(f"source = '{s}'").collect()}
        assert len(ratio) == 1


def test_short_sources_repeat_to_the_cap(spark):
    d = docs(spark, [("big", 500, 40), ("tiny", 5, 20), ("zero", 10, 10)])
    t = spark.createDataFrame([("big", 0.6, 2), ("tiny", 0.4, 3), ("zero", 0.0, 1), ("absent", 0.1, 4), ("none", 0.0, 4), (None, 0.5, 1)], TARGETS)
    assert {r["source"] for r in mixture.short_sources(d, t).collect()} == {"tiny", "absent"}
    rows = Mixture(d, t).rates().collect()
    assert {r["copies"] for r in rows if r["source"] == "tiny"} == {3}
    assert not [r for r in rows if r["source"] == "zero"]


def test_nulls_blanks_and_nothing(spark):
    rows = [(1, None, "text"), (2, "  ", "text"), (3, "a", None), (4, "a", " \n"), (5, "a", "real text"), (None, "a", "real text"), (6, "A ", "more real text")]
    d = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in mixture.document_tokens(d).collect()) == [5, 6]
    t = spark.createDataFrame([("a", None, None), ("a", 0.2, 1), ("b", -1.0, 2)], TARGETS)
    assert [r["source"] for r in mixture.short_sources(d, t).collect()] == []
    assert mixture.short_sources(d.where("false"), t).collect() == []
    assert mixture.short_sources(d, t.where("false")).collect() == []
    assert Mixture(d, t.where("false")).rates().collect() == []


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    d = docs(spark, [("a", 20, 10)]).withColumns({"tokens": F.lit("x"), "cap": F.lit(1), "share": F.lit(2), "rate": F.lit(3)})
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS).withColumns({"tokens": F.lit(1), "doc_id": F.lit(2)})
    assert sum(r["copies"] for r in Mixture(d, t).rates().collect()) == 20


def test_short_is_read_from_the_solution(spark, monkeypatch):
    d = docs(spark, [("a", 100, 20), ("b", 100, 20)])
    t = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], TARGETS)
    assert mixture.short_sources(d, t).collect() == []
    solve = Mixture._solve
    monkeypatch.setattr(Mixture, "_solve", lambda self, rounds: solve(self, rounds).selectExpr("source", "m - 2 as m", "unit", "cap"))
    assert {r["source"] for r in mixture.short_sources(d, t).collect()} == {"a", "b"}


@pytest.mark.parametrize("text", ["x" * 70_000, "漢字" * 30_000, "ab1_" * 20_000 + " cd", "word  word\n word " * 5000, "a. b'll - 12 " * 6000])
def test_long_texts_count_as_if_whole(text):
    assert mixture.token_counts([text], VOCABULARY) == [len(mixture.encoding(VOCABULARY).encode_ordinary(text))]
