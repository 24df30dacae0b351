"""Leaked passages (p6)."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import leaks
from quillspan.llm.fm_index import FMIndex, suffix_order

PASSAGE = "Le comité décide que la réserve du siège paie 357 euros à la région pour œuvre Zürich avant midi demain"
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, passage string"


@given(st.lists(st.integers(0, 3), max_size=300))
@settings(max_examples=80, deadline=None)
def test_suffix_order(s):
    b = bytes(s)
    assert list(suffix_order(np.array(s, np.uint8), 6)) == sorted(range(len(b)), key=lambda i: b[i:])


@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.lists(st.integers(0, 3), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_search_and_locate(s, p):
    f = FMIndex(np.array(s, np.uint8), sample=4)
    lo, hi = f.search(np.array([3, *p], np.uint8), np.array([1, len(p)]))
    b = bytes(s)
    assert sorted(f.locate(np.arange(lo[1], max(lo[1], hi[1])))) == [i for i in range(len(b)) if b.startswith(bytes(p), i)]


def words(n, start=0):
    return " ".join(PASSAGE.split()[start : start + n])


VARIANTS = {
    "plain": words(12),
    "longer": f"Avant. {words(14)} et après",
    "case": words(12, 2).upper(),
    "accents": "comite decide que la reserve du siege paie 357 euros a la",
    "decomposed": "comité décide que la réserve du siège paie 357 euros à la",
    "punctuation": "comité: décide, que (la) réserve - du siège; paie “357” euros... à la",
    "invisible": "comi­té dé​cide que la réserve du siège paie 357 euros à la",
    "fillers": "com\u3164ité déci\u2800de que\ufeff la ré\u2062serve du siège paie 357 euros à la",
    "markup": "<p>comité <b>décide</b> que la rés<i>erve</i> du siège **paie** 357 _euros_ à la</p>",
    "entities": "comit&eacute;&nbsp;d&eacute;cide que la r&#233;serve du si&egrave;ge paie 357 euros &agrave; la",
    "lines": "comité\ndécide que\r\nla réserve du siège paie\n\n357 euros à la",
    "broken word": "comité décide que la réser-\nve du siège paie 357 euros à la",
    "broken bare": "comité décide que la réser\nve du siège paie 357 euros à la",
}
CLEAN = {
    "eleven": words(11),
    "gap": f"{words(6)} vraiment {words(6, 6)}",
    "swapped": "décide comité que la réserve du siège paie 357 euros à la",
    "half a word": "xcomité décide que la réserve du siège paie 357 euros à la",
    "half a word at the end": words(11) + "x",
    "other number": words(12).replace("357", "358"),
}


def test_variants(spark):
    rows = [(i, t) for i, t in enumerate(VARIANTS.values())] + [(100 + i, t) for i, t in enumerate(CLEAN.values())] + [(200, None), (201, ""), (202, "   "), (None, words(12))]
    got = leaks.leaked_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, PASSAGE), (8, None), (9, words(11)), (None, PASSAGE)], ITEMS)).collect()
    names = [*VARIANTS]
    assert {names[r["doc_id"]] if r["doc_id"] < 100 else r["doc_id"] for r in got} == set(VARIANTS)
    assert {r["item_id"] for r in got} == {7}


def test_shared_passages_and_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "a " + PASSAGE), (2, PASSAGE), (2, PASSAGE)], DOCS)
    items = spark.createDataFrame([(1, PASSAGE), (2, "Autre. " + PASSAGE), (2, PASSAGE)], ITEMS)
    assert {tuple(r) for r in leaks.leaked_documents(docs, items).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_spans_merge_and_count_letters(spark):
    docs = spark.createDataFrame([(1, f"Un début. {words(14)} — milieu — {words(12, 3)}")], DOCS)
    got = sorted((r["span_start"], r["span_end"]) for r in leaks.leaked_spans(docs, spark.createDataFrame([(1, PASSAGE)], ITEMS)).collect())
    n = lambda t: len(leaks.letters(t)[0])
    a = n("Un début")
    assert got == [(a, a + n(words(14))), (a + n(words(14)) + n("milieu"), a + n(words(14)) + n("milieu") + n(words(12, 3)))]


@pytest.mark.parametrize("size", [40, 70, 200, 5000])
def test_shards_of_any_size_agree(spark, size):
    filler = "Autre texte sans rapport avec la chose. " * 30
    docs = spark.createDataFrame([(1, filler + PASSAGE + filler), (2, filler), (3, words(12))], DOCS)
    assert {r["doc_id"] for r in leaks.leaked_documents(docs, spark.createDataFrame([(1, PASSAGE)], ITEMS), shard_letters=size).collect()} == {1, 3}


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_LETTERS", 60)
    docs = spark.createDataFrame([(1, PASSAGE), (2, "rien")], DOCS)
    items = spark.createDataFrame([(i, PASSAGE + f" {i}") for i in range(5)], ITEMS)
    assert leaks.leaked_documents(docs, items).count() == 5


def test_empty_tables_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, PASSAGE)], DOCS).withColumns({"item_id": F.lit(3), "p": F.lit("x"), "passage": F.lit("y")})
    items = spark.createDataFrame([(1, PASSAGE)], ITEMS).withColumns({"doc_id": F.lit(3), "i": F.lit("x")})
    assert leaks.leaked_documents(docs, items).count() == 1
    assert leaks.leaked_documents(docs.where("false"), items).collect() == []
    assert leaks.leaked_documents(docs, items.where("false")).collect() == []


def test_non_latin_letters_are_compared_exactly(spark):
    greek = "ένα δύο τρία τέσσερα πέντε έξι επτά οκτώ εννέα δέκα έντεκα δώδεκα"
    docs = spark.createDataFrame([(1, greek.upper()), (2, greek.replace("δέκα", "δέκβ"))], DOCS)
    assert {r["doc_id"] for r in leaks.leaked_documents(docs, spark.createDataFrame([(1, greek)], ITEMS)).collect()} == {1}


LONG_MARKUP = {
    "image data": f'comité décide <img src="data:image/png;base64,{"QUJD" * 400}==" alt="a > b"/>que la réserve du siège paie 357 euros à la',
    "attribute list": f"comité décide <span {' '.join(f'data-k{i}="v{i}"' for i in range(90))} hidden>que la réserve</span> du siège paie 357 euros à la",
    "long target": f"comité [décide](https://x.org/{'a' * 3000}) que la réserve du siège paie 357 euros à la",
    "link title": "comité [décide](https://x.org/p \"Un titre\") que la [réserve](<u> 'deux mots') du siège paie 357 euros à la",
    "nested brackets": "comité [décide](https://x.org/a_(b_(c))_d) que la réserve du siège paie 357 euros à la",
}


@pytest.mark.parametrize("name", LONG_MARKUP)
def test_markup_of_any_length_makes_no_difference(name):
    plain = leaks.letters("comité décide que la réserve du siège paie 357 euros à la")
    assert all(np.array_equal(a, b) for a, b in zip(leaks.letters(LONG_MARKUP[name]), plain))


def test_prose_after_a_less_than_sign_stays():
    prose = "où <b vaut moins " + "mot, " * 200 + "et c> d"
    assert len(leaks.letters(prose)[0]) > 600


def test_unclosed_markup_is_scanned_in_linear_time():
    for t in ("<a b=" * 50_000, '<a b="' * 50_000, "](" * 100_000, "](a " * 50_000, "<a " * 50_000):
        leaks.letters(t)


def test_a_passage_with_a_very_long_word_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_LETTERS", 40)
    giant = "x" * 50_000
    items = [(i, words(12, i % 3)) for i in range(6)] + [(9, f"{words(12)} {giant} {words(12)}"), (10, words(11))]
    docs = [(1, words(16)), (2, f"{words(11, 1)} {giant} {words(2)}"), (3, "nothing here")]
    df = spark.createDataFrame(docs, DOCS)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_documents(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, i) for i in (0, 1, 2, 3, 4, 5, 9)} | {(2, 9)}
    assert got == {(r["doc_id"], r["item_id"]) for r in leaks.leaked_documents(df, spark.createDataFrame(items, ITEMS), shard_letters=60_000).collect()}
