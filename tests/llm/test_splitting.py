"""Oversized texts (p2)."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import splitting

CHUNKS = "id bigint, text string, loaded_at timestamp_ntz"


def plain(text, limit=1200, overlap=150):
    """The rule of the separators, written out."""
    out, s = [], 0
    while True:
        if len(text) - s <= limit:
            out.append((s, len(text)))
            break
        window = text[s : s + limit]
        for sep in ("\n\n", ". ", "\n"):
            at = window.rfind(sep)
            if at > 0.6 * limit:
                end = s + at + len(sep)
                break
        else:
            end = s + limit
        out.append((s, end))
        s = end - overlap
    return [(a, b) for a, b in out if text[a:b].strip()]


@given(st.text(alphabet="ab. \n\ré\U0001f600", min_size=0, max_size=900))
@settings(max_examples=150, deadline=None)
def test_rule_equals_its_statement(text):
    assert splitting.pieces(text, 100, 20) == plain(text, 100, 20) or not text


@given(st.text(alphabet="ab cd. \né", min_size=101, max_size=900))
@settings(max_examples=150, deadline=None)
def test_cohesion_pieces_cover_the_text(text):
    p = splitting.pieces(text, 100, 20, method="cohesion")
    assert all(b - a <= 100 for a, b in p)
    covered = set()
    for a, b in p:
        covered.update(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)


def test_cohesion_cuts_where_the_topic_changes():
    first = "The pump moves water through the valve. The valve of the pump leaks water. " * 6
    second = "The choir sings songs in the church. Songs of the choir fill the church. " * 6
    text = first + second
    cuts = [b for _, b in splitting.pieces(text, 700, 50, method="cohesion")]
    assert abs(cuts[0] - len(first)) <= 40


def test_split_over_spark(spark):
    late, early = dt.datetime(2025, 2, 1), dt.datetime(2025, 1, 1)
    long = "Sentence number one is here. " * 100
    huge = "x" * 50_000
    rows = [(1, long, early), (1, long, late), (2, "a" * 1200, early), (3, None, early), (4, "", early), (5, " " * 1300, early), (6, huge, early), (None, long, early), (7, "\U0001f600" * 1201, None), (8, "old " * 400, early), (8, "new. " * 400, late)]
    got = {}
    for r in splitting.split_oversized(spark.createDataFrame(rows, CHUNKS)).collect():
        got.setdefault(r["chunk_id"], []).append((r["piece_start"], r["piece_end"]))
    got = {k: sorted(v) for k, v in got.items()}
    assert set(got) == {1, 6, 7, 8}
    assert got[1] == plain(long) and got[6] == plain(huge) and got[7] == [(0, 1200), (1050, 1201)] and got[8] == plain("new. " * 400)


def test_split_of_nothing_and_odd_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "word. " * 300, None)], CHUNKS).withColumns({"late": F.lit(1), "chunk_id": F.lit("x"), "piece_start": F.lit(0)})
    assert splitting.split_oversized(df).count() == 2
    assert splitting.split_oversized(df.drop("loaded_at")).count() == 2
    assert splitting.split_oversized(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        splitting.split_oversized(df, method="other")
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=100, overlap=90)
