"""Problem 2: texts above a size limit cut into overlapping pieces.

Two rules for where a piece ends share one operator. ``separators`` is the
embedding service's own rule (blank line, then sentence end, then line end),
whose cuts are prescribed exactly and so cannot be chosen by cohesion.
``cohesion`` is lexical-cohesion segmentation (Hearst's TextTiling): the
similarity of the word blocks left and right of every natural boundary is
computed along the text, and each piece ends at the deepest valley within its
window.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "chunk_id bigint, piece_start int, piece_end int"
SEPARATORS = ("\n\n", ". ", "\n")
GAP = re.compile(r"(?:[.!?…]['\"»”)\]]*\s+)|\n+")
WORD = re.compile(r"[^\W\d_]{3,}")


def separator_end(text: str, start: int, limit: int, least: float) -> int:
    """End of the piece that starts at ``start`` and does not reach the end of the text."""
    for sep in SEPARATORS:
        at = text.rfind(sep, start, start + limit)
        if at - start > least:
            return at + len(sep)
    return start + limit


def cohesion_gaps(text: str, block: int = 6) -> list[tuple[int, float]]:
    """(offset, depth) of every natural boundary inside the text, in order.

    The score of a boundary is the cosine of the word counts of the ``block``
    sentences before and after it; its depth is how far the score lies below
    the nearest peaks on both sides. Running sums make it linear in the text.
    """
    cuts = [m.end() for m in GAP.finditer(text)]
    if cuts and cuts[-1] == len(text):
        cuts.pop()
    if not cuts:
        return []
    bags = [Counter(WORD.findall(text[a:b].lower())) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    left: Counter = Counter()
    right: Counter = Counter()
    for b in bags[1 : 1 + block]:
        right.update(b)
    scores = []
    for i in range(len(cuts)):
        left.update(bags[i])
        if i >= block:
            left.subtract(bags[i - block])
            left += Counter()
        if i:
            right.subtract(bags[i])
            right += Counter()
            if i + block < len(bags):
                right.update(bags[i + block])
        small, large = (left, right) if len(left) < len(right) else (right, left)
        both = sum(n * large[w] for w, n in small.items() if w in large)
        size = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        scores.append(both / size if size else 0.0)
    n = len(scores)
    up_left, up_right = scores[:], scores[:]
    for i in range(1, n):
        if scores[i - 1] >= scores[i]:
            up_left[i] = max(up_left[i - 1], scores[i - 1])
    for i in range(n - 2, -1, -1):
        if scores[i + 1] >= scores[i]:
            up_right[i] = max(up_right[i + 1], scores[i + 1])
    return [(c, up_left[i] + up_right[i] - 2 * s) for i, (c, s) in enumerate(zip(cuts, scores))]


def pieces(text: str, limit: int = 1200, overlap: int = 150, fill: float = 0.6, method: str = "separators") -> list[tuple[int, int]]:
    """[start, end) of each piece of one text, in code points."""
    least, out, start, n = fill * limit, [], 0, len(text)
    gaps = cohesion_gaps(text) if method == "cohesion" and n > limit else []
    first = 0
    while n - start > limit:
        if method == "separators":
            end = separator_end(text, start, limit, least)
        else:
            while first < len(gaps) and gaps[first][0] <= start + least:
                first += 1
            best, at = -1.0, 0
            for g in range(first, len(gaps)):
                if gaps[g][0] > start + limit:
                    break
                if gaps[g][1] >= best:
                    best, at = gaps[g][1], gaps[g][0]
            if not at:
                blank = max(text.rfind(" ", start, start + limit), text.rfind("\n", start, start + limit))
                at = blank + 1 if blank - start > least else start + limit
            end = at
        out.append((start, end))
        start = max(end - overlap, start + 1)
    out.append((start, n))
    return [(a, b) for a, b in out if not text[a:b].isspace()]


def split_oversized(chunks: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = 1200, overlap: int = 150, fill: float = 0.6, method: str = "separators") -> DataFrame:
    """Pieces of every text of more than ``limit`` characters: (chunk_id, piece_start, piece_end).

    Characters are code points of the text as stored; offsets are 0-based, the
    end exclusive. A piece has at most ``limit`` characters, ends in the last
    ``1 - fill`` of its window at a natural boundary where there is one, and
    the next starts ``overlap`` characters before its end. Pieces of white
    space only are left out. Of an id delivered with different oversized texts
    the latest ``loaded_at`` counts (the greatest text, if that ties or the
    column is absent). Texts at the limit, NULL and empty texts and NULL ids
    have no pieces; an empty table gives no rows. The length test runs in the
    JVM, so only oversized texts, once each, reach Python.
    """
    if method not in ("separators", "cohesion"):
        raise ValueError(f"unknown method {method!r}")
    if not 0 <= overlap < fill * limit:
        raise ValueError("the overlap must be less than the least size of a piece")
    late = F.col("loaded_at") if "loaded_at" in chunks.columns else F.lit(None).cast("timestamp")
    big = chunks.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), late.alias("late")).where((F.length("text") > limit) & F.col("id").isNotNull())
    once = big.groupBy("id").agg(F.max_by("text", F.struct("late", "text")).alias("text"))

    def cut(batches):
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in pieces(t, limit, overlap, fill, method):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["chunk_id", "piece_start", "piece_end"])

    return once.mapInArrow(cut, PIECES)
