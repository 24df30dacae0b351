"""Problem 6: passages of held-out items inside a corpus.

Method: each task turns its documents into letters (case, accents, Unicode
form, punctuation, invisible characters, markup, entities and line breaks make
no difference), joins them into shards of a bounded number of letters, builds
an FM-index of each shard, searches every run of ``words`` consecutive words of
the items backward through wavelet ranks, locates the hits by sampled suffix
positions and merges them into removal spans. Nothing is shuffled but the hits.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.fm_index import FMIndex

SPANS = "doc_id bigint, item_id bigint, span_start int, span_end int"
BLOCK_TAG = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|tr|td|th|table|thead|tbody|h[1-6]|blockquote|pre|section|article|header|footer)\b[^<>]{0,500}>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]{0,500}>", re.S)
# A tag of any length is one if all in it are attributes; otherwise "<" may be prose. Possessive, so a scan never turns back.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'<>`]++)"""
_BARE = "allowfullscreen|async|autofocus|autoplay|checked|controls|default|defer|disabled|download|hidden|ismap|itemscope|loop|multiple|muted|novalidate|open|readonly|required|reversed|selected"
LONG_TAG = re.compile(rf"""</?([A-Za-z][\w:.-]*+)(?:\s++(?:[^\s"'<>/=]++\s*+=\s*+{_VALUE}|(?:{_BARE})\b))*+\s*+/?>""", re.I)
_TARGET = r"[^()\s]"
for _ in range(8):
    _TARGET = rf"(?:[^()\s]|\({_TARGET}*+\))"
LINK = re.compile(rf"""\]\(\s*+(?:<[^<>\n]*+>|{_TARGET}*+)(?:\s++(?:"[^"]*+"|'[^']*+'|\([^()]*+\)))?+\s*+\)""")
SHARD_LETTERS = 2_000_000
ITEM_LETTERS = 4_000_000
BLOCKS_KEPT = 2
KEY_LETTERS = 64


def _classes() -> np.ndarray:
    """0: separates words, 1: letter or digit, 2: invisible or combining."""
    kind = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalnum():
            kind[cp] = 1
        elif cp > 127 and unicodedata.category(ch) in ("Mn", "Me", "Cf"):
            kind[cp] = 2
    # Soft hyphen, Hangul fillers and the blank Braille cell, invisible whatever their category.
    kind[[0x00AD, 0x115F, 0x1160, 0x2800, 0x3164, 0xFFA0]] = 2
    return kind


_KIND: list = []


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised letters and digits, and whether each starts a word."""
    if not _KIND:
        _KIND.append(_classes())
    if "&" in text:
        for _ in range(2):
            text = html.unescape(text)
    if "](" in text:
        text = LINK.sub("]", text)
    if "<" in text:
        text = LONG_TAG.sub(lambda m: "\n" if BLOCK_TAG.match(f"<{m[1]}>") else "", text)
        text = TAG.sub("", BLOCK_TAG.sub("\n", text))
    if "](" in text:
        text = LINK.sub("]", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = text.casefold()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[0][cp]
    seen = cp[kind != 2]
    kind = kind[kind != 2]
    keep = kind == 1
    after = np.r_[True, ~keep[:-1]] if len(keep) else keep
    return seen[keep], after[keep]


def symbols(cp: np.ndarray) -> np.ndarray:
    """Letters as 1 .. 62: a-z and 0-9 have their own, all others share 26 by remainder and are compared again at a hit."""
    out = (37 + cp % 26).astype(np.uint8)
    low = (cp >= 97) & (cp <= 122)
    out[low] = (cp[low] - 96).astype(np.uint8)
    digit = (cp >= 48) & (cp <= 57)
    out[digit] = (cp[digit] - 21).astype(np.uint8)
    return out


class Phrases:
    """All runs of ``words`` consecutive words of the passages, each with the items that hold it."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        found: dict[bytes, set] = {}
        for item, passage in items:
            cp, start = letters(passage)
            at = np.flatnonzero(start)
            ends = np.r_[at[1:], len(cp)]
            for i in range(len(at) - words + 1):
                found.setdefault(cp[at[i] : ends[i + words - 1]].tobytes(), set()).add(item)
        self.items = [sorted(v) for v in found.values()]
        self.cp = [np.frombuffer(k, np.uint32) for k in found]
        self.length = np.array([len(c) for c in self.cp], np.int64)
        # What is searched in the index: the first letters; the rest is compared where they occur.
        self.searched = np.minimum(self.length, KEY_LETTERS)
        self.table = symbols(np.concatenate([c[:KEY_LETTERS] for c in self.cp])) if found else np.zeros(0, np.uint8)
        odd = np.r_[0, np.cumsum(self.table >= 37)]
        ends = np.cumsum(self.searched)
        self.plain = (odd[ends] == odd[ends - self.searched]) & (self.length <= KEY_LETTERS)


class Shard:
    """Documents (letters, word starts) one after the other, and their index."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        size = np.array([len(c) + 1 for c, _ in docs])
        self.base = np.r_[0, np.cumsum(size)]
        s = np.zeros(int(self.base[-1]), np.uint8)
        self.cp = np.zeros(len(s), np.uint32)
        self.start = np.ones(len(s) + 1, bool)
        for (c, w), b in zip(docs, self.base):
            s[b : b + len(c)] = symbols(c)
            self.cp[b : b + len(c)] = c
            self.start[b : b + len(c)] = w
        self.index = FMIndex(s)

    def find(self, phrases: Phrases) -> list[tuple[int, int, int]]:
        """(document, letter offset, phrase) of every occurrence that starts and ends at word boundaries."""
        lo, hi = self.index.search(phrases.table, phrases.searched)
        many = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(many)), many)
        rows = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        pos = self.index.locate(rows)
        end = pos + phrases.length[which]
        good = end < len(self.start)
        good[good] = self.start[pos[good]] & self.start[end[good]]
        out = []
        for p, w in zip(pos[good], which[good]):
            if not phrases.plain[w] and not np.array_equal(self.cp[p : p + phrases.length[w]], phrases.cp[w]):
                continue
            d = int(np.searchsorted(self.base, p, side="right")) - 1
            out.append((d, int(p - self.base[d]), int(w)))
        return out


def _spans(doc: int, hits: list[tuple[int, int]], phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """Hits (letter offset, phrase) of one document, overlapping ones of an item merged."""
    by_item: dict[int, list] = {}
    for at, w in hits:
        for item in phrases.items[w]:
            by_item.setdefault(item, []).append((at, at + int(phrases.length[w])))
    out = []
    for item, parts in by_item.items():
        parts.sort()
        a, b = parts[0]
        for x, y in parts[1:]:
            if x > b:
                out.append((doc, item, a, b))
                a, b = x, y
            b = max(b, y)
        out.append((doc, item, a, b))
    return out


def _search(docs: DataFrame, blocks: list, words: int, shard_letters: int) -> DataFrame:
    """Spans of the items of all blocks: each shard is indexed once, and every block is searched in it."""

    def run(batches):
        kept: dict[int, Phrases] = {}

        def phrases():
            for i, b in enumerate(blocks):
                if i in kept:
                    yield kept[i]
                    continue
                p = Phrases(b.value, words)
                if i < BLOCKS_KEPT:
                    kept[i] = p
                yield p

        def batch(rows):
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "item_id", "span_start", "span_end"])

        def flush(held):
            shard, out = Shard([h[1] for h in held]), []
            for p in phrases():
                hits: dict[int, list] = {}
                for d, at, w in shard.find(p):
                    hits.setdefault(d, []).append((at, w))
                out += [r for d, h in hits.items() for r in _spans(held[d][0], h, p)]
            return batch(out)

        def long(doc, c, w):
            # A document longer than a shard is indexed in overlapping pieces, each searched for all blocks.
            overlap = max((int(p.length.max(initial=0)) for p in phrases()), default=0)
            hits: list[set] = [set() for _ in blocks]
            for a in range(0, len(c), shard_letters):
                shard = Shard([(c[a : a + shard_letters + overlap], w[a : a + shard_letters + overlap])])
                last = a + shard_letters + overlap >= len(c)
                for i, p in enumerate(phrases()):
                    for _, at, k in shard.find(p):
                        e = a + at + int(p.length[k])
                        if last or e >= len(c) or w[e]:
                            hits[i].add((a + at, k))
            return batch([r for p, h in zip(phrases(), hits) for r in _spans(doc, sorted(h), p)])

        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c, w = letters(text)
                if len(c) > shard_letters:
                    yield long(doc, c, w)
                    continue
                held.append((doc, (c, w)))
                size += len(c) + 1
                if size >= shard_letters:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, SPANS)


def leaked_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", passage_col: str = "passage", words: int = 12, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """Where documents contain at least ``words`` consecutive words of an item's passage: (doc_id, item_id, span_start, span_end).

    A word of a passage is a run of its normalised letters and digits; a match
    starts and ends at word boundaries of the document, while breaks inside it
    do not count. Spans are offsets into the document's normalised letters,
    overlapping spans of an item merged. Passages with fewer words, NULL or
    empty passages, texts and ids have no rows; passages that share text are
    all reported; a repeated document is reported under each of its ids. Texts
    of any length are indexed whole. The held-out items go to the tasks in
    blocks of about ``ITEM_LETTERS`` characters, loaded one after the other, so
    no broadcast grows with them; the corpus is read and indexed once, whatever
    their number. Empty tables give no rows; extra columns are not read.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null and length(text) > 0")
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage_col).alias("p")).where("i is not null and p is not null").distinct()
    spread = documents.sparkSession.sparkContext.broadcast
    blocks, block, size = [], [], 0
    for r in rows.orderBy("i", "p").toLocalIterator():
        if block and size + len(r["p"]) > ITEM_LETTERS and r["i"] != block[-1][0]:
            blocks.append(spread(block))
            block, size = [], 0
        block.append((r["i"], r["p"]))
        size += len(r["p"])
    if block:
        blocks.append(spread(block))
    return _search(docs if blocks else docs.limit(0), blocks, words, shard_letters)


def leaked_documents(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The distinct (doc_id, item_id) of ``leaked_spans``."""
    return leaked_spans(documents, items, **options).select("doc_id", "item_id").distinct()
