"""Problem 7: documents drawn so that each source makes up a target share of the tokens.

Method: entropy balancing. Among all document rates between 0 and a source's
cap that meet the sources' token targets, the one nearest to taking every
document once (in relative entropy) is an exponential tilt of the document's
size, cut at the cap. Its multipliers solve a convex dual, found by Newton
steps whose gradient and curvature are distributed aggregates over the
documents; the rates are then rounded into copies.
"""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.core.workspace import stored

TOKENIZERS = os.environ.get("QUILLSPAN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pre-tokenisation pattern that belongs to byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Text is cut for encoding only before a blank that a letter or digit follows and none precedes: the pattern begins a piece there, so no count changes.
CUT = re.compile(r"(?<=\S) (?=[^\W_])")
PIECE_LETTERS = 20_000
_LOADED: dict = {}
#: A source is balanced when what it gives is this near its target, as a share of it.
TOLERANCE = 1e-9


def encoding(path: str):
    """A tiktoken encoding from a vocabulary file of ranks; loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(texts: list, path: str) -> list[int]:
    """Tokens of each text; special tokens in a text are ordinary text.

    Very long texts are encoded piece after piece, cut where the tokenizer's
    own pattern begins a piece, so the counts are those of the whole text. A
    run without such a place is encoded in one piece, however long.
    """
    enc = encoding(path)
    out = []
    for t in texts:
        n, at = 0, 0
        while at < len(t):
            cut = CUT.search(t, at + PIECE_LETTERS) if len(t) - at > PIECE_LETTERS else None
            end = cut.start() if cut else len(t)
            n += len(enc.encode_ordinary(t[at:end]))
            at = end
        out.append(n)
    return out


def document_tokens(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents that have a source and a text that is not blank.

    ``source`` is trimmed and lower case; blank sources count as none. The
    vocabulary file is a parameter; by default it is the multilingual byte-level
    one in the folder ``QUILLSPAN_TOKENIZERS`` names.
    """
    path = tokenizer or os.path.join(TOKENIZERS, "byte_bpe_multi_50k.tiktoken")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text").where("doc_id is not null and length(source) > 0 and text rlike '\\\\S'")

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(token_counts(b.column(2).to_pylist(), path), pa.int64())], ["doc_id", "source", "tokens"])

    return docs.mapInArrow(count, "doc_id bigint, source string, tokens bigint")


class Mixture:
    """The balanced mixture of ``documents`` by ``targets`` (source, target_share, max_repeats).

    budget: tokens of the corpus to make; default all tokens of documents with
    a source. Targets with a NULL or negative share or cap count as 0; of
    repeated sources the shares add up and the greatest cap holds; sources
    without a target are not drawn. Ties and repeated documents need no care:
    every row is a document of its own. Empty documents or targets give empty
    results. A source falls short if the balanced rates leave it below its
    target: its multiplier has grown until every document is drawn at the cap
    and the tokens so drawn are still too few, or it has no tokens to draw.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, budget: float | None = None, tokenizer: str | None = None, rounds: int = 100):
        self.docs = stored(document_tokens(documents, tokenizer), "tokens")
        goal = targets.select(F.lower(F.trim("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("double").alias("cap"))
        goal = goal.where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
        stats = self.docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
        total = self.docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
        self.plan = stored(goal.join(stats, "source", "left").crossJoin(F.broadcast(total)).withColumns({
            "tokens": F.coalesce("tokens", F.lit(0)),
            "docs": F.coalesce("docs", F.lit(0)),
            "want": F.col("share") * (F.lit(float(budget)) if budget is not None else F.col("total")),
        }), "plan")
        self.sizes = stored(self.docs.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("many")), "sizes")
        self.multipliers = self._solve(rounds)
        # What the solution draws, before rounding into copies, against the target.
        drawn = self.sizes.join(F.broadcast(self.multipliers), "source").groupBy("source").agg(F.sum(self._rate() * F.col("tokens") * F.col("many")).alias("reached"))
        reached = F.coalesce("reached", F.lit(0.0))
        self.plan = self.plan.join(F.broadcast(drawn), "source", "left").withColumn("short", F.col("want") - reached > TOLERANCE * F.col("want"))

    def _rate(self):
        """exp(multiplier * size relative to the source's mean), at most the cap."""
        return F.least(F.col("cap"), F.exp(F.least(F.col("m") * F.col("tokens") / F.col("unit"), F.lit(500.0))))

    def _solve(self, rounds: int) -> DataFrame:
        """(source, m, unit, cap) of the sources with something to draw.

        The dual is separable: one multiplier a source, kept in a table with
        one row per target source; each round is one aggregate over the sizes
        of each source, counted first, since documents of equal size have equal
        rates: what a round reads is bounded by the distinct sizes, and the
        corpus is read once. Newton steps are kept inside a bracket that every
        round tightens. A source whose documents are all at the cap cannot give
        more, and its multiplier stays there.
        """
        spark = self.docs.sparkSession
        sizes = self.sizes
        sources = self.plan.where("tokens > 0 and want > 0 and cap > 0").select("source", "want", "cap", "tokens", "docs").collect()
        state = {r["source"]: {"m": 0.0, "unit": max(1.0, r["tokens"] / r["docs"]), "cap": r["cap"], "want": r["want"], "lo": None, "hi": None, "done": False} for r in sources}
        kind = "source string, m double, unit double, cap double"
        for _ in range(rounds):
            live = [(s, v["m"], v["unit"], v["cap"]) for s, v in state.items() if not v["done"]]
            if not live:
                break
            now = F.broadcast(spark.createDataFrame(live, kind))
            got = sizes.join(now, "source").select("source", "tokens", "many", "unit", "cap", self._rate().alias("c")).groupBy("source").agg(
                F.sum(F.col("c") * F.col("tokens") * F.col("many")).alias("have"),
                F.sum(F.when(F.col("c") < F.col("cap"), F.col("c") * F.col("tokens") * F.col("tokens") / F.col("unit") * F.col("many")).otherwise(0.0)).alias("slope"),
                F.min((F.col("c") >= F.col("cap")) | (F.col("tokens") == 0)).alias("full"),
            )
            for r in got.collect():
                v = state[r["source"]]
                miss = r["have"] - v["want"]
                if abs(miss) <= TOLERANCE * v["want"] or (miss < 0 and r["full"]):
                    v["done"] = True
                    continue
                v["hi" if miss > 0 else "lo"] = v["m"]
                lo, hi = v["lo"], v["hi"]
                step = v["m"] - miss / r["slope"] if r["slope"] > 0 else None
                if step is None or (lo is not None and step <= lo) or (hi is not None and step >= hi):
                    # Outside the bracket: halve it, or look further on its open side.
                    step = (lo + hi) / 2 if lo is not None and hi is not None else (2 * abs(lo) + 1 + lo if hi is None else hi - 2 * abs(hi) - 1)
                v["m"] = step
        return spark.createDataFrame([(s, v["m"], v["unit"], v["cap"]) for s, v in state.items()], kind)

    def rates(self) -> DataFrame:
        """(doc_id, source, tokens, rate, copies) of the documents of target sources.

        Copies are the rate rounded down, plus one with the probability of the
        remainder, drawn from a hash of the doc_id: expected tokens stay as
        balanced and a document never exceeds its cap.
        """
        drawn = self.docs.join(F.broadcast(self.multipliers), "source").withColumn("rate", self._rate())
        draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
        copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
        return drawn.select("doc_id", "source", "tokens", "rate", copies.cast("int").alias("copies"))

    def report(self) -> DataFrame:
        """A row per target source: (source, target_share, tokens, docs, short, drawn_docs, copies, drawn_tokens, actual_share)."""
        used = self.rates().groupBy("source").agg(
            F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("drawn_docs"), F.sum(F.col("copies").cast("bigint")).alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("drawn_tokens")
        )
        rows = self.plan.join(used, "source", "left")
        whole = used.agg(F.sum("drawn_tokens").alias("whole"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        return rows.crossJoin(F.broadcast(whole)).select(
            "source", F.col("share").alias("target_share"), "tokens", "docs", "short", zero("drawn_docs"), zero("copies"), zero("drawn_tokens"), F.coalesce(F.col("drawn_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share")
        )


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Sources that the balanced solution leaves below their share of all tokens at ``max_repeats``: (source)."""
    return Mixture(documents, targets, tokenizer=tokenizer).report().where("short").select("source")
