"""Measures of retrieval quality and latency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.retrieval import pair_cosines, unit_rows


def recall_mrr(results: DataFrame, truth: DataFrame, kinds: DataFrame, k: int = 8) -> DataFrame:
    """Per kind of question: (kind, questions, recall, mrr); a question's rank is that of its first true hit within k.

    ``results`` (query_id, chunk_id, rank), ``truth`` (query_id, chunk_id),
    ``kinds`` (query_id, kind). Questions without truth do not count.
    """
    first = results.where(F.col("rank") <= k).join(truth.distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = truth.select("query_id").distinct().join(kinds, "query_id").join(first, "query_id", "left")
    return asked.groupBy("kind").agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(F.col("first").isNotNull().cast("double")), 9).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"),
    )


def halves(lexical: DataFrame, dense: DataFrame, truth: DataFrame, k: int = 8) -> DataFrame:
    """(found_by, questions): which half has a true hit within k: both, lexical, dense, neither."""
    t = truth.distinct()
    hit = lambda r: r.where(F.col("rank") <= k).join(t, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct()
    q = t.select("query_id").distinct().join(hit(lexical).withColumn("l", F.lit(1)), "query_id", "left").join(hit(dense).withColumn("d", F.lit(1)), "query_id", "left")
    by = F.when(F.col("l").isNotNull() & F.col("d").isNotNull(), "both").when(F.col("l").isNotNull(), "lexical").when(F.col("d").isNotNull(), "dense").otherwise("neither")
    return q.groupBy(by.alias("found_by")).agg(F.count(F.lit(1)).alias("questions"))


def overlap(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """Per question the share of the exact top k that the approximate one has, and whether the first is the same: (query_id, recall, top1)."""
    e, a = exact.where(F.col("rank") <= k), approximate.where(F.col("rank") <= k)
    both = e.select("query_id", "chunk_id", F.col("rank").alias("re")).join(a.select("query_id", "chunk_id", F.col("rank").alias("ra")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.round(F.count("ra") / F.count(F.lit(1)), 9).alias("recall"), (F.count_if((F.col("re") == 1) & (F.col("ra") == 1)) > 0).alias("top1"))


def overlap_summary(per: DataFrame, below: float = 0.9) -> DataFrame:
    return per.agg(F.round(F.avg("recall"), 9).alias("recall"), F.min("recall").alias("worst"), F.count_if(F.col("recall") < below).alias("below"), F.count_if("top1").alias("top1_kept"))


def separation_bands(scores: DataFrame) -> DataFrame:
    """(signal, kind, low, median, high) of (signal, kind, score)."""
    return scores.groupBy("signal", "kind").agg(F.round(F.min("score"), 9).alias("low"), F.round(F.percentile("score", F.lit(0.5)), 9).alias("median"), F.round(F.max("score"), 9).alias("high"))


def separates(bands: DataFrame, good: str, bad: str) -> DataFrame:
    """(signal, separates): whether the worst good score beats the best bad one."""
    g = bands.where(F.col("kind") == good).select("signal", F.col("low").alias("g"))
    b = bands.where(F.col("kind") == bad).select("signal", F.col("high").alias("b"))
    return g.join(b, "signal").select("signal", (F.col("g") > F.col("b")).alias("separates"))


def log_fit(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Least squares of log10 y on log10 x: (slope, intercept); points that are not positive are left out."""
    p = points.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"))
    return p.agg(F.round(F.regr_slope("ly", "lx"), 6).alias("slope"), F.round(F.regr_intercept("ly", "lx"), 6).alias("intercept"))


def nearest_rank(df: DataFrame, key: str, value: str, fraction: float, rule: str = "floor") -> DataFrame:
    """A percentile of each key by position in the sorted values: 'floor' takes index min(n-1, int(n*f)), 'less' int(n*f)-1 (the last if negative, as an index from the end)."""
    order = Window.partitionBy(key).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    k = F.floor(n * F.lit(fraction))
    at = F.least(n - 1, k) if rule == "floor" else F.when(k >= 1, k - 1).otherwise(n - 1)
    return df.where(F.col(value).isNotNull()).select(key, value, (F.row_number().over(order) - 1).alias("i"), at.alias("at")).where("i = at").select(key, F.col(value).alias("percentile"))


def latency_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, p99, first_avg): discrete percentiles and the mean of the flagged first run of each."""
    return df.groupBy(key).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"), F.expr(f"percentile_disc(0.99) within group (order by {value})").alias("p99"), F.round(F.avg(F.when(F.col("i") == 1, F.col(value))), 9).alias("first_avg"))


def ranking_equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row comparing two rankings (query_id, chunk_id, rank, score): rows of each, missing scores, in both, at another rank, largest score difference."""
    both = a.select("query_id", "chunk_id", F.col("rank").alias("ra"), F.col("score").alias("sa")).join(b.select("query_id", "chunk_id", F.col("rank").alias("rb"), F.col("score").alias("sb")), ["query_id", "chunk_id"], "full")
    return both.agg(
        F.count("ra").alias("rows_a"),
        F.count("rb").alias("rows_b"),
        F.count_if((F.col("ra").isNotNull() & F.col("sa").isNull()) | (F.col("rb").isNotNull() & F.col("sb").isNull())).alias("null_scores"),
        F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("in_both"),
        F.count_if(F.col("ra") != F.col("rb")).alias("moved"),
        F.round(F.max(F.abs(F.col("sa") - F.col("sb"))), 6).alias("max_delta"),
    )


def label_shortlist(documents: DataFrame, labels: DataFrame, truth: DataFrame, block: int = 20_000) -> DataFrame:
    """(document_id, rank): the best position of a true label among all labels, by cosine with the document's mean vector.

    ``documents`` (document_id, embedding), ``labels`` (label_id, embedding),
    ``truth`` (document_id, label_id). Each document's best true label is found
    first; then the labels that come before it are counted, the labels going to
    the tasks in blocks of ``block`` that are loaded one after the other.
    Equal cosines, to nine digits, rank by label_id. Documents without a true
    label among the labels have no row.
    """
    lab = labels.where(F.col("embedding").isNotNull() & F.col("label_id").isNotNull()).select(F.col("label_id").cast("bigint").alias("label_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    doc = documents.select(F.col("document_id").cast("bigint").alias("document_id"), F.col("embedding").cast("array<double>").alias("x"))
    pairs = truth.select("document_id", "label_id").distinct().join(lab, "label_id").join(doc, "document_id")
    own = pair_cosines(pairs.select(F.col("document_id").alias("query_id"), F.col("label_id").alias("chunk_id"), F.col("x").alias("q"), "embedding"))
    best = own.groupBy(F.col("query_id").alias("document_id")).agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("minus"))).alias("b"))
    d = doc.join(best, "document_id").select("document_id", "x", F.col("b.score").alias("score"), (-F.col("b.minus")).alias("label_id"))
    spread = documents.sparkSession.sparkContext.broadcast
    blocks, ids, vs = [], [], []
    for r in lab.orderBy("label_id").toLocalIterator():
        ids.append(r["label_id"])
        vs.append(r["embedding"])
        if len(ids) == block:
            blocks.append(spread((np.array(ids, np.int64), np.array(vs, np.float64))))
            ids, vs = [], []
    if ids:
        blocks.append(spread((np.array(ids, np.int64), np.array(vs, np.float64))))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            score, mine = b.column(2).to_numpy()[:, None], b.column(3).to_numpy()[:, None]
            before = np.zeros(b.num_rows, np.int64)
            for known in blocks:
                other, e = known.value
                s = np.round(x @ unit_rows(e).T, 9)
                before += (((s > score) | ((s == score) & (other < mine))) & (other != mine)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((before + 1).astype(np.int32), pa.int32())], ["document_id", "rank"])

    return d.mapInArrow(run, "document_id bigint, rank int")


def shortlist_recall(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """(k, documents, found): how many documents have a true label among the first k, for each k."""
    each = ranks.select("document_id", "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("rank") <= F.col("k")).alias("found"))


def shortlist_length(ranks: DataFrame, share: float = 0.95) -> DataFrame:
    """(k): the shortest list that has a true label for at least ``share`` of the documents."""
    per = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    # One row per rank, thus at most as many as there are labels.
    run = per.select("rank", F.sum("n").over(Window.orderBy("rank")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return run.where(F.col("upto") >= share * F.col("all")).agg(F.min("rank").alias("k"))
