"""Ranked retrieval for many questions at once: lexical, dense and exact halves, fusion, relevance.

A set of questions is a DataFrame (query_id, ...). Questions are few next to
the corpus, but their number is not bounded: they are collected to the tasks
only after ``bounded`` has checked their size; beyond it the joins shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.core.workspace import stored
from quillspan.functions.text import analysed, is_identifier, postings

CANDIDATES, RRF_K, EXACT, DEFAULT_LIMIT, MAX_LIMIT = 50, 60, 10, 8, 50
OCCURRENCE_WEIGHT = 0.1
FLOOR, WEAK, LEXICAL_SHARE = 0.02, 0.15, 1 / 3
BROADCAST_ROWS = 20_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, score: str, k: int, by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each question with ``rank`` from 1; equal scores by the smaller id."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def question_lexemes(questions: DataFrame, id_col: str, text_col: str, stop: frozenset[str] = frozenset(), analyser: str = "simple") -> DataFrame:
    """(query_id, token), distinct; stop words left out. A question without lexemes has no rows."""
    q = questions.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(analysed(text_col, analyser))).alias("token")).where("token is not null")
    return q.where(~F.col("token").isin(sorted(stop))) if stop else q


def lexical_or(lexemes: DataFrame, chunks: DataFrame, id_col: str = "id", text_col: str = "text", k: int = CANDIDATES, analyser: str = "simple") -> DataFrame:
    """(query_id, chunk_id, score, rank) of an OR question: every occurrence of a lexeme is a cover of its own, so the cover density is their number times the weight. Only the tokens of some question leave the scan."""
    hits = postings(chunks, id_col, text_col, analyser).join(bounded(lexemes), "token").groupBy("query_id", F.col("id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    return ranked(hits.select("query_id", "chunk_id", (F.col("n") * OCCURRENCE_WEIGHT).alias("score")), "score", k)


def exact_identifiers(lexemes: DataFrame, chunks: DataFrame, id_col: str = "id", text_col: str = "text", k: int = EXACT, analyser: str = "simple") -> DataFrame:
    """Chunks that hold all identifiers of a question, ranked by cover density (AND); questions without identifiers have no rows.

    With one identifier that is its occurrences times the weight. With more,
    the positions of the identifiers in a chunk, and no other words, are
    gathered per question and chunk: at most the identifiers the chunk holds.
    """
    wanted = lexemes.where(is_identifier(F.col("token")))
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    hits = postings(chunks, id_col, text_col, analyser).join(bounded(wanted), "token").select("query_id", F.col("id").alias("chunk_id"), "token", "position")
    per = hits.groupBy("query_id", "chunk_id").agg(F.countDistinct("token").alias("have"), F.count(F.lit(1)).alias("n"))
    full = per.join(bounded(need), "query_id").where("have = need")
    one = full.where("need = 1").select("query_id", "chunk_id", (F.col("n") * OCCURRENCE_WEIGHT).alias("score"))
    many = hits.join(full.where("need > 1").select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("position", "token"))).alias("at"))
    scored = many.select("query_id", "chunk_id", covers(F.col("at.position"), F.col("at.token")).alias("score"))
    return ranked(one.unionByName(scored), "score", k)


def _covers(positions: pd.Series, tokens: pd.Series) -> pd.Series:
    out = []
    for p, t in zip(positions, tokens):
        lists: dict[str, list[int]] = {}
        for at, token in zip(p, t):
            lists.setdefault(token, []).append(int(at))
        out.append(cover_density(list(lists.values())))
    return pd.Series(out, dtype="float64")


def covers(positions: Column, tokens: Column) -> Column:
    """``cover_density`` over two array columns, the positions ascending and the token at each."""
    return F.round(F.pandas_udf(_covers, "double")(positions, tokens), 9)


def cover_density(positions: list[list[int]], weight: float = OCCURRENCE_WEIGHT) -> float:
    """Cover-density rank of an AND question: the sum over minimal intervals that hold every lexeme of weight / (1 + words in between).

    ``positions`` has the sorted positions of each lexeme.
    """
    if not positions or any(not p for p in positions):
        return 0.0
    events = sorted((p, i) for i, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}
    score, previous = 0.0, -1
    for p, i in events:
        last[i] = p
        if len(last) == len(positions):
            low = min(last.values())
            if low > previous:  # so this occurrence closes a cover that no shorter one lies in
                score += weight / (1 + (p - low + 1 - len(positions)))
                previous = low
    return score


def bm25(lexemes: DataFrame, chunks: DataFrame, id_col: str = "id", text_col: str = "text", k: int = CANDIDATES, k1: float = 1.2, b: float = 0.75, analyser: str = "simple") -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25; counts cover all chunks given, so filter them by policy first. A chunk's length is the tokens its analyser keeps."""
    sizes = chunks.select(F.col(id_col).alias("chunk_id"), F.size(F.filter(analysed(text_col, analyser), lambda t: t.isNotNull())).alias("len"))
    corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    hits = postings(chunks, id_col, text_col, analyser).join(bounded(lexemes.select("token").distinct()), "token", "left_semi")
    tf = hits.groupBy(F.col("id").alias("chunk_id"), "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = lexemes.join(df, "token").crossJoin(F.broadcast(corpus)).select("query_id", "token", idf.alias("idf"), "avg")
    scored = tf.join(bounded(weights), "token").join(sizes, "chunk_id")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return ranked(scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("score")), "score", k)


def width_guard(df: DataFrame, column: str, width: int) -> DataFrame:
    """Fails the query if a vector has another width, rather than ranking it."""
    bad = F.raise_error(F.concat(F.lit("vector width "), F.size(column).cast("string"), F.lit(f", the space has {width}")))
    return df.withColumn(column, F.when(F.size(column) == width, F.col(column)).otherwise(bad.cast(df.schema[column].dataType)))


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of a flat list, by score and then the smaller id, in that order."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    nth = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)]))
    return rows[nth < k], scores[nth < k], ids[nth < k]


def scan_topk(questions: DataFrame, vectors: DataFrame, k: int, scores, block: int = 50_000, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, score): what may be among each question's k best, by one scan of all vectors.

    ``questions`` has (query_id, embedding), ``vectors`` (chunk_id, embedding);
    NULL embeddings are left out, and a width unlike the first question's fails
    the query. ``scores(q, x, query_ids, chunk_ids)`` gives the score matrix of
    two blocks of vectors, -inf for pairs that do not count. The questions
    travel to the tasks at most ``block`` a scan, and each task keeps a running
    top k per question, which it gives out once at its end: k rows per question
    and task are shuffled, whatever the number of vectors. Scores are rounded
    to ``digits``; equal ones go to the smaller chunk_id.
    """
    rows = questions.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("e")).where("e is not null and query_id is not null").orderBy("query_id")
    source = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and chunk_id is not null")
    kind, at_once = "query_id bigint, chunk_id bigint, score double", 1024

    def part(ids, vs):
        known = questions.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), np.array(vs, np.float64).reshape(len(ids), -1)))

        def score(batches):
            qid, q = known.value
            blocks = range(0, len(qid), at_once)
            held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in blocks]
            floor = np.full(len(qid), -np.inf)
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                cid = b.column(0).to_numpy()
                for i, a in enumerate(blocks):
                    s = np.round(scores(q[a : a + at_once], x, qid[a : a + at_once], cid).astype(np.float64), digits)
                    low = floor[a : a + at_once]
                    if n > k:
                        low = np.maximum(low, np.partition(s, n - k, axis=1)[:, n - k])
                    r, c = np.nonzero((s >= low[:, None]) & (s > -np.inf))
                    held[i] = r, v, _ = _best(*(np.concatenate(p) for p in zip(held[i], (r, s[r, c], cid[c]))), k)
                    full = np.flatnonzero(np.bincount(r, minlength=len(low)) == k)
                    floor[a + full] = v[np.searchsorted(r, full, side="right") - 1]
            for (r, v, ids), a in zip(held, blocks):
                yield pa.RecordBatch.from_arrays([pa.array(qid[a + r], pa.int64()), pa.array(ids, pa.int64()), pa.array(v, pa.float64())], ["query_id", "chunk_id", "score"])

        return width_guard(source, "embedding", len(vs[0])).mapInArrow(score, kind)

    result, ids, vs = None, [], []
    for r in rows.toLocalIterator():
        if vs and len(r["e"]) != len(vs[0]):
            raise ValueError(f"question {r['query_id']} has width {len(r['e'])}, others {len(vs[0])}")
        ids.append(r["query_id"])
        vs.append(r["e"])
        if len(ids) == block:
            p = part(ids, vs)
            result, ids, vs = p if result is None else result.unionByName(p), [], []
    if ids:
        p = part(ids, vs)
        result = p if result is None else result.unionByName(p)
    return vectors.sparkSession.createDataFrame([], kind) if result is None else result


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def near_rows(q: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, skip: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine to nine digits) of all pairs that may be among the k best of a row of ``q``.

    ``q`` and ``x`` have unit rows, ``floor`` the k-th best score of each
    question so far, ``skip`` pairs that do not count. Products in single
    precision, with the largest error they can have, say which pairs are
    computed in double precision, so none is lost.
    """
    rough = q.astype(np.float32) @ x.astype(np.float32).T
    if skip is not None:
        rough[skip] = -np.inf
    slack = (q.shape[1] + 8) * 1.2e-7
    low = floor - slack
    new = np.flatnonzero(floor == -np.inf)
    if len(x) > k and len(new):
        low[new] = np.partition(rough[new], len(x) - k, axis=1)[:, len(x) - k] - 2 * slack
    r, c = np.divmod(np.flatnonzero((rough >= low.astype(np.float32)[:, None]) & (rough > -np.inf)), max(1, len(x)))
    s = np.round((q[r] * x[c]).sum(1), 9)
    ok = s >= floor[r]
    return r[ok], c[ok], s[ok]


def near_topk(questions: DataFrame, vectors: DataFrame, k: int, block: int = 50_000, exclude_self: bool = False, opened: list[int] | None = None, means: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(query_id, opened, chunk_id, score): what may be among each question's k best by cosine, by one scan as of ``scan_topk``.

    Without ``means`` all vectors count. With the ids and means of the lists
    that ``vectors`` names in ``gid``, those of a question's nearest lists
    count, and it has k rows a task for each step of ``opened``: for those
    beyond the last step, up to so many lists. All-zero vectors never count.
    """
    steps = [1] if opened is None else sorted(opened)
    rows = questions.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("e")).where("e is not null and query_id is not null").orderBy("query_id")
    gid = F.lit(0).cast("bigint") if means is None else F.col("gid").cast("bigint")
    source = vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), gid.alias("gid")).where("embedding is not null and chunk_id is not null and gid is not null")
    kind, at_once = "query_id bigint, opened int, chunk_id bigint, score double", 1024

    def part(ids, vs):
        known = questions.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), unit_rows(np.array(vs, np.float64).reshape(len(ids), -1))))

        def score(batches):
            qid, q = known.value
            many = len(steps)
            if means is None:
                names, step = np.zeros(1, np.int64), np.zeros((len(qid), 1), np.int64)
            else:
                names = means[0]
                place = np.argsort(np.argsort(-np.round(q @ unit_rows(means[1]).T, 9), axis=1, kind="stable"), axis=1)  # equal ones by the smaller id
                step = np.searchsorted(steps, place, side="right")
            # The lists of a question and what it holds of them are by step; held rows are numbered question * many + step.
            blocks = range(0, len(qid), at_once)
            held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in blocks]
            floor = np.full(len(qid) * many, -np.inf)
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, q.shape[1]))
                cid, of = b.column(0).to_numpy(), b.column(2).to_numpy()
                for g in np.unique(of):
                    mine = np.flatnonzero((of == g) & x.any(1))
                    at = int(np.searchsorted(names, g))
                    y, ids = unit_rows(x[mine]), cid[mine]
                    for i, a in enumerate(blocks):
                        n = min(at_once, len(qid) - a)
                        asked = np.flatnonzero(step[a : a + n, at] < many)
                        if not len(asked) or not len(mine):
                            continue
                        number = asked * many + step[a + asked, at]
                        skip = None
                        if exclude_self:
                            first, last = np.searchsorted(qid[a + asked], ids), np.searchsorted(qid[a + asked], ids, side="right")
                            own = last - first
                            skip = (np.repeat(first, own) + np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own), np.repeat(np.arange(len(ids)), own))
                        r, c, s = near_rows(q[a + asked], y, floor[a * many + number], k, skip)
                        if not len(r):
                            continue
                        held[i] = r, v, _ = _best(*(np.concatenate(p) for p in zip(held[i], (number[r], s, ids[c]))), k)
                        full = np.flatnonzero(np.bincount(r, minlength=n * many) == k)
                        floor[a * many + full] = v[np.searchsorted(r, full, side="right") - 1]
            for (r, v, ids), a in zip(held, blocks):
                yield pa.RecordBatch.from_arrays([pa.array(qid[a + r // many], pa.int64()), pa.array(np.array(steps)[r % many], pa.int32()), pa.array(ids, pa.int64()), pa.array(v, pa.float64())], ["query_id", "opened", "chunk_id", "score"])

        return width_guard(source, "embedding", len(vs[0])).mapInArrow(score, kind)

    result, ids, vs = None, [], []
    for r in rows.toLocalIterator():
        if vs and len(r["e"]) != len(vs[0]):
            raise ValueError(f"question {r['query_id']} has width {len(r['e'])}, others {len(vs[0])}")
        ids.append(r["query_id"])
        vs.append(r["e"])
        if len(ids) == block:
            p = part(ids, vs)
            result, ids, vs = p if result is None else result.unionByName(p), [], []
    if ids:
        p = part(ids, vs)
        result = p if result is None else result.unionByName(p)
    return vectors.sparkSession.createDataFrame([], kind) if result is None else result


def dense(questions: DataFrame, vectors: DataFrame, k: int = CANDIDATES, exclude_self: bool = False, block: int = 50_000) -> DataFrame:
    """Exact cosine top k of each question: (query_id, chunk_id, score, rank). All-zero vectors are never found; equal scores, to nine digits, go to the smaller id."""
    return ranked(near_topk(questions, vectors, k, block, exclude_self).drop("opened"), "score", k)


def pair_cosines(df: DataFrame, left: str = "q", right: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score) of rows (query_id, chunk_id, left, right): cosine in double precision, to nine digits."""

    def run(batches):
        for b in batches:
            x, y = (unit_rows(b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)) for i in (2, 3)) if b.num_rows else (np.zeros((0, 1)),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round((x * y).sum(1), 9))], ["query_id", "chunk_id", "score"])

    return df.select(F.col("query_id").cast("bigint"), F.col("chunk_id").cast("bigint"), F.col(left).cast("array<double>"), F.col(right).cast("array<double>")).mapInArrow(run, "query_id bigint, chunk_id bigint, score double")


def fuse(rankings: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank): (query_id, chunk_id, score, rank). An empty ranking adds nothing."""
    every = None
    for r in rankings:
        one = r.select("query_id", "chunk_id", "rank")
        every = one if every is None else every.unionByName(one)
    score = F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 12)
    return ranked(every.groupBy("query_id", "chunk_id").agg(score.alias("score")), "score", limit)


def leader_floor(rankings: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """Fusion in which the first of every ranking has a seat: (query_id, chunk_id, score, position).

    Leaders outside the first ``limit`` take the last seats, at least one of
    which is left to the fusion; they carry the score of the last row kept. A
    leader absent from the cut that leads two rankings is seated twice, and
    with a tiny limit the seats may exceed it: both as the reference semantics
    have it. Per question at most ``limit`` + the number of rankings rows are
    looked at after the fused ranking has been cut.
    """
    fused = fuse(rankings, limit, k)
    leads = None
    for i, r in enumerate(rankings):
        one = r.where("rank = 1").select("query_id", "chunk_id", F.lit(i).alias("half"))
        leads = one if leads is None else leads.unionByName(one)
    absent = leads.join(fused.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    missing = absent.groupBy("query_id").agg(F.count(F.lit(1)).alias("missing"))
    seats = F.when(F.lit(limit >= 2), F.greatest(F.lit(1), limit - F.coalesce("missing", F.lit(0)))).otherwise(F.lit(limit))
    kept = fused.join(missing, "query_id", "left").where(F.col("rank") <= seats)
    last = kept.groupBy("query_id").agg(F.min("score").alias("score"), F.max("rank").alias("at"))
    seat = F.row_number().over(Window.partitionBy("query_id").orderBy("half"))
    added = absent.join(last, "query_id").select("query_id", "chunk_id", "score", (F.col("at") + seat).alias("position")) if limit >= 2 else None
    rows = kept.select("query_id", "chunk_id", "score", F.col("rank").alias("position"))
    return rows if added is None else rows.unionByName(added)


#: Columns of a hit from its chunk and from its document.
OF_CHUNK, OF_DOCUMENT = ("document_id", "page_num", "char_start", "char_end", "text", "bboxes"), ("filename", "media_type", "label_ids")


def hydrate(fused: DataFrame, lexical: DataFrame, vector: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Fused rows with where they stand and the rank and score of each half, in fused order by ``rank``.

    The chunk gives document, page, offsets, text and boxes; ``documents``, if
    given, the file name, media type and labels of the document itself. Columns
    that a table lacks are left out.
    """
    lex = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    den = vector.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    c = chunks.select(F.col("id").alias("chunk_id"), *[n for n in OF_CHUNK if n in chunks.columns])
    hits = fused.join(lex, ["query_id", "chunk_id"], "left").join(den, ["query_id", "chunk_id"], "left").join(c, "chunk_id")
    if documents is not None:
        hits = hits.join(documents.select(F.col("id").alias("document_id"), *[n for n in OF_DOCUMENT if n in documents.columns]), "document_id", "left")
    return hits


def hybrid_search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, limit: int = DEFAULT_LIMIT, stop: frozenset[str] = frozenset(), engine: str = "occurrences", analyser: str = "simple", documents: DataFrame | None = None, scores: DataFrame | None = None, reranks: bool = False) -> DataFrame:
    """Search of many questions (query_id, text, embedding) over visible chunks and vectors.

    ``engine`` chooses the lexical rank, 'occurrences' or 'bm25', ``analyser``
    the tokens. The first of the lexical, dense and exact ranking has a seat
    (``leader_floor``). With ``reranks`` the hits are put in the order of
    ``scores`` (query_id, chunk_id, rerank); a question without a full set of
    them keeps its fused order. ``reasons`` says what a question had to do
    without: 'embedding' (answered by words alone) and 'reranker';
    ``degraded`` whether there is any. A search that is not to rerank is not
    degraded by it.
    """
    if engine not in ("occurrences", "bm25"):
        raise ValueError(f"unknown engine {engine!r}")
    lexemes = question_lexemes(questions, "query_id", "text", stop, analyser)
    # Each ranking, k rows a question, is read several times below and written once: its scan of the corpus is not repeated.
    lexical = stored((lexical_or if engine == "occurrences" else bm25)(lexemes, chunks, analyser=analyser), "lexical")
    vector = stored(dense(questions, vectors), "dense")
    exact = stored(exact_identifiers(lexemes, chunks, analyser=analyser), "exact")
    fused = leader_floor([lexical, vector, exact], limit).withColumnRenamed("position", "rank")
    hits = hydrate(fused, lexical, vector, chunks, documents)
    blind = questions.select("query_id", F.when(F.col("embedding").isNull(), F.array(F.lit("embedding"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    hits = hits.join(bounded(blind), "query_id")
    hits = hits.withColumn("degraded", F.size("reasons") > 0)
    if reranks:
        hits = reranked(hits, questions.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, rerank double") if scores is None else scores)
    return hits


def reranked(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """The hits of ``hybrid_search`` in the order of (query_id, chunk_id, rerank), with 'reranker' among the reasons of a question whose scores are not complete."""
    ordered = rerank(hits, scores).drop("rank").withColumnRenamed("position", "rank")
    reasons = F.when(F.col("rerank").isNull(), F.array_append("reasons", F.lit("reranker"))).otherwise(F.col("reasons"))
    return ordered.withColumn("reasons", reasons).withColumn("degraded", F.size("reasons") > 0)


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, rank) in the order of (query_id, chunk_id, rerank); ties keep the fused order.

    Where a question's assessments are incomplete, repeated or not finite, the
    whole question keeps its fused order and ``rerank`` is NULL.
    """
    s = scores.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("times"), F.max("rerank").alias("rerank"))
    j = hits.join(s, ["query_id", "chunk_id"], "left")
    fine = (F.col("times") == 1) & F.col("rerank").isNotNull() & ~F.isnan("rerank") & (F.abs("rerank") < float("inf"))
    whole = Window.partitionBy("query_id")
    j = j.withColumn("whole", F.min(F.coalesce(fine, F.lit(False)).cast("int")).over(whole) == 1)
    j = j.withColumn("rerank", F.when(F.col("whole"), F.col("rerank")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").desc_nulls_last(), "rank")
    return j.withColumn("position", F.row_number().over(order)).drop("times", "whole")


def overlap_reranker(question: str, passage: str) -> float:
    """A deterministic stand-in for a cross-encoder: the share of the question's words in the passage."""
    q = set(question.lower().split())
    return len(q & set(passage.lower().split())) / len(q) if q else 0.0


def relevance(hits: DataFrame) -> DataFrame:
    """(query_id, relevance): NONE, WEAK or CONFIDENT over the returned hits (query_id, lexical_rank, rerank).

    Too small a lexical share means NONE, before all else; without a reranker
    the rest is CONFIDENT; else the best score decides.
    """
    per = hits.groupBy("query_id").agg(F.max("rerank").alias("best"), F.avg(F.col("lexical_rank").isNotNull().cast("double")).alias("share"))
    band = F.when(F.col("share") < LEXICAL_SHARE, "NONE").when(F.col("best").isNull(), "CONFIDENT").when(F.col("best") < FLOOR, "NONE").when(F.col("best") < WEAK, "WEAK").otherwise("CONFIDENT")
    return per.select("query_id", band.alias("relevance"))


def token_batches(lengths: list[int], budget: int, most: int, extra: int = 0) -> list[list[int]]:
    """Items, by position, in batches under a token budget and a count; an item over the budget is a batch of its own."""
    out: list[list[int]] = []
    spent = 0
    for i, n in enumerate(lengths):
        cost = n // 3 + 1 + extra
        if not out or spent + cost > budget or len(out[-1]) >= most:
            out.append([])
            spent = 0
        out[-1].append(i)
        spent += cost
    return out
