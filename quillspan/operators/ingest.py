"""From files to chunks: media types, cutting, routing, duplicates, boxes, filing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.chunking import LEAST_TEXT, OVERLAP, TARGET, chunk_text

MAX_BYTES, MAX_PAGES = 100 * 1024 * 1024, 3000
STATES = ("pending", "parsing", "chunking", "embedding", "classifying", "ready", "failed")


def media_type(filename: Column) -> Column:
    """plain, markdown or, for any other name, pdf."""
    suffix = F.lower(F.regexp_extract(filename, "(\\.[^.]*)$", 1))
    return F.when(suffix.isin(".txt", ".text"), "plain").when(suffix.isin(".md", ".markdown"), "markdown").otherwise("pdf")


def content_fits(kind: Column, content: Column) -> Column:
    """Whether the bytes are what the name says: a PDF starts with its mark, text is UTF-8 without NUL."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    no_nul = F.instr(F.decode(content, "ISO-8859-1"), "\x00") == 0
    pdf = F.decode(F.substring(content, 1, 5), "ISO-8859-1") == "%PDF-"
    return F.when(kind == "pdf", pdf).otherwise(utf8 & no_nul)


def staged(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(tenant_id, filename, sha256, size_bytes, media_type, accepted) of (tenant_id, filename, content): content-addressed, so equal bytes have one address."""
    kind = media_type(F.col("filename"))
    size = F.octet_length("content")
    return files.select("tenant_id", "filename", F.sha2("content", 256).alias("sha256"), size.cast("bigint").alias("size_bytes"), kind.alias("media_type"), ((size <= max_bytes) & content_fits(kind, F.col("content"))).alias("accepted"))


def natural_chunks(units: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(id, char_start, char_end, text) of every page or file cut at natural boundaries; order and offsets as in ``chunking.chunk_text``. NULL ids are dropped."""

    def cut(batches):
        for b in batches:
            ids, rows = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in chunk_text(t, target, overlap):
                    ids.append(i)
                    rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["id", "char_start", "char_end", "text"])

    # Texts too short for a chunk never leave the JVM.
    rows = units.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where((F.length(text_col) >= LEAST_TEXT) & F.col("id").isNotNull())
    return rows.mapInArrow(cut, "id bigint, char_start int, char_end int, text string")


def fixed_windows(units: DataFrame, id_col: str, text_col: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(id, start, text): windows of ``size`` characters every ``size - overlap``, the baseline chunker; empty texts have none."""
    step = size - overlap
    d = units.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("t") - 1), F.lit(step)))
    return d.select("id", "t", starts.alias("start")).where((F.col("start") == 0) | (F.col("start") < F.length("t") - overlap)).select("id", "start", F.substring(F.col("t"), F.col("start") + 1, F.lit(size)).alias("text"))


def page_route(pages: DataFrame, id_col: str, text_col: str, gutters: DataFrame | None = None) -> DataFrame:
    """(id, route, broken_spacing): UNREADABLE below 100 characters, LAYOUT with a gutter, else FAST; spacing is broken if over 2 % of the tokens have 30 characters or more.

    ``gutters`` is the result of ``column_gutters`` for the same ids; without
    it no page is LAYOUT.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    tokens = F.filter(F.split(t, "\\s+"), lambda w: w != "")
    long = F.filter(tokens, lambda w: F.length(w) >= 30)
    columns = F.lit(0)
    if gutters is not None:
        pages = pages.join(gutters.select(F.col("page").alias(id_col), F.size("gutters").alias("_gutters")), id_col, "left")
        columns = F.coalesce("_gutters", F.lit(0))
    return pages.select(F.col(id_col).alias("id"), F.when(F.length(F.trim(t)) < 100, "UNREADABLE").when(columns > 0, "LAYOUT").otherwise("FAST").alias("route"), (F.coalesce(F.try_divide(F.size(long), F.size(tokens)), F.lit(0.0)) > 0.02).alias("broken_spacing"))


def _spacing(text: Column) -> Column:
    return F.try_divide(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))), F.length(text))


def retry_spacing(text: Column) -> Column:
    """Whether a page's spacing is so thin that it is worth parsing again."""
    return (F.length(text) >= 200) & (_spacing(text) < 0.12)


def respaced(text: Column, again: Column) -> Column:
    """The second parse of a page where its share of blanks is at least 1.25 times that of the first, else the first."""
    return F.when(F.coalesce(retry_spacing(text) & (_spacing(again) >= 1.25 * _spacing(text)), F.lit(False)), again).otherwise(text)


# Bins of a page's width, least words, share of the peak and bins of the text block, its middle, a trough.
BINS, LEAST_WORDS, BODY_SHARE, LEAST_BODY, MIDDLE, TROUGH = 60, 250, 0.1, 10, (0.3, 0.7), 0.25


def column_gutters(words: DataFrame, page_col: str = "page") -> DataFrame:
    """(page, gutters array<double>) of words (page, x0, x1) with normalised edges: where the columns of each page are parted, left to right.

    Word centres are counted in 60 bins, summed per page before anything is
    gathered. The text block reaches from the first to the last bin above a
    tenth of the peak; a gutter is a run of bins, in the middle 30 to 70 % of
    the block, below a quarter of the block's median count, and is placed at
    the middle of the run. Pages of fewer than 250 words, or with fewer than
    ten bins above a tenth of the peak, have none. Words without an edge are
    left out.
    """
    centre = (F.col("x0").cast("double") + F.col("x1").cast("double")) / 2
    w = words.select(F.col(page_col).alias("page"), centre.alias("centre")).where("page is not null and centre is not null")
    bins = w.groupBy("page", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("centre") * BINS))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = bins.groupBy("page").agg(F.sum("n").alias("words"), F.max("n").alias("peak"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    per = per.withColumn("count", F.expr(f"transform(sequence(0, {BINS - 1}), i -> coalesce(m[i], 0))"))
    per = per.withColumn("body", F.expr(f"filter(sequence(0, {BINS - 1}), i -> count[i] > peak * {BODY_SHARE}D)"))
    per = per.withColumn("first", F.element_at("body", 1)).withColumn("wide", F.element_at("body", -1) - F.col("first") + 1)
    per = per.withColumn("sorted", F.array_sort(F.slice("count", F.col("first") + 1, F.col("wide"))))
    per = per.withColumn("typical", F.expr("(sorted[cast(floor((wide - 1) / 2) as int)] + sorted[cast(floor(wide / 2) as int)]) / 2"))
    low, high = (f"first + cast(floor(wide * {m}D) as int)" for m in MIDDLE)
    per = per.withColumn("low", F.expr(f"filter(sequence({low}, {high}), i -> count[i] < {TROUGH}D * typical)"))
    per = per.withColumn("starts", F.expr("filter(low, i -> not array_contains(low, i - 1))")).withColumn("ends", F.expr("filter(low, i -> not array_contains(low, i + 1))"))
    found = F.zip_with("starts", "ends", lambda a, b: (a + b + 1) / 2 / BINS)
    some = (F.col("words") >= LEAST_WORDS) & (F.size("body") >= LEAST_BODY) & (F.col("typical") > 0)
    return per.select("page", F.when(some, found).otherwise(F.array().cast("array<double>")).alias("gutters"))


def column_texts(words: DataFrame, gutters: DataFrame, page_col: str = "page") -> DataFrame:
    """(page, text) of words (page, x0, x1, y0, word): read column by column, each from top to bottom, columns parted by a blank line.

    A word belongs to the column its centre lies in; words of one line (tops
    equal to three digits) are read from left to right. A page is read whole.
    """
    w = words.withColumnRenamed(page_col, "page").join(gutters, "page")
    column = F.size(F.filter("gutters", lambda g: g < (F.col("x0") + F.col("x1")) / 2))
    lines = w.select("page", column.alias("column"), F.round("y0", 3).alias("line"), "x0", "word").groupBy("page", "column", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word"))), lambda s: s["word"]), " ").alias("t"))
    columns = lines.groupBy("page", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda s: s["t"]), "\n").alias("t"))
    return columns.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "t"))), lambda s: s["t"]), "\n\n").alias("text"))


def page_boxes(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Boxes (…, x0, y0, x1, y1, width, height) in points as shares of the page, 0 to 1."""
    share = lambda c, whole: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c).cast("double") / F.col(whole))).alias(c)
    kept = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1", width, height)]
    return boxes.select(*kept, share("x0", width), share("y0", height), share("x1", width), share("y1", height))


def merged_lines(boxes: DataFrame) -> DataFrame:
    """Boxes (id, page, x0, y0, x1, y1) of one line as one: neighbours in reading order on the same page, tops within 0.005, gap below 0.03."""
    order = Window.partitionBy("id", "page").orderBy(F.round("y0", 3), "x0", "x1", "y1")
    gap = (F.abs(F.col("y0") - F.lag("y0").over(order)) < 0.005) & (F.col("x0") - F.lag("x1").over(order) < 0.03)
    b = boxes.withColumn("fresh", F.when(F.coalesce(gap, F.lit(False)), 0).otherwise(1))
    b = b.withColumn("line", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("id", "page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def highlight(chunks: DataFrame) -> DataFrame:
    """(chunk_id, page, x0, y0, x1, y1): one rectangle round a chunk's boxes on each page, clamped to the page."""
    b = chunks.select(F.col("id").alias("chunk_id"), F.explode("bboxes").alias("b")).select("chunk_id", "b.*")
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double")))
    return b.groupBy("chunk_id", "page").agg(*(F.round(clamp(f(c)), 6).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))


def deduplicated(documents: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row per (tenant_id, sha256): the first record's id, the union of labels, the number of records.

    Real labels displace the tenant's quarantine label, which stays only alone.
    ``quarantine`` has (tenant_id, label_id).
    """
    flat = documents.select("tenant_id", "sha256", "id", F.explode_outer("label_ids").alias("label_id"))
    q = quarantine.select("tenant_id", "label_id", F.lit(True).alias("is_quarantine"))
    per = flat.join(q, ["tenant_id", "label_id"], "left").groupBy("tenant_id", "sha256").agg(
        F.min("id").alias("id"), F.countDistinct("id").alias("copies"), F.sort_array(F.collect_set("label_id")).alias("every"), F.sort_array(F.collect_set(F.when(F.col("is_quarantine").isNull(), F.col("label_id")))).alias("real")
    )
    return per.select("tenant_id", "sha256", "id", "copies", F.when(F.size("real") > 0, F.col("real")).otherwise(F.col("every")).alias("label_ids"))


def replaced(existing: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """The table after writing ``fresh``: earlier rows of the same documents are gone, so writing twice changes nothing."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without_documents(df: DataFrame, deleted: DataFrame, key: str = "document_id") -> DataFrame:
    """A table after its documents (id) were deleted."""
    return df.join(deleted.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def cascaded(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables after documents (id) were deleted, with all that hangs on them.

    ``tables`` may hold documents, document_labels, chunks, chunk_embeddings
    and query_citations; rows that name no document or chunk stay. Each table
    is one anti-join; the chunks that go are found once.
    """
    ids = deleted.select(F.col("id").cast("bigint").alias("_id")).where("_id is not null").distinct()
    gone = tables["chunks"].join(ids, F.col("document_id") == F.col("_id"), "left_semi").select(F.col("id").alias("_id")).distinct() if "chunks" in tables else None
    keys = {"documents": ("id", ids), "document_labels": ("document_id", ids), "chunks": ("document_id", ids), "chunk_embeddings": ("chunk_id", gone), "query_citations": ("chunk_id", gone)}
    return {n: t.join(keys[n][1], F.col(keys[n][0]) == F.col("_id"), "left_anti") if n in keys and keys[n][1] is not None else t for n, t in tables.items()}


def uploaded_again(existing: DataFrame, uploads: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(upload_id, document_id, label_ids, deduplicated): where the bytes of each upload end up.

    An upload (id, tenant_id, sha256, label_ids) whose bytes its tenant already
    holds becomes the oldest such document (id, tenant_id, sha256, label_ids)
    with the labels of both; the quarantine label (tenant_id, label_id) stays
    only alone. Other uploads are documents of their own.
    """
    first = existing.where("sha256 is not null").groupBy("tenant_id", "sha256").agg(F.min_by(F.struct("id", "label_ids"), "id").alias("d"))
    q = quarantine.groupBy("tenant_id").agg(F.min("label_id").alias("q"))
    u = uploads.select(F.col("id").alias("upload_id"), "tenant_id", "sha256", F.coalesce("label_ids", F.array().cast("array<bigint>")).alias("own"))
    j = u.join(first, ["tenant_id", "sha256"], "left").join(q, "tenant_id", "left")
    union = F.array_union("own", F.coalesce("d.label_ids", F.array().cast("array<bigint>")))
    j = j.withColumn("union", F.array_sort(F.array_distinct(union)))
    labels = F.when(F.col("d").isNotNull() & (F.size("union") > 1), F.filter("union", lambda v: ~F.coalesce(v == F.col("q"), F.lit(False)))).otherwise(F.col("union"))
    return j.select("upload_id", F.coalesce("d.id", "upload_id").alias("document_id"), labels.alias("label_ids"), F.col("d").isNotNull().alias("deduplicated"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old_if_null: list[str]) -> DataFrame:
    """Rows of ``new`` over those of ``old``; NULLs in the named columns keep the old value."""
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in old.columns if c != key], F.lit(True).alias("_o"))
    n = new.select(*new.columns, F.lit(True).alias("_n"))
    j = o.join(n, key, "full")
    pick = lambda c: (F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in keep_old_if_null else F.when(F.col("_n"), F.col(c)).otherwise(F.col(f"_old_{c}"))).alias(c)
    return j.select(key, *[pick(c) for c in old.columns if c != key])


def resolve_upload_labels(requested: set[int], known: set[int], reach: set[int], default: int, quarantine: int) -> set[int]:
    """Labels of an upload: none, or just the default, means quarantine; unknown or unreachable ones are refused."""
    if not requested or requested == {default}:
        return {quarantine}
    if unknown := requested - known:
        raise KeyError(f"unknown labels {sorted(unknown)}")
    if beyond := requested - reach:
        raise PermissionError(f"beyond reach {sorted(beyond)}")
    return requested


def next_state(state: Column, chunks: Column) -> Column:
    """The state after a successful step; a document without chunks fails rather than become ready."""
    step = F.when(state == "pending", "parsing").when(state == "parsing", "chunking").when((state == "chunking") & (chunks == 0), "failed").when(state == "chunking", "embedding")
    return step.when(state == "embedding", "classifying").when(state == "classifying", "ready").otherwise(state)


def omission_note(pages: Column) -> Column:
    """Which pages were left out: the first eight by number, then how many more."""
    shown = F.array_join(F.transform(F.slice(F.array_sort(pages), 1, 8), lambda p: p.cast("string")), ", ")
    more = F.when(F.size(pages) > 8, F.concat(F.lit(" and "), (F.size(pages) - 8).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(pages) > 0, F.concat(F.lit("Pages left out: "), shown, more))


def appended_note(old: Column, new: Column, cap: int = 500) -> Column:
    return F.substring(F.concat_ws("; ", old, new), 1, cap)


def filing_numbers(reply: Column, count: Column | int, most: int = 3) -> Column:
    """Folder numbers a model's reply names: none if it starts with NONE; those in 1..count, each once, the first ``most``."""
    found = F.transform(F.regexp_extract_all(reply, F.lit("\\d+"), F.lit(0)), lambda s: F.try_to_number(F.substring(s, 1, 9), F.lit("999999999")).cast("bigint"))
    valid = F.slice(F.array_distinct(F.filter(found, lambda v: (v >= 1) & (v <= count))), 1, most)
    return F.when(F.upper(F.ltrim(reply)).startswith("NONE"), F.array().cast("array<bigint>")).otherwise(valid)


def filing_outcome(labels_only_quarantine: Column, folders: Column, answered: Column, chosen: Column, limit: int = 60) -> Column:
    """What became of filing: only quarantined documents are filed, too many or no folders are not offered."""
    return (
        F.when(~labels_only_quarantine, "KEPT").when(folders == 0, "NO_FOLDERS").when(folders > limit, "TOO_MANY_FOLDERS").when(answered.isNull(), "UNAVAILABLE").when(F.size(chosen) > 0, "CHOSE").otherwise("DECLINED")
    )


def excerpt(chunks: DataFrame, n: int = 6) -> DataFrame:
    """(document_id, excerpt): the first n chunks in reading order. n texts a document are kept before any are gathered."""
    order = Window.partitionBy("document_id").orderBy(F.col("page_num").asc_nulls_first(), "char_start", "id")
    first = chunks.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return first.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "\n").alias("excerpt"))


def boxes_in_slice(text: str, words: list[tuple[str, object]], start: int, end: int) -> list:
    """Boxes of the words of a page, in order, that overlap text[start:end]; words are found one after the other."""
    out, at = [], 0
    for word, box in words:
        found = text.find(word, at)
        if found < 0:
            continue
        at = found + len(word)
        if found >= end:
            break
        if at > start:
            out.append(box)
    return out


# -- tables -----------------------------------------------------------------
def table_cell(value: Column) -> Column:
    """One cell on one line: NULL is empty, a line break is a blank, a pipe is escaped."""
    return F.regexp_replace(F.replace(F.translate(F.coalesce(value, F.lit("")), "\n", " "), F.lit("|"), F.lit("\\|")), "^\\s+|\\s+$", "")


def is_table(rows: Column) -> Column:
    """At least two rows, all of at least two columns, and something in them."""
    some = F.exists(rows, lambda r: F.exists(r, lambda c: table_cell(c) != ""))
    return (F.size(rows) >= 2) & F.forall(rows, lambda r: F.size(r) >= 2) & some


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: the first row is the header, short rows are padded; NULL where it is no table."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    cells = lambda r: F.concat(F.transform(r, table_cell), F.array_repeat(F.lit(""), wide - F.size(r)))
    lines = F.transform(rows, lambda r: line(cells(r)))
    rule = F.array(line(F.array_repeat(F.lit("---"), wide)))
    return F.when(is_table(rows), F.array_join(F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, F.lit(2), F.size(lines))), "\n"))


def tables_markdown(df: DataFrame, id_col: str, rows_col: str) -> DataFrame:
    """(id, markdown) of array<array<string>> columns; what is no table has NULL."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), table_markdown(F.col(rows_col)).alias("markdown"))


def byte_size(size: Column) -> Column:
    """Decimal size for people: 104857600 is 105 MB."""
    return F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1_000_000, F.concat(F.round(size / 1e3).cast("bigint").cast("string"), F.lit(" kB"))).when(
        size < 1_000_000_000, F.concat(F.round(size / 1e6).cast("bigint").cast("string"), F.lit(" MB"))
    ).otherwise(F.concat(F.round(size / 1e9, 1).cast("string"), F.lit(" GB")))
