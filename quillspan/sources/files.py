"""Files as tables."""

from __future__ import annotations

import tomllib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.ingest import MAX_PAGES, media_type


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, filename, size_bytes, content, media_type) of files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("filename"), F.col("length").alias("size_bytes"), "content", media_type(name).alias("media_type"))


def text_units(files: DataFrame) -> DataFrame:
    """(path, text, page_num) of plain and Markdown files: the whole file is one unit without a page. Content that is not UTF-8 is dropped."""
    t = files.where(F.col("media_type").isin("plain", "markdown") & F.is_valid_utf8(F.col("content").cast("string")))
    return t.select("path", F.col("content").cast("string").alias("text"), F.lit(None).cast("int").alias("page_num"))


PageParser = Callable[[bytes], list[str]]


def pdf_units(files: DataFrame, parser: PageParser, max_pages: int = MAX_PAGES) -> DataFrame:
    """(path, text, page_num) of PDF files through an injected parser, pages from 1; files with more than ``max_pages`` pages have one row without text and page."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pages = parser(content)
                rows += [(path, None, None)] if len(pages) > max_pages else [(path, t, i + 1) for i, t in enumerate(pages)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["path", "text", "page_num"])

    return files.where("media_type = 'pdf'").select("path", "content").mapInArrow(run, "path string, text string, page_num int")


def manifest(spark: SparkSession, toml_text: str, section: str, schema: str) -> DataFrame:
    """The tables of one section of a TOML manifest; keys that the schema does not name are left out, missing ones NULL."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in tomllib.loads(toml_text).get(section, [])], schema)


def checksum_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(filename, expected, found) of files whose SHA-256 is not the manifest's (filename, sha256)."""
    f = files.select("filename", F.sha2("content", 256).alias("found"))
    return expected.select("filename", F.col("sha256").alias("expected")).join(f, "filename", "left").where(~F.col("expected").eqNullSafe(F.col("found")))
