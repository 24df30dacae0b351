"""Written intermediate tables.

Iterative operators cut their lineage with tables written to the folder that
``spark.checkpoint.dir`` names. All executors share it, so the loss of an
executor costs a re-read and no recomputation of earlier rounds. Where the
setting is absent (tests on a local master) a temporary folder is used and
removed at exit; on a cluster its absence is an error, since a machine-local
folder could not be read by the other executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, _LOCAL[key], True)
    return f"file://{_LOCAL[key]}"


def path_exists(spark: SparkSession, name: str) -> bool:
    """Whether a folder or file of that name is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class Stored:
    """A written table: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, label: str = "table"):
        spark = df.sparkSession
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quillspan-{uuid.uuid4().hex}-{label}"
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and returns the table read back."""
    return Stored(df, label).df


def clear(spark: SparkSession) -> int:
    """Deletes all tables this application wrote; results that have not been computed yet can no longer be. Returns how many."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for t in made:
        t.drop()
    return len(made)
