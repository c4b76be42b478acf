"""What the operators of this subpackage share: tables, the shared folder, word rules."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: blank, and tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    global _local_dir
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tidewright-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidewright/{label}-{uuid.uuid4().hex}"


#: Settings of the jobs that write intermediate tables: shuffle files go once their job has ended, and what goes to a Python worker at once is bounded in bytes.
_JOB_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def _job_conf(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _JOB_CONF}
    for k, v in _JOB_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends here, and a lost executor costs nothing. by: a column of few values, whose rows are then read apart."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    with _job_conf(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(part: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """part in pieces whose values of a string or binary column take so many bytes at most, or a single row."""
    size = part.column(column).nbytes
    rows = max(1, min(part.num_rows, int(part.num_rows * most / size) if size > most else part.num_rows))
    for at in range(0, part.num_rows, rows):
        yield part.slice(at, rows)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialise() wrote and that nothing will read again."""
    mark = "/tidewright/"
    for path in {f[: f.find("/", f.rfind(mark) + len(mark))] for f in df.inputFiles() if mark in f}:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; on a cluster it is installed or sent along."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_SPACE))


def word_count(c: Column) -> Column:
    """Words of c as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
