"""Helpers that the operators of this part share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import materialize, shared_dir  # noqa: F401

#: Rows and bytes handed to a Python worker at once. Texts differ in length by orders of magnitude, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20
#: Characters from which a text is read piece by piece, where its words or tokens as a list would take much memory.
LONG = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete a table that materialize wrote and nothing reads any more, and let Spark delete shuffle files of finished steps."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the garbage of their plans; in a long job that may be late. So does the driver's memory."""
    gc.collect()
    spark._jvm.System.gc()
    trim()


def short_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches short, and lets Python workers on this machine find the package. A cluster gets it by --py-files."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    most = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))
    if not 0 < most <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(f):
    """A function over batches that gives freed memory back when a partition ends: Python workers live on, beside each other."""

    def over(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return over


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def held_out(doc_id: Column | str, mod: int, rest: int) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo `mod`, is `rest`. A null id counts as ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod == rest


def matches(pattern, text, long: int = LONG) -> Iterator:
    """All matches of a compiled pattern; those of a long text one after the other, never as one list."""
    return iter(pattern.findall(text)) if len(text) < long else (m.group() for m in pattern.finditer(text))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't use."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
