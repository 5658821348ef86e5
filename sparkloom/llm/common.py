"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.materialize import bucketed, materialize, remove
from sparkloom.ship import ship

__all__ = ["bucketed", "materialize", "remove"]

#: The white space that parts words: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Maps ASCII capitals to small letters and leaves every other byte.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Most rows and text bytes of one Arrow batch, which bounds the memory of a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers and lowers the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; smaller settings stay."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Returns what a reused Python worker has freed, by this or an earlier task, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean() -> None:
    """trim(), and from now on gives large arrays of this worker back as soon as they are freed (glibc would else keep ever larger ones)."""
    trim()
    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    except AttributeError:  # another C library
        pass


def sweep(spark: SparkSession) -> None:
    """Has garbage collected on the driver, so that Spark's cleaner removes the shuffle files of what nothing refers to any more."""
    for _ in range(2):  # what the first round frees may hold on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(by), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cuts a batch into runs of rows whose column holds about `most` bytes; a longer row stands alone."""
    sizes = batch.column(column).cast(pa.large_binary())
    start, held = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
