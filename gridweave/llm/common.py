"""Shared helpers: the shared work folder, stage tables, size-checked broadcast, batch maps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no spark.checkpoint.dir and runs in one process, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/gridweave"

#: Most bytes of a side that may be broadcast.
BROADCAST_BYTES = 32 << 20

#: Bytes of heavy rows that a task hands to Python, or holds before it writes them, at a time.
HEAVY_BYTES = 4 << 20
HEAVY = {"spark.sql.execution.arrow.maxBytesPerBatch": str(HEAVY_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "256"}
HEAVY_FILES = {"parquet.block.size": HEAVY_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

#: Bytes of a value, and of a row beside its values, as a broadcast table holds them.
_WIDTH = {"int": 4, "bigint": 8, "double": 8, "boolean": 1}
_ROW = 24


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that its executors and driver share")
    return (named or FALLBACK_DIR).rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gridweave/{tag}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while a table is written; what it had before comes back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, tag: str, codec: str = "none", heavy: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors.

    Mostly not compressed: these are hashes and packed arrays, and codecs hold buffers outside the heap for each file.
    heavy: what the tasks read or write are long texts or rows of a MB. Then as many rows as HEAVY_BYTES hold go to Python
    together, the reader takes few rows at a time, and the writer, which else looks at its size every 100 rows, does after each.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    write = df.write.option("compression", codec)
    with settings(spark, HEAVY if heavy else {}):
        (write.options(**HEAVY_FILES) if heavy else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files behind tables made by stored() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, extra: int = 0, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the bound in bytes, else as it is (a shuffled join).

    extra: the bytes of all its strings and arrays, measured; its columns of one width are reckoned by type.
    """
    width = _ROW + sum(_WIDTH.get(f.dataType.simpleString(), 16) for f in df.schema)
    return F.broadcast(df) if rows * width + extra <= (BROADCAST_BYTES if limit is None else limit) else df


def trim() -> None:
    """Give what a Python worker has freed back to the system: workers outlive their tasks, and allocators keep it."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if free is not None:
        free(0)


def trimmed(fn: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """fn(*tables), after which what it freed goes back to the system."""
    try:
        return fn(*tables)
    finally:
        trim()


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int = 4 << 20, rows: int = 2000
) -> DataFrame:
    """mapInArrow in slices of about `size` bytes and at most `rows` rows, so that a batch of long texts stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, size, rows):
                yield fn(piece)
        trim()

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, size: int = 4 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the bytes of its column `text`."""
    weight = np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0), np.int64).cumsum()
    at = 0
    while at < batch.num_rows:
        done = int(weight[at - 1]) if at else 0
        end = min(max(int(np.searchsorted(weight, done + size, "right")), at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def doc_view(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return docs.select(*(docs[n] for n in names))
