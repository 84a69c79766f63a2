"""Pieces shared by the operators of this package."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import Scratch, checkpointed

__all__ = ["Scratch", "checkpointed", "column", "map_batches", "read", "released", "small_batches", "utf8", "words"]

#: Words of the licence and benchmark operators, on UTF-8 bytes with A-Z lower-cased.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Rows and bytes of an Arrow batch: a batch of long texts must fit a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the driver's folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session; lower settings stay as they are."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            now = str(spark.conf.get(key))
            if not now.isdigit() or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))
        except Exception as error:  # a release without this setting
            if "CONFIG" not in str(error) and "does not exist" not in str(error):
                raise


def utf8(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, giving back at a task's end what it no longer holds.

    Python workers serve one task after another, and allocators keep freed pages: without this
    a worker stays as large as the largest task that it ever had, in every later stage.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def map_batches(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]
) -> DataFrame:
    """mapInArrow, with state made once for a task.

    make() runs on the executor and returns a function from a batch to the columns of its
    output (None: no rows).
    """
    small_batches(df.sparkSession)
    fields = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in fields)],
                    schema=fields,
                )

    return df.mapInArrow(released(run), schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
