"""Shared pieces: the word rule, Arrow helpers, and where intermediate tables go."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadloom.storage import fresh_dir

#: Rows of one batch, from Parquet or to Python; texts may be long, so batches stay short.
BATCH_ROWS = 400


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six ASCII characters."""
    return text.split()


def tune(spark: SparkSession) -> None:
    """Keep Arrow and Parquet batches small, unless the session already asks for smaller ones."""
    for key, usual in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if int(spark.conf.get(key, usual)) > BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder once and read it back (columnar, with fresh statistics)."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(batch: pa.RecordBatch, name: str, null: bytes = b"") -> list[bytes]:
    """A string column as UTF-8 bytes; nulls become ``null``."""
    values = batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
    return [null if v is None else v for v in values]


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that others of any name can't clash."""
    from pyspark.sql import functions as F

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def regrouped(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, so that fewer words are looked up again."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system at a task's end: Python workers live on between tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict | None], schema: str, size: int = 1) -> DataFrame:
    """mapInArrow with one output batch for each input batch, or several of ``size`` bytes together; per_batch returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    tune(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, size):
            if batch.num_rows and (out := per_batch(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def spans(lengths: np.ndarray) -> np.ndarray:
    """Offsets with a leading 0 of consecutive runs."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] for every start and length."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
