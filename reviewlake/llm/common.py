"""Shared helpers: adding columns from Arrow batches, tables in the shared folder, word scanning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import checkpointed, materialise, new_path, shared_dir  # noqa: F401

UPPER = bytes(range(65, 91))
#: A-Z to a-z, every other byte unchanged.
ASCII_LOWER = bytes.maketrans(UPPER, UPPER.lower())


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that a result is about to add; a clashing input column gives way."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, limit: str = "4m") -> None:
    """From now on Arrow batches of this session hold 4 MB, not 64, unless the user has set a size: texts are long, and a batch is in memory
    several times, in the JVM and in Python."""
    if spark.conf.get(BATCH_KEY, None) in (None, "67108864b", "64MB", "64m"):
        spark.conf.set(BATCH_KEY, limit)


def add_columns(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """df with more columns, computed from one text or binary column by Python code in Arrow batches.

    make() runs once in each task and returns the function that turns a list of values (bytes or None) into one list
    per new column. Columns of df that have a new column's name give way, except the input column itself.
    """
    small_batches(df.sparkSession)
    df = without(df, *[n for n, _ in fields if n.lower() != text.lower()])
    out = T.StructType([f for f in df.schema.fields if f.name.lower() not in {n.lower() for n, _ in fields}] + [T.StructField(n, t) for n, t in fields])
    keep = [f.name for f in out.fields[: len(out.fields) - len(fields)]]
    types = [to_arrow_type(t) for _, t in fields]
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, text):
                column = batch.column(batch.schema.get_field_index(text))
                if not pa.types.is_binary(column.type):
                    column = column.cast(pa.binary())
                new = work(column.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(v, t) for v, t in zip(new, types, strict=True)], names=names)

    return df.mapInArrow(run, out)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts of about `limit` bytes of one column, so that what a task holds at a time doesn't follow the length of the
    texts; a longer text goes alone. An empty batch stays one part."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def sampled(df: DataFrame, hash_col: str, size: int) -> DataFrame:
    """About `size` rows of df (all, where it has no more): those whose 64-bit hash is in the lowest share. It takes one count, no
    sort, and the same rows are chosen wherever they lie."""
    n = df.count()
    if n <= size:
        return df
    return df.filter(F.col(hash_col) < F.lit(int(-(1 << 63) + (1 << 64) * size // n)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_training_row(doc_id) -> F.Column:
    """Rows that labels may be learnt from: crc32 of the decimal id, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))
