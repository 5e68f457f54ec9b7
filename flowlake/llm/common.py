"""Helpers shared by the operators on text corpora."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

ROWS_AT_ONCE = 256
WHITE = r"[\x20\x09-\x0D]+"
TRIMMED = " \t\n\u000b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIMMED))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_key(text: Column) -> Column:
    """128-bit key of a text; null and empty texts share one."""
    full = F.coalesce(text, F.lit(""))
    return F.concat_ws("-", F.hex(F.xxhash64(full)), F.hex(F.xxhash64(F.lit(1), full)))


def plus(df: DataFrame, **added: DataType) -> StructType:
    """Schema of ``df`` with further columns."""
    return StructType([*df.schema.fields, *[StructField(name, kind) for name, kind in added.items()]])


def map_batches(df: DataFrame, use: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """mapInArrow in slices of a few hundred rows, so that long texts never pile up."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = use(batch.slice(start, ROWS_AT_ONCE))
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    return df.mapInArrow(run, schema)


def texts_in(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


class Shared:
    """A broadcast value of any class, for workers that need not have this package.

    The value travels pickled by value, and is unpickled once per worker process.
    """

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        kept = self.sent.__dict__
        if "_unpickled" not in kept:
            kept["_unpickled"] = pickle.loads(self.sent.value)
        return kept["_unpickled"]


def broadcast_value(spark: SparkSession, value) -> Shared:
    return Shared(spark, value)
