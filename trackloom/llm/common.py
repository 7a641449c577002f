"""Helpers shared by the text operators: null rules, A-Z lower-casing, shared work folders."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes table that lower-cases A-Z and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is right, and much faster than ``translate``, where all is ASCII."""
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def texts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Only the key columns and the text, null texts as empty ones; other columns of any name are left out."""
    return df.select(*keys, F.coalesce(df[text], F.lit("")).alias("text"))


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of an Arrow batch of texts, its bytes, and rows of a batch of numbers.
TEXTS, SIZE, NUMBERS = 256, 8 << 20, 16_384


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch, where they are higher, to what suits long texts.

    A lazy plan reads them when it runs, so they stay lowered; no operator raises them but for steps of its own.
    """
    for name, most in ((_ROWS, TEXTS), (_BYTES, SIZE)):
        if not 0 < _number(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def _number(setting: str) -> int:
    """A setting in bytes or rows as a number; one that isn't plain counts as too large."""
    return int(setting) if setting.lstrip("-").isdigit() else 1 << 62


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other rows in an Arrow batch for the jobs that run inside, and those of before afterwards."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    return shared.folder(spark, "work")


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a shared path and read it back: the plan is cut, and a lost executor loses nothing."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a work folder that nothing reads any more."""
    shared.forget(spark, path)


def one_of_each(docs: DataFrame, key: Column, again: DataFrame) -> DataFrame:
    """``docs`` with one row for each ``_again_id, _again_key`` of ``again`` that several rows have as doc_id and key.

    The row with the least hash stays; each task leaves one row a key before rows move. Other rows are untouched.
    """
    again = keep(again, f"{shared_dir(docs.sparkSession)}/again")
    if again.isEmpty():
        return docs
    on = docs["doc_id"].eqNullSafe(again["_again_id"]) & (key == again["_again_key"])
    many, order = docs.join(again, on, "left_semi"), [c for c, kind in docs.dtypes if "map<" not in kind]
    place = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*order)))
    return docs.join(again, on, "left_anti").union(many.withColumn("_place", place).where("_place = 1").drop("_place"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(df: DataFrame, added: str, start, pass_on: list[str]) -> DataFrame:
    """Add columns computed by Python from Arrow batches; rows neither move nor change in number.

    ``added`` is their DDL schema. ``start()`` runs once in a task and returns a function from a record batch to
    the added columns' values, in order. ``pass_on`` names the columns that go through unchanged.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*df.select(*pass_on).schema.fields, *new.fields])

    def run(batches):
        import pyarrow as pa

        work, kinds = start(), [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            made = work(batch) if batch.num_rows else [[]] * len(kinds)
            made = [pa.array(v, kind) for v, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in pass_on), *made], names=[*pass_on, *new.names])

    return df.mapInArrow(run, schema)
