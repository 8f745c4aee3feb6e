"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefold.session import shared_folder

#: Whitespace of the word contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
GAPS = r"[\x20\x09-\x0D]+"

#: A table of at most so many narrow rows (ids, hashes, a few numbers) may be broadcast: some tens of MB.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and U+0009-U+000D; an empty array for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAPS))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: one in five by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared checkpoint folder and read back: lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, hinted for broadcast only if it has at most so many rows (a count of file footers); else the join stays shuffled."""
    return F.broadcast(written) if written.count() <= rows else written


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand at most so many rows at once to Python: for long rows, of which Spark's usual batch would fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ship(module: str) -> None:
    """Send the functions of a module to the tasks by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
