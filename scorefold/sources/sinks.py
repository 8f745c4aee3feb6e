"""Writers of item tables and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_items(items: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Item table; ``json`` writes one object per line."""
    items.write.mode("overwrite").format(fmt).save(path)


def write_index(items: DataFrame, path: str, nested: tuple[str, ...] = ("context",)) -> None:
    """CSV index without the nested columns."""
    items.drop(*nested).write.mode("overwrite").option("header", True).csv(path)


def write_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int) -> None:
    """A bucketed table for tables that are joined on the same keys again and again."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
