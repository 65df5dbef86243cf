"""Exact distinct counts of dense ids by bitmaps, which merge over days, weeks or any other key.

A bitmap holds 32,768 neighbouring ids in 4 KB. Tasks set bits before the shuffle, so of each task, key and range of
ids one bitmap is exchanged, however many rows there are, and no row is copied for each counted column. For
ids given without large holes; a column of scattered ids needs a bitmap for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_bitmaps(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, id_range, n_rows, ids): which ids of ``column`` each key has. Null ids count as rows only."""
    place = F.col(column).cast("bigint")
    return df.groupBy(*keys, F.bitmap_bucket_number(place).alias("id_range")).agg(
        F.count("*").alias("n_rows"), F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("ids")
    )


def merged(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of coarser keys, from those of finer ones."""
    return bitmaps.groupBy(*keys, "id_range").agg(F.sum("n_rows").alias("n_rows"), F.bitmap_or_agg("ids").alias("ids"))


def distinct_counts(bitmaps: DataFrame, keys: list[str], name: str, rows: str = "n_rows") -> DataFrame:
    """(keys, rows, name): rows and different ids of each key."""
    return bitmaps.groupBy(*keys).agg(F.sum("n_rows").alias(rows), F.coalesce(F.sum(F.bitmap_count("ids")), F.lit(0)).alias(name))
