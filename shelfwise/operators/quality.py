"""Load verification: the stored tables against their source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_tables(name: str, source: DataFrame, stored: DataFrame, id_column: str) -> DataFrame:
    """(table_name, check_name, source_value, stored_value, passed): rows, distinct ids and the
    nulls of every shared column, one aggregate per side."""
    shared = [c for c in source.columns if c in stored.columns]
    names = ["rows", "distinct_ids", *[f"nulls_{c}" for c in shared]]

    def profile(df: DataFrame, out: str) -> DataFrame:
        row = df.agg(
            F.count("*").alias("rows"),
            F.countDistinct(id_column).alias("distinct_ids"),
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls_{c}") for c in shared],
        )
        pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias(out)) for n in names])
        return row.select(F.explode(pairs).alias("p")).select("p.*")

    both = profile(source, "source_value").join(profile(stored, "stored_value"), "check_name")
    return both.select(
        F.lit(name).alias("table_name"), "check_name", "source_value", "stored_value",
        (F.col("source_value") == F.col("stored_value")).alias("passed"),
    )


def compare_totals(source: DataFrame, stored: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Price sums within ``tolerance`` and equal date ranges, one row."""

    def totals(df: DataFrame):
        return df.agg(F.sum("price").alias("s"), F.min("t_dat").alias("lo"), F.max("t_dat").alias("hi")).select(F.struct("*"))

    row = stored.agg(F.count("*").alias("n_rows")).select("n_rows", totals(source).scalar().alias("a"), totals(stored).scalar().alias("b"))
    return row.select(
        "n_rows",
        F.col("a.s").alias("source_price_sum"),
        F.col("b.s").alias("stored_price_sum"),
        (F.abs(F.col("a.s") - F.col("b.s")) <= tolerance * F.abs(F.col("a.s"))).alias("price_ok"),
        ((F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))).alias("dates_ok"),
    )


def round_trip(raw: DataFrame, stored: DataFrame, articles: DataFrame, customers: DataFrame) -> DataFrame:
    """Map the stored keys back to ids and compare with the raw rows, in both directions and with
    multiplicity: one union and one aggregate, over all rows."""
    keys = ["t_dat", "customer_id", "article_id", "sales_channel_id"]
    back = (
        stored.join(articles.select("article_idx", "article_id"), "article_idx")
        .join(customers.select("customer_idx", "customer_id"), "customer_idx")
    )
    signed = reduce(
        DataFrame.unionByName,
        [raw.select(*keys, F.lit(1).alias("side")), back.select(*keys, F.lit(-1).alias("side"))],
    )
    diff = signed.groupBy(*keys).agg(F.sum("side").alias("d"))
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("n_only_in_source"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("n_only_in_store"),
    )


def id_lengths(articles: DataFrame, length: int = 10) -> DataFrame:
    return articles.agg(
        F.count("*").alias("n_ids"), F.count(F.when(F.length("article_id") != length, 1)).alias("n_wrong_length")
    )
