"""The given star-schema tables read as transactions, customers and articles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import week_index
from shelfwise.schema import Calendar

STORE_CALENDAR = Calendar(date(1994, 12, 28), 343, (339, 340, 341, 342))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def transactions(
    spark: SparkSession,
    folder: str,
    cal: Calendar = STORE_CALENDAR,
    first_week: int | None = None,
    before_week: int | None = None,
) -> DataFrame:
    """One row per order line. The week limits are put on the raw timestamp as well, so
    they reach the order scan as pushed filters."""
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if first_week is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(cal.week_bounds(first_week)[0]).cast("timestamp_ntz"))
    if before_week is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(cal.week_bounds(before_week)[0]).cast("timestamp_ntz"))
    orders = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("t_dat"))
    # what a line gives is computed before it travels to its order
    lines = read(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").cast("bigint").alias("article_idx"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.when(F.col("l_linestatus") == "O", 2).otherwise(1).cast("tinyint").alias("sales_channel_id"),
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("bigint").alias("customer_idx"),
        "article_idx",
        "t_dat",
        "price",
        "sales_channel_id",
        week_index(F.col("t_dat"), cal).alias("week_idx"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return read(spark, folder, "customer").select(
        F.col("c_custkey").cast("bigint").alias("customer_idx"),
        F.col("c_name").alias("customer_id"),
        F.when(F.col("c_custkey") % 50 != 0, 18 + (F.col("c_custkey") * 7) % 60).cast("float").alias("age"),
        F.when(F.col("c_acctbal") > 5000, 1).cast("float").alias("FN"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).cast("float").alias("Active"),
        F.when(seg == "BUILDING", None).when(seg == "MACHINERY", "PRE-CREATE").otherwise("ACTIVE").alias(
            "club_member_status"
        ),
        F.when(seg == "BUILDING", None)
        .when(seg == "HOUSEHOLD", "Monthly")
        .when(seg == "FURNITURE", "NONE")
        .otherwise("Regularly")
        .alias("fashion_news_frequency"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    word = F.split(F.col("p_name"), " ")
    return read(spark, folder, "part").select(
        F.col("p_partkey").cast("bigint").alias("article_idx"),
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("article_id"),
        F.col("p_name").alias("prod_name"),
        F.concat_ws("|", "p_brand", "p_type").alias("product_code"),
        F.col("p_size").alias("product_type_no"),
        F.get(word, F.lit(1)).alias("product_type_name"),
        F.col("p_type").alias("product_group_name"),
        F.col("p_type").alias("index_group_name"),
        F.col("p_brand").alias("garment_group_name"),
        F.get(word, F.lit(0)).alias("colour_group_name"),
        F.get(word, F.lit(1)).alias("section_name"),
        F.get(word, F.lit(1)).alias("department_name"),
        F.col("p_size").alias("department_no"),
    )
