"""Loading, converting and storing the three base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import age_bucket, week_index
from shelfwise.session import materialize
from shelfwise.functions.ordering import running_rank
from shelfwise.schema import Calendar


def with_week_index(tx: DataFrame, cal: Calendar) -> DataFrame:
    """Add ``week_idx``; ``t_dat`` may be a date or a number of epoch days."""
    if dict(tx.dtypes)["t_dat"] != "date":
        tx = tx.withColumn("t_dat", F.date_from_unix_date(F.col("t_dat").cast("int")))
    return tx.withColumn("week_idx", week_index(F.col("t_dat"), cal))


def load_transactions(spark: SparkSession, path: str, cal: Calendar) -> DataFrame:
    tx = spark.read.parquet(path)
    return tx if "week_idx" in tx.columns else with_week_index(tx, cal)


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    """NaN in the numeric attributes is stored as null."""
    df = spark.read.parquet(path)
    for c in ("age", "FN", "Active"):
        if dict(df.dtypes).get(c) in ("float", "double"):
            df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def customer_age_buckets(customers: DataFrame) -> DataFrame:
    return customers.select("customer_idx", age_bucket(F.col("age")).alias("age_bucket"))


def article_product_codes(articles: DataFrame) -> DataFrame:
    return articles.select("article_idx", "product_code")


# --- conversion from raw exports ------------------------------------------


def dense_keys(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """Add ``key``: the 0-based position of ``id_col`` in sorted order, ranked without a
    single-task window (range shuffle plus partition offsets)."""
    ids = df.select(id_col).distinct()
    keyed = running_rank(ids, [], [F.col(id_col).asc()], key)
    return df.join(keyed.select(id_col, (F.col(key) - 1).cast("bigint").alias(key)), id_col)


def convert_articles(raw: DataFrame) -> DataFrame:
    """Raw article rows to the dimension: ids padded to ten digits, dense key added."""
    return dense_keys(raw.withColumn("article_id", F.lpad("article_id", 10, "0")), "article_id", "article_idx")


def convert_customers(raw: DataFrame) -> DataFrame:
    out = raw
    for c in ("FN", "Active", "age"):
        if c in raw.columns:
            out = out.withColumn(c, F.col(c).cast("float"))
    return dense_keys(out, "customer_id", "customer_idx")


def convert_transactions(raw: DataFrame, articles: DataFrame, customers: DataFrame, cal: Calendar) -> DataFrame:
    """Raw sales rows to the fact table through the two key maps."""
    tx = raw.select(
        F.to_date("t_dat").alias("t_dat"),
        "customer_id",
        F.lpad(F.col("article_id").cast("string"), 10, "0").alias("article_id"),
        F.col("price").cast("double").alias("price"),
        F.col("sales_channel_id").cast("tinyint").alias("sales_channel_id"),
    )
    tx = tx.join(articles.select("article_id", "article_idx"), "article_id").join(
        customers.select("customer_id", "customer_idx"), "customer_id"
    )
    return with_week_index(
        tx.select("t_dat", "customer_idx", "article_idx", "price", "sales_channel_id"), cal
    )


def convert_sample_submission(spark: SparkSession, csv_path: str, out: str) -> None:
    """Submission CSV (customer id, ten-digit article ids) to parquet."""
    df = spark.read.schema("customer_id string, prediction string").csv(csv_path, header=True)
    df.write.mode("overwrite").option("compression", "zstd").parquet(out)


ARTICLE_CSV = (
    "article_id string, product_code string, prod_name string, product_type_no int, product_type_name string, "
    "product_group_name string, graphical_appearance_no int, graphical_appearance_name string, "
    "colour_group_code int, colour_group_name string, perceived_colour_value_id int, "
    "perceived_colour_value_name string, perceived_colour_master_id int, perceived_colour_master_name string, "
    "department_no int, department_name string, index_code string, index_name string, index_group_no int, "
    "index_group_name string, section_no int, section_name string, garment_group_no int, "
    "garment_group_name string, detail_desc string"
)
CUSTOMER_CSV = (
    "customer_id string, FN float, Active float, club_member_status string, "
    "fashion_news_frequency string, age float, postal_code string"
)
TRANSACTION_CSV = "t_dat string, customer_id string, article_id string, price double, sales_channel_id int"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)


# --- sinks ------------------------------------------------------------------


def write_transactions(tx: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Fact sink: one folder per week, so week filters prune partitions; days sorted inside
    the files, so date filters skip row groups. A week is spread over as many tasks as its
    size asks for, since one week may hold most rows. The input is computed once and saved, as it
    is read for the sizes and for the rows."""
    tx = materialize(tx)
    parts = F.ceil(F.count("*") / F.lit(rows_per_file)).cast("int")
    sizes = tx.groupBy("week_idx").agg(parts.alias("parts"))  # one row per week
    (
        tx.join(F.broadcast(sizes), "week_idx")
        .repartition("week_idx", F.pmod(F.hash("customer_idx", "article_idx"), F.col("parts")))
        .drop("parts")
        .sortWithinPartitions("week_idx", "t_dat")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("week_idx")
        .parquet(path)
    )


def write_fold_features(features: DataFrame, path: str, fold_week: int) -> None:
    """Each fold owns one folder and overwrites it, so a fold that is built again is not stored twice."""
    features.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/fold={fold_week}")


def write_holdout_features(features: DataFrame, public: str, labels: str) -> None:
    """Holdout sink: the public features carry label -1, the labels are stored apart."""
    features = materialize(features)
    features.withColumn("label", F.lit(-1).cast("tinyint")).write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(public)
    features.select("customer_idx", "article_idx", "label").write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(labels)


def read_folds(spark: SparkSession, path: str, weeks: list[int]) -> DataFrame:
    """Read several folds; the filter prunes the fold folders."""
    return spark.read.parquet(path).filter(F.col("fold").isin(list(weeks)))


# --- content hashes -----------------------------------------------------------


def content_summary(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-free hash: the sum of the row hashes as a decimal."""
    row = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.select(row.alias("h")).agg(
        F.lit(name).alias("table_name"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("content_hash"),
    )


def portable_content_summary(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`content_summary` with md5, so other SQL engines give the same value."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.select(head.alias("h")).agg(
        F.lit(name).alias("table_name"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("content_hash"),
    )


def export_tables(tables: dict[str, DataFrame], path: str, params: dict[str, str]) -> DataFrame:
    """Write each table under ``path`` with a manifest; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if name == "segment_popular":
            writer = writer.partitionBy("age_bucket")
        writer.parquet(f"{path}/{name}")
        part = content_summary(spark.read.parquet(f"{path}/{name}"), name)
        manifest = part if manifest is None else manifest.unionByName(part)
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    spark.createDataFrame(sorted(params.items()), "key string, value string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/_params")
    return spark.read.parquet(f"{path}/_manifest")


def load_exported(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """Read an export; with ``verify`` counts and hashes must equal the manifest."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    names = [r.table_name for r in manifest.select("table_name").collect()]
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if verify:
        found = None
        for n, df in tables.items():
            part = content_summary(df, n)
            found = part if found is None else found.unionByName(part)
        bad = [r.table_name for r in manifest.exceptAll(found).collect()]
        if bad:
            raise ValueError(f"exported tables changed since they were written: {bad}")
    return tables


def judge_additions(held: DataFrame, new: DataFrame, cap: int) -> DataFrame:
    """All rows of ``new`` with ``accepted``. ``held`` has (profile_id, held), the purchases a profile has.

    A profile's addition that would bring it above ``cap`` is refused as a whole; nothing is dropped.
    """
    sizes = new.groupBy("profile_id").agg(F.count("*").alias("__n"))
    room = sizes.join(held.select("profile_id", F.col("held").alias("__held")), "profile_id", "left")
    fits = room.select("profile_id", (F.coalesce("__held", F.lit(0)) + F.col("__n") <= cap).alias("accepted"))
    return new.join(fits, "profile_id")
