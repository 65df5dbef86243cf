"""Catalogue, customer and profile queries, answered for many ids at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import age_bucket, hash_uniform, safe_ratio
from shelfwise.functions.ordering import top_k
from shelfwise.operators.metrics import PAIR
from shelfwise.schema import SEED

META = ["article_id", "prod_name", "product_type_name", "colour_group_name"]
# fixed values: purchase-count limits of the sampling segments
ACTIVITY = {"cold-start": (0, 0), "light": (1, 4), "medium": (5, 19), "heavy": (20, None)}


# --- articles -------------------------------------------------------------------


def with_metadata(df: DataFrame, articles: DataFrame) -> DataFrame:
    return df.join(articles.select("article_idx", *META), "article_idx", "left")


def search(articles: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Articles whose name, type or colour holds ``text`` literally, in any case."""
    needle = text.lower()
    hit = F.lit(False)
    for c in ("prod_name", "product_type_name", "colour_group_name"):
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return articles.filter(hit).orderBy("article_idx").limit(limit).select("article_idx", *META)


def trending(last_week: DataFrame, articles: DataFrame, n: int = 20) -> DataFrame:
    """Best sellers of the last week with their metadata."""
    return with_metadata(last_week.filter(F.col("source_rank") <= n), articles).select(
        "article_idx", F.col("source_rank").alias("rank"), F.col("score").alias("sales_last_week"), *META
    )


def browse(
    articles: DataFrame,
    sales: DataFrame,
    filters: dict[str, str] | None = None,
    text: str | None = None,
    offset: int = 0,
    limit: int = 24,
) -> DataFrame:
    """One page of the filtered catalogue by sales, never sold last, with the total hit count.
    Filters match whole values in any case, ``text`` any part of the name."""
    rows = articles
    for c, v in (filters or {}).items():
        rows = rows.filter(F.lower(c) == v.lower())
    if text:
        rows = rows.filter(F.lower("prod_name").contains(text.lower()))
    total = rows.agg(F.count("*")).scalar()
    scored = rows.join(sales.select("article_idx", "sales"), "article_idx", "left")
    page = scored.orderBy(F.col("sales").desc_nulls_last(), "article_idx").offset(offset).limit(limit)
    return page.select("article_idx", *META, "sales", total.alias("total"))


def filter_values(articles: DataFrame, columns) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    return articles.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()


# --- customers ------------------------------------------------------------------


def id_lookup(ids: DataFrame, customers: DataFrame) -> DataFrame:
    """Outside customer ids to dense keys."""
    return ids.join(customers.select("customer_id", "customer_idx"), "customer_id")


def activity_counts(history: DataFrame, customers: DataFrame) -> DataFrame:
    """Purchases of every known customer, 0 without history."""
    n = history.groupBy("customer_idx").agg(F.count("*").alias("n_purchases"))
    return customers.select("customer_idx", "customer_id", "age").join(n, "customer_idx", "left").withColumn(
        "n_purchases", F.coalesce("n_purchases", F.lit(0))
    )


def sample_by_activity(history: DataFrame, customers: DataFrame, n: int = 5, seed: int = SEED) -> DataFrame:
    """n customers per activity segment in hash order."""
    count = F.col("n_purchases")
    segment = F.lit(None).cast("string")
    for name, (lo, hi) in ACTIVITY.items():
        within = count >= lo if hi is None else count.between(lo, hi)
        segment = F.when(within, name).otherwise(segment)
    rows = activity_counts(history, customers).withColumn("segment", segment)
    rows = rows.withColumn("u", hash_uniform(seed, F.col("customer_idx")))
    best = top_k(rows, ["segment"], [F.asc("u"), F.asc("customer_idx")], n, "place")
    return best.select("segment", "place", "customer_idx", "customer_id", age_bucket(F.col("age")).alias("age_bucket"))


def customer_profiles(history: DataFrame, customers: DataFrame, cutoff_week: int) -> DataFrame:
    """Counts in all history and the last four weeks, and the age bucket, per customer."""
    n = history.groupBy("customer_idx").agg(
        F.count("*").alias("n_purchases"),
        F.count(F.when(F.col("week_idx") >= cutoff_week - 4, 1)).alias("n_last_4_weeks"),
        F.countDistinct("article_idx").alias("n_articles"),
        F.max("t_dat").alias("last_purchase"),
    )
    return n.join(customers.select("customer_idx", "customer_id", age_bucket(F.col("age")).alias("age_bucket")), "customer_idx")


def recent_purchases(history: DataFrame, articles: DataFrame, n: int = 10) -> DataFrame:
    """Each customer's n latest articles with metadata."""
    last = history.groupBy(*PAIR).agg(F.max("t_dat").alias("bought_on"))
    best = top_k(last, ["customer_idx"], [F.desc("bought_on"), F.asc("article_idx")], n, "place")
    return with_metadata(best, articles).select("customer_idx", "place", "article_idx", "bought_on", *META)


def actual_purchases(truth: DataFrame, articles: DataFrame) -> DataFrame:
    return with_metadata(truth, articles).select("customer_idx", "article_idx", *META)


def preference_summary(history: DataFrame, articles: DataFrame) -> DataFrame:
    """(customer_idx, top_types, top_colour) by the number of distinct articles, ties by name."""
    pairs = history.select(*PAIR).distinct().join(articles.select("article_idx", "product_type_name", "colour_group_name"), "article_idx")

    def best(column: str, k: int) -> DataFrame:
        n = pairs.filter(F.col(column).isNotNull()).groupBy("customer_idx", column).agg(F.count("*").alias("n"))
        return top_k(n, ["customer_idx"], [F.desc("n"), F.asc(column)], k, "r")

    types = best("product_type_name", 2).groupBy("customer_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "product_type_name"))), lambda x: x["product_type_name"]), " and ").alias("top_types")
    )
    colour = best("colour_group_name", 1).select("customer_idx", F.col("colour_group_name").alias("top_colour"))
    return types.join(colour, "customer_idx", "full")


def compare_customers(lists: DataFrame, summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (left_idx, right_idx) pair: both summaries and how many recommended articles the
    two lists share. Lists hold at most k rows each."""
    packed = lists.groupBy("customer_idx").agg(F.collect_set("article_idx").alias("items")).join(summary, "customer_idx", "left")
    out = pairs
    for side in ("left", "right"):
        out = out.join(
            packed.select(F.col("customer_idx").alias(f"{side}_idx"), *[F.col(c).alias(f"{side}_{c}") for c in ("items", "top_types", "top_colour")]),
            f"{side}_idx",
        )
    return out.select(
        "left_idx", "right_idx", "left_top_types", "right_top_types", "left_top_colour", "right_top_colour",
        F.size(F.array_intersect("left_items", "right_items")).alias("n_shared"),
    )


def sample_shoppers(history: DataFrame, customers: DataFrame, articles: DataFrame, n: int = 40, low: int = 5, high: int = 150) -> DataFrame:
    """Diverse shoppers: an equal number per age bucket (fewest purchases first), open places to
    the busiest of the rest, each with a describing sentence."""
    counts = history.groupBy("customer_idx").agg(
        F.count("*").alias("n_purchases"), F.count(F.when(F.col("sales_channel_id") == 1, 1)).alias("n_store")
    ).filter(F.col("n_purchases").between(low, high))
    known = counts.join(customers.select("customer_idx", "customer_id", age_bucket(F.col("age")).alias("age_bucket")), "customer_idx")
    with_age = known.filter(F.col("age_bucket") != "missing")
    per = max(1, n // 5)
    chosen = top_k(with_age, ["age_bucket"], [F.asc("n_purchases"), F.asc("customer_idx")], per, "place").drop("place")
    rest = known.join(chosen.select("customer_idx"), "customer_idx", "left_anti").orderBy(F.desc("n_purchases"), "customer_idx").limit(n)
    # at most 2n rows from here on
    both = chosen.withColumn("late", F.lit(0)).unionByName(rest.withColumn("late", F.lit(1)))
    busiest = F.when(F.col("late") == 1, -F.col("n_purchases")).otherwise(0)
    picked = both.orderBy("late", busiest, "customer_idx").limit(n)
    likes = preference_summary(history.join(picked.select("customer_idx"), "customer_idx", "left_semi"), articles)
    channel = F.when(F.col("n_store") * 2 >= F.col("n_purchases"), "store").otherwise("online")
    out = picked.join(likes, "customer_idx", "left").withColumn("channel", channel)
    sentence = F.concat(
        F.format_string("%d purchases, most of them %s, age group %s", "n_purchases", "channel", "age_bucket"),
        F.coalesce(F.concat(F.lit("; types: "), "top_types"), F.lit("")),
        F.coalesce(F.concat(F.lit("; colour: "), "top_colour"), F.lit("")),
    )
    return out.select("customer_idx", "customer_id", "age_bucket", "channel", "n_purchases", sentence.alias("summary"))


# --- user-made profiles ------------------------------------------------------------


def profile_list(profiles: DataFrame, purchases: DataFrame) -> DataFrame:
    """Profiles with their purchase counts."""
    n = purchases.groupBy("profile_id").agg(F.count("*").alias("n_purchases"), F.max("created_at").alias("last_purchase"))
    return profiles.join(n, "profile_id", "left").withColumn("n_purchases", F.coalesce("n_purchases", F.lit(0)))


def profile_history(purchases: DataFrame, day, price: float = 0.05, channel: int = 2, week: int | None = None) -> DataFrame:
    """Profile purchases as transactions of negative customer ids, so they never meet real ones."""
    return purchases.select(
        (-F.col("profile_id")).cast("bigint").alias("customer_idx"),
        F.col("article_idx").cast("bigint"),
        F.coalesce(F.col("t_dat"), F.lit(day)).alias("t_dat") if "t_dat" in purchases.columns else F.lit(day).alias("t_dat"),
        F.lit(price).alias("price"),
        F.lit(channel).cast("tinyint").alias("sales_channel_id"),
        F.lit(week).cast("int").alias("week_idx"),
    )


# --- funnel and trends ----------------------------------------------------------------


def candidate_funnel(merged: DataFrame, sources, scores: DataFrame | None = None) -> DataFrame:
    """Every candidate with the sources that named it, its merge rank and, with ``scores``, its
    model rank (lists are at most the merge budget long)."""
    named = F.array_compact(F.array(*[F.when(F.col(f"{s}_rank").isNotNull(), F.lit(s)) for s in sources]))
    out = merged.select(*PAIR, "final_source", "final_rank", F.array_join(named, ",").alias("sources"), F.size(named).alias("n_sources"))
    if scores is None:
        return out
    from pyspark.sql import Window as W

    w = W.partitionBy("customer_idx").orderBy(F.desc("score"), F.asc("article_idx"))
    return out.join(scores.select(*PAIR, "score"), PAIR).withColumn("model_rank", F.row_number().over(w))


def trend_groups(last_week: DataFrame, articles: DataFrame, n: int = 10) -> DataFrame:
    """Product types among the best sellers and their share of those sales."""
    g = last_week.join(articles.select("article_idx", "product_type_name"), "article_idx").groupBy("product_type_name").agg(
        F.sum("score").alias("sales"), F.count("*").alias("n_articles")
    )
    total = g.agg(F.sum("sales")).scalar()
    return g.withColumn("share", safe_ratio(F.col("sales"), total)).orderBy(F.desc("sales"), "product_type_name").limit(n)


def trend_by_age(segments: DataFrame, articles: DataFrame, n: int = 10) -> DataFrame:
    rows = segments.filter((F.col("age_bucket") != "missing") & (F.col("source_rank") <= n))
    return with_metadata(rows, articles).select("age_bucket", F.col("source_rank").alias("rank"), "article_idx", F.col("score").alias("sales"), "prod_name")


def sales_by_article_age(features: DataFrame) -> DataFrame:
    """Share of last week's sales per article age. Limits in days are fixed values."""
    age = F.col("a_days_since_first_sale")
    label = F.when(age < 14, "under 2 weeks").when(age < 60, "under 60 days").when(age < 180, "under 180 days").otherwise("older")
    rows = features.filter(age.isNotNull()).groupBy(label.alias("age_label")).agg(F.sum("a_sales_1w").alias("sales"), F.count("*").alias("n_articles"))
    total = rows.agg(F.sum("sales")).scalar()
    return rows.withColumn("share", safe_ratio(F.col("sales"), total))
