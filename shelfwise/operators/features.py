"""The 68 point-in-time features of (customer, article) candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import count_if, hash_uniform, safe_ratio
from shelfwise.functions.skew import left_join_dealt
from shelfwise.operators.candidates import bucket_units, decay_weight
from shelfwise.operators.partials import Partials, article_weeks, customer_weeks, of_history, pair_days
from shelfwise.schema import FEATURES, NEGATIVE_RATE, SEED, SOURCES, Calendar
from shelfwise.sources.splits import weeks_between

ORDINAL = ("product_group_name", "index_group_name", "garment_group_name", "colour_group_name", "section_name")


# --- customer ------------------------------------------------------------------


def customer_features(history: DataFrame, cutoff_week: int, customers: DataFrame, cal: Calendar) -> DataFrame:
    """One row per customer with history."""
    rows = history.filter(F.col("week_idx") < cutoff_week)
    return customer_features_of(customer_weeks(rows), pair_days(rows), cutoff_week, customers, cal)


def customer_features_of(weeks: DataFrame, pairs: DataFrame, cutoff_week: int, customers: DataFrame, cal: Calendar) -> DataFrame:
    """The same from partials by (customer, week) and (customer, article)."""
    w, n = F.col("week_idx"), F.sum("n")
    spread = (F.sum("price_sq") - F.sum("price") * F.sum("price") / n) / (n - 1)
    kinds = pairs.groupBy("customer_idx").agg(F.count("*").alias("c_n_unique_articles"))
    agg = weeks.groupBy("customer_idx").agg(
        n.alias("c_n_purchases"),
        *[F.sum(F.when(w >= cutoff_week - k, F.col("n")).otherwise(0)).alias(f"c_n_purchases_{k}w") for k in (1, 4, 12)],
        (F.lit(cal.cutoff_day(cutoff_week)) - F.unix_date(F.max("last"))).alias("c_days_since_last_purchase"),
        (F.sum("price") / n).alias("c_mean_price"),
        # equal prices have no spread, whatever their sums round to
        F.when(n > 1, F.when(F.min("lowest") == F.max("highest"), 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))))).alias("c_std_price"),
        (F.sum("online") / n).alias("c_online_share"),
        F.count("*").alias("c_n_active_weeks"),
        F.sum(F.bit_count("days")).alias("n_days"),
    )
    status, news = F.col("club_member_status"), F.col("fashion_news_frequency")
    who = customers.select(
        "customer_idx",
        F.col("age").cast("double").alias("c_age"),
        F.when(status.isNull(), -1).when(status == "ACTIVE", 1).otherwise(0).alias("c_club_member_status"),
        F.when(news.isNull(), -1).when(news == "Regularly", 2).when(news == "Monthly", 1).otherwise(0).alias(
            "c_fashion_news_frequency"
        ),
        F.coalesce(F.col("FN").cast("int"), F.lit(-1)).alias("c_FN"),
        F.coalesce(F.col("Active").cast("int"), F.lit(-1)).alias("c_Active"),
    )
    agg = agg.join(kinds, "customer_idx")
    # mean rows per shopping day
    agg = agg.withColumn("c_avg_basket_size", F.col("c_n_purchases") / F.col("n_days")).drop("n_days")
    out = agg.join(who, "customer_idx", "left")
    # a customer without a dimension row has null attributes, coded like null values
    coded = ("c_club_member_status", "c_fashion_news_frequency", "c_FN", "c_Active")
    return out.na.fill(-1, list(coded))


# --- article -------------------------------------------------------------------


def ordinal_codes(articles: DataFrame, columns=ORDINAL) -> DataFrame:
    """Position of each category among the sorted distinct values of the whole dimension."""
    lists = articles.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).select(F.struct("*").alias("x"))
    coded = articles.withColumn("__lists", lists.scalar())
    return coded.select(
        "article_idx",
        *[
            F.when(F.col(c).isNotNull(), F.array_position(F.col(f"__lists.{c}"), F.col(c)) - 1).alias(f"a_{c}")
            for c in columns
        ],
    )


def article_features(
    history: DataFrame,
    cutoff_week: int,
    articles: DataFrame,
    customers: DataFrame,
    cal: Calendar,
    censored_before: int | None = None,
) -> DataFrame:
    """One row per article of the dimension, and the helper ``online_share_4w``."""
    rows = history.filter(F.col("week_idx") < cutoff_week)
    return article_features_of(article_weeks(rows, customers), pair_days(rows), cutoff_week, articles, cal, censored_before)


def article_features_of(
    weeks: DataFrame, pairs: DataFrame, cutoff_week: int, articles: DataFrame, cal: Calendar, censored_before: int | None = None
) -> DataFrame:
    """The same from partials by (article, week) and (customer, article)."""
    c, w = cutoff_week, F.col("week_idx")
    censored = cal.anchor_day + 28 if censored_before is None else censored_before

    def late(column: str, n: int) -> Column:
        return F.sum(F.when(w >= c - n, F.col(column)).otherwise(0))

    # two distinct dates exist exactly when first and last differ
    again = pairs.groupBy("article_idx").agg((count_if(F.col("first") < F.col("last")) / F.count("*")).alias("rebuy"))
    sold = weeks.groupBy("article_idx").agg(
        *[late("n", n).alias(f"s{n}") for n in (1, 2, 4)],
        late("buyers", 1).alias("buyers1"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        (F.sum("price") / F.sum("n")).alias("mean_all"),
        safe_ratio(late("price", 4), late("n", 4)).alias("mean4"),
        safe_ratio(late("price", 1), late("n", 1)).alias("mean1"),
        late("aged", 12).alias("k12"),
        late("age", 12).alias("a12"),
        late("age_sq", 12).alias("q12"),
        safe_ratio(late("online", 4), late("n", 4)).alias("online_share_4w"),
    ).join(again, "article_idx")
    k, a, q = F.col("k12"), F.col("a12"), F.col("q12")
    cutoff = F.lit(cal.cutoff_day(c))
    meta = articles.select("article_idx", "product_type_no", "department_no")
    joined = meta.join(sold, "article_idx", "left").join(ordinal_codes(articles), "article_idx")
    zero = F.lit(0)
    return joined.select(
        "article_idx",
        F.coalesce("s1", zero).alias("a_sales_1w"),
        F.coalesce("s2", zero).alias("a_sales_2w"),
        F.coalesce("s4", zero).alias("a_sales_4w"),
        F.coalesce("buyers1", zero).alias("a_unique_buyers_1w"),
        safe_ratio(F.col("s1"), F.col("s4") / 4.0).alias("a_trend_ratio"),
        (cutoff - F.unix_date("first")).alias("a_days_since_first_sale"),
        F.when(F.col("first").isNotNull(), F.when(F.unix_date("first") < censored, 1).otherwise(0)).alias("a_censored_flag"),
        (cutoff - F.unix_date("last")).alias("a_days_since_last_sale"),
        F.col("mean4").alias("a_mean_price_4w"),
        safe_ratio(F.col("mean1"), F.col("mean_all")).alias("a_price_vs_own_history"),
        F.col("rebuy").alias("a_repurchase_rate"),
        safe_ratio(a, k).alias("a_mean_buyer_age_12w"),
        F.when(k > 1, F.sqrt(F.greatest((q - a * a / k) / (k - 1), F.lit(0.0)))).alias("a_std_buyer_age_12w"),
        F.col("product_type_no").alias("a_product_type_no"),
        *[F.col(f"a_{n}") for n in ORDINAL],
        F.col("department_no").alias("a_department_no"),
        "online_share_4w",
    )


# --- candidate -----------------------------------------------------------------


def candidate_features(merged: DataFrame, sources=SOURCES) -> DataFrame:
    """Source flags and their number; sources absent from the frame count as not used."""
    have = set(merged.columns)
    out = merged
    for s in sources:
        if f"{s}_rank" not in have:
            out = out.withColumn(f"{s}_rank", F.lit(None).cast("smallint")).withColumn(
                f"{s}_score", F.lit(None).cast("float")
            )
    flags = {f"in_{s}": F.when(F.col(f"{s}_rank").isNotNull(), 1).otherwise(0) for s in sources}
    total: Column = sum(flags.values(), F.lit(0))
    return out.withColumns({**flags, "n_sources": total})


def popularity_totals(history: DataFrame, cutoff_week: int, cal: Calendar) -> DataFrame:
    """One row: units of the last week (at least 1) and decayed units (at least 1e-6)."""
    rows = weeks_between(history, cutoff_week - 4, cutoff_week)
    return rows.agg(
        F.greatest(count_if(F.col("week_idx") == cutoff_week - 1), F.lit(1)).alias("units_last_week"),
        F.greatest(F.coalesce(F.sum(decay_weight(cutoff_week, cal)), F.lit(0.0)), F.lit(1e-6)).alias("units_decayed"),
    )


def bucket_totals(history: DataFrame, cutoff_week: int, buckets: DataFrame) -> DataFrame:
    return (
        bucket_units(history, cutoff_week, buckets).groupBy("age_bucket").agg(F.sum("score").alias("bucket_units"))
    )


# --- interaction and assembly --------------------------------------------------


def add_interactions(candidates: DataFrame, pairs: DataFrame, articles: DataFrame, cutoff_week: int, cal: Calendar) -> DataFrame:
    """Interaction features. ``candidates`` carries the customer and article features, the
    article's product_code and both group names, and ``online_share_4w``; ``pairs`` are the partials by (customer, article)."""
    pairs = pairs.repartition("customer_idx")
    meta = articles.select("article_idx", "product_code", "product_group_name", "garment_group_name")
    detailed = pairs.join(meta, "article_idx", "left").repartition("customer_idx")

    def per(group: str, *aggs: Column) -> DataFrame:
        return detailed.filter(F.col(group).isNotNull()).groupBy("customer_idx", group).agg(*aggs)

    codes = per("product_code", F.sum("n").alias("n_code"), F.max("last").alias("last_code"))
    groups = per("product_group_name", F.sum("n").alias("n_pg"))
    garments = per("garment_group_name", F.sum("n").alias("n_gg"))
    own = pairs.select("customer_idx", "article_idx", F.col("n").alias("n_own"), F.col("last").alias("last_own"))

    # the candidates come dealt by customer
    x = candidates.join(own, ["customer_idx", "article_idx"], "left")
    x = x.join(codes, ["customer_idx", "product_code"], "left")
    x = x.join(groups, ["customer_idx", "product_group_name"], "left")
    x = x.join(garments, ["customer_idx", "garment_group_name"], "left")
    cutoff = F.lit(cal.cutoff_day(cutoff_week))
    return x.withColumns(
        {
            "i_times_bought": F.coalesce("n_own", F.lit(0)),
            "i_days_since_bought_article": cutoff - F.unix_date("last_own"),
            "i_bought_same_product_code": F.coalesce("n_code", F.lit(0)),
            "i_days_since_bought_product_code": cutoff - F.unix_date("last_code"),
            "i_customer_share_product_group": F.col("n_pg") / F.col("c_n_purchases"),
            "i_customer_share_garment_group": F.col("n_gg") / F.col("c_n_purchases"),
            "i_age_gap": F.abs(F.col("c_age") - F.col("a_mean_buyer_age_12w")),
            "i_price_ratio": safe_ratio(F.col("a_mean_price_4w"), F.col("c_mean_price")),
            "i_channel_gap": F.abs(F.col("c_online_share") - F.col("online_share_4w")),
        }
    ).drop("n_own", "last_own", "n_code", "last_code", "n_pg", "n_gg")


def add_shares(x: DataFrame, totals: DataFrame, per_bucket: DataFrame, buckets: DataFrame) -> DataFrame:
    """Shares of the popularity scores. ``totals`` has one row, ``per_bucket`` at most one for each age bucket."""
    x = x.join(buckets, "customer_idx", "left").join(F.broadcast(per_bucket), "age_bucket", "left")
    return x.withColumns(
        {
            "popularity_last_week_share": F.col("popularity_last_week_score").cast("double")
            / totals.select("units_last_week").scalar(),
            "popularity_decayed_share": F.col("popularity_decayed_score").cast("double")
            / totals.select("units_decayed").scalar(),
            "segment_popular_share": safe_ratio(F.col("segment_popular_score"), F.col("bucket_units")),
        }
    ).drop("age_bucket", "bucket_units")


def assemble(
    merged: DataFrame,
    history: DataFrame,
    cutoff_week: int,
    articles: DataFrame,
    customers: DataFrame,
    buckets: DataFrame,
    shared: DataFrame,
    cal: Calendar,
    customer_history: DataFrame | None = None,
    article_table: DataFrame | None = None,
    totals: DataFrame | None = None,
    per_bucket: DataFrame | None = None,
    partials: Partials | None = None,
) -> DataFrame:
    """Candidates with all features in double or integer precision.

    ``customer_history`` may hold just the served customers' rows; with ``partials`` it is not needed. With the last tables, which
    a state has, no raw sales are read at all. The shared lists fill most
    candidate rows with few articles, so their features are broadcast and only the remaining
    rows look theirs up by article. The candidates are dealt by customer and stay so: no join moves a row with its features.
    """
    if customer_history is not None:
        own = of_history(customer_history, cutoff_week, customers)
    else:
        own = (of_history(history, cutoff_week, customers) if partials is None else partials).of(merged)
    art = article_features(history, cutoff_week, articles, customers, cal) if article_table is None else article_table
    art = art.join(
        articles.select("article_idx", "product_code", "product_group_name", "garment_group_name"), "article_idx"
    )
    x = candidate_features(merged.repartition("customer_idx"))
    x = left_join_dealt(x, art, "article_idx", shared.select("article_idx"), "customer_idx")
    x = x.join(customer_features_of(own.by_customer, own.pairs, cutoff_week, customers, cal), "customer_idx", "left")
    x = add_interactions(x, own.pairs, articles, cutoff_week, cal)
    totals = popularity_totals(history, cutoff_week, cal) if totals is None else totals
    per_bucket = bucket_totals(history, cutoff_week, buckets) if per_bucket is None else per_bucket
    return add_shares(x, totals, per_bucket, buckets)


def add_labels(x: DataFrame, truth: DataFrame) -> DataFrame:
    marked = truth.select("customer_idx", "article_idx", F.lit(1).alias("label"))
    return x.join(marked, ["customer_idx", "article_idx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def downsample_negatives(x: DataFrame, rate: float = NEGATIVE_RATE, seed: int = SEED, portable: bool = False) -> DataFrame:
    """All positives and a hash-chosen share of the negatives: the same rows in every run."""
    if portable:
        u = hash_uniform(seed, F.col("customer_idx"), F.col("article_idx"))
    else:
        h = F.xxhash64("customer_idx", "article_idx", F.lit(seed))
        u = F.shiftrightunsigned(h, 11) / F.lit(float(2**53))
    return x.filter((F.col("label") == 1) | (u < rate))


def enforce_types(x: DataFrame) -> DataFrame:
    """Registry order and types; a feature the frame lacks becomes a typed null."""
    have = set(x.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.type).alias(f.name) for f in FEATURES
    ]
    return x.select(
        F.col("customer_idx").cast("bigint"), F.col("article_idx").cast("bigint"), F.col("label").cast("tinyint"), *cols
    )


# --- checks --------------------------------------------------------------------


def column_health(x: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, null_rate, is_constant) of each column from one aggregate."""
    n = F.count("*")
    stats = x.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                ((n - F.count(c)) / n).alias("null_rate"),
                F.coalesce(F.min(c).cast("double") == F.max(c).cast("double"), F.lit(True)).alias("is_constant"),
            ).alias(f"s_{c}")
            for c in columns
        ]
    )
    return stats.select(F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("s")).select("s.*")


def label_consistency(x: DataFrame, truth: DataFrame) -> DataFrame:
    """Positives over truth pairs, which has to equal the candidate recall at the budget."""
    n_truth = truth.agg(F.count("*").alias("n")).scalar()
    return x.agg(F.sum("label").alias("n_positive")).select(
        "n_positive", n_truth.alias("n_truth"), safe_ratio(F.col("n_positive"), n_truth).alias("recall")
    )


