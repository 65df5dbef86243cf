"""Candidate generators. Every frame follows :data:`shelfwise.schema.CANDIDATES`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import age_bucket
from shelfwise.functions.ordering import running_rank, top_k
from shelfwise.functions.skew import expansion_join
from shelfwise.schema import (
    CANDIDATES,
    DECAY_WEEKS,
    PRODUCT_CODE_WEEKS,
    SEGMENT_WEEKS,
    SOURCE_K,
    Calendar,
)
from shelfwise.session import materialize
from shelfwise.sources.splits import before_week, weeks_between


def shape(df: DataFrame, source: str, score: str = "score", rank: str = "source_rank") -> DataFrame:
    """Fixed columns and types; narrowing happens only here."""
    return df.select(
        F.col("customer_idx").cast("bigint"),
        F.col("article_idx").cast("bigint"),
        F.lit(source).alias("source"),
        F.col(score).cast("float").alias("score"),
        F.col(rank).cast("smallint").alias("source_rank"),
    )


def of_customers(df: DataFrame, customers: DataFrame | None) -> DataFrame:
    """Rows of the given customers; ``None`` keeps everyone and saves the join."""
    return df if customers is None else df.join(customers.select("customer_idx"), "customer_idx", "left_semi")


# --- personal sources --------------------------------------------------------


def repurchase(
    history: DataFrame,
    cutoff_week: int,
    customers: DataFrame | None,
    k: int = SOURCE_K["repurchase"],
    lookback_weeks: int | None = None,
    ordering: str = "production",
) -> DataFrame:
    """Articles bought before: latest first, then (``production``) most often, then lowest id."""
    if ordering not in ("production", "recency_only"):
        raise ValueError(ordering)
    rows = before_week(history, cutoff_week)
    if lookback_weeks is not None:
        rows = rows.filter(F.col("week_idx") >= cutoff_week - lookback_weeks)
    pairs = of_customers(rows, customers).groupBy("customer_idx", "article_idx").agg(
        F.max("t_dat").alias("last_date"), F.count("*").alias("n")
    )
    order = [F.desc("last_date"), F.asc("article_idx")]
    if ordering == "production":
        order.insert(1, F.desc("n"))
    best = top_k(pairs, ["customer_idx"], order, k, "source_rank")
    return shape(best.withColumn("score", F.unix_date("last_date")), "repurchase")


def product_code_siblings(
    history: DataFrame,
    cutoff_week: int,
    customers: DataFrame | None,
    articles: DataFrame,
    k: int = SOURCE_K["product_code"],
    lookback_weeks: int = PRODUCT_CODE_WEEKS,
    sales_history: DataFrame | None = None,
) -> DataFrame:
    """Unbought articles that share a product code with a recent purchase, by last week's sales.

    The first 2k articles of a code are its head, one array a code. A customer takes the first k of it
    that they do not own, by array difference, so a code's articles are not expanded for each customer. Only customers
    who own most of the head of a larger code go on to its next articles, in blocks of k and no deeper than k plus
    what they own. Both joins cut codes that very many customers bought.
    """
    head = 2 * k
    codes = articles.select("article_idx", "product_code").filter(F.col("product_code").isNotNull())
    rows = of_customers(before_week(history, cutoff_week), customers)
    bought = rows.groupBy("customer_idx", "article_idx").agg(F.max("week_idx").alias("last_week"))
    sold = history if sales_history is None else sales_history
    sales = (
        sold.filter(F.col("week_idx") == cutoff_week - 1).groupBy("article_idx").agg(F.count("*").alias("score"))
    )
    scored = codes.join(sales, "article_idx", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    ranked = materialize(running_rank(scored, ["product_code"], [F.desc("score"), F.asc("article_idx")], "code_rank"))
    entry = F.when(F.col("code_rank") <= head, F.struct("code_rank", "article_idx", "score"))
    heads = ranked.groupBy("product_code").agg(F.sort_array(F.collect_list(entry)).alias("head"), F.count("*").alias("articles"))
    wanted = (
        expansion_join(bought, ranked.select("article_idx", "product_code", "code_rank"), ["article_idx"], "customer_idx", "product_code")
        .groupBy("customer_idx", "product_code")
        .agg(
            F.count("*").alias("owned"),
            F.max("last_week").alias("last_week"),
            F.collect_list(F.when(F.col("code_rank") <= head, F.col("code_rank").cast("int"))).alias("owned_head"),
        )
        .filter(F.col("last_week") >= cutoff_week - lookback_weeks)
    )
    free = F.array_except(F.sequence(F.lit(1), F.size("head")), F.col("owned_head"))
    taken = expansion_join(wanted, heads, ["product_code"], "customer_idx", "product_code").select(
        "customer_idx", "product_code", "owned", "articles", F.slice(free, 1, k).alias("free"), "head"
    )
    near = taken.select("customer_idx", F.explode(F.transform("free", lambda r: F.get("head", r - 1))).alias("a"))
    near = near.select("customer_idx", "a.article_idx", "a.score")
    more = taken.filter((F.size("free") < k) & (F.col("articles") > head)).select(
        "customer_idx",
        "product_code",
        (F.col("owned") + k).alias("deepest"),
        F.explode(F.sequence(F.lit(head // k), F.floor((F.col("owned") + (k - 1)) / k).cast("int"))).alias("block"),
    )
    blocks = ranked.filter(F.col("code_rank") > head).withColumn("block", F.floor((F.col("code_rank") - 1) / k).cast("int"))
    deep = (
        expansion_join(more, blocks, ["product_code", "block"], "customer_idx", "article_idx")
        .filter(F.col("code_rank") <= F.col("deepest"))
        .select("customer_idx", "article_idx", "score")
        .join(bought.select("customer_idx", "article_idx"), ["customer_idx", "article_idx"], "left_anti")
    )
    found = near.unionByName(deep)
    best = top_k(found, ["customer_idx"], [F.desc("score"), F.asc("article_idx")], k, "source_rank")
    return shape(best, "product_code")


# --- shared lists -------------------------------------------------------------


def last_week_top(history: DataFrame, cutoff_week: int, k: int = SOURCE_K["popularity_last_week"]) -> DataFrame:
    """(article_idx, score, source_rank): units of the last week; at most k rows."""
    units = history.filter(F.col("week_idx") == cutoff_week - 1).groupBy("article_idx").agg(F.count("*").alias("score"))
    return _ranked_list(units, k)


def decay_weight(cutoff_week: int, cal: Calendar, decay: str = "inverse", halflife_days: float = 7.0) -> Column:
    age = F.lit(cal.cutoff_day(cutoff_week)) - F.unix_date("t_dat")
    if decay == "inverse":
        return F.lit(1.0) / (F.lit(1.0) + age.cast("double"))
    if decay == "exp":
        return F.pow(F.lit(0.5), age.cast("double") / F.lit(halflife_days))
    raise ValueError(decay)


def decayed_top(
    history: DataFrame,
    cutoff_week: int,
    cal: Calendar,
    k: int = SOURCE_K["popularity_decayed"],
    decay: str = "inverse",
    halflife_days: float = 7.0,
) -> DataFrame:
    """Time-decayed units of the last weeks. Units are counted per day first, so the float sum
    has one term per day and does not depend on the row order."""
    daily = (
        weeks_between(history, cutoff_week - DECAY_WEEKS, cutoff_week)
        .groupBy("article_idx", "t_dat")
        .agg(F.count("*").alias("n"))
    )
    # rounded so that equal scores tie, and fall to the article id, however they were summed
    score = F.round(F.sum(F.col("n") * decay_weight(cutoff_week, cal, decay, halflife_days)), 9)
    return _ranked_list(daily.groupBy("article_idx").agg(score.alias("score")), k)


def _ranked_list(scored: DataFrame, k: int) -> DataFrame:
    """Top k of the whole table as a short list with ranks (a k-row sort, then positions)."""
    best = scored.orderBy(F.desc("score"), F.asc("article_idx")).limit(k)
    packed = best.agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("score").cast("double")).alias("neg"), "article_idx", "score"))
        ).alias("best")
    )
    return packed.select(F.posexplode("best").alias("pos", "x")).select(
        "x.article_idx", "x.score", (F.col("pos") + 1).alias("source_rank")
    )


def bucket_units(history: DataFrame, cutoff_week: int, buckets: DataFrame) -> DataFrame:
    """Units per (age bucket, article) in the segment window, over all customers. Counted per
    customer and article first, so the join with the buckets carries fewer rows."""
    per_customer = (
        weeks_between(history, cutoff_week - SEGMENT_WEEKS, cutoff_week)
        .groupBy("customer_idx", "article_idx")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_customer.join(buckets, "customer_idx")
        .groupBy("age_bucket", "article_idx")
        .agg(F.sum("n").alias("score"))
    )


def segment_top(
    history: DataFrame, cutoff_week: int, buckets: DataFrame, k: int = SOURCE_K["segment_popular"]
) -> DataFrame:
    """(age_bucket, article_idx, score, source_rank): at most k rows per bucket."""
    units = bucket_units(history, cutoff_week, buckets)
    return top_k(units, ["age_bucket"], [F.desc("score"), F.asc("article_idx")], k, "source_rank")


def as_array(short_list: DataFrame, *cols: str) -> DataFrame:
    """A k-row list packed into one array value, to be read as a scalar subquery."""
    return short_list.agg(F.sort_array(F.collect_list(F.struct("source_rank", *cols))).alias("items"))


def give_to_all(short_list: DataFrame, customers: DataFrame, source: str) -> DataFrame:
    """Hand a k-row list to every customer. The list is a scalar subquery that each task
    expands, so the customers are neither joined nor shuffled."""
    items = as_array(short_list, "article_idx", "score")
    return shape(customers.select("customer_idx", F.inline(items.scalar())), source)


def popularity_last_week(
    history: DataFrame, cutoff_week: int, customers: DataFrame, k: int = SOURCE_K["popularity_last_week"]
) -> DataFrame:
    return give_to_all(last_week_top(history, cutoff_week, k), customers, "popularity_last_week")


def popularity_decayed(
    history: DataFrame,
    cutoff_week: int,
    customers: DataFrame,
    cal: Calendar,
    k: int = SOURCE_K["popularity_decayed"],
    decay: str = "inverse",
    halflife_days: float = 7.0,
) -> DataFrame:
    best = decayed_top(history, cutoff_week, cal, k, decay, halflife_days)
    return give_to_all(best, customers, "popularity_decayed")


def segment_popular(
    history: DataFrame,
    cutoff_week: int,
    customers: DataFrame,
    customer_table: DataFrame,
    k: int = SOURCE_K["segment_popular"],
) -> DataFrame:
    """Top list of the customer's age bucket; customers without a dimension row get nothing."""
    buckets = customer_table.select("customer_idx", age_bucket(F.col("age")).alias("age_bucket"))
    lists = (
        segment_top(history, cutoff_week, buckets, k)
        .groupBy("age_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("source_rank", "article_idx", "score"))).alias("items"))
    )
    # six buckets of at most k entries
    given = customers.join(buckets, "customer_idx").join(F.broadcast(lists), "age_bucket")
    return shape(given.select("customer_idx", F.inline("items")), "segment_popular")


# --- contract ------------------------------------------------------------------


def contract_report(df: DataFrame, k: int) -> DataFrame:
    """One row: row count, repeated pairs, highest rank and rank violations."""
    pairs = df.groupBy("customer_idx", "article_idx").agg(
        F.count("*").alias("n"), F.max("source_rank").alias("top"), F.min("source_rank").alias("low")
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated_pairs"),
        F.max("top").cast("int").alias("max_rank"),
        F.count(F.when((F.col("top") > k) | (F.col("low") < 1), 1)).alias("n_bad_ranks"),
    )


def check_candidates(df: DataFrame, k: int, name: str) -> None:
    want = [(f.name, f.dataType) for f in CANDIDATES]
    have = [(f.name, f.dataType) for f in df.schema]
    if want != have:
        raise ValueError(f"{name}: columns {have} differ from {want}")
    r = contract_report(df, k).first()
    if r.n_repeated_pairs or r.n_bad_ranks:
        raise ValueError(f"{name}: {r.n_repeated_pairs} repeated pairs, {r.n_bad_ranks} ranks outside 1..{k}")
