"""Exploratory queries over transactions, customers and articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.bitmaps import distinct_counts, id_bitmaps
from shelfwise.functions.columns import count_if, safe_ratio
from shelfwise.functions.ordering import exact_quantiles, running_totals, top_k
from shelfwise.operators.copurchase import basket_items, pair_counts
from shelfwise.session import materialize
from shelfwise.sources.splits import weeks_between

BASKET = ["customer_idx", "t_dat"]


def _quantile_names(points) -> dict[str, float]:
    return {f"p{p}": p / 100 for p in points}


# --- tables ---------------------------------------------------------------------


def column_dictionary(df: DataFrame) -> DataFrame:
    """(column_name, type, n_distinct, pct_null, examples): examples are the three smallest
    values. One fold of (column, value) pairs serves all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in df.columns])
    cells = df.select(F.explode(pairs).alias("p")).groupBy("p.c", "p.v").agg(F.count("*").alias("n"))
    stats = cells.groupBy("c").agg(
        F.count("v").alias("n_distinct"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = (
        top_k(cells.filter(F.col("v").isNotNull()), ["c"], [F.asc("v")], 3, "r")
        .groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]), ", ").alias("examples"))
    )
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return stats.join(first, "c", "left").select(
        F.col("c").alias("column_name"), kinds[F.col("c")].alias("type"), "n_distinct",
        (F.col("n_null") * 100.0 / F.col("n_rows")).alias("pct_null"), "examples",
    )


def duplicate_rows(tx: DataFrame) -> DataFrame:
    """Rows that occur more than once in full, and how often repeated lines share one price."""
    full = tx.groupBy(*tx.columns).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicates")
    )
    lines = tx.groupBy("customer_idx", "article_idx", "t_dat", "sales_channel_id").agg(
        F.count("*").alias("n"), F.stddev_samp("price").alias("sd")
    )
    same = lines.filter(F.col("n") > 1).agg(
        F.count("*").alias("n_repeated_lines"),
        (F.avg(F.when(F.col("sd") < 1e-6, 1.0).otherwise(0.0)) * 100).alias("pct_same_price"),
    ).select(F.struct("*")).scalar()
    return full.select("*", same.alias("s")).select(
        "n_rows", "n_duplicates", (F.col("n_duplicates") * 100.0 / F.col("n_rows")).alias("pct_duplicates"), "s.*"
    )


def referential_integrity(tx: DataFrame, customers: DataFrame, articles: DataFrame) -> DataFrame:
    """Per key: ids used, ids unknown to the dimension, dimension ids never used."""
    out = None
    for key, dim in (("customer_idx", customers), ("article_idx", articles)):
        used = tx.groupBy(key).agg(F.lit(1).alias("u"))
        both = used.join(dim.select(key, F.lit(1).alias("d")), key, "full").agg(
            F.lit(key).alias("key"),
            F.count("u").alias("n_used"),
            count_if(F.col("d").isNull()).alias("n_unknown"),
            count_if(F.col("u").isNull()).alias("n_never_used"),
        )
        out = both if out is None else out.unionByName(both)
    return out


def category_counts(customers: DataFrame, columns=("club_member_status", "fashion_news_frequency")) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("label")) for c in columns])
    return customers.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.label").agg(F.count("*").alias("n"))


def value_summary(df: DataFrame, value: str, limits: dict[str, Column]) -> DataFrame:
    """Range, mean, quantiles and the counts of rows meeting each limit."""
    q = exact_quantiles(df, [], value, _quantile_names((5, 25, 50, 75, 95)))
    s = df.agg(
        F.min(value).cast("double").alias("min_value"), F.max(value).cast("double").alias("max_value"),
        F.avg(value).alias("mean_value"), *[count_if(c).alias(n) for n, c in limits.items()],
    ).select(F.struct("*")).scalar()
    return q.select("*", s.alias("s")).select("s.*", *q.columns)


# --- time -----------------------------------------------------------------------


def volume(tx: DataFrame, by: str) -> DataFrame:
    """Rows, customers and articles per day (``t_dat``) or week (``week_idx``), counted by bitmaps of ids."""
    buyers = distinct_counts(id_bitmaps(tx, [by], "customer_idx"), [by], "n_customers", "n_tx")
    return buyers.join(distinct_counts(id_bitmaps(tx, [by], "article_idx"), [by], "n_articles").drop("n_rows"), by)


def weekday_pattern(tx: DataFrame) -> DataFrame:
    """Mean daily rows per weekday (0 = Monday) and the lift over the Monday-Friday mean."""
    daily = tx.groupBy("t_dat").agg(F.count("*").alias("n"))
    dow = daily.groupBy(F.weekday("t_dat").alias("dow")).agg(F.avg("n").alias("mean_tx"), F.count("*").alias("n_days"))
    base = dow.filter(F.col("dow") < 5).agg(F.avg("mean_tx")).scalar()
    return dow.withColumn("lift", F.col("mean_tx") / base)


def busiest_days(tx: DataFrame, n: int = 10) -> DataFrame:
    daily = tx.groupBy("t_dat").agg(F.count("*").alias("n_tx"), F.countDistinct("customer_idx").alias("n_customers"))
    return daily.orderBy(F.desc("n_tx"), "t_dat").limit(n)


def channel_share(tx: DataFrame) -> DataFrame:
    """Weekly rows per channel, side by side, with the online percentage."""
    wide = tx.groupBy("week_idx").pivot("sales_channel_id", [1, 2]).agg(F.count("t_dat")).na.fill(0)
    total = F.col("1") + F.col("2")
    return wide.select(
        "week_idx", F.col("1").alias("channel_1"), F.col("2").alias("channel_2"), (F.col("2") * 100.0 / total).alias("channel_2_pct")
    )


def debuts(tx: DataFrame, by: str = "t_dat") -> DataFrame:
    """Articles first sold per day or week."""
    first = tx.groupBy("article_idx").agg(F.min(by).alias(by))
    return first.groupBy(by).agg(F.count("*").alias("n_debuts"))


def debut_spikes(tx: DataFrame, uncensored_from, n: int = 5) -> DataFrame:
    """The days with most debuts after the start-up weeks, their rank and ratio to the median.
    The table has one row per day, so it is ranked by a plain window."""
    days = debuts(tx).filter(F.col("t_dat") >= F.lit(uncensored_from))
    median = days.agg(F.median("n_debuts")).scalar()
    ranked = days.withColumn("day_rank", F.rank().over(W.orderBy(F.desc("n_debuts"))))
    return ranked.orderBy(F.desc("n_debuts"), "t_dat").limit(n).withColumn("vs_median", safe_ratio(F.col("n_debuts"), median))


# --- customers ------------------------------------------------------------------


def purchases_per_customer(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_idx").agg(F.count("*").alias("n_purchases"))


def distribution(df: DataFrame, value: str, points=(25, 50, 75, 90, 99)) -> DataFrame:
    q = exact_quantiles(df, [], value, _quantile_names(points))
    s = df.agg(
        F.avg(value).alias("mean_value"), F.min(value).cast("double").alias("min_value"), F.max(value).cast("double").alias("max_value"),
        (F.avg(F.when(F.col(value) == 1, 1.0).otherwise(0.0)) * 100).alias("pct_one"),
    ).select(F.struct("*")).scalar()
    return q.select("*", s.alias("s")).select(*q.columns, "s.*")


def purchase_tiers(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers per purchase tier, including those who never bought."""
    n = customers.select("customer_idx").join(purchases_per_customer(tx), "customer_idx", "left")
    c = F.coalesce("n_purchases", F.lit(0))
    tier = F.when(c == 0, "0").when(c == 1, "1").when(c <= 5, "2-5").when(c <= 20, "6-20").otherwise("21+")
    counts = n.groupBy(tier.alias("tier")).agg(F.count("*").alias("n_customers"))
    total = counts.agg(F.sum("n_customers")).scalar()
    return counts.withColumn("pct", F.col("n_customers") * 100.0 / total)


def active_weeks(tx: DataFrame) -> DataFrame:
    return tx.groupBy("customer_idx").agg(F.countDistinct("week_idx").alias("n_active_weeks"))


def purchase_gaps(tx: DataFrame, most_active: int | None = None) -> DataFrame:
    """Days between successive shopping days. Rows are folded to distinct days before the window,
    so a customer has at most one row per calendar day."""
    if most_active is not None:
        best = purchases_per_customer(tx).orderBy(F.desc("n_purchases"), "customer_idx").limit(most_active)
        tx = tx.join(best, "customer_idx", "left_semi")
    days = tx.select(*BASKET).distinct()
    w = W.partitionBy("customer_idx").orderBy("t_dat")
    gap = F.datediff("t_dat", F.lag("t_dat").over(w))
    return days.select("customer_idx", gap.alias("gap_days")).filter(F.col("gap_days").isNotNull())


def basket_sizes(tx: DataFrame) -> DataFrame:
    """Distinct articles per customer and day."""
    return tx.select(*BASKET, "article_idx").distinct().groupBy(*BASKET).agg(F.count("*").alias("basket_size"))


def recency(tx: DataFrame) -> DataFrame:
    """Days from each customer's last purchase to the last day of the data."""
    last = tx.groupBy("customer_idx").agg(F.max("t_dat").alias("last"))
    end = tx.agg(F.max("t_dat")).scalar()
    return last.select("customer_idx", F.datediff(end, F.col("last")).alias("recency_days"))


def activity_by_category(tx: DataFrame, customers: DataFrame, column: str) -> DataFrame:
    rows = customers.select("customer_idx", column).join(purchases_per_customer(tx), "customer_idx", "left")
    rows = rows.withColumn("n_purchases", F.coalesce("n_purchases", F.lit(0))).filter(F.col(column).isNotNull())
    mid = exact_quantiles(rows, [column], "n_purchases", {"median_purchases": 0.5})
    stats = rows.groupBy(column).agg(F.count("*").alias("n_customers"), F.avg("n_purchases").alias("mean_purchases"))
    return stats.join(mid.select(column, "median_purchases"), column)


# --- articles -------------------------------------------------------------------


def concentration(tx: DataFrame) -> DataFrame:
    """Gini of sales per article (trapezoid under the Lorenz curve) and the sales share of the top
    1 % and 10 %. Works on one row per distinct sales count."""
    sales = tx.groupBy("article_idx").agg(F.count("*").alias("v"))
    cells = sales.groupBy("v").agg(F.count("*").alias("c"))
    ran = running_totals(cells, [], [F.asc("v")], {"upto": F.col("c")})
    tot = cells.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("s"), F.min("v").alias("low")).select(F.struct("*")).scalar()
    r = ran.withColumn("t", tot).select("v", "c", "upto", "t.*").withColumn("n", F.col("n").cast("double"))
    v, c, upto, n = F.col("v"), F.col("c"), F.col("upto"), F.col("n")
    # each value counts once in every cumulative sum at or after its rank
    cum = v * (c * (n + 1) - c * (2 * upto - c + 1) / 2)

    def top_share(p: float) -> Column:
        rest = n - F.ceil(n * F.lit(p))
        return F.sum(v * F.greatest(F.least(c.cast("double"), upto - rest), F.lit(0.0))) / F.max("s") * 100

    area = (F.sum(cum) / F.max("s") - (F.max("low") / F.max("s") + 1) / 2) / (F.max("n") - 1)
    return r.agg(
        F.max("n").alias("n_articles"), (1 - 2 * area).alias("gini"),
        top_share(0.01).alias("top_1_pct_share"), top_share(0.1).alias("top_10_pct_share"),
    )


def sales_by_category(tx: DataFrame, articles: DataFrame, columns, n: int = 15) -> DataFrame:
    """Top categories of each column by sales. Sales are folded to articles before the join."""
    per = tx.groupBy("article_idx").agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("label")) for c in columns])
    rows = articles.join(per, "article_idx", "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.explode(pairs).alias("p"))
    sums = rows.groupBy("p.column_name", "p.label").agg(F.sum("n").alias("n_sales"))
    return top_k(sums, ["column_name"], [F.desc("n_sales"), F.asc("label")], n, "rank")


def lifespans(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_idx").agg(F.datediff(F.max("t_dat"), F.min("t_dat")).alias("lifespan_days"))


def weekly_sales(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_idx", "week_idx").agg(F.count("*").alias("n"))


def decay_of_best_sellers(tx: DataFrame, n_articles: int = 500, horizon: int = 20) -> DataFrame:
    """Weekly sales of the best sellers by weeks since their first sale (weeks with sales only)."""
    weekly = weekly_sales(tx)
    per = weekly.groupBy("article_idx").agg(F.sum("n").alias("total"), F.min("week_idx").alias("debut"))
    best = per.orderBy(F.desc("total"), "article_idx").limit(n_articles)
    age = weekly.join(F.broadcast(best), "article_idx").withColumn("weeks_since_debut", F.col("week_idx") - F.col("debut"))
    age = age.filter(F.col("weeks_since_debut") <= horizon)
    mid = exact_quantiles(age, ["weeks_since_debut"], "n", {"median_sales": 0.5})
    mean = age.groupBy("weeks_since_debut").agg(F.avg("n").alias("mean_sales"))
    return mid.join(mean, "weeks_since_debut").select("weeks_since_debut", F.col("n_values").alias("n_articles"), "mean_sales", "median_sales")


def decay_of_all_articles(tx: DataFrame, uncensored_from, last_week: int, horizon: int = 40) -> DataFrame:
    """Median weekly sales by weeks since debut over every article that debuted after the start-up
    weeks, with zero weeks filled in while observable, in percent of week 1."""
    weekly = weekly_sales(tx)
    first = tx.groupBy("article_idx").agg(F.min("t_dat").alias("day"), F.min("week_idx").alias("debut"))
    grid = first.filter(F.col("day") >= F.lit(uncensored_from)).select(
        "article_idx",
        "debut",
        F.explode(F.sequence(F.lit(0), F.least(F.lit(horizon), F.lit(last_week) - F.col("debut")))).alias("weeks_since_debut"),
    )
    rows = grid.withColumn("week_idx", F.col("debut") + F.col("weeks_since_debut")).join(weekly, ["article_idx", "week_idx"], "left")
    rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    mid = exact_quantiles(rows, ["weeks_since_debut"], "n", {"median_sales": 0.5})
    ref = mid.filter(F.col("weeks_since_debut") == 1).agg(F.max("median_sales")).scalar()
    return mid.select(
        "weeks_since_debut", F.col("n_values").alias("n_articles"), "median_sales",
        safe_ratio(F.col("median_sales") * 100, ref).alias("pct_of_week_1"),
    )


def half_life(decay: DataFrame) -> DataFrame:
    """First week whose median is below half of week 1."""
    return decay.agg(F.min(F.when(F.col("pct_of_week_1") < 50, F.col("weeks_since_debut"))).alias("half_life_week"))


# --- price ----------------------------------------------------------------------


def price_by_group(tx: DataFrame, articles: DataFrame, column: str = "product_group_name") -> DataFrame:
    """Quartiles of the price per group; rows are folded to (article, price) before the join."""
    cells = tx.groupBy("article_idx", "price").agg(F.count("*").alias("k"))
    rows = cells.join(articles.select("article_idx", column), "article_idx")
    by = rows.groupBy(column, "price").agg(F.sum("k").alias("k"))
    ran = running_totals(by, [column], [F.asc("price")], {"upto": F.col("k")})
    n = by.groupBy(column).agg(F.sum("k").alias("n"))
    sized = ran.join(n, column)
    out, picks = [], []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (F.col("n") - 1) * p
        picks += [
            F.min(F.when(F.col("upto") > F.floor(at), F.col("price"))).alias(f"lo_{name}"),
            F.min(F.when(F.col("upto") > F.ceil(at), F.col("price"))).alias(f"hi_{name}"),
        ]
        part = (F.col("t") - 1) * p
        out.append((F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * (part - F.floor(part))).alias(f"{name}_price"))
    return sized.groupBy(column).agg(F.max("n").alias("t"), *picks).select(column, F.col("t").alias("n_tx"), *out)


def price_variation(tx: DataFrame, min_tx: int = 10) -> DataFrame:
    """Per article with enough sales: coefficient of variation and discount range of its price."""
    p = tx.groupBy("article_idx").agg(
        F.count("*").alias("n_tx"), F.stddev_samp("price").alias("sd"), F.avg("price").alias("mean"),
        F.min("price").alias("low"), F.max("price").alias("high"),
    ).filter(F.col("n_tx") >= min_tx)
    return p.select(
        "article_idx", "n_tx", safe_ratio(F.col("sd"), F.col("mean")).alias("cv"),
        safe_ratio(F.col("high") - F.col("low"), F.col("high")).alias("discount_range"),
    )


# --- stability and repetition ---------------------------------------------------------


def weekly_overlap(tx: DataFrame, sizes=(12, 100), first_week: int = 1) -> DataFrame:
    """Shared articles and Jaccard of each week's top lists with the previous week that had sales."""
    weekly = weekly_sales(tx).filter(F.col("week_idx") >= first_week)
    best = top_k(weekly, ["week_idx"], [F.desc("n"), F.asc("article_idx")], max(sizes), "r").select("week_idx", "article_idx", "r")
    # one row per week
    prev = weekly.select("week_idx").distinct().withColumn("prev_week", F.lag("week_idx").over(W.orderBy("week_idx")))
    prev = prev.filter(F.col("prev_week").isNotNull())
    before = best.select(F.col("week_idx").alias("prev_week"), "article_idx", F.col("r").alias("pr"))
    # each week's list and the list before it, side by side: at most 2 * max(sizes) rows per week
    now = best.join(prev, "week_idx").select("week_idx", "article_idx", "r", F.lit(None).cast("int").alias("pr"))
    past = before.join(prev, "prev_week").select("week_idx", "article_idx", F.lit(None).cast("int").alias("r"), "pr")
    rows = now.unionByName(past).groupBy("week_idx", "article_idx").agg(F.min("r").alias("r"), F.min("pr").alias("pr"))
    aggs = []
    for k in sizes:
        a, b = F.col("r") <= k, F.col("pr") <= k
        aggs += [count_if(a & b).alias(f"shared_{k}"), safe_ratio(count_if(a & b), count_if(a | b)).alias(f"jaccard_{k}")]
    return rows.groupBy("week_idx").agg(*aggs)


def overlap_summary(overlap: DataFrame) -> DataFrame:
    """One row: median overlap and the number of weeks without any; the input has a row per week."""
    return overlap.agg(
        F.count("*").alias("n_pairs"),
        F.median("jaccard_12").alias("median_jaccard_12"),
        F.median("jaccard_100").alias("median_jaccard_100"),
        F.median("shared_12").alias("median_shared_12"),
        count_if(F.col("jaccard_12") == 0).alias("n_zero_overlap_12"),
    )


def repeat_rate(tx: DataFrame, articles: DataFrame, level: str) -> DataFrame:
    """Share of rows bought after the customer's first day with the same article, code or type.
    Per (customer, thing) the first day's rows are subtracted, so no window is needed."""
    if level == "article_idx":
        daily = tx.groupBy("customer_idx", "article_idx", "t_dat").agg(F.count("*").alias("n"))
    else:
        folded = tx.groupBy("customer_idx", "article_idx", "t_dat").agg(F.count("*").alias("k"))
        daily = (
            folded.join(articles.select("article_idx", level), "article_idx")
            .groupBy("customer_idx", level, "t_dat").agg(F.sum("k").alias("n"))
        )
    pairs = daily.groupBy("customer_idx", level).agg(F.sum("n").alias("n"), F.min(F.struct("t_dat", "n")).alias("first"))
    return pairs.agg(
        F.lit(level).alias("level"), F.sum("n").alias("n_tx"), F.sum(F.col("n") - F.col("first.n")).alias("n_repeat"),
        (F.sum(F.col("n") - F.col("first.n")) / F.sum("n")).alias("repeat_rate"),
    )


def repeat_rates(tx: DataFrame, articles: DataFrame, levels=("article_idx", "product_code", "product_type_name")) -> DataFrame:
    return reduce(DataFrame.unionByName, [repeat_rate(tx, articles, x) for x in levels])


def repeat_rate_by_group(tx: DataFrame, articles: DataFrame, column: str = "product_group_name", n: int = 15) -> DataFrame:
    daily = tx.groupBy("customer_idx", "article_idx", "t_dat").agg(F.count("*").alias("n"))
    pairs = daily.groupBy("customer_idx", "article_idx").agg(F.sum("n").alias("n"), F.min(F.struct("t_dat", "n")).alias("first"))
    per = pairs.groupBy("article_idx").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("first.n")).alias("again"))
    g = per.join(articles.select("article_idx", column), "article_idx").groupBy(column).agg(
        F.sum("n").alias("n_tx"), (F.sum("again") / F.sum("n")).alias("repeat_rate")
    )
    return g.orderBy(F.desc("n_tx"), column).limit(n)


def cold_start(history: DataFrame, truth: DataFrame) -> DataFrame:
    """Shares of target-week buyers by prior purchases, and of target-week articles never sold."""
    n = history.groupBy("customer_idx").agg(F.count("*").alias("n"))
    buyers = truth.select("customer_idx").distinct().join(n, "customer_idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sold = history.select("article_idx").distinct().withColumn("sold", F.lit(1))
    arts = truth.select("article_idx").distinct().join(sold, "article_idx", "left").agg(
        F.count("*").alias("n_articles"), count_if(F.col("sold").isNull()).alias("n_new_articles")
    ).select(F.struct("*")).scalar()

    def share(cond: Column) -> Column:
        return F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100

    return buyers.agg(
        F.count("*").alias("n_buyers"),
        share(F.col("n") == 0).alias("pct_no_history"),
        share(F.col("n").between(1, 4)).alias("pct_1_to_4"),
        share(F.col("n") >= 5).alias("pct_5_or_more"),
    ).select("*", arts.alias("a")).select(
        "n_buyers", "pct_no_history", "pct_1_to_4", "pct_5_or_more", "a.*"
    ).withColumn("pct_new_articles", safe_ratio(F.col("n_new_articles") * 100, F.col("n_articles")))


def top_pairs(tx: DataFrame, as_of_week: int, lookback: int, articles: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent article pairs of one basket, fewer only where there are fewer.

    No pair is in more baskets than the second most frequent article. From there the least count asked for is
    halved until n pairs reach it; rare articles take no part before that, so early rounds cost little.
    """
    items = materialize(basket_items(tx, as_of_week, lookback))
    most = items.groupBy("article_idx").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(2).collect()
    least = most[1]["n"] if len(most) > 1 else 1
    while True:
        order = [F.desc("pair_count"), F.asc("article_a"), F.asc("article_b")]
        best = materialize(pair_counts(items, least).orderBy(*order).limit(n))
        if least == 1 or best.count() == n:
            break
        least //= 2
    names = articles.select("article_idx", "prod_name")
    return best.join(
        names.select(F.col("article_idx").alias("article_a"), F.col("prod_name").alias("name_a")), "article_a", "left"
    ).join(names.select(F.col("article_idx").alias("article_b"), F.col("prod_name").alias("name_b")), "article_b", "left").select(
        "article_a", "article_b", "pair_count", "name_a", "name_b"
    )


def multi_variant_baskets(tx: DataFrame, as_of_week: int, lookback: int, articles: DataFrame) -> DataFrame:
    """Basket-and-code groups with several variants, against baskets of at least two articles."""
    items = weeks_between(tx, as_of_week - lookback, as_of_week).select(*BASKET, "article_idx").distinct()
    sizes = items.groupBy(*BASKET).agg(F.count("*").alias("k")).filter(F.col("k") >= 2).agg(F.count("*").alias("n")).scalar()
    variants = items.join(articles.select("article_idx", "product_code"), "article_idx").groupBy(*BASKET, "product_code").agg(F.count("*").alias("k"))
    return variants.agg(count_if(F.col("k") >= 2).alias("n_multi_variant")).withColumn("n_multi_article", sizes).withColumn(
        "pct_multi_variant", safe_ratio(F.col("n_multi_variant") * 100, F.col("n_multi_article"))
    )


