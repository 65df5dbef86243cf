"""Basket co-purchase edges and the candidates drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordering import top_k
from shelfwise.functions.skew import expansion_join
from shelfwise.operators.candidates import of_customers, shape
from shelfwise.schema import BASKET_WEEKS, SEED_WEEKS, SOURCE_K
from shelfwise.session import materialize
from shelfwise.sources.splits import before_week, weeks_between

BASKET = ["customer_idx", "t_dat"]
# baskets up to this many distinct articles are paired directly
DIRECT_BASKET_SIZE = 100


def basket_items(history: DataFrame, as_of_week: int, lookback_weeks: int) -> DataFrame:
    """Distinct (basket, article) rows; a basket is one customer's day."""
    rows = weeks_between(history, as_of_week - lookback_weeks, as_of_week)
    return rows.select(*BASKET, "article_idx").distinct()


def pair_counts(items: DataFrame, min_count: int, direct_size: int = DIRECT_BASKET_SIZE) -> DataFrame:
    """(article_a < article_b, pair_count, na, nb) of all pairs in at least ``min_count`` baskets;
    na and nb count the baskets of either article.

    Exact, and without listing all pairs of a large basket:

    * baskets of up to ``direct_size`` articles are paired directly. Rows stay with their customer: an article
      in fewer than ``min_count`` baskets adds few pairs, and looking it up would exchange every row twice;
    * an article of a counted pair is in at least ``min_count`` baskets itself, so rarer
      articles are dropped from larger baskets first;
    * in those, a pair not met in any small one must share ``min_count`` large
      baskets. The smallest shared one cannot be among the ``min_count - 1`` largest of
      either article, so those memberships need not be paired. What remains is paired
      in square blocks of bounded size, and the pairs are counted by looking them up in
      the large-basket memberships.
    """
    common = items.groupBy("article_idx").agg(F.count("*").alias("baskets")).filter(F.col("baskets") >= min_count)
    sized = _sized(items)
    direct = sized.filter(F.col("size") <= direct_size)
    larger = sized.filter(F.col("size") > direct_size)
    # the sizes alone are one aggregate where the items lie; the items are not met with them for it
    if _sizes(items).filter(F.col("size") > direct_size).isEmpty():
        found = _paired(direct).filter(F.col("n_small") >= min_count)
        return _with_baskets(found.withColumnRenamed("n_small", "pair_count"), common)
    live = materialize(_sized(larger.drop("size").join(common.select("article_idx"), "article_idx", "left_semi")))
    small = _paired(direct.unionByName(live.filter(F.col("size") <= direct_size)))
    return _with_baskets(_with_large_baskets(small, live.filter(F.col("size") > direct_size), min_count, direct_size), common)


def _sized(items: DataFrame) -> DataFrame:
    """The items of baskets with more than one article, and how many those are."""
    return items.join(_sizes(items).filter(F.col("size") > 1), BASKET)


def _sizes(items: DataFrame) -> DataFrame:
    return items.groupBy(*BASKET).agg(F.count("*").alias("size"))


def _paired(small: DataFrame) -> DataFrame:
    """(article_a, article_b, n_small): all pairs of each basket, counted."""
    return (
        small.groupBy(*BASKET)
        .agg(F.sort_array(F.collect_list("article_idx")).alias("arts"))
        .select("arts", F.posexplode("arts").alias("i", "article_a"))
        .select("article_a", F.explode(F.expr("slice(arts, i + 2, size(arts))")).alias("article_b"))
        .groupBy("article_a", "article_b")
        .agg(F.count("*").alias("n_small"))
    )


def _with_baskets(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """``na`` and ``nb`` of pairs already found."""
    pairs = pairs.join(common.select(F.col("article_idx").alias("article_a"), F.col("baskets").alias("na")), "article_a")
    pairs = pairs.join(common.select(F.col("article_idx").alias("article_b"), F.col("baskets").alias("nb")), "article_b")
    return pairs.select("article_a", "article_b", "pair_count", "na", "nb")


def _with_large_baskets(small: DataFrame, large: DataFrame, min_count: int, direct_size: int) -> DataFrame:
    generators = large
    if min_count > 1:
        largest_first = [F.desc("size"), F.asc("customer_idx"), F.asc("t_dat")]
        skip = top_k(large, ["article_idx"], largest_first, min_count - 1).select(*BASKET, "article_idx")
        generators = large.join(skip, [*BASKET, "article_idx"], "left_anti")
    placed = (
        generators.withColumn("blocks", F.ceil(F.col("size") / F.lit(direct_size)).cast("int"))
        .withColumn("own", F.pmod(F.hash("article_idx"), F.col("blocks")))
        .select(*BASKET, "article_idx", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select(*BASKET, "article_idx", F.least("own", "other").alias("row_block"), F.greatest("own", "other").alias("col_block"))
    )
    left = placed.withColumnsRenamed({"article_idx": "article_a"})
    right = placed.withColumnsRenamed({"article_idx": "article_b"})
    from_large = (
        left.join(right, [*BASKET, "row_block", "col_block"])
        .filter(F.col("article_a") < F.col("article_b"))
        .groupBy("article_a", "article_b")
        .agg(F.lit(0).cast("long").alias("n_small"))
    )
    found = small.unionByName(from_large).groupBy("article_a", "article_b").agg(F.sum("n_small").alias("n_small"))
    n_large = large.groupBy("article_idx").agg(F.count("*").alias("n_large"))
    reach = (
        found.join(n_large.select(F.col("article_idx").alias("article_a"), F.col("n_large").alias("la")), "article_a", "left")
        .join(n_large.select(F.col("article_idx").alias("article_b"), F.col("n_large").alias("lb")), "article_b", "left")
        .na.fill(0, ["la", "lb"])
        .filter(F.col("n_small") + F.least("la", "lb") >= min_count)
    )
    rarer_first = F.col("la") <= F.col("lb")
    reach = materialize(
        reach.withColumn("rare", F.when(rarer_first, F.col("article_a")).otherwise(F.col("article_b"))).withColumn(
            "frequent", F.when(rarer_first, F.col("article_b")).otherwise(F.col("article_a"))
        )
    )
    # counted from the side with fewer large baskets
    members = large.select(*BASKET, F.col("article_idx").alias("rare"), F.xxhash64(*BASKET).alias("basket"))
    shared = (
        expansion_join(members, reach.filter(F.least("la", "lb") > 0), ["rare"], "basket", "frequent")
        .join(large.select(*BASKET, F.col("article_idx").alias("frequent")), [*BASKET, "frequent"], "left_semi")
        .groupBy("article_a", "article_b")
        .agg(F.count("*").alias("n_shared"))
    )
    return (
        reach.join(shared, ["article_a", "article_b"], "left")
        .withColumn("pair_count", F.col("n_small") + F.coalesce("n_shared", F.lit(0)))
        .filter(F.col("pair_count") >= min_count)
        .select("article_a", "article_b", "pair_count")
    )


def copurchase_edges(
    history: DataFrame,
    as_of_week: int,
    lookback_weeks: int = BASKET_WEEKS,
    min_count: int = 5,
    direct_size: int = DIRECT_BASKET_SIZE,
) -> DataFrame:
    """Symmetric (seed_article, candidate_article, cosine_score) edges."""
    pairs = pair_counts(basket_items(history, as_of_week, lookback_weeks), min_count, direct_size)
    cosine = F.col("pair_count") / F.sqrt(F.col("na").cast("double") * F.col("nb").cast("double"))
    both = F.explode(
        F.array(
            F.struct(F.col("article_a").alias("seed_article"), F.col("article_b").alias("candidate_article")),
            F.struct(F.col("article_b").alias("seed_article"), F.col("article_a").alias("candidate_article")),
        )
    )
    return pairs.select(both.alias("e"), cosine.alias("cosine_score")).select("e.*", "cosine_score")


def copurchase_candidates(
    history: DataFrame,
    cutoff_week: int,
    customers: DataFrame | None,
    edges: DataFrame,
    k: int = SOURCE_K["copurchase"],
    customer_lookback_weeks: int = SEED_WEEKS,
) -> DataFrame:
    """Sum of edge weights over the distinct articles bought lately; bought articles excluded.

    A popular article has many buyers and many edges: the expansion cuts such a seed on both sides."""
    rows = of_customers(before_week(history, cutoff_week), customers)
    bought = rows.groupBy("customer_idx", "article_idx").agg(F.max("week_idx").alias("last_week"))
    seeds = bought.filter(F.col("last_week") >= cutoff_week - customer_lookback_weeks).select(
        "customer_idx", F.col("article_idx").alias("seed_article")
    )
    scores = (
        expansion_join(seeds, edges, ["seed_article"], "customer_idx", "candidate_article")
        .groupBy("customer_idx", F.col("candidate_article").alias("article_idx"))
        # rounded so that equal sums tie in every summation order
        .agg(F.round(F.sum("cosine_score"), 9).alias("score"))
        .join(bought.select("customer_idx", "article_idx"), ["customer_idx", "article_idx"], "left_anti")
    )
    best = top_k(scores, ["customer_idx"], [F.desc("score"), F.asc("article_idx")], k, "source_rank")
    return shape(best, "copurchase")
