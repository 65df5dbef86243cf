"""List metrics on long predictions (customer_idx, article_idx, pos from 1) and truth pairs."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import safe_ratio
from shelfwise.functions.skew import left_join_hot
from shelfwise.functions.ordering import running_rank, top_k
from shelfwise.schema import METRIC_K

PAIR = ["customer_idx", "article_idx"]


BEST_SELLERS = 500  # articles whose ranks are broadcast

def predictions_from_ranks(merged: DataFrame, k: int = METRIC_K, rank: str = "final_rank") -> DataFrame:
    return merged.filter(F.col(rank) <= k).select(*PAIR, F.col(rank).cast("int").alias("pos"))


def predictions_from_scores(scored: DataFrame, k: int = METRIC_K, score: str = "score") -> DataFrame:
    """Top k per customer by score, lowest article id first among equals."""
    best = top_k(scored.select(*PAIR, score), ["customer_idx"], [F.desc(score), F.asc("article_idx")], k, "pos")
    return best.select(*PAIR, "pos")


def _ideal_dcg(n: Column, k: int) -> Column:
    sums, total = [], 0.0
    for i in range(k):
        total += 1.0 / log2(i + 2)
        sums.append(F.lit(total))
    return F.get(F.array(*sums), F.least(n, F.lit(k)).cast("int") - 1)


def per_customer_metrics(preds: DataFrame, truth: DataFrame, k: int = METRIC_K) -> DataFrame:
    """One row per truth customer: n_truth, n_hits, ap, ndcg, recall, precision, hit, has_preds.

    A repeated article scores once in ap and recall, but every time in ndcg and precision.
    Customers without predictions score 0 and carry ``has_preds`` false.
    """
    top = preds.filter(F.col("pos") <= k)
    # predictions and truth meet in one aggregate per pair: one shuffle, no join
    tagged = top.select(*PAIR, "pos", F.lit(0).alias("bought")).unionByName(
        truth.select(*PAIR, F.lit(None).cast("int").alias("pos"), F.lit(1).alias("bought"))
    )
    pairs = tagged.groupBy(*PAIR).agg(
        F.max("bought").alias("bought"),
        F.min("pos").alias("first_pos"),
        F.count("pos").alias("times"),
        F.sum(1.0 / F.log2(F.col("pos") + 1.0)).alias("gain"),
    )
    is_hit = (F.col("bought") == 1) & F.col("first_pos").isNotNull()
    users = pairs.groupBy("customer_idx").agg(
        F.sum("bought").alias("n_truth"),
        F.count(F.when(is_hit, 1)).alias("n_hits"),
        # at most k positions per customer
        F.sort_array(F.collect_list(F.when(is_hit, F.col("first_pos")))).alias("at"),
        F.sum(F.when(is_hit, F.col("gain"))).alias("dcg"),
        F.sum(F.when(is_hit, F.col("times"))).alias("n_all_hits"),
        F.max(F.col("first_pos").isNotNull()).alias("has_preds"),
    ).filter(F.col("n_truth") > 0)
    ap_sum = F.aggregate(
        F.transform(F.col("at"), lambda p, i: (i + 1) / p.cast("double")), F.lit(0.0), lambda a, x: a + x
    )
    return users.select(
        "customer_idx",
        "n_truth",
        "n_hits",
        (ap_sum / F.least("n_truth", F.lit(k))).alias("ap"),
        (F.coalesce("dcg", F.lit(0.0)) / _ideal_dcg(F.col("n_truth"), k)).alias("ndcg"),
        (F.col("n_hits") / F.col("n_truth")).alias("recall"),
        (F.coalesce("n_all_hits", F.lit(0)) / F.lit(float(k))).alias("precision"),
        F.when(F.col("n_hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        "has_preds",
    )


def summarize_metrics(users: DataFrame, missing: str = "drop") -> DataFrame:
    """One row of means over the truth customers. ``missing='drop'`` leaves customers without
    predictions out of the hit rate, ``'zero'`` counts them as misses."""
    hit = F.avg(F.when(F.col("has_preds"), F.col("hit"))) if missing == "drop" else F.avg("hit")
    return users.agg(
        F.count("*").alias("n_customers"),
        F.avg("ap").alias("map"),
        F.avg("ndcg").alias("ndcg"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        hit.alias("hit_rate"),
        safe_ratio(F.sum("n_hits"), F.sum("n_truth")).alias("micro_recall"),
    )


def recall_at_cuts(preds: DataFrame, truth: DataFrame, cuts) -> DataFrame:
    """Micro recall and mean per-customer recall at several cuts, in one pass."""
    best = preds.groupBy(*PAIR).agg(F.min("pos").alias("pos"))
    joined = truth.join(best, PAIR, "left")
    users = joined.groupBy("customer_idx").agg(
        F.count("*").alias("n"), *[F.count(F.when(F.col("pos") <= c, 1)).alias(f"h{c}") for c in cuts]
    )
    return users.agg(
        *[safe_ratio(F.sum(f"h{c}"), F.sum("n")).alias(f"micro_recall_{c}") for c in cuts],
        *[F.avg(F.col(f"h{c}") / F.col("n")).alias(f"mean_recall_{c}") for c in cuts],
    )


# --- beyond accuracy -----------------------------------------------------------


def article_popularity_ranks(history: DataFrame) -> DataFrame:
    """(article_idx, units, pop_rank), 1 = most sold."""
    units = history.groupBy("article_idx").agg(F.count("*").alias("units"))
    return running_rank(units, [], [F.desc("units"), F.asc("article_idx")], "pop_rank")


def catalog_coverage(preds: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct recommended over distinct sold articles."""
    sold = history.select("article_idx").distinct().agg(F.count("*").alias("n_sold")).scalar()
    return (
        preds.select("article_idx")
        .distinct()
        .agg(F.count("*").alias("n_recommended"))
        .select("n_recommended", sold.alias("n_sold"))
        .withColumn("coverage", F.coalesce(safe_ratio(F.col("n_recommended"), F.col("n_sold")), F.lit(0.0)))
    )


def per_customer_extras(
    preds: DataFrame, truth_customers: DataFrame | None, history: DataFrame, ranks: DataFrame | None = None
) -> DataFrame:
    """Per customer with predictions: pop_bias (mean popularity rank), repeat_share (bought
    before), novelty_share (never sold before). Articles without sales have no rank."""
    if truth_customers is not None:
        preds = preds.join(truth_customers, "customer_idx", "left_semi")
    ranks = article_popularity_ranks(history) if ranks is None else ranks
    # only the listed customers' history is folded; the best sellers, which fill most lists, are joined by broadcast
    listed = history.join(preds.select("customer_idx").distinct(), "customer_idx", "left_semi")
    bought = listed.select(*PAIR).distinct().withColumn("bought", F.lit(True))
    ranks = ranks.select("article_idx", "pop_rank")
    return (
        left_join_hot(preds, ranks, "article_idx", ranks.filter(F.col("pop_rank") <= BEST_SELLERS), "customer_idx")
        .join(bought, PAIR, "left")
        .groupBy("customer_idx")
        .agg(
            F.avg("pop_rank").alias("pop_bias"),
            F.avg(F.when(F.col("bought"), 1.0).otherwise(0.0)).alias("repeat_share"),
            F.avg(F.when(F.col("pop_rank").isNull(), 1.0).otherwise(0.0)).alias("novelty_share"),
        )
    )


def overlap_with_truth(preds: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Recommended and actually bought articles per customer and model."""
    out = None
    for model, df in preds.items():
        part = (
            df.select(*PAIR).distinct().join(truth, PAIR, "left_semi")
            .groupBy("customer_idx").agg(F.count("*").alias("n_bought"))
            .select(F.lit(model).alias("model"), "customer_idx", "n_bought")
        )
        out = part if out is None else out.unionByName(part)
    return out


def outcome_table(ranker: DataFrame, heuristic: DataFrame, truth: DataFrame, k: int = METRIC_K) -> DataFrame:
    """Per truth customer: ap and hit of both models; the input of every test."""
    r = per_customer_metrics(ranker, truth, k)
    h = per_customer_metrics(heuristic, truth, k)
    return r.select("customer_idx", F.col("ap").alias("ranker_ap"), F.col("hit").alias("ranker_hit")).join(
        h.select("customer_idx", F.col("ap").alias("heuristic_ap"), F.col("hit").alias("heuristic_hit")),
        "customer_idx",
    )
