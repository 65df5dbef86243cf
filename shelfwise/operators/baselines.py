"""Reference lists every ranker is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordering import top_k
from shelfwise.operators import candidates as cand
from shelfwise.operators.merge import merge_candidates
from shelfwise.operators.metrics import PAIR, predictions_from_ranks
from shelfwise.schema import METRIC_K
from shelfwise.sources.splits import before_week


def heuristic_lists(merged: DataFrame, k: int = METRIC_K) -> DataFrame:
    """The merge order itself."""
    return predictions_from_ranks(merged, k)


def last_week_lists(history: DataFrame, cutoff_week: int, customers: DataFrame, k: int = METRIC_K) -> DataFrame:
    """Last week's best sellers for everyone."""
    rows = cand.popularity_last_week(history, cutoff_week, customers, k)
    return predictions_from_ranks(rows, k, "source_rank")


def recent_then_popular(
    history: DataFrame, cutoff_week: int, customers: DataFrame, k: int = METRIC_K, deduplicate: bool = True
) -> DataFrame:
    """Latest purchases first, open places filled with last week's best sellers. Without
    deduplication the raw rows are used, so an article can take several places."""
    if deduplicate:
        own = cand.repurchase(history, cutoff_week, customers, k, ordering="recency_only")
        common = cand.popularity_last_week(history, cutoff_week, customers, k)
        merged = merge_candidates({"repurchase": own, "popularity_last_week": common}, k)
        return predictions_from_ranks(merged, k)
    own = raw_recent_rows(history, cutoff_week, customers, k)
    common = cand.give_to_all(cand.last_week_top(history, cutoff_week, k), customers, "popularity_last_week")
    fill = common.join(own.select(*PAIR).distinct(), PAIR, "left_anti").select(*PAIR, (F.col("source_rank") + k).alias("pos"))
    return top_k(own.unionByName(fill), ["customer_idx"], [F.asc("pos")], k, "place").select(
        *PAIR, F.col("place").alias("pos")
    )


def raw_recent_rows(history: DataFrame, cutoff_week: int, customers: DataFrame | None, k: int = METRIC_K) -> DataFrame:
    rows = cand.of_customers(before_week(history, cutoff_week), customers).select(*PAIR, "t_dat")
    return top_k(rows, ["customer_idx"], [F.desc("t_dat"), F.asc("article_idx")], k, "pos").select(*PAIR, "pos")


def repeats_in_history(history: DataFrame, cutoff_week: int, customers: DataFrame, k: int = METRIC_K) -> DataFrame:
    """How many customers have a repeated article among their k latest rows: overall and among
    ``customers``."""
    per = (
        raw_recent_rows(history, cutoff_week, None, k).groupBy("customer_idx")
        .agg((F.count("*") != F.countDistinct("article_idx")).alias("repeats"))
        .join(customers.select("customer_idx", F.lit(True).alias("asked")), "customer_idx", "left")
    )
    return per.agg(
        F.count("*").alias("n_customers"),
        F.count(F.when(F.col("repeats"), 1)).alias("n_with_repeats"),
        F.count("asked").alias("n_asked"),
        F.count(F.when(F.col("repeats") & F.col("asked"), 1)).alias("n_asked_with_repeats"),
    )
