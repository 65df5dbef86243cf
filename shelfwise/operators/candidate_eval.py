"""Quality of candidate sets against the truth of a fold."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import purchase_segment, safe_ratio
from shelfwise.operators.merge import merge_candidates
from shelfwise.operators.metrics import PAIR
from shelfwise.schema import MERGE_BUDGET, RECALL_CUTS, SOURCES


def _hits(cuts, rank: str = "final_rank"):
    return [F.count(F.when(F.col(rank) <= c, 1)).alias(f"h{c}") for c in cuts]


def _recalls(cuts, total: str = "n_truth"):
    return [safe_ratio(F.col(f"h{c}"), F.col(total)).alias(f"recall_{c}") for c in cuts]


def candidate_recall(merged: DataFrame, truth: DataFrame, cuts=RECALL_CUTS) -> DataFrame:
    """Recall at all cuts, share of customers served and mean list size, in one aggregate."""
    lists = merged.groupBy("customer_idx").agg(F.count("*").alias("size"))
    users = truth.select("customer_idx").distinct().join(lists, "customer_idx", "left")
    served = users.agg(
        F.count("*").alias("n_eval_customers"),
        (F.count("size") / F.count("*")).alias("coverage"),
        F.avg("size").alias("mean_candidates"),
    )
    found = truth.join(merged.select(*PAIR, "final_rank"), PAIR, "left").agg(
        F.count("*").alias("n_truth"), *_hits(cuts)
    )
    row = found.select(F.struct("*").alias("f"))
    return served.select("*", row.scalar().alias("f")).select(
        "n_eval_customers", "coverage", "mean_candidates", "f.*"
    ).select("n_eval_customers", "coverage", "mean_candidates", *_recalls(cuts))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [df.select(*PAIR, F.lit(s).alias("source"), F.col("source_rank").cast("int")) for s, df in sources.items()],
    )


def recall_by_source(sources: dict[str, DataFrame], truth: DataFrame, cuts=RECALL_CUTS) -> DataFrame:
    """Each source alone: coverage and recall, all sources in one pass."""
    rows = union_sources(sources)
    totals = truth.agg(
        F.count("*").alias("n_truth"), F.countDistinct("customer_idx").alias("n_eval")
    ).select(F.struct("*")).scalar()
    covered = (
        rows.join(truth.select("customer_idx").distinct(), "customer_idx", "left_semi")
        .groupBy("source", "customer_idx").agg(F.lit(1).alias("one"))
        .groupBy("source").agg(F.count("*").alias("n_covered"))
    )
    found = rows.join(truth, PAIR, "left_semi").groupBy("source").agg(*_hits(cuts, "source_rank"))
    return (
        covered.join(found, "source", "left")
        .na.fill(0)
        .withColumn("t", totals)
        .select("*", "t.*")
        .select("source", safe_ratio(F.col("n_covered"), F.col("n_eval")).alias("coverage"), *_recalls(cuts))
    )


def incremental_recall(
    sources: dict[str, DataFrame], truth: DataFrame, n: int = MERGE_BUDGET, cuts=RECALL_CUTS, priority=SOURCES
) -> DataFrame:
    """Recall as the sources are added by priority, and the gain of each step.

    Sources of lower priority only append to a list, so one merge of all serves every step: a
    step has the rows whose best source was added by then, at the ranks they have in the end.
    """
    total = truth.agg(F.count("*").alias("n")).scalar()
    names = [s for s in priority if s in sources]
    merged = merge_candidates(dict(sources), n, list(priority)).join(truth, PAIR, "left_semi")
    order = F.array_position(F.array(*map(F.lit, names)), F.col("final_source"))
    marked = merged.select("final_rank", order.alias("prio"))
    counts = marked.agg(
        *[F.count_if((F.col("prio") <= i + 1) & (F.col("final_rank") <= c)).alias(f"h{c}_{i}") for i in range(len(names)) for c in cuts]
    )
    steps = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("source_added"), *[F.col(f"h{c}_{i}").alias(f"h{c}") for c in cuts])
            for i, s in enumerate(names)
        ]
    )
    rows = counts.select(F.inline(steps)).withColumn("n_truth", total)
    from pyspark.sql import Window as W

    w = W.orderBy("step")  # one row per source
    out = rows.select("step", "source_added", *_recalls(cuts))
    for c in cuts:
        out = out.withColumn(f"gain_{c}", F.col(f"recall_{c}") - F.coalesce(F.lag(f"recall_{c}").over(w), F.lit(0.0)))
    return out


def source_overlap(sources: dict[str, DataFrame], max_rank: int = 200) -> DataFrame:
    """Jaccard of each pair of sources over their (customer, article) pairs.

    One aggregate marks which sources hold a pair; the pairs are then counted per combination
    of sources, so the 15 comparisons run on at most 63 rows."""
    names = list(sources)
    rows = union_sources(sources).filter(F.col("source_rank") <= max_rank)
    marks = [F.max(F.when(F.col("source") == s, 1).otherwise(0)).alias(f"m_{s}") for s in names]
    combos = rows.groupBy(*PAIR).agg(*marks).groupBy(*[f"m_{s}" for s in names]).agg(F.count("*").alias("n"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("source_a"),
                F.lit(b).alias("source_b"),
                (F.col(f"m_{a}") * F.col(f"m_{b}")).alias("both"),
                F.greatest(f"m_{a}", f"m_{b}").alias("either"),
            )
            for a, b in combinations(names, 2)
        ]
    )
    agg = (
        combos.select("n", F.explode(pairs).alias("p"))
        .groupBy("p.source_a", "p.source_b")
        .agg(
            F.sum(F.col("n") * F.col("p.both")).alias("n_both"),
            F.sum(F.col("n") * F.col("p.either")).alias("n_either"),
        )
    )
    return agg.select(
        "source_a", "source_b", "n_both", "n_either",
        F.coalesce(safe_ratio(F.col("n_both"), F.col("n_either")), F.lit(0.0)).alias("jaccard"),
    )


def purchase_segments(history: DataFrame, customers: DataFrame) -> DataFrame:
    """(customer_idx, prior_count, segment) for the given customers, 0 without history."""
    counts = (
        history.join(customers, "customer_idx", "left_semi")
        .groupBy("customer_idx").agg(F.count("*").alias("prior_count"))
    )
    return (
        customers.select("customer_idx").join(counts, "customer_idx", "left")
        .withColumn("prior_count", F.coalesce("prior_count", F.lit(0)))
        .withColumn("segment", purchase_segment(F.col("prior_count")))
    )


def recall_by_segment(merged: DataFrame, truth: DataFrame, segments: DataFrame, cuts=RECALL_CUTS) -> DataFrame:
    """Recall per segment; null where a segment has no truth."""
    sizes = segments.groupBy("segment").agg(F.count("*").alias("n_customers"))
    found = (
        truth.join(merged.select(*PAIR, "final_rank"), PAIR, "left")
        .join(segments.select("customer_idx", "segment"), "customer_idx")
        .groupBy("segment").agg(F.count("*").alias("n_truth"), *_hits(cuts))
    )
    return sizes.join(found, "segment", "left").select("segment", "n_customers", *_recalls(cuts))


def oracle_bound(merged: DataFrame, truth: DataFrame, k: int = 12) -> DataFrame:
    """MAP of a perfect order within the candidates, and the share of candidates that were bought."""
    mine = merged.join(truth.select("customer_idx").distinct(), "customer_idx", "left_semi").select(
        *PAIR, F.lit(1).alias("listed"), F.lit(0).alias("bought")
    )
    both = (
        mine.unionByName(truth.select(*PAIR, F.lit(0).alias("listed"), F.lit(1).alias("bought")))
        .groupBy(*PAIR).agg(F.max("listed").alias("listed"), F.max("bought").alias("bought"))
        .groupBy("customer_idx")
        .agg(
            F.sum("bought").alias("n_truth"),
            F.sum("listed").alias("n_candidates"),
            F.sum(F.col("listed") * F.col("bought")).alias("n_hits"),
        )
    )
    return both.agg(
        F.avg(F.least("n_hits", F.lit(k)) / F.least("n_truth", F.lit(k))).alias("oracle_map"),
        F.avg(F.coalesce(safe_ratio(F.col("n_hits"), F.col("n_candidates")), F.lit(0.0))).alias("candidate_precision"),
        F.sum("n_hits").alias("total_hits"),
        F.sum("n_candidates").alias("total_candidates"),
        F.count("*").alias("n_customers"),
    )


def compare_orders(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """Two top lists per customer: lists that differ, sets that differ, and sets whose
    difference touches the truth."""
    rows = (
        a.select(*PAIR, F.col("pos").alias("pa"), F.lit(None).cast("int").alias("pb"), F.lit(0).alias("t"))
        .unionByName(b.select(*PAIR, F.lit(None).cast("int").alias("pa"), F.col("pos").alias("pb"), F.lit(0).alias("t")))
        .unionByName(truth.select(*PAIR, F.lit(None).cast("int").alias("pa"), F.lit(None).cast("int").alias("pb"), F.lit(1).alias("t")))
        .groupBy(*PAIR).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("t").alias("t"))
    )
    only_one = F.col("pa").isNull() != F.col("pb").isNull()
    users = rows.groupBy("customer_idx").agg(
        F.max(~F.col("pa").eqNullSafe(F.col("pb"))).alias("order_differs"),
        F.max(only_one).alias("set_differs"),
        F.max(only_one & (F.col("t") == 1)).alias("difference_hits"),
        F.max(F.col("pa").isNotNull() | F.col("pb").isNotNull()).alias("has_list"),
    )
    return users.filter("has_list").agg(
        F.count("*").alias("n_customers"),
        F.count(F.when(F.col("order_differs"), 1)).alias("n_order_differs"),
        F.count(F.when(F.col("set_differs"), 1)).alias("n_set_differs"),
        F.count(F.when(F.col("difference_hits"), 1)).alias("n_difference_hits"),
    )
