"""Evaluation runs built from the metric, resampling and baseline operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import baselines as bl
from shelfwise.operators import metrics as mt
from shelfwise.operators import resampling as rs
from shelfwise.schema import METRIC_K, SEED, Calendar
from shelfwise.session import materialize
from shelfwise.sources.splits import build_fold


def metric_suite(
    model: str,
    preds: DataFrame,
    truth: DataFrame,
    history: DataFrame,
    n_boot: int = 1000,
    seed: int = SEED,
    k: int = METRIC_K,
    ranks: DataFrame | None = None,
) -> DataFrame:
    """One wide row: accuracy, hit rate, coverage, popularity bias, repeat and novelty share with
    intervals. All customer means share one set of resamples."""
    who = truth.select("customer_idx").distinct()
    preds = preds.join(who, "customer_idx", "left_semi")
    users = mt.per_customer_metrics(preds, truth, k)
    extras = mt.per_customer_extras(preds, None, history, ranks)
    table = materialize(users.join(extras, "customer_idx", "left"))
    one = F.lit(1.0)
    reps = rs.replicate_sums(
        table,
        {
            "map": (F.col("ap"), one),
            "hit": (F.when(F.col("has_preds"), F.col("hit")), one),
            "pop": (F.col("pop_bias"), one),
            "repeat": (F.col("repeat_share"), one),
        },
        n_boot,
        seed,
    )
    bounds = reps.agg(
        *[
            F.percentile(v, F.lit(q)).alias(f"{v}_{side}")
            for v in ("map", "hit", "pop", "repeat")
            for side, q in (("lo", 0.025), ("hi", 0.975))
        ]
    ).select(F.struct("*")).scalar()
    cov = rs.bootstrap_coverage(preds, history, n_boot, seed).select(
        F.struct("coverage", F.col("ci_lo").alias("coverage_lo"), F.col("ci_hi").alias("coverage_hi"), F.col("bias").alias("coverage_bias"))
    ).scalar()
    point = table.agg(
        F.count("*").alias("n_eval_customers"),
        *[F.avg(c).alias(n) for n, c in (("map", "ap"), ("ndcg", "ndcg"), ("recall", "recall"), ("precision", "precision"))],
        F.avg(F.when(F.col("has_preds"), F.col("hit"))).alias("hit_rate"),
        *[F.avg(c).alias(c) for c in ("pop_bias", "repeat_share", "novelty_share")],
    )
    return point.select(F.lit(model).alias("model"), "*", bounds.alias("b"), cov.alias("c")).select(
        "model", *point.columns, "b.*", "c.*"
    )


def compare_models(
    lists: dict[str, DataFrame], truth: DataFrame, history: DataFrame, against: str, n_boot: int = 1000, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Holdout report: the metric suite of every model, and each model's paired difference to
    ``against``."""
    ranks = materialize(mt.article_popularity_ranks(history))
    suites = [metric_suite(m, p, truth, history, n_boot, seed, ranks=ranks) for m, p in lists.items()]
    base = mt.per_customer_metrics(lists[against], truth).select("customer_idx", F.col("ap").alias("b"))
    rows = None
    for m, p in lists.items():
        if m == against:
            continue
        part = mt.per_customer_metrics(p, truth).select("customer_idx", F.col("ap").alias("a")).join(base, "customer_idx")
        part = part.withColumn("model", F.lit(m))
        rows = part if rows is None else rows.unionByName(part)
    return reduce(DataFrame.unionByName, suites), rs.paired_difference(rows, "a", "b", n_boot, seed, ["model"])


def rolling_baseline(tx: DataFrame, weeks: list[int], cal: Calendar) -> DataFrame:
    """MAP of last week's best sellers on each fold, every fold seeing only its past."""
    parts = []
    for w in weeks:
        fold = build_fold(tx, w, cal)
        preds = bl.last_week_lists(fold.history, w, fold.eval_customers)
        users = mt.per_customer_metrics(preds, fold.truth)
        parts.append(users.agg(F.lit(w).alias("week_idx"), F.count("*").alias("n_customers"), F.avg("ap").alias("map")))
    return reduce(DataFrame.unionByName, parts)


def customer_repeat_rates(history: DataFrame) -> DataFrame:
    """(customer_idx, n, rate): rows and the share of them bought on a day after the first
    purchase of the same article. Folded per day, so no window over a pair's rows is needed."""
    daily = history.groupBy("customer_idx", "article_idx", "t_dat").agg(F.count("*").alias("n"))
    pairs = daily.groupBy("customer_idx", "article_idx").agg(
        F.sum("n").alias("n"), F.min(F.struct("t_dat", "n")).alias("first")
    )
    return pairs.groupBy("customer_idx").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") - F.col("first.n")) / F.sum("n")).alias("rate")
    )


def rolling_ranker(folds: list[tuple[int, DataFrame, DataFrame]]) -> DataFrame:
    """Train on all earlier folds, score the next: (week_idx, map of the ranker and of the merge
    order, lift in percent). ``folds`` lists (week, features with labels, truth) by week."""
    from shelfwise.operators.ranker import train_linear

    parts = []
    for i in range(1, len(folds)):
        week, x, truth = folds[i]
        seen = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f[1] for f in folds[:i]])
        model = train_linear(seen)
        ranked = mt.predictions_from_scores(model.score(x))
        out = mt.outcome_table(ranked, bl.heuristic_lists(x), truth)
        parts.append(
            out.agg(
                F.lit(week).alias("week_idx"), F.count("*").alias("n_customers"),
                F.avg("ranker_ap").alias("ranker_map"), F.avg("heuristic_ap").alias("heuristic_map"),
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    lift = F.when(F.col("heuristic_map") > 0, (F.col("ranker_map") / F.col("heuristic_map") - 1) * 100)
    return rows.withColumn("lift_pct", lift)
