"""Point-in-time folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.bitmaps import distinct_counts, id_bitmaps
from shelfwise.functions.columns import week_end, week_index, week_start
from shelfwise.schema import Calendar


@dataclass(frozen=True)
class Fold:
    """``history`` ends before ``week``; ``truth`` holds the distinct pairs bought in it."""

    week: int
    history: DataFrame
    truth: DataFrame
    eval_customers: DataFrame


def weeks_between(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Half-open week range [start, stop)."""
    return df.filter((F.col("week_idx") >= start) & (F.col("week_idx") < stop))


def before_week(df: DataFrame, week: int) -> DataFrame:
    return df.filter(F.col("week_idx") < week)


def build_fold(tx: DataFrame, week: int, cal: Calendar, allow_holdout: bool = False) -> Fold:
    if week == cal.holdout_week and not allow_holdout:
        raise ValueError(f"week {week} is the holdout; use build_holdout_fold")
    truth = tx.filter(F.col("week_idx") == week).select("customer_idx", "article_idx").distinct()
    return Fold(week, before_week(tx, week), truth, truth.select("customer_idx").distinct())


def build_holdout_fold(tx: DataFrame, cal: Calendar) -> Fold:
    return build_fold(tx, cal.holdout_week, cal, allow_holdout=True)


def check_no_future_rows(history: DataFrame, cutoff_week: int) -> None:
    """Leakage guard; reads at most one offending row."""
    if history.filter(F.col("week_idx") >= cutoff_week).limit(1).count():
        raise ValueError(f"history holds rows of week {cutoff_week} or later")


def active_customers(tx: DataFrame, week: int) -> DataFrame:
    """Every customer seen before ``week``."""
    return before_week(tx, week).select("customer_idx").distinct()


def last_full_week(tx: DataFrame, cal: Calendar) -> DataFrame:
    """One row: the last day, and the last week whose seven days all lie up to it: that of the day six days before."""
    last = F.max("t_dat")
    return tx.agg(last.alias("last_day"), week_index(F.date_sub(last, 6), cal).alias("last_week"))


def fold_overview(tx: DataFrame, weeks: list[int], cal: Calendar) -> DataFrame:
    """Dates, rows, buyers and history size of each fold week."""
    per_week = tx.groupBy("week_idx").agg(F.count("*").alias("n_transactions"))  # a row a week
    folds = tx.filter(F.col("week_idx").isin(list(weeks)))
    distinct = [
        distinct_counts(id_bitmaps(folds, ["week_idx"], c), ["week_idx"], name).drop("n_rows")
        for c, name in (("customer_idx", "n_customers"), ("article_idx", "n_articles"))
    ]
    hist = [F.sum(F.when(F.col("week_idx") < w, F.col("n_transactions")).otherwise(0)).alias(f"h{w}") for w in weeks]
    sizes = per_week.agg(*hist).select(
        F.explode(F.array(*[F.struct(F.lit(w).alias("week_idx"), F.col(f"h{w}").alias("n_history")) for w in weeks]))
    ).select("col.*")
    return (
        per_week.filter(F.col("week_idx").isin(list(weeks)))
        .join(distinct[0], "week_idx")
        .join(distinct[1], "week_idx")
        .join(sizes, "week_idx")
        .select(
            "week_idx",
            week_start(F.col("week_idx"), cal).alias("start_date"),
            week_end(F.col("week_idx"), cal).alias("end_date"),
            "n_transactions", "n_customers", "n_articles", "n_history",
        )
    )
