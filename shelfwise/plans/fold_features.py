"""From a transactions table to the feature matrix of a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfwise.operators import features as ft
from shelfwise.plans import candidate_run as cr
from shelfwise.schema import SEED, Calendar
from shelfwise.session import materialize_by
from shelfwise.sources.splits import Fold, build_fold, check_no_future_rows


def fold_frame(
    fold: Fold,
    cal: Calendar,
    articles: DataFrame,
    customers: DataFrame,
    settings: cr.RunSettings | None = None,
    serve: DataFrame | None = None,
    state: cr.CandidateState | None = None,
    merged: DataFrame | None = None,
) -> DataFrame:
    """Untyped candidate rows with features and labels; ``serve`` defaults to the fold's buyers, ``state`` and ``merged``
    to those that are built here.

    The merged candidates are written once, since the article, customer and
    interaction branches all start from them.
    """
    check_no_future_rows(fold.history, fold.week)
    state = state or cr.build_state(fold.history, fold.week, cal, articles, customers, settings)
    who = fold.eval_customers if serve is None else serve
    merged = materialize_by(cr.generate(fold.history, who, state), "customer_idx") if merged is None else merged
    x = ft.assemble(
        merged, fold.history, fold.week, articles, customers, state.buckets, state.shared, cal, article_table=state.article_table,
        totals=state.popularity_totals, per_bucket=state.bucket_totals, partials=state.partials,
    )
    return ft.add_labels(x, fold.truth)


def build_fold_features(
    tx: DataFrame,
    week: int,
    cal: Calendar,
    articles: DataFrame,
    customers: DataFrame,
    settings: cr.RunSettings | None = None,
    negative_rate: float = 1.0,
    seed: int = SEED,
    allow_holdout: bool = False,
    state: cr.CandidateState | None = None,
) -> DataFrame:
    """Typed feature matrix of one fold; below rate 1 the negatives are downsampled. ``state``: one of that
    week, which may be rolled from the week before."""
    fold = build_fold(tx, week, cal, allow_holdout)
    x = fold_frame(fold, cal, articles, customers, settings, state=state)
    if negative_rate < 1.0:
        x = ft.downsample_negatives(x, negative_rate, seed)
    return ft.enforce_types(x)
