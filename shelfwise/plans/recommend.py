"""Recommendations for known customers and for hand-made histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import age_bucket
from shelfwise.operators import explain as xp
from shelfwise.operators import features as ft
from shelfwise.operators import metrics as mt
from shelfwise.operators.ranker import LinearRanker
from shelfwise.plans import candidate_run as cr
from shelfwise.schema import METRIC_K, Calendar
from shelfwise.session import materialize, materialize_by
from shelfwise.sources.splits import before_week


def candidate_features(
    history: DataFrame, served_history: DataFrame, who: DataFrame, state: cr.CandidateState, customers: DataFrame, cal: Calendar
) -> DataFrame:
    """Feature rows of the served customers. State tables come from ``history`` alone; the served
    customers' own rows may lie outside it."""
    own = cr.personal_sources(served_history, who, state, history)
    merged = materialize_by(cr.merge_with_shared_lists(own, state.shared, who, state.buckets, state.settings.budget), "customer_idx")
    return ft.assemble(
        merged, history, state.week, state.articles, customers, state.buckets, state.shared, cal, customer_history=served_history,
        article_table=state.article_table, totals=state.popularity_totals, per_bucket=state.bucket_totals,
    )


def recommend(
    history: DataFrame,
    who: DataFrame,
    state: cr.CandidateState,
    customers: DataFrame,
    model: LinearRanker,
    cal: Calendar,
    k: int = METRIC_K,
) -> DataFrame:
    """(customer, article, pos, final_source, reasons): the top k by model score."""
    mine = history.join(who.select("customer_idx"), "customer_idx", "left_semi")
    x = materialize_by(candidate_features(history, mine, who, state, customers, cal), "customer_idx")
    return explained_top(x, model, k)


def explained_top(x: DataFrame, model: LinearRanker, k: int = METRIC_K) -> DataFrame:
    """Written, k rows a customer: whatever session it is given, the lists meet the feature rows where those lie, dealt by customer."""
    top = xp.mark_top(model.score(x), k)
    texts = xp.reason_lists(xp.reasons(xp.contrasts_of(x, model, top, xp.THEMES)))
    return materialize(top.join(x.select(*xp.ROW, "final_source"), xp.ROW).join(texts, xp.ROW, "left"))


def recommend_custom(
    history: DataFrame,
    custom: DataFrame,
    profile_table: DataFrame,
    state: cr.CandidateState,
    customers: DataFrame,
    model: LinearRanker,
    cal: Calendar,
    k: int = METRIC_K,
) -> DataFrame:
    """For hand-made histories: ``custom`` holds transactions of negative customer ids, rows of the
    cutoff week or later are dropped; ``profile_table`` (customer_idx, age, ...) sets the bucket."""
    who = profile_table.select("customer_idx")
    people = customers.unionByName(profile_table, allowMissingColumns=True)
    buckets = people.select("customer_idx", age_bucket(F.col("age")).alias("age_bucket"))
    mine = before_week(custom, state.week)
    local = cr.CandidateState(**{**state.__dict__, "buckets": buckets})
    x = candidate_features(history, mine, who, local, people, cal)
    return explained_top(materialize_by(x, "customer_idx"), model, k)


def recommended_lists(x: DataFrame, model: LinearRanker, k: int = METRIC_K) -> DataFrame:
    return mt.predictions_from_scores(model.score(x), k)
