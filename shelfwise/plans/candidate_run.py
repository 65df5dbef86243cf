"""All sources for a set of customers, merged."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import age_bucket
from shelfwise.operators import candidates as cand
from shelfwise.operators import copurchase as cop
from shelfwise.operators import features as ft
from shelfwise.operators.merge import merge_with_shared_lists, shared_lists
from shelfwise.operators.partials import Partials, of_history, rolled
from shelfwise.schema import (
    AGE_BUCKETS,
    BASKET_WEEKS,
    MERGE_BUDGET,
    MIN_PAIR_COUNT,
    PRODUCT_CODE_WEEKS,
    SEED_WEEKS,
    SOURCE_K,
    Calendar,
)
from shelfwise.session import materialize


@dataclass(frozen=True)
class RunSettings:
    """Windows and limits of a candidate run."""

    k: dict = field(default_factory=lambda: dict(SOURCE_K))
    budget: int = MERGE_BUDGET
    min_pair_count: int = MIN_PAIR_COUNT
    basket_weeks: int = BASKET_WEEKS
    seed_weeks: int = SEED_WEEKS
    code_weeks: int = PRODUCT_CODE_WEEKS
    unknown_bucket: str | None = None


@dataclass(frozen=True)
class CandidateState:
    """Customer-independent tables of one cutoff week."""

    week: int
    cal: Calendar
    articles: DataFrame
    buckets: DataFrame
    edges: DataFrame
    last_week: DataFrame
    decayed: DataFrame
    segments: DataFrame
    shared: DataFrame
    settings: RunSettings
    article_table: DataFrame  # features of all articles
    popularity_totals: DataFrame  # one row
    bucket_totals: DataFrame  # one row per age bucket
    partials: Partials  # what the features need of the sales

    def tables(self) -> dict[str, DataFrame]:
        return {
            "copurchase_edges": self.edges,
            "popularity_last_week": self.last_week,
            "popularity_decayed": self.decayed,
            "segment_popular": self.segments,
            "article_features": self.article_table,
            "popularity_totals": self.popularity_totals,
            "bucket_totals": self.bucket_totals,
            "customer_weeks": self.partials.by_customer,
            "article_weeks": self.partials.by_article,
            "pair_days": self.partials.pairs,
        }


def build_state(
    history: DataFrame,
    week: int,
    cal: Calendar,
    articles: DataFrame,
    customers: DataFrame,
    settings: RunSettings | None = None,
    last: Partials | None = None,
    later: Partials | None = None,
) -> CandidateState:
    """``last``: the partials of the week before; then the features read one week of ``history`` only. ``later``: those of a
    later week, from which the folds before it take theirs, so that they are exchanged and written once for all folds."""
    s = settings or RunSettings()
    if last is not None and last.week != week - 1:
        raise ValueError(f"partials of week {last.week} do not lead to week {week}")
    if later is not None:
        partials = later.before(week, history)
    else:
        partials = (of_history(history, week, customers) if last is None else rolled(last, history, customers)).saved()
    buckets = customers.select("customer_idx", age_bucket(F.col("age")).alias("age_bucket"))
    last_week = cand.last_week_top(history, week, s.k["popularity_last_week"])
    decayed = cand.decayed_top(history, week, cal, s.k["popularity_decayed"])
    segments = cand.segment_top(history, week, buckets, s.k["segment_popular"])
    return CandidateState(
        week=week,
        cal=cal,
        articles=articles,
        buckets=buckets,
        # state tables are written once per cutoff and read by every branch
        edges=materialize(cop.copurchase_edges(history, week, s.basket_weeks, s.min_pair_count)),
        last_week=last_week,
        decayed=decayed,
        segments=segments,
        shared=materialize(shared_lists(last_week, decayed, segments, list(AGE_BUCKETS))),
        settings=s,
        article_table=materialize(ft.article_features_of(partials.by_article, partials.pairs, week, articles, cal)),
        popularity_totals=materialize(ft.popularity_totals(history, week, cal)),
        bucket_totals=materialize(ft.bucket_totals(history, week, buckets)),
        partials=partials,
    )


def personal_sources(
    history: DataFrame, customers: DataFrame | None, state: CandidateState, sales_history: DataFrame | None = None
) -> dict[str, DataFrame]:
    """``sales_history`` gives the last week's sales when ``history`` holds only the served rows."""
    s, w = state.settings, state.week
    return {
        "repurchase": cand.repurchase(history, w, customers, s.k["repurchase"]),
        "product_code": cand.product_code_siblings(
            history, w, customers, state.articles, s.k["product_code"], s.code_weeks, sales_history
        ),
        "copurchase": cop.copurchase_candidates(
            history, w, customers, state.edges, s.k["copurchase"], s.seed_weeks
        ),
    }


def all_sources(history: DataFrame, customers: DataFrame, state: CandidateState) -> dict[str, DataFrame]:
    """The six source frames, expanded, for evaluation of single sources."""
    out = personal_sources(history, customers, state)
    out["popularity_last_week"] = cand.give_to_all(state.last_week, customers, "popularity_last_week")
    out["popularity_decayed"] = cand.give_to_all(state.decayed, customers, "popularity_decayed")
    lists = state.segments.groupBy("age_bucket").agg(
        F.sort_array(F.collect_list(F.struct("source_rank", "article_idx", "score"))).alias("items")
    )
    given = customers.join(state.buckets, "customer_idx").join(F.broadcast(lists), "age_bucket")
    out["segment_popular"] = cand.shape(given.select("customer_idx", F.inline("items")), "segment_popular")
    return out


def generate(history: DataFrame, customers: DataFrame | None, state: CandidateState) -> DataFrame:
    """Merged candidates. ``customers=None`` serves everyone in ``history``; then customers
    without a dimension row count as the bucket ``settings.unknown_bucket`` if that is set."""
    own = personal_sources(history, customers, state)
    who = history.select("customer_idx").distinct() if customers is None else customers.select("customer_idx")
    buckets = state.buckets
    if state.settings.unknown_bucket is not None:
        buckets = who.join(buckets, "customer_idx", "left").select(
            "customer_idx", F.coalesce("age_bucket", F.lit(state.settings.unknown_bucket)).alias("age_bucket")
        )
    return merge_with_shared_lists(own, state.shared, who, buckets, state.settings.budget)


def generate_for_everyone(history: DataFrame, state: CandidateState) -> DataFrame:
    """Every customer seen before the week, in one job."""
    return generate(history, None, state)
