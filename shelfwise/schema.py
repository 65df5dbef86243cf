"""Types, parameters and the feature registry."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import types as T

# --- fixed values: time axes and parameter defaults -------------------------


@dataclass(frozen=True)
class Calendar:
    """Week axis: week 0 starts on ``anchor`` (a Wednesday) and lasts seven days."""

    anchor: date
    holdout_week: int
    validation_weeks: tuple[int, ...]

    @property
    def anchor_day(self) -> int:
        return (self.anchor - date(1970, 1, 1)).days

    def week_of(self, day: date) -> int:
        return (day - self.anchor).days // 7

    def week_bounds(self, week: int) -> tuple[date, date]:
        start = self.anchor + timedelta(days=7 * week)
        return start, start + timedelta(days=6)

    def cutoff_day(self, week: int) -> int:
        """Epoch day on which ``week`` starts."""
        return self.anchor_day + 7 * week


RETAIL_CALENDAR = Calendar(date(2018, 9, 19), 104, (100, 101, 102, 103))

SOURCES = (
    "repurchase",
    "product_code",
    "copurchase",
    "popularity_last_week",
    "popularity_decayed",
    "segment_popular",
)
PERSONAL_SOURCES = SOURCES[:3]
SHARED_SOURCES = SOURCES[3:]
SOURCE_K = {
    "repurchase": 50,
    "product_code": 50,
    "copurchase": 50,
    "popularity_last_week": 200,
    "popularity_decayed": 100,
    "segment_popular": 50,
}
MERGE_BUDGET = 200
METRIC_K = 12
RECALL_CUTS = (20, 50, 100, 200)
PRODUCT_CODE_WEEKS = 12
DECAY_WEEKS = 4
SEGMENT_WEEKS = 2
BASKET_WEEKS = 8
SEED_WEEKS = 4
MIN_PAIR_COUNT = 3
NEGATIVE_RATE = 0.2
SEED = 42
AGE_BUCKETS = ("<25", "25-34", "35-44", "45-54", "55+", "missing")
PURCHASE_SEGMENTS = ("0", "1-4", "5-19", "20+")

# --- table schemas -----------------------------------------------------------

TRANSACTIONS = T.StructType(
    [
        T.StructField("t_dat", T.DateType(), False),
        T.StructField("customer_idx", T.LongType(), False),
        T.StructField("article_idx", T.LongType(), False),
        T.StructField("price", T.FloatType(), True),
        T.StructField("sales_channel_id", T.ByteType(), True),
    ]
)

CANDIDATES = T.StructType(
    [
        T.StructField("customer_idx", T.LongType(), True),
        T.StructField("article_idx", T.LongType(), True),
        T.StructField("source", T.StringType(), False),
        T.StructField("score", T.FloatType(), True),
        T.StructField("source_rank", T.ShortType(), True),
    ]
)


def merged_columns(sources=SOURCES) -> list[str]:
    cols = ["customer_idx", "article_idx", "final_source", "final_rank"]
    for s in sources:
        cols += [f"{s}_score", f"{s}_rank"]
    return cols


@dataclass(frozen=True)
class Feature:
    name: str
    type: T.DataType
    group: str


_INT, _SHORT, _BYTE, _FLOAT = T.IntegerType(), T.ShortType(), T.ByteType(), T.FloatType()


def _source_features(source: str) -> list[Feature]:
    out = [
        Feature(f"in_{source}", _BYTE, "candidate"),
        Feature(f"{source}_rank", _SHORT, "candidate"),
        Feature(f"{source}_score", _FLOAT, "candidate"),
    ]
    if source in SHARED_SOURCES:
        out.append(Feature(f"{source}_share", _FLOAT, "candidate"))
    return out


def _group(group: str, **names: T.DataType) -> list[Feature]:
    return [Feature(n, t, group) for n, t in names.items()]


# fixed values: names, order and groups of the features
FEATURES: list[Feature] = (
    [Feature("final_rank", _INT, "candidate"), Feature("n_sources", _BYTE, "candidate")]
    + [f for s in SOURCES for f in _source_features(s)]
    + _group(
        "customer",
        c_n_purchases=_INT, c_n_purchases_1w=_INT, c_n_purchases_4w=_INT, c_n_purchases_12w=_INT,
        c_n_unique_articles=_INT, c_days_since_last_purchase=_FLOAT, c_n_active_weeks=_INT,
        c_avg_basket_size=_FLOAT, c_mean_price=_FLOAT, c_std_price=_FLOAT, c_online_share=_FLOAT,
        c_age=_FLOAT, c_club_member_status=_BYTE, c_fashion_news_frequency=_BYTE, c_FN=_BYTE, c_Active=_BYTE,
    )
    + _group(
        "article",
        a_sales_1w=_INT, a_sales_2w=_INT, a_sales_4w=_INT, a_unique_buyers_1w=_INT, a_trend_ratio=_FLOAT,
        a_days_since_first_sale=_FLOAT, a_censored_flag=_BYTE, a_days_since_last_sale=_FLOAT,
        a_mean_price_4w=_FLOAT, a_price_vs_own_history=_FLOAT, a_repurchase_rate=_FLOAT,
        a_mean_buyer_age_12w=_FLOAT, a_std_buyer_age_12w=_FLOAT, a_product_type_no=_INT,
        # codes by rank: integers, so that no number of categories overflows them
        a_product_group_name=_INT, a_index_group_name=_INT, a_garment_group_name=_INT,
        a_colour_group_name=_INT, a_section_name=_INT, a_department_no=_INT,
    )
    + _group(
        "interaction",
        i_times_bought=_INT, i_days_since_bought_article=_FLOAT, i_bought_same_product_code=_INT,
        i_days_since_bought_product_code=_FLOAT, i_customer_share_product_group=_FLOAT,
        i_customer_share_garment_group=_FLOAT, i_age_gap=_FLOAT, i_price_ratio=_FLOAT, i_channel_gap=_FLOAT,
    )
)
FEATURE_NAMES = [f.name for f in FEATURES]
FEATURE_GROUPS = ("candidate", "customer", "article", "interaction")


def feature_columns(group: str) -> list[str]:
    return [f.name for f in FEATURES if f.group == group]
