"""Additive explanations of the linear ranker and reason sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.columns import hash_uniform, safe_ratio, two_sided_p
from shelfwise.functions.ordering import top_k
from shelfwise.operators.ranker import LinearRanker
from shelfwise.schema import FEATURES, METRIC_K, SEED

ROW = ["customer_idx", "article_idx"]
GROUP_OF = {f.name: f.group for f in FEATURES}


def contributions(x: DataFrame, model: LinearRanker) -> DataFrame:
    """(customer, article, feature, value, contribution): the contributions of a row sum to its
    score."""
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("value"),
                (model.contribution(i) + F.lit(0.0)).alias("contribution"),
            )
            for i, f in enumerate(model.features)
        ]
    )
    return x.select(*ROW, F.explode(parts).alias("p")).select(*ROW, "p.*")


def with_contrast(long: DataFrame) -> DataFrame:
    """Add ``contrast``: the contribution minus its mean over the customer's list. The window group
    is one list, at most the merge budget of rows."""
    w = W.partitionBy("customer_idx", "feature")
    return long.withColumn("contrast", F.col("contribution") - F.avg("contribution").over(w))


def wide_contrasts(x: DataFrame, model: LinearRanker, features=None) -> DataFrame:
    """One row per (customer, article): of each feature i its value, contribution and contrast as ``v{i}``, ``c{i}``, ``d{i}``.

    The same numbers as of :func:`contributions` and :func:`with_contrast`, but a row stays one row: the window exchanges
    each once (none if ``x`` is dealt by customer) instead of once for each feature.
    """
    chosen = _chosen(model, features)
    wide = x.select(
        *ROW,
        *[F.col(f).cast("double").alias(f"v{i}") for i, f in chosen],
        *[(model.contribution(i) + F.lit(0.0)).alias(f"c{i}") for i, _ in chosen],
    )
    w = W.partitionBy("customer_idx")
    return wide.select("*", *[(F.col(f"c{i}") - F.avg(f"c{i}").over(w)).alias(f"d{i}") for i, _ in chosen])


def _chosen(model: LinearRanker, features=None) -> list[tuple[int, str]]:
    return [(i, f) for i, f in enumerate(model.features) if features is None or f in features]


def as_long(wide: DataFrame, model: LinearRanker, features=None) -> DataFrame:
    """(customer, article, feature, value, contribution, contrast) of :func:`wide_contrasts`."""
    parts = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"v{i}").alias("value"), F.col(f"c{i}").alias("contribution"),
            F.col(f"d{i}").alias("contrast"),
        )
        for i, f in _chosen(model, features)
    ]
    return wide.select(*ROW, F.inline(F.array(*parts)))


def contrasts_of(x: DataFrame, model: LinearRanker, rows: DataFrame, features=None) -> DataFrame:
    """Contributions and contrasts, as of :func:`with_contrast`, of the given (customer, article) rows.

    The means over each list are one aggregate of the wide rows; only the given rows, and only the
    ``features`` asked for, become long.
    """
    chosen = [(i, f) for i, f in enumerate(model.features) if features is None or f in features]
    wide = x.select(
        *ROW,
        *[F.col(f).cast("double").alias(f"v{i}") for i, f in chosen],
        *[(model.contribution(i) + F.lit(0.0)).alias(f"c{i}") for i, _ in chosen],
    )
    means = wide.groupBy("customer_idx").agg(*[F.avg(f"c{i}").alias(f"m{i}") for i, _ in chosen])
    picked = wide.join(rows.select(*ROW), ROW, "left_semi").join(means, "customer_idx")
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f"v{i}").alias("value"), F.col(f"c{i}").alias("contribution"),
                (F.col(f"c{i}") - F.col(f"m{i}")).alias("contrast"),
            )
            for i, f in chosen
        ]
    )
    return picked.select(*ROW, F.inline(parts))


def additivity(long: DataFrame, scored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose contributions do not sum to the score."""
    sums = long.groupBy(*ROW).agg(F.sum("contribution").alias("s"))
    gap = F.abs(F.col("s") - F.col("score"))
    return sums.join(scored, ROW).agg(
        F.count("*").alias("n_rows"), F.count(F.when(gap > tolerance, 1)).alias("n_off"), F.max(gap).alias("max_gap")
    )


def mark_top(scored: DataFrame, k: int = METRIC_K) -> DataFrame:
    """(customer, article) of each customer's top k by score."""
    return top_k(scored, ["customer_idx"], [F.desc("score"), F.asc("article_idx")], k, "pos").select(*ROW, "pos")


def global_importance(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean absolute contribution and contrast per feature (and per ``by``)."""
    return long.groupBy(*(by or []), "feature").agg(
        F.count("*").alias("n"), F.avg(F.abs("contribution")).alias("mean_abs_contribution"),
        F.avg(F.abs("contrast")).alias("mean_abs_contrast"),
    )


def group_importance(importance: DataFrame) -> DataFrame:
    """Importance summed per feature group and its share."""
    groups = F.create_map(*[F.lit(v) for kv in GROUP_OF.items() for v in kv])
    g = importance.withColumn("feature_group", groups[F.col("feature")]).groupBy("feature_group").agg(
        F.sum("mean_abs_contribution").alias("total"), F.count("*").alias("n_features")
    )
    total = g.agg(F.sum("total")).scalar()
    return g.withColumn("share", safe_ratio(F.col("total"), total))


def rank_comparison(importance: DataFrame, gain: DataFrame) -> DataFrame:
    """Ranks of each feature by contribution, contrast and model importance (one row per feature)."""
    rows = importance.join(gain, "feature", "left").na.fill(0.0, ["importance"])
    for c, out in (("mean_abs_contribution", "rank_contribution"), ("mean_abs_contrast", "rank_contrast"), ("importance", "rank_importance")):
        rows = rows.withColumn(out, F.row_number().over(W.orderBy(F.desc(F.round(c, 9)), "feature")))
    return rows


def sample_customers(x: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """All rows of n customers taken in hash order, so lists stay whole."""
    who = x.select("customer_idx").distinct().withColumn("u", hash_uniform(seed, F.col("customer_idx")))
    return x.join(who.orderBy("u", "customer_idx").limit(n), "customer_idx", "left_semi")


def partner_feature(x: DataFrame, model: LinearRanker, feature: str) -> DataFrame:
    """The other feature whose values correlate most with ``feature``'s contribution."""
    i = model.features.index(feature)
    others = [f for f in model.features if f != feature]
    row = x.select(model.contribution(i).alias("__c"), *others).agg(
        *[F.struct(F.lit(f).alias("feature"), F.abs(_corr(f)).alias("r")).alias(f"p_{j}") for j, f in enumerate(others)]
    )
    pairs = row.select(F.explode(F.array(*row.columns)).alias("p")).select("p.*")
    return pairs.filter(F.col("r").isNotNull()).orderBy(F.desc(F.round("r", 9)), "feature").limit(1)


def _corr(f: str) -> Column:
    v = F.col(f).cast("double")
    c = F.when(v.isNotNull(), F.col("__c"))
    # F.corr divides by zero under ANSI when a column is constant
    return safe_ratio(F.covar_pop(v, c), F.sqrt(F.var_pop(v) * F.var_pop(c)))


# --- reasons ----------------------------------------------------------------------

# fixed values: theme of each feature that can give a reason, and the wording and limits
THEMES = {
    "i_days_since_bought_article": "repurchase",
    "i_days_since_bought_product_code": "repurchase",
    "a_trend_ratio": "popularity_trend",
    "i_age_gap": "demographic_fit",
    "i_customer_share_product_group": "category",
    "i_customer_share_garment_group": "category",
    "a_repurchase_rate": "popularity_trend",
    "i_bought_same_product_code": "co_purchase",
}
MEAN_REPURCHASE_RATE = 0.0474
TEXT = {
    "i_days_since_bought_article": "You bought this exact item",
    "i_days_since_bought_product_code": "You bought another colour or size of this product",
    "a_trend_ratio": "Trending: %d%% more sales this week than its 4-week average",
    "i_age_gap": "Popular with customers your age",
    "i_customer_share_product_group": "product category",
    "i_customer_share_garment_group": "garment category",
    "often": "In a %s you buy often (%d%% of your purchases)",
    "before": "In a %s you've bought from before (%d%% of your purchases)",
    "a_repurchase_rate": "Customers re-buy this more than most items (%d%% vs 4.7%% avg)",
    "i_bought_same_product_code": "Often bought together with something you bought recently",
}


def _whole(v: Column) -> Column:
    return F.bround(v, 0).cast("int")


def reason_text(feature: Column, value: Column) -> Column:
    """Sentence for a feature value, or null when the value says nothing."""
    days = _whole(value)
    ago = F.concat(
        F.when(feature == "i_days_since_bought_article", TEXT["i_days_since_bought_article"]).otherwise(TEXT["i_days_since_bought_product_code"]),
        F.format_string(" %d ", days), F.when(days == 1, "day").otherwise("days"), F.lit(" ago"),
    )
    pct = _whole(value * 100)
    trend = _whole((value - 1.0) * 100)
    label = F.when(feature == "i_customer_share_product_group", TEXT["i_customer_share_product_group"]).otherwise(
        TEXT["i_customer_share_garment_group"]
    )
    share = F.when(value >= 0.25, F.format_string(TEXT["often"], label, pct)).when(
        value >= 0.10, F.format_string(TEXT["before"], label, pct)
    )
    known = value.isNotNull() & ~F.isnan(value)
    return F.when(
        known,
        F.when(feature.isin("i_days_since_bought_article", "i_days_since_bought_product_code"), F.when(days > 0, ago))
        .when(feature == "a_trend_ratio", F.when(trend >= 5, F.format_string(TEXT["a_trend_ratio"], trend)))
        .when(feature == "i_age_gap", F.when(value <= 10, TEXT["i_age_gap"]))
        .when(feature.isin("i_customer_share_product_group", "i_customer_share_garment_group"), share)
        .when(feature == "a_repurchase_rate", F.when(value >= 2 * MEAN_REPURCHASE_RATE, F.format_string(TEXT["a_repurchase_rate"], pct)))
        .when(feature == "i_bought_same_product_code", F.when(F.floor(value) > 0, TEXT["i_bought_same_product_code"])),
    )


def eligible_reasons(long: DataFrame) -> DataFrame:
    """Reasons with positive contrast; one about the exact item silences the product-code one."""
    rows = long.filter(F.col("feature").isin(*THEMES)).withColumn("reason", reason_text(F.col("feature"), F.col("value")))
    rows = rows.filter((F.round("contrast", 9) > 0) & F.col("reason").isNotNull())
    w = W.partitionBy(*ROW)  # at most one row per reason feature
    exact = F.max(F.col("feature") == "i_days_since_bought_article").over(w)
    rows = rows.withColumn("exact", exact)
    theme = F.create_map(*[F.lit(v) for kv in THEMES.items() for v in kv])
    kept = rows.filter(~(F.col("exact") & (F.col("feature") == "i_days_since_bought_product_code")))
    return kept.withColumn("theme", theme[F.col("feature")]).drop("exact")


def reasons(long: DataFrame, k: int = 3) -> DataFrame:
    """(customer, article, place, theme, feature, reason): best reason per theme, then the k best."""
    order = [F.desc(F.round("contrast", 9)), F.asc("feature")]
    best = top_k(eligible_reasons(long), [*ROW, "theme"], order, 1, "r")
    return top_k(best, ROW, order, k, "place").select(*ROW, "place", "theme", "feature", "reason")


def reason_lists(rs: DataFrame) -> DataFrame:
    """Reasons of a row as one text array, at most k entries."""
    packed = rs.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("place", "reason"))).alias("r"))
    return packed.select(*ROW, F.transform("r", lambda x: x["reason"]).alias("reasons"))


def reason_coverage(rs: DataFrame, rows: DataFrame) -> DataFrame:
    """Share of rows with a reason, mean reasons per row, and rows where both purchase reasons
    appear together (which the rules exclude)."""
    per = rs.groupBy(*ROW).agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("feature") == "i_days_since_bought_article", 1).otherwise(0)).alias("e"),
        F.max(F.when(F.col("feature") == "i_days_since_bought_product_code", 1).otherwise(0)).alias("c"),
    )
    return rows.select(*ROW).join(per, ROW, "left").agg(
        F.count("*").alias("n_rows"), F.count("n").alias("n_with_reason"),
        (F.count("n") / F.count("*")).alias("share_with_reason"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_reasons"),
        F.count(F.when((F.col("e") == 1) & (F.col("c") == 1), 1)).alias("n_conflicts"),
    )


def faithfulness(wide: DataFrame, model: LinearRanker, seed: int = SEED) -> DataFrame:
    """Score drop from hiding the strongest reason feature against hiding another, hash-chosen one.
    Hiding a value replaces it by the mean, so the drop is the feature's contribution. A sign
    test on the differences follows from counts. ``wide`` as of :func:`wide_contrasts`: all is found within a row."""
    chosen = _chosen(model)

    def strong(i: int, f: str) -> Column:
        return F.when(F.col(f"d{i}") > 0, 0).otherwise(1) if f in THEMES else F.lit(1)

    def entry(first: Column, second: Column, third: Column, fourth: Column) -> Column:
        return F.struct(first.alias("k"), second.alias("l"), third.alias("feature"), fourth.alias("contribution"))

    top = F.array_min(F.array(*[entry(strong(i, f), -F.col(f"d{i}"), F.lit(f), F.col(f"c{i}")) for i, f in chosen]))
    drawn = F.array(
        *[
            F.struct(
                hash_uniform(seed, F.col("customer_idx"), F.col("article_idx"), F.lit(f)).alias("u"),
                F.lit(f).alias("feature"), F.col(f"c{i}").alias("contribution"),
            )
            for i, f in chosen
        ]
    )
    rows = wide.select(top.alias("top"), F.slice(F.sort_array(drawn), 1, 2).alias("r"))
    # the second in hash order stands in when the first is the top feature itself
    r1, r2 = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    other = F.when(r1["feature"] != F.col("top.feature"), r1["contribution"]).otherwise(r2["contribution"])
    d = rows.select(F.col("top.contribution").alias("t"), other.alias("o")).withColumn("d", F.round(F.col("t") - F.col("o"), 12))
    agg = d.agg(
        F.count("*").alias("n_rows"), F.avg("t").alias("top_mean_drop"), F.avg("o").alias("random_mean_drop"),
        F.count(F.when(F.col("d") > 0, 1)).alias("n_larger"), F.count(F.when(F.col("d") < 0, 1)).alias("n_smaller"),
    )
    n = F.col("n_larger") + F.col("n_smaller")
    z = safe_ratio(F.col("n_larger") - n / 2.0, F.sqrt(n.cast("double")) / 2)
    return agg.withColumn("z", z).withColumn("p_value", two_sided_p(z)).withColumn("passed", F.col("top_mean_drop") > F.col("random_mean_drop"))


def worked_examples(top: DataFrame, segments: DataFrame, lists: DataFrame, seed: int = SEED) -> DataFrame:
    """One customer per segment, taken in hash order, with the ranked list and its reasons."""
    who = segments.join(top.select("customer_idx").distinct(), "customer_idx", "left_semi").withColumn("u", hash_uniform(seed, F.col("customer_idx")))
    one = top_k(who, ["family", "segment"], [F.asc("u"), F.asc("customer_idx")], 1, "r").select("family", "segment", "customer_idx")
    return one.join(top, "customer_idx").join(lists, ROW, "left").select("family", "segment", *ROW, "pos", F.array_join("reasons", " | ").alias("reasons"))
