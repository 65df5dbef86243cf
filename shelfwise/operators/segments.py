"""Customer segments and tests per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.ordering import exact_quantiles
from shelfwise.functions.columns import age_bucket, purchase_segment, recency_bucket
from shelfwise.operators.experiment import holm, paired_t, with_student_p
from shelfwise.operators.resampling import paired_difference
from shelfwise.schema import SEED, Calendar
from shelfwise.session import materialize

FAMILIES = ("prior_purchases", "age_bucket", "channel_tertile", "recency", "new_article_buyer")


def extended_segments(
    history: DataFrame,
    customers: DataFrame,
    truth: DataFrame,
    cutoff_week: int,
    cal: Calendar,
    new_scope: str = "evaluated",
) -> DataFrame:
    """(customer_idx, family, segment) for the truth customers in five families.

    ``new_scope``: an article is new when no ``evaluated`` customer bought it before, or, with
    ``all``, when nobody did.
    """
    who = truth.select("customer_idx").distinct()
    mine = history.join(who, "customer_idx", "left_semi")
    stats = mine.groupBy("customer_idx").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("sales_channel_id") == 2, 1.0).otherwise(0.0)).alias("online"),
        F.max("t_dat").alias("last"),
    )
    thirds = exact_quantiles(stats, [], "online", {"lo": 0.3333, "hi": 0.6667})
    enough = F.col("n_values") >= 3
    cuts = thirds.agg(
        F.coalesce(F.max(F.when(enough, F.col("lo"))), F.lit(0.33)).alias("lo"),
        F.coalesce(F.max(F.when(enough, F.col("hi"))), F.lit(0.67)).alias("hi"),
    ).select(F.struct("*")).scalar()
    known = (mine if new_scope == "evaluated" else history).select("article_idx").distinct()
    new_buyers = truth.join(known, "article_idx", "left_anti").select("customer_idx").distinct().withColumn("new", F.lit(True))
    days = F.lit(cal.cutoff_day(cutoff_week)) - F.unix_date("last")
    wide = (
        who.join(stats, "customer_idx", "left")
        .join(customers.select("customer_idx", "age"), "customer_idx", "left")
        .join(new_buyers, "customer_idx", "left")
        .withColumn("cut", cuts)
    )
    channel = (
        F.when(F.col("online").isNull(), "no_history")
        .when(F.col("online") <= F.col("cut.lo"), "low_online")
        .when(F.col("online") <= F.col("cut.hi"), "mid_online")
        .otherwise("high_online")
    )
    labels = {
        "prior_purchases": purchase_segment(F.coalesce("n", F.lit(0))),
        "age_bucket": age_bucket(F.col("age")),
        "channel_tertile": channel,
        "recency": recency_bucket(days),
        "new_article_buyer": F.when(F.col("new"), "buys_new_article").otherwise("no_new_article"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("family"), v.alias("segment")) for k, v in labels.items()])
    return wide.select("customer_idx", F.explode(pairs).alias("s")).select("customer_idx", "s.*")


def segment_map(users: DataFrame, segments: DataFrame, value: str = "ap") -> DataFrame:
    """Mean AP per segment."""
    return (
        users.select("customer_idx", value).join(segments, "customer_idx")
        .groupBy("family", "segment").agg(F.count("*").alias("n"), F.avg(value).alias("map"))
    )


def segment_tests(outcomes: DataFrame, segments: DataFrame, n_boot: int = 1000, seed: int = SEED) -> DataFrame:
    """Per segment: MAP of both models, interval and bootstrap p of the difference, paired t with
    its p, and both p values Holm-corrected over all segments."""
    keys = ["family", "segment"]
    rows = materialize(outcomes.join(segments, "customer_idx"))
    boot = paired_difference(rows, "ranker_ap", "heuristic_ap", n_boot, seed, keys)
    t = with_student_p(paired_t(rows, keys, "ranker_ap", "heuristic_ap"), out="p_ttest").select(*keys, "t", "p_ttest")
    out = boot.join(t, keys).withColumnsRenamed({"mean_a": "map_ranker", "mean_b": "map_heuristic"})
    # fewer than two customers, or no spread, cannot reject
    out = out.withColumn("p_ttest", F.coalesce(F.when(~F.isnan("p_ttest"), F.col("p_ttest")), F.lit(1.0)))
    out = holm(out, "p_bootstrap", keys, "p_bootstrap_adj")
    out = holm(out, "p_ttest", keys, "p_ttest_adj")
    return out.withColumn("significant", F.col("p_ttest_adj") < 0.05).withColumn("flagged", ~F.col("ci_excludes_zero"))


def segment_ttests(outcomes: DataFrame, segments: DataFrame) -> DataFrame:
    """Only the paired t part, recomputed from stored outcomes."""
    keys = ["family", "segment"]
    t = with_student_p(paired_t(outcomes.join(segments, "customer_idx"), keys, "ranker_ap", "heuristic_ap"))
    t = t.withColumn("p_value", F.coalesce(F.when(~F.isnan("p_value"), F.col("p_value")), F.lit(1.0)))
    return holm(t, "p_value", keys, "p_adj")


