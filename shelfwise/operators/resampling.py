"""Bootstrap over customers as Spark aggregates: Poisson weights from a hash, no row is
gathered, and each task folds its rows into one partial sum per replicate."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import LANES, lane_digest, lane_uniform, poisson_weight, safe_ratio
from shelfwise.schema import SEED

BITS = 64  # replicates whose draws one mask holds


def replicate_sums(
    df: DataFrame,
    values: dict[str, tuple[Column, Column]],
    n_boot: int,
    seed: int = SEED,
    unit: str = "customer_idx",
    groups: list[str] | None = None,
) -> DataFrame:
    """(groups, replicate, one column per value): sum(w * num) / sum(w * den).

    ``values`` maps a name to (numerator, denominator) columns; a mean has denominator 1.
    Rows are expanded to n_boot / 4 blocks, not n_boot rows.
    """
    groups = groups or []
    base = df.select(
        *groups,
        F.col(unit).alias("__unit"),
        *[c.alias(f"__{p}_{n}") for n, (num, den) in values.items() for p, c in (("x", num), ("d", den))],
    )
    blocks = -(-n_boot // LANES)
    rows = base.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("__digest", lane_digest(seed, F.col("__unit"), F.col("__block")))
    rows = rows.withColumns({f"__w{j}": poisson_weight(lane_uniform(F.col("__digest"), j)) for j in range(LANES)})
    aggs = []
    for n in values:
        known = F.col(f"__x_{n}").isNotNull()
        for j in range(LANES):
            w = F.col(f"__w{j}")
            aggs.append(F.sum(w * F.col(f"__x_{n}")).alias(f"__sx_{n}_{j}"))
            aggs.append(F.sum(F.when(known, w * F.col(f"__d_{n}"))).alias(f"__sd_{n}_{j}"))
    summed = rows.groupBy(*groups, "__block").agg(*aggs)
    lanes = F.array(
        *[
            F.struct(
                (F.col("__block") * LANES + j).alias("replicate"),
                # rounded: sums that cancel to zero must not keep a summation-order residue
                *[F.round(safe_ratio(F.col(f"__sx_{n}_{j}"), F.col(f"__sd_{n}_{j}")), 12).alias(n) for n in values],
            )
            for j in range(LANES)
        ]
    )
    return (
        summed.select(*groups, F.explode(lanes).alias("r"))
        .select(*groups, "r.*")
        .filter(F.col("replicate") < n_boot)
    )


def interval(replicates: DataFrame, value: str, groups: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Percentile interval per group; n_boot values per group."""
    return replicates.groupBy(*(groups or [])).agg(
        F.percentile(value, F.lit(alpha / 2)).alias("ci_lo"),
        F.percentile(value, F.lit(1 - alpha / 2)).alias("ci_hi"),
    )


def bootstrap_mean(
    df: DataFrame,
    value: str,
    n_boot: int = 1000,
    seed: int = SEED,
    groups: list[str] | None = None,
    alpha: float = 0.05,
    weight: str | None = None,
    unit: str = "customer_idx",
) -> DataFrame:
    """Mean with interval; ``weight`` makes it a ratio of sums (cluster bootstrap of a rate)."""
    groups = groups or []
    x, d = F.col(value).cast("double"), F.lit(1.0)
    if weight:
        d = F.col(weight).cast("double")
        x = x * d
    reps = replicate_sums(df, {"m": (x, d)}, n_boot, seed, unit, groups)
    known = F.when(F.col(value).isNotNull(), d)
    point = df.groupBy(*groups).agg(
        (F.sum(x) / F.sum(known)).alias("mean"), F.count(value).alias("n_customers")
    )
    bounds = interval(reps, "m", groups, alpha)
    if not groups:
        both = bounds.select(F.struct("*")).scalar()
        return point.withColumn("b", both).select("mean", "b.*", "n_customers")
    return point.join(bounds, groups).select(*groups, "mean", "ci_lo", "ci_hi", "n_customers")


def bootstrap_p_value(replicates: DataFrame, value: str, observed: DataFrame, groups: list[str]) -> DataFrame:
    """Two-sided p per group with +1 smoothing; ``observed`` holds (groups, observed)."""
    r = replicates.join(observed, groups) if groups else replicates.withColumn("observed", observed.scalar())
    against = F.when(F.col("observed") > 0, F.col(value) <= 0).otherwise(F.col(value) >= 0)
    return r.groupBy(*groups).agg(
        F.least(F.lit(1.0), 2.0 * (F.count(F.when(against, 1)) + 1) / (F.count(value) + 1)).alias("p_bootstrap")
    )


def paired_difference(
    outcomes: DataFrame,
    a: str,
    b: str,
    n_boot: int = 1000,
    seed: int = SEED,
    groups: list[str] | None = None,
) -> DataFrame:
    """Means of both columns, mean difference with interval and p, relative lift in percent."""
    groups = groups or []
    d = F.col(a) - F.col(b)
    reps = replicate_sums(outcomes, {"diff": (d, F.lit(1.0))}, n_boot, seed, groups=groups)
    key = groups or ["__all"]
    if not groups:
        outcomes = outcomes.withColumn("__all", F.lit(1))
        reps = reps.withColumn("__all", F.lit(1))
    point = outcomes.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_diff")
    )
    p = bootstrap_p_value(reps, "diff", point.select(*key, F.col("mean_diff").alias("observed")), key)
    out = point.join(interval(reps, "diff", key), key).join(p, key)
    return out.select(
        *groups,
        "n", "mean_a", "mean_b", "mean_diff", "ci_lo", "ci_hi",
        ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)).alias("ci_excludes_zero"),
        (safe_ratio(F.col("mean_diff"), F.col("mean_b")) * 100.0).alias("lift_pct"),
        "p_bootstrap",
    )


def bootstrap_coverage(
    preds: DataFrame,
    history: DataFrame,
    n_boot: int = 200,
    seed: int = SEED,
    fraction: float = 1.0,
    alpha: float = 0.05,
) -> DataFrame:
    """Catalogue coverage over resampled customers.

    A resample misses customers, so its coverage lies below the point value; ``bias`` reports
    by how much. ``fraction`` draws m = fraction * n customers. Only whether a customer is
    drawn matters, which is a Poisson weight above 0.
    """
    sold = history.select("article_idx").distinct().agg(F.count("*").alias("n")).scalar()
    point = preds.agg(F.countDistinct("article_idx").alias("n_rec"), F.countDistinct("customer_idx").alias("n_customers"))
    # one bit for each replicate that draws a customer; an article is covered where any bit of its customers is set
    word = F.col("word")
    digests = F.transform(F.sequence(F.lit(0), F.lit(BITS // LANES - 1)), lambda i: lane_digest(seed, F.col("customer_idx"), word * (BITS // LANES) + i))

    def with_bit(mask: Column, lane: Column) -> Column:
        digest = F.get(F.col("digests"), F.floor(lane / LANES).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), lane)
        return F.when(lane_uniform(digest, lane % LANES) >= F.lit(exp(-fraction)), mask.bitwiseOR(bit)).otherwise(mask)

    lanes = F.sequence(F.lit(0), F.lit(BITS - 1))
    masks = (
        preds.select("customer_idx").distinct()
        .withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // BITS) - 1))))
        .withColumn("digests", digests)
        .select("customer_idx", "word", F.aggregate(lanes, F.lit(0).cast("long"), with_bit).alias("mask"))
    )
    covered = preds.select("customer_idx", "article_idx").join(masks, "customer_idx").groupBy("article_idx", "word").agg(F.bit_or("mask").alias("mask"))
    drawn = (
        covered.withColumn("lane", F.explode(lanes))
        .groupBy((word * BITS + F.col("lane")).alias("replicate"))
        .agg(F.sum(F.call_function("shiftright", F.col("mask"), F.col("lane")).bitwiseAND(F.lit(1))).alias("n_rec"))
        .filter((F.col("replicate") < n_boot) & (F.col("n_rec") > 0))
        .withColumn("coverage", F.col("n_rec") / sold)
    )
    summary = drawn.agg(
        F.percentile("coverage", F.lit(alpha / 2)).alias("ci_lo"),
        F.percentile("coverage", F.lit(1 - alpha / 2)).alias("ci_hi"),
        F.avg("coverage").alias("boot_mean"),
    ).select(F.struct("*")).scalar()
    return (
        point.withColumn("coverage", F.col("n_rec") / sold)
        .withColumn("b", summary)
        .select(
            "n_customers", "coverage", "b.ci_lo", "b.ci_hi", (F.col("b.boot_mean") - F.col("coverage")).alias("bias")
        )
    )
