"""Tests and experiment analysis on per-customer outcome tables.

Everything is folded to sufficient statistics (n, sums, sums of squares) on Spark first;
the formulas then run as columns on one row per comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.columns import (
    Z_80,
    Z_975,
    hash_uniform,
    normal_cdf,
    LANES, lane_digest, lane_uniform,
    safe_ratio,
    two_sided_p,
)
from shelfwise.functions.ordering import average_ranks, running_rank
from shelfwise.functions.student import student_p
from shelfwise.schema import SEED


# --- formulas -------------------------------------------------------------------


def z_test(df: DataFrame, hits_a: str, n_a: str, hits_b: str, n_b: str) -> DataFrame:
    """Pooled two-proportion z-test of b against a, with the unpooled 95 % interval."""
    na, nb = F.col(n_a).cast("double"), F.col(n_b).cast("double")
    pa, pb = F.col(hits_a) / na, F.col(hits_b) / nb
    pool = (F.col(hits_a) + F.col(hits_b)) / (na + nb)
    se0 = F.sqrt(pool * (1 - pool) * (1 / na + 1 / nb))
    se = F.sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb)
    z = F.coalesce(safe_ratio(pb - pa, se0), F.lit(0.0))
    return df.withColumns(
        {
            "p_a": pa,
            "p_b": pb,
            "z": z,
            "p_value": two_sided_p(z),
            "effect": pb - pa,
            "ci_lo": pb - pa - Z_975 * se,
            "ci_hi": pb - pa + Z_975 * se,
        }
    )


def welch(df: DataFrame, a: str, b: str) -> DataFrame:
    """Welch's t of b against a from columns n_<x>, mean_<x>, var_<x>."""
    va, vb = F.col(f"var_{a}") / F.col(f"n_{a}"), F.col(f"var_{b}") / F.col(f"n_{b}")
    se2 = va + vb
    effect = F.col(f"mean_{b}") - F.col(f"mean_{a}")
    dof = safe_ratio(se2 * se2, va * va / (F.col(f"n_{a}") - 1) + vb * vb / (F.col(f"n_{b}") - 1))
    return df.withColumns(
        {
            "t": safe_ratio(effect, F.sqrt(se2)),
            "dof": dof,
            "effect": effect,
            "ci_lo": effect - Z_975 * F.sqrt(se2),
            "ci_hi": effect + Z_975 * F.sqrt(se2),
        }
    )


def with_student_p(df: DataFrame, t: str = "t", dof: str = "dof", out: str = "p_value") -> DataFrame:
    return df.withColumn(out, student_p(F.col(t), F.col(dof)))


def paired_t(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """Per group: n, mean difference and t of a - b."""
    d = F.col(a) - F.col(b)
    agg = df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return agg.withColumn("t", safe_ratio(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))).withColumn(
        "dof", (F.col("n") - 1).cast("double")
    )


def holm(df: DataFrame, p: str, tie_break: list[str], out: str = "p_adj") -> DataFrame:
    """Holm step-down over all rows of a table with one row per test."""
    order = W.orderBy(F.asc(p), *tie_break)
    ranked = df.withColumn("__i", F.row_number().over(order)).withColumn("__m", F.count("*").over(W.partitionBy(F.lit(0))))
    stepped = ranked.withColumn("__s", (F.col("__m") - F.col("__i") + 1) * F.col(p))
    upto = W.orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    return stepped.withColumn(out, F.least(F.lit(1.0), F.max("__s").over(upto))).drop("__i", "__m", "__s")


# --- arms -----------------------------------------------------------------------


def assign_arms(users: DataFrame, seed: int = SEED) -> DataFrame:
    """Exact halves: the lower half of the hash order is arm A (one fewer when odd)."""
    keyed = users.select("customer_idx", hash_uniform(seed, F.col("customer_idx")).alias("u"))
    ranked = running_rank(keyed, [], [F.asc("u"), F.asc("customer_idx")], "r")
    half = keyed.agg(F.floor(F.count("*") / 2).alias("half")).scalar()
    return ranked.select("customer_idx", F.when(F.col("r") <= half, "A").otherwise("B").alias("arm"))


def _by_arm(outcomes: DataFrame, arms: DataFrame) -> DataFrame:
    return outcomes.join(arms, "customer_idx")


def replay_comparison(outcomes: DataFrame, arms: DataFrame) -> DataFrame:
    """Arm A sees the heuristic, arm B the ranker: z-test on hits and Welch t on AP, one row."""
    a, b = F.col("arm") == "A", F.col("arm") == "B"
    stats = _by_arm(outcomes, arms).agg(
        F.count(F.when(a, 1)).alias("n_a"),
        F.count(F.when(b, 1)).alias("n_b"),
        F.sum(F.when(a, F.col("heuristic_hit"))).alias("hits_a"),
        F.sum(F.when(b, F.col("ranker_hit"))).alias("hits_b"),
        F.avg(F.when(a, F.col("heuristic_ap"))).alias("mean_a"),
        F.avg(F.when(b, F.col("ranker_ap"))).alias("mean_b"),
        F.var_samp(F.when(a, F.col("heuristic_ap"))).alias("var_a"),
        F.var_samp(F.when(b, F.col("ranker_ap"))).alias("var_b"),
    )
    z = z_test(stats, "hits_a", "n_a", "hits_b", "n_b").withColumnsRenamed(
        {"effect": "hit_effect", "ci_lo": "hit_ci_lo", "ci_hi": "hit_ci_hi", "p_value": "z_p_value"}
    )
    return welch(z, "a", "b").withColumnsRenamed({"effect": "ap_effect", "ci_lo": "ap_ci_lo", "ci_hi": "ap_ci_hi"})


def guardrails(preds: DataFrame, arms: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per arm: coverage of the sold catalogue and mean popularity rank."""
    n_sold = ranks.agg(F.count("*").alias("n")).scalar()
    rows = preds.join(arms, "customer_idx").join(ranks.select("article_idx", "pop_rank"), "article_idx", "left")
    coverage = (
        rows.select("arm", "article_idx").distinct().groupBy("arm").agg((F.count("*") / n_sold).alias("coverage"))
    )
    bias = (
        rows.groupBy("arm", "customer_idx").agg(F.avg("pop_rank").alias("rank"))
        .groupBy("arm").agg(F.avg("rank").alias("popularity_bias"), F.count("*").alias("n_customers"))
    )
    return coverage.join(bias, "arm")


def split_tests(outcomes: DataFrame, value: str, n_splits: int, seed: int = SEED) -> DataFrame:
    """One z-test per random split of the same outcomes (no true effect). Each user falls in
    B by a hash of (user, split), one digest for each block of splits; tasks fold their users to one row per block."""
    rows = outcomes.select("customer_idx", F.col(value).alias("x")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(-(-n_splits // LANES) - 1)))
    )
    rows = rows.withColumn("digest", lane_digest(seed, F.col("customer_idx"), F.col("block")))
    rows = rows.withColumns({f"b{j}": lane_uniform(F.col("digest"), j) >= 0.5 for j in range(LANES)})
    aggs = [F.count("*").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("hits")]
    for j in range(LANES):
        aggs.append(F.count_if(f"b{j}").alias(f"n{j}"))
        aggs.append(F.coalesce(F.sum(F.when(F.col(f"b{j}"), F.col("x"))), F.lit(0.0)).alias(f"hits{j}"))
    lanes = F.array(
        *[
            F.struct(
                (F.col("block") * LANES + j).alias("split"), (F.col("n") - F.col(f"n{j}")).alias("n_a"), F.col(f"n{j}").alias("n_b"),
                (F.col("hits") - F.col(f"hits{j}")).alias("hits_a"), F.col(f"hits{j}").alias("hits_b"),
            )
            for j in range(LANES)
        ]
    )
    counts = rows.groupBy("block").agg(*aggs).select(F.inline(lanes))
    counts = counts.filter((F.col("split") < n_splits) & (F.col("n_a") > 0) & (F.col("n_b") > 0))
    return z_test(counts, "hits_a", "n_a", "hits_b", "n_b")


def aa_calibration(outcomes: DataFrame, value: str, n_splits: int, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """Share of no-effect splits that reject, with a binomial interval."""
    tests = split_tests(outcomes, value, n_splits, seed)
    rate = tests.agg(
        F.count("*").alias("n_splits"),
        F.count(F.when(F.col("p_value") < alpha, 1)).alias("n_rejected"),
        F.avg(F.when(F.col("p_value") < alpha, 1.0).otherwise(0.0)).alias("rejection_rate"),
    )
    se = F.sqrt(F.col("rejection_rate") * (1 - F.col("rejection_rate")) / F.col("n_splits"))
    return rate.withColumn("ci_lo", F.col("rejection_rate") - Z_975 * se).withColumn(
        "ci_hi", F.col("rejection_rate") + Z_975 * se
    )


def sequential_looks(outcomes: DataFrame, arms: DataFrame, arrivals: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Cumulative z-test per arrival day and whether it is the first to cross ``alpha``.
    ``arrivals`` has (customer_idx, day); the daily table has one row per day."""
    b = F.col("arm") == "B"
    daily = (
        _by_arm(outcomes, arms).join(arrivals, "customer_idx").groupBy("day").agg(
            F.count(F.when(~b, 1)).alias("n_a"),
            F.count(F.when(b, 1)).alias("n_b"),
            F.coalesce(F.sum(F.when(~b, F.col("heuristic_hit"))), F.lit(0.0)).alias("hits_a"),
            F.coalesce(F.sum(F.when(b, F.col("ranker_hit"))), F.lit(0.0)).alias("hits_b"),
        )
    )
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    cum = daily.select("day", *[F.sum(c).over(upto).alias(c) for c in ("n_a", "n_b", "hits_a", "hits_b")])
    tested = z_test(cum.filter((F.col("n_a") > 0) & (F.col("n_b") > 0)), "hits_a", "n_a", "hits_b", "n_b")
    crossed = F.min(F.when(F.col("p_value") < alpha, F.col("day"))).over(W.partitionBy(F.lit(0)))
    return tested.withColumn("first_crossing", F.coalesce(crossed == F.col("day"), F.lit(False)))


# --- variance reduction ------------------------------------------------------------


def cuped(users: DataFrame, metric: str, covariate: str) -> DataFrame:
    """One row: theta, correlation, variance before and after, and Welch t both ways.
    ``users`` has (arm, metric, covariate); missing covariates have to be set to 0 before."""
    m, x = F.col(metric).cast("double"), F.col(covariate).cast("double")
    pooled = users.agg(
        F.coalesce(safe_ratio(F.covar_samp(x, m), F.var_samp(x)), F.lit(0.0)).alias("theta"),
        F.avg(x).alias("x_mean"),
        F.coalesce(safe_ratio(F.covar_pop(x, m), F.sqrt(F.var_pop(x) * F.var_pop(m))), F.lit(0.0)).alias("corr"),
    ).select(F.struct("*")).scalar()
    adj = users.withColumn("c", pooled).withColumn(
        "adj", m - F.col("c.theta") * (x - F.col("c.x_mean"))
    )
    a, b = F.col("arm") == "A", F.col("arm") == "B"
    parts = []
    for name, col in (("raw", m), ("adj", F.col("adj"))):
        for arm, cond in (("a", a), ("b", b)):
            v = F.when(cond, col)
            parts += [
                F.count(v).alias(f"n_{name}_{arm}"),
                F.avg(v).alias(f"mean_{name}_{arm}"),
                F.var_samp(v).alias(f"var_{name}_{arm}"),
            ]
    out = adj.agg(
        F.first("c").alias("c"), F.var_samp(m).alias("var_unadjusted"), F.var_samp("adj").alias("var_adjusted"), *parts
    )
    out = welch(out, "raw_a", "raw_b").withColumnsRenamed({"t": "t_unadjusted", "dof": "dof_unadjusted"})
    out = welch(out, "adj_a", "adj_b").withColumnsRenamed({"t": "t_adjusted", "dof": "dof_adjusted"})
    return out.select(
        "c.theta", "c.x_mean", "c.corr",
        (F.col("c.corr") * F.col("c.corr")).alias("r_squared"),
        (1 - F.col("c.corr") * F.col("c.corr")).alias("n_factor"),
        "var_unadjusted", "var_adjusted",
        F.coalesce((1 - safe_ratio(F.col("var_adjusted"), F.col("var_unadjusted"))) * 100, F.lit(0.0)).alias("variance_reduction_pct"),
        "t_unadjusted", "t_adjusted", "dof_adjusted",
    )


# --- power ------------------------------------------------------------------------


def required_n(p0: Column, p1: Column) -> Column:
    """Users per arm of a two-sided z-test at 5 % with power 80 %; null when the rates agree."""
    mid = (p0 + p1) / 2
    root = Z_975 * F.sqrt(2 * mid * (1 - mid)) + Z_80 * F.sqrt(p0 * (1 - p0) + p1 * (1 - p1))
    return F.ceil(safe_ratio(root * root, (p1 - p0) * (p1 - p0)))


def power_at(p0: Column, p1: Column, n: Column, alpha: float = 0.05) -> Column:
    mid = (p0 + p1) / 2
    delta = F.abs(p1 - p0)
    spread = F.sqrt(p0 * (1 - p0) + p1 * (1 - p1))
    z = safe_ratio(delta * F.sqrt(n.cast("double")) - Z_975 * F.sqrt(2 * mid * (1 - mid)), spread)
    return F.when((delta == 0) | (n <= 0), alpha).when(spread == 0, 1.0).otherwise(normal_cdf(z))


def mde_at(p0: Column, n: Column) -> Column:
    return (Z_975 + Z_80) * F.sqrt(2 * p0 * (1 - p0) / n)


def power_table(rates: DataFrame, lifts=(0.01, 0.02, 0.05, 0.10), n_factor: Column | float = 1.0) -> DataFrame:
    """``rates`` has (segment, n_customers, base_rate); the table gives, per lift, users per arm
    without and with variance reduction, weeks at the segment's weekly traffic, power at that
    traffic, the smallest detectable effect and Cohen's h."""
    factor = F.lit(n_factor) if isinstance(n_factor, float) else n_factor
    p0 = F.col("base_rate")
    p1 = p0 * (1 + F.col("lift"))
    per_arm = F.col("n_customers") / 2.0
    rows = rates.withColumn("lift", F.explode(F.array(*[F.lit(x) for x in lifts])))
    rows = rows.withColumn("p_treat", p1).withColumn("n_per_arm", F.when(F.col("p_treat") < 1, required_n(p0, p1)))
    h = 2 * (F.asin(F.sqrt("p_treat")) - F.asin(F.sqrt(p0)))
    return rows.withColumns(
        {
            "n_total": F.col("n_per_arm") * 2,
            "n_per_arm_cuped": F.when(F.col("n_per_arm").isNotNull(), F.greatest(F.lit(1.0), F.bround(F.col("n_per_arm") * factor))),
            "weeks": F.col("n_per_arm") / per_arm,
            "power": F.when(F.col("p_treat") < 1, power_at(p0, F.col("p_treat"), per_arm)),
            "mde": mde_at(p0, per_arm),
            "cohen_h": F.when(F.col("p_treat") < 1, F.abs(h)),
        }
    )


# --- association -------------------------------------------------------------------


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho). Rows are folded to distinct (x, y) values before any ranking, and the
    ranks are centred, so the sums stay exact for large tables."""
    known = df.select(x, y).dropna()
    cells = known.groupBy(x, y).agg(F.count("*").alias("__n"))
    rx = average_ranks(known, [], x, "rx").select(x, "rx")
    ry = average_ranks(known, [], y, "ry").select(y, "ry")
    mid = known.agg(((F.count("*") + 1) / 2.0).alias("m")).scalar()
    c = cells.join(rx, x).join(ry, y).withColumn("rx", F.col("rx") - mid).withColumn("ry", F.col("ry") - mid)
    s = c.agg(
        F.sum("__n").alias("n"),
        F.sum(F.col("__n") * F.col("rx") * F.col("ry")).alias("sxy"),
        F.sum(F.col("__n") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("__n") * F.col("ry") * F.col("ry")).alias("syy"),
    )
    return s.select("n", safe_ratio(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("rho"))


def chi_square(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, chi2, dof, cramers_v) of the x-by-y table, whose size is the product of the
    category counts."""
    cells = df.select(x, y).dropna().groupBy(x, y).agg(F.count("*").alias("o"))
    rows = cells.groupBy(x).agg(F.sum("o").alias("rx"))
    cols = cells.groupBy(y).agg(F.sum("o").alias("cy"))
    total = cells.agg(F.sum("o").alias("n")).scalar()
    # sum over all cells of (o-e)^2/e = sum over filled cells of o^2/e - n
    filled = cells.join(rows, x).join(cols, y).agg(
        F.sum(F.col("o") * F.col("o") * total / (F.col("rx") * F.col("cy"))).alias("q"),
        F.sum("o").alias("n"),
        F.countDistinct(x).alias("r"),
        F.countDistinct(y).alias("c"),
    )
    chi2 = F.col("q") - F.col("n")
    return filled.select(
        "n", chi2.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"),
        F.sqrt(safe_ratio(chi2, F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"),
    )


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """``group`` true is sample 1. One row: n1, n2, U of sample 1 and the rank-biserial
    correlation, from one row per distinct value."""
    rows = df.select(value, group.alias("g")).dropna()
    counts = rows.groupBy(value).agg(F.count(F.when(F.col("g"), 1)).alias("k1"), F.count(F.when(~F.col("g"), 1)).alias("k2"))
    ranks = average_ranks(rows, [], value, "r").select(value, "r")
    s = counts.join(ranks, value).agg(
        F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.sum(F.col("k1") * F.col("r")).alias("r1")
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return s.select("n1", "n2", u.alias("u"), (1 - safe_ratio(2 * u, F.col("n1").cast("double") * F.col("n2"))).alias("rank_biserial"))


