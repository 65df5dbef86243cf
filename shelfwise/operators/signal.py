"""Signal of single features: AUC, list quality when ranked by one feature, correlation, drift."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.columns import safe_ratio
from shelfwise.functions.ordering import exact_quantiles, running_totals, top_k

EPSILON = 1e-6


def unpivot(x: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, value) rows with double values."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    )
    return x.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def feature_auc(x: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, n_positive, auc): rank-sum AUC of higher values, ties counted half; 0.5 below
    ten known values or with a single class. Rows are folded to one per (feature, value)."""
    cells = (
        unpivot(x, features, ["label"]).filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("label").cast("long").alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
    )
    ran = running_totals(cells, ["feature"], [F.asc("value")], {"neg_upto": F.col("neg")})
    s = ran.groupBy("feature").agg(
        F.sum("pos").alias("n_positive"),
        F.sum("neg").alias("n_negative"),
        F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)).alias("wins"),
    )
    n = F.col("n_positive") + F.col("n_negative")
    auc = safe_ratio(F.col("wins"), F.col("n_positive").cast("double") * F.col("n_negative"))
    named = x.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return named.join(s, "feature", "left").select(
        "feature",
        F.coalesce(n, F.lit(0)).alias("n"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        F.coalesce(F.when(n >= 10, auc), F.lit(0.5)).alias("auc"),
    )


def directions(auc: DataFrame) -> DataFrame:
    """Rank ascending when lower values mark positives; taken from training folds."""
    return auc.select("feature", (F.col("auc") < 0.5).alias("ascending"))


def feature_map(x: DataFrame, truth: DataFrame, features: list[str], direction: DataFrame, k: int = 12) -> DataFrame:
    """(feature, map): MAP@k over all truth customers when candidates are ordered by one feature.

    All features run in one job: rows dealt by customer, as saved features are, are unpivoted in place, cut to
    k per (customer, feature), and only hits travel further."""
    n_truth = truth.groupBy("customer_idx").agg(F.count("*").alias("n_truth"))
    # one row per feature
    long = unpivot(x, features, ["customer_idx", "article_idx", "label"]).join(
        F.broadcast(direction), "feature"
    )
    key = F.when(F.col("ascending"), F.col("value")).otherwise(-F.col("value"))
    best = top_k(
        long.withColumn("k", key), ["customer_idx", "feature"], [F.asc_nulls_last("k"), F.asc("article_idx")], k, "pos"
    )
    w = W.partitionBy("customer_idx", "feature").orderBy("pos")  # at most k rows
    hits = best.filter(F.col("label") == 1).withColumn("h", F.row_number().over(w))
    ap = (
        hits.groupBy("customer_idx", "feature").agg(F.sum(F.col("h") / F.col("pos")).alias("s"))
        .join(n_truth, "customer_idx")
        .groupBy("feature").agg(F.sum(F.col("s") / F.least("n_truth", F.lit(k))).alias("total"))
    )
    n = n_truth.agg(F.count("*").alias("n")).scalar()
    return direction.select("feature").join(ap, "feature", "left").select(
        "feature", (F.coalesce("total", F.lit(0.0)) / n).alias("map")
    )


def leakage_flags(auc: DataFrame, maps: DataFrame, oracle_map: DataFrame, auc_limit: float = 0.9) -> DataFrame:
    """Features that look too good: oriented AUC above the limit, or MAP above the oracle bound."""
    rows = auc.join(maps, "feature").withColumn("oriented_auc", F.greatest("auc", 1 - F.col("auc")))
    return rows.withColumn("oracle_map", oracle_map.scalar()).select(
        "feature", "oriented_auc", "map",
        (F.col("oriented_auc") > auc_limit).alias("auc_flag"),
        (F.col("map") > F.col("oracle_map")).alias("map_flag"),
    )


def correlated_pairs(x: DataFrame, features: list[str], limit: float = 0.95) -> DataFrame:
    """Pearson correlation of each pair over rows where both are known; pairs with |r| > limit.

    Each Arrow batch is reduced to its matrix products, one row per pair, which Spark then
    sums; columns are centred first so that the products do not cancel."""
    means = x.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).select(F.struct("*")).scalar()
    centred = x.withColumn("m", means).select(*[(F.col(f).cast("double") - F.col(f"m.{f}")).alias(f) for f in features])
    pairs = list(combinations(range(len(features)), 2))
    ia, ib = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def products(batches):
        for pdf in batches:
            v = pdf.to_numpy(dtype="float64", na_value=np.nan)
            known = (~np.isnan(v)).astype("float64")
            v = np.nan_to_num(v)
            yield pd.DataFrame(
                {
                    "a": ia,
                    "b": ib,
                    "n": (known.T @ known)[ia, ib],
                    "sx": (v.T @ known)[ia, ib],
                    "sy": (known.T @ v)[ia, ib],
                    "sxx": ((v * v).T @ known)[ia, ib],
                    "syy": (known.T @ (v * v))[ia, ib],
                    "sxy": (v.T @ v)[ia, ib],
                }
            )

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    schema = "a int, b int, " + ", ".join(f"{c} double" for c in sums)
    total = centred.mapInPandas(products, schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx = F.greatest(F.col("sxx") - safe_ratio(sx * sx, n), F.lit(0.0))
    vy = F.greatest(F.col("syy") - safe_ratio(sy * sy, n), F.lit(0.0))
    spread = (vx > n * 1e-12) & (vy > n * 1e-12)
    r = F.when(spread, (F.col("sxy") - safe_ratio(sx * sy, n)) / F.sqrt(vx * vy))
    names = F.array(*[F.lit(f) for f in features])
    return total.select(
        F.element_at(names, F.col("a") + 1).alias("feature_a"), F.element_at(names, F.col("b") + 1).alias("feature_b"), r.alias("r")
    ).filter(F.abs("r") > limit)


def stability_index(base: DataFrame, other: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi) with decile edges of ``base``; shares below 1e-6 are lifted to it. Nulls are
    left out. The edges are one small row, read as a scalar subquery."""
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(unpivot(base, features, []), ["feature"], "value", {f"q{i}": p for i, p in enumerate(probs)})
    row = F.struct("feature", F.array(*[f"q{i}" for i in range(len(probs))]))
    packed = edges.agg(F.map_from_entries(F.collect_list(row)).alias("m")).scalar()

    def binned(x: DataFrame, name: str) -> DataFrame:
        long = unpivot(x, features, []).filter(F.col("value").isNotNull())
        long = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
        cut = long.withColumn("edges", F.element_at(packed, F.col("feature")))
        b = F.size(F.filter("edges", lambda e: e < F.col("value")))
        return cut.groupBy("feature", b.alias("bin")).agg(F.sum("n").alias(name))

    n = binned(base, "n_base").join(binned(other, "n_other"), ["feature", "bin"], "full").na.fill(0)
    w = W.partitionBy("feature")  # at most ``bins`` rows
    pb = F.greatest(F.col("n_base") / F.sum("n_base").over(w), F.lit(EPSILON))
    po = F.greatest(safe_ratio(F.col("n_other"), F.sum("n_other").over(w)), F.lit(EPSILON))
    terms = n.select("feature", ((po - pb) * F.log(po / pb)).alias("term"))
    return terms.groupBy("feature").agg(F.sum("term").alias("psi"))
