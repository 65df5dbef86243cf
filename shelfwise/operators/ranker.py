"""Rankers on the feature matrix, trained with pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.operators import metrics as mt
from shelfwise.schema import FEATURE_GROUPS, FEATURE_NAMES, SEED, feature_columns
from shelfwise.session import materialize


def training_frame(folds: DataFrame) -> DataFrame:
    """Rows of customers with at least one positive; others carry no order to learn from."""
    useful = folds.filter(F.col("label") == 1).select("customer_idx").distinct()
    return folds.join(useful, "customer_idx", "left_semi")


def training_counts(folds: DataFrame) -> DataFrame:
    per = folds.groupBy("customer_idx").agg(F.count("*").alias("n"), F.max("label").alias("any_positive"))
    keep = F.col("any_positive") == 1
    return per.agg(
        F.count(F.when(keep, 1)).alias("n_customers_kept"),
        F.count(F.when(~keep, 1)).alias("n_customers_dropped"),
        F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("n_rows_kept"),
        F.coalesce(F.sum(F.when(~keep, F.col("n"))), F.lit(0)).alias("n_rows_dropped"),
    )


@dataclass(frozen=True)
class LinearRanker:
    """Score = sum of weight * (value - mean) / std; an unknown value counts as the mean."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    weights: tuple[float, ...]

    def standardized(self, i: int) -> Column:
        if not self.stds[i]:
            return F.lit(0.0)
        return F.coalesce((F.col(self.features[i]).cast("double") - self.means[i]) / self.stds[i], F.lit(0.0))

    def contribution(self, i: int) -> Column:
        return self.standardized(i) * F.lit(self.weights[i])

    def score(self, x: DataFrame) -> DataFrame:
        """(customer_idx, article_idx, score) as one codegen projection. Terms are summed from an
        array, which keeps the expression tree flat."""
        terms = F.array(*[self.contribution(i) for i in range(len(self.features))])
        total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
        return x.select("customer_idx", "article_idx", total.alias("score"))


def column_stats(x: DataFrame, features) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Means and standard deviations: one row, two numbers per feature."""
    # one small aggregate over unpivoted values: a hundred aggregates side by side are too long a method to be compiled
    long = x.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])))
    rows = {r.i: r for r in long.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()}
    of = [rows.get(i) for i in range(len(features))]
    return tuple((r.m if r else None) or 0.0 for r in of), tuple((r.s if r else None) or 0.0 for r in of)


def train_linear(folds: DataFrame, features=None, reg: float = 0.01, max_iter: int = 30) -> LinearRanker:
    """Logistic regression without intercept on features centred within each customer's list.

    Centring removes what is common to a list, so the weights fit the differences between its
    rows, without building the pairs of positives and negatives. A list has at most the merge
    budget of rows, so the window group is small.
    """
    features = tuple(features or FEATURE_NAMES)
    rows = training_frame(folds)
    means, stds = column_stats(rows, features)
    base = LinearRanker(features, means, stds, tuple(1.0 for _ in features))
    z = rows.select("customer_idx", F.col("label").cast("double").alias("label"), *[base.standardized(i).alias(f) for i, f in enumerate(features)])
    w = W.partitionBy("customer_idx")
    centred = z.select("label", *[(F.col(f) - F.avg(f).over(w)).alias(f) for f in features])
    data = VectorAssembler(inputCols=list(features), outputCol="x").transform(centred).select("label", "x")
    fit = LogisticRegression(featuresCol="x", labelCol="label", fitIntercept=False, regParam=reg, maxIter=max_iter, tol=1e-4, standardization=False).fit(data)
    return LinearRanker(features, means, stds, tuple(float(v) for v in fit.coefficients))


def choose_regularization(train: DataFrame, valid: DataFrame, truth: DataFrame, grid=(0.001, 0.01, 0.1)) -> tuple[LinearRanker, list]:
    """Best model on the next fold by MAP; the fold must not be downsampled."""
    tried = []
    for reg in grid:
        model = train_linear(train, reg=reg)
        tried.append((reg, evaluate(model.score(valid), truth), model))
    best = max(tried, key=lambda t: t[1])
    return best[2], [(r, m) for r, m, _ in tried]


def evaluate(scored: DataFrame, truth: DataFrame) -> float:
    users = mt.per_customer_metrics(mt.predictions_from_scores(scored), truth)
    return mt.summarize_metrics(users).first()["map"]


def scaled_rounds(inner_rounds: int, n_inner: int, n_full: int, least: int = 10) -> int:
    """Boosting rounds for a retrain on more rows, scaled by the row ratio."""
    return max(least, round(inner_rounds * n_full / n_inner))


def _assembled(x: DataFrame, features, extra=()) -> DataFrame:
    filled = x.select(
        "customer_idx", "article_idx", F.col("label").cast("double").alias("label"), *extra,
        *[F.coalesce(F.col(f).cast("double"), F.lit(-999.0)).alias(f) for f in features],
    )
    return VectorAssembler(inputCols=list(features), outputCol="x").transform(filled)


def train_trees(train: DataFrame, valid: DataFrame | None = None, features=None, rounds: int = 20, depth: int = 4, seed: int = SEED):
    """Gradient-boosted trees; with ``valid`` (the next fold) boosting stops when it no longer gains."""
    features = tuple(features or FEATURE_NAMES)
    rows = training_frame(train).withColumn("held", F.lit(False))
    gbt = GBTClassifier(featuresCol="x", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1)
    if valid is not None:
        rows = rows.unionByName(training_frame(valid).withColumn("held", F.lit(True)))
        gbt = gbt.setValidationIndicatorCol("held")
    return gbt.fit(_assembled(rows, features, ("held",)))


def score_trees(model, x: DataFrame, features=None) -> DataFrame:
    out = model.transform(_assembled(x, tuple(features or FEATURE_NAMES)))
    return out.select("customer_idx", "article_idx", vector_to_array("probability")[1].alias("score"))


def tree_importance(model, spark, features=None) -> DataFrame:
    """(feature, importance); one row per feature."""
    pairs = list(zip(features or FEATURE_NAMES, [float(v) for v in model.featureImportances.toArray()]))
    return spark.createDataFrame(pairs, "feature string, importance double")


def linear_importance(model: LinearRanker, spark) -> DataFrame:
    return spark.createDataFrame([(f, abs(w)) for f, w in zip(model.features, model.weights)], "feature string, importance double")


def group_ablation(train: DataFrame, test: DataFrame, truth: DataFrame) -> DataFrame:
    """Retrain without each feature group; per-customer AP beside the full model's, in long form
    (group, customer_idx, ablated_ap, full_ap), ready for the paired tests."""
    full = train_linear(train)
    base = materialize(_ap(full.score(test), truth).withColumnRenamed("ap", "full_ap"))
    out = None
    for group in FEATURE_GROUPS:
        dropped = set(feature_columns(group))
        model = train_linear(train, [f for f in FEATURE_NAMES if f not in dropped])
        part = _ap(model.score(test), truth).withColumnRenamed("ap", "ablated_ap").join(base, "customer_idx")
        part = part.select(F.lit(group).alias("feature_group"), "customer_idx", "ablated_ap", "full_ap")
        out = part if out is None else out.unionByName(part)
    return out


def _ap(scored: DataFrame, truth: DataFrame) -> DataFrame:
    return mt.per_customer_metrics(mt.predictions_from_scores(scored), truth).select("customer_idx", "ap")


def score_checks(scored: DataFrame, features: DataFrame) -> DataFrame:
    """One row of sanity counts: rows lost or gained, null or NaN scores, repeated pairs."""
    n = features.agg(F.count("*")).scalar()
    pairs = scored.groupBy("customer_idx", "article_idx").agg(F.count("*").alias("k"), F.max("score").alias("score"))
    return pairs.agg(
        F.sum("k").alias("n_scored"),
        F.count(F.when(F.col("score").isNull() | F.isnan("score"), 1)).alias("n_bad_scores"),
        F.count(F.when(F.col("k") > 1, 1)).alias("n_repeated"),
    ).withColumn("n_expected", n)
