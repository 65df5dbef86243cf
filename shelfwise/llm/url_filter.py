"""URL filter: host and path rules, and logistic regression on hashed character n-grams, in SQL functions only.

The model is trained from a small labelled table (url, label 0 or 1, 1 means block) of at most
``max_rows`` rows, by full gradient descent written as array functions over one row; the weights
come back as one array of ``buckets`` numbers and a bias. With ``momentum`` each gradient is taken ahead of the weights (Nesterov). A row's cells are scaled to length one, and the
two classes weigh the same. Every page is then scored by itself, with no shuffle.

Null url, or one without ``://``: host and path are empty, the probability is that of the bias alone. A page without
a host gives the model nothing to judge, so it is allowed unless a rule fits. Very long urls are scored whole. Repeated
rows are judged one by one. Equally long rules that fit: the smaller (host, path) wins. Other columns are
not touched and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import let


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    buckets: int = 4_096
    sizes: tuple[int, ...] = (3, 4, 5)
    rounds: int = 250
    rate: float = 8.0
    decay: float = 1e-4
    momentum: float = 0.0  # share of the last step that the next one starts ahead by
    max_rows: int = 2_000
    limit: float = 0.5  # block above this probability


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def cells(host: Column, path: Column, model: UrlModel) -> Column:
    """Distinct cells of the character n-grams of ``^host path$``."""
    s = F.concat(F.lit("^"), host, path, F.lit("$"))

    def grams(k: int) -> Column:
        def cell(i: Column) -> Column:  # one parameter: a second one would be given the index
            return F.pmod(F.xxhash64(F.substring(s, i, F.lit(k))), F.lit(model.buckets)).cast("int")

        starts = F.sequence(F.lit(1), F.length(s) - k + 1)
        return F.when(F.length(s) >= k, F.transform(starts, cell)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*[grams(k) for k in model.sizes]))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows as ``row`` (a struct of all columns) with ``host`` and ``path``."""
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    return df.select("row", host.alias("host"), path.alias("path"))


def train(labelled: DataFrame, model: UrlModel = UrlModel()) -> Column:
    """Weights as one array, the bias last. More than ``max_rows`` rows are refused."""
    parts = with_parts(labelled)
    rows = parts.select(
        cells(F.col("host"), F.col("path"), model).alias("f"),
        F.col("row.label").cast("double").alias("y"), "host", "path",
    ).filter("y is not null")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("host", "path", "y", "f"))).alias("data"))
    size = F.size("data")
    guard = F.when(size <= model.max_rows, F.col("data")).otherwise(
        F.raise_error(F.lit(f"the labelled table has more than {model.max_rows} rows"))
    )
    packed = packed.select(guard.alias("data"))
    # rows by cell, to sum what a cell's rows are wrong by
    pairs = packed.select(F.posexplode("data").alias("i", "r")).select("i", F.explode("r.f").alias("cell"))
    by_cell = pairs.groupBy("cell").agg(F.array_sort(F.collect_list("i")).alias("rows"))
    cells_all = labelled.sparkSession.range(model.buckets).select(F.col("id").cast("int").alias("cell"))
    full = cells_all.join(by_cell, "cell", "left").select("cell", F.coalesce("rows", F.array().cast("array<int>")).alias("rows"))
    where = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "rows"))), lambda x: x["rows"]).alias("w"))
    ready = packed.select(
        F.struct(
            F.transform("data", lambda r: r["f"]).alias("f"), F.transform("data", lambda r: r["y"]).alias("y"),
            F.size("data").alias("n"), where.scalar().alias("where"),
        ).alias("d")
    )

    def wrong(d: Column, w: Column) -> Column:
        """Label minus probability of every row, times its class's weight; the bias is the last weight."""
        ones = F.aggregate(d["y"], F.lit(0.0), lambda a, t: a + t)

        def one(f: Column, t: Column) -> Column:
            total = F.aggregate(f, F.lit(0.0), lambda a, s: a + F.get(w, s)) / F.sqrt(F.size(f))
            share = F.when(t == 1, ones / d["n"]).otherwise(1 - ones / d["n"])
            return (t - 1 / (1 + F.exp(-total - F.element_at(w, -1)))) / (2 * share)

        return F.zip_with(d["f"], d["y"], one)

    def step(d: Column, w: Column) -> Column:
        def moved(r: Column) -> Column:
            inner = F.transform(
                d["where"],
                lambda rows, s: F.get(w, s)
                + model.rate
                * (F.aggregate(rows, F.lit(0.0), lambda a, i: a + F.get(r, i) / F.sqrt(F.size(F.get(d["f"], i)))) / d["n"] - model.decay * F.get(w, s)),
            )
            bias = F.element_at(w, -1) + model.rate * F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / d["n"]
            return F.concat(inner, F.array(bias))

        return let(wrong(d, w), moved)

    def descend(d: Column) -> Column:
        start = F.array_repeat(F.lit(0.0), F.size(d["where"]) + 1)
        rounds = F.sequence(F.lit(1), F.lit(model.rounds))
        if not model.momentum:
            return F.aggregate(rounds, start, lambda w, _: step(d, w))

        def ahead(s: Column) -> Column:
            return F.zip_with(s["w"], s["last"], lambda a, b: a + model.momentum * (a - b))

        def moved(s: Column) -> Column:
            return F.struct(let(ahead(s), lambda w: step(d, w)).alias("w"), s["w"].alias("last"))

        both = F.struct(start.alias("w"), start.alias("last"))
        return F.aggregate(rounds, both, lambda s, _: moved(s), lambda s: s["w"])

    return ready.select(let(F.col("d"), descend)).scalar()


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame, model: UrlModel = UrlModel()) -> DataFrame:
    """Rows as ``row`` with host, path, rule, probability and verdict."""
    df = with_parts(pages)
    longest_first = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [
        (r, ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))) & F.startswith(F.col("path"), F.lit(r.path)))
        for r in longest_first
    ]
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, fit in reversed(fits):
        rule = F.when(fit, F.lit(r.name)).otherwise(rule)
        by_rule = F.when(fit, F.lit(r.verdict)).otherwise(by_rule)
    df = df.withColumn("cells", cells(F.col("host"), F.col("path"), model)).withColumn("weights", train(labelled, model))
    w = F.col("weights")
    total = F.element_at(w, -1) + F.when(
        F.size("cells") > 0, F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.get(w, c)) / F.sqrt(F.size("cells"))
    ).otherwise(F.lit(0.0))
    df = df.withColumn("probability", 1 / (1 + F.exp(-total)))
    own = F.when((F.col("host") != "") & (F.col("probability") > model.limit), F.lit("block")).otherwise(F.lit("allow"))
    return df.select("row", "host", "path", rule.alias("rule"), "probability", F.coalesce(by_rule, own).alias("verdict"))
