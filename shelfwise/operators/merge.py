"""Priority merge of the candidate sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.functions.ordering import top_k
from shelfwise.schema import MERGE_BUDGET, SHARED_SOURCES, SOURCES, merged_columns


def _tagged(sources: dict[str, DataFrame], priority: list[str]) -> DataFrame:
    rank_of = {s: i for i, s in enumerate(priority)}
    frames = [
        df.select(
            "customer_idx",
            "article_idx",
            F.lit(rank_of.get(name, len(priority))).alias("prio"),
            F.col("source_rank").cast("int").alias("source_rank"),
            F.lit(name).alias("source"),
            "score",
        )
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def _per_pair(tagged: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row per pair: the winning source and every source's score and rank."""
    cols = []
    for s in names:
        hit = F.col("source") == s
        cols.append(F.max(F.when(hit, F.col("score"))).cast("float").alias(f"{s}_score"))
        cols.append(F.max(F.when(hit, F.col("source_rank"))).cast("smallint").alias(f"{s}_rank"))
    return tagged.groupBy(*keys).agg(F.min(F.struct("prio", "source_rank", "source")).alias("best"), *cols)


_BEST_FIRST = ["best.prio", "best.source_rank", "best.source", "article_idx"]


def merge_candidates(
    sources: dict[str, DataFrame], n: int = MERGE_BUDGET, priority: list[str] | None = None
) -> DataFrame:
    """Fill ``n`` places per customer by source priority, then rank within the source; a pair
    counts for its first source. Rows are shuffled once, by customer: at most the sum of the
    source limits per customer, so no customer is hot here."""
    priority = list(priority or SOURCES)
    names = [s for s in priority if s in sources] + [s for s in sources if s not in priority]
    rows = _tagged(sources, priority).repartition("customer_idx")
    pairs = _per_pair(rows, names, ["customer_idx", "article_idx"])
    merged = top_k(pairs, ["customer_idx"], _BEST_FIRST, n, "final_rank")
    return merged.select(
        "customer_idx",
        "article_idx",
        F.col("best.source").alias("final_source"),
        F.col("final_rank").cast("int").alias("final_rank"),
        *[c for s in names for c in (f"{s}_score", f"{s}_rank")],
    )


def shared_lists(last_week: DataFrame, decayed: DataFrame, segments: DataFrame, bucket_names: list[str]) -> DataFrame:
    """The three shared lists merged per age bucket: (age_bucket, article_idx, pos, prio,
    source_rank, source, scores and ranks). One list of at most 350 rows per bucket, plus the
    bucket "" for customers without a dimension row."""
    keys = ["age_bucket", "article_idx"]
    every = F.explode(F.array(*[F.lit(b) for b in [*bucket_names, ""]])).alias("age_bucket")
    prio = {s: i for i, s in enumerate(SOURCES)}
    frames = {
        "popularity_last_week": last_week.select(every, "*"),
        "popularity_decayed": decayed.select(every, "*"),
        "segment_popular": segments,
    }
    tagged = reduce(
        DataFrame.unionByName,
        [
            df.select(
                *keys,
                F.lit(prio[s]).alias("prio"),
                F.col("source_rank").cast("int").alias("source_rank"),
                F.lit(s).alias("source"),
                F.col("score").cast("float").alias("score"),
            )
            for s, df in frames.items()
        ],
    )
    pairs = _per_pair(tagged, list(SHARED_SOURCES), keys)
    ranked = pairs.withColumn("pos", F.row_number().over(W.partitionBy("age_bucket").orderBy(*_BEST_FIRST)))
    return ranked.select(*keys, "pos", "best.prio", "best.source_rank", "best.source", *_score_columns(SHARED_SOURCES))


def _score_columns(names) -> list[str]:
    return [c for s in names for c in (f"{s}_score", f"{s}_rank")]


def merge_with_shared_lists(
    personal: dict[str, DataFrame],
    shared: DataFrame,
    customers: DataFrame,
    buckets: DataFrame,
    n: int = MERGE_BUDGET,
) -> DataFrame:
    """Same rows as :func:`merge_candidates` when the shared sources rank below the personal
    ones. Only the personal rows are shuffled; each customer's open places are filled from
    the bucket's list inside the task, so the long common tail never crosses the network."""
    own, common = list(personal), list(SHARED_SOURCES)
    home = customers.select("customer_idx").join(buckets, "customer_idx", "left")
    home = home.withColumn("age_bucket", F.coalesce("age_bucket", F.lit("")))

    rows = _tagged(personal, list(SOURCES)).repartition("customer_idx")
    pairs = _per_pair(rows, own, ["customer_idx", "article_idx"])
    best = top_k(pairs, ["customer_idx"], _BEST_FIRST, n, "final_rank")
    # bounded: seven lists of at most 350 rows
    look = F.broadcast(shared.select("age_bucket", "article_idx", "pos", *_score_columns(common)))
    known = best.join(home, "customer_idx").join(look, ["age_bucket", "article_idx"], "left")
    entry = [
        "final_rank",
        "article_idx",
        F.col("best.source").alias("final_source"),
        *_score_columns(own),
        *_score_columns(common),
    ]
    lists = known.groupBy("customer_idx").agg(
        F.collect_list(F.struct(*entry)).alias("own"), F.collect_set("pos").alias("taken")
    )
    tail = shared.groupBy("age_bucket").agg(
        F.sort_array(
            F.collect_list(F.struct("pos", "article_idx", "source", *_score_columns(common)))
        ).alias("tail")
    )
    full = home.join(lists, "customer_idx", "left").join(F.broadcast(tail), "age_bucket", "left")
    empty = "cast(array() as {})"
    types = dict(lists.dtypes)
    tail_type = dict(tail.dtypes)["tail"]
    full = full.select(
        "customer_idx",
        F.coalesce("own", F.expr(empty.format(types["own"]))).alias("own"),
        F.coalesce("taken", F.expr("cast(array() as array<int>)")).alias("taken"),
        F.coalesce("tail", F.expr(empty.format(tail_type))).alias("tail"),
    )
    # of the first n + |taken| tail entries at least n - |own| are free
    free = F.expr(
        f"slice(filter(slice(tail, 1, {n} + size(taken)), x -> not array_contains(taken, x.pos)), 1, {n} - size(own))"
    )
    nulls = ", ".join(
        f"cast(null as float) as {s}_score, cast(null as smallint) as {s}_rank" for s in own
    )
    copied = ", ".join(f"x.{c} as {c}" for c in _score_columns(common))
    fill = F.expr(
        "transform(free, (x, i) -> struct(size(own) + i + 1 as final_rank, x.article_idx as article_idx, "
        f"x.source as final_source, {nulls}, {copied}))"
    )
    out = full.withColumn("free", free).select("customer_idx", F.inline(F.concat("own", fill)))
    return out.select(*[F.col(c) for c in merged_columns([*own, *common])])


def candidate_count_stats(merged: DataFrame, budget: int = MERGE_BUDGET) -> DataFrame:
    """Rows per customer: mean, median, 10th and 90th percentile (nearest rank), share at budget.

    Counts take at most ``budget`` values, so the distribution is aggregated to one row per
    count before any percentile is taken."""
    sizes = merged.groupBy("customer_idx").agg(F.count("*").alias("n"))
    freq = sizes.groupBy("n").agg(F.count("*").alias("f"))
    freq = freq.withColumn("upto", F.sum("f").over(W.orderBy("n")))  # at most one row per count value
    total = freq.agg(F.sum("f").alias("total")).scalar()
    freq = freq.withColumn("total", total)

    def nearest(q: float):
        at = F.round((F.col("total") - 1) * F.lit(q))
        return F.min(F.when(F.col("upto") > at, F.col("n"))).cast("double")

    return freq.agg(
        F.sum("f").alias("n_customers"),
        F.round(F.sum(F.col("n") * F.col("f")) / F.sum("f"), 6).alias("mean_candidates"),
        F.percentile(F.col("n").cast("double"), F.lit(0.5), F.col("f")).alias("median_candidates"),
        nearest(0.1).alias("p10"),
        nearest(0.9).alias("p90"),
        F.round(
            F.sum(F.when(F.col("n") == budget, F.col("f")).otherwise(0)) * 100.0 / F.sum("f"), 6
        ).alias("pct_at_budget"),
    )
