"""Top-k, ranks and running totals that never gather one group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Catalyst plans WindowGroupLimit, so a hot key is cut to k rows
    per map task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums of ``totals`` per key in ``order``.

    A window would sort each key in one task. Here rows are range-partitioned by
    (keys, order), so a hot key spans many partitions; each partition is summed on
    its own and shifted by the totals of the partitions before it. The sorted rows
    are checkpointed, because both branches must see the same partition borders.
    ``order`` has to be a total order within the key.
    """
    sums = {f"__v_{n}": c for n, c in totals.items()}
    rows = df.select("*", *[c.alias(n) for n, c in sums.items()])
    rows = rows.orderBy(*keys, *order).withColumn("__pos", F.monotonically_increasing_id())
    rows = materialize(rows).withColumn("__part", F.shiftright("__pos", _LOCAL_BITS))

    # one row per (partition, key): at most partitions + distinct keys rows, and a
    # key's rows here number no more than the partitions it spans
    pieces = rows.groupBy("__part", *keys).agg(*[F.sum(n).alias(f"__p{n}") for n in sums])
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select(
        "__part",
        *[F.col(c).alias(f"__k_{c}") for c in keys],
        *[F.coalesce(F.sum(f"__p{n}").over(before), F.lit(0)).alias(f"__s{n}") for n in sums],
    )
    inside = W.partitionBy("__part", *keys).orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(n).over(inside).alias(f"__r{n}") for n in sums])
    cond = F.col("__part") == F.col("__q_part")
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = summed.join(shifts.withColumnRenamed("__part", "__q_part"), cond)
    return joined.select(
        *df.columns,
        *[(F.col(f"__r__v_{n}") + F.col(f"__s__v_{n}")).alias(n) for n in totals],
    )


def running_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based row number per key, for keys of any size (``keys=[]`` ranks the whole table)."""
    return running_totals(df, keys, order, {rank: F.lit(1).cast("long")})


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str = "rank") -> DataFrame:
    """Ties share the mean of their positions. Returns one row per (keys, value)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ran = running_totals(counts, keys, [F.col(value).asc()], {"__upto": F.col("__n")})
    return ran.select(*keys, value, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(rank))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, exact for groups of any size.

    Rows are folded to one per (key, value); each quantile is then the smallest value whose
    running count passes its position, which is a plain conditional minimum."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ran = running_totals(counts, keys, [F.col(value).asc()], {"__upto": F.col("__n")})
    total = F.col("__total")
    sized = ran.select(*keys, F.col(value).cast("double").alias("__v"), "__upto")
    if keys:
        sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
        sized = sized.join(sizes, keys)
    else:
        sized = sized.withColumn("__total", counts.agg(F.sum("__n")).scalar())
    picks, outs = [], []
    for name, p in probs.items():
        at = (total - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("__upto") > F.floor(at), F.col("__v"))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("__upto") > F.ceil(at), F.col("__v"))).alias(f"__hi_{name}"))
        part = (F.col("__t") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.coalesce(F.col(f"__hi_{name}"), F.col(f"__lo_{name}"))
        outs.append((lo + (hi - lo) * (part - F.floor(part))).alias(name))
    agg = sized.groupBy(*keys).agg(F.max("__total").alias("__t"), *picks)
    return agg.select(*keys, F.col("__t").alias("n_values"), *outs)
