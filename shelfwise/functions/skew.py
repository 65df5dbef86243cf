"""Join helpers for keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialize


def left_join_hot(
    left: DataFrame, right: DataFrame, key: str, hot_keys: DataFrame, spread: str
) -> DataFrame:
    """Left join where the keys in ``hot_keys`` (a bounded list) hold most left rows.

    Rows with a hot key meet a broadcast of just those right rows. They then pass the
    second join under a negative key that matches nothing (keys are not negative) and is
    spread by the hash of ``spread``, so no partition of that shuffle is hot.
    """
    cols = [c for c in right.columns if c != key]
    hot = right.join(F.broadcast(hot_keys.select(key).distinct()), key, "left_semi")
    hot = hot.select(key, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__h_{c}") for c in cols])
    step = left.join(F.broadcast(hot), key, "left").withColumn(
        "__key",
        F.when(F.col("__hot"), -1 - F.pmod(F.xxhash64(spread), F.lit(2**40))).otherwise(F.col(key).cast("long")),
    )
    cold = right.select(F.col(key).cast("long").alias("__key"), *[F.col(c).alias(f"__c_{c}") for c in cols])
    out = step.join(cold, "__key", "left")
    return out.select(
        *left.columns,
        *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(c) for c in cols],
    )


def left_join_dealt(left: DataFrame, right: DataFrame, key: str, hot_keys: DataFrame, home: str) -> DataFrame:
    """The same for left rows that are dealt by ``home`` and stay where they are.

    Hot keys (a bounded list) meet a broadcast. Of the others only the (home, key) pairs travel to ``right``, and come
    back with its columns.
    """
    cols = [c for c in right.columns if c != key]
    few = F.broadcast(hot_keys.select(key).distinct())
    hot = right.join(few, key, "left_semi").select(key, *[F.col(c).alias(f"__h_{c}") for c in cols])
    cold = left.select(home, key).join(few, key, "left_anti").distinct()
    found = cold.join(right, key).select(home, key, *[F.col(c).alias(f"__c_{c}") for c in cols]).repartition(home)
    out = left.join(F.broadcast(hot), key, "left").join(found, [home, key], "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(c) for c in cols])


#: Keys that are cut, at most; their list is broadcast.
MOST_CUT_KEYS = 100_000


def expansion_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_spread: str, right_spread: str, left_rows: int = 20_000, right_rows: int = 1_000
) -> DataFrame:
    """Inner equi-join whose heavy keys are cut on both sides.

    A key with many rows is dealt into parts of some ``left_rows`` by the hash of ``left_spread`` and blocks of
    some ``right_rows`` by the hash of ``right_spread``. A left row is copied to the blocks of its own key, a right row to
    the parts of its own, so no pair is met twice and no group holds more than a part and a block. Keys that need no cut
    pass as they are. The list of keys to cut is broadcast: a key is cut only where it holds a hundred-thousandth of a
    side at least, so it has no more than twice :data:`MOST_CUT_KEYS` rows.
    """
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "__l"), (right, "__r"))]
    sizes = materialize(counts[0].join(counts[1], keys))
    total = sizes.agg(F.sum("__l").alias("l"), F.sum("__r").alias("r"), F.max("__l").alias("ml"), F.max("__r").alias("mr")).first()
    per_left, per_right = (max(rows, -(-(total[c] or 0) // MOST_CUT_KEYS)) for c, rows in (("l", left_rows), ("r", right_rows)))
    if (total["ml"] or 0) <= per_left and (total["mr"] or 0) <= per_right:
        return left.join(right, keys)
    cut = sizes.filter((F.col("__l") > per_left) | (F.col("__r") > per_right)).select(
        *keys, F.ceil(F.col("__l") / per_left).cast("int").alias("__parts"), F.ceil(F.col("__r") / per_right).cast("int").alias("__blocks")
    )
    parts, blocks = F.coalesce("__parts", F.lit(1)), F.coalesce("__blocks", F.lit(1))

    def dealt(df: DataFrame, own: str, n: Column, spread: str, other: str, m: Column) -> DataFrame:
        met = df.join(F.broadcast(cut), keys, "left").withColumn(own, F.pmod(F.xxhash64(spread), n).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), m - 1))).drop("__parts", "__blocks")

    one = dealt(left, "__part", parts, left_spread, "__block", blocks)
    two = dealt(right, "__block", blocks, right_spread, "__part", parts)
    return one.join(two, [*keys, "__part", "__block"]).drop("__part", "__block")
