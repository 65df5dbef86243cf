"""Histogram sort: rows go to shards that are ranges of one key and hold nearly equal bytes, in SQL functions only.

The key is (62 bits of the text's hash, id, part), so equal texts stand side by side and a shard border
falls inside a group of them only where the group is too large for the tolerance. A table of
(hash, id, part, size) is saved once. Each round counts the exact bytes below evenly spaced probes within
every open bracket, and narrows the brackets, until each border is within ``tolerance`` of its
target or lies between two neighbouring keys. Only the counts of the probes reach the driver, a
number that depends on the shards and not on the rows. Whole rows are then exchanged once.

``part`` is 0 but for rows that share text and id with so many others that together they weigh more than the
tolerance or a block. Those rows, and no others, are saved whole with a number of their own, so that borders
and blocks can cut such a group too.

Null text: no bytes, as the empty text. Null id: sorts below all others. Rows with the same text and id
are told apart by ``part`` alone, so which of them goes where is open; each has a slot of its own. Very long texts:
a row is never cut, so a shard's bytes may be off by one row. An empty table gives an empty result.
Other columns are carried along in ``row`` and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import saved

TOP = 1 << 62
LOWEST_ID = -(1 << 63)
#: Groups of equal rows to be numbered that are sent to every task, some 16 bytes each; more are joined.
BROADCAST_GROUPS = 1 << 18


@dataclass(frozen=True)
class Sharding:
    shards: int = 24
    tolerance: float = 0.002  # of a shard's bytes
    probes: int = 64  # in each open bracket and round
    block_bytes: int = 16 << 20  # a shard is sorted and numbered in blocks of about so many bytes
    overhead: int = 8  # bytes a row counts besides its text


@dataclass
class Bracket:
    """Keys from ``low`` up to, not with, ``high``, and the bytes below each of the two."""

    low: int
    high: int
    below_low: int
    below_high: int


def _tree(value: Column, cuts: list, at: int = 0) -> Column:
    """Number of cuts at or below the value, by nested conditions as deep as the logarithm of their number."""
    if not cuts:
        return F.lit(at)
    mid = len(cuts) // 2
    return F.when(value < F.lit(cuts[mid]), _tree(value, cuts[:mid], at)).otherwise(_tree(value, cuts[mid + 1 :], at + mid + 1))


def _count(keys: DataFrame, value: Column, brackets: list[Bracket], probes: int) -> dict[int, list[Bracket]]:
    """For each bracket by its low end: the filled cells between its probes, in order, cut down to the keys they hold."""
    edges = sorted({e for b in brackets for e in (b.low, b.high)})
    widths = {b.low: max(1, -(-(b.high - b.low) // probes)) for b in brackets}
    k = F.col("k")
    number = F.lit(None).cast("bigint")
    for i, edge in enumerate(edges):
        if edge in widths:
            far, step = F.lit(edge).cast("decimal(20,0)"), F.lit(widths[edge]).cast("decimal(20,0)")
            inside = F.floor((k.cast("decimal(20,0)") - far) / step).cast("bigint")
            number = F.when(F.col("slot") == i, inside).otherwise(number)
    cells = keys.select(value.alias("k"), "size").withColumn("slot", _tree(k, edges) - 1)
    cells = cells.select("slot", number.alias("cell"), "size", "k")
    got = cells.filter("cell is not null").groupBy("slot", "cell").agg(
        F.sum("size").alias("bytes"), F.min("k").alias("first"), F.max("k").alias("last")
    )
    sums = {(r["slot"], r["cell"]): r for r in got.collect()}
    out = {}
    for b in brackets:
        i, below = edges.index(b.low), b.below_low
        out[b.low] = []
        for cell in range(probes):
            if found := sums.get((i, cell)):
                out[b.low].append(Bracket(found["first"], found["last"] + 1, below, below + found["bytes"]))
                below += found["bytes"]
    return out


def _refine(
    keys: DataFrame, value: Column, whole: Bracket, targets: list[float], slack: float, probes: int
) -> dict[float, tuple[int, Bracket]]:
    """Narrow the bracket of each target until an end is close enough or it holds one key.

    Returns for each target the end next to it, and the bracket.
    """
    done: dict[float, tuple[int, Bracket]] = {}
    open_ = {t: whole for t in targets}
    first = probes * max(1, len(targets))
    while open_:
        distinct = {b.low: b for b in open_.values()}
        counted = _count(keys, value, list(distinct.values()), first)
        first = probes
        for t, b in list(open_.items()):
            c = next(c for c in counted[b.low] if c.below_high >= t)
            under, over = t - c.below_low, c.below_high - t
            if min(under, over) <= slack or c.high - c.low == 1:
                done[t] = (c.low if under <= over else c.high, c)
                del open_[t]
            else:
                open_[t] = c
    return done


def keyed(docs: DataFrame, overhead: int) -> DataFrame:
    """Whole rows as ``row``, with hash, id and size."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("hash"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST_ID)).alias("id"),
        (F.octet_length(text) + overhead).cast("bigint").alias("size"),
    )


def with_parts(rows: DataFrame, how: Sharding) -> tuple[DataFrame, DataFrame]:
    """The rows with ``part``, and their saved table (hash, id, part, size).

    The groups to be numbered are at most ``shards / tolerance``, or one for each ``block_bytes``, whichever is more.
    """
    plain = saved(rows.select("hash", "id", "size"))
    total = plain.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    limit = min(how.block_bytes, how.tolerance * total / how.shards)
    groups = plain.groupBy("hash", "id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    heavy = saved(groups.filter((F.col("n") > 1) & (F.col("bytes") > limit)).select("hash", "id"))
    n_heavy = heavy.count()
    none = F.lit(0).cast("bigint")
    if not n_heavy:
        return rows.withColumn("part", none), plain.withColumn("part", none)
    if n_heavy <= BROADCAST_GROUPS:
        heavy = F.broadcast(heavy)
    numbered = saved(rows.join(heavy, ["hash", "id"], "left_semi").withColumn("part", F.monotonically_increasing_id()))
    light = rows.join(heavy, ["hash", "id"], "left_anti").withColumn("part", none)
    keys = plain.join(heavy, ["hash", "id"], "left_anti").withColumn("part", none)
    return light.unionByName(numbered), saved(keys.unionByName(numbered.select("hash", "id", "size", "part")))


def borders(keys: DataFrame, how: Sharding) -> tuple[list[tuple[int, int, int]], int]:
    """The keys (hash, id, part) at which shards 1, 2, ... begin, and the total of bytes."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    if not total:
        return [], 0
    targets = [total * j / how.shards for j in range(1, how.shards)]
    slack = how.tolerance * total / how.shards
    whole = Bracket(0, TOP, 0, total)
    cuts = _cut(keys, ["hash", "id", "part"], [0, LOWEST_ID, 0], whole, targets, slack, how.probes)
    return [cuts[t] for t in targets], total


def _cut(
    keys: DataFrame, columns: list[str], lowest: list[int], whole: Bracket, targets: list[float], slack: float, probes: int
) -> dict[float, tuple[int, ...]]:
    """The key at which each target's border lies: by the first column, and inside one of its values by the others."""
    first, rest = columns[0], columns[1:]
    cuts: dict[float, tuple[int, ...]] = {}
    inside: dict[int, tuple[Bracket, list[float]]] = {}  # at most one value for each border
    for t, (border, b) in _refine(keys, F.col(first), whole, targets, slack, probes).items():
        if rest and b.high - b.low == 1 and min(t - b.below_low, b.below_high - t) > slack:
            inside.setdefault(b.low, (b, []))[1].append(t)
        else:
            cuts[t] = (border, *lowest[1:])
    for value, (b, within) in inside.items():
        same = keys.filter(F.col(first) == value)
        ends = same.agg(F.min(rest[0]).alias("low"), F.max(rest[0]).alias("high")).first()
        bracket = Bracket(ends["low"], ends["high"] + 1, b.below_low, b.below_high)
        for t, key in _cut(same, rest, lowest[1:], bracket, within, slack, probes).items():
            cuts[t] = (value + 1, *lowest[1:]) if key[0] > ends["high"] else (value, *key)
    return cuts


def _below(cut: tuple[int, int, int]) -> Column:
    h, i, p = (F.lit(v) for v in cut)
    same_id = (F.col("id") == i) & (F.col("part") < p)
    return (F.col("hash") < h) | ((F.col("hash") == h) & ((F.col("id") < i) | same_id))


def _shard(cuts: list[tuple[int, int, int]], at: int = 0) -> Column:
    if not cuts:
        return F.lit(at)
    mid = len(cuts) // 2
    return F.when(_below(cuts[mid]), _shard(cuts[:mid], at)).otherwise(_shard(cuts[mid + 1 :], at + mid + 1))


def shard(docs: DataFrame, how: Sharding = Sharding()) -> DataFrame:
    """Whole rows as ``row``, each with ``size``, ``shard`` and ``slot`` (gapless from 0 in a shard).

    A shard is cut into blocks by a hash of the key. The slots of a block begin behind those of the blocks
    before it and follow the key inside, so that no task sorts a whole shard.
    """
    rows, keys = with_parts(keyed(docs, how.overhead), how)
    cuts, total = borders(keys, how)
    blocks = max(1, ceil(total / how.shards / how.block_bytes))
    block = F.pmod(F.xxhash64("id", "hash", "part"), F.lit(blocks)).cast("int")
    counts = keys.groupBy(_shard(cuts).alias("shard"), block.alias("block")).agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("shard", _shard(cuts)).withColumn("block", block)
    order = W.partitionBy("shard", "block").orderBy("hash", "id", "part")
    numbered = rows.withColumn("nth", F.row_number().over(order).cast("bigint"))
    placed = numbered.join(offsets, ["shard", "block"])
    return placed.select("row", "size", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
