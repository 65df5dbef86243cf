"""Links within buckets, and components of links: shared by the near-duplicate operators.

A bucket's rows are compared inside tasks with numpy, in groups of bounded size, and only a spanning
forest of the links found leaves a task, never all pairs of a group. A bucket larger than ``group``
is dealt into chunks, and each pair of chunks is one group, so no task holds a large bucket and no
link of it is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import saved, table_saved

#: So many hot buckets are broadcast at most; more are joined.
BROADCAST_BUCKETS = 20_000

Verify = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def forest(groups: np.ndarray, verify: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Spanning forest of the verified links between rows of equal group number; groups lie in order.

    Row i is compared with row i + 1, then i + 2 and so on, for all groups at once, but not
    with rows that are connected to it already.
    """
    n = len(groups)
    label, found = np.arange(n), []
    left, step = np.arange(n), 1
    while True:
        left = left[left + step < n]
        left = left[groups[left] == groups[left + step]]
        if not len(left):
            break
        label = _roots(label)
        a = left[label[left] != label[left + step]]
        if len(a):
            a = a[verify(a, a + step)]
        for i in a.tolist():
            x, y = i, i + step
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                found.append((i, i + step))
        step += 1
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold each group whole, with the number of each row's group. Rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), dtype=bool)
        for k in keys:
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.cumsum(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        numbers = cut(t)
        last = int(np.searchsorted(numbers, numbers[-1]))
        if last:
            yield t.slice(0, last), numbers[:last]
            held = t.slice(last).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, cut(t)


def _once(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the keys, without those that have all keys of the row before."""
    last: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = [c[0] for c in columns] != last
        last = [c[-1] for c in columns]
        yield batch if new.all() else batch.filter(pa.array(new))


def links_in_buckets(rows: DataFrame, verify: Verify, group: int = 2_048, counted: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect what ``verify`` links within a bucket.

    ``rows``: bucket bigint, node bigint and what ``verify(table, i, j)`` reads to tell which of the
    row pairs i, j are links. A node may be in many buckets; where it comes again in a bucket, one row of it is read. ``counted``: as many rows of each bucket, where they are cheaper to count.
    """
    sizes = (rows if counted is None else counted).groupBy("bucket").agg(F.count("*").alias("__n")).filter(F.col("__n") > group)
    sizes = saved(sizes.select("bucket", F.ceil(F.col("__n") / group).cast("int").alias("__m")))
    hot = sizes.count()
    if hot:
        right = F.broadcast(sizes) if hot <= BROADCAST_BUCKETS else sizes
        chunk = F.pmod(F.xxhash64("node"), F.coalesce("__m", F.lit(1))).cast("int")
        dealt = rows.join(right, "bucket", "left").withColumn("__c", chunk)
        dealt = dealt.withColumn("__d", F.explode(F.sequence(F.lit(0), F.coalesce("__m", F.lit(1)) - 1)))
        dealt = dealt.withColumn("__i", F.least("__c", "__d")).withColumn("__j", F.greatest("__c", "__d"))
    else:
        dealt = rows.withColumn("__i", F.lit(0)).withColumn("__j", F.lit(0))
    keys = ["bucket", "__i", "__j"]
    dealt = dealt.select(*keys, *[c for c in rows.columns if c != "bucket"])
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, numbers in whole_groups(_once(batches, [*keys, "node"]), keys):
            pairs = forest(numbers, lambda i, j, t=t: verify(t, i, j))
            node = t.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[pairs[:, 0]], pa.int64()), pa.array(node[pairs[:, 1]], pa.int64())], names=["a", "b"]
            )

    return dealt.mapInArrow(scan, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node of its component.

    Large star and small star in turn: each node's larger neighbours, then its smaller ones, move to
    the smallest node it sees, until nothing moves. Each round's links are saved.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = table_saved(edges), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small)
