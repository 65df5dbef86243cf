"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked where at most ``distance`` bits differ.

Pigeonhole blocks: the 64 bits are cut into ``distance + 3`` blocks. Two fingerprints that differ in at most
``distance`` bits agree in at least three blocks, so they meet in a bucket of one of the tables,
one for each choice of three blocks (about 32 bits); there the Hamming distance is verified.
Only distinct fingerprints are compared.

Null text and texts without a word have fingerprint zero and link like any other. Repeated rows and
equal texts share a fingerprint, and so a component. A null doc_id takes part but names no
component unless all ids there are null. An empty table gives an empty result.

``keep_one_similar`` has another rule: texts are near copies where the Jaccard similarity of their word shingles is
``similarity`` or more. Some ten of 64 bits differ at 0.8, beyond any radius that blocks of one fingerprint reach with
high recall, so texts within ``distance`` bits and texts that share a MinHash band of the same shingles are candidates. What
candidates connect is one bucket, to which each text's shingles go once; there the exact similarity of the candidates is
verified. A pair at just the least similarity is a candidate with a probability of ``recall`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import popcount, saved, small_batches, strings, text_or_empty
from shelfwise.llm.links import components, links_in_buckets

SEED = 42
DISTANCE = 3
BLOCK = 1 << 16  # shingles whose bits are counted at once
#: The places of candidates are broadcast if they are no more than so many, some 20 MB; else they are joined.
BROADCAST_TEXTS = 400_000


@dataclass(frozen=True)
class NearCopies:
    words: int = 5
    similarity: float = 0.8
    recall: float = 0.999  # of pairs that are just similar enough
    rows: int = 4  # hashes in a band
    distance: int = DISTANCE

    @property
    def bands(self) -> int:
        """The fewest bands with the recall asked for at the least similarity."""
        return int(np.ceil(np.log(1 - self.recall) / np.log(1 - self.similarity**self.rows)))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the word shingles in order; a shorter text is one shingle."""
    w = text.lower().split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype="<u8")


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes."""
    return _majority(shingle_hashes(text, words)) if text.split() else 0


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(h), BLOCK):
        part = h[start : start + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row, saved."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fp = pa.array([fingerprint(t, words) for t in strings(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=["doc_id", "text_hash", "fp"])

    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), "text")
    return saved(slim.mapInArrow(scan, "doc_id bigint, text_hash bigint, fp bigint"))


def _buckets(fp: Column, distance: int) -> Column:
    """One bucket number for each table: three blocks of the fingerprint and the number of the table."""
    n = distance + 3
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = []
    for low, high in pairwise(edges):
        mask = (1 << (high - low)) - 1
        blocks.append((F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(mask).cast("long")), high - low))
    keys = []
    for number, chosen in enumerate(combinations(blocks, 3)):
        key = F.lit(number).cast("long")
        for block, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(block)
        keys.append(key)
    return F.array(*keys)


def close_fingerprints(fps: DataFrame, distance: int = DISTANCE, group: int = 2_048) -> DataFrame:
    """Links (a, b) that connect fingerprints, given as distinct ``fp``, with at most ``distance`` differing bits."""
    rows = fps.select(F.explode(_buckets(F.col("fp"), distance)).alias("bucket"), F.col("fp").alias("node"))

    def verify(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fp = t.column("node").to_numpy().view(np.uint64)
        return popcount(fp[i] ^ fp[j]) <= distance

    return links_in_buckets(rows, verify, group)


def component_of_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component_id, keeper): the smallest doc_id of the component, and (no id, id, text hash) of the row to keep."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    nodes = saved(prints.groupBy("fp").agg(first.alias("first")))
    linked = components(close_fingerprints(nodes.select("fp"), distance))
    rooted = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    return rooted.join(keepers, "root").select("fp", F.col("keeper.doc_id").alias("component_id"), "keeper")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = fingerprints(docs, words)
    return prints.join(component_of_fingerprints(prints, distance), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id."""
    prints = fingerprints(docs, words)
    return _only(docs, component_of_fingerprints(prints, distance).select("keeper.*").distinct())


def _only(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keepers`` names by doc_id and text_hash, once each."""
    keepers = keepers.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("__id", F.col("row.doc_id").cast("bigint"))
    rows = rows.withColumn("__hash", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    kept = rows.alias("r").join(
        keepers.alias("k"), F.col("r.__id").eqNullSafe(F.col("k.__id")) & (F.col("r.__hash") == F.col("k.__hash")), "left_semi"
    )
    return kept.dropDuplicates(["__id", "__hash"]).select("row.*")


def _seeds(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"band", k) | 1 for k in range(n)], dtype=np.uint64)


def band_keys(h: np.ndarray, seeds: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of MinHashes of the shingle hashes."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(h), 4_096):
        np.minimum(least, np.multiply.outer(seeds, h[start : start + 4_096]).min(axis=1), out=least)
    parts = least.reshape(bands, -1)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, how: NearCopies) -> DataFrame:
    """(doc_id, text_hash, fp, keys) of every row, saved."""
    seeds, bands, words = _seeds(how.rows * how.bands), how.bands, how.words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps, keys = [], []
            for text in strings(batch.column(2)):
                h = shingle_hashes(text, words)
                fps.append(_majority(h))
                keys.append(band_keys(h, seeds, bands))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "fp", "keys"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    return saved(slim.mapInArrow(scan, "doc_id bigint, text_hash bigint, fp bigint, keys array<bigint>"))


def similar_texts(docs: DataFrame, nodes: DataFrame, how: NearCopies, group: int = 512) -> DataFrame:
    """(node, root) of the texts that are linked to others. ``nodes``: node, first (its row), fp, keys."""
    rows = nodes.select(F.explode("keys").alias("bucket"), "node")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    stars = rows.join(shared.select("bucket", "low"), "bucket").select(F.col("node").alias("a"), F.col("low").alias("b"))
    prints = nodes.groupBy("fp").agg(F.min("node").alias("low"))
    close = close_fingerprints(prints.select("fp"), how.distance)
    name = lambda c: prints.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"))
    close = close.join(name("a"), "a").join(name("b"), "b").select(F.col("a_low").alias("a"), F.col("b_low").alias("b"))
    equal = nodes.join(prints, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    met = components(stars.unionByName(close).unionByName(equal)).withColumnRenamed("root", "bucket")
    wanted = saved(met.join(nodes, "node").select("first", "bucket", "fp", "keys"))
    wanted = wanted.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("node"), "bucket", "fp", "keys")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"))
    few = wanted.count() <= BROADCAST_TEXTS
    places = wanted.select("__id", "node", "bucket")
    met_texts = texts.join(
        F.broadcast(places) if few else places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("node"))
    )
    words, similarity, distance, bands = how.words, how.similarity, how.distance, how.bands

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = met_texts.select("node", "text").mapInArrow(read, "node bigint, shingles array<bigint>").dropDuplicates(["node"])

    def verify(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fp = t.column("fp").to_numpy().view(np.uint64)
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, bands)
        out = (popcount(fp[i] ^ fp[j]) <= distance) | (keys[i] == keys[j]).any(axis=1)
        column = t.column("shingles").combine_chunks()
        edge, flat = column.offsets.to_numpy(), column.values.to_numpy()
        for k in np.flatnonzero(out).tolist():
            x, y = flat[edge[i[k]] : edge[i[k] + 1]], flat[edge[j[k]] : edge[j[k] + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[k] = both >= similarity * (len(x) + len(y) - both) - 1e-12
        return out

    full = wanted.select("bucket", "node", "fp", "keys").join(sets, "node").select("bucket", "node", "fp", "keys", "shingles")
    return components(links_in_buckets(full, verify, group))


def keep_one_similar(docs: DataFrame, how: NearCopies = NearCopies()) -> DataFrame:
    """The rows of ``docs``, one of each component of near copies: that with the smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = sketches(docs, how).groupBy(F.col("text_hash").alias("node")).agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = saved(nodes)
    rooted = nodes.join(similar_texts(docs, nodes, how), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    return _only(docs, rooted.groupBy("root").agg(F.min("first").alias("keeper")).select("keeper.*"))
