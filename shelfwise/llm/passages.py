"""Substring dedup: paragraphs that repeat across documents, found by MinHash banding and verified.

Two kinds of paragraph are compared. Lines of at least ``least_words`` words, which is one shingle, and blocks of lines
between blank lines, so that hard-wrapped paragraphs are whole, get MinHash signatures
of their five-word shingles; lines that share a band meet in a bucket, where the exact Jaccard
similarity of their shingle sets is verified, and what is linked forms components. A passage that was
pasted inside a line has no line of its own, so windows of ``window`` words are taken as paragraphs
too: winnowing picks in every text the window with the least hash among ``window`` neighbours, so two texts
that share a run of ``2 * window - 1`` words or more pick the same window within it. Windows are compared by
a 96-bit hash of their words, ASCII letters in lower case. Windows that repeat are seeds: each grows on either side, word by
word and by up to ``window - 1`` words, as far as another document goes on alike, so no outer word of such a run is left.

In each component the occurrence with the smallest (doc_id, start) stays, and those in other documents are to be
removed. Overlapping removals of a document are merged. Positions are code points.

Null, empty or shorter texts have no paragraphs. A document is a doc_id with a text: repeated rows count as
one, different texts under one doc_id or without one as several; paragraphs that repeat only within a document stay. A null doc_id counts as
less than all others. Ties of two texts under one id are decided by the hash of the text. Long texts are read whole. An empty table gives an empty
result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import sized_batches, small_batches, strings, table_dropped, table_saved
from shelfwise.llm.links import components, links_in_buckets, whole_groups

NO_ID, _LAST = -(1 << 63), (1 << 63) - 1
#: The places of colliding lines are broadcast if they are no more than so many, some 20 MB; else they are joined.
BROADCAST_LINES = 400_000
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Passages:
    shingle: int = 5
    similarity: float = 0.8
    recall: float = 0.99  # of line pairs that are just similar enough
    rows: int = 2  # hashes in a band
    least_words: int = 5
    window: int = 25

    @property
    def least_banded(self) -> int:
        """Shingles from which on a line has bands. Of two different sets of which the larger has n, n - 1 are common at best; below this
        number lines are similar enough only if their sets are equal. Then the lines are equal, and so are their hashes, unless a word
        comes twice in them."""
        n = 1
        while n - 1 < self.similarity * n - 1e-9:
            n += 1
        return n - 1

    @property
    def bands(self) -> int:
        """The fewest bands with the recall asked for at the least similarity."""
        return int(np.ceil(np.log(1 - self.recall) / np.log(1 - self.similarity**self.rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    if n == 1:
        return h
    if n % 2:
        return _runs(h, n - 1, base)[:-1] * base + h[n - 1 :]
    half = _runs(h, n // 2, base)
    return half[: -n // 2] * _power(base, n // 2) + half[n // 2 :]


def rolling(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of n word hashes: a polynomial in ``base``, by halving."""
    return _mix(_runs(h, n, base)) if len(h) >= n else np.empty(0, dtype=np.uint64)


@cache
def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def values_at(h: np.ndarray, at: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """What :func:`rolling` holds at some positions."""
    powers = np.array([_power(base, n - 1 - k) for k in range(n)])
    return _mix((h[at[:, None] + np.arange(n)] * powers).sum(axis=1, dtype=np.uint64))


def _laid(start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges behind one another: the positions in them, each one's place in its range, and where the ranges begin."""
    cut = np.cumsum(many) - many
    order = np.arange(many.sum()) - np.repeat(cut, many)
    return np.repeat(start, many) + order, order.astype(np.uint64), cut


def _sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every n neighbours."""
    pick, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def winnowed(h: np.ndarray, n: int) -> np.ndarray:
    """Positions that hold the least hash of some n neighbours (of all, if they are fewer)."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    n = min(n, len(h))
    least = _sliding(h, n, True)
    pad = np.zeros(n - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), n, False) == h)


def sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else np.append(x[:1], x[1:][new])


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share. The smaller is looked up in the larger."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.count_nonzero(x.take(x.searchsorted(y), mode="clip") == y))


@dataclass
class Words:
    """Word hashes of a text with the code points where words start and end, and the line of each."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray


def word_hashes(text: bytes) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, text.lower().split())), dtype=np.uint64)


def words_of(text: bytes) -> Words:
    raw = np.frombuffer(text, dtype=np.uint8)
    space = np.concatenate([[True], _SPACES[raw], [True]])
    first, last = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return Words(word_hashes(text), points[first], points[last], np.cumsum(raw == 10)[first] if len(raw) else first)


def line_bounds(w: Words, least: int) -> list[tuple[int, int]]:
    """(first word, word behind the last) of the lines with enough words."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(w.line)) + 1, [len(w.line)]])
    return [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a >= least]


def block_bounds(w: Words, least: int) -> list[tuple[int, int]]:
    """The same of the blocks of lines between blank lines; where one line has 95 % of a block's words, it stands for the block."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(w.line) > 1) + 1, [len(w.line)]])
    blocks = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a >= least and w.line[a] < w.line[b - 1]]
    return [(a, b) for a, b in blocks if 100 * np.bincount(w.line[a:b] - w.line[a]).max() < 95 * (b - a)]


_PATHS = "id bigint, own bigint, no bigint, left boolean, hash bigint, proof int, edge int, path binary, places array<int>"
_SPOT = ("at", "words")
_NO_BOUNDS = np.empty((0, 2), dtype=np.int64)


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _BASES[0]) | np.uint64(1)


def _doc(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def _key(docs: DataFrame) -> DataFrame:
    """(doc, text): the texts that are not null with their document, that is id and hash of the text."""
    return docs.filter("text is not null").select(F.struct(_doc().alias("id"), F.xxhash64("text").alias("own")).alias("doc"), "text")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows out of a task, with ``id`` and ``own`` put together again."""
    return rows.select(F.struct("id", "own").alias("doc"), *[c for c in rows.columns if c not in ("id", "own")])


def paragraphs(docs: DataFrame, how: Passages) -> tuple[DataFrame, DataFrame]:
    """(lines, windows) of all documents, saved. A text is read once for both."""
    seeds, shingle, window, least, rows, bands = _seeds(how.rows * how.bands), how.shingle, how.window, how.least_words, how.rows, how.bands
    least_banded = how.least_banded

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, 1, 128):
            # the words of all texts of the batch in a row, so that hashes are made in few calls
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            read = [words_of(t or b"") for t in texts]
            counts = np.array([len(w.hashes) for w in read])
            base = np.cumsum(counts) - counts
            h, start, end = (np.concatenate([getattr(w, c) for w in read]) for c in ("hashes", "start", "end"))
            a, s = rolling(h, window, _BASES[0]), rolling(h, shingle, _BASES[0])
            picked, bounds = [], []
            for w, first, n in zip(read, base.tolist(), counts.tolist(), strict=True):
                picked.append(winnowed(a[first : max(first, first + n - window + 1)], window))
                bounds.append(np.array(block_bounds(w, least) + line_bounds(w, least), dtype=np.int64).reshape(-1, 2) if n >= least else _NO_BOUNDS)
            owner = [np.repeat(np.arange(len(read)), list(map(len, x))) for x in (picked, bounds)]
            at, ends = np.concatenate(picked), np.concatenate(bounds)
            spot, ends = at + base[owner[0]], ends + base[owner[1]][:, None]
            proof = (values_at(h, spot, window, _BASES[1]) >> np.uint64(33)).astype(np.int32)
            many = ends[:, 1] - ends[:, 0] - shingle + 1
            has_bands = many >= least_banded
            for i in np.flatnonzero(~has_bands).tolist():
                first, last = ends[i].tolist()
                has_bands[i] = len(set(h[first:last].tolist())) < last - first
            inside, order, cut = _laid(ends[:, 0], many)
            inside = s[inside]
            # the whole line's hash: its shingles in order
            node = np.add.reduceat(_mix(inside + order * _BASES[1]), cut) if len(ends) else np.empty(0, dtype=np.uint64)
            some, size = inside[np.repeat(has_bands, many)], many[has_bands]
            key = np.zeros((len(size), bands), dtype=np.uint64)
            if len(size):
                begin = np.cumsum(size) - size
                sign = np.stack([np.minimum.reduceat(_mix(some * k), begin) for k in seeds], axis=1)
                band = sign.reshape(len(size), bands, rows)
                for r in range(rows):
                    key = _mix(key * _BASES[1] + band[:, :, r])
                key = _mix(key + np.arange(bands, dtype=np.uint64) * _BASES[0])
            where, no_spot = np.concatenate(owner), np.zeros(len(ends), dtype=np.int32)
            keys = pa.ListArray.from_arrays(
                pa.array(np.concatenate([np.zeros(len(at) + 1, dtype=np.int32), np.cumsum(has_bands * bands)]).astype(np.int32)),
                pa.array(key.ravel().view(np.int64)), mask=pa.array(np.arange(len(where)) < len(at)),
            )
            ids = [c.take(pa.array(where)) for c in batch.column(0).flatten()]
            flat = [
                np.concatenate([start[spot], start[ends[:, 0]]]).astype(np.int32), np.concatenate([end[spot + window - 1], end[ends[:, 1] - 1]]).astype(np.int32),
                np.concatenate([a[spot], node]).view(np.int64), np.concatenate([proof, no_spot]),
                np.concatenate([at.astype(np.int32), no_spot]), np.concatenate([counts[owner[0]].astype(np.int32), no_spot]),
            ]
            is_line = pa.array(np.arange(len(where)) >= len(at))
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, flat), keys, is_line], names=["id", "own", "start", "end", "node", "proof", *_SPOT, "keys", "is_line"])

    schema = "id bigint, own bigint, start int, end int, node bigint, proof int, at int, words int, keys array<bigint>, is_line boolean"
    # in two folders, so that who reads the lines does not read the windows
    both = _keyed(table_saved(_key(docs).mapInArrow(scan, schema), compression="zstd", by="is_line"))
    lines = both.filter("is_line").select("doc", "start", "end", "node", "keys")
    return lines, both.filter("not is_line").select("doc", "start", "end", F.col("node").alias("hash"), "proof", *_SPOT)


def repeated(windows: DataFrame) -> DataFrame:
    """The windows that two or more documents hold, saved: all that later steps read."""
    mark = F.xxhash64("doc")
    groups = windows.groupBy("hash").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high").select("hash")
    hits = windows.join(groups, "hash", "left_semi").select("doc", "start", "end", "at", "words", "hash", "proof")
    return table_saved(hits, compression="zstd")


def grown(docs: DataFrame, hits: DataFrame, how: Passages) -> DataFrame:
    """(doc, start, end, keeper, removed) of repeated windows with 1 to ``window - 1`` words more on one side.

    A side of a window is looked at in all documents if in one of them repeated windows do not cover
    it already, so the inner windows of a passage do not take part. Of a side only two stretches are told: the longest that an
    earlier document has too, and the longest of those that no earlier one but a later one has. The keeper
    of the former is that of the window or a later one, so it is left null.
    """
    size, reach, pair = how.window, how.window - 1, ["hash", "proof"]

    def islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether a window may be grown on either side: repeated windows that overlap or touch are an island, and only its ends are looked at."""
        for t, numbers in whole_groups(batches, ["id", "own"]):
            at, words = (t.column(c).to_numpy().astype(np.int64) for c in _SPOT)
            fresh = np.append(True, (numbers[1:] != numbers[:-1]) | (at[1:] > at[:-1] + size))
            starts, island = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            first, last = at[starts][island], (at[np.append(starts[1:], len(at)) - 1] + size)[island]
            left = (first > 0) & (at - reach < first)
            right = (last < words) & (at + size + reach > last)
            kept = [t.column(c).combine_chunks() for c in ("id", "own", "at", *pair)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(left), pa.array(right)], names=["id", "own", "at", *pair, "left", "right"])

    spots = hits.select("doc.id", "doc.own", *_SPOT, *pair).repartition("id", "own").sortWithinPartitions("id", "own", "at")
    spots = spots.mapInArrow(islands, "id bigint, own bigint, at int, hash bigint, proof int, left boolean, right boolean")
    spots = _keyed(table_saved(spots, compression="zstd"))
    sides = spots.groupBy(*pair).agg(F.max("left").alias("left"), F.max("right").alias("right")).filter("left or right")
    wanted = spots.drop("left", "right").join(sides, pair).groupBy("doc").agg(F.collect_list(F.struct("at", "left", "right", *pair)).alias("spans"))
    # numbers in the order of the documents
    wanted = table_saved(wanted.orderBy("doc").withColumn("no", F.monotonically_increasing_id()))
    if (wanted.agg(F.sum(F.size("spans")).alias("n")).first()["n"] or 0) <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    steps = np.arange(1, size)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            out: list[tuple[np.ndarray, ...]] = []
            # the spans of all documents of the batch behind one another
            spans = batch.column(4)
            flat = dict(zip(("at", "left", "right", *pair), (c.to_numpy(zero_copy_only=False) for c in spans.flatten().flatten()), strict=True))
            ends = np.cumsum(spans.value_lengths().to_numpy()).tolist()
            rows = zip(*[c.to_pylist() for c in batch.columns[:3]], strings(batch.column(3)), [0, *ends], ends, strict=False)
            for doc, own, no, text, first, last in rows:
                w = words_of(text)
                for side in ("left", "right"):
                    spot = first + np.flatnonzero(flat[side][first:last])
                    if not len(spot):
                        continue
                    at, seed, proof = (flat[c][spot].astype(np.int64) for c in ("at", *pair))
                    word = at[:, None] - steps if side == "left" else at[:, None] + reach + steps
                    inside = (word >= 0) & (word < len(w.hashes))
                    many = inside.sum(axis=1)
                    word, some = word[inside], many > 0
                    edge = w.end[at + reach] if side == "left" else w.start[at]
                    n = int(some.sum())
                    out.append((
                        np.full(n, doc), np.full(n, own), np.full(n, no), np.full(n, side == "left"), seed[some], proof[some].astype(np.int32),
                        edge[some].astype(np.int32), many[some], (w.hashes[word] >> np.uint64(32)).astype(np.uint32),
                        (w.start if side == "left" else w.end)[word].astype(np.int32),
                    ))
            if out:
                *flat, many, path, places = (np.concatenate(c) for c in zip(*out, strict=True))
                cut = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                paths = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(cut * np.int32(4)), pa.py_buffer(path)])
                places = pa.ListArray.from_arrays(pa.array(cut), pa.array(places))
                names = ["id", "own", "no", "left", "hash", "proof", "edge", "path", "places"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, flat), paths, places], names=names)

    found = _key(docs).join(wanted, "doc").select("doc.id", "doc.own", "no", "text", "spans").mapInArrow(read, _PATHS)
    found = table_saved(_keyed(found).withColumn("way", F.xxhash64("proof", "left", "path")), compression="zstd")
    # documents that go on alike are one way; only where several begin with the same word are they looked at word by word
    ways = found.groupBy("hash", "way", "proof", "left", "path").agg(F.min("no").alias("low"), F.max("no").alias("high"))
    ways = table_saved(ways.withColumn("n", F.expr("cast(octet_length(path) / 4 as int)")).withColumn("head", F.expr("substring(path, 1, 4)")), compression="zstd")
    window = ["hash", "proof", "left", "head"]
    forks = ways.groupBy(*window).agg(F.min("way").alias("a"), F.max("way").alias("b")).filter("a <> b").select(*window)
    plain = ways.join(forks, window, "left_anti").filter("low <> high").select("hash", "way", "low", F.col("n").alias("any"), F.lit(0).alias("lower"))
    prefix = F.xxhash64("proof", "left", F.expr("substring(path, 1, 4 * k)"))
    steps_of = ways.join(forks, window, "left_semi").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    steps_of = steps_of.select("hash", prefix.alias("step"), "way", "k", "low", "high")
    common = steps_of.groupBy("hash", "step").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first <> last")
    forked = steps_of.join(common, ["hash", "step"]).groupBy("hash", "way").agg(
        F.min("low").alias("low"), F.max("k").alias("any"), F.coalesce(F.max(F.when(F.col("first") < F.col("low"), F.col("k"))), F.lit(0)).alias("lower")
    )
    # saved, so that the prefixes' exchange is gone before the ways are looked up
    met = found.join(table_saved(plain.unionByName(forked)), ["hash", "way"])
    lowest = F.col("no") == F.col("low")
    both = F.array(
        F.struct(F.when(lowest, F.col("lower")).otherwise(F.col("any")).alias("k"), F.lit(True).alias("removed")),
        F.struct(F.when(lowest & (F.col("any") > F.col("lower")), F.col("any")).otherwise(0).alias("k"), F.lit(False).alias("removed")),
    )
    far = F.get("places", F.col("x.k") - 1)
    return met.select("doc", "left", "edge", "places", F.explode(both).alias("x")).filter("x.k > 0").select(
        "doc", F.when(F.col("left"), far).otherwise(F.col("edge")).alias("start"), F.when(F.col("left"), F.col("edge")).otherwise(far).alias("end"),
        F.when(~F.col("x.removed"), F.col("doc")).alias("keeper"), "x.removed",
    )


def _occurrences(found: DataFrame, by: list[str]) -> DataFrame:
    """(doc, start, end, keeper) of the paragraphs that two or more documents hold, ``by`` telling what is equal."""
    first = F.min(F.struct("doc", "start"))
    groups = found.groupBy(*by).agg(first.alias("first"), F.max("doc").alias("last")).filter("first.doc <> last")
    return found.join(groups, by).select("doc", "start", "end", F.col("first.doc").alias("keeper"))


def similar_lines(docs: DataFrame, lines: DataFrame, how: Passages, group: int = 512) -> DataFrame:
    """(node, root) of the lines that are linked to others that are not equal to them."""
    # equal lines are one node, however many documents hold them
    names = [f"key_{i}" for i in range(how.bands)]
    rows = lines.filter(F.size("keys") > 0).select("node", *[F.get("keys", F.lit(i)).alias(c) for i, c in enumerate(names)])
    rows = rows.groupBy("node").agg(*[F.min(c).alias(c) for c in names]).select(F.explode(F.array(*names)).alias("bucket"), "node")
    # one exchange for the count and for what is taken by it; the join would ask for buckets that are not null on one side alone
    rows = rows.filter("bucket is not null").repartition("bucket")
    # buckets with the same nodes, as near copies have in most bands, are compared once
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark_{i}") for i in range(2)]
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), *marks).filter("n > 1").groupBy("n", "mark_0", "mark_1").agg(F.min("bucket").alias("bucket"))
    met = table_saved(rows.join(shared.select("bucket"), "bucket", "left_semi"))
    # a node is in no more buckets than there are bands
    held_in = met.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    wanted = lines.join(held_in, "node").groupBy("node").agg(F.min(F.struct("doc", "start", "end")).alias("at"), F.first("buckets").alias("buckets"))
    wanted = wanted.groupBy("at.doc").agg(F.collect_list(F.struct("node", "at.start", "at.end", "buckets")).alias("spans"))
    wanted = table_saved(wanted.select("doc", "spans"))
    texts = _key(docs)
    if (wanted.agg(F.sum(F.size("spans")).alias("n")).first()["n"] or 0) <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    shingle, similarity = how.shingle, how.similarity

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            buckets, nodes, lines = [], [], []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for x in spans:
                    buckets += x["buckets"]
                    nodes += [x["node"]] * len(x["buckets"])
                    lines += [text[x["start"] : x["end"]]] * len(x["buckets"])
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], names=["bucket", "node", "line"])

    # lines travel as texts, which are smaller than their shingles' hashes, and once: from their document to their buckets
    found = texts.join(wanted, "doc").select("text", "spans").mapInArrow(read, "bucket bigint, node bigint, line string")
    held: list = [None, None]

    def verify(t: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if held[0] is not t:
            hashes = [word_hashes(x) for x in strings(t.column("line"))]
            every, at, sets = rolling(np.concatenate(hashes), shingle, _BASES[0]), 0, []
            for own in hashes:
                sets.append(sorted_set(every[at : at + len(own) - shingle + 1]))
                at += len(own)
            held[:] = t, sets
        sets, out = held[1], np.zeros(len(i), dtype=bool)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = sets[a], sets[b]
            both = common(x, y) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 else 0
            out[k] = both >= similarity * (len(x) + len(y) - both) - 1e-12
        return out

    return components(links_in_buckets(found, verify, group, met))


def repeats(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """(doc_id, text_hash, start, end, component_id, removed): the repeated stretches of each document.

    ``component_id`` is the doc_id whose occurrence stays, the smallest where several meet in a
    stretch; ``removed`` is false for the occurrences that stay.
    """
    lines, windows = paragraphs(docs, how)
    linked = similar_lines(docs, lines, how)
    rooted = lines.select("doc", "start", "end", "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # saved one after the other, so that the exchanges of one are gone before the next begins
    in_lines = table_saved(_occurrences(rooted, ["root"]), compression="zstd")
    hits = repeated(windows)
    table_dropped(lines)  # and the windows with them: nothing reads them from here on
    found = in_lines.unionByName(_occurrences(hits, ["hash", "proof"]))
    found = found.withColumn("removed", F.col("keeper") != F.col("doc")).unionByName(grown(docs, hits, how)).withColumn("keeper", F.col("keeper.id"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What overlaps or touches as one stretch, for each document and kind."""
        for t, numbers in whole_groups(batches, kind):
            start, end = (t.column(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            # the farthest end so far; later groups lie beyond all earlier ones
            before = np.maximum.accumulate(end + (numbers << 32)) - (numbers << 32)
            fresh = np.flatnonzero(np.append(True, (numbers[1:] != numbers[:-1]) | (start[1:] > before[:-1] + 1)))
            keeper = np.minimum.reduceat(t.column("keeper").fill_null(_LAST).to_numpy(), fresh)
            held = np.logical_or.reduceat(t.column("keeper").is_valid().to_numpy(), fresh)
            last = np.maximum.reduceat(end, fresh)
            first = t.take(pa.array(fresh))
            kept = [first.column(c).combine_chunks() for c in (*kind, "start")]
            kept += [pa.array(last.astype(np.int32)), pa.array(keeper, mask=~held)]
            yield pa.RecordBatch.from_arrays(kept, names=[*kind, "start", "end", "keeper"])

    kind = ["id", "own", "removed"]
    found = found.select("doc.id", "doc.own", "removed", "start", "end", "keeper").repartition(*kind).sortWithinPartitions(*kind, "start", "end")
    merged = _keyed(found.mapInArrow(merge, "id bigint, own bigint, removed boolean, start int, end int, keeper bigint"))
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return merged.select(name("doc.id").alias("doc_id"), F.col("doc.own").alias("text_hash"), "start", "end", name("keeper").alias("component_id"), "removed")


def remove_repeats(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """The rows of ``docs`` with the stretches to be removed cut out; rows left without a word go."""
    cuts = repeats(docs, how).filter("removed").groupBy(F.struct(_doc().alias("id"), F.col("text_hash").alias("own")).alias("key"))
    cuts = cuts.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    place = docs.columns.index("text")
    # the row stays one struct to the end, so its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.withColumn("key", F.struct(_doc("row.doc_id").alias("id"), F.xxhash64("row.text").alias("own"))).join(cuts, "key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = batch.column(0).flatten()
            texts, stay = columns[place].to_pylist(), []
            for i, spans in enumerate(batch.column(1).to_pylist()):
                if spans and texts[i] is not None:
                    out, at = [], 0
                    for s in spans:
                        out.append(texts[i][at : s["start"]])
                        at = max(at, s["end"])
                    texts[i] = "".join([*out, texts[i][at:]])
                stay.append(not spans or bool(texts[i] and texts[i].encode().split()))
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names).filter(pa.array(stay))

    docs_names = docs.columns
    return met.select("row", "cuts").mapInArrow(cut, docs.schema)
