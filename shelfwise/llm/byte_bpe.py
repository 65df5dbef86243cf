"""Byte-level BPE: ranked merges folded over byte arrays with higher-order functions, and decoding.

The rank map is one literal value: an array of small maps, reached by a hash of the bytes, since a map alone is
searched from its start. A word (a match of the split pattern) that is a piece itself is that piece. Any other starts as
single bytes; each step of the fold joins the leftmost of the neighbouring pairs with the least rank, and only the
two pairs beside it are looked up again.

The words of the corpus are counted, and the most frequent distinct ones, ``frequent`` at most, are folded once
and kept as another such literal. Documents look their words up there; what is not found is folded in
place, so texts are never shuffled and nothing unbounded is broadcast. Decoding looks up each id's
bytes and concatenates them.

Null text is encoded as the empty text: no ids. Repeated rows are encoded one by one; an empty table
gives an empty result. Special tokens' strings are ordinary text. Ids outside the vocabulary decode to null. Other
columns are not touched and may have any name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import let, sized_batches, small_batches, table_saved

NONE = 2**31 - 1


@dataclass(frozen=True)
class Tables:
    """Literal tables of a vocabulary, as columns."""

    ranks: Column  # array of maps from bytes to rank
    pieces: Column  # array of hexadecimal bytes by id
    buckets: int
    pattern: str


def read_ranks(path: str) -> list[tuple[bytearray, int]]:
    with open(path, "rb") as lines:
        return [(bytearray(base64.b64decode(piece)), int(rank)) for piece, rank in map(bytes.split, lines)]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucketed(entries: DataFrame, buckets: int) -> Column:
    """One value from (key, value) rows with distinct keys: an array of ``buckets`` maps, null where there is none."""
    maps = entries.groupBy(_bucket(F.col("key"), buckets).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    empty = entries.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    every = empty.join(maps, "b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.map_entries("m").alias("e")))), lambda x: F.map_from_entries(x["e"]))).scalar()


def tables(spark: SparkSession, path: str, pattern: str, buckets: int = 1 << 16) -> Tables:
    """Read a rank file on the driver; its size is that of the vocabulary."""
    ranks = read_ranks(path)
    rows = spark.createDataFrame(ranks, "key binary, value int")
    top = max(r for _, r in ranks)
    by_id = spark.range(top + 1).select(F.col("id").cast("int").alias("value")).join(rows, "value", "left")
    pieces = by_id.agg(F.transform(F.array_sort(F.collect_list(F.struct("value", F.hex("key").alias("h")))), lambda x: x["h"])).scalar()
    return Tables(bucketed(rows, buckets), pieces, buckets, f"(?U){pattern}")


def find(table: Column, key: Column, buckets: int) -> Column:
    return F.get(table, _bucket(key, buckets))[key]


def fold(word: Column, ranks: Column, buckets: int) -> Column:
    """Ids of one word, given as bytes."""

    def rank(key: Column) -> Column:
        return F.coalesce(find(ranks, key, buckets), F.lit(NONE))

    def step(s: Column) -> Column:
        parts, costs = s["parts"], s["costs"]

        def join(at: Column) -> Column:  # 1-based place of the pair
            one = F.concat(F.get(parts, at - 1), F.get(parts, at))
            return let(
                one,
                lambda new: F.struct(
                    F.concat(F.slice(parts, 1, at - 1), F.array(new), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                    F.concat(
                        F.slice(costs, 1, F.greatest(at - 2, F.lit(0))),
                        F.when(at > 1, F.array(rank(F.concat(F.get(parts, at - 2), new)))).otherwise(F.array().cast("array<int>")),
                        F.when(at + 1 < F.size(parts), F.array(rank(F.concat(new, F.get(parts, at + 1))))).otherwise(F.array().cast("array<int>")),
                        F.slice(costs, at + 2, F.size(parts)),
                    ).alias("costs"),
                ),
            )

        least = F.array_min(costs)
        return F.when(F.coalesce(least, F.lit(NONE)) == NONE, s).otherwise(let(F.array_position(costs, least).cast("int"), join))

    n = F.octet_length(word)
    places = F.sequence(F.lit(1), n)
    bytes_ = F.transform(places, lambda i: F.substring(word, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2))))
    start = F.struct(bytes_.alias("parts"), pairs.alias("costs"))
    merged = F.aggregate(F.sequence(F.lit(1), n - 1), start, lambda s, _: step(s), lambda s: F.transform(s["parts"], rank))
    whole = find(ranks, word, buckets)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(merged)


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def frequent_words(docs: DataFrame, t: Tables, most: int) -> DataFrame:
    """(word) of at most ``most`` rows: all words of some count or more."""
    counts = docs.select(F.explode(words(F.col("text"), t.pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = table_saved(counts.filter("n > 1"))
    # at most some hundred steps of a power of 2 ** (1 / 8)
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    return counts.filter(step >= least if least is not None else F.lit(False)).select("word")


def encode(docs: DataFrame, t: Tables, frequent: int = 1 << 17) -> DataFrame:
    """Rows of ``docs`` as ``row`` with ``ids`` (array of int) of their whole texts."""
    bytes_ = F.col("word").cast("binary")
    known = frequent_words(docs, t, frequent).withColumn("ranks", t.ranks)
    known = known.select(F.col("word").alias("key"), fold(bytes_, F.col("ranks"), t.buckets).alias("value"))
    table = bucketed(table_saved(known), t.buckets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words(F.col("text"), t.pattern).alias("words"))
    rows = rows.withColumn("known", table).withColumn("ranks", t.ranks)
    one = lambda w: F.coalesce(find(F.col("known"), w, t.buckets), let(w.cast("binary"), lambda b: fold(b, F.col("ranks"), t.buckets)))
    return rows.select("row", F.flatten(F.transform("words", one)).alias("ids"))


def decode(rows: DataFrame, t: Tables, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """``rows`` with the bytes of an array of ids as a further column."""
    piece = lambda i: F.get(F.col("__pieces"), i)
    bytes_ = F.unhex(F.array_join(F.transform(ids, piece), ""))
    known = F.forall(ids, lambda i: piece(i).isNotNull())
    return rows.withColumn("__pieces", t.pieces).withColumn(name, F.when(known, bytes_)).drop("__pieces")


def little_endian(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers, one after the other."""

    def one(i: Column) -> Column:
        h = F.lpad(F.hex(i), 8, "0")
        return F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])

    return F.unhex(F.array_join(F.transform(ids, one), ""))


# The same fold inside tasks. The higher-order functions above need some 200 microseconds for each word that is
# folded and 3 for each that is looked up, more than the time there is for texts whose words are mostly rare.

#: Distinct stretches a worker remembers, and the longest of them; words beyond so many bytes are folded with a heap, others so many together
#: where there are at least ``FEW``.
REMEMBERED, LONGEST, SHORT, TOGETHER, FEW = 500_000, 48, 64, 4_096, 32
#: Split patterns that may be applied to the stretches between spaces; with others each text is split whole.
SPACED = {public_tokenizers.PATTERN}


def fold_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: single bytes, of which the leftmost pair with the least rank is joined again and again.

    A heap holds the pairs; entries of pairs that are gone no longer fit their parts and are passed over.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    if len(word) <= SHORT:
        while True:
            costs = [ranks.get(a + b, NONE) for a, b in pairwise(parts)]
            if not costs or (least := min(costs)) == NONE:
                return [ranks[p] for p in parts]
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < len(parts):
                pair = parts[a] + parts[b]
                if (r := ranks.get(pair)) is not None:
                    heappush(heap, (r, a, len(pair)))
    return [ranks[p] for p in parts if p is not None]


class Pairs:
    """The rank of two neighbouring pieces, for many at a time: every cut of a piece into two others, in order of their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks.get(bytes([i]), NONE) for i in range(256)], dtype=np.int64)
        cuts = [
            (a * self.size + b, r)
            for piece, r in ranks.items()
            for i in range(1, len(piece))
            if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None
        ]
        keys, joined = np.array(cuts, dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        # one more that no pair has, so that a place behind the last can be read
        self.keys, self.joined = np.append(keys[order], -1), np.append(joined[order], NONE)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where the two are no piece together, or where there is no second (-1)."""
        key = a * self.size + b
        at = np.searchsorted(self.keys[:-1], key)
        return np.where((self.keys[at] == key) & (b >= 0), self.joined[at], NONE)


def fold_many(words: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers. In every step each word joins the leftmost of its pairs with the least rank;
    words of about one length are folded together."""
    out, sizes = [b""] * len(words), np.array(list(map(len, words)), dtype=np.int64)
    for row in np.split(order := np.argsort(sizes, kind="stable"), range(TOGETHER, len(order), TOGETHER)):
        if not len(row):
            continue
        width = int(sizes[row[-1]])
        left = sizes[row]  # parts of each word
        parts = np.full((len(row), width + 1), -1, dtype=np.int64)
        parts[np.arange(width + 1) < left[:, None]] = pairs.single[np.frombuffer(b"".join([words[i] for i in row.tolist()]), dtype=np.uint8)]
        costs = pairs.rank(parts[:, :-1], parts[:, 1:])
        while len(row):
            at = costs.argmin(axis=1)
            every = np.arange(len(row))
            least = costs[every, at]
            if (done := least == NONE).any():
                ids = parts[done]
                raw = ids[ids >= 0].astype("<u4").tobytes()
                ends = (4 * np.cumsum(left[done])).tolist()
                for i, start, end in zip(row[done].tolist(), [0, *ends], ends, strict=False):
                    out[i] = raw[start:end]
                go = ~done
                row, left, parts, costs, at, least, every = row[go], left[go], parts[go], costs[go], at[go], least[go], every[: int(go.sum())]
                if not len(row):
                    break
            parts[every, at] = least
            width = costs.shape[1]
            stay = np.arange(width) + (np.arange(width) > at[:, None])
            parts = np.take_along_axis(parts, stay, axis=1)
            costs = np.take_along_axis(costs, stay[:, : width - 1], axis=1)
            left = left - 1
            inner = np.flatnonzero(at > 0)
            costs[inner, at[inner] - 1] = pairs.rank(parts[inner, at[inner] - 1], least[inner])
            inner = np.flatnonzero(at < width - 1)
            costs[inner, at[inner]] = pairs.rank(least[inner], parts[inner, at[inner] + 1])
            if width == 1:  # one part is left of each
                costs = np.full((len(row), 1), NONE)
                parts = np.column_stack([parts, np.full(len(row), -1)])
    return out


class Coder:
    """A vocabulary in a worker, with what it has met so far: stretches behind a space, and matches of the split pattern elsewhere."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.behind: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.pieces = {i: piece for piece, i in ranks.items()}
        self.split = regex.compile(pattern)
        # A match begins at every space behind a character that is no white space, and what follows does not hang on what was before.
        self.whole = regex.compile(r"\s " if pattern in SPACED else "")

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.ranks)

    def fold(self, words: set[str]) -> dict[str, bytes]:
        """Ids by word. Long ones are folded one by one, and so are a few."""
        raw = [w.encode() for w in words]
        short = [w for w in raw if len(w) <= SHORT and w not in self.ranks] if len(raw) >= FEW else []
        found = dict(zip(short, fold_many(short, self.pairs), strict=True)) if short else {}
        return {w: found[r] if r in found else array("I", fold_bytes(r, self.ranks)).tobytes() for w, r in zip(words, raw, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Equal stretches between spaces are encoded once."""
        first: list[list[str]] = []
        rest: list[list[str]] = []
        for t in texts:
            parts = [t] if self.whole.search(t) else t.split(" ")
            first.append(self.split.findall(parts[0]))
            rest.append(parts[1:])
        some, every = set(chain.from_iterable(first)), set(chain.from_iterable(rest))
        if len(self.known) + len(self.behind) + len(some) + len(every) > REMEMBERED:
            self.known.clear()
            self.behind.clear()
        fresh = [c for c in every if c not in self.behind]
        cut = [self.split.findall(" " + c) for c in fresh]
        lone = {w for w in some if w not in self.known}
        ids = self.fold(lone.union(*cut))
        own: dict[str, bytes] = {}
        for c, words in zip(fresh, cut, strict=True):
            (self.behind if len(c) <= LONGEST else own)[c] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])
        alone: dict[str, bytes] = {}
        for w in lone:
            (self.known if len(w) <= LONGEST else alone)[w] = ids[w]
        behind = {c: own[c] if c in own else self.behind[c] for c in every} if own else self.behind
        known = {w: alone[w] if w in alone else self.known[w] for w in some} if alone else self.known
        return [b"".join(chain(map(known.__getitem__, a), map(behind.__getitem__, b))) for a, b in zip(first, rest, strict=True)]

    def decode(self, ids: bytes) -> bytes | None:
        try:
            return b"".join(map(self.pieces.__getitem__, array("I", ids)))
        except KeyError:
            return None


_coders: dict[tuple[str, int], Coder] = {}


def _coder(shared: Broadcast, pattern: str) -> Coder:
    """One for each worker and vocabulary, so that what it remembers outlives a task."""
    packed: bytes = shared.value
    key = (pattern, hash(packed))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}, pattern)
    return _coders[key]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, broadcast: its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_in_tasks(docs: DataFrame, shared: Broadcast, pattern: str, texts: int = 512) -> DataFrame:
    """(doc_id, ids) of every row, ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for batch in sized_batches(batches, 1, texts):
            ids = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, ids binary")


def decode_in_tasks(rows: DataFrame, shared: Broadcast, pattern: str, texts: int = 64) -> DataFrame:
    """(doc_id, ids, bytes): the bytes of all pieces in order, null if an id is not in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for batch in small_batches(batches, texts):
            found = [coder.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["doc_id", "ids", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, bytes binary")
