"""Periodic runs of words: stretches that repeat themselves with a period, found by block convolution.

A run is a stretch of consecutive words with smallest period q, at least ``max(12, 2 * q)`` words long, that no neighbouring word
extends keeping period q. All runs of a text are found, of any period:

- Scales are dyadic. Part of a run with period q reaches over ``length - q`` words, each equal to the word q
  further on. For q from 2B - 1 to 4B - 2 that part holds a whole aligned block of B words, so the block occurs again
  q words further on. (For short periods the least length makes room for a block of 4; a block of 2 finds period 6.)
- The occurrences of a block in the window behind it are the offsets where the sum of squared differences of word numbers is
  zero. That sum is a convolution, taken with an exact integer transform modulo the prime 998244353: a true zero is zero there.
- Blocks whose first words do not come again at a distance in question are passed over before that, by sorted four-word hashes.
- Distances found are seeds. Of equal distances in a row of blocks one is kept; it grows on both sides by prefix hashes, and
  every run is then compared word by word, so a sum or hash that agreed by chance leaves nothing.

Words of different texts have a separator between them that equals nothing, so the texts of a batch are searched as one.

Null, empty and short texts have no runs. Repeated rows are rows of their own. A long text is searched whole, in memory in
proportion to its words. An empty table gives an empty result. The input's columns stay in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import let, small_batches, strings, words

LEAST = 12
PRIME, ROOT = 998_244_353, 3
#: Words searched together, and the most elements of one transform.
TOGETHER, ELEMENTS = 150_000, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _roots(n: int, inverse: bool) -> list[np.ndarray]:
    """For each stage of a transform of n elements, the powers of the stage's root of unity."""
    out, size = [], 2
    while size <= n:
        w = pow(ROOT, (PRIME - 1) // size, PRIME)
        w = pow(w, PRIME - 2, PRIME) if inverse else w
        powers = np.ones(1, dtype=np.uint64)
        while len(powers) < size // 2:
            powers = np.concatenate([powers, powers * np.uint64(pow(w, len(powers), PRIME)) % PRIME])
        out.append(powers)
        size *= 2
    return out


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), modulo :data:`PRIME`."""
    rows, n = x.shape
    x, p = x.astype(np.uint64), np.uint64(PRIME)
    bits = n.bit_length() - 1
    order = np.zeros(n, dtype=np.int64)
    for b in range(bits):
        order |= (np.arange(n) >> b & 1) << (bits - 1 - b)
    x = x[:, order]
    for powers in _roots(n, inverse):
        half = len(powers)
        y = x.reshape(rows, -1, 2, half)
        low, high = y[:, :, 0], y[:, :, 1] * powers % p
        x = np.concatenate([(low + high) % p, (low + p - high) % p], axis=-1).reshape(rows, n)
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % p if inverse else x


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences, modulo the prime, of each block at each offset of its window where it fits."""
    rows, size = blocks.shape
    width = windows.shape[1]
    n = 1 << (width - 1).bit_length()
    p = np.uint64(PRIME)
    x, y = np.zeros((rows, n), dtype=np.uint64), np.zeros((rows, n), dtype=np.uint64)
    x[:, :size], y[:, :width] = blocks[:, ::-1] % p, windows % p
    product = transform(transform(x) * transform(y) % p, inverse=True)[:, size - 1 : width]
    squares = np.zeros((rows, width + 1), dtype=np.uint64)
    np.cumsum(y[:, :width] * y[:, :width] % p, axis=1, out=squares[:, 1:])
    inside = squares[:, size:] - squares[:, :-size]
    return (inside + (x * x % p).sum(axis=1, keepdims=True) + np.uint64(2) * (p - product)) % p


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least period, largest period) up to the periods that a text of so many words can have."""
    if longest >= LEAST:
        yield 2, 6, 6
        yield 4, 1, 14
        block = 8
        while 2 * (2 * block - 1) <= longest:
            yield block, 2 * block - 1, 4 * block - 2
            block *= 2


class _Text:
    """Numbered words of several texts, with what the search looks up in them."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        # ids: separators included, which occur once each; ends: for each position the end of its text
        self.ids, self.ends, self.n = ids, ends, len(ids)
        self.values = ids.astype(np.uint64) * _ODD
        self.values ^= self.values >> np.uint64(29)
        self.values *= np.uint64(0xBF58476D1CE4E5B9)
        self.order: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.powers = np.cumprod(np.full(self.n + 1, _ODD, dtype=np.uint64))
        self.prefix = np.append(np.uint64(0), np.cumsum(self.values * self.powers[:-1], dtype=np.uint64))

    def again(self, at: np.ndarray, size: int, least: int, most: int) -> np.ndarray:
        """Whether the ``size`` words at a position come again, in the same text, least to most words further on."""
        if size not in self.order:
            h = sum((self.values[k : self.n - size + 1 + k] * self.powers[k] for k in range(size)), np.zeros(self.n - size + 1, dtype=np.uint64))
            order = np.argsort(h, kind="stable")
            fresh = np.append(True, h[order][1:] != h[order][:-1])
            rank = np.empty(len(h), dtype=np.int64)
            rank[order] = np.cumsum(fresh)
            many = np.append(fresh[1:], True) & fresh
            once = np.empty(len(h), dtype=bool)
            once[order] = many
            self.order[size] = rank * (self.n + 1), rank[order] * (self.n + 1) + order, once
        group, places, once = self.order[size]
        out = ~once[at]
        left = at[out]
        found = np.searchsorted(places, group[left] + left + least)
        upto = group[left] + np.minimum(left + most, self.ends[left] - size)
        out[out] = (found < len(places)) & (places[np.minimum(found, len(places) - 1)] <= upto)
        return out

    def same(self, i: np.ndarray, q: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether words i to i + size hash as those q further on."""
        first = (self.prefix[i + size] - self.prefix[i]) * self.powers[q] * _INVERSE
        return first == self.prefix[i + q + size] - self.prefix[i + q]

    def grow(self, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last position around each ``at`` whose words all equal those q further on."""
        low, high = at.copy(), at.copy()
        step = 1 << max(self.n - 1, 1).bit_length()
        while step:
            fits = np.flatnonzero(high + q + step <= self.n)
            fits = fits[self.same(high[fits], q[fits], step)]
            high[fits] += step
            fits = np.flatnonzero(low >= step)
            fits = fits[self.same(low[fits] - step, q[fits], step)]
            low[fits] -= step
            step >>= 1
        return low, high


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """(start, length, period) of every run of each array of word numbers, by start and then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    none = np.empty((0, 3), dtype=np.int64)
    longest = int(sizes.max(initial=0))
    if longest < LEAST:
        return [none for _ in texts]
    top = max(int(t.max(initial=0)) for t in texts) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.concatenate([np.append(t, top + i) for i, t in enumerate(texts)]).astype(np.int64)
    text = _Text(ids, np.repeat(starts + sizes, sizes + 1))
    found: list[np.ndarray] = []
    for block, least, most in _scales(longest):
        at = np.arange(0, text.n - block - least + 1, block)
        at = at[at + block + least <= text.ends[at]]
        at = at[text.again(at, min(block, 4), least, most)]
        seeds: list[np.ndarray] = []
        width = most - least + block
        rows = max(1, ELEMENTS >> (width - 1).bit_length())
        for i in range(0, len(at), rows):
            some = at[i : i + rows]
            near = some[:, None] + least + np.arange(width)
            windows = np.where(near < text.n, ids[np.minimum(near, text.n - 1)], top + len(texts))
            zero = mismatches(ids[some[:, None] + np.arange(block)].astype(np.uint64), windows.astype(np.uint64)) == 0
            r, d = np.nonzero(zero)
            seeds.append(np.stack([d + least, some[r]], axis=1))
        if not sum(map(len, seeds)):
            continue
        q, at = np.concatenate(seeds).T
        order = np.lexsort((at, q))
        q, at = q[order], at[order]
        fresh = np.append(True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + block))
        q, at = q[fresh], at[fresh]
        low, high = text.grow(at, q)
        length = high - low + q
        fits = (length >= np.maximum(LEAST, 2 * q)) & (high > low)
        found.append(np.stack([low[fits], length[fits], q[fits]], axis=1))
    if not found:
        return [none for _ in texts]
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # a stretch with several periods has its least one first; the others are multiples of it
    every = every[np.append(True, (every[1:, :2] != every[:-1, :2]).any(axis=1))] if len(every) else every
    true = [s for s in every.tolist() if np.array_equal(ids[s[0] : s[0] + s[1] - s[2]], ids[s[0] + s[2] : s[0] + s[1]])]
    every = np.array(true, dtype=np.int64).reshape(-1, 3)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    owner = np.searchsorted(starts, every[:, 0], side="right") - 1
    every[:, 0] -= starts[owner]
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [every[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def dropped(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run behind its first period."""
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, found[:, 0] + found[:, 2], 1)
    np.add.at(mark, found[:, 0] + found[:, 1], -1)
    return np.cumsum(mark)[:n] > 0


def find(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """``row`` with n_words, ``runs``: (start, length, period) of each run by start and period, and ``collapsed``: the
    words that no run holds behind its first period, joined by single spaces."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1_024):
            parts = [t.split() for t in strings(batch.column(1))]
            first = 0
            while first < len(parts):  # so many texts that their words are some TOGETHER, one at least
                last, total = first, 0
                while last < len(parts) and (total == 0 or total + len(parts[last]) <= TOGETHER):
                    total, last = total + len(parts[last]), last + 1
                yield some(batch.slice(first, last - first), parts[first:last])
                first = last

    def some(batch: pa.RecordBatch, parts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        for p in parts:
            for w in p:
                numbers.setdefault(w, len(numbers))
        found = runs([np.fromiter(map(numbers.__getitem__, p), dtype=np.int64, count=len(p)) for p in parts])
        left = []
        for p, r in zip(parts, found, strict=True):
            left.append(b" ".join([w for w, gone in zip(p, dropped(len(p), r).tolist(), strict=True) if not gone] if len(r) else p))
        flat = np.concatenate(found)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
        offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(p) for p in parts], pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(left, pa.binary()).cast(pa.string())],
            names=["row", "n_words", "runs", "collapsed"],
        )

    column = F.col(f"`{text}`") if isinstance(text, str) else text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), column.alias("text"))
    run = "array<struct<start: bigint, length: bigint, period: bigint>>"
    schema = rows.select("row", F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(run).alias("runs"), F.lit("").alias("collapsed")).schema
    return rows.mapInArrow(search, schema)


def longest(column: str = "runs") -> Column:
    """The longest run; of equally long ones the first, then the one with the least period. Null without a run."""
    order = F.transform(column, lambda r: F.struct((-r["length"]).alias("key"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)


def with_repeats(text: Column, key: Column) -> Column:
    """A text in which words repeat with a known period, for a tenth of all keys; other texts stay as they are.

    Let h be the CRC32 of the decimal key, g = h / 10 without its fraction. Where h is a multiple of ten, each word i from a = g % n on becomes word
    a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(key.cast("string").cast("binary"))

    def planted(s: Column) -> Column:
        n, g = F.nullif(F.size(s["w"]).cast("bigint"), F.lit(0)), s["g"]
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        back = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(s["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(back, " ")

    made = let(F.struct(words(text).alias("w"), F.floor(h / 10).alias("g")), planted)
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)
