"""Best-fit packing by minimum bin slack: token pieces of at most ``limit`` tokens fill sequences of that length.

Pieces are counted by length, which gives at most ``limit`` counts however large the corpus is. For each
bin in turn, bitset subset-sum dynamic programming over the available lengths finds the fullest
feasible combination that holds the longest piece left; it is then removed, as often at once as the
counts allow. Spark ranks the pieces within their length and looks up their places.

Null or empty text: one piece that holds the end token alone. Repeated rows are packed one by one.
Equal lengths are taken in the order of doc_id within blocks. An empty table gives an empty result. A null
doc_id is packed like any other. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import small_batches, strings

END = 1
LIMIT = 4_096
#: Texts of a task that are held in Python at once; distinct stretches a worker remembers, the longest of them in bytes, and how many are encoded
#: together.
TEXTS, REMEMBERED, LONGEST, TOGETHER = 64, 600_000, 48, 400
#: Pieces of one length are ranked in blocks of about so many.
BLOCK_ROWS = 50_000

#: Kinds of bytes: white space, and letters, marks and digits, which the tokenizer parts from one another (digits each alone). All others are odd:
#: the apostrophe, control characters, and what is not ASCII but the letters U+00C0 to U+00FF.
SPACE, LETTER, MARK, DIGIT, ODD = range(5)
_KINDS = np.full(256, ODD, dtype=np.int8)
for _byte in range(33, 127):
    _KINDS[_byte] = LETTER if chr(_byte).isalpha() else DIGIT if chr(_byte).isdigit() else MARK
_KINDS[[32, *range(9, 14)]] = SPACE
_KINDS[[ord("'"), 0xC3]] = ODD, LETTER
_AFTER_C3 = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])  # not so the signs of times and division
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


class WordEncoder:
    """Ids of stretches between ASCII white space, which the tokenizer drops and never joins across.

    Letters, marks and digits that follow one another are set apart and letters made lower, as the tokenizer does, so a word is one stretch however it
    is written; only stretches with odd characters stay as they are. Each stretch is encoded once and remembered, many as one
    text: each word ends with the one id of its own that closes a word, and words are counted
    beforehand, so that the ids are told apart again. Odd stretches are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # what may begin a special token's string is odd
        self.kinds = _KINDS.copy()
        self.kinds[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()]] = ODD

    def _kind(self, raw: np.ndarray) -> np.ndarray:
        kind = self.kinds[raw]
        kind[1:][(raw[:-1] == 0xC3) & _AFTER_C3[raw[1:]]] = LETTER
        return kind

    def stretches(self, texts: list[bytes]) -> list[list[bytes]]:
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        kind, low = self._kind(raw), _LOWER[raw]
        odd = np.flatnonzero(kind == ODD)
        if len(odd):  # with all of the stretch around it
            space = np.concatenate([[-1], np.flatnonzero(kind == SPACE)])
            at = np.unique(np.searchsorted(space, odd))
            edges = np.zeros(len(raw) + 1, dtype=np.int8)
            edges[space[at - 1] + 1] = 1
            edges[space[at]] = -1
            inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
            kind[inside], low[inside] = ODD, raw[inside]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != SPACE) & (kind[:-1] != SPACE)) + 1
        data = np.insert(low, cut, 32).tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts])
        ends = (ends + np.searchsorted(cut, ends)).tolist()
        return [data[i:j].split() for i, j in zip([0, *ends], ends, strict=False)]

    def _each(self, stretches: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in stretches], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _together(self, stretches: list[bytes], words: np.ndarray) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([b" ".join(stretches).decode()], add_special_tokens=False)[0].ids
        ids, last = np.array(found, dtype="<u4"), np.cumsum(words)
        closed = np.flatnonzero(self.closes[ids]) + 1
        if len(closed) != last[-1] or closed[-1] != len(ids):
            return self._each(stretches)
        raw, ends = ids.tobytes(), (4 * closed[last - 1]).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def learn(self, stretches: set[bytes]) -> dict[bytes, bytes]:
        """Ids by stretch, for those given at least. What is long is not remembered."""
        known = self.known
        fresh = [c for c in stretches if c not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list(stretches)
        own: dict[bytes, bytes] = {}
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at : at + TOGETHER]
            raw = np.frombuffer(b" ".join(some), dtype=np.uint8)
            kind = self._kind(raw)
            first = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
            odd = np.logical_or.reduceat(kind == ODD, first)
            # a word, a run of marks or any number of digits
            words = np.where(kind[first] == DIGIT, np.diff(first, append=len(raw) + 1) - 1, 1)
            apart, plain = list(compress(some, odd)), list(compress(some, ~odd))
            for c, ids in chain(zip(apart, self._each(apart), strict=True), zip(plain, self._together(plain, words[~odd]), strict=True) if plain else ()):
                (known if len(c) <= LONGEST else own)[c] = ids
        return known if not own else {c: own[c] if c in own else known[c] for c in stretches}


_encoders: dict[str, WordEncoder] = {}


def encode(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without special tokens."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    parts = _encoders[path].stretches(texts)
    ids = _encoders[path].learn(set(chain.from_iterable(parts)))
    for p in parts:
        yield b"".join(map(ids.__getitem__, p))


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit integers.

    Each text's ids are followed by the end token; only longer ones are cut, every ``limit`` tokens.
    """
    end = np.array([END], dtype="<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, TEXTS):
            doc, piece, start, length, ids = [], [], [], [], []
            for key, own in zip(batch.column(0).to_pylist(), encode(strings(batch.column(1)), tokenizer_path), strict=True):
                own += end
                n = len(own) // 4
                for k, at in enumerate(range(0, n, limit)):
                    size = min(limit, n - at)
                    doc.append(key)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    ids.append(own[4 * at : 4 * (at + size)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(scan, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def fullest(counts: dict[int, int], room: int, descending: list[int]) -> list[tuple[int, int]]:
    """(length, how many) with the largest sum that is at most ``room``, by subset-sum over a bitset.

    Bit s of ``reach`` says that some choice sums to s. Counts enter in powers of two.
    """
    if counts.get(room):
        return [(room, 1)]
    reach, full, mask = 1, 1 << room, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in descending:
        if length > room or not counts[length]:
            continue
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            k *= 2
        if reach & full:
            break
    best = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= take * length
    return list(chosen.items())


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, how many in each bin)]) until no piece is left."""
    counts = dict(counts)
    descending = sorted(counts, reverse=True)
    bins = []
    while descending:
        longest = descending[0]
        counts[longest] -= 1
        chosen = dict(fullest(counts, limit - longest, descending))
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[length] // k for length, k in chosen.items())
        for length, k in chosen.items():
            counts[length] -= times * k
        bins.append((times, sorted(chosen.items(), reverse=True)))
        descending = [x for x in descending if counts[x]]
    return bins


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows of ``cut`` (doc_id, piece, length and others) with ``sequence_id`` and ``offset``.

    ``cut`` is read three times: pass a saved table.
    """
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``limit`` rows
    first: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: rank of the first piece, bin, pieces in a bin, offset
    ranks: dict[int, int] = {}
    number = 0
    for times, chosen in plan({r["length"]: r["n"] for r in counted}, limit):
        offset = 0
        for length, k in chosen:
            at = ranks.get(length, 0)
            first.setdefault(length, []).append((at, number, k, offset))
            ranks[length] = at + times * k
            offset += k * length
        number += times
    tables = {length: np.array(rows, dtype=np.int64) for length, rows in first.items()}

    session = cut.sparkSession
    sizes = session.createDataFrame(
        [(r["length"], -(-r["n"] // BLOCK_ROWS)) for r in counted], "__length bigint, __blocks bigint"
    )
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.col("__blocks"))
    dealt = cut.join(F.broadcast(sizes), F.col("length") == F.col("__length")).withColumn("__block", block)
    before = W.partitionBy("__length").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = dealt.groupBy("__length", "__block").agg(F.count("*").alias("__n"))
    blocks = blocks.select("__length", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__length", "__block").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("__nth", F.row_number().over(inside)).join(blocks, ["__length", "__block"])
    ranked = ranked.select(*cut.columns, (F.col("__before") + F.col("__nth") - 1).alias("__rank"))

    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            lengths, rank = batch.column(names.index("length")).to_numpy(), batch.column(n).to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for rows in np.split(order, edges[1:]) if len(order) else []:
                length = int(lengths[rows[0]])
                t = tables[length]
                at = t[np.searchsorted(t[:, 0], rank[rows], side="right") - 1]
                k = rank[rows] - at[:, 0]
                sequence[rows] = at[:, 1] + k // at[:, 2]
                offset[rows] = at[:, 3] + k % at[:, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces that carry their ids: each sequence's ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")).alias("ids"))
