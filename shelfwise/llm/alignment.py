"""Alignment of two tokenizers over the same texts, and how often their tokens meet in a corpus.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte fallback. Both tokenize a text
with a space before it. The spans they report are coarse cuts: character offsets of A, byte spans of B's proto (as its offset mapping).
Tokens that report a shared or an empty span, as parts of a multibyte character and byte-fallback tokens
do, are placed by their decoded bytes. Byte offsets at which a token of either side ends cut the tokens into groups.
(sentencepiece 0.2.3 has dropped the immutable form of its proto; the plain one and the offset mapping made of it have the same spans.)

Work is done once for each distinct piece of text that a worker remembers: where a space follows a character that is no white
space, A's pattern begins a new match and B, if no entry of its vocabulary holds a space behind another character
(checked), a new piece. The same holds before line ends and between letters and the punctuation that no entry holds behind a letter. Both
are tokenized from such cut to such cut; other vocabularies see whole texts.

A text that is null, empty, or not given back byte for byte by both sides has no tokens: zeros and the empty string.
Repeated rows are rows of their own and count as documents. Long texts are read whole. An empty table gives an
empty result. The columns of the input stay in the struct ``row``, so they may have any names.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import saved, small_batches, strings, table_saved

#: So many pairs of ids, those in most documents, are broadcast with their counts (some 17 bytes each); others are joined.
BROADCAST_PAIRS = 1_000_000
#: Pieces of text a worker remembers (half of them those met last), the longest of them, and how many are tokenized in one call.
REMEMBERED, LONGEST, TOGETHER = 680_000, 48, 256
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r" \s|\s\Z")
_ODD_ASCII = ["  ", *(f" {c}" for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f")]
_B = np.int64(1 << 32)
_NONE: tuple[tuple, ...] = ((),) * 7


#: The groups of one piece of text: as text, the linked ids (a * 2**32 + b, with repeats, 8 bytes each), where in the piece the groups end (8 bytes
#: each), numbers of tokens of A and B, of groups, and the piece's bytes. A plain tuple: hundreds of thousands are remembered.
Aligned = tuple[str, bytes, bytes, int, int, int, int]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers in a worker, with the pieces of text met so far."""

    def __init__(self, a_json: bytes, b_model: bytes, spans: bool = True):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json.decode()), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        alphabet, size = _byte_alphabet(), self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        plan = json.loads(a_json)
        split = plan.get("pre_tokenizer") or {}
        self.cuts = (
            not any(re.search("[^▁]▁", p) for p in pieces) and plan.get("normalizer") is None
            and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        )
        marks = "".join(c for c in ".,;:!?" if not any(re.search(rf"[^\W_]{re.escape(c)}", p) for p in pieces))
        lines = "" if any("\n" in p for p in pieces) else r"|(?<=\S)(?=\n)"
        self.finer = re.compile(rf"(?<=[^\W_])(?=[{marks}]){lines}" if marks else lines[1:] or r"(?!)")
        # every id as text with each of the marks that may follow it: within A's ids, behind them, within B's, behind them, at a piece's end
        self.names = [f"{i}{mark}" for mark, ids in zip(",|,;", (size, size, len(pieces), len(pieces)), strict=True) for i in range(ids)]
        self.names += [str(i) for i in range(len(pieces))]
        self.spans = spans
        self.skip = len(self.b.encode("x"))
        self.known: dict[str, Aligned | tuple[()]] = {}
        self.before: dict[str, Aligned | tuple[()]] = {}
        self.long: list[str] = []

    def pieces(self, text: str) -> list[str]:
        """Pieces of the text with its space, which both sides tokenize apart."""
        text = " " + text
        if not self.cuts:
            return [text]
        # a space that no white space follows ends a match of A and a piece of B wherever it stands
        odd = "\0" in text or text[-1] <= " " or (any(w in text for w in _ODD_ASCII) if text.isascii() else _ODD.search(text))
        return _CUT.split(text) if odd else text.replace(" ", "\0 ").split("\0")[1:]

    def _tokens(self, text: str) -> tuple[list[int], np.ndarray, list[int], np.ndarray] | None:
        """Ids and byte ends of both sides of a part of a text; none if the bytes differ."""
        source = text.encode()
        e = self.a.encode(text, add_special_tokens=False)
        if text[0] == " " and len(text) > 1:  # B adds the space itself
            mapped, skip, back = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True), 0, -1
        else:  # a lone space, which B would not see, or no space: read behind a letter, of whose pieces there are ``skip``
            mapped, skip, back = self.b.encode("x" + text, return_type="offset_mapping", return_bytes=True), self.skip, 1
        a_ids, b_ids, offsets = e.ids, mapped["ids"][skip:], e.offsets
        if b"".join([self.a_bytes[i] for i in a_ids]) != source or b"".join([self.b_bytes[i] for i in b_ids]) != source:
            return None
        a_spans = np.fromiter(chain.from_iterable(offsets), dtype=np.int64, count=2 * len(a_ids)).reshape(-1, 2)
        b_spans = np.fromiter(chain.from_iterable(mapped["offsets"][skip:]), dtype=np.int64, count=2 * len(b_ids)).reshape(-1, 2) - back
        if len(source) != len(text):  # characters to bytes
            raw = np.frombuffer(source, dtype=np.uint8)
            a_spans = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[a_spans]
        return (
            a_ids, _refined(a_spans, self.a_size[a_ids]), b_ids, _refined(b_spans, self.b_size[b_ids]),
        )

    def _align(self, pieces: list[str]) -> list[Aligned | tuple[()]]:
        """Each piece aligned, tokenized all together; one by one if the bytes of them all do not fit. Nothing for one without tokens."""
        found = self._tokens("".join(pieces))
        if found is None:
            return [()] if len(pieces) == 1 else [self._align([p])[0] for p in pieces]
        a_ids, a_ends, b_ids, b_ends = found
        a_ids, b_ids = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        cut = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_at, b_at = (np.append(0, np.searchsorted(e, cut, side="right")) for e in (a_ends, b_ends))
        n_a, n_b = np.diff(a_at), np.diff(b_at)
        stops = np.cumsum([len(p.encode()) for p in pieces])
        upto = np.searchsorted(cut, stops, side="right")
        first = np.append(0, upto[:-1])
        # tokens as they are written: of each group those of A, then those of B
        a_size, b_size = len(self.a_bytes), len(self.b_bytes)
        behind = np.full(len(cut), 2 * a_size + b_size)
        behind[upto[upto > first] - 1] += b_size
        a_mark, b_mark = np.zeros(len(a_ids), dtype=np.int64), np.full(len(b_ids), 2 * a_size)
        a_mark[a_at[1:] - 1], b_mark[b_at[1:] - 1] = a_size, behind
        written = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        written[np.arange(len(a_ids)) + np.repeat(b_at[:-1], n_a)] = a_ids + a_mark
        written[np.arange(len(b_ids)) + np.repeat(a_at[1:], n_b)] = b_ids + b_mark
        names = list(map(self.names.__getitem__, written.tolist()))
        # all pairs of each group
        many = n_a * n_b
        edge = np.append(0, np.cumsum(many))
        place, width = np.arange(edge[-1]) - np.repeat(edge[:-1], many), np.repeat(n_b, many)
        row = place // width
        links = (a_ids[np.repeat(a_at[:-1], many) + row] * _B + b_ids[np.repeat(b_at[:-1], many) + place - row * width]).tobytes()
        starts, ends = np.append(0, stops[:-1]), b""
        if self.spans:
            ends = (cut - np.repeat(starts, upto - first)).tobytes()
        token, link, group = (np.append(x[first], x[-1:]).tolist() for x in (a_at + b_at, 8 * edge, 8 * np.arange(len(cut) + 1)))
        counts = zip(*((x[upto] - x[first]).tolist() for x in (a_at, b_at)), (upto - first).tolist(), (stops - starts).tolist(), strict=True)
        return [
            ("".join(names[token[k] : token[k + 1]]), links[link[k] : link[k + 1]], ends[group[k] : group[k + 1]], *n)
            for k, n in enumerate(counts)
        ]

    def _fill(self, fresh: list[str]) -> None:
        """Align the fresh pieces: those with more than a word are put together from finer parts, of which the new ones are tokenized."""
        known, recall = self.known, self._recall
        cut, new = [], set()
        for p in fresh:
            if not self.cuts or p[-1] <= " " or p[1:].isalnum():
                new.add(p)
            else:
                parts = self.finer.split(p)
                cut.append((p, parts))
                new.update([q for q in parts if q not in known and not recall(q)])
        # a part without a space or line end before it is read behind a letter, by itself
        plain = [q for q in new if q[0] in " \n" and len(q) <= LONGEST and (q[1:].isalnum() or (q[1:2] > " " and q[-1] > " " and q[1:].isprintable()))] if self.cuts else []
        for i in range(0, len(plain), TOGETHER):
            some = plain[i : i + TOGETHER]
            known.update(zip(some, self._align(some), strict=True))
        for q in new:
            if q not in known:
                known[q] = self._align([q])[0]
        for p, parts in cut:
            if len(parts) > 1:
                got = [known[q] for q in parts]
                known[p] = () if () in got else _joined(got)
        self.long += [q for q in new if len(q) > LONGEST] + [p for p, _ in cut if len(p) > LONGEST]

    def _recall(self, piece: str) -> bool:
        """Whether the piece was met before the last turn of what is remembered; it then stays for another."""
        got = self.before.get(piece)
        if got is None:
            return False
        self.known[piece] = got
        return True

    def align(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The aligned pieces of each text; none for a text without tokens."""
        split = [self.pieces(t) if t else [] for t in texts]
        found = [list(map(self.known.get, parts)) for parts in split]
        fresh = {p for parts, got in zip(split, found, strict=True) if None in got for p, x in zip(parts, got, strict=True) if x is None}
        if len(self.known) + len(fresh) > REMEMBERED // 2:  # what is met again before the next turn stays, the rest goes
            self.before, self.known = self.known, {}
        self._fill([p for p in fresh if not self._recall(p)])
        known, out = self.known, []
        for parts, got in zip(split, found, strict=True):
            if None in got:
                got = [known[p] if x is None else x for p, x in zip(parts, got, strict=True)]
            out.append(None if not got or () in got else got)
        for p in self.long:  # too long to be remembered
            known.pop(p, None)
        self.long.clear()
        return out


def _joined(parts: list[Aligned]) -> Aligned:
    names, links, own, n_a, n_b, n_groups, size = zip(*parts, strict=True)
    ends = b"".join(own)
    if ends:
        ends = (np.frombuffer(ends, dtype=np.int64) + np.repeat(np.cumsum((0, *size[:-1])), n_groups)).tobytes()
    return ";".join(names), b"".join(links), ends, sum(n_a), sum(n_b), sum(n_groups), sum(size)


def _refined(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: reported ends where they are whole cuts, between them by the sizes of the decoded tokens."""
    by_size = np.cumsum(sizes)
    if not len(spans):
        return by_size
    whole = spans[:, 1] > spans[:, 0]
    whole[:-1] &= spans[:-1, 1] == spans[1:, 0]
    at = np.maximum.accumulate(np.where(whole, np.arange(len(spans)), -1))
    shift = np.where(whole, spans[:, 1] - by_size, 0)
    return by_size + np.where(at >= 0, shift[at], 0)


_aligners: dict[tuple[int, bool], Aligner] = {}


def _aligner(shared: Broadcast, spans: bool) -> Aligner:
    """One for each worker and pair of vocabularies, so that what it remembers outlives a task."""
    key = hash(shared.value), spans
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*shared.value, spans)
    return _aligners[key]


def vocabularies(spark: SparkSession, a_path: str, b_path: str) -> Broadcast:
    """Both vocabulary files, broadcast: their size is that of the vocabularies."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def align(docs: DataFrame, shared: Broadcast, text: str = "text", spans: bool = True) -> DataFrame:
    """``row`` with the alignment of its text.

    n_a, n_b, n_groups, n_links: tokens of both sides, groups and linked occurrences; groups: the ids as
    ``a1,a2|b1;a3|b2,b3``; ends: the byte of space and text at which each group ends (with ``spans``); pairs and
    times: the different linked ids as a * 2**32 + b, in order, and how often each is linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared, spans)
        gc.disable()  # what is remembered has no cycles, and looking for some takes a fifth of the time
        for batch in small_batches(batches, 256):
            texts = [t.decode("utf-8", "surrogateescape") if t else "" for t in strings(batch.column(1))]
            whole = [t if t.isascii() or not any("\ud800" <= c <= "\udfff" for c in t) else "" for t in texts]  # bytes that are no UTF-8
            numbers: list[list[int]] = []
            names, ends, pairs, times = [], [], [], []
            for got in aligner.align(whole):
                text_groups, links, own, n_a, n_b, n_groups, size = zip(*got, strict=True) if got else _NONE
                joined = np.frombuffer(b"".join(links), dtype=np.int64)
                ids, n = np.unique(joined, return_counts=True)
                numbers.append([sum(n_a), sum(n_b), sum(n_groups), len(joined)])
                names.append(";".join(text_groups))
                pairs.append(ids)
                times.append(n)
                if spans:
                    start = np.cumsum((0, *size))[:-1]
                    ends.append(np.frombuffer(b"".join(own), dtype=np.int64) + np.repeat(start, n_groups))
            count = np.array(numbers, dtype=np.int64).reshape(-1, 4)
            arrays = [batch.column(0), *[pa.array(count[:, k]) for k in range(4)], pa.array(names, pa.string())]
            arrays += [_lists(ends, pa.int64())] if spans else []
            arrays += [_lists(pairs, pa.int64()), _lists(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
        gc.enable()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = rows.select(
        "row", *[F.lit(0).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.lit("").alias("groups"),
        *[F.array(F.lit(0).cast("bigint")).alias(c) for c in (("ends",) if spans else ()) + ("pairs", "times")],
    ).schema
    fields = schema.fields
    return rows.mapInArrow(run, schema)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; whether no other pair of its A id is in more. Saved."""
    counts = saved(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(_a_id("pair").alias("a")).agg(F.max("n").alias("most"))  # as many rows as A has ids at most
    return saved(counts.withColumn("a", _a_id("pair")).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _a_id(pair: str) -> Column:
    return F.shiftright(pair, 32).cast("int")


def rated(aligned: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` (without ``pairs`` and ``times``) with ``count_sum``, the documents of the pair summed over all links, and ``n_best``,
    the links whose pair is the best of its A id.

    The pairs in most documents, up to ``most`` of them, are looked up in a broadcast; the rest of each row's
    pairs, if there are more in all, is joined.
    """
    sizes = sorted(counts.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("pairs")).collect(), reverse=True)
    total, least = 0, 0
    for size, pairs in sizes:  # at most 64 of them
        total += pairs
        if total > most:
            least = 1 << (size + 1)
            break
    heavy = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    found = aligned.sparkSession.sparkContext.broadcast([heavy.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
    keep = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = aligned.select(F.struct(*keep).alias("kept"), "pairs", "times")
    schema = rows.select(
        "kept", F.lit(0).cast("bigint").alias("count_sum"), F.lit(0).cast("bigint").alias("n_best"),
        F.col("pairs").alias("rest"), F.col("times").alias("rest_times"),
    ).schema

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = found.value
        for batch in small_batches(batches, 2_048):
            column = batch.column(1)
            edge = column.offsets.to_numpy()
            own, times = (c.values.to_numpy()[edge[0] : edge[-1]] for c in (column, batch.column(2)))
            edge = edge - edge[0]
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), dtype=bool)
            at = at[hit]
            summed, bests = np.zeros((2, len(own) + 1), dtype=np.int64)
            summed[1:][hit], bests[1:][hit] = n[at] * times[hit], best[at] * times[hit]
            sums = [np.cumsum(x)[edge] for x in (summed, bests)]
            missed = np.append(0, np.cumsum(~hit))[edge].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(missed), pa.array(x[~hit])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.diff(s)) for s in sums], *rest], names=schema.names)

    out = rows.mapInArrow(look, schema)
    if least:
        out = table_saved(out.withColumn("id", F.monotonically_increasing_id()))
        rest = out.select("id", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("id", F.col("x.rest").alias("pair"), "x.rest_times")
        rest = rest.join(counts.filter(F.col("n") < least), "pair").groupBy("id").agg(
            F.sum(F.col("n") * F.col("rest_times")).alias("more"), F.sum(F.when(F.col("best"), F.col("rest_times")).otherwise(0)).alias("bests")
        )
        out = out.join(rest, "id", "left").select(
            "kept", (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), (F.col("n_best") + F.coalesce("bests", F.lit(0))).alias("n_best")
        )
    return out.select("kept.*", "count_sum", "n_best")
