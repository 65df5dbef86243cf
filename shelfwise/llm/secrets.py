"""Secret scans: base patterns, and weak parts of credentials that count only where complementary parts stand near.

Each text is scanned once. Weak parts (logins, bare keys, endpoints) are then joined with the
other parts of their text: an interval join on (row, position block), where two parts meet if no more than
``reach`` code points lie between them. A weak key needs an access identifier or a login, a login
needs a secret, an endpoint needs both. Parts do not overlap within a kind and have a least length, so a
block holds a bounded number of them and no key of the join is hot.

Null or empty text: no spans. Repeated rows: each has its own result, as rows are told apart by a
number given after the scan is saved. A null doc_id changes nothing. An empty table gives an empty
result. Long texts are scanned whole. Other columns may have any names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import saved, small_batches, strings

REACH = 200
#: All kinds in the order that decides between spans with the same start.
KINDS = ("assign", "access", "hex", "login", "key", "endpoint")
WEAK = KINDS[3:]
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_LOGIN = re.compile(rb"""(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.IGNORECASE)
_KEY = re.compile(rb"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
_ENDPOINT = re.compile(rb"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}""")

Span = tuple[int, int, int]  # kind, start, end in bytes


def scan_text(text: bytes) -> tuple[list[Span], list[Span]]:
    """Base spans, and weak candidates that overlap none of them, in bytes."""
    base: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        base += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        base += [(1, *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(2, *m.span()) for m in _HEX.finditer(text)]
    weak: list[Span] = []
    if any(k in low for k in (b"user", b"login", b"account", b"client")):
        weak += [(3, *m.span()) for m in _LOGIN.finditer(text)]
    weak += [(4, *m.span()) for m in _KEY.finditer(text) if _mixed(m[0])]
    if b"://" in text:
        weak += [(5, *m.span()) for m in _ENDPOINT.finditer(text)]
    spans = sorted((s, e) for _, s, e in base)
    return base, [w for w in weak if not covered(w, spans)]


def covered(part: Span, spans: list[tuple[int, int]]) -> bool:
    """Whether a span overlaps the part. Spans of one kind are disjoint, so at most one of each kind can reach over a later one."""
    near = spans[max(0, bisect_left(spans, (part[1],)) - len(KINDS)) : bisect_left(spans, (part[2],))]
    return any(part[1] < e for _, e in near)


def _mixed(token: bytes) -> bool:
    """A bare key has digits, capitals and small letters."""
    return bool(re.search(rb"[0-9]", token) and re.search(rb"[A-Z]", token) and re.search(rb"[a-z]", token))


def _code_points(text: bytes, spans: list[Span]) -> list[dict]:
    """Spans with code point positions, sorted by start and kind."""
    at, points, out = 0, 0, {}
    for place in sorted({p for _, s, e in spans for p in (s, e)}):
        points += len(text[at:place].decode(errors="replace"))
        out[place], at = points, place
    ordered = sorted((out[s], k, out[e]) for k, s, e in spans)
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in ordered]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, weak) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            base, weak = [], []
            for text in strings(batch.column(2)):
                b, w = scan_text(text)
                base.append(_code_points(text, b))
                weak.append(_code_points(text, w))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, _SPANS), pa.array(weak, _SPANS)], names=["doc_id", "text_hash", "base", "weak"]
            )

    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), "text")
    return slim.mapInArrow(run, f"doc_id bigint, text_hash bigint, base {_SPANS_SQL}, weak {_SPANS_SQL}")


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak ones of ``parts`` (scope, kind, start, end) that have their complements within ``reach``.

    Scopes are never joined with one another.
    """
    kind = F.col("kind")
    role = F.when(kind.isin("access", "login"), "id").when(kind == "endpoint", "endpoint").otherwise("secret")
    parts = parts.withColumn("role", role)
    # either side lies in the blocks its interval touches, the weak one widened by the reach
    first, last = F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach)
    left = parts.filter(kind.isin(*WEAK)).withColumn("block", F.explode(F.sequence(first, last)))
    own = F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))
    right = parts.filter("role <> 'endpoint'").select(
        "scope", F.explode(own).alias("block"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("other")
    )
    near = (F.col("s2") - F.col("end") <= reach) & (F.col("start") - F.col("e2") <= reach) & (F.col("role") != F.col("other"))
    met = left.join(right, ["scope", "block"]).filter(near)
    found = met.groupBy("scope", "kind", "start", "end", "role").agg(
        F.max(F.col("other") == "id").alias("has_id"), F.max(F.col("other") == "secret").alias("has_secret")
    )
    whole = (
        F.when(F.col("role") == "id", F.col("has_secret"))
        .when(F.col("role") == "secret", F.col("has_id"))
        .otherwise(F.col("has_id") & F.col("has_secret"))
    )
    return found.filter(whole).select("scope", "kind", "start", "end")


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, text_hash, base, spans) of every row; ``spans`` has the linked weak parts too, by start and kind."""
    rows = saved(scan(docs)).withColumn("scope", F.monotonically_increasing_id())
    weak = rows.filter(F.size("weak") > 0)
    linked = link_parts(weak.select("scope", F.inline(F.concat("base", "weak"))), reach)
    added = linked.groupBy("scope").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    order = F.array(*map(F.lit, KINDS))
    joined = rows.join(added, "scope", "left")
    every = F.concat("base", F.coalesce("added", F.array().cast(_SPANS_SQL)))
    keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", "text_hash", "base", spans.alias("spans"))


def redact(docs: DataFrame, reach: int = REACH, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each stretch of overlapping spans replaced by ``mask``."""
    found = find(docs, reach).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("__i", F.col("row.doc_id").cast("bigint")).withColumn("__h", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    met = rows.join(found, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    names, place = docs.columns, docs.columns.index("text")
    flat = met.select("row", "__spans")  # the row stays one struct to the end, so its columns may have any names

    def mask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = batch.column(0).flatten()
            texts = columns[place].to_pylist()
            for i, spans in enumerate(batch.column(1).to_pylist()):
                if spans:
                    texts[i] = masked(texts[i], [(s["start"], s["end"]) for s in spans], mask)
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return flat.mapInArrow(mask_all, docs.schema)


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with each stretch of overlapping spans, given in order, replaced by ``mask``."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
