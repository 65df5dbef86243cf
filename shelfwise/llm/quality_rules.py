"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio, in SQL functions only.

Word unigrams and bigrams are hashed into ``buckets`` cells. Two multinomials are counted over all
rows, one over the trusted target rows and one over the raw corpus. One is added to each raw cell. The target
gets ``prior`` counts a cell too, but dealt out as the raw corpus is: where the trusted rows are few it stays near the
raw one, and the score near zero, instead of being pulled to flat. With ``prior`` zero, one is added to each target cell. A document scores the mean over its n-grams of log p_target - log p_raw, and is kept if that
is no less than ``threshold``; there is no sampling and no random number.

Null or empty text: no words, all counts zero, score 0, base_failed. Repeated rows: each is
counted and judged. No trusted row, or an empty table: with a prior every score is 0, so all that passes the base rules
is kept; without one the scores come from the raw counts alone, still deterministic. Other columns are not touched and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE, WORD_CHAR, let

SYMBOLS = "#*$%&|<>"
#: A bitmap of the trusted ids takes 4 kB for 32,768 ids in a row; beyond so many bitmaps they are joined, not broadcast.
BROADCAST_BITMAPS = 2_000


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 16_384  # a power of two
    threshold: float = -0.08
    min_words: int = 50
    max_repeat_percent: int = 50
    prior: float = 0.0  # counts a cell that the target takes over from the raw corpus


#: For tables of any size: clean texts unlike the few trusted rows are not rejected for that.
SMOOTH = QualityRules(prior=8.0)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _cell(hash_: Column, buckets: int) -> Column:
    return hash_.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add ``rep``: words in 3-word windows that occur twice or more in the text. ``h`` has the words' hashes.

    Where the windows' hashes are all different, there are none. Else each window becomes one long, its hash
    above its position, and sorting the longs brings equal windows together. Neighbours with equal hashes are
    compared word by word. The positions found are sorted again, and each covers three words, or as
    many as there are up to the next.
    """
    w, h, n = F.col("w"), F.col("h"), F.col("n")
    width = F.length(F.bin(n.cast("long")))
    none, three, zero = F.array().cast("array<bigint>"), F.lit(3).cast("long"), F.lit(0).cast("long")
    starts = F.sequence(F.lit(0), n - 3)

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))

    def low(bits: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def same(x: Column, y: Column, bits: Column) -> Column:
        p, q = x.bitwiseAND(low(bits)).cast("int"), y.bitwiseAND(low(bits)).cast("int")
        equal = F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0
        for k in range(3):
            equal = equal & (F.get(w, p + k) == F.get(w, q + k))
        return equal

    def twice(bits: Column) -> Column:
        packed = F.transform(starts, lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long")))
        return let(
            F.sort_array(packed),
            lambda s: F.transform(
                F.filter(
                    s,
                    lambda x, i: ((i > 0) & same(x, F.get(s, i - 1), bits))
                    | ((i < F.size(s) - 1) & same(x, F.get(s, i + 1), bits)),
                ),
                lambda x: x.bitwiseAND(low(bits)),
            ),
        )

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, i: F.least(three, F.coalesce(F.get(at, i + 1) - p, three))), zero, lambda a, x: a + x
        )

    df = df.withColumn("windows", F.when(n >= 3, F.transform(starts, window)).otherwise(none))
    fresh = F.size("windows") == F.size(F.array_distinct("windows"))
    return df.withColumn("rep", F.when(fresh, zero).otherwise(let(F.sort_array(let(width, twice)), covered)))


def trusted_flag(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows (doc_id, text, target). ``trusted`` has doc_id; repeated or null ids there do no harm.

    The ids go into bitmaps, which are broadcast while they are few, so texts are not shuffled.
    """
    maps = trusted.filter("doc_id is not null").groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bitmap")
    )
    if maps.count() <= BROADCAST_BITMAPS:
        maps = F.broadcast(maps)
    ids = docs.withColumn("bucket", F.bitmap_bucket_number("doc_id")).withColumn("bit", F.bitmap_bit_position("doc_id"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return ids.join(maps, "bucket", "left").select("doc_id", "text", F.coalesce(hit, F.lit(False)).alias("target"))


def weights(docs: DataFrame, trusted: DataFrame, rules: QualityRules) -> Column:
    """Log ratio of each cell as one array (a scalar subquery of ``buckets`` numbers)."""
    flagged = trusted_flag(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), trusted)
    w = flagged.select("target", _words(F.col("text")).alias("w"))
    pairs = w.select("target", F.inline(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))))
    one = F.xxhash64("a")
    two = F.when(F.col("b").isNotNull(), F.xxhash64(one, F.xxhash64("b")))
    cells = pairs.select("target", F.explode(F.array(_cell(one, rules.buckets), _cell(two, rules.buckets))).alias("cell"))
    cells = cells.filter("cell is not null")
    every = flagged.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("cell"), F.lit(0).alias("raw"), F.lit(0).alias("trust"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("raw"), F.count_if("target").alias("trust"))
    counts = counts.unionByName(every).groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("trust").alias("trust"))
    b = F.lit(float(rules.buckets))
    packed = counts.agg(
        F.array_sort(F.collect_list(F.struct("cell", "raw", "trust"))).alias("cells"),
        F.sum("raw").alias("raws"), F.sum("trust").alias("trusts"),
    )
    m = F.lit(rules.prior * rules.buckets)

    def log_ratio(c: Column) -> Column:
        p_raw = (c["raw"] + 1) / (F.col("raws") + b)
        if rules.prior:
            return F.log((c["trust"] / p_raw + m) / (F.col("trusts") + m))
        return F.log((c["trust"] + 1) / (F.col("trusts") + b)) - F.log(p_raw)

    ratio = F.transform("cells", log_ratio)
    return packed.select(ratio).scalar()


def judge(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Rows of ``docs`` as ``row`` (a struct of all columns) with the counts, ``score`` and ``kept``."""
    text = F.coalesce("row.text", F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.withColumn("w", _words(text)).withColumn("n", F.size("w"))
    df = _with_repeats(df.withColumn("h", F.transform("w", lambda a: F.xxhash64(a))))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD_CHAR)))
    df = df.withColumn("lines", lines).withColumn("weights", weights(docs, trusted, rules))
    h, ratio = F.col("h"), lambda x: F.get(F.col("weights"), _cell(x, rules.buckets))
    total = F.aggregate(
        F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0),
        lambda a, i: a + ratio(F.get(h, i))
        + F.when(i < F.size(h) - 1, ratio(F.xxhash64(F.get(h, i), F.get(h, i + 1)))).otherwise(F.lit(0.0)),
    )
    df = df.withColumn("score", F.when(F.col("n") > 0, total / (2 * F.col("n") - 1)).otherwise(F.lit(0.0)))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    n = F.col("n").cast("long")
    failed = (n < rules.min_words) | (100 * F.col("rep") > rules.max_repeat_percent * n)
    return df.select(
        "row", n.alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("rep").alias("n_repeat_words"),
        failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= rules.threshold)).alias("kept"),
    )


def keep(docs: DataFrame, trusted: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept.

    The condition also reads a row number. Without it, the optimizer would move the filter below the
    columns it is made of, and write each of them out again wherever it is used.
    """
    judged = judge(docs, trusted, rules).withColumn("number", F.monotonically_increasing_id())
    return judged.filter("kept and number >= 0").select("row.*")
