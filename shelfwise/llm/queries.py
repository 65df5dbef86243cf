"""The dealt operators as registered queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    alignment, byte_bpe, licenses, neighbours, packing, passages, periodic, quality_rules, secrets, sharding, simhash, toxicity, url_filter,
    url_labels,
)
from shelfwise.llm.common import saved, table, table_saved
from shelfwise.llm.url_filter import Rule, UrlModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    out = quality_rules.judge(table(spark, folder, "documents"), trusted, quality_rules.SMOOTH)
    return out.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.round("score", 9).alias("score"),
    )


URL_RULES = [
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
]
#: Steps, momentum and limit chosen on the labelled hosts that are held out.
URL_MODEL = UrlModel(rounds=150, rate=4.0, momentum=0.9)


def labelled_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """(url, label), 1 for unwanted: the training part of the labelled table, or the hosts held out of it."""
    return spark.createDataFrame(url_labels.rows(held_out), "url string, label int")


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    out = url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES, labelled_urls(spark), URL_MODEL)
    return out.select("row.page_id", "host", "path", "rule", "verdict", F.round("probability", 9).alias("probability"))


@query
def op8_histogram_sort(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.shard(table(spark, folder, "documents"))
    return out.select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def packed(docs: DataFrame) -> DataFrame:
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    slim = saved(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(slim).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query
def op5_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    out = secrets.find(table(spark, folder, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query
def op2_paragraph_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeats(table(spark, folder, "documents"))


@query
def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    shared, pattern = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    ids = byte_bpe.encode_in_tasks(table(spark, folder, "documents"), shared, pattern)
    return byte_bpe.decode_in_tasks(ids, shared, pattern).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op11_tokenizer_spans(spark: SparkSession, folder: str) -> DataFrame:
    shared = alignment.vocabularies(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    out = alignment.align(table(spark, folder, "documents").select("doc_id", "text"), shared, spans=False)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    slim = table_saved(
        out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"), compression="zstd"
    )
    return alignment.rated(slim, alignment.pair_counts(slim))


@query
def op12_block_convolution(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = periodic.find(docs, periodic.with_repeats(F.col("text"), F.col("doc_id"))).withColumn("long", periodic.longest())
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "long.start", "long.length", "long.period",
        F.floor(F.col("long.length") * 1000 / F.col("long.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_license_join(spark: SparkSession, folder: str) -> DataFrame:
    out = licenses.scan(table(spark, folder, "documents"), keep=["doc_id"])
    base = F.array_distinct(F.transform("found", lambda x: x["label"]))
    every = F.array_distinct(F.concat(base, F.transform("hits", lambda x: x["label"])))
    starts = F.transform("found", lambda x: x["start"])
    score = F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda x: x["score"])), F.lit(0.0)))
    return out.select(
        "row.doc_id", "n_words", F.size("found").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), score.alias("score"),
    )
