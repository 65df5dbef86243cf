"""Profile purchases arriving as a stream, added within the limit of a profile or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfwise.sources.tables import judge_additions


def append_purchases(stream: DataFrame, path: str, checkpoint: str, cap: int, once: bool = True) -> StreamingQuery:
    """Write each micro-batch of (profile_id, id, article_idx, created_at) under ``path``/rows with ``accepted``.

    ``path``/counts holds what each batch added to a profile, one row for each profile and batch, so a
    batch reads counts and not the purchases. Every batch owns one folder in both and overwrites
    it, so a batch retried after a failure adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = T.StructType([batch.schema["profile_id"], T.StructField("held", T.LongType()), T.StructField("batch", T.LongType())])
        before = spark.read.schema(counts).option("ignoreMissingFiles", "true").parquet(f"{path}/counts").filter(f"batch <> {number}")
        held = before.groupBy("profile_id").agg(F.sum("held").alias("held"))
        judged = judge_additions(held, batch, cap)
        judged.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        written = spark.read.parquet(f"{path}/rows/batch={number}").filter("accepted")
        added = written.groupBy("profile_id").agg(F.count("*").alias("held"))
        added.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
