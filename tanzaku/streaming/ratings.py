"""Streams of answers and documents: windowed counts, and merges of micro-batches into a stored table.

The batch operators have no streaming face of their own to match; these two apply them to unbounded input.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_answers(answers: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, choice, n): answers by window of event time; what is later than the watermark is dropped."""
    w = answers.withColumn("ts_", F.col(time).cast("timestamp")).withWatermark("ts_", late)
    return w.groupBy(F.window("ts_", window).alias("w"), "choice").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "choice", "n")


def merge_stream(source: DataFrame, target: str, key: str, text: str, checkpoint: str) -> StreamingQuery:
    """Appends to the parquet table ``target`` the rows of each micro-batch whose text is new or changed.

    Texts are compared by their digests, which lie beside the table in ``<target>_digests`` (key, digest, batch_id), so that a
    batch never reads the texts again. Of rows of one key in a batch the greatest in column order counts. Digests
    follow their rows: a batch that is replayed after a failure may write rows once more, under the same number, and
    loses none. Readers take a row with the greatest ``batch_id`` of a key.
    """
    digests = f"{target}_digests"

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        one = batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("m")).select(key, "m.*").withColumn("digest", F.md5(text))
        try:
            known = spark.read.parquet(digests)
        except AnalysisException:  # the first batch
            known = None
        if known is not None:
            last = known.groupBy(key).agg(F.max_by("digest", "batch_id").alias("digest"))
            same = (F.col(f"one.{key}") == F.col(f"last.{key}")) & F.col("one.digest").eqNullSafe(F.col("last.digest"))
            one = one.alias("one").join(last.alias("last"), same, "left_anti")
        new = one.withColumn("batch_id", F.lit(batch_id).cast("long")).persist()
        try:
            new.select(*batch.columns, "batch_id").write.mode("append").parquet(target)
            new.select(key, "digest", "batch_id").write.mode("append").parquet(digests)
        finally:
            new.unpersist()

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
