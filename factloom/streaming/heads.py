"""Ingest of fact items as a stream, with the guarded head kept for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def head_stream(items: DataFrame) -> DataFrame:
    """The guarded head of a stream of facts as a stateful aggregate; nothing is late, so there is no watermark."""
    order = F.struct(F.coalesce("valid_from", F.lit(0)).cast("long").alias("at"), F.col("seq"))
    won = items.groupBy("subject", "predicate").agg(F.max_by(F.struct("op", "object", "valid_from", "seq"), order).alias("w"))
    return won.select("subject", "predicate", "w.*")


def append_log(items: DataFrame, log_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends micro-batches to the log; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    q = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="15 seconds")).start()


def reset_log(spark: SparkSession, log_path: str, confirm: bool) -> None:
    """Wipes a log of micro-batches: an empty table of its columns takes its place. Only ``confirm=True`` does so."""
    if confirm is not True:
        raise ValueError("a log is wiped only with confirm=True")
    columns = spark.read.parquet(log_path).drop("batch").schema
    spark.createDataFrame([], columns).write.mode("overwrite").parquet(log_path)


def ingest(items: DataFrame, log_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends micro-batches to a log that commits each as a whole: the sink's own record of committed batches is what
    readers go by, a batch that runs again is the same batch, and what a killed run left is not seen."""
    q = items.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime="15 seconds")).start()


def reset_item(seq: int, confirm: bool) -> dict:
    """The write that wipes a log: readers see nothing of what was written before it. It is committed as any other, so that
    they see all of the log or none. Only ``confirm=True`` makes one."""
    if confirm is not True:
        raise ValueError("a log is wiped only with confirm=True")
    return {"seq": seq, "op": "reset"}


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """The committed items of a log that were written after its last reset."""
    log = spark.read.parquet(log_path)
    last = log.where("op = 'reset'").agg(F.max("seq").alias("__reset"))  # one row
    return log.where("op != 'reset'").join(F.broadcast(last)).where("__reset is null or seq > __reset").drop("__reset")
