"""The same preprocessing over file streams: each micro-batch is a batch job with exactly-once output folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirework.operators.storage import temporary
from quirework.plans.preprocess import preprocess, raw_documents


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, kind: str = "general") -> StreamingQuery:
    """Chunks of a stream of docs (doc_id, text) as Parquet, partitioned by batch; a repeated batch replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch's own tables go with it, so an endless stream fills no disk.
        with temporary(batch.sparkSession):
            chunks, _, _ = preprocess(raw_documents(batch), kind)
            chunks.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_documents(docs: DataFrame, time: str, delay: str, key: str = "doc_id") -> DataFrame:
    """Resubmitted documents once, within a watermark; state is bounded by the delay."""
    return docs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
