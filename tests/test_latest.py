"""Superseded results are dropped, whatever the order of batches; state goes with the watermark."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirework.streaming import latest


@pytest.mark.parametrize(("op", "cancelled", "rows", "out"), [(-1, False, [(1, "start")], (1, False)), (3, False, [(2, "result")], (3, False)), (3, True, [(3, "result")], (3, True)), (3, True, [(4, "start")], (4, False)), (3, False, [(3, "cancel")], (3, True)), (3, False, [(2, "cancel"), (5, "start")], (5, False))])
def test_newest(op, cancelled, rows, out):
    assert latest.newest(op, cancelled, pd.DataFrame(rows, columns=["op", "kind"])) == out


def test_out_of_order_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [(1, 1, "start", "00:00:00", None), (2, 5, "start", "00:00:01", None)],
        [(1, 2, "start", "00:00:05", None), (1, 1, "result", "00:00:04", "old"), (2, 5, "result", "00:00:06", "kept")],
        [(1, 2, "result", "00:00:07", "new"), (1, 1, "result", "00:00:03", "older"), (2, 6, "start", "00:00:08", None), (2, 6, "cancel", "00:00:09", None), (2, 6, "result", "00:00:09", "cancelled")],
        [(3, 1, "result", "02:00:00", "far later")],
        [(4, 1, "result", "02:00:01", "another")],
        [(2, 1, "result", "02:00:02", "after its state went")],
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "doc_id long, op long, kind string, at string, value string").withColumn("at", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "at")))
        df.coalesce(1).write.parquet(f"file://{tmp_path}/in/batch={k}")
    try:
        # A file a batch, in order.
        stream = spark.readStream.schema(latest.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        q = latest.latest_results(stream).writeStream.format("memory").queryName("latest").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.doc_id, r.op, r.value) for r in spark.table("latest").collect())
    assert got == [(1, 2, "new"), (2, 1, "after its state went"), (2, 5, "kept"), (3, 1, "far later"), (4, 1, "another")]
