"""Written intermediate tables in the cluster's shared folder, and sums over ordered blocks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: list[str] = []
#: The driver's folder of files that are sent to executors.
_sent: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, in local sessions only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quirework-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = f"file://{_own[0]}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy", **options: object) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    for key, value in options.items():
        writer = writer.option(key.replace("_", "."), str(value))
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; what was derived from them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a written table for broadcast if it has at most this many rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sent_file(spark: SparkSession, name: str, size: int, parts: Iterable[tuple[int, bytes]]) -> str:
    """Send a file of size bytes to all executors, with each part (place, bytes) where it belongs and zeros elsewhere.

    Parts pass the driver one by one and lie on its disk. Spark keeps such a file until the session ends, since executors
    that start later fetch it too.
    """
    if not _sent:
        _sent.append(tempfile.mkdtemp(prefix="quirework-sent-"))
        atexit.register(shutil.rmtree, _sent[0], ignore_errors=True)
    path = os.path.join(os.path.realpath(_sent[0]), f"{name}-{uuid.uuid4().hex}")
    with open(path, "wb") as file:
        file.truncate(size)
        for at, part in parts:
            file.seek(at)
            file.write(part)
    spark.sparkContext.addFile(f"file://{path}")
    return os.path.basename(path)


def mapped(name: str, kind: str) -> np.ndarray:
    """In a task: a sent file as an array, whose pages the workers of an executor share."""
    return np.asarray(np.memmap(SparkFiles.get(name), kind, "r"))


def running_total(df: DataFrame, keys: list[str], block: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add the sum of value over the rows before each row, within keys, ordered by (block, *order).

    Two levels: totals of blocks are summed over few rows, rows only within their block, so that no task
    has to order all rows of a key.
    """
    spark_keys = [*keys, block]
    totals = df.groupBy(*spark_keys).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(F.col(block).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(spark_keys)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(spark_keys)]
    within = Window.partitionBy(*spark_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(totals, same).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within", *[f"_k{n}" for n in range(len(spark_keys))])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are written: it waits for the driver's JVM to collect garbage."""
    spark.sparkContext._jvm.System.gc()
