"""Written intermediate tables, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Paths written within the open scopes, the innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are cut within, at the end: what is derived from them must be written by then."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(scan: DataFrame, key: str, rounds: int = 0) -> DataFrame:
    """A scan of fewer files than the session runs tasks at once, dealt by key: a file with one row group is one task else.

    A table of many files is left as it is, so no text is shuffled where the scan is parallel already. Small rows that take
    long are dealt into so many tasks a core, which aren't joined again for their few bytes.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if len(scan.inputFiles()) >= cores:
        return scan
    return scan.repartition(rounds * cores, key) if rounds else scan.repartition(key)


def parts(rows: DataFrame, each: int = 200_000) -> int:
    """In how many partitions rows of a stored table are dealt, so many rows to each; Parquet counts them in its footers.

    Spark joins shuffled partitions by their compressed bytes, and rows that compress well make a task as large as its
    share of the table. A count that is given isn't joined, so a task's memory stays as tables grow.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and read it again: later steps plan and run on files.

    A local session without that setting uses a temporary folder of this process. Within `temporary` the table goes
    when the scope ends; elsewhere it stays as long as the folder does.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quirework-lines-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = f"file://{_own[0]}"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
