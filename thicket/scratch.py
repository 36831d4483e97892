"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a local one is made only where none is set, on a local master."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    there = there or getattr(spark, "_thicket_scratch", None)
    if not there:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = spark._thicket_scratch = tempfile.mkdtemp(prefix="thicket-")
    return there.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: later stages neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/thicket-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._thicket_path = path
    _WRITTEN.append((spark, path))
    return out


def drop(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_thicket_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session's queries have left for their results to read; to be called when those are written."""
    for s, path in list(_WRITTEN):
        if s is spark:
            _delete(spark, path)
            _WRITTEN.remove((s, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns (in any letter case) that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c.replace('`', '``')}`" for c in df.columns if c.lower() not in taken])


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with Arrow batches in its session of at most so many rows: by default 10,000 long texts at once go through the memory of the JVM and of a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df
