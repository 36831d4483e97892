"""Texts in; trees in and out, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType, _parse_datatype_string

from thicket.plans.tree import PARTS, Tree


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, path, text): a row for each text file, whole."""
    rows = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
    return rows.select(F.xxhash64("file_path").alias("tree_id"), F.col("file_path").alias("path"), F.col("value").alias("text"))


def save_tree(tree: Tree, path: str) -> None:
    """Nodes and vectors are partitioned by layer, so that a walk reads only the layers it visits."""
    for name in PARTS:
        writer = getattr(tree, name).write.mode("overwrite")
        (writer.partitionBy("layer") if "layer int" in PARTS[name] else writer).parquet(f"{path}/{name}")


def load_tree(spark: SparkSession, path: str) -> Tree:
    """A saved tree; ValueError if a part of it isn't there or has other columns.  Nothing is unpickled."""
    return Tree(*(_part(spark, f"{path}/{name}", _parse_datatype_string(schema)) for name, schema in PARTS.items()))


def _part(spark: SparkSession, path: str, want: StructType) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"{path} holds no part of a saved tree") from e
    lacks = {(f.name, f.dataType.simpleString()) for f in want} - set(df.dtypes)
    if lacks:
        raise ValueError(f"{path} lacks the columns {sorted(lacks)}")
    return df.select(*want.names)
