"""Chunks and vectors of documents as they arrive; stateless, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thicket.config import ClusterConfig
from thicket.models import embed
from thicket.plans.build import leaves


def stream_leaves(docs: DataFrame, cfg: ClusterConfig | None = None) -> DataFrame:
    """Leaf nodes with their clustering vector for a stream docs(tree_id, text)."""
    cfg = cfg or ClusterConfig()
    model = cfg.embedding_models[cfg.cluster_embedding_model]
    return leaves(docs, cfg).withColumn("embedding", embed(model, F.col("text")))


def write_leaves(docs: DataFrame, path: str, checkpoint: str, cfg: ClusterConfig | None = None, once: bool = True) -> StreamingQuery:
    """Appends the leaves of a stream to Parquet, exactly once by the checkpoint; once: what is there now, then stop."""
    writer = stream_leaves(docs, cfg).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
