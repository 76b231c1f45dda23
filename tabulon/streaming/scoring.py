"""Fit in batch, score in stream: a fitted feature map and K-means model label the rows of a stream. Stateless, so without a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.clustering import labelled
from ..operators.features import FeatureMap, apply


def scored(stream: DataFrame, features: FeatureMap, model, to: str = "cluster_label") -> DataFrame:
    return labelled(apply(stream, features), model, to=to).drop("features")


def start(stream: DataFrame, features: FeatureMap, model, path: str, checkpoint: str, **trigger):
    """Writes the labelled rows below ``path`` as Parquet; exactly once by the checkpoint."""
    return scored(stream, features, model).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
