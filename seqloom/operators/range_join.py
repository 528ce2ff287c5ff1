"""Interval containment as an equi-join on bins, instead of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 64


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, also: Column | None = None, width: int = BIN) -> DataFrame:
    """Pairs with low <= point < high. Each span is copied to the bins it meets; a point has one bin, so no pair comes twice."""
    binned = points.withColumn("_bin", F.floor(F.col(point) / width))
    cut = spans.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return binned.join(cut, "_bin").where(inside if also is None else inside & also).drop("_bin")
