"""As-of join: each request meets the last span of its group that starts at or before it, by a merge of both sides in ranges.

Both sides are put in one order and dealt into ranges of about ``every`` rows, whatever the groups are. In a range the last span
before a request is a running value; a request before the first span of its range takes the last span of the ranges before, from a
table of one row a range. Cost grows with the rows of both sides and their sorting, and not with their product, also if one group has all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.running import ROWS
from seqloom.scratch import small, written


def asof_join(requests: DataFrame, spans: DataFrame, by: str, at: str, start: str, every: int = ROWS) -> DataFrame:
    """The requests with the columns of their span (other than ``by``); null where their group has none that starts so early.

    Requests without a group or a place have no span. Of spans with one start in a group one is taken, the greatest in its columns.
    """
    taken = [c for c in spans.columns if c != by]
    span = F.struct(F.col(by), F.col(start).alias("_start"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(taken)])
    right = spans.where(F.col(by).isNotNull() & F.col(start).isNotNull()).select(F.col(by).alias("_by"), F.col(start).cast("long").alias("_at"), F.lit(0).alias("_kind"), span.alias("_span"))
    left = requests.select(F.col(by).alias("_by"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(*requests.columns).alias("_request"))
    rows = left.unionByName(right, allowMissingColumns=True)
    order = ["_by", "_at", "_kind"]
    ranges = max(1, -(-rows.count() // every))
    tagged = written(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "asof")
    lasts = tagged.groupBy("_range").agg(F.max("_span").alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_range", F.last("_last", True).over(before).alias("_carried"))
    inner = Window.partitionBy("_range").orderBy(*order, F.col("_span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = tagged.withColumn("_own", F.last("_span", True).over(inner)).where("_kind = 1").join(small(carried), "_range")
    met = met.withColumn("_own", F.coalesce("_own", "_carried"))
    same = (F.col(f"_own.{by}") == F.col("_by")) & F.col("_at").isNotNull()
    return met.select("_request.*", *[F.when(same, F.col(f"_own._{k}")).alias(c) for k, c in enumerate(taken)])
