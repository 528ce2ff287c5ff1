"""Running sums over a whole table without a single-task window.

Rows are dealt into ranges of their key, each of about ``ROWS`` rows whatever the keys are; the totals of the ranges are summed first
(a table of one row a range), then the rows within each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.scratch import small, written

ROWS = 1 << 17


def running_sums(df: DataFrame, key: str, sums: dict[str, str], rows: int = ROWS) -> DataFrame:
    """Adds, for each name: column in ``sums``, the sum of the column over all rows with a smaller key."""
    ranges = max(1, -(-df.count() // rows))
    # written once, so that rows keep the range that they were dealt to
    tagged = written(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = tagged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inner = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = tagged.join(small(bases), "_range")
    return joined.select(*df.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).cast("long").alias(n) for n, c in sums.items()])
