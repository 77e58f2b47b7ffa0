"""Ranks and exact percentiles of columns, without one task that sees all values.

Values are range-partitioned, sums within a partition are running sums there, and what lies in the
partitions before comes from a table with one row for each partition, which is small enough to
broadcast whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import saved


def running(counts: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """counts (by, value, c; a row for each value) with upto, the sum of c up to the value, and n, that of all; each within `by`."""
    by = by or []
    rows = saved(counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()))  # saved: the parts stay as they are
    parts = rows.groupBy(*by, "part").agg(F.sum("c").alias("here"))
    order = Window.partitionBy(*by)
    before = F.coalesce(F.sum("here").over(order.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).withColumn("n", F.sum("here").over(order)).drop("here")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "part").orderBy(value))
    return rows.join(F.broadcast(parts), [*by, "part"]).withColumn("upto", upto).drop("part", "before")


def percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: n, the values that are not null, and by name their exact percentiles, interpolated; nulls if there are none."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("c"))
    at, picked = running(counts, "value"), [F.max("n").alias("n")]
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        for end, f in (("low", F.floor), ("high", F.ceil)):
            nth = f(place)
            picked.append(F.max(F.when((F.col("upto") > nth) & (F.col("upto") - F.col("c") <= nth), F.col("value"))).alias(f"{name}_{end}"))
    ends = at.agg(*picked)
    out = [F.coalesce("n", F.lit(0)).alias("n")]
    for name, share in shares.items():
        place, low, high = F.lit(share) * (F.col("n") - 1), F.col(f"{name}_low"), F.col(f"{name}_high")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return ends.select(*out)
