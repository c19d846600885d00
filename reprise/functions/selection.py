"""Exact percentiles of groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.operators.ordinals import running_sum


def exact_percentiles(values: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(key, n, a column per name in `wanted`): percentiles by linear interpolation between ranks.

    Equal values are counted before anything moves, the counts are range-partitioned by (key, value)
    and summed up along that order; only the partitions' sums reach the driver. A hot key is spread
    over partitions, a hot value is one row. Null values are none; a null key is a group.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = running_sum(counts.select(F.struct(F.col("k").isNotNull().alias("some"), "k", "v").alias("o"), "c"), "o", "c", "upto")
    totals = counts.groupBy("k").agg(F.sum("c").alias("n"))
    rows = placed.select("o.k", "o.v", "c", "upto")
    # What lies before a key's first value is what all keys before it hold.
    before = rows.groupBy("k").agg(F.min(F.col("upto") - F.col("c")).alias("base")).withColumnRenamed("k", "k2")
    ends = totals.join(before, F.col("k").eqNullSafe(F.col("k2"))).drop("k2").withColumnRenamed("k", "k2")
    of = rows.join(ends, F.col("k").eqNullSafe(F.col("k2"))).drop("k2").withColumn("last", F.col("upto") - F.col("base") - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    out = []
    for name, p in wanted.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        value_at = lambda r: F.min(F.when((F.col("first") <= r) & (F.col("last") >= r), F.col("v")))
        low, high = F.floor(at), F.ceil(at)
        out.append((name, value_at(low), value_at(high), F.max(at - low)))
    found = of.groupBy("k").agg(F.max("n").alias("n"), *(x.alias(f"{name}_{i}") for name, *xs in out for i, x in enumerate(xs)))
    return found.select(F.col("k").alias(key), "n", *((F.col(f"{m}_0") + (F.col(f"{m}_1") - F.col(f"{m}_0")) * F.col(f"{m}_2")).alias(m) for m in wanted))
