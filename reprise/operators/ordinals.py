"""Global row numbers and running sums without a window over everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reprise.session import materialise


def with_ordinal(rows: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Rows with their place from 0 in the order of a column without repeats.

    Rows are range-partitioned and numbered within partitions; only the partitions' sizes, one
    number each, go to the driver. Keep `rows` narrow: it is checkpointed, as ranges come from a sample.
    """
    placed = materialise(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    numbered = placed.withColumn(name, (F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1).cast("bigint"))
    sizes = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())
    if len(sizes) < 2:
        return numbered.drop("_p")
    before, starts = 0, []
    for p, n in sizes:
        starts += [F.lit(p), F.lit(before)]
        before += n
    return numbered.withColumn(name, F.col(name) + F.create_map(*starts)[F.col("_p")]).drop("_p")


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of `value` up to and including each, in the order of a column without repeats."""
    placed = materialise(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    part = placed.withColumn(name, F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = sorted((r["_p"], r["s"] or 0) for r in placed.groupBy("_p").agg(F.sum(value).alias("s")).collect())
    before, starts = 0, []
    for p, n in sums:
        starts += [F.lit(p), F.lit(before)]
        before += n
    return part.drop("_p") if len(sums) < 2 else part.withColumn(name, F.col(name) + F.create_map(*starts)[F.col("_p")]).drop("_p")


def carried(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Rows with the latest value, nulls aside, of the rows before them of the same key; `order` has no repeats within a key.

    Rows are range-partitioned by (key, order), so a key that a third of all rows have is spread;
    only the last value of each partition, with its key, goes to the driver. Values must be narrow.
    """
    placed = materialise(rows.withColumn("_o", F.struct(F.col(key).alias("k"), F.col(order).alias("o"))).repartitionByRange("_o").withColumn("_p", F.spark_partition_id()))
    # Values as structs, so that they can be handed back as literals of a table.
    own = Window.partitionBy("_p", "_o.k").orderBy("_o.o").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_v", F.last(value, ignorenulls=True).over(own))
    # The last value of the last key in each partition that has one.
    ends = placed.where(F.col(value).isNotNull()).groupBy("_p").agg(F.max(F.struct("_o", F.col(value).alias("v"))).alias("e")).select("_p", F.col("e._o.k").alias("k"), F.col("e.v").alias("v"))
    given = sorted(r["_p"] for r in ends.select("_p").collect())
    parts = sorted(r["_p"] for r in placed.select("_p").distinct().collect())
    before, last = [], None
    for p in parts:
        if last is not None:
            before.append((p, last))
        if p in set(given):
            last = p
    if not before:
        return within.withColumnRenamed("_v", name).drop("_o", "_p")
    links = rows.sparkSession.createDataFrame(before, "_q int, _p int").join(ends, "_p").select(F.col("_q"), F.col("k").alias("_k"), F.col("v").alias("_w"))
    both = within.join(F.broadcast(links), (F.col("_p") == F.col("_q")) & F.col("_o.k").eqNullSafe(F.col("_k")), "left")  # a row per partition
    return both.withColumn(name, F.coalesce("_v", "_w")).drop("_o", "_p", "_v", "_q", "_k", "_w")
