"""What ran when: requests in flight, gaps between related requests, nearest earlier donors, throughput."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.operators.ordinals import carried, running_sum, with_ordinal


def in_flight(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: wall, busy and idle seconds and the most requests at once, of rows (start_s, end_s).

    A sweep over starts and ends; a request that ends when another starts has ended first.
    """
    marks = rows.select(*keys, F.explode(F.array(F.struct(F.col("start_s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_s").alias("t"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.t", "m.d")
    by = marks.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    # One running sum over all keys: starts and ends of a key cancel out, so it is 0 where the next begins.
    run = with_ordinal(running_sum(by.select(F.struct(*keys, "t").alias("o"), "d"), "o", "d", "n"), "o").select("ordinal", "o.*", "n")
    after = run.select((F.col("ordinal") - 1).alias("ordinal"), *(F.col(k).alias(f"_{k}") for k in keys), F.col("t").alias("_t"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    gap = F.when(reduce(Column.__and__, same), F.col("_t") - F.col("t"))
    return run.join(after, "ordinal", "left").groupBy(*keys).agg((F.max("t") - F.min("t")).alias("wall_s"), F.max("n").alias("most_at_once"), F.coalesce(F.sum(F.when(F.col("n") == 0, gap)), F.lit(0.0)).alias("idle_s"))


def gap_shortfall(rows: DataFrame, keys: list[str], unit: str, least: int) -> DataFrame:
    """For each repeated `unit` within `keys`: requests finished between its last finish and this start, and how many short of `least` that is.

    One running count over starts and finishes in time order; no join between rows. A request
    without a duration never finished.
    """
    marks = rows.select(*keys, unit, "id", F.explode(F.array(F.struct(F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).alias("t"), F.lit(0).alias("start")), F.struct(F.col("start_s").alias("t"), F.lit(1).alias("start")))).alias("m")).select(*keys, unit, "id", "m.t", "m.start").where("t IS NOT NULL")
    ordered = running_sum(marks.select(F.struct(*keys, "t", "start", "id").alias("o"), F.struct(*keys, unit).alias("u"), (1 - F.col("start")).alias("ends")), "o", "ends", "done")
    # Counts go on from key to key, which differences within a key don't see.
    at = carried(ordered.withColumn("last", F.when(F.col("ends") == 1, F.col("done"))), "u", "o", "last", "before")
    seen = at.withColumn("gap", F.col("done") - F.col("before")).where("ends = 0 AND gap IS NOT NULL")
    return seen.select(*(F.col(f"o.{k}").alias(k) for k in keys), F.col(f"u.{unit}").alias(unit), "o.id", "gap", F.greatest(F.lit(0), F.lit(least) - F.col("gap")).alias("shortfall"))


def nearest_earlier(refs: DataFrame, stages: DataFrame, key: str, position: str) -> DataFrame:
    """As-of join: each ref (id, key, position) with the latest stage of its key before its position; refs without one are left out.

    Refs and stages are merged and carried forward in one pass, so no pairs arise and no key is one
    task. Of stages at one position the greatest id counts.
    """
    marks = refs.select(F.col(key).alias("k"), F.col(position).alias("p"), F.lit(0).alias("kind"), "id").union(stages.select(F.col(key), F.col(position), F.lit(1), "id"))
    stage = F.when(F.col("kind") == 1, F.struct("p", "id"))
    found = carried(marks.select("k", F.struct("p", "kind", "id").alias("o"), stage.alias("s")), "k", "o", "s", "found").where("o.kind = 0 AND found IS NOT NULL")
    return found.select("o.id", F.col("k").alias(key), F.col("o.p").alias(position), F.col("found.id").alias("stage"), F.col("found.p").alias("stage_position"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, wanted: tuple[int, ...]) -> DataFrame:
    """p-th values by nearest rank, half ranks going to the even one; null values are none.

    Equal values are counted first and ranks are running sums over ranges, so no group is one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = running_sum(counts.select(F.struct(*keys, "v").alias("o"), F.struct(*keys).alias("g"), "c"), "o", "c", "upto")
    totals = placed.groupBy("g").agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("base")).withColumnRenamed("g", "g2")
    ranked = placed.join(totals, F.col("g").eqNullSafe(F.col("g2")))
    first, last = F.col("upto") - F.col("c") - F.col("base"), F.col("upto") - F.col("base") - 1
    rank = lambda p: F.rint((F.col("n") - 1).cast("double") * (p / 100))
    at: list[Column] = [F.min(F.when((first <= rank(p)) & (last >= rank(p)), F.col("o.v"))).alias(f"p{p}") for p in wanted]
    mean = F.sum(F.col("o.v") * F.col("c")) / F.sum("c")
    return ranked.groupBy("g").agg(*at, mean.alias("mean")).select("g.*", *(f"p{p}" for p in wanted), "mean")


def throughput(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, errors and rates of each run, of rows (start_s, end_s, error, tokens)."""
    flight = in_flight(rows, keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    per = lambda x, s, d: F.when(s > 0, F.bround(x / s, d))
    both = counts.join(flight, keys)
    served = F.greatest(F.col("wall_s") - F.col("idle_s"), F.lit(0.0))
    return both.select(*keys, "requests", "errors", F.bround("wall_s", 3).alias("wall_s"), F.bround("idle_s", 3).alias("idle_s"), "most_at_once", per(F.col("requests"), F.col("wall_s"), 4).alias("rps"), per(F.col("requests"), served, 4).alias("rps_served"), per(F.col("tokens"), F.col("wall_s"), 2).alias("tokens_per_s"))
