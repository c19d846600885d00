"""Smaller rules on rows: contamination, service time, routes, references, overlap of prompts, threshold checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions import text as T

# Long names that short route outcomes stand for.
ROUTES = {"semantic": "semantic_placement", "exact": "exact_placement", "prefix": "exact_placement", "random": "fallback", "none": "fallback"}


def cold_contaminated(cached: Column, block: int = 16) -> Column:
    """Whether a cold request found more than a block cached; null where nothing was reported."""
    return F.when(cached.isNotNull(), cached > block)


def pair_class(error_a: Column, error_b: Column, cached_a: Column, cached_b: Column, block: int = 16) -> Column:
    """errored, contaminated or usable, of two runs of one prompt."""
    bad = lambda e: F.coalesce(e, F.lit("")) != ""
    warm = lambda c: F.coalesce(c, F.lit(0)) > block
    return F.when(bad(error_a) | bad(error_b), "errored").when(warm(cached_a) | warm(cached_b), "contaminated").otherwise("usable")


def service_ms(parts: Column) -> Column:
    """Sum of an array of times, a missing one counting as none."""
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def route_outcome(*headers: Column) -> Column:
    """The first header that is given, in lower case without blanks around it, short names written out."""
    given = F.coalesce(*(F.nullif(F.trim(F.lower(h)), F.lit("")) for h in headers))
    names = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    return F.coalesce(names[given], given)


def settle_seconds(items: Column, delay_ms: Column, lanes: Column) -> Column:
    """Seconds spent waiting after donors, lanes waiting side by side."""
    return F.when((items > 0) & (delay_ms > 0), items * delay_ms / 1000 / F.greatest(lanes, F.lit(1))).otherwise(0.0)


def references(rows: DataFrame) -> DataFrame:
    """(item_id, stream_position, output_text): the first row of each item outside the warm arm."""
    cold = rows.where("arm <> 'warm'")
    return cold.groupBy("item_id").agg(F.min_by(F.struct("stream_position", "output_text"), "ordinal").alias("r")).select("item_id", "r.*")


def reference_answers(probes: DataFrame, refs: DataFrame) -> DataFrame:
    """(item_id, status, answer): each probe's cold answer; a reference at another place of the stream is none."""
    j = probes.select("item_id", F.col("stream_position").alias("p")).join(refs.withColumn("known", F.lit(True)), "item_id", "left")
    moved = F.coalesce(F.col("p") != F.col("stream_position"), F.lit(False))
    status = F.when(F.col("known").isNull(), "missing").when(moved, "moved").when(F.coalesce("output_text", F.lit("")) == "", "empty").otherwise("answered")
    return j.withColumn("status", status).select("item_id", "status", F.when(F.col("status") == "answered", F.col("output_text")).alias("answer"))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{T.SPACE}]+"), lambda w: w != "")


def word_runs(words: Column, size: int = 16) -> Column:
    """Distinct runs of `size` of an array of words, a plain column; a shorter text is one run."""
    n = F.greatest(F.size(words) - size + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))


def overlap_ratio(original: Column, other: Column) -> Column:
    """Share of `other`'s word runs, both being arrays of distinct ones, that stand in `original`; 1.0 if it has none."""
    return F.when(F.size(other) == 0, 1.0).otherwise(F.size(F.array_intersect(other, original)) / F.size(other))


def check(metrics: DataFrame, limits: dict[str, tuple[str, float]], allow_missing: bool = False) -> DataFrame:
    """(metric, value, relation, bound, status) of a row of metrics against limits.

    `limits` maps a metric to (">=" or "<=", bound). A metric that was not measured fails, unless it
    may be missing, when it is skipped; it never passes.
    """
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(r).alias("relation"), F.lit(float(b)).alias("bound")) for m, (r, b) in limits.items()]
    rows = metrics.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    ok = F.when(F.col("relation") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return rows.withColumn("status", F.when(F.col("value").isNull(), "skipped" if allow_missing else "missing").when(ok, "passed").otherwise("failed"))
