"""Order-preserving removal of sources that share a token window with an earlier kept one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reprise.functions import text as T
from reprise.session import materialise

WINDOW = 16


def shared_windows(sources: DataFrame, order: str, text: str, window: int = WINDOW) -> DataFrame:
    """(o, h): the windows, as 64-bit hashes, of each source that another source holds too."""
    ids = sources.select(F.col(order).alias("o"), T.token_ids(F.col(text)).alias("ids"))
    hashes = ids.select("o", F.explode(F.array_distinct(F.transform(F.filter(T.windows(F.col("ids"), window), lambda w: ~T.degenerate(w)), lambda w: F.xxhash64(w)))).alias("h"))
    several = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return hashes.join(several, "h").select("o", "h")


def first_overlaps(windows: DataFrame, order: str) -> DataFrame:
    """(order, n_windows, first): of each source that shares windows, how many, and the first that holds one of them."""
    first = windows.groupBy("h").agg(F.min("o").alias("first"))
    return windows.join(first, "h").groupBy(F.col("o").alias(order)).agg(F.count("*").alias("n_windows"), F.min("first").alias("first"))


def greedy_keep(sources: DataFrame, windows: DataFrame, order: str) -> DataFrame:
    """(order, kept): the first source is kept, and each next unless it shares a window with a kept earlier one.

    Decided in rounds: a source that is the first undecided holder of all its windows, none of them
    having a kept earlier holder, is kept; one with such a window is dropped. Sources meet in
    aggregates by window, so a window that a third of all sources hold makes no pairs. Rounds are as
    many as the longest chain of decisions that depend on each other; state is checkpointed.
    """
    # `first_kept` of a window is its least kept holder so far; only windows of undecided sources go on.
    open_ = materialise(windows.withColumn("first_kept", F.lit(None).cast(windows.schema["o"].dataType)))
    dropped = None
    while not open_.isEmpty():
        by = open_.groupBy("h").agg(F.min("first_kept").alias("kept_"), F.min("o").alias("first_open"))
        seen = open_.join(by, "h")
        of = seen.groupBy("o").agg(F.bool_or(F.coalesce(F.col("kept_") < F.col("o"), F.lit(False))).alias("blocked"), F.bool_and(F.col("first_open") == F.col("o")).alias("leads"))
        decided = materialise(of.where("blocked OR leads").select("o", (~F.col("blocked")).alias("kept")))
        lost = decided.where("NOT kept").select("o")
        dropped = lost if dropped is None else dropped.union(lost)
        told = seen.join(decided, "o", "left")
        now_kept = told.where("kept").groupBy("h").agg(F.min("o").alias("now"))
        rest = told.where("kept IS NULL").select("o", "h", "kept_").join(now_kept, "h", "left")
        open_ = materialise(rest.select("o", "h", F.least("kept_", "now").alias("first_kept")))
    if dropped is None:
        return sources.select(order, F.lit(True).alias("kept"))
    lost = dropped.select(F.col("o").alias(order), F.lit(False).alias("_kept"))
    return sources.select(order).join(lost, order, "left").select(order, F.coalesce("_kept", F.lit(True)).alias("kept"))


def cap_per_dataset(sources: DataFrame, order: str, cap: int) -> DataFrame:
    """The first `cap` sources of each dataset; the limit is applied within partitions first."""
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(order))
    return sources.withColumn("rank", rank).where(F.col("rank") <= cap)
