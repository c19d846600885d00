"""Percentiles of large numeric columns from mergeable digests with a deterministic rank error.

Values are quantized to an ordered universe of 2**23 leaves: every power of two that a double can
have, of either sign, in 2,048 equal steps. A leaf is at most 1/2048 of its value wide (2**-1033 below
2**-1022), zero and the infinities have leaves of their own, and nothing is clamped. A digest keeps
counts on nodes of the dyadic tree over the leaves. Two children and their parent are folded into the
parent while their count together stays within n / k. Digests merge by adding the counts of equal
nodes, followed by another compression; no inner node ever holds more than n / k, so a rank is off by
at most 23 n / k, however the values were parted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 23
STEPS = 2048
#: Exponents of the least normal double and of the leaf that holds zero and what is below half a step.
_LEAST_EXPONENT, _ZERO = -1022, 1 << (DEPTH - 1)
#: Share of n by which a rank may be off.
RANK_ERROR = 0.001
PERCENTILES = (50, 90, 95, 99)


def leaf_of(x: Column) -> Column:
    """Leaf of a value that is not NaN: the sign, the exponent and eleven bits of the fraction, in the order of values."""
    size = F.abs(x)
    two = F.lit(2.0)
    guess = F.floor(F.log2(size))
    power = guess + F.when(size >= F.pow(two, guess + 1), 1).when(size < F.pow(two, guess), -1).otherwise(0)
    normal = (power - _LEAST_EXPONENT + 1) * STEPS + F.floor((size / F.pow(two, power) - 1) * STEPS)
    small = F.floor(size * 2.0**-_LEAST_EXPONENT * STEPS)
    place = F.when(size < 2.0**_LEAST_EXPONENT, small).when(size == float("inf"), 2047 * STEPS).otherwise(normal)
    return F.when(x < 0, _ZERO - 1 - place).otherwise(_ZERO + place).cast("int")


def value_of(leaf: Column) -> Column:
    """Middle of a leaf's range; 0 for the leaf of zero."""
    place = F.when(leaf < _ZERO, _ZERO - 1 - leaf).otherwise(leaf - _ZERO)
    field, step = F.floor(place / STEPS), (place % STEPS + 0.5) / STEPS
    size = F.when(field == 0, 2.0**_LEAST_EXPONENT * step).when(field == 2047, float("inf")).otherwise(F.pow(F.lit(2.0), field + _LEAST_EXPONENT - 1) * (1 + step))
    return F.when(leaf == _ZERO, 0.0).when(leaf < _ZERO, -size).otherwise(size)


def compress(group: np.ndarray, level: np.ndarray, node: np.ndarray, count: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """Folds nodes into their parents, bottom up, for many groups at once.

    `group` numbers the groups from 0; `most[g]` is the count that nodes of group g may be folded up to.
    """
    done = []
    for depth in range(DEPTH):
        here = level == depth
        parent = (group[here].astype(np.int64) << DEPTH) | (node[here] >> 1)
        above = level == depth + 1
        own = (group[above].astype(np.int64) << DEPTH) | node[above]
        keys, at = np.unique(np.concatenate([parent, own]), return_inverse=True)
        total = np.bincount(at, np.concatenate([count[here], count[above]]), len(keys)).astype(np.int64)
        fold = (total <= most[keys >> DEPTH])[at[: len(parent)]]
        if not fold.any():
            done.append((group[here], level[here], node[here], count[here]))
            group, level, node, count = group[~here], level[~here], node[~here], count[~here]
            continue
        done.append((group[here][~fold], level[here][~fold], node[here][~fold], count[here][~fold]))
        folded, into = np.unique(np.concatenate([parent[fold], own]), return_inverse=True)
        sums = np.bincount(into, np.concatenate([count[here][fold], count[above]]), len(folded)).astype(np.int64)
        rest = ~here & ~above
        group = np.concatenate([group[rest], folded >> DEPTH])
        node = np.concatenate([node[rest], folded & (2**DEPTH - 1)])
        level = np.concatenate([level[rest], np.full(len(folded), depth + 1)])
        count = np.concatenate([count[rest], sums])
    done.append((group, level, node, count))
    return tuple(np.concatenate(x) for x in zip(*done))


def _compressor(keys: list[str], k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        count = rows["n_values"].to_numpy(np.int64)
        n = np.bincount(group, count, group.max() + 1).astype(np.int64)
        first = np.zeros(group.max() + 1, np.int64)
        first[group[::-1]] = np.arange(len(group))[::-1]
        g, level, node, count = compress(group, rows["level"].to_numpy(np.int64), rows["node"].to_numpy(np.int64), count, n // k)
        out = rows[keys].iloc[first[g]].reset_index(drop=True)
        return out.assign(level=level.astype(np.int32), node=node.astype(np.int32), n_values=count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of a group that may go on in the next batch: at most the nodes of one tree
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows[keys].iloc[-1]
            same = np.ones(len(rows), bool)
            for name in keys:
                same &= rows[name].isna() if pd.isna(last[name]) else (rows[name] == last[name]).fillna(False).to_numpy(bool)
            held = rows[same].reset_index(drop=True)
            if not same.all():
                yield whole(rows[~same].reset_index(drop=True))
        if held is not None:
            yield whole(held)

    return run


def _compressed(nodes: DataFrame, keys: list[str], rank_error: float) -> DataFrame:
    """`nodes` holds each node once per group; groups are bounded by the size of the tree."""
    k = int(DEPTH / rank_error)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    placed = nodes.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInPandas(_compressor(keys, k), schema)


def digests(values: DataFrame, keys: list[str], value: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """Digest rows (keys, level, node, n_values) of each group.

    Null and NaN are no values; null keys form groups of their own. Leaves are counted before any
    row is shuffled: a group is at most as many rows as its values have leaves, 2,048 for each power
    of two that they reach over, whatever its size.
    """
    x = F.col(value)
    leaves = values.where(x.isNotNull() & ~F.isnan(x)).select(*keys, F.lit(0).alias("level"), leaf_of(x.cast("double")).alias("node"))
    counted = leaves.groupBy(*keys, "level", "node").agg(F.count("*").alias("n_values"))
    return _compressed(counted, keys, rank_error)


def merge(parts: DataFrame, keys: list[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """Digests of coarser groups, such as any period of days, by addition of nodes."""
    added = parts.groupBy(*keys, "level", "node").agg(F.sum("n_values").alias("n_values"))
    return _compressed(added, keys, rank_error)


def percentiles(parts: DataFrame, keys: list[str], wanted: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """p-th percentiles (the value of rank ceil(p n / 100)) of each group of a digest.

    `rank_error` is the most by which a rank can be off in that digest: the largest sum of counts
    on the inner nodes above one leaf is bounded by the sum over levels of the largest count.
    """
    last = (F.col("node") + 1) * F.pow(F.lit(2), F.col("level")) - 1
    placed = parts.withColumn("last", last.cast("int"))
    by = Window.partitionBy(*keys)
    ranked = placed.select(*keys, "level", "last", "n_values", F.sum("n_values").over(by.orderBy("last", "level").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n_values").over(by).alias("n"))
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p / 100), F.col("last"))).alias(f"p{p}") for p in wanted]
    level_most = [F.coalesce(F.max(F.when(F.col("level") == d, F.col("n_values"))), F.lit(0)) for d in range(1, DEPTH + 1)]
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n_values"), *at, sum(level_most[1:], level_most[0]).alias("rank_error"))
    return found.select(*keys, "n_values", *(value_of(F.col(f"p{p}")).alias(f"p{p}") for p in wanted), "rank_error")


def rank_check(values: DataFrame, digest: DataFrame, key: str, value: str, rank_error: float = RANK_ERROR, wanted: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(key, n_values, n_nodes, n_leaves, a column p.._within): whether each percentile's rank is within the bound.

    True ranks are counted over all values; `digest` has one group for each value of `key`.
    """
    found = percentiles(digest, [key], wanted).select(key, *(leaf_of(F.col(f"p{p}")).alias(f"l{p}") for p in wanted))
    nodes = digest.groupBy(key).agg(F.count("*").alias("n_nodes"))
    leaves = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key, leaf_of(F.col(value)).alias("leaf")).agg(F.count("*").alias("c"))
    n = F.sum("c")
    below = lambda p: F.coalesce(F.sum(F.when(F.col("leaf") < F.col(f"l{p}"), F.col("c"))), F.lit(0))
    upto = lambda p: F.coalesce(F.sum(F.when(F.col("leaf") <= F.col(f"l{p}"), F.col("c"))), F.lit(0))
    rank = lambda p: F.ceil(n * p / 100)
    within = [((below(p) + 1 - n * rank_error <= rank(p)) & (rank(p) <= upto(p) + n * rank_error)).alias(f"p{p}_within") for p in wanted]
    return leaves.join(found, key).groupBy(key).agg(n.alias("n_values"), F.count("*").alias("n_leaves"), *within).join(nodes, key).select(key, "n_values", "n_nodes", "n_leaves", *(f"p{p}_within" for p in wanted))


def request_times(metrics: DataFrame) -> DataFrame:
    """(dataset, transform, day, ttft_ms) of each distinct request that has a measurement."""
    measured = metrics.where(F.col("ttft_ms").isNotNull() & ~F.isnan("ttft_ms"))
    row = F.struct("ingested_at", "dataset", "transform", F.to_date("started_at").alias("day"), "ttft_ms")
    once = measured.groupBy("engine_request_id").agg(F.min(row).alias("r"))
    return once.select("r.dataset", "r.transform", "r.day", "r.ttft_ms")
