"""Statistics that SQL lacks: seeded bootstrap intervals, and divergence of top-k distributions."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from reprise.functions.columns import bound

RESAMPLES, ALPHA, SEED = 2000, 0.05, "bootstrap"
#: The exact bootstrap needs its values in one place, in order; larger samples use `poisson_mean_interval`.
MOST_VALUES = 1_000_000


#: Draws that are held at once.
_HELD_DRAWS = 1 << 22


def interval(values: Sequence[float], statistic: Callable[..., np.ndarray] = np.median, resamples: int = RESAMPLES, seed: str = SEED) -> tuple[float, float, float] | None:
    """(point, low, high) of a seeded percentile bootstrap; None without values, the point alone for one.

    `statistic` takes a matrix of resamples and an axis, as numpy's do. The generator's whole numbers
    are drawn resample by resample, in the order of the values.
    """
    x = np.asarray(values, float)
    if not len(x):
        return None
    point = float(statistic(x[None, :], axis=1)[0])
    if len(x) == 1:
        return point, point, point
    draw = random.Random(seed).randrange
    at_once = max(1, _HELD_DRAWS // len(x))
    found = []
    for done in range(0, resamples, at_once):
        shape = (min(at_once, resamples - done), len(x))
        drawn = np.fromiter((draw(len(x)) for _ in range(shape[0] * shape[1])), np.int64, shape[0] * shape[1])
        found.append(statistic(x[drawn.reshape(shape)], axis=1))
    low, high = np.quantile(np.concatenate(found), [ALPHA / 2, 1 - ALPHA / 2])
    return point, float(low), float(high)


def bootstrap(rows: DataFrame, keys: list[str], value: str, order: str, statistic: Callable = np.median, resamples: int = RESAMPLES, seed: str = SEED) -> DataFrame:
    """(keys, n, point, low, high) per group, values taken in the order of a column.

    For groups of results, such as pairs of a run. A group of more than `MOST_VALUES` is refused.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > MOST_VALUES:
            raise ValueError("too many values for an exact bootstrap")
        point, low, high = interval(group.sort_values("o")["v"].tolist(), statistic, resamples, seed)
        return pd.DataFrame([(*key, len(group), point, low, high)])

    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + ["n bigint", "point double", "low double", "high double"])
    flat = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.col(order).alias("o"))
    return flat.groupBy(*keys).applyInPandas(run, schema)


# The Poisson(1) distribution function at 0, 1, 2, ...
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
#: Rows drawn for at once, and groups whose sums a task holds before it hands them on.
_DRAWN, _HELD = 256, 64


def _draws(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) weights, rows by replicates: of xxhash64(unit, r) for r from 1, given xxhash64(unit)."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    r = np.arange(1, resamples + 1, dtype=np.uint64) * p1
    h = (hashes.astype(np.int64).view(np.uint64) + p5 + np.uint64(4))[:, None] ^ r
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    u = (h ^ (h >> np.uint64(32))) & np.uint64((1 << 53) - 1)
    weights = np.zeros(u.shape, np.uint8)
    for step in _POISSON:
        weights += u >= np.uint64(math.ceil(step * (1 << 53)))
    return weights.astype(float)


def _weighed_sums(schema: pa.Schema, keys: int, resamples: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            columns = [[k[i] for k in held] for i in range(keys)] + [[x[i] for x in held.values()] for i in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            v, h = (batch.column(keys + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            places: dict[tuple, list[int]] = {}
            for n, k in enumerate(zip(*(batch.column(i).to_pylist() for i in range(keys)))) if keys else ((n, ()) for n in range(len(v))):
                places.setdefault(k, []).append(n)
            for k, at in places.items():
                if k not in held and len(held) >= _HELD:
                    yield out()
                    held.clear()
                sums = held.setdefault(k, [0, 0.0, np.zeros(resamples), np.zeros(resamples)])
                for i in range(0, len(at), _DRAWN):
                    rows = at[i : i + _DRAWN]
                    weights = _draws(h[rows], resamples)
                    sums[0] += len(rows)
                    sums[1] += float(v[rows].sum())
                    sums[2] += weights.sum(axis=0)
                    sums[3] += v[rows] @ weights
        if held:
            yield out()

    return run


def poisson_mean_interval(rows: DataFrame, keys: list[str], value: str, unit: str, resamples: int = RESAMPLES) -> DataFrame:
    """(keys, n, point, low, high) of the mean, for samples of any size.

    Every replicate weighs a row by a Poisson(1) number drawn from a hash of its `unit`. Tasks hand
    on one sum per group and replicate, so nothing is gathered.
    """
    v = F.col(value).cast("double")
    drawn = rows.where(v.isNotNull()).select(*keys, v.alias("_v"), F.xxhash64(F.col(unit)).alias("_h"))
    kept = [f for f in drawn.schema.fields if f.name not in ("_v", "_h")]
    made = StructType([*kept, *(StructField(c, t) for c, t in (("_n", LongType()), ("_s", DoubleType()), ("_w", ArrayType(DoubleType())), ("_wv", ArrayType(DoubleType()))))])
    sums = drawn.mapInArrow(_weighed_sums(to_arrow_schema(made), len(keys), resamples), made)
    each = sums.select(*keys, "_n", "_s", F.posexplode(F.arrays_zip("_w", "_wv")).alias("_r", "_x"))
    mean = F.try_divide(F.sum("_x._wv"), F.sum("_x._w"))
    found = each.groupBy(*keys, "_r").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), mean.alias("_m"))
    first = lambda c: F.max(F.when(F.col("_r") == 0, F.col(c)))
    every = found.groupBy(*keys).agg(first("_n").alias("n"), (first("_s") / first("_n")).alias("point"), F.array_sort(F.collect_list("_m")).alias("_every"))
    at = lambda p: F.element_at("_every", F.greatest(F.lit(1), F.ceil(F.size("_every") * p).cast("int")))
    return every.select(*keys, "n", "point", at(ALPHA / 2).alias("low"), at(1 - ALPHA / 2).alias("high"))


def topk_divergence(cold: Column, warm: Column) -> Column:
    """KL divergence of two top-k lists of (token_id, logprob) over the union of their tokens.

    A token that a list lacks is one nat below its least; both are normalised. An empty side gives 0.
    """
    side = lambda x: F.struct(F.map_from_entries(F.transform(x, lambda e: F.struct(e.token_id, e.logprob))).alias("m"), (F.array_min(F.transform(x, lambda e: e.logprob)) - 1.0).alias("floor"))
    weight = lambda s, t: F.exp(F.coalesce(F.try_element_at(s.m, t), s.floor))
    ids = F.array_union(F.transform(cold, lambda e: e.token_id), F.transform(warm, lambda e: e.token_id))
    weights = bound(F.struct(side(cold).alias("a"), side(warm).alias("b"), ids.alias("ids")), lambda s: F.transform(s.ids, lambda t: F.struct(weight(s.a, t).alias("a"), weight(s.b, t).alias("b"))))
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda n, x: n + of(x))
    # With p = a / A and q = b / B: the sum of p ln(p / q) is the sum of a (ln a - ln b) / A, less ln A - ln B.
    sums = lambda xs: F.struct(total(xs, lambda x: x.a).alias("a"), total(xs, lambda x: x.b).alias("b"), total(xs, lambda x: F.when(x.a > 0, x.a * F.ln(x.a / x.b)).otherwise(0.0)).alias("d"))
    found = bound(bound(weights, sums), lambda t: t.d / t.a - F.ln(t.a / t.b))
    return F.when((F.size(cold) <= 0) | (F.size(warm) <= 0), 0.0).otherwise(found)


def first_divergence(cold: Column, warm: Column) -> Column:
    """Index of the first position whose tokens differ; null if none within the shorter one does."""
    n = F.least(F.size(cold), F.size(warm))
    same = F.zip_with(F.slice(cold, F.lit(1), n), F.slice(warm, F.lit(1), n), lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, F.lit(False))
    return F.when((n > 0) & (at > 0), (at - 1).cast("int"))
