import math
import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from reprise.llm.quantiles import DEPTH, digests, leaf_of, merge, percentiles, rank_check, request_times, value_of


def test_leaves_are_ordered_and_narrow(spark):
    rng = random.Random(1)
    some = [0.0, 0.004, 1 / 256, 0.9999, 1.0, 7.999999, 8.0, 123.456, 2.0**24 - 1, 2.0**24, 1e300, 1.7976931348623157e308, 2.0**-1022, 2.0**-1023, 5e-324, float("inf")]
    some += [2.0**k * f for k in range(-1022, 1023, 13) for f in (1, 1 - 2**-53, 1 + 2**-52)] + [10.0 ** rng.uniform(-300, 300) for _ in range(500)]
    values = sorted({x for v in some for x in (v, -v)})
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", leaf_of(F.col("x")).alias("leaf"), value_of(leaf_of(F.col("x"))).alias("back")).collect()
    bits = np.array([abs(r.x) for r in rows]).view(np.int64) >> 41
    assert [r.leaf for r in rows] == [2**22 - 1 - b if r.x < 0 else 2**22 + b for r, b in zip(rows, bits.tolist())]
    assert 0 <= min(r.leaf for r in rows) and max(r.leaf for r in rows) < 2**DEPTH
    assert all(r.back == r.x if math.isinf(r.x) else abs(r.back - r.x) <= max(abs(r.x) / 2048, 2.0**-1033) for r in rows)


def check(values, got, error, n_parts=1):
    """Every answer's rank is within the bound, up to the width of a leaf."""
    values = sorted(values)
    for p in (50, 90, 95, 99):
        rank = math.ceil(len(values) * p / 100)
        low = sum(x < got[f"p{p}"] * (1 - 1 / 1000) for x in values) + 1
        high = sum(x <= got[f"p{p}"] * (1 + 1 / 1000) for x in values)
        assert low - error <= rank <= high + error


def test_rank_error_stays_within_its_bound(spark):
    rng = random.Random(3)
    rows = [(g, d, math.exp(rng.gauss(4, 1.5))) for g in ("a", "b", None) for d in range(4) for _ in range(1500 if g == "a" else 40)]
    df = spark.createDataFrame(rows, "g string, d int, x double").repartition(7)
    for error in (0.001, 0.05):
        days = digests(df, ["g", "d"], "x", error)
        assert days.groupBy().sum("n_values").first()[0] == len(rows)
        merged = merge(days, ["g"], error)
        if error == 0.05:
            assert merged.count() < 1500
        for r in percentiles(merged, ["g"]).collect():
            own = [x for g, _, x in rows if g == r.g]
            assert r.n_values == len(own) and r.rank_error <= error * len(own)
            check(own, r, error * len(own))
        (all_,) = {tuple(r[4:]) for r in rank_check(df, merged, "g", "x", error).where("g IS NOT NULL").collect()}
        assert all_ == (True,) * 4
        two = merge(days.where("d < 2"), ["g"], error)
        for r in percentiles(two, ["g"]).collect():
            check([x for g, d, x in rows if g == r.g and d < 2], r, error * r.n_values)


def test_merging_is_the_same_in_any_order(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i % 3, rng.expovariate(0.01)) for i in range(6000)], "d int, x double")
    days = digests(df, ["d"], "x", 0.02).withColumn("g", F.lit(1))
    assert sorted(merge(days, ["g"], 0.02).collect()) == sorted(merge(days.orderBy(F.desc("n_values")), ["g"], 0.02).collect())


def test_requests_count_once(spark):
    t = datetime(2026, 1, 2, 3)
    rows = [("a", "d", "t", 5.0, t, t), ("a", "d", "t", 5.0, t, datetime(2026, 2, 1)), ("b", "d", "t", None, t, t), ("c", "d", "t", float("nan"), t, t), ("e", None, None, 7.0, None, None)]
    df = spark.createDataFrame(rows, "engine_request_id string, dataset string, transform string, ttft_ms double, started_at timestamp, ingested_at timestamp").withColumn("day", F.lit("x"))
    times = request_times(df)
    assert sorted((r.dataset or "", r.ttft_ms) for r in times.collect()) == [("", 7.0), ("d", 5.0)]
    got = percentiles(digests(times, ["dataset", "transform", "day"], "ttft_ms"), ["dataset", "transform", "day"]).collect()
    assert len(got) == 2 and all(abs(r.p50 - x) < 0.01 for r, x in zip(sorted(got, key=lambda r: r.p50), (5, 7)))
    assert percentiles(digests(times.limit(0), ["dataset"], "ttft_ms"), ["dataset"]).collect() == []
