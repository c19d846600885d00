import random

from reprise.operators.ordinals import carried, running_sum, with_ordinal


def test_values_are_carried_across_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), n, rng.choice([None, None, None, n])) for n in range(400)]
    rows += [("z", 1000 + n, None) for n in range(20)] + [("y", 999, 5)] + [("y", 1000 + n, None) for n in range(200)]
    wanted, last = {}, {}
    for k, n, v in rows:
        wanted[n, k] = last.get(k)
        if v is not None:
            last[k] = v
    df = spark.createDataFrame(rows, "k string, n int, v int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.n, r.k): r.x for r in carried(df, "k", "n", "v", "x").collect()}
        assert got == wanted and len(got) == len(rows)
        sums = {r.n: r.s for r in running_sum(df.selectExpr("struct(n, k) AS o", "n"), "o", "n", "s").collect()}
        places = {r.n: r.ordinal for r in with_ordinal(df.selectExpr("struct(n, k) AS o", "n"), "o").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert carried(df.limit(0), "k", "n", "v", "x").collect() == []
    by_place = sorted((n, k or "") for k, n, _ in rows)
    assert len(sums) == len({n for _, n, _ in rows}) and max(places.values()) == len(by_place) - 1
    assert max(sums.values()) == sum(n for _, n, _ in rows)
