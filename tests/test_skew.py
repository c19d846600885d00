from reprise.operators.skew import grid_join, hot_keys


def test_grid_join_is_a_join(spark):
    left = [("hot" if n % 3 else f"k{n % 7}", n) for n in range(90)] + [(None, 900)]
    right = [("hot" if n % 2 else f"k{n % 5}", n) for n in range(70)] + [(None, 901), ("only", 902)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    got = sorted((r.x, r.y) for r in grid_join(a, b, "k", "x", "y", chunk=7).collect())
    assert got == sorted((x, y) for j, x in left for k, y in right if j is not None and j == k)
    assert grid_join(a.limit(0), b, "k", "x", "y").collect() == []


def test_hot_keys_are_seen(spark):
    a = spark.range(6000).selectExpr("if(id % 3 < 2, 'hot', concat('k', id % 50)) AS k", "id AS x")
    b = spark.range(2000).selectExpr("if(id % 4 < 2, 'hot', NULL) AS k", "id AS y")
    (row,) = hot_keys(a, b, "k", "x", "y", chunk=250).collect()
    assert row.k == "hot" and 10 <= row._m <= 22 and 2 <= row._n <= 7
    assert grid_join(a, b, "k", "x", "y", chunk=250).count() == 4000 * 1000
