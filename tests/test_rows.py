from pyspark.sql import functions as F

from reprise.operators import rows as R


def test_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    null = F.lit(None).cast("bigint")
    assert get(R.cold_contaminated(F.lit(17))) and get(R.cold_contaminated(F.lit(16))) is False and get(R.cold_contaminated(null)) is None
    assert get(R.pair_class(F.lit(""), F.lit(None).cast("string"), F.lit(64), null)) == "contaminated" and get(R.pair_class(F.lit("x"), F.lit(""), F.lit(64), null)) == "errored"
    assert get(R.service_ms(F.array(F.lit(1.5), F.lit(None).cast("double"), F.lit(2.0)))) == 3.5
    assert get(R.route_outcome(F.lit(" "), F.lit(" Semantic "))) == "semantic_placement" and get(R.route_outcome(F.lit("odd"))) == "odd" and get(R.route_outcome(F.lit(""))) is None
    assert get(R.settle_seconds(F.lit(8), F.lit(500), F.lit(0))) == 4.0 and get(R.settle_seconds(F.lit(0), F.lit(500), F.lit(4))) == 0.0


def test_overlap(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(text, text), (text, " ".join(map(str, range(20)))), ("a b", "a b"), ("a", ""), ("x " * 30, text)], "a string, b string")
    w = df.select(R.split_words(F.col("a")).alias("a"), R.split_words(F.col("b")).alias("b")).select(R.word_runs(F.col("a")).alias("a"), R.word_runs(F.col("b")).alias("b"))
    assert [round(r.x, 2) for r in w.select(R.overlap_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 1.0, 1.0, 1.0, 0.0]


def test_checks(spark):
    m = spark.createDataFrame([(0.7, 0.2, None)], "a double, b double, c double")
    limits = {"a": (">=", 0.6), "b": ("<=", 0.1), "c": (">=", 0.0)}
    assert {r.metric: r.status for r in R.check(m, limits).collect()} == {"a": "passed", "b": "failed", "c": "missing"}
    assert {r.metric: r.status for r in R.check(m, limits, True).collect()}["c"] == "skipped"
