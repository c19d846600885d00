import pytest
from pyspark.sql import functions as F

from reprise.operators import scoring as R


def one(spark, schema, rows, column):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n int, {schema}")
    return [r.x for r in df.select("n", column.alias("x")).orderBy("n").collect()]


def test_letters_and_choices(spark):
    rows = [("Answer: b", ["B"]), ("A or B", ["B", "c"]), (None, ["A"]), ("B", []), ("B", None), ("so be it", [" "]), ("(c).", [None, "C "])]
    assert one(spark, "o string, a array<string>", rows, R.letter_match(F.col("o"), F.col("a"))) == [1.0, 0.0, 0.0, None, None, None, 1.0]
    rows = [("longbench_v2_mc", None), (None, "A"), ("x", None), (None, None)]
    assert one(spark, "t string, e string", rows, R.is_multiple_choice(F.col("t"), F.col("e"))) == [True, True, False, False]


def test_response_rows(spark):
    rows = [("x" * 3000, 47, 2, ["x"], False), ("Answer: A", None, None, ["A"], True), (None, 16, 0, None, False), ("the committee", 0, 0, ["the committee met"], False)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, output_text string, cached_tokens bigint, exact_hit_blocks bigint, answers array<string>, choice boolean")
    got = [(r.backend_confirmed_blocks, r.exact_hit_tokens, len(r.output_text), r.quality_score, r.quality_pass) for r in R.response_row(df).orderBy("n").collect()]
    assert got == [(2, 32, 2000, 0.0, False), (None, None, 9, 1.0, True), (1, 0, 0, None, None), (0, 0, 13, 0.5, False)]


def test_ratios_fail_on_bad_denominators(spark):
    assert one(spark, "a double, b double", [(6.0, 3.0)], R.paired_ratio(F.col("a"), F.col("b"))) == [2.0]
    for bad in (0.0, -1.0, None):
        with pytest.raises(Exception, match="bad denominator"):
            one(spark, "a double, b double", [(6.0, bad)], R.paired_ratio(F.col("a"), F.col("b")))


def test_settling(spark):
    rows = [(None, 5.0, 2.0), (4.5, 5.0, 2.0), (1.0, 5.0, 2.0), (None, 5.0, 0.0)]
    assert one(spark, "f double, t double, s double", rows, R.settle_remaining(F.col("f"), F.col("t"), F.col("s"))) == [2.0, 1.5, 0.0, 0.0]


def test_names(spark):
    names = [("A4", "conn_span"), ("A5", "conn_span_noaudit"), ("A4", "A4"), ("A6", "same_long")]
    rows = [("A4 conn_span",), ("uses CONN_SPAN_NOAUDIT",), ("xA4",), (None,), ("a4/x",), ("conn_spans",), ("same_long conn_span",)]
    assert one(spark, "d string", rows, R.arm_named(F.col("d"), names)) == ["A4", "A5", "", "", "A4", "", "A4"]
    urls = spark.createDataFrame([("http://a/", 2), ("http://a/metrics", 1), ("http://a", 3), ("http://b//", 4)], "u string, n int")
    assert sorted(tuple(r) for r in R.endpoints(urls, "u", "n").collect()) == [("http://a/metrics", 1), ("http://b/metrics", 4)]
    rows = [("/models/Qwen2.5-7B", "Qwen/qwen2.5-7b"), ("a/b", "b"), ("x", "y"), ("", "y"), ("x", None)]
    assert one(spark, "s string, e string", rows, R.model_matches(F.col("s"), F.col("e"))) == [True, True, False, False, None]
    rows = [('{"tenant": "", "tenant_id": "t"}',), ("{}",), (None,), ('{"tenant": "u"}',)]
    assert one(spark, "m string", rows, R.named_in(F.col("m"), ("tenant", "tenant_id"), "d")) == ["t", "d", "d", "u"]


def test_left_over_and_sources(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    done = spark.createDataFrame([("a", "cold"), ("a", "warm"), ("b", "cold"), ("b", "cold"), ("c", "single")], "item_id string, arm string")
    assert sorted(r.item_id for r in R.both_arms_left(items, done).collect()) == ["b", "c"]
    df = spark.createDataFrame([("x", "connector_audit"), ("x", None), ("y", "usage"), ("y", "connector_audit"), ("z", "")], "arm string, external_confirmed_tokens_source string")
    got = {r.arm: (r.sources, r.per_request) for r in R.source_labels(df, ["arm"]).collect()}
    assert got == {"x": (["connector_audit"], True), "y": (["connector_audit", "usage"], False), "z": ([], None)}
    df = spark.createDataFrame([(1, 1, True), (2, 3, True), (None, 1, True)], "expected_span_target_start int, audit_advertised_target_start int, audit_joined boolean")
    assert tuple(R.target_start_agreement(df).first()) == (0.5, 1, 2)
    assert tuple(R.target_start_agreement(df.limit(0)).first()) == (None, None, 0)


def test_opportunity_rates(spark):
    alignment = spark.createDataFrame([(6, 2, 8)], "aligned bigint, aligned_outside_classes bigint, opportunity_rows bigint")
    counts = spark.createDataFrame([("same_doc_new_instruction", 9), ("revised_doc", 3), ("no_reuse", 50)], "traffic_class string, n_items bigint")
    assert tuple(R.opportunity_rates(alignment, counts).first()) == (0.5, 4 / 12, 12, R.FROM_MANIFEST, 0.75, 8, 0.5)
    assert tuple(R.opportunity_rates(alignment).first()) == (0.75, 0.5, 8, R.FROM_ROWS, 0.75, 8, 0.75)
    assert R.opportunity_rates(alignment, counts.limit(0)).first().given_opportunity is None
