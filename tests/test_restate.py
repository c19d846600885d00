import json
import re

import pytest
from pyspark.sql import functions as F

from reprise.functions import restate as R
from reprise.operators import rows, workload
from reprise.sources import readers

TEXT = "The team said the report was important because many records were found in 2019. The review requires a new account of all large items that nobody had ever looked at before now. U.S. officials made the case. It is small, and the government shows it."


def test_facts_survive(spark):
    df = spark.createDataFrame([(TEXT, "k"), ("", "k"), ("One Medical", "k")], "t string, k string")
    r = df.withColumn("o", R.restated(F.col("t"), F.col("k"))).withColumns({"a": rows.split_words(F.col("t")), "b": rows.split_words(F.col("o"))})
    first, empty, short = r.withColumn("v", rows.overlap_ratio(rows.word_runs(F.col("a")), rows.word_runs(F.col("b")))).collect()
    assert first.o != TEXT and "2019" in first.o and "U.S." in first.o and R.MERGED in first.o and first.v < 0.35
    assert (empty.o, empty.v, short.o, short.v) == ("", 1.0, "One Medical", 1.0)


def test_known_sentences(spark):
    df = spark.createDataFrame([(0, "We said (the) report is new, but 5 records were found."), (0, "no word here has any swap at all or so"), (1, "Word")], "k int, s string")
    got = [r.x for r in df.select(R.reworded(F.col("s"), F.col("k")).alias("x")).collect()]
    assert got == ["We stated (the) account is recent, but 5 records were identified.", "no word here has any swap indeed at all or so", "Word"]
    both = spark.createDataFrame([(["He came.", "The man left.", "It was late.", "IT failed.", "U.S.", "A dog ran.", "There Inc. is."],)], "s array<string>")
    assert both.select(R.joined(F.transform("s", lambda x: F.struct(x.alias("given"), x.alias("made")))).alias("x")).first().x == "He came; in other words, the man left. It was late. IT failed. U.S.; in other words, a dog ran. There Inc. is."


def test_probe_numbers(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("s"), F.lit("text 2").alias("t"))
    got = df.withColumn("n", R.fact_numbers(F.col("s"), F.col("t"))).select("n", R.addends(F.col("s"), F.lit("x"), F.col("n.n")).alias("ab"), R.complement(F.col("s"), F.lit("x")).alias("c")).collect()
    for r in got:
        assert str(r.n.n)[0] != str(r.n.wrong)[0] and 23 <= r.n.n <= 89
        assert r.ab.a + r.ab.b == r.n.n and r.ab.a != r.ab.b and str(r.c.failed)[0] != str(r.c.passed)[0] and r.c.failed + r.c.passed == r.c.total
    full = spark.createDataFrame([("s", " ".join(map(str, range(200))))], "s string, t string")
    assert full.select(R.fact_numbers(F.col("s"), F.col("t")).alias("n")).first().n is None


@pytest.mark.parametrize("kind", workload.PROBES)
def test_probe_items(spark, kind):
    same = "Qq zz ww. " * 30  # nothing in it can be reworded
    src = spark.createDataFrame([("s1", "d", TEXT, "What?", None), ("s2", "d", " ".join(map(str, range(200))), "What?", None), ("s3", "d", None, "x", None), ("s4", "d", same, "What?", None)], "source_id string, dataset string, context string, input string, metadata map<string,string>")
    config = spark.createDataFrame([("d", [kind], 4, 10, "adjacent")], "dataset string, transforms array<string>, max_segments int, min_segment_chars int, negative_selection string")
    got = {r.source_id: r for r in workload.build(src, config, kind).collect()}
    assert {k: r.failure for k, r in got.items()} == {"s1": None, "s2": "no_numbers", "s4": "too_close"}
    item = got["s1"]
    assert item.donors[0].text != item.recipient and "exactly how many" in item.recipient
    assert got["s2"].donors is None and got["s2"].recipient is None


def test_sparse_edit(spark):
    text = ". ".join(f"Sentence {n}" for n in range(200)) + ".  End."
    df = spark.createDataFrame([(text, "a"), (text, "b"), ("", "a"), (None, "a")], "c string, s string")
    one, other, empty, none = (r.x for r in df.select(workload.edited(F.col("c"), F.col("s")).alias("x")).collect())
    assert one != other and 1 <= one.count("(rev-2 annotation r") <= 20 and (empty, none) == ("", None)
    assert re.sub(r" \(rev-2 annotation r\d+\)", "", one) == text


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"_id": "a", "context": "c", "input": "q", "answers": ["x"]}) + "\n" + json.dumps({"context": "c2"}) + "\n")
    a, b = readers.read_questions(spark, str(tmp_path / "q.jsonl"), "d").orderBy("ordinal").collect()
    assert a.source_id == "a" and a.answers == ["x"] and len(b.source_id) == 16 and b.input == "" and b.answers == []
    (tmp_path / "m.jsonl").write_text(json.dumps({"question": "Q?", "choice_A": "1", "choice_B": "2", "answer": "B"}))
    r = readers.read_questions(spark, str(tmp_path / "m.jsonl"), "m", multiple_choice=True).first()
    assert r.input == "Q?\nA. 1\nB. 2\nC. \nD. " and r.answers == ["B"]


def test_engine_timing(spark):
    rows = [json.dumps(x) for x in ({"time_to_first_token_ms": 1527.5, "queue_time_ms": 0.02}, {"ttft": 2, "time_in_queue": "0.5"}, {"arrival_time": 1.0, "first_scheduled_time": 1.5, "first_token_time": 1.25}, {})]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], "n int, m string")
    t, q = readers.engine_timing(F.col("m"))
    got = [(r.t, r.q) for r in df.orderBy("n").select(t.alias("t"), q.alias("q")).collect()]
    assert got == [(1527.5, 0.02), (2000.0, 500.0), (None, 500.0), (None, None)]
    h = spark.createDataFrame([(1, 0.5), (2, 0.5)], "prompt_tokens bigint, traffic_share double")
    r = spark.createDataFrame([(2, 0.9)], "prompt_tokens bigint, hit_rate double")
    assert {x.prompt_tokens: x.hit_rate for x in readers.with_rates(h, r, 0.1).collect()} == {1: 0.1, 2: 0.9}
