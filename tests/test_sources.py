import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reprise.operators.logs import counter, counter_deltas, decision_summary, fleet_delta, log_summary, samples
from reprise.operators.ordinals import running_sum, with_ordinal
from reprise.operators.quarantine import assemble_csv_records, valid_events
from reprise.sources import readers, writers


def test_manifest_round_trip(spark, tmp_path):
    items = [{"item_id": f"i{n:03}", "dataset": "d", "recipient_prompt": "é\n" * n, "metadata": {"b": 1, "a": [n]}, "extra": 1} for n in range(25)]
    (tmp_path / "m.jsonl").write_text("\n\n".join(json.dumps(i) for i in items) + "\n")
    df = readers.read_manifest(spark, str(tmp_path / "m.jsonl"))
    rows = df.orderBy("ordinal").collect()
    assert [r.item_id for r in rows] == [i["item_id"] for i in items]
    assert rows[0].answers == [] and rows[0].input == "" and rows[0].negative_control is False and json.loads(rows[3].metadata) == {"b": 1, "a": [3]}
    assert [r.item_id for r in readers.read_manifest(spark, str(tmp_path / "m.jsonl"), 2).collect()] == ["i000", "i001"]
    for k in (1, 2):
        writers.write_canonical(df, "ordinal", str(tmp_path / f"out{k}"))
    one, two = ([p.read_bytes() for p in sorted((tmp_path / f"out{k}").glob("part-*"))] for k in (1, 2))
    assert one == two and b'"metadata": {"a": [0], "b": 1}' in b"".join(one)
    back = readers.read_manifest(spark, str(tmp_path / "out1")).orderBy("ordinal").collect()
    assert [r.recipient_prompt for r in back] == [i["recipient_prompt"] for i in items]


def test_results_and_checkpoints(spark, tmp_path):
    doc = {"run": {"run_id": "r1"}, "requests": [{"item_id": "a", "ttft_ms": 1.5, "unknown": 1, "output_top_logprobs": [[[-0.5, 7, "x"]]]}, {"item_id": "b", "arm": "warm"}]}
    doc["requests"][0]["output_top_logprobs"] = [[[-0.5, 7]]]
    (tmp_path / "r.json").write_text(json.dumps(doc))
    a, b = readers.read_result(spark, str(tmp_path / "r.json")).orderBy("ordinal").collect()
    assert a.arm == "single" and a.fuzzy_confirmed_tokens == 0 and a.external_confirmed_tokens is None and a.run_id == "r1" and b.arm == "warm"
    assert a.output_top_logprobs[0][0].token_id == 7 and a.output_top_logprobs[0][0].logprob == -0.5
    (tmp_path / "c.jsonl").write_text(json.dumps(doc["requests"][0]) + "\n" + json.dumps(doc["requests"][1]) + "\n{\"item_id\": \"c")
    assert sorted(r.item_id for r in readers.read_checkpoint(spark, str(tmp_path / "c.jsonl")).collect()) == ["a", "b"]
    assert readers.frozen(readers.file_digests(spark, str(tmp_path / "r.json")), {"r.json": __import__("hashlib").sha256((tmp_path / "r.json").read_bytes()).hexdigest()})


def test_audit_file(spark, tmp_path):
    event = {"schema_version": 2, "event": "load_allocated", "source": "s", "connector_id": "c", "mode": "m", "time_unix_s": 1, "tokens": 4}
    (tmp_path / "a.jsonl").write_text(json.dumps(event) + "\n\nnot json\n" + json.dumps(event | {"schema_version": 1}) + "\n")
    assert valid_events(readers.read_audit(spark, str(tmp_path / "a.jsonl"))).count() == 1


def test_audit_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,1\ny,"one\n\ntwo ""2"""\nz,3\nw,"open\nlast')
    (tmp_path / "b.jsonl").write_text('{"a": "\\""}\n{"b": 1}\n')
    (tmp_path / "c.csv").write_text("v,5\n")
    got = [tuple(r) for r in readers.read_audit(spark, str(tmp_path)).orderBy("line_id").select("source_file", "line_format", "raw_line").collect()]
    read = {n: (tmp_path / n).read_text().split("\n") for n in ("a.csv", "c.csv")}
    a = [("a.csv", "csv", r) for r in assemble_csv_records(read["a.csv"])]
    assert a[1][2] == 'y,"one\n\ntwo ""2"""' and a[3][2] == 'w,"open\nlast'
    assert got == [*a, ("b.jsonl", "jsonl", '{"a": "\\""}'), ("b.jsonl", "jsonl", '{"b": 1}'), ("c.csv", "csv", "v,5")]


def test_sse(spark, tmp_path):
    lines = ["", 'data: {"id": "x1", "choices": [{"delta": {"content": ""}}]}', 'data: {"id": "x2", "choices": [{"delta": {"content": "He"}}]}', "data: broken", 'data: {"choices": [{"delta": {"content": "y"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 3}}}', "data: [DONE]"]
    (tmp_path / "s.txt").write_text("\n".join(lines))
    r = readers.fold_sse(readers.read_sse(spark, str(tmp_path / "s.txt")).withColumn("k", F.lit(1)), ["k"]).first()
    assert (r.text, r.response_id, r.prompt_tokens, r.completion_tokens, r.cached_tokens) == ("Hey", "x1", 5, 2, 3)


def test_histograms(spark, tmp_path):
    (tmp_path / "h.csv").write_text("# tokens, share\n8192, 0.25\n\n16384,0.75\n")
    assert [tuple(r) for r in readers.read_histogram(spark, str(tmp_path / "h.csv")).collect()] == [(8192, 0.25), (16384, 0.75)]
    assert [tuple(r) for r in readers.parse_histogram(spark, "8192:0.25, 16384:0.75,").collect()] == [(8192, 0.25), (16384, 0.75)]


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def test_exposition(spark):
    page = lines(spark, "# HELP q", 'q_total{model="a \\"b\\"",engine="0"} 40000', 'q_total{engine="1"} 960', "q_created 5", "hits 12 17000", "bad line here now", "x NaN", "")
    s = samples(page)
    assert {(r.name, r.value) for r in s.where("name <> 'x'").collect()} == {("q_total", 40000.0), ("q_total", 960.0), ("q_created", 5.0), ("hits", 12.0)}
    r = s.agg(counter("q").alias("q"), counter("q", engine="1").alias("one"), counter("none").alias("none")).first()
    assert (r.q, r.one, r.none) == (40960.0, 960.0, None)
    assert s.where("labels['model'] is not null").first().labels["model"] == 'a "b"'


def test_deltas(spark):
    schema = "url string, q double, h double, error string"
    before = spark.createDataFrame([("a", 1000.0, 400.0, None), ("b", 10.0, 1.0, None), ("c", 1.0, 1.0, "down"), ("d", 1.0, None, None)], schema)
    after = spark.createDataFrame([("a", 41960.0, 12688.0, None), ("b", 4.0, 2.0, None), ("c", 2.0, 2.0, None), ("d", 2.0, 5.0, None), ("e", 1.0, 1.0, None)], schema)
    got = {r.url: r for r in counter_deltas(before, after, ["q", "h"]).collect()}
    assert (got["a"].q, got["a"].h) == (40960.0, 12288.0) and got["b"].q == -6.0 and not got["c"].paired and not got["e"].paired and got["d"].h is None
    fleet = fleet_delta(counter_deltas(before, after, ["q", "h"]), "h", "q", ["q", "h"]).first()
    assert fleet.reset and fleet.endpoints_paired == 3 and fleet.endpoints_failed == 2


def test_logs(spark):
    r = log_summary(lines(spark, "donor registered request_id=a namespace=n tokens=880 blocks=55", "semantic lookup hit request_id=a donor_id=b similarity=0.9 kind=span reusable_tokens=880 reason=x", "load advertised request_id=a donor_id=b tokens=880", "materialized request_id=a donor_id=b tokens=880", "ERROR x"), "connector").first()
    assert (r.donor_registered_events, r.semantic_hit_events, r.advertised_events, r.materialized_events, r.materialized_tokens, r.errors) == (1, 1, 1, 1, 880, 1)
    r = log_summary(lines(spark, "[FUZZY] Realized 512 fuzzy tokens", "[FUZZY RADIX] segmented prefill realized donor phase: donor_tokens=608 target=[0,608) direct_paged_kv=True", "[FUZZY RADIX] segmented prefill realized donor phase: donor_tokens=656 target=[608,1264) direct_paged_kv=True", "[E:onnxruntime: x"), "fuzzy").first()
    assert (r.materialized_events, r.materialized_tokens, r.warnings, r.errors) == (2, 1264, 1, 0)
    r = log_summary(lines(spark, "Retrieved 4096 out of total 8192 tokens", "Stored 128 tokens"), "exact").first()
    assert (r.materialized_events, r.materialized_tokens) == (1, 4096)
    rows = ['{"event": "lookup", "found": true}', '{"event": "lookup", "found": false, "rejection_reason": "no_donor_match"}', '{"event": "materialized", "materialized": 552, "requires_rope_correction": true}', '{"event": "engine_blend_boundary"}', "junk", "Non-zero status code returned"]
    r = decision_summary(lines(spark, *rows)).first()
    assert (r.semantic_hits, r.materialized_units, r.rope_corrections, r.engine_boundaries, r.rejections, r.errors, r.warnings) == (1, 552, 1, 1, 1, 1, 1)


def test_ordinals(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k", "id % 3 as v").repartition(5)
    got = sorted((r.k, r.ordinal, r.s) for r in running_sum(with_ordinal(df, "k"), "k", "v", "s").collect())
    assert [o for _, o, _ in got] == list(range(1000))
    by = {r.k: r.v for r in df.collect()}
    total = 0
    for k, _, s in got:
        total += by[k]
        assert s == total


def test_cumulative_stream(spark):
    rows = [{"text": "He", "output_ids": [], "meta_info": {"prompt_tokens": 9, "cached_tokens": 0}}, {"text": "Hey", "output_ids": [1], "meta_info": {"cached_tokens": 4, "cached_tokens_details": {"fuzzy": 3}}}, {"meta_info": {"cached_tokens": 0}}]
    df = spark.createDataFrame([("a", n, json.dumps(r)) for n, r in enumerate(rows)] + [("b", 7, "{}")], "k string, ordinal bigint, payload string")
    got = {r.k: tuple(r)[1:] for r in readers.fold_cumulative(df, ["k"]).collect()}
    assert got == {"a": ("Hey", 9, 4, 3, 1), "b": ("", 0, 0, 0, None)}


def test_benchmark_documents(spark, tmp_path):
    rows = [{"_id": "x", "context": "c", "question": "Q", "choice_A": "1", "answer": "A"}, {"question": "R"}]
    for n, doc in enumerate((rows, {"data": [], "train": rows}, {"other": rows})):
        (tmp_path / f"{n}.json").write_text("  " + json.dumps(doc))
    for n in (0, 1):
        got = readers.read_benchmark_document(spark, str(tmp_path / f"{n}.json"), "d").orderBy("ordinal").collect()
        assert [r.source_id for r in got][0] == "x" and got[0].answers == ["A"] and len(got) == 2
    with pytest.raises(Exception, match="unsupported shape"):
        readers.read_benchmark_document(spark, str(tmp_path / "2.json"), "d").collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("data/q.jsonl", json.dumps({"_id": "a", "context": "c", "input": "i", "answers": ["y"]}) + "\n\n" + json.dumps({"context": "é"}))
    a, b = readers.read_zip_member(spark, str(tmp_path / "z.zip"), "data/q.jsonl", "d").orderBy("ordinal").collect()
    assert a.source_id == "a" and a.answers == ["y"] and b.context == "é"
    with pytest.raises(Exception, match="no item named"):
        readers.read_zip_member(spark, str(tmp_path / "z.zip"), "data/none.jsonl", "d").collect()
