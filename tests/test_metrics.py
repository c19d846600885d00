import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reprise.functions import stats
from reprise.functions.rouge import rouge_l
from reprise.operators import audit, metrics, pairing, timeline, workload
from reprise.operators import signals as S
from reprise.operators.quarantine import parse_audit_lines, valid_events
from reprise.streaming.audit import _updater, fold_stream, run_to_end

T0 = datetime(2026, 1, 1)
COLUMNS = {
    "item_id": "string", "arm": "string", "dataset": "string", "transform": "string", "traffic_class": "string", "negative_control": "boolean", "donor_count": "bigint", "total_blocks": "bigint", "prompt_tokens": "bigint",
    "ttft_ms": "double", "queue_time_ms": "double", "error": "string", "output_text": "string", "flush_contaminated": "boolean", "stream_position": "bigint", "wrapper_rank": "bigint",
    "external_confirmed_tokens": "bigint", "fuzzy_confirmed_tokens": "bigint", "backend_confirmed_tokens": "bigint", "audit_materialized": "boolean", "audit_joined": "boolean", "audit_advertised_tokens": "bigint", "audit_observed_boundary": "bigint",
    "audit_lookup_hit": "boolean", "audit_hit_boundary": "bigint", "audit_superseded_tokens": "bigint", "audit_blocks_evicted": "bigint", "expected_supplied_tokens": "bigint", "parent_item_id": "string", "engine_request_id": "string", "engine_response_id": "string",
}


def rows(spark, *given):
    made = []
    for n, g in enumerate(given):
        base = {"item_id": f"i{n}", "arm": "warm", "dataset": "d", "transform": "t", "negative_control": False, "donor_count": 1, "total_blocks": 4, "prompt_tokens": 64, "engine_request_id": f"rq-{n:016x}"}
        made.append(tuple((base | g).get(c) for c in COLUMNS))
    df = spark.createDataFrame(made or [], ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
    return df.withColumn("ordinal", F.struct((F.lit(T0) + F.make_interval(secs=F.monotonically_increasing_id())).alias("started_at"), "engine_request_id"))


@pytest.mark.parametrize(("row", "tokens", "mechanism"), [
    ({"fuzzy_confirmed_tokens": 18662, "backend_confirmed_tokens": 3}, 18662, "scatter"),
    ({"fuzzy_confirmed_tokens": 128, "backend_confirmed_tokens": 128}, 128, "head"),
    ({"backend_confirmed_tokens": 11264}, None, "exact"),
    ({"backend_confirmed_tokens": 3}, None, "none"),
    ({"external_confirmed_tokens": 64}, 64, "external"),
    ({"audit_materialized": False}, 0, "none"),
    ({"external_confirmed_tokens": 0}, 0, "none"),
])
def test_signals(spark, row, tokens, mechanism):
    r = rows(spark, row).select(S.semantic_tokens().alias("t"), S.is_hit().alias("h"), S.mechanism().alias("m")).first()
    assert (r.t, r.m) == (tokens, mechanism) and r.h == (None if tokens is None else tokens >= 64)


def test_arm_join(spark):
    df = rows(spark, {"item_id": "a", "arm": "cold"}, {"item_id": "a"}, {"item_id": "a", "total_blocks": 9}, {"item_id": "b", "arm": "cold"}, {"item_id": "c"}, {"item_id": "d", "arm": "cold"}, {"item_id": "d", "donor_count": None})
    assert {r.item_id: r.status for r in pairing.join_arms(df).collect()} == {"a": "paired", "b": "only_cold", "c": "only_warm", "d": "mismatch"}
    assert {(r.arm, r.item_id): r.n for r in pairing.duplicates(df).collect()} == {("warm", "a"): 2}


def both(item, cold, warm, **more):
    return [{"item_id": item, "arm": "cold", "ttft_ms": cold} | more, {"item_id": item, "ttft_ms": warm} | more]


def test_pairs_and_summary(spark):
    given = both("a", 200.0, 100.0, external_confirmed_tokens=64) + both("b", 100.0, 100.0, backend_confirmed_tokens=3) + both("c", 50.0, 100.0, negative_control=True) + both("z", 0.0, 5.0)
    given += both("e", 1.0, 1.0, error="x") + [{"item_id": "u", "arm": "cold"}, {"item_id": "k", "arm": "cold", "flush_contaminated": True}, {"item_id": "k"}]
    given += [{"item_id": "m", "arm": "cold", "stream_position": 1}, {"item_id": "m", "stream_position": 2}]
    paired = pairing.pairs(rows(spark, *given))
    assert {r.status: r.n_pairs for r in pairing.status_counts(paired).collect()} == {"clean": 4, "errored": 1, "unpaired": 1, "contaminated": 1, "moved": 1}
    s = pairing.summary(pairing.timed(paired)).first()
    assert (s.pairs_used, s.blended_median, s.control_pairs, s.control_median) == (3, 1.5, 1, 0.5)
    assert (s.hit_rate, s.hit_rate_confirmed, s.pairs_unconfirmed, s.hit_only_median) == (0.5, 1.0, 1, 2.0)
    empty = pairing.summary(pairing.timed(pairing.pairs(rows(spark).where("arm IN ('cold', 'warm')")))).first()
    assert empty.pairs_used == 0 and empty.blended_median is None and empty.hit_rate is None


def test_miss_tax(spark):
    given = both("m1", 100.0, 112.0, audit_joined=True) + both("m2", 120.0, 128.0, audit_joined=True, audit_advertised_tokens=0) + both("s1", 200.0, 40.0, audit_joined=True, audit_advertised_tokens=3776)
    t = pairing.miss_tax(pairing.pairs(rows(spark, *given))).first()
    assert (t.pairs, t.pairs_advertising, t.cold_p50_ms, t.warm_p50_ms, t.miss_tax_ms) == (2, 1, 110.0, 120.0, 10.0)
    t = pairing.miss_tax(pairing.pairs(rows(spark, *both("m", 1.0, 2.0), *both("n", 1.0, 2.0, negative_control=True)))).first()
    assert t.miss_tax_ms is None and t.pairs is None and t.pairs_control == 1


def test_propagation(spark):
    given = [{"item_id": "p", "arm": "cold", "output_text": "x y"}, {"item_id": "p", "output_text": "alpha beta gamma"}]
    for item, parent, warm in (("q1", "p", "alpha beta gamma"), ("q2", "p", "one two"), ("q3", None, "a"), ("q4", "none", "a"), ("q5", "p", "")):
        given += [{"item_id": item, "arm": "cold", "traffic_class": "propagation_probe", "parent_item_id": parent, "output_text": "one two"}, {"item_id": item, "traffic_class": "propagation_probe", "parent_item_id": parent, "output_text": warm}]
    df = rows(spark, *given)
    got = pairing.propagation(pairing.pairs(df, "output_text", "parent_item_id"), pairing.last_rows(df).where("arm = 'warm'"), rouge_l)
    assert {r.status: r.n for r in got.collect()} == {"propagated": 1, "kept": 1, "unlinked": 1, "no_served_answer": 1, "no_warm_answer": 1}


def test_alignment_metrics(spark):
    served = {"traffic_class": "revised_doc", "audit_joined": True, "audit_advertised_tokens": 512, "audit_observed_boundary": 16, "audit_lookup_hit": True, "audit_hit_boundary": 16, "audit_materialized": True, "external_confirmed_tokens": 256, "wrapper_rank": 0}
    df = rows(spark, served, served | {"traffic_class": "exact_repeat", "wrapper_rank": 5, "audit_materialized": False, "external_confirmed_tokens": None}, {"traffic_class": "same_doc_new_instruction", "audit_joined": True}, {"audit_joined": True}, {"arm": "cold", "audit_joined": True}, {"audit_joined": None})
    joined = F.bool_or(F.col("audit_joined").isNotNull())
    a = metrics.considered(df).agg(*metrics.alignment_aggregates(joined)).first()
    assert (a.rows_considered, a.aligned, a.lookup_hits, a.given_match, a.given_opportunity, a.aligned_outside_classes, a.given_opportunity_in_class) == (4, 2, 2, 1.0, 1.0, 1, 0.5)
    m = metrics.considered(df).agg(*metrics.reuse_aggregates(joined)).first()
    assert (m.reuse_token_rate, m.reuse_request_rate, m.reuse_tokens, m.advertised_tokens) == (0.25, 0.5, 256, 1024)
    strata = {r.stratum: r for r in metrics.by_stratum(df).collect()}
    assert sum(r.aligned for r in strata.values()) == a.aligned and strata["unstratified"].aligned == 0 and strata["unstratified"].given_match is None
    p = metrics.presence(df).first()
    assert (p.audit_present, p.rows_considered, p.excluded_cold_arm, p.excluded_not_joined) == (True, 4, 1, 1)
    none = metrics.considered(rows(spark, {})).agg(*metrics.alignment_aggregates(F.coalesce(joined, F.lit(False)))).first()
    assert none.given_match is None and none.aligned is None and none.lookup_hits == 0


def event(name, rid="rq-0000000000000001", connector="sched-1", rs=0, es=0, **payload):
    return json.dumps({"schema_version": 2, "event": name, "source": "kv", "connector_id": connector, "mode": "m", "time_unix_s": 1.0, "request_id": rid, "request_seq": rs, "event_seq": es} | payload)


def raw(spark, *lines):
    return spark.createDataFrame([(n, "f", "jsonl", x) for n, x in enumerate(lines)], "line_id bigint, source_file string, line_format string, raw_line string")


def test_fold(spark, tmp_path):
    ad, made, miss = "semantic_span_load_advertised", "runtime_materialized", "semantic_span_boundary_missed"
    lines = [event("request_first_seen", prompt_tokens=900), event("semantic_lookup_hit", es=1, reusable_tokens=80), event(ad, es=2, token_count=256, boundary=16, target_start=32), event(made, connector="wrk-1", tokens=256), event(ad, es=3, token_count=768, boundary=48), event(made, connector="wrk-1", es=1, tokens=768)]
    lines += [event(miss, rid="cmpl-rq-00000000000000ab-0", boundary=1008, stored_donor_tokens=0), event("lookup_skipped_short_prompt", rid="cmpl-rq-00000000000000ab-0", es=1), event(made, rid="rq-0000000000000001", connector="wrk-1", rs=1, es=0)]
    lines += [event("load_allocated", rid=None, tokens=5), "broken"]
    events = valid_events(raw(spark, *lines))
    got = {r.request_id: r for r in audit.fold(events).collect()}
    a, b = got["rq-0000000000000001"], got["cmpl-rq-00000000000000ab-0"]
    assert (a.prompt_tokens, a.advertised_tokens, a.advertised_boundary, a.advertised_target_start, a.advertise_count) == (900, 768, 48, None, 2)
    assert (a.materialized_tokens, a.superseded_tokens, a.hit_boundary, a.request_id_reused, a.event_count) == (768, 256, 48, True, 7)
    assert (b.miss_reason, b.missed_at, b.observed_boundary, b.materialized_tokens, b.lookup_skipped, b.advertised_tokens) == ("donor_not_captured", 1008, 1008, None, "short_prompt", None)
    folder = tmp_path / "raw"
    for part in (lines[:4], lines[4:]):
        raw(spark, *lines).where(F.col("raw_line").isin(*part)).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(raw(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    live = {r.request_id: r for r in run_to_end(spark, fold_stream(stream), str(tmp_path / "run"), ["request_id"], "event_count").collect()}
    for k, r in got.items():
        assert (live[k].advertised_tokens, live[k].materialized_tokens, live[k].superseded_tokens, live[k].event_count) == (r.advertised_tokens, r.materialized_tokens, r.superseded_tokens, r.event_count)
    matched = {r.engine_request_id: r.match for r in audit.resolve(spark.createDataFrame([("rq-0000000000000001",), ("rq-00000000000000ab",), ("rq-x",)], "engine_request_id string"), audit.fold(events)).collect()}
    assert matched == {"rq-0000000000000001": "exact", "rq-00000000000000ab": "normalized", "rq-x": "missing"}


@pytest.mark.parametrize(("payload", "reason"), [
    ({"stored_donor_tokens": 2048, "segments_beyond_capture": 2, "n_raw_segments": 1}, "donor_too_short"),
    ({"stored_donor_tokens": 512, "n_raw_segments": 1, "segments_beyond_capture": 0, "snapped_spans": []}, "below_min_semantic_span"),
    ({"stored_donor_tokens": 1024, "n_segments": 2, "n_raw_segments": 0}, "donor_too_short"),
    ({"stored_donor_tokens": 1024, "n_segments": 2, "n_raw_segments": 0, "segments_wrong_donor": 2}, "true_misalignment"),
    ({"stored_donor_tokens": 0}, "donor_not_captured"),
    ({"stored_donor_tokens": True, "snapped_spans": "x"}, "unclassified"),
    ({}, "unclassified"),
])
def test_miss_reasons(spark, payload, reason):
    e = valid_events(raw(spark, event("semantic_span_boundary_missed", **payload)))
    assert audit.payloads(e).select(audit.miss_reason().alias("r")).first().r == reason


def test_normalized_ids(spark):
    ids = {"chatcmpl-rq-1": ["rq", "rq-1"], "cmpl-rq-1-0-0a1b2c3d": ["cmpl-rq-1-0", "cmpl-rq-1", "rq-1-0-0a1b2c3d", "rq-1-0", "rq-1"], "rq-abc": []}
    df = spark.createDataFrame([(k,) for k in ids], "i string")
    got = {r.i: set(r.n) for r in df.select("i", audit.normalized_ids(F.col("i")).alias("n")).collect()}
    assert got["rq-abc"] == set() and "rq-1" in got["chatcmpl-rq-1"] and set(ids["cmpl-rq-1-0-0a1b2c3d"]) <= got["cmpl-rq-1-0-0a1b2c3d"]
    df = rows(spark, {"engine_response_id": "chatcmpl-rq-0000000000000000", "engine_request_id": "rq-0000000000000000"}, {"engine_response_id": "other"}, {"engine_response_id": None})
    assert tuple(audit.id_echo(df).first()) == (2, 1, 1, 1)
    assert parse_audit_lines(raw(spark, "")).count() == 0


def test_statistics(spark):
    assert stats.interval([]) is None and stats.interval([2.0]) == (2.0, 2.0, 2.0)
    values = [float(x) for x in range(1, 40)]
    one = stats.interval(values, np.mean, 300)
    assert one == stats.interval(values, np.mean, 300) and one[1] < one[0] < one[2]
    df = spark.createDataFrame([("g", x, int(x)) for x in values], "g string, x double, o int")
    r = stats.bootstrap(df, ["g"], "x", "o", np.mean, 300).first()
    assert (r.point, r.low, r.high) == one
    p = stats.poisson_mean_interval(df, ["g"], "x", "o", 200).first()
    assert abs(p.point - 20) < 1e-9 and abs(p.low - one[1]) < 2 and abs(p.high - one[2]) < 2
    top = "array<struct<token_id bigint, logprob double>>"
    k = spark.createDataFrame([([(1, -0.1), (2, -2.0)], [(1, -0.1), (2, -2.0)], [(1, -2.0), (2, -0.1)], [(8, -0.1)], [])], f"a {top}, b {top}, c {top}, d {top}, e {top}")
    r = k.select(*(stats.topk_divergence(F.col("a"), F.col(x)).alias(x) for x in "bcde")).first()
    assert abs(r.b) < 1e-12 and r.c > 0.1 and r.d > 0.5 and math.isfinite(r.d) and r.e == 0.0
    d = spark.createDataFrame([([1, 2, 3], [1, 5]), ([1], [1, 2]), ([], [1])], "a array<bigint>, b array<bigint>")
    assert [r.x for r in d.select(stats.first_divergence(F.col("a"), F.col("b")).alias("x")).collect()] == [1, None, None]


def test_timelines(spark):
    df = spark.createDataFrame([("r", f"q{n}", u, float(a), float(b), None, 10) for n, (u, a, b) in enumerate([("x", 0, 2), ("y", 1, 3), ("z", 3, 4), ("x", 6, 8)])], "run string, id string, unit string, start_s double, end_s double, error string, tokens bigint")
    f = timeline.in_flight(df, ["run"]).first()
    assert (f.wall_s, f.most_at_once, f.idle_s) == (8.0, 2, 2.0)
    t = timeline.throughput(df, ["run"]).first()
    assert (t.requests, t.errors, t.rps, t.rps_served, t.tokens_per_s) == (4, 0, 0.5, 0.6667, 5.0)
    g = timeline.gap_shortfall(df, ["run"], "unit", 3).first()
    assert (g.id, g.gap, g.shortfall) == ("q3", 2, 1)
    v = spark.createDataFrame([("k", float(x)) for x in (50, 10, 30, 20, 40)], "k string, v double")
    r = timeline.nearest_rank(v, ["k"], "v", (0, 50, 100)).first()
    assert (r.p0, r.p50, r.p100, r.mean) == (10.0, 30.0, 50.0, 30.0)
    refs = spark.createDataFrame([("a", "s", 5), ("b", "s", 1), ("c", "t", 9)], "id string, key string, position int")
    stages = spark.createDataFrame([("u", "s", 1), ("v", "s", 4), ("w", "s", 5)], "id string, key string, position int")
    assert [(r.id, r.stage) for r in timeline.nearest_earlier(refs, stages, "key", "position").collect()] == [("a", "v")]
    assert timedelta(0) == T0 - T0


def test_workload(spark):
    src = spark.createDataFrame([(f"s{n}", "d", f"Para one {n}. More.\n\nPara two.", "What is it?", {"domain": x}) for n, x in enumerate("aabba")], "source_id string, dataset string, context string, input string, metadata map<string,string>")
    near = {r.source_id: (r.next, r.other) for r in workload.neighbours(src).collect()}
    assert near == {"s0": ("s1", "s2"), "s1": ("s2", "s2"), "s2": ("s3", "s4"), "s3": ("s4", "s4"), "s4": ("s0", "s2")}
    one = spark.createDataFrame([("s0", "d", {"domain": "a"}), ("s1", "d", None)], "source_id string, dataset string, metadata map<string,string>")
    assert {r.source_id: r.other for r in workload.neighbours(one.where("source_id = 's0'")).collect()} == {"s0": "s0"}
    assert {r.source_id: r.other for r in workload.neighbours(one).collect()} == {"s0": "s1", "s1": "s0"}
    kinds = ["exact_repeat", "negative_control", "entity_swap_control", "rag_reorder", "multi_donor_composite", "sparse_edit"]
    config = spark.createDataFrame([("d", kinds, 2, 10, "cross_domain")], "dataset string, transforms array<string>, max_segments int, min_segment_chars int, negative_selection string")
    built = {k: {r.source_id: r for r in workload.build(src, config, k).collect()} for k in kinds}
    assert built["exact_repeat"]["s0"].donors[0].text == built["exact_repeat"]["s0"].recipient
    assert set(built["entity_swap_control"]) == {"s0", "s2", "s4"} and all(r.negative_control for r in built["negative_control"].values())
    assert "Para one 2" in built["negative_control"]["s0"].donors[0].text and "Para one 0" in built["negative_control"]["s0"].recipient
    assert built["rag_reorder"]["s1"].recipient.index("Para two") < built["rag_reorder"]["s1"].recipient.index("Para one 1")
    assert len(built["multi_donor_composite"]["s1"].donors) == 2 and "Document 2:\nPara two." in built["multi_donor_composite"]["s1"].recipient
    assert workload.build(src, config, "fuzzy_edit").count() == 0
    cut = spark.createDataFrame([(1, "a. " * 300), (2, "  "), (3, "one\n \ntwo\n\n\nthree"), (4, "x" * 250)], "i int, c string")
    got = {r.i: r.parts for r in workload.with_segments(cut.selectExpr("i", "c", "2 AS most", "100 AS least"), "c", "most", "least").collect()}
    assert [len(x) for x in got[1]] == [647, 251] and set(" ".join(got[1])) == set("a. ")
    assert got[2] == [""] and got[3] == ["one", "two"] and got[4] == ["x" * 125, "x" * 125]


def test_idle_requests_are_final():
    class State:
        exists, hasTimedOut, get, waits = False, False, None, []

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.waits.append(ms)

    rows = [("semantic_span_load_advertised", "c", 1, 1, 5, None, 64, 128), ("runtime_materialized", "c", 1, 2, 6, 60, None, None)]
    batch = pd.DataFrame(rows, columns=["event", "connector_id", "request_seq", "event_seq", "line_id", "tokens", "token_count", "boundary"])
    state, fold = State(), _updater(1000)
    (row,) = fold(("r",), iter([batch]), state)
    assert row.iloc[0].tolist() == ["r", 64, 128, 1, 60, 0, 2] and state.exists and state.waits == [1000]
    state.hasTimedOut = True
    (last,) = fold(("r",), iter([]), state)
    assert last.equals(row) and not state.exists
