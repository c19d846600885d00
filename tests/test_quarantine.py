import json

import pytest

from reprise.operators.quarantine import Malformed, assemble_csv_records, parse_audit_lines, parse_json, parse_line, split_csv, valid_events

GOOD = '2,load_allocated,kv,wrk-1,"a, b",1.5,rq-0123456789abcdef,0,1,"{""tokens"": 3}"'
EVENT = {"schema_version": 2, "event": "load_allocated", "source": "kv", "connector_id": "w", "mode": "m", "time_unix_s": 1.5}


def jsonl(**other):
    return json.dumps(EVENT | other)


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None),
        ("  " + GOOD.replace(",kv,", ' , "kv" ,') + "\t", None),
        (GOOD.replace("tokens", "tok\nens"), None),
        (GOOD.replace("2,", '" 2 ",', 1), None),
        (GOOD.replace(',"a, b",', ',\t"a, b"\t,'), None),
        (GOOD.replace(",1.5,", ",\n1.5 ,"), None),
        (GOOD.replace(',"a, b",', ',\t"a, b"\t"c",'), "unparsable"),
        (GOOD.replace(',"a, b",', ',a "b",'), "unparsable"),
        (GOOD[:-1], "unparsable"),
        (GOOD.replace("wrk-1", 'wr"k-1'), "unparsable"),
        (GOOD.replace('b"', 'b"x'), "unparsable"),
        (GOOD + ",", "wrong_columns"),
        (GOOD.replace(",1.5", ""), "wrong_columns"),
        (GOOD.replace("2,", "2.0,", 1), "bad_schema_version"),
        (GOOD.replace("load_allocated", "Load_allocated"), "bad_event"),
        (GOOD.replace("load_allocated", "lookup_skipped_"), "bad_event"),
        (GOOD.replace("load_allocated", "lookup_skipped_a_b"), None),
        (GOOD.replace("load_allocated", "lookup_skipped_a_"), "bad_event"),
        (GOOD.replace("rq-0123456789abcdef", ""), None),
        (GOOD.replace("rq-0123456789abcdef", "cmpl-rq-0123456789abcdef_12-0a1b2c3d"), None),
        (GOOD.replace("rq-0123456789abcdef", "null"), "bad_request_id"),
    ],
)
def test_csv_reasons(line, reason):
    assert parse_line("csv", line)[0] == reason


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (jsonl(), None),
        (jsonl(schema_version="2"), None),
        (jsonl(schema_version=True), "bad_schema_version"),
        (jsonl(schema_version=2.5), "bad_schema_version"),
        (jsonl(event=3), "bad_event"),
        (jsonl(request_id=None), None),
        (jsonl(request_id=""), "bad_request_id"),
        (jsonl(request_id="rq-0123456789abcdef", n=10**20), None),
        (jsonl() + jsonl(), "unparsable"),
        (jsonl(x=float("nan")), "unparsable"),
        ("null", "wrong_columns"),
        ("[]", "wrong_columns"),
        (json.dumps({k: v for k, v in EVENT.items() if k != "mode"}), "wrong_columns"),
        ('{"a": ' + "[" * 100_000 + "]" * 100_000 + "}", "wrong_columns"),
        ('{"a": ' + "[" * 100_000 + "]" * 99_999 + "}", "unparsable"),
    ],
)
def test_json_reasons(line, reason):
    assert parse_line("jsonl", line)[0] == reason


def test_blank_lines_are_no_records():
    assert parse_line("csv", " \t\n") is None and parse_line("jsonl", None) is None


def test_strict_parsers():
    assert split_csv('a, "b ""c"" , d" ,') == ["a", 'b "c" , d', ""]
    assert len(split_csv("x" * 500_000 + ",y")) == 2
    with pytest.raises(Malformed):
        parse_json('{"a": Infinity}')
    assert list(assemble_csv_records(['a,"b', 'c",d', "e", '"f'])) == ['a,"b\nc",d', "e", '"f']


def test_rows_from_spark(spark):
    lines = [(1, "f", "csv", GOOD, "x"), (2, "f", "jsonl", jsonl(request_seq="7", tokens=4), "x"), (3, "f", "jsonl", "", "x"), (4, None, None, None, "x"), (5, "f", "jsonl", jsonl(source="\ud800"), None), (5, "f", "csv", "a,b", None)]
    df = spark.createDataFrame(lines, "line_id bigint, source_file string, line_format string, raw_line string, reason string")
    got = {(r.line_id, r.reason): r for r in parse_audit_lines(df).collect()}
    assert set(got) == {(1, None), (2, None), (5, None), (5, "wrong_columns")}
    assert got[1, None].mode == "a, b" and got[1, None].time_unix_s == 1.5 and got[1, None].event_seq == 1
    assert got[2, None].request_seq == 7 and json.loads(got[2, None].payload) == {"tokens": 4}
    assert got[5, "wrong_columns"].raw_line == "a,b"
    assert valid_events(df.limit(0)).collect() == []
