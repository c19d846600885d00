"""Loading delimited and JSON event lines: valid lines as typed rows, the rest with a reason.

Records are assembled quote-aware where files are read (`sources.readers.read_audit`), each is parsed
by Python's strict csv reader (or a strict JSON decoder) inside a partition-wise map, and structural
exceptions are captured before any typed field is built. Parsing is one narrow pass, without a shuffle.
"""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ten csv columns, the six keys every record has, the event names.
CSV_COLUMNS = (
    "schema_version", "event", "source", "connector_id", "mode",
    "time_unix_s", "request_id", "request_seq", "event_seq", "payload",
)
REQUIRED_KEYS = CSV_COLUMNS[:6]
EVENT_NAMES = frozenset({
    "request_first_seen", "semantic_lookup_hit", "semantic_span_load_advertised",
    "semantic_span_boundary_missed", "semantic_span_declined_unaligned_boundary",
    "semantic_span_declined_below_min_after_clamp", "semantic_span_supply_clamped",
    "load_allocated", "runtime_materialized", "runtime_materialization_declined",
    "prefix_cache_blocks_evicted",
})
SKIP_EVENT = re.compile(r"lookup_skipped_[a-z_]*[a-z]")
REQUEST_ID = re.compile(r"(?:chatcmpl-|cmpl-)?rq-[0-9a-f]{16}(?:[-_][0-9]{1,3})?(?:-[0-9a-f]{8})?")
WHOLE_NUMBER = re.compile(r"[+-]?[0-9]+")

UNPARSABLE, WRONG_COLUMNS = "unparsable", "wrong_columns"
BAD_VERSION, BAD_EVENT, BAD_REQUEST = "bad_schema_version", "bad_event", "bad_request_id"

PARSED_SCHEMA = (
    "line_id bigint, source_file string, line_format string, reason string, schema_version int, "
    "event string, source string, connector_id string, mode string, time_unix_s double, "
    "request_id string, request_seq bigint, event_seq bigint, payload string, raw_line string"
)

_FIELD = re.compile(r'\s*(?:"((?:[^"]|"")*)"\s*|([^",]*))(,|\Z)')


class Malformed(ValueError):
    """A record whose shape is broken."""


def assemble_csv_records(lines: Iterable[str]) -> Iterator[str]:
    """Join physical lines into records: a record ends at a line end outside quotes.

    An unfinished record at the end of the input is yielded as it is, so that the parser rejects
    it with a reason instead of losing it.
    """
    held: list[str] = []
    quotes = 0
    for line in lines:
        held.append(line)
        quotes += line.count('"')
        if quotes % 2 == 0:
            yield "\n".join(held)
            held, quotes = [], 0
    if held:
        yield "\n".join(held)


csv.field_size_limit(sys.maxsize)


def _strict(record: str) -> list[str]:
    rows = list(csv.reader([record], strict=True, skipinitialspace=True))
    return rows[0] if rows else [""]


def _bare(record: str) -> str:
    """The record without white space around its fields, read quote-aware; fields that hold line breaks are quoted.

    Raises `Malformed` where it is no sequence of plain fields without quotes and of quoted ones.
    """
    out, at, end = [], 0, ","
    while end:
        m = _FIELD.match(record, at)
        if not m:
            raise Malformed("quotes")
        quoted, plain, end = m.groups()
        value = quoted if quoted is not None else plain.strip()
        out.append(f'"{value}"' if quoted is not None or "\n" in value or "\r" in value else value)
        at = m.end()
    return ",".join(out)


def split_csv(record: str) -> list[str]:
    """Fields of one record, without white space around them.

    The strict reader's error is the reason that a record is malformed: a quote left open, or text
    after a closing quote. It takes white space around a quoted field for such text, so a record that
    it rejects is read again without. A quote within an unquoted field is no error to it, so records
    in whose values it leaves a quote are held against the rule for fields.
    """
    try:
        try:
            fields = _strict(record)
        except csv.Error:
            fields = _strict(_bare(record))
        else:
            if any('"' in v for v in fields):
                fields = _strict(_bare(record))
    except csv.Error as e:
        raise Malformed(str(e)) from e
    return [v.strip() for v in fields]


def _no_constant(name: str):
    raise Malformed(f"{name} is no JSON")


def _integer(text: str):
    return int(text) if len(text) < 4000 else float("inf") * (-1 if text[0] == "-" else 1)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=_integer)


_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|[^\s\[\]{},:"]+')


def _deeply_nested(text: str) -> object:
    """Checks a value that is nested deeper than the decoder's stack allows, with a stack of its own.

    Containers within the outermost one come out as null: only the outer keys are of interest.
    """
    stack: list[tuple[str, list]] = []  # opening bracket, flat sequence of items, "," and ":"
    at, done = 0, []
    while at < len(text):
        c = text[at]
        if c in " \t\n\r":
            at += 1
        elif c in "[{":
            stack.append((c, []))
            at += 1
        elif c in "]}":
            if not stack or stack[-1][0] + c not in ("[]", "{}"):
                raise Malformed("nesting")
            kind, got = stack.pop()
            flat = kind + "".join(got) + c  # holds scalars only, so that the decoder needs no stack
            _DECODER.decode(flat)
            (stack[-1][1] if stack else done).append("null" if stack else flat)
            at += 1
        elif c in ",:":
            (stack[-1][1] if stack else done).append(c)
            at += 1
        elif m := _SCALAR.match(text, at):
            (stack[-1][1] if stack else done).append(m[0] + " ")
            at = m.end()
        else:
            raise Malformed("no value")
    if stack or len(done) != 1:
        raise Malformed("nesting")
    return _DECODER.decode(done[0])


def parse_json(record: str) -> object:
    """Exactly one strict JSON value: no constants beyond the standard, nothing after it."""
    try:
        return _DECODER.decode(record)
    except RecursionError:
        try:
            return _deeply_nested(record)
        except ValueError as e:
            raise Malformed(str(e)) from e
    except Malformed:
        raise
    except ValueError as e:
        raise Malformed(str(e)) from e


def _whole(value: object) -> int | None:
    """A 64-bit whole number out of a number or its text; anything else is no number."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        value = int(value) if WHOLE_NUMBER.fullmatch(value.strip()) and len(value) < 40 else None
    if isinstance(value, float):
        value = int(value) if abs(value) < 2**63 else None
    return value if isinstance(value, int) and -(2**63) <= value < 2**63 else None


def _number(value: object) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def parse_line(line_format: str | None, raw: str | None) -> tuple | None:
    """(reason, typed fields...) of one record; None for a blank one, which is no record."""
    if raw is None or not (record := raw.strip()):
        return None
    none = (None,) * len(CSV_COLUMNS)
    is_csv = line_format == "csv"
    try:
        got = split_csv(record) if is_csv else parse_json(record)
    except Malformed:
        return (UNPARSABLE, *none)
    if is_csv:
        if len(got) != len(CSV_COLUMNS):
            return (WRONG_COLUMNS, *none)
        fields = dict(zip(CSV_COLUMNS, got))
        fields["request_id"] = fields["request_id"] or None
        payload = fields["payload"] or None
    else:
        if not isinstance(got, dict) or any(k not in got for k in REQUIRED_KEYS):
            return (WRONG_COLUMNS, *none)
        fields = got
        payload = json.dumps({k: v for k, v in got.items() if k not in CSV_COLUMNS}, ensure_ascii=False)
    version, event, request = fields["schema_version"], fields["event"], fields.get("request_id")
    if not (version == "2" or (type(version) is int and version == 2)):
        return (BAD_VERSION, *none)
    if not isinstance(event, str) or not (event in EVENT_NAMES or SKIP_EVENT.fullmatch(event)):
        return (BAD_EVENT, *none)
    if request is not None and not (isinstance(request, str) and REQUEST_ID.fullmatch(request)):
        return (BAD_REQUEST, *none)
    return (
        None, 2, event, _text(fields["source"]), _text(fields["connector_id"]), _text(fields["mode"]),
        _number(fields["time_unix_s"]), request, _whole(fields.get("request_seq")), _whole(fields.get("event_seq")), payload,
    )


def _clean(value: object) -> object:
    """Lone surrogates, which JSON may escape, can't be stored as UTF-8."""
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else value


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.strip().split(" ")[0] for x in PARSED_SCHEMA.split(",")]
    for batch in batches:
        out = []
        for line_id, source_file, line_format, raw in zip(batch["line_id"], batch["source_file"], batch["line_format"], batch["raw_line"]):
            if (got := parse_line(line_format, raw)) is not None:
                out.append((line_id, source_file, line_format, *map(_clean, got), raw if got[0] else None))
        made = pd.DataFrame(out, columns=names)
        yield made.astype({"line_id": "Int64", "schema_version": "Int32", "request_seq": "Int64", "event_seq": "Int64"})


def parse_audit_lines(lines: DataFrame) -> DataFrame:
    """One row per record of `lines(line_id, source_file, line_format, raw_line, ...)`.

    `reason` is null for a valid record, whose typed fields are then filled; else it is the first
    of unparsable, wrong_columns, bad_schema_version, bad_event, bad_request_id that applies, the
    typed fields are null and `raw_line` holds the record. Null and blank lines are no records. An
    unknown or null `line_format` is read as JSON. Equal lines stay separate rows; other columns of
    the input are ignored; an empty table gives an empty result.
    """
    return lines.select("line_id", "source_file", "line_format", "raw_line").mapInPandas(_parse_batches, PARSED_SCHEMA)


def valid_events(lines: DataFrame) -> DataFrame:
    return parse_audit_lines(lines).where(F.col("reason").isNull()).drop("reason", "raw_line")


def rejected_lines(lines: DataFrame) -> DataFrame:
    return parse_audit_lines(lines).where(F.col("reason").isNotNull()).select("line_id", "source_file", "line_format", "reason", "raw_line")
