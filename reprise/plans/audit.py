"""Queries on connector events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.operators import audit
from reprise.operators.quarantine import CSV_COLUMNS, EVENT_NAMES, REQUEST_ID, rejected_lines, valid_events
from reprise.plans import views
from reprise.plans.views import REQUESTS_SQL
from reprise.session import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_events(table(spark, sf_dir, "connector_audit_raw"))


_FIELD = r'[ \t\r\n]*("(?:[^"]|"")*"|[^",]*?)[ \t\r\n]*'
_TEN = "^" + ",".join([_FIELD] * 10) + "$"
_NAMED = ", ".join(f"'{c}'" for c in CSV_COLUMNS)
_PLAIN = "trim(CASE WHEN r.{c} LIKE '\"%' THEN replace(r.{c}[2:-2], '\"\"', '\"') ELSE r.{c} END, ' ' || chr(9) || chr(10) || chr(13))"
_COLUMNS = ", ".join(f"{_PLAIN.format(c=c)} AS {c}" for c in CSV_COLUMNS)
_ANY_CSV = '^(?:' + _FIELD + ',)*' + _FIELD + '$'
# A lenient JSON reader takes a comma before a closing bracket, and NaN; strict ones must not.
_LENIENT = r"""regexp_matches(regexp_replace(line, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',[ \t\r\n]*[}\]]|NaN|Infinity')"""
_EVENT_OK = f"(event IN ({', '.join(repr(x) for x in sorted(EVENT_NAMES))}) OR regexp_full_match(event, 'lookup_skipped_[a-z_]*[a-z]'))"
_REQUEST_OK = f"regexp_full_match(request_id, '{REQUEST_ID.pattern}')"
LINES_SQL = f"""lines AS (SELECT line_id, source_file, line_format, trim(raw_line, ' ' || chr(9) || chr(10) || chr(13)) AS line FROM connector_audit_raw),
  csv0 AS (SELECT line_id, source_file, regexp_matches(line, '{_ANY_CSV}') AS parses, regexp_extract(line, '{_TEN}', [{_NAMED}]) AS r, regexp_matches(line, '{_TEN}') AS ten FROM lines WHERE line_format = 'csv' AND line <> ''),
  csv AS (SELECT line_id, source_file, parses, ten, {_COLUMNS} FROM csv0),
  js0 AS (SELECT line_id, source_file, json_valid(line) AND NOT {_LENIENT} AS parses, CASE WHEN json_valid(line) AND NOT {_LENIENT} THEN line::JSON END AS j FROM lines WHERE line_format <> 'csv' AND line <> ''),
  js AS (SELECT line_id, source_file, parses, json_type(j) = 'OBJECT' AND len(list_intersect(json_keys(j), ['schema_version', 'event', 'source', 'connector_id', 'mode', 'time_unix_s'])) = 6 AS ten, j,
    CASE WHEN json_type(j, '$.schema_version') IN ('UBIGINT', 'BIGINT', 'VARCHAR') THEN j ->> '$.schema_version' END AS schema_version,
    CASE WHEN json_type(j, '$.event') = 'VARCHAR' THEN j ->> '$.event' END AS event,
    CASE WHEN coalesce(json_type(j, '$.request_id'), 'NULL') = 'NULL' THEN NULL WHEN json_type(j, '$.request_id') = 'VARCHAR' THEN j ->> '$.request_id' ELSE '?' END AS request_id FROM js0),
  judged AS (
    SELECT line_id, 'csv' AS f, parses, ten, schema_version, event, nullif(request_id, '') AS request_id FROM csv
    UNION ALL SELECT line_id, 'jsonl', parses, ten, schema_version, event, request_id FROM js),
  reasons AS (SELECT line_id, f, CASE WHEN NOT parses THEN 'unparsable' WHEN NOT coalesce(ten, false) THEN 'wrong_columns' WHEN coalesce(schema_version, '') <> '2' THEN 'bad_schema_version'
    WHEN NOT coalesce({_EVENT_OK}, false) THEN 'bad_event' WHEN request_id IS NOT NULL AND NOT {_REQUEST_OK} THEN 'bad_request_id' END AS reason FROM judged)"""
_INT = r"CASE WHEN regexp_full_match({x}, '\s*[+-]?[0-9]+\s*') THEN trim({x})::BIGINT WHEN regexp_full_match({x}, '-?[0-9]+\.[0-9]+') THEN regexp_extract({x}, '^(-?[0-9]+)', 1)::BIGINT END"
EVENTS_SQL = f"""{LINES_SQL},
  events AS (
    SELECT line_id, source_file, event, connector_id, nullif(request_id, '') AS request_id, {_INT.format(x='request_seq')} AS request_seq, {_INT.format(x='event_seq')} AS event_seq, CASE WHEN json_valid(payload) THEN payload::JSON END AS p
    FROM csv WHERE line_id IN (SELECT line_id FROM reasons WHERE reason IS NULL)
    UNION ALL
    SELECT line_id, source_file, event, j ->> '$.connector_id', request_id, {_INT.format(x="(j ->> '$.request_seq')")}, {_INT.format(x="(j ->> '$.event_seq')")}, j
    FROM js WHERE line_id IN (SELECT line_id FROM reasons WHERE reason IS NULL))"""


def _p(name: str) -> str:
    return _INT.format(x=f"(p ->> '$.{name}')")


_DECLINES = ", ".join(repr(x) for x in audit.DECLINES)
_BOUNDARIES = ", ".join(repr(x) for x in audit.BOUNDARIES)
_LAST = "(arg_max({{'v': {v}}}, o) FILTER (WHERE {w})).v"
_IS = "event = '{}'".format
_ADV, _MAT, _HIT, _MISS, _SEEN = map(_IS, ("semantic_span_load_advertised", "runtime_materialized", "semantic_lookup_hit", "semantic_span_boundary_missed", "request_first_seen"))


def _last(v: str, w: str) -> str:
    return _LAST.format(v=v, w=w)


_REASON = f"""CASE WHEN {_p("stored_donor_tokens")} IS NULL AND {_p("n_raw_segments")} IS NULL AND spans IS NULL AND {_p("segments_beyond_capture")} IS NULL THEN 'unclassified'
  WHEN {_p("stored_donor_tokens")} = 0 THEN 'donor_not_captured' WHEN coalesce({_p("segments_beyond_capture")}, 0) > 0 THEN 'donor_too_short'
  WHEN {_p("segments_beyond_capture")} IS NULL AND {_p("n_raw_segments")} = 0 AND coalesce({_p("n_segments")}, 0) > 0 AND coalesce({_p("segments_wrong_donor")}, 0) = 0 THEN 'donor_too_short'
  WHEN coalesce({_p("n_raw_segments")}, 0) > 0 AND coalesce(spans, 0) = 0 THEN 'below_min_semantic_span' ELSE 'true_misalignment' END"""
FOLD_SQL = f"""{EVENTS_SQL},
  e AS (SELECT *, connector_id || '|' || lpad((coalesce(request_seq, -1) + 1)::VARCHAR, 12, '0') || '|' || lpad((coalesce(event_seq, -1) + 1)::VARCHAR, 12, '0') || '|' || lpad(line_id::VARCHAR, 15, '0') AS o,
    CASE WHEN json_type(p, '$.snapped_spans') = 'ARRAY' THEN json_array_length(p, '$.snapped_spans') END AS spans FROM events WHERE request_id IS NOT NULL),
  ads AS (SELECT request_id, arg_max(line_id, o) AS advertised_line FROM e WHERE {_ADV} GROUP BY 1),
  f0 AS (SELECT request_id, bool_or({_SEEN}) AS first_seen, {_last(_p("prompt_tokens"), _SEEN)} AS prompt_tokens,
    {_last(_p("boundary"), _ADV)} AS advertised_boundary, {_last(_p("target_start"), _ADV)} AS advertised_target_start, {_last(f"coalesce({_p('token_count')}, 0)", _ADV)} AS advertised_tokens,
    count(*) FILTER (WHERE {_ADV}) AS advertise_count, count(*) FILTER (WHERE {_HIT}) AS lookup_hits, {_last(_p("already_computed_tokens"), _HIT)} AS hit_boundary0, {_last(_p("reusable_tokens"), _HIT)} AS reusable_tokens,
    count(*) FILTER (WHERE {_MISS}) AS boundary_missed_count, {_last(_p("boundary"), _MISS)} AS missed_at, {_last(_REASON, _MISS)} AS miss_reason,
    {_last("event", f"event IN ({_DECLINES})")} AS decline_event, {_last(_p("boundary"), f"event IN ({_BOUNDARIES}) AND {_p('boundary')} IS NOT NULL")} AS last_span_boundary,
    (sum(coalesce({_p("tokens")}, 0)) FILTER (WHERE {_IS("load_allocated")}))::BIGINT AS allocated_tokens,
    CASE WHEN count(*) FILTER (WHERE {_MAT}) > 0 THEN coalesce(sum(coalesce({_p("tokens")}, 0)) FILTER (WHERE {_MAT} AND line_id >= coalesce(advertised_line, -1)), 0)::BIGINT END AS materialized_tokens,
    coalesce(sum(coalesce({_p("tokens")}, 0)) FILTER (WHERE {_MAT} AND line_id < coalesce(advertised_line, -1)), 0)::BIGINT AS superseded_tokens,
    coalesce(string_agg(coalesce(nullif(p ->> '$.declined_reason', ''), 'unspecified'), ',' ORDER BY o) FILTER (WHERE {_IS("runtime_materialization_declined")}), '') AS declined_reasons,
    coalesce(string_agg(substr(event, 16), ',' ORDER BY o) FILTER (WHERE event LIKE 'lookup\\_skipped\\_%' ESCAPE '\\'), '') AS lookup_skipped,
    coalesce(sum(coalesce({_p("blocks_evicted")}, 0)) FILTER (WHERE {_IS("prefix_cache_blocks_evicted")}), 0)::BIGINT AS prefix_blocks_evicted, count(*) AS event_count
    FROM e LEFT JOIN ads USING (request_id) GROUP BY 1),
  reused AS (SELECT request_id, bool_or(n > 1) AS request_id_reused FROM (SELECT request_id, connector_id, count(DISTINCT request_seq) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
  folded AS (SELECT * EXCLUDE (hit_boundary0), CASE WHEN advertise_count > 0 THEN advertised_boundary ELSE last_span_boundary END AS observed_boundary,
    CASE WHEN lookup_hits > 0 THEN coalesce(hit_boundary0, CASE WHEN advertise_count > 0 THEN advertised_boundary ELSE last_span_boundary END) END AS hit_boundary FROM f0 JOIN reused USING (request_id))"""
_LOOSE = r"""list_filter(list_distinct(list_concat(b2, list_transform(b2, lambda x: regexp_replace(x, '[-_]\d+$', '')))), lambda x: x <> '' AND x <> id)"""
_B1 = "list_distinct([id, regexp_replace(id, '^chatcmpl-', ''), regexp_replace(id, '^cmpl-', '')])"
_B2 = "list_distinct(list_concat(b1, list_transform(b1, lambda x: regexp_replace(x, '-[0-9a-f]{8}$', ''))))"
RESOLVED_SQL = f"""n1 AS (SELECT request_id AS id, {_B1} AS b1 FROM (SELECT request_id, request_id AS id FROM folded)), n2 AS (SELECT id, {_B2} AS b2 FROM n1), n3 AS (SELECT id, unnest({_LOOSE}) AS client_id FROM n2),
  loose AS (SELECT client_id, count(*) AS n, min(id) AS only_ FROM n3 GROUP BY 1),
  resolved AS (SELECT engine_request_id, CASE WHEN f.request_id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'normalized' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS match, coalesce(f.request_id, CASE WHEN n = 1 THEN only_ END) AS audited_id
    FROM requests r LEFT JOIN folded f ON f.request_id = r.engine_request_id LEFT JOIN loose l ON l.client_id = r.engine_request_id)"""


def src03_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by what became of them."""
    raw = table(spark, sf_dir, "connector_audit_raw")
    bad = rejected_lines(raw).groupBy(F.col("reason").alias("line_class")).agg(F.count("*").alias("n"))
    good = valid_events(raw).groupBy(F.when(F.col("request_id").isNull(), "engine_scope").otherwise("event").alias("line_class")).agg(F.count("*").alias("n"))
    return bad.union(good)


def prj09_miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = audit.payloads(events(spark, sf_dir)).where("event = 'semantic_span_boundary_missed'")
    return e.groupBy(audit.miss_reason().alias("miss_reason")).agg(F.count("*").alias("n"))


def ag28_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's facts."""
    return audit.fold(events(spark, sf_dir))


def ag29_reused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag28_folded(spark, sf_dir).groupBy("request_id_reused").agg(F.count("*").alias("n_requests"))


def st01_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each request in audit order."""
    e = events(spark, sf_dir).where("request_id IS NOT NULL")
    return e.groupBy("request_id").agg(F.max_by("event", audit.order_key()).alias("last_event"), F.max_by("line_id", audit.order_key()).alias("line_id"))


def jn05_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's match in the audit."""
    return audit.resolve(views.requests(spark, sf_dir), ag28_folded(spark, sf_dir))


def ag30_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn05_resolved(spark, sf_dir).groupBy("match").agg(F.count("*").alias("n_rows"))


def jn07_id_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.id_echo(views.requests(spark, sf_dir, "engine_response_id"))


_NORMAL = "n1 AS (SELECT engine_request_id, engine_response_id AS id, list_distinct([engine_response_id, regexp_replace(engine_response_id, '^chatcmpl-', ''), regexp_replace(engine_response_id, '^cmpl-', '')]) AS b1 FROM requests)"
QUERIES = {f.__name__: f for f in (src03_line_classes, prj09_miss_reasons, ag28_folded, ag29_reused_ids, st01_event_order, jn05_resolved, ag30_join_report, jn07_id_echo)}
ORACLES = {
    "p2_found": f"WITH {LINES_SQL} SELECT line_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p2_valid_fields": f"""WITH {LINES_SQL}, good AS (SELECT line_id FROM reasons WHERE reason IS NULL),
      fields AS (SELECT line_id, source_file, 'csv' AS line_format, event, source, connector_id, mode, time_unix_s, nullif(request_id, '') AS request_id, request_seq, event_seq FROM csv WHERE line_id IN (FROM good)
        UNION ALL SELECT line_id, source_file, 'jsonl', event, j ->> '$.source', j ->> '$.connector_id', j ->> '$.mode', j ->> '$.time_unix_s', request_id, j ->> '$.request_seq', j ->> '$.event_seq' FROM js WHERE line_id IN (FROM good))
      SELECT line_id, source_file, line_format, 2 AS schema_version, event, source, connector_id, mode, try_cast(time_unix_s AS DOUBLE) AS time_unix_s, request_id, {_INT.format(x='request_seq')} AS request_seq, {_INT.format(x='event_seq')} AS event_seq FROM fields""",
    "p2_reason_counts": f"WITH {LINES_SQL} SELECT source_file, line_format, reason, count(*) AS n_lines FROM reasons JOIN lines USING (line_id) WHERE reason IS NOT NULL GROUP BY ALL",
    "src03_line_classes": f"WITH {EVENTS_SQL} SELECT reason AS line_class, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT CASE WHEN request_id IS NULL THEN 'engine_scope' ELSE 'event' END, count(*) FROM events GROUP BY 1",
    "prj09_miss_reasons": f"WITH {EVENTS_SQL}, e AS (SELECT *, CASE WHEN json_type(p, '$.snapped_spans') = 'ARRAY' THEN json_array_length(p, '$.snapped_spans') END AS spans FROM events WHERE {_MISS}) SELECT {_REASON} AS miss_reason, count(*) AS n FROM e GROUP BY 1",
    "ag28_folded": f"WITH {FOLD_SQL} SELECT * FROM folded",
    "ag29_reused_ids": f"WITH {FOLD_SQL} SELECT request_id_reused, count(*) AS n_requests FROM folded GROUP BY 1",
    "st01_event_order": f"WITH {FOLD_SQL} SELECT request_id, arg_max(event, o) AS last_event, arg_max(line_id, o) AS line_id FROM e GROUP BY 1",
    "jn05_resolved": f"WITH {REQUESTS_SQL}, {FOLD_SQL}, {RESOLVED_SQL} SELECT * FROM resolved",
    "ag30_join_report": f"WITH {REQUESTS_SQL}, {FOLD_SQL}, {RESOLVED_SQL} SELECT match, count(*) AS n_rows FROM resolved GROUP BY 1",
    "jn07_id_echo": f"WITH {REQUESTS_SQL}, {_NORMAL}, n2 AS (SELECT engine_request_id, id, {_B2} AS b2 FROM n1), n3 AS (SELECT engine_request_id, id, {_LOOSE} AS l FROM n2) SELECT count(*) FILTER (WHERE id <> '') AS rows_checked, count(*) FILTER (WHERE id <> '' AND (id = engine_request_id OR list_contains(l, engine_request_id))) AS rows_echoed, count(*) FILTER (WHERE id <> '' AND NOT (id = engine_request_id OR list_contains(l, engine_request_id))) AS rows_mismatched, count(*) FILTER (WHERE coalesce(id, '') = '') AS rows_without_response_id FROM n3",
}
