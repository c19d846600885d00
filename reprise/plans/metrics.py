"""Queries on request rows: signals, pairs, per-arm and audit metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reprise.functions.rouge import rouge_l
from reprise.operators import audit, metrics, pairing
from reprise.operators import signals as S
from reprise.operators.ordinals import with_ordinal
from reprise.plans import views
from reprise.plans.audit import FOLD_SQL, RESOLVED_SQL, events
from reprise.plans.text import _SQL_WORDS, SQL_LCS
from reprise.plans.views import REQUESTS_SQL

# Measures that the test tables lack, derived from those they have, the same way on both sides.
_DERIVED = {
    "fuzzy_confirmed_tokens": "CASE WHEN external_confirmed_tokens IS NULL AND wrapper_rank >= 6 THEN semantic_eligible_tokens ELSE 0 END",
    "backend_confirmed_blocks": "CAST(floor(backend_confirmed_tokens / 16) AS BIGINT)",
    "planner_found": "semantic_candidate_blocks > 0",
    "planner_latency_ms": "coalesce(queue_time_ms, 0)",
    "route_outcome": "CASE WHEN error IS NOT NULL THEN 'error' WHEN semantic_eligible_blocks > 0 THEN 'semantic_placement' WHEN exact_hit_blocks > 0 THEN 'exact_placement' END",
    "quality_pass": "CASE WHEN output_text IS NOT NULL THEN length(output_text) % 5 <> 0 END",
    "flush_contaminated": "arm = 'cold' AND exact_hit_blocks > 0",
    "expected_supplied_tokens": "CASE WHEN donor_count = 1 THEN semantic_eligible_tokens END",
    "rope_delta_bucket": "CASE WHEN wrapper_rank <> 7 THEN CAST(wrapper_rank % 3 AS BIGINT) END",
}
_COLUMNS = ("run_id", "engine_response_id", "item_id", "dataset", "transform", "negative_control", "arm", "traffic_class", "wrapper_rank", "stream_position", "donor_count", "prompt_tokens", "total_blocks", "exact_hit_blocks", "exact_hit_tokens", "semantic_candidate_blocks", "semantic_candidate_tokens", "semantic_eligible_blocks", "semantic_eligible_tokens", "backend_confirmed_tokens", "external_confirmed_tokens", "queue_time_ms", "ttft_ms", "output_text", "error", "started_at")
_NO_AUDIT = {"audit_materialized": "boolean", "audit_joined": "boolean", "audit_advertised_tokens": "bigint"}
ROWS_SQL = f"{REQUESTS_SQL}, rows_ AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in _DERIVED.items())} FROM requests)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir, *_COLUMNS).withColumn("ordinal", F.struct("started_at", "engine_request_id"))
    return r.withColumns({name: F.expr(sql) for name, sql in _DERIVED.items()})


def _unaudited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).withColumns({c: F.lit(None).cast(t) for c, t in _NO_AUDIT.items()})


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stamp(rows(spark, sf_dir), audit.fold(events(spark, sf_dir)))


def prj01_traffic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy(S.traffic_class().alias("traffic_class")).agg(F.count("*").alias("n_rows"))


def prj02_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic tokens, hit and mechanism of every request."""
    return _unaudited(spark, sf_dir).select("engine_request_id", S.semantic_tokens().alias("semantic_tokens"), S.is_hit().alias("is_hit"), S.mechanism().alias("mechanism"), S.wrapper_stratum().alias("stratum"))


def prj06_audit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(spark, sf_dir).groupBy("arm", S.audit_class().alias("audit_class"), "audit_joined").agg(F.count("*").alias("n_rows"))


def ag18_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the workload by traffic class."""
    items = views.items(spark, sf_dir).select("transform", F.get_json_object("metadata", "$.traffic_class").alias("traffic_class"))
    return items.groupBy(S.traffic_class().alias("traffic_class")).agg(F.count("*").alias("n_items"))


def prj18_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an item's metadata expects of its request; truth values and other text are no numbers."""
    m = views.items(spark, sf_dir).select("item_id", F.from_json("metadata", "stream_position string, expected_supplied_tokens string, wrapper_rank string, wrapper_id string, segment_count string").alias("m"))
    return m.select("item_id", *(audit.number(F.col(f"m.{c}")).alias(c) for c in ("stream_position", "expected_supplied_tokens", "wrapper_rank", "segment_count")), F.nullif("m.wrapper_id", F.lit("")).alias("wrapper_id"))


def jn01_join_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.join_arms(rows(spark, sf_dir).where("arm IN ('cold', 'warm')"))


def ag37_pairing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jn01_join_arms(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("status").orderBy("item_id"))  # ten per status, limited before the shuffle
    shown = j.withColumn("k", first).where("k <= 10").groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("preview"))
    return j.groupBy("status").agg(F.count("*").alias("n_items")).join(shown, "status")


def wf03_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.duplicates(rows(spark, sf_dir).where("arm IN ('cold', 'warm')"))


def wf04_replay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold and warm steps of the items of each dataset, in the order of their ids: 2i and 2i + 1."""
    i = with_ordinal(views.items(spark, sf_dir).select(F.struct("dataset", "item_id").alias("o")), "o").select("o.dataset", "o.item_id", "ordinal")
    first = i.groupBy("dataset").agg(F.min("ordinal").alias("first"))
    step = i.join(first, "dataset").select("dataset", "item_id", (F.col("ordinal") - F.col("first")).alias("i"))
    return step.select("dataset", "item_id", F.posexplode(F.array(F.lit("cold"), F.lit("warm"))).alias("k", "arm"), "i").select("dataset", "item_id", "arm", (F.col("i") * 2 + F.col("k")).alias("position"))


def jn04_pair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.status_counts(pairing.pairs(_unaudited(spark, sf_dir).where("arm IN ('cold', 'warm')")))


def jn04_clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean pairs with both times, their ratio, hit and mechanism."""
    flat = pairing.timed(pairing.pairs(_unaudited(spark, sf_dir).where("arm IN ('cold', 'warm')"))).where("timed")
    return flat.select("item_id", "control", "cold_ms", "warm_ms", "ratio", "hit", "mechanism", "traffic_class")


def ag20_paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.summary(pairing.timed(pairing.pairs(_unaudited(spark, sf_dir).where("arm IN ('cold', 'warm')"))))


def ag20_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = pairing.timed(pairing.pairs(_unaudited(spark, sf_dir).where("arm IN ('cold', 'warm')")))
    return flat.where("timed AND NOT control").groupBy("mechanism").agg(F.count("*").alias("n_pairs"))


def ag20_output_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the arms' answers over clean pairs that both have one."""
    paired = pairing.pairs(_unaudited(spark, sf_dir).where("arm IN ('cold', 'warm')"), "output_text")
    scored = pairing.answers(paired).select(rouge_l("warm_text", "cold_text").alias("r"))
    return scored.agg(F.count("*").alias("n_pairs"), F.round(F.avg("r"), 9).alias("mean_rouge_l"))


def ag21_miss_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.miss_tax(pairing.pairs(_stamped(spark, sf_dir).where("arm IN ('cold', 'warm')")))


def ag21_capture_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.miss_tax(pairing.pairs(_stamped(spark, sf_dir).where("arm IN ('cold', 'warm')")), capture=True)


def ag25_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propagation, with reworded documents as probes and the dataset's first item as their parent."""
    r = _unaudited(spark, sf_dir).where("arm IN ('cold', 'warm')")
    first = views.items(spark, sf_dir).groupBy("dataset").agg(F.min("item_id").alias("parent_item_id"))
    probes = r.withColumn("traffic_class", F.when(F.col("traffic_class") == "reworded_doc", S.PROBE).otherwise(F.col("traffic_class"))).join(first, "dataset", "left")
    served = pairing.last_rows(r.where("arm = 'warm'").select("item_id", "arm", "ordinal", "output_text"))
    return pairing.propagation(pairing.pairs(probes, "output_text", "parent_item_id"), served, rouge_l)


def ag01_per_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, confirmed mass, rates, lifts and negative controls of each arm."""
    return metrics.per_arm(rows(spark, sf_dir))


def ag09_by_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_transform(rows(spark, sf_dir))


def ag06_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).where("route_outcome IS NOT NULL").groupBy("arm", "route_outcome").agg(F.count("*").alias("n_rows"))


def ag08_rope_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by bucket of the position shift; rows without a bucket belong to none."""
    b = rows(spark, sf_dir).where("rope_delta_bucket IS NOT NULL")
    return b.groupBy("rope_delta_bucket").agg(F.count("*").alias("n_rows"), F.count("quality_pass").alias("n_scored"), F.avg(F.col("quality_pass").cast("int")).alias("quality_pass_rate"))


def ag10_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.considered(_stamped(spark, sf_dir))
    joined = F.coalesce(F.bool_or(F.col("audit_joined").isNotNull()), F.lit(False))
    return c.agg(*metrics.alignment_aggregates(joined))


def ag11_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.breakdowns(_stamped(spark, sf_dir))


def ag12_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_stratum(_stamped(spark, sf_dir))


def ag15_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialised reuse and the inputs to propagation."""
    c = metrics.considered(_stamped(spark, sf_dir))
    joined = F.coalesce(F.bool_or(F.col("audit_joined").isNotNull()), F.lit(False))
    return c.agg(*metrics.reuse_aggregates(joined))


def ag17_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.presence(_stamped(spark, sf_dir))


def jn06_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows with their audit facts."""
    return _stamped(spark, sf_dir).select("engine_request_id", "match", "audit_joined", "audit_observed_boundary", "audit_advertised_tokens", "audit_materialized", "external_confirmed_tokens", "audit_lookup_hit", "audit_hit_boundary", "audit_miss_reason", "audit_decline_event", "audit_superseded_tokens", "audit_blocks_evicted")


_CLASS = "coalesce(nullif(traffic_class, ''), nullif(transform, ''), '')"
_SEM = "CASE WHEN external_confirmed_tokens IS NULL THEN {unmeasured} ELSE greatest(external_confirmed_tokens, coalesce(fuzzy_confirmed_tokens, 0)) END"
_SEM_PLAIN = _SEM.format(unmeasured="nullif(coalesce(fuzzy_confirmed_tokens, 0), 0)")
_MECH = "CASE WHEN coalesce(fuzzy_confirmed_tokens, 0) > coalesce(backend_confirmed_tokens, 0) THEN 'scatter' WHEN coalesce(fuzzy_confirmed_tokens, 0) > 0 THEN 'head' WHEN coalesce(external_confirmed_tokens, 0) >= 64 THEN 'external' WHEN coalesce(backend_confirmed_tokens, 0) >= 64 THEN 'exact' ELSE 'none' END"
_STRATUM = "CASE WHEN wrapper_rank IS NULL THEN 'unstratified' WHEN wrapper_rank <= 1 THEN 'shared_wrapper' ELSE 'ad_hoc' END"
_CLEAN_NUM = r"CASE WHEN regexp_full_match({x}, '\s*[+-]?[0-9]+\s*') THEN {x}::BIGINT END"
_FIRST = f"WITH {ROWS_SQL}, firsts AS (SELECT DISTINCT ON (item_id, arm) * FROM rows_ WHERE arm IN ('cold', 'warm') ORDER BY item_id, arm, started_at, engine_request_id), c AS (SELECT * FROM firsts WHERE arm = 'cold'), w AS (SELECT * FROM firsts WHERE arm = 'warm'), j AS (SELECT coalesce(c.item_id, w.item_id) AS item_id, CASE WHEN w.item_id IS NULL THEN 'only_cold' WHEN c.item_id IS NULL THEN 'only_warm' WHEN {' AND '.join(f'c.{x} IS NOT DISTINCT FROM w.{x}' for x in pairing.FINGERPRINT)} THEN 'paired' ELSE 'mismatch' END AS status FROM c FULL JOIN w ON c.item_id = w.item_id)"
_STAMPED = f"""{FOLD_SQL}, {RESOLVED_SQL}, stamped AS (SELECT r.* EXCLUDE (external_confirmed_tokens), s.match, s.audited_id IS NOT NULL AS audit_joined, f.observed_boundary AS audit_observed_boundary,
  CASE WHEN f.advertise_count > 0 THEN f.advertised_tokens END AS audit_advertised_tokens, f.advertised_target_start AS audit_advertised_target_start, CASE WHEN f.request_id IS NOT NULL THEN f.materialized_tokens IS NOT NULL END AS audit_materialized, coalesce(f.materialized_tokens, r.external_confirmed_tokens) AS external_confirmed_tokens,
  CASE WHEN f.request_id IS NOT NULL THEN f.lookup_hits > 0 END AS audit_lookup_hit, f.hit_boundary AS audit_hit_boundary, f.miss_reason AS audit_miss_reason, f.missed_at AS audit_missed_at, f.decline_event AS audit_decline_event, f.superseded_tokens AS audit_superseded_tokens, f.prefix_blocks_evicted AS audit_blocks_evicted
  FROM rows_ r JOIN resolved s USING (engine_request_id) LEFT JOIN folded f ON f.request_id = s.audited_id)"""


def _pairs_sql(source: str) -> str:
    return f"""lasts AS (SELECT DISTINCT ON (item_id, arm) * FROM {source} WHERE arm IN ('cold', 'warm') ORDER BY item_id, arm, started_at DESC, engine_request_id DESC),
  c AS (SELECT * FROM lasts WHERE arm = 'cold'), w AS (SELECT * FROM lasts WHERE arm = 'warm'),
  p AS (SELECT c.item_id AS cold_id, coalesce(c.negative_control, false) AS control, c.ttft_ms AS cold_ms, c.queue_time_ms AS cold_queue_ms, c.output_text AS cold_text, w.*,
    CASE WHEN w.item_id IS NULL THEN 'unpaired' WHEN c.flush_contaminated THEN 'contaminated' WHEN coalesce(c.error, '') <> '' OR coalesce(w.error, '') <> '' THEN 'errored' WHEN c.stream_position <> w.stream_position THEN 'moved' ELSE 'clean' END AS status
    FROM c LEFT JOIN w ON c.item_id = w.item_id),
  clean AS (SELECT *, coalesce(cold_ms <> 0 AND NOT isnan(cold_ms), false) AND coalesce(ttft_ms <> 0 AND NOT isnan(ttft_ms), false) AS timed, cold_ms / ttft_ms AS ratio FROM p WHERE status = 'clean')"""


_PAIRS = f"WITH {ROWS_SQL}, {_pairs_sql('rows_')}, flat AS (SELECT *, ({_SEM_PLAIN}) >= 64 AS hit, coalesce(backend_confirmed_tokens, 0) >= 64 AS legacy_hit, {_MECH} AS mechanism, {_CLASS} AS tclass FROM clean)"
_AUDITED_PAIRS = f"WITH {ROWS_SQL}, {_STAMPED}, {_pairs_sql('stamped')}"


def _q(x: str, p: float, when: str) -> str:
    return f"quantile_cont({x}::DOUBLE, {p}) FILTER (WHERE {when})"


_B, _C = "timed AND NOT control", "timed AND control"
_SUMMARY = f"""{_PAIRS} SELECT count(*) FILTER (WHERE timed) AS pairs_used, {_q('cold_ms', .5, 'timed')} AS cold_p50_ms, {_q('cold_ms', .95, 'timed')} AS cold_p95_ms, {_q('ttft_ms', .5, 'timed')} AS warm_p50_ms, {_q('ttft_ms', .95, 'timed')} AS warm_p95_ms,
  {_q('ratio', .5, _B)} AS blended_median, avg(ratio) FILTER (WHERE {_B}) AS blended_mean, count(*) FILTER (WHERE {_B} AND coalesce(hit, legacy_hit)) / nullif(count(*) FILTER (WHERE {_B}), 0) AS hit_rate,
  count(*) FILTER (WHERE {_B} AND hit) / nullif(count(*) FILTER (WHERE {_B} AND hit IS NOT NULL), 0) AS hit_rate_confirmed, count(*) FILTER (WHERE {_B} AND hit IS NOT NULL) AS pairs_confirmed, count(*) FILTER (WHERE {_B} AND hit IS NULL) AS pairs_unconfirmed, count(*) FILTER (WHERE {_B} AND hit IS NULL AND legacy_hit) AS hits_unverified,
  {_q('ratio', .5, _B + ' AND coalesce(hit, legacy_hit)')} AS hit_only_median, avg(ratio) FILTER (WHERE {_B} AND coalesce(hit, legacy_hit)) AS hit_only_mean, count(*) FILTER (WHERE {_C}) AS control_pairs, {_q('ratio', .5, _C)} AS control_median, avg(ratio) FILTER (WHERE {_C}) AS control_mean,
  {_q('cold_queue_ms', .5, 'true')} AS cold_queue_p50_ms, {_q('queue_time_ms', .5, 'true')} AS warm_queue_p50_ms FROM flat"""


def _tax(missed: str) -> str:
    measured = "(NOT control AND coalesce(audit_joined, false))"
    silent = f"({measured} AND coalesce(audit_advertised_tokens, 0) = 0)"
    used = f"({missed.format(silent=silent)} AND timed)"
    said = "CASE WHEN bool_or(audit_joined IS NOT NULL) THEN {} END".format
    warm, cold = _q("ttft_ms", 0.5, used), _q("cold_ms", 0.5, used)
    n = lambda x: f"count(*) FILTER (WHERE {x})"
    return f"""{_AUDITED_PAIRS} SELECT {said(f'({warm}) - ({cold})')} AS miss_tax_ms, {said(_q('(ttft_ms - cold_ms)', .5, used))} AS median_of_differences_ms, {said(warm)} AS warm_p50_ms, {said(cold)} AS cold_p50_ms, {said(n(used))} AS pairs,
      {said(n(missed.format(silent=silent) + ' AND NOT timed'))} AS pairs_without_times, {said(n(measured + ' AND NOT ' + silent))} AS pairs_advertising, {said(n('NOT control AND NOT coalesce(audit_joined, false)'))} AS pairs_not_audited, {said(n(silent + ' AND NOT ' + missed.format(silent=silent)))} AS pairs_outside_class, {n('control')} AS pairs_control FROM clean"""


_ARM = f"""WITH {ROWS_SQL}, a AS (SELECT {{key}}, count(*) AS request_count, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in metrics._SUMS)}, sum(backend_confirmed_blocks)::BIGINT AS backend_confirmed_blocks,
  CASE WHEN count(backend_confirmed_blocks) > 0 THEN coalesce(sum(backend_confirmed_tokens), 0)::BIGINT END AS backend_confirmed_tokens, sum(external_confirmed_tokens)::BIGINT AS external_confirmed_tokens,
  bool_or(planner_found OR semantic_candidate_blocks > 0 OR semantic_eligible_blocks > 0 OR planner_latency_ms > 0) AS planned, count(*) FILTER (WHERE negative_control) AS negative_control_count, coalesce(sum(total_blocks) FILTER (WHERE negative_control), 0)::BIGINT AS negative_control_blocks,
  coalesce(sum(semantic_eligible_blocks) FILTER (WHERE negative_control), 0)::BIGINT AS negative_control_eligible_blocks, count(*) FILTER (WHERE negative_control AND route_outcome = 'semantic_placement') AS negative_control_placements,
  CASE WHEN count(backend_confirmed_blocks) > 0 THEN coalesce(sum(backend_confirmed_blocks) FILTER (WHERE negative_control), 0)::BIGINT END AS negative_control_confirmed_blocks, count(*) FILTER (WHERE route_outcome = 'semantic_placement') AS semantic_placements,
  count(*) FILTER (WHERE planner_found) AS planner_hits, avg(planner_latency_ms) FILTER (WHERE planner_latency_ms > 0) AS mean_planner_latency_ms, avg(ttft_ms) FILTER (WHERE NOT isnan(ttft_ms)) AS mean_ttft_ms, avg(quality_pass::INT) AS quality_pass_rate FROM rows_ GROUP BY {{group}}),
  z AS (SELECT *, coalesce(exact_hit_blocks / nullif(total_blocks, 0), 0.0) AS x, coalesce(semantic_eligible_blocks / nullif(total_blocks, 0), 0.0) AS y, CASE WHEN backend_confirmed_blocks IS NOT NULL THEN coalesce(backend_confirmed_blocks / nullif(total_blocks, 0), 0.0) END AS k FROM a)
  SELECT * EXCLUDE (x, y, k), x AS exact_block_hit_rate, coalesce(semantic_candidate_blocks / nullif(total_blocks, 0), 0.0) AS semantic_candidate_block_rate, y AS semantic_eligible_block_rate, k AS backend_confirmed_block_rate, CASE WHEN planned THEN y - x END AS semantic_eligible_lift, k - x AS backend_confirmed_lift,
  coalesce(exact_hit_tokens / nullif(prompt_tokens, 0), 0.0) AS exact_token_rate, coalesce(semantic_candidate_tokens / nullif(prompt_tokens, 0), 0.0) AS semantic_candidate_token_rate, coalesce(semantic_eligible_tokens / nullif(prompt_tokens, 0), 0.0) AS semantic_eligible_token_rate, CASE WHEN external_confirmed_tokens IS NOT NULL THEN coalesce(external_confirmed_tokens / nullif(prompt_tokens, 0), 0.0) END AS external_token_rate,
  coalesce(negative_control_eligible_blocks / nullif(negative_control_blocks, 0), 0.0) AS negative_control_eligible_rate, coalesce(negative_control_placements / nullif(negative_control_count, 0), 0.0) AS negative_control_placement_rate, CASE WHEN negative_control_confirmed_blocks IS NOT NULL THEN coalesce(negative_control_confirmed_blocks / nullif(negative_control_blocks, 0), 0.0) END AS negative_control_confirmed_rate,
  coalesce(semantic_placements / nullif(request_count, 0), 0.0) AS semantic_placement_rate, coalesce(planner_hits / nullif(request_count, 0), 0.0) AS planner_hit_rate FROM z"""
_CONSIDERED = f"WITH {ROWS_SQL}, {_STAMPED}, k AS (SELECT *, coalesce(audit_advertised_tokens, 0) > 0 AND coalesce(audit_observed_boundary, 0) > 0 AS adv, coalesce(audit_lookup_hit, false) AND coalesce(audit_hit_boundary, 0) > 0 AS hit, {_CLASS} IN ('same_doc_new_instruction', 'revised_doc') AS opp, {_CLASS} AS tclass, {_STRATUM} AS stratum FROM stamped WHERE arm <> 'cold')"
_N = "count(*) FILTER (WHERE {})".format
_SUPPLIED = "expected_supplied_tokens IS NOT NULL AND audit_advertised_tokens IS NOT NULL"
_MADE = "audit_advertised_tokens IS NOT NULL AND audit_materialized"
_CACHED = "tclass = 'propagation_probe' AND external_confirmed_tokens IS NULL AND coalesce(backend_confirmed_tokens, 0) > 0"
_KEPT = f"coalesce(sum(coalesce(external_confirmed_tokens, 0)) FILTER (WHERE {_MADE}), 0)::BIGINT"
_PROMISED = "coalesce(sum(audit_advertised_tokens), 0)::BIGINT"

QUERIES = {
    f.__name__: f
    for f in (prj01_traffic_classes, prj02_signals, prj06_audit_classes, prj18_expectations, ag18_class_counts, jn01_join_arms, ag37_pairing_report, wf03_duplicates, wf04_replay_plan, jn04_pair_status, jn04_clean_pairs, ag20_paired_summary, ag20_mechanisms, ag20_output_rouge, ag21_miss_tax, ag21_capture_tax, ag25_propagation, ag01_per_arm, ag09_by_transform, ag06_routes, ag08_rope_buckets, ag10_alignment, ag11_breakdowns, ag12_strata, ag15_materialised, ag17_presence, jn06_stamped)
}
ORACLES = {
    "prj01_traffic_classes": f"WITH {ROWS_SQL} SELECT {_CLASS} AS traffic_class, count(*) AS n_rows FROM rows_ GROUP BY 1",
    "prj02_signals": f"WITH {ROWS_SQL} SELECT engine_request_id, {_SEM_PLAIN} AS semantic_tokens, ({_SEM_PLAIN}) >= 64 AS is_hit, {_MECH} AS mechanism, {_STRATUM} AS stratum FROM rows_",
    "prj06_audit_classes": f"WITH {ROWS_SQL}, {_STAMPED} SELECT arm, CASE WHEN arm = 'cold' THEN 'cold_arm' ELSE 'considered' END AS audit_class, audit_joined, count(*) AS n_rows FROM stamped GROUP BY ALL",
    "prj18_expectations": "WITH items AS (SELECT DISTINCT ON (item_id) * FROM workload_items) SELECT item_id, " + ", ".join(f"{_CLEAN_NUM.format(x=f'(metadata::JSON ->> {chr(39)}$.{c}{chr(39)})')} AS {c}" for c in ("stream_position", "expected_supplied_tokens", "wrapper_rank", "segment_count")) + ", nullif(metadata::JSON ->> '$.wrapper_id', '') AS wrapper_id FROM items",
    "ag18_class_counts": "WITH items AS (SELECT DISTINCT ON (item_id) * FROM workload_items) SELECT coalesce(nullif(metadata::JSON ->> '$.traffic_class', ''), nullif(transform, ''), '') AS traffic_class, count(*) AS n_items FROM items GROUP BY 1",
    "jn01_join_arms": f"{_FIRST} SELECT * FROM j",
    "ag37_pairing_report": f"{_FIRST} SELECT status, count(*) AS n_items, array_to_string(list_sort(list(item_id))[1:10], ',') AS preview FROM j GROUP BY 1",
    "wf03_duplicates": f"WITH {ROWS_SQL} SELECT arm, item_id, count(*) AS n, min(started_at) AS first_at FROM rows_ WHERE arm IN ('cold', 'warm') GROUP BY ALL HAVING count(*) > 1",
    "wf04_replay_plan": "WITH items AS (SELECT DISTINCT ON (item_id) * FROM workload_items), i AS (SELECT dataset, item_id, row_number() OVER (PARTITION BY dataset ORDER BY item_id) - 1 AS i FROM items) SELECT dataset, item_id, arm, i * 2 + k AS position FROM i, (VALUES ('cold', 0), ('warm', 1)) v(arm, k)",
    "jn04_pair_status": f"{_PAIRS} SELECT status, count(*) AS n_pairs FROM p GROUP BY 1",
    "jn04_clean_pairs": f"{_PAIRS} SELECT item_id, control, cold_ms, ttft_ms AS warm_ms, ratio, hit, mechanism, tclass AS traffic_class FROM flat WHERE timed",
    "ag20_paired_summary": _SUMMARY,
    "ag20_mechanisms": f"{_PAIRS} SELECT mechanism, count(*) AS n_pairs FROM flat WHERE {_B} GROUP BY 1",
    "ag20_output_rouge": f"""{_PAIRS}, t AS (SELECT {_SQL_WORDS.format(x="output_text")} AS x, {_SQL_WORDS.format(x="cold_text")} AS y FROM clean WHERE cold_text <> '' AND output_text <> ''),
      m AS (SELECT len(x) AS n, len(y) AS k, CASE WHEN len(x) > 0 AND len(y) > 0 THEN {SQL_LCS.format(x="x", y="y")} ELSE 0 END AS c FROM t)
      SELECT count(*) AS n_pairs, round(avg(CASE WHEN c = 0 THEN 0.0 ELSE 2 * (c / n) * (c / k) / (c / n + c / k) END), 9) AS mean_rouge_l FROM m""",
    "ag21_miss_tax": _tax("{silent}"),
    "ag21_capture_tax": _tax(f"({{silent}} AND {_CLASS} = 'no_reuse')"),
    "ag01_per_arm": _ARM.format(key="arm", group="arm"),
    "ag09_by_transform": _ARM.format(key="transform", group="ROLLUP (transform)"),
    "ag06_routes": f"WITH {ROWS_SQL} SELECT arm, route_outcome, count(*) AS n_rows FROM rows_ WHERE route_outcome IS NOT NULL GROUP BY ALL",
    "ag08_rope_buckets": f"WITH {ROWS_SQL} SELECT rope_delta_bucket, count(*) AS n_rows, count(quality_pass) AS n_scored, avg(quality_pass::INT) AS quality_pass_rate FROM rows_ WHERE rope_delta_bucket IS NOT NULL GROUP BY 1",
    "ag10_alignment": f"{_CONSIDERED} SELECT count(*) AS rows_considered, {_N('adv')} / nullif({_N('hit')}, 0) AS given_match, {_N('adv')} AS aligned, {_N('hit')} AS lookup_hits, {_N('adv')} / nullif({_N('opp')}, 0) AS given_opportunity, {_N('adv AND NOT opp')} AS aligned_outside_classes, {_N('adv AND opp')} / nullif({_N('opp')}, 0) AS given_opportunity_in_class, {_N('opp')} AS opportunity_rows, {_N('wrapper_rank <= 1')} / nullif(count(wrapper_rank), 0) AS wrapper_head_share, {_N('wrapper_rank <= 1')} / nullif(count(wrapper_rank), 0) > 0.5 AS wrapper_head_is_majority, {_N(_SUPPLIED + ' AND expected_supplied_tokens = audit_advertised_tokens')} / nullif({_N(_SUPPLIED)}, 0) AS supplied_agreement, {_N(_SUPPLIED + ' AND expected_supplied_tokens = audit_advertised_tokens')} AS supplied_agreed, {_N(_SUPPLIED)} AS supplied_claims FROM k",
    "ag11_breakdowns": f"{_CONSIDERED} SELECT 'miss' AS kind, audit_miss_reason AS reason, count(*) AS n FROM k WHERE audit_miss_reason IS NOT NULL AND coalesce(audit_missed_at, 0) > 0 GROUP BY ALL UNION ALL SELECT 'decline', audit_decline_event, count(*) FROM k WHERE audit_decline_event IS NOT NULL GROUP BY ALL",
    "ag12_strata": f"{_CONSIDERED}, s AS (SELECT stratum, count(*) AS rows_considered, {_N('adv')} AS aligned, {_N('hit')} AS lookup_hits, {_N('opp')} AS opportunity_rows FROM k GROUP BY 1), z AS (SELECT stratum, coalesce(rows_considered, 0) AS rows_considered, coalesce(aligned, 0) AS aligned, coalesce(lookup_hits, 0) AS lookup_hits, coalesce(opportunity_rows, 0) AS opportunity_rows FROM (VALUES ('shared_wrapper'), ('ad_hoc'), ('unstratified')) v(stratum) LEFT JOIN s USING (stratum)) SELECT *, aligned / nullif(lookup_hits, 0) AS given_match, aligned / nullif(opportunity_rows, 0) AS given_opportunity FROM z",
    "ag15_materialised": f"{_CONSIDERED} SELECT {_KEPT} / nullif({_PROMISED}, 0) AS reuse_token_rate, {_KEPT} AS reuse_tokens, {_PROMISED} AS advertised_tokens, {_N(_MADE)} / nullif(count(audit_advertised_tokens), 0) AS reuse_request_rate, {_N(_MADE)} AS reuse_requests, count(audit_advertised_tokens) AS advertised_requests, coalesce(sum(audit_superseded_tokens), 0)::BIGINT AS superseded_tokens, {_N(_CACHED)} / nullif({_N(chr(116) + 'class = ' + chr(39) + 'propagation_probe' + chr(39))}, 0) AS cached_without_materialization_rate, {_N('tclass = ' + chr(39) + 'propagation_probe' + chr(39))} AS probes, coalesce(sum(audit_blocks_evicted), 0)::BIGINT AS blocks_evicted, {_N('coalesce(audit_blocks_evicted, 0) > 0')} AS rows_evicting FROM k",
    "ag17_presence": f"WITH {ROWS_SQL}, {_STAMPED} SELECT bool_or(arm <> 'cold') AS audit_present, {_N('arm <> ' + chr(39) + 'cold' + chr(39) + ' AND audit_joined')} AS rows_joined, {_N('arm <> ' + chr(39) + 'cold' + chr(39))} AS rows_considered, {_N('arm = ' + chr(39) + 'cold' + chr(39))} AS excluded_cold_arm, 0::BIGINT AS excluded_not_joined FROM stamped",
    "jn06_stamped": f"WITH {ROWS_SQL}, {_STAMPED} SELECT engine_request_id, match, audit_joined, audit_observed_boundary, audit_advertised_tokens, audit_materialized, external_confirmed_tokens, audit_lookup_hit, audit_hit_boundary, audit_miss_reason, audit_decline_event, audit_superseded_tokens, audit_blocks_evicted FROM stamped",
}
