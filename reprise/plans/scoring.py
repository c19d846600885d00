"""Queries on rows out of responses, scores, names and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions import text as T
from reprise.operators import logs, metrics
from reprise.operators import scoring as R
from reprise.plans import metrics as M
from reprise.plans import runs, text, views
from reprise.plans.metrics import _CONSIDERED, _N, _PAIRS, _STAMPED, ROWS_SQL
from reprise.plans.views import ITEMS_SQL, REQUESTS_SQL

ARMS = [("A0", "cold"), ("A1", "warm"), ("A2", "single"), ("A3", "warm w3"), ("A4", "single w1")]


def _choice() -> F.Column:
    return R.is_multiple_choice(F.get_json_object("metadata", "$.traffic_class"), F.get_json_object("metadata", "$.expected_answer_letter"))


def prj14_multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by whether they are multiple-choice ones."""
    return views.items(spark, sf_dir).groupBy(_choice().alias("choice")).agg(F.count("*").alias("n_items"))


def prj15_response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's facts out of its response and item."""
    items = views.items(spark, sf_dir).select("item_id", "answers", _choice().alias("choice"))
    r = views.requests(spark, sf_dir, "item_id", "output_text", "backend_confirmed_tokens", "exact_hit_blocks").withColumnRenamed("backend_confirmed_tokens", "cached_tokens")
    made = R.response_row(r.join(items, "item_id"))
    return made.select("engine_request_id", "backend_confirmed_tokens", "backend_confirmed_blocks", "exact_hit_tokens", F.length("output_text").alias("n_chars"), F.round("quality_score", 6).alias("quality_score"), "quality_pass")


def prj19_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.items(spark, sf_dir).select(R.named_in(F.col("metadata"), ("template", "wrapper_id"), "default").alias("template"), R.named_in(F.col("metadata"), ("tenant", "tenant_id"), "public").alias("tenant"))
    return named.groupBy("template", "tenant").agg(F.count("*").alias("n_items"))


def sf14_letter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.items(spark, sf_dir).select("item_id", F.array(F.substring(F.coalesce(F.col("transform"), F.lit("")), 1, 1), F.lit(" a "), F.lit(None).cast("string")).alias("answers"))
    r = views.requests(spark, sf_dir, "item_id", "output_text").join(items, "item_id")
    return r.groupBy(R.letter_match(F.col("output_text"), F.col("answers")).alias("score")).agg(F.count("*").alias("n"))


def ag07_quality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of each arm's outputs; null where nothing was scored."""
    r = views.requests(spark, sf_dir, "item_id", "arm", "output_text").where("output_text IS NOT NULL").select("item_id", "arm", F.md5("output_text").alias("output"))
    f1 = text.sf12_token_f1(spark, sf_dir).select("item_id", "output", F.col("score").alias("f1"))
    rouge = text.sf13_rouge_l(spark, sf_dir).select("item_id", "output", F.col("score").alias("rouge_l"))
    both = r.join(f1, ["item_id", "output"], "left").join(rouge, ["item_id", "output"], "left")
    return both.groupBy("arm").agg(F.round(F.avg("f1"), 6).alias("mean_quality_f1"), F.round(F.avg("rouge_l"), 6).alias("mean_quality_rouge_l"), F.count("f1").alias("n_scored"))


def ag10_opportunity_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment over the opportunities that the manifest holds and over those that were run."""
    return R.opportunity_rates(M.ag10_alignment(spark, sf_dir), M.ag18_class_counts(spark, sf_dir))


def ag14_target_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("donor_count") == 1, F.col("semantic_eligible_tokens"))
    return R.target_start_agreement(metrics.considered(M._stamped(spark, sf_dir)).withColumn("expected_span_target_start", expected))


def ag27_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each arm's external tokens come from."""
    label = F.when(F.col("audit_materialized"), "connector_audit").when(F.col("external_confirmed_tokens").isNotNull(), "usage")
    return R.source_labels(M._stamped(spark, sf_dir).withColumn("external_confirmed_tokens_source", label), ["arm"]).withColumn("sources", F.array_join("sources", ","))


def mf07_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.jn04_clean_pairs(spark, sf_dir)
    return p.select("item_id", R.paired_ratio(F.col("cold_ms"), F.col("warm_ms")).alias("ratio"))


def wf08_settle_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that each later request of an item in a run would still have to wait for the first to settle."""
    t = runs._timed(spark, sf_dir).withColumn("end_s", F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")))
    first = t.groupBy("run_id", "item_id").agg(F.min(F.struct("start_s", "id", "end_s")).alias("first"))
    later = t.join(first, ["run_id", "item_id"]).where(F.col("id") != F.col("first.id"))
    return later.select("id", F.round(R.settle_remaining(F.col("first.end_s"), F.col("start_s"), F.lit(3600)), 3).alias("settle_s"))


def jn19_pairs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which not both arms have been run."""
    return R.both_arms_left(views.items(spark, sf_dir).select("item_id"), views.requests(spark, sf_dir, "item_id", "arm"))


def sf21_arm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the arm that a declaration of arm and worker names."""
    declared = F.concat(F.lit("Run "), F.upper("arm"), F.lit(" "), F.regexp_replace("worker_id", "^.*?(w?[0-9]+)$", "$1"))
    return views.requests(spark, sf_dir, "arm", "worker_id").groupBy(R.arm_named(declared, ARMS).alias("arm_id")).agg(F.count("*").alias("n"))


def src21_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = views.requests(spark, sf_dir, "worker_id", "arm", "started_at").select(F.concat(F.lit("http://"), "worker_id", F.when(F.col("arm") == "cold", "/").when(F.col("arm") == "warm", "/metrics/").otherwise("")).alias("u"), "started_at")
    return R.endpoints(urls.where("u IS NOT NULL"), "u", "started_at")


def src23_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a served name is that of a dataset, written in other ways."""
    d = views.items(spark, sf_dir).select("dataset", F.concat(F.lit("org/"), F.upper("dataset"), F.lit("/")).alias("served")).distinct()
    return d.select("dataset", R.model_matches(F.col("served"), F.col("dataset")).alias("same"), R.model_matches(F.concat("dataset", F.lit("-v2")), F.col("dataset")).alias("longer"), R.model_matches(F.lit("org/other"), F.col("dataset")).alias("other"))


def _lines(spark: SparkSession, sf_dir: str, *lines: F.Column) -> DataFrame:
    return M.rows(spark, sf_dir).select("arm", F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line"))


def ag31_fuzzy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    made = _lines(
        spark, sf_dir,
        F.concat(F.lit("[FUZZY] register_donor_async: ok request_id="), "engine_request_id", F.lit(" tokens="), n("prompt_tokens")),
        F.when(F.col("semantic_eligible_tokens") > 0, F.concat(F.lit("[FUZZY] Realized "), n("semantic_eligible_tokens"), F.lit(" fuzzy tokens"))),
        F.when(F.col("error").isNotNull(), F.lit("Shape mismatch attempting to re-use buffer")),
    )
    return logs.log_summary(made, "fuzzy", ["arm"]).select("arm", "donor_registered_events", "donor_registered_tokens", "materialized_events", "materialized_tokens", "errors", "warnings")


def ag31_exact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    made = _lines(spark, sf_dir, F.concat(F.lit("Stored "), n("prompt_tokens"), F.lit(" out of total "), n("prompt_tokens"), F.lit(" tokens")), F.when(F.col("exact_hit_tokens") > 0, F.concat(F.lit("Retrieved "), n("exact_hit_tokens"), F.lit(" out of total "), n("prompt_tokens"), F.lit(" tokens"))))
    return logs.log_summary(made, "exact", ["arm"]).select("arm", "stored_events", "stored_tokens", "materialized_events", "materialized_tokens", "errors")


def ag31_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.rows(spark, sf_dir)
    event = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    made = F.array(
        event(event=F.lit("donor_registered")),
        event(event=F.lit("lookup"), found=F.col("planner_found"), rejection_reason=F.when(~F.col("planner_found"), "no_donor_match")),
        F.when(F.col("semantic_eligible_tokens") > 0, event(event=F.lit("materialized"), materialized=F.col("semantic_eligible_tokens"), requires_rope_correction=F.col("wrapper_rank") > 2)),
        F.when(F.col("error").isNotNull(), F.lit("{broken")),
    )
    return logs.decision_summary(r.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("line")))


QUERIES = {
    f.__name__: f
    for f in (prj14_multiple_choice, prj15_response_rows, prj19_templates, sf14_letter_match, ag07_quality_means, ag10_opportunity_rates, ag14_target_starts, ag27_sources, mf07_ratios, wf08_settle_remaining, jn19_pairs_left, sf21_arm_names, src21_endpoints, src23_models, ag31_fuzzy_log, ag31_exact_log, ag31_decision_log)
}
_META = "metadata::JSON ->> '$.{}'".format
_CHOICE = f"coalesce({_META('traffic_class')} = 'longbench_v2_mc', false) OR ({_META('expected_answer_letter')}) IS NOT NULL"
_TIMED = runs._T
_SUM = "coalesce(sum({}) FILTER (WHERE {}), 0)::BIGINT".format
ORACLES = {
    "prj14_multiple_choice": f"WITH {ITEMS_SQL} SELECT {_CHOICE} AS choice, count(*) AS n_items FROM items GROUP BY 1",
    "prj15_response_rows": f"""{text._SQL_SCORED}, r AS ({text.ORACLES['sf11_answer_recall']})
      SELECT engine_request_id, backend_confirmed_tokens, backend_confirmed_tokens // 16 AS backend_confirmed_blocks, exact_hit_blocks * 16 AS exact_hit_tokens, length(substr(coalesce(output_text, ''), 1, 2000))::INT AS n_chars,
        CASE WHEN output_text IS NULL THEN CASE WHEN len(answers) > 0 THEN 0.0 END ELSE score END AS quality_score, CASE WHEN output_text IS NULL THEN CASE WHEN len(answers) > 0 THEN false END ELSE score >= 0.6 END AS quality_pass
      FROM requests q JOIN items i USING (item_id) LEFT JOIN r ON r.item_id = q.item_id AND r.output = md5(q.output_text)""",
    "prj19_templates": f"WITH {ITEMS_SQL} SELECT coalesce(nullif({_META('template')}, ''), nullif({_META('wrapper_id')}, ''), 'default') AS template, coalesce(nullif({_META('tenant')}, ''), nullif({_META('tenant_id')}, ''), 'public') AS tenant, count(*) AS n_items FROM items GROUP BY ALL",
    "sf14_letter_match": f"WITH {REQUESTS_SQL}, {ITEMS_SQL}, l AS (SELECT {text._LETTER} AS letter, upper(substr(coalesce(i.transform, ''), 1, 1)) AS t FROM (SELECT item_id, coalesce(output_text, '') AS output_text FROM requests) JOIN items i USING (item_id)) SELECT CASE WHEN letter IN (t, 'A') THEN 1.0 ELSE 0.0 END AS score, count(*) AS n FROM l GROUP BY 1",
    "ag07_quality_means": f"WITH {REQUESTS_SQL}, f AS ({text.ORACLES['sf12_token_f1']}), l AS ({text.ORACLES['sf13_rouge_l']}) SELECT arm, round(avg(f.score), 6) AS mean_quality_f1, round(avg(l.score), 6) AS mean_quality_rouge_l, count(f.score) AS n_scored FROM requests r LEFT JOIN f ON f.item_id = r.item_id AND f.output = md5(r.output_text) LEFT JOIN l ON l.item_id = r.item_id AND l.output = md5(r.output_text) WHERE output_text IS NOT NULL GROUP BY 1",
    "ag10_opportunity_rates": f"WITH a AS ({M.ORACLES['ag10_alignment']}), n AS (SELECT coalesce(sum(n_items) FILTER (WHERE traffic_class IN ('same_doc_new_instruction', 'revised_doc')), 0)::BIGINT AS d FROM ({M.ORACLES['ag18_class_counts']})) SELECT aligned / nullif(d, 0) AS given_opportunity, (aligned - aligned_outside_classes) / nullif(d, 0) AS given_opportunity_in_class, d AS denominator, 'manifest' AS denominator_source, aligned / nullif(opportunity_rows, 0) AS given_opportunity_rows_present, opportunity_rows AS rows_present_denominator, aligned / nullif(d, 0) AS boundary_alignment_rate FROM a, n",
    "ag14_target_starts": f"{_CONSIDERED}, s AS (SELECT CASE WHEN donor_count = 1 THEN semantic_eligible_tokens END AS e, audit_advertised_target_start AS a, audit_joined FROM k) SELECT CASE WHEN bool_or(audit_joined) THEN {_N('e = a')} / nullif({_N('e IS NOT NULL AND a IS NOT NULL')}, 0) END AS agreement, CASE WHEN bool_or(audit_joined) THEN {_N('e = a')} END AS agreed, {_N('e IS NOT NULL AND a IS NOT NULL')} AS claims FROM s",
    "ag27_sources": f"WITH {ROWS_SQL}, {_STAMPED}, s AS (SELECT arm, CASE WHEN audit_materialized THEN 'connector_audit' WHEN external_confirmed_tokens IS NOT NULL THEN 'usage' END AS l FROM stamped) SELECT arm, coalesce(string_agg(DISTINCT l, ',' ORDER BY l), '') AS sources, bool_and(l = 'connector_audit') AS per_request FROM s GROUP BY 1",
    "mf07_ratios": f"{_PAIRS} SELECT item_id, cold_ms / ttft_ms AS ratio FROM flat WHERE timed",
    "wf08_settle_remaining": f"{_TIMED}, e AS (SELECT run_id, item_id, id, start_s, CASE WHEN end_s > start_s THEN end_s END AS end_s FROM t), f AS (SELECT DISTINCT ON (run_id, item_id) run_id, item_id, id AS first_id, end_s AS finished FROM e ORDER BY run_id, item_id, start_s, id) SELECT id, round(CASE WHEN finished IS NULL THEN 3600 ELSE greatest(0, 3600 - (start_s - finished)) END, 3) AS settle_s FROM e JOIN f USING (run_id, item_id) WHERE id <> first_id",
    "jn19_pairs_left": f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM request_metrics WHERE arm IN ('cold', 'warm') GROUP BY 1 HAVING count(DISTINCT arm) = 2)",
    "sf21_arm_names": f"WITH {REQUESTS_SQL}, d AS (SELECT lower('Run ' || upper(arm) || ' ' || regexp_replace(worker_id, '^.*?(w?[0-9]+)$', '\\1')) AS d FROM requests) SELECT CASE WHEN regexp_matches(d, '(^|[^a-z0-9])single w1($|[^a-z0-9])') THEN 'A4' WHEN regexp_matches(d, '(^|[^a-z0-9])warm w3($|[^a-z0-9])') THEN 'A3' WHEN d LIKE '%single%' THEN 'A2' WHEN d LIKE '%cold%' THEN 'A0' WHEN d LIKE '%warm%' THEN 'A1' ELSE '' END AS arm_id, count(*) AS n FROM d GROUP BY 1",
    "src21_endpoints": f"WITH {REQUESTS_SQL} SELECT 'http://' || worker_id || '/metrics' AS url, min(started_at) AS started_at FROM requests WHERE worker_id IS NOT NULL GROUP BY 1",
    "src23_models": f"WITH {ITEMS_SQL} SELECT DISTINCT dataset, true AS same, true AS longer, false AS other FROM items",
    "ag31_fuzzy_log": f"WITH {ROWS_SQL} SELECT arm, count(prompt_tokens) AS donor_registered_events, sum(prompt_tokens)::BIGINT AS donor_registered_tokens, {_N('semantic_eligible_tokens > 0')} AS materialized_events, {_SUM('semantic_eligible_tokens', 'semantic_eligible_tokens > 0')} AS materialized_tokens, 0::BIGINT AS errors, count(error) AS warnings FROM rows_ GROUP BY 1",
    "ag31_exact_log": f"WITH {ROWS_SQL} SELECT arm, count(prompt_tokens) AS stored_events, sum(prompt_tokens)::BIGINT AS stored_tokens, {_N('exact_hit_tokens > 0')} AS materialized_events, {_SUM('exact_hit_tokens', 'exact_hit_tokens > 0')} AS materialized_tokens, 0::BIGINT AS errors FROM rows_ GROUP BY 1",
    "ag31_decision_log": f"WITH {ROWS_SQL} SELECT count(*) AS donor_registrations, {_N('planner_found')} AS semantic_hits, {_N('semantic_eligible_tokens > 0')} AS materialization_events, {_SUM('semantic_eligible_tokens', 'semantic_eligible_tokens > 0')} AS materialized_units, {_N('semantic_eligible_tokens > 0 AND wrapper_rank > 2')} AS rope_corrections, 0::BIGINT AS engine_boundaries, {_N('NOT planner_found')} AS rejections, count(error) AS errors, 0::BIGINT AS warnings FROM rows_",
}
