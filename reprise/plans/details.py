"""Queries on the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions import text as T
from reprise.operators import blocks, pairing
from reprise.operators import rows as R
from reprise.operators import signals as S
from reprise.operators.ordinals import running_sum
from reprise.plans import metrics as M
from reprise.plans import runs, views
from reprise.plans.metrics import _ARM, _FIRST, _PAIRS, ROWS_SQL
from reprise.plans.text import sql_token_ids
from reprise.plans.views import ITEMS_SQL, REQUESTS_SQL


def _arms(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rows of both arms with the columns named only: a first or last row carries all of its columns."""
    return M.rows(spark, sf_dir).where("arm IN ('cold', 'warm')").select("item_id", "arm", "ordinal", *columns)


def wf01_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.first_rows(_arms(spark, sf_dir, "engine_request_id")).drop("ordinal")


def wf02_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.last_rows(_arms(spark, sf_dir, "engine_request_id")).drop("ordinal")


def jn02_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.join_arms(_arms(spark, sf_dir, *pairing.FINGERPRINT)).where("status IN ('only_cold', 'only_warm')")


def jn03_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose first rows of the arms differ in their fingerprint, and in what of it."""
    both = pairing.sides(pairing.first_rows(_arms(spark, sf_dir, *pairing.FINGERPRINT)).drop("ordinal"), "inner")
    differing = F.filter(F.array(*(F.when(~F.col(f"cold.{c}").eqNullSafe(F.col(f"warm.{c}")), c) for c in pairing.FINGERPRINT)), lambda x: x.isNotNull())
    return both.select("item_id", F.array_join(differing, ",").alias("differing")).where("differing <> ''")


def jn12_reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.rows(spark, sf_dir)
    probes = pairing.last_rows(r.where("arm = 'warm' AND traffic_class = 'reworded_doc'").select("item_id", "arm", "ordinal", "stream_position"))
    return R.reference_answers(probes, R.references(r))


def jn13_reference_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset, whether any item of the warm arm was answered outside it too."""
    r = M.rows(spark, sf_dir).select("dataset", "item_id", "arm").distinct()
    out = r.where("arm <> 'warm'").select("item_id").distinct().withColumn("k", F.lit(1))
    return r.where("arm = 'warm'").join(out, "item_id", "left").groupBy("dataset").agg((F.count("k") > 0).alias("overlaps"))


def jn15_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each item, a column per arm."""
    return M.rows(spark, sf_dir).groupBy("item_id").pivot("arm", ["cold", "single", "warm"]).agg(F.count("engine_request_id")).na.fill(0)


def jn20_prompt_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each recipient's runs of sixteen words that stand in each of its donors."""
    donors = views.items(spark, sf_dir).select("item_id", "recipient_prompt", F.posexplode("donor_prompts").alias("donor_no", "d"))
    words = donors.select("item_id", "donor_no", R.split_words(F.coalesce("d.text", F.lit(""))).alias("a"), R.split_words(F.col("recipient_prompt")).alias("b"))
    i = words.select("item_id", "donor_no", R.word_runs(F.col("a")).alias("a"), R.word_runs(F.col("b")).alias("b"))
    return i.select("item_id", "donor_no", R.overlap_ratio(F.col("a"), F.col("b")).alias("overlap"))


def wf13_donor_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places between an item and the latest earlier one of its source."""
    n = runs.jn16_nearest_donor(spark, sf_dir)
    return n.groupBy((F.col("position") - F.col("stage_position")).alias("gap")).agg(F.count("*").alias("n"))


def _same_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of tokens that stand at the same place of an item's recipient and a donor, donor by donor."""
    donors = views.items(spark, sf_dir).select("item_id", "recipient_prompt", F.posexplode("donor_prompts").alias("donor_no", "d"))
    i = donors.select("item_id", "donor_no", T.token_ids(F.col("recipient_prompt")).alias("a"), T.token_ids(F.col("d.text")).alias("b"), "d.donor_id")
    at = i.select("item_id", "donor_no", "donor_id", F.posexplode(F.zip_with("a", "b", lambda x, y: x == y)).alias("pos", "same")).where("same")
    return at.select("item_id", F.struct("donor_no", "pos").alias("ordinal"), F.col("pos").alias("target_pos"), F.col("pos").alias("donor_pos"), "donor_id")


def mf02_eligible_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.eligible_blocks(_same_places(spark, sf_dir))


def prj11_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = M.rows(spark, sf_dir).where("arm = 'cold'")
    return r.groupBy(R.cold_contaminated(F.col("backend_confirmed_tokens")).alias("contaminated")).agg(F.count("*").alias("n"))


def prj13_pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pairing.sides(pairing.first_rows(_arms(spark, sf_dir, "error", "backend_confirmed_tokens")).drop("ordinal"), "inner")
    kind = R.pair_class(F.col("cold.error"), F.col("warm.error"), F.col("cold.backend_confirmed_tokens"), F.col("warm.backend_confirmed_tokens"))
    return both.groupBy(kind.alias("pair_class")).agg(F.count("*").alias("n"))


def prj16_service_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that both arms took for an item, unmeasured ones counting as none."""
    s = pairing.sides(pairing.first_rows(views.arm_rows(spark, sf_dir, "latency_ms").select("item_id", "arm", "ordinal", "latency_ms")).drop("ordinal"), "inner")
    return s.select("item_id", R.service_ms(F.array("cold.latency_ms", "warm.latency_ms")).alias("service_ms"))


def prj20_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reprise.operators.workload import domain

    return views.sources(spark, sf_dir).groupBy(domain().alias("domain")).agg(F.count("*").alias("n"))


def ag22_queue_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue time per request of each arm out of two counters; null where nothing was counted."""
    r = M.rows(spark, sf_dir).groupBy("arm").agg(F.sum("queue_time_ms").alias("ms_sum"), F.count("queue_time_ms").alias("n"))
    return r.select("arm", "n", S.rate(F.col("ms_sum"), F.col("n")).alias("ms_per_request"))


def ag24_divergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean divergence, pairs, and the upper median of the first place that differs."""
    kl = runs.mf03_divergence(spark, sf_dir).agg(F.count("*").alias("n_pairs"), F.round(F.avg("kl"), 6).alias("mean_kl"))
    at = runs.mf04_first_divergence(spark, sf_dir).where("first_divergence IS NOT NULL").groupBy(F.col("first_divergence").alias("d")).agg(F.count("*").alias("c"))
    upto = running_sum(at, "d", "c", "upto")
    n = at.agg(F.sum("c").alias("m"))
    median = upto.join(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("m") / 2)).agg(F.min("d").alias("median_first_divergence"))
    return kl.join(F.broadcast(median))  # a row each


def ag42_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warm arm's metrics against thresholds."""
    warm = M.ag01_per_arm(spark, sf_dir).where("arm = 'warm'")
    return R.check(warm, {"quality_pass_rate": (">=", 0.6), "semantic_placement_rate": (">=", 0.9), "backend_confirmed_block_rate": (">=", 0.0), "negative_control_confirmed_rate": ("<=", 0.05)})


def so02_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of either sources or items, each once."""
    return views.sources(spark, sf_dir).select("dataset").union(views.items(spark, sf_dir).select("dataset")).distinct()


def mf08_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.items(spark, sf_dir).groupBy("transform").agg(F.count("*").alias("n"))
    return n.select("transform", R.settle_seconds(F.col("n"), F.lit(250), F.lit(4)).alias("settle_s"))


_SIDES = f"WITH {ROWS_SQL}, firsts AS (SELECT DISTINCT ON (item_id, arm) * FROM rows_ WHERE arm IN ('cold', 'warm') ORDER BY item_id, arm, started_at, engine_request_id), c AS (SELECT * FROM firsts WHERE arm = 'cold'), w AS (SELECT * FROM firsts WHERE arm = 'warm')"
_RUNS = "CASE WHEN len({w}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len({w}) - 15, 1) + 1), lambda i: array_to_string({w}[i : i + 15], ' '))) END"
_WORDS = r"list_filter(regexp_split_to_array({x}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"
_DONORS = f"{ITEMS_SQL}, donors AS (SELECT item_id, recipient_prompt, generate_subscripts(donor_prompts, 1)::INT - 1 AS donor_no, unnest(donor_prompts) AS d FROM items)"
QUERIES = {
    f.__name__: f
    for f in (wf01_first_rows, wf02_last_rows, jn02_one_sided, jn03_mismatches, jn12_reference_answers, jn13_reference_overlap, jn15_outcomes, jn20_prompt_overlap, wf13_donor_gaps, mf02_eligible_blocks, prj11_contaminated, prj13_pair_classes, prj16_service_time, prj20_domains, ag22_queue_per_request, ag24_divergence_summary, ag42_checks, so02_names, mf08_settle)
}
ORACLES = {
    "wf01_first_rows": f"{_SIDES} SELECT item_id, arm, engine_request_id FROM firsts",
    "wf02_last_rows": f"{_PAIRS} SELECT item_id, arm, engine_request_id FROM lasts",
    "jn02_one_sided": f"{_FIRST} SELECT * FROM j WHERE status IN ('only_cold', 'only_warm')",
    "jn03_mismatches": f"{_SIDES}, m AS (SELECT c.item_id, concat_ws(',', {', '.join(f'CASE WHEN c.{x} IS DISTINCT FROM w.{x} THEN {chr(39)}{x}{chr(39)} END' for x in pairing.FINGERPRINT)}) AS differing FROM c JOIN w ON c.item_id = w.item_id) SELECT * FROM m WHERE differing <> ''",
    "jn12_reference_answers": f"""WITH {ROWS_SQL}, p AS (SELECT DISTINCT ON (item_id) item_id, stream_position AS p FROM rows_ WHERE arm = 'warm' AND traffic_class = 'reworded_doc' ORDER BY item_id, started_at DESC, engine_request_id DESC),
      r AS (SELECT DISTINCT ON (item_id) item_id, stream_position, output_text FROM rows_ WHERE arm <> 'warm' ORDER BY item_id, started_at, engine_request_id), s AS (SELECT p.item_id, CASE WHEN r.item_id IS NULL THEN 'missing' WHEN p <> stream_position THEN 'moved' WHEN coalesce(output_text, '') = '' THEN 'empty' ELSE 'answered' END AS status, output_text FROM p LEFT JOIN r ON p.item_id = r.item_id)
      SELECT item_id, status, CASE WHEN status = 'answered' THEN output_text END AS answer FROM s""",
    "jn13_reference_overlap": f"WITH {ROWS_SQL} SELECT dataset, bool_or(item_id IN (SELECT item_id FROM rows_ WHERE arm <> 'warm')) AS overlaps FROM rows_ WHERE arm = 'warm' GROUP BY 1",
    "jn15_outcomes": f"WITH {ROWS_SQL} SELECT item_id, count(*) FILTER (WHERE arm = 'cold') AS cold, count(*) FILTER (WHERE arm = 'single') AS single, count(*) FILTER (WHERE arm = 'warm') AS warm FROM rows_ GROUP BY 1",
    "jn20_prompt_overlap": f"WITH {_DONORS}, w AS (SELECT item_id, donor_no, {_WORDS.format(x='coalesce(d.text, ' + chr(39) * 2 + ')')} AS x, {_WORDS.format(x='recipient_prompt')} AS y FROM donors), r AS (SELECT item_id, donor_no, {_RUNS.format(w='x')} AS a, {_RUNS.format(w='y')} AS b FROM w) SELECT item_id, donor_no, CASE WHEN len(b) = 0 THEN 1.0 ELSE len(list_intersect(b, a)) / len(b) END AS overlap FROM r",
    "wf13_donor_gaps": f"WITH {ITEMS_SQL}, i AS (SELECT source_id, (metadata::JSON ->> '$.stream_position')::BIGINT AS p FROM items), n AS (SELECT a.p - b.p AS gap FROM i a ASOF JOIN i b ON a.source_id = b.source_id AND a.p > b.p) SELECT gap, count(*) AS n FROM n GROUP BY 1",
    "mf02_eligible_blocks": f"WITH {_DONORS}, t AS (SELECT item_id, donor_no, {sql_token_ids('recipient_prompt')} AS a, {sql_token_ids('d.text')} AS b FROM donors), p AS (SELECT item_id, donor_no, unnest(range(0, least(len(a), len(b)))) AS i, a, b FROM t), m AS (SELECT item_id, i, max(donor_no) AS k FROM p WHERE a[i + 1] = b[i + 1] GROUP BY ALL), g AS (SELECT item_id, i // 16 AS block_no, count(*) AS n, count(DISTINCT k) AS d FROM m GROUP BY ALL) SELECT item_id, count(*) FILTER (WHERE n = 16 AND d = 1) AS eligible_blocks FROM g GROUP BY 1",
    "prj11_contaminated": f"WITH {ROWS_SQL} SELECT backend_confirmed_tokens > 16 AS contaminated, count(*) AS n FROM rows_ WHERE arm = 'cold' GROUP BY 1",
    "prj13_pair_classes": f"{_SIDES} SELECT CASE WHEN coalesce(c.error, '') <> '' OR coalesce(w.error, '') <> '' THEN 'errored' WHEN coalesce(c.backend_confirmed_tokens, 0) > 16 OR coalesce(w.backend_confirmed_tokens, 0) > 16 THEN 'contaminated' ELSE 'usable' END AS pair_class, count(*) AS n FROM c JOIN w ON c.item_id = w.item_id GROUP BY 1",
    "prj16_service_time": f"{_SIDES} SELECT c.item_id, coalesce(c.latency_ms, 0) + coalesce(w.latency_ms, 0) AS service_ms FROM c JOIN w ON c.item_id = w.item_id",
    "prj20_domains": "WITH sources AS (SELECT DISTINCT ON (source_id) * FROM source_records) SELECT coalesce(nullif(metadata['domain'], ''), dataset) AS domain, count(*) AS n FROM sources GROUP BY 1",
    "ag22_queue_per_request": f"WITH {REQUESTS_SQL} SELECT arm, count(queue_time_ms) AS n, sum(queue_time_ms) / nullif(count(queue_time_ms), 0) AS ms_per_request FROM requests GROUP BY 1",
    "ag24_divergence_summary": f"WITH k AS ({runs.ORACLES['mf03_divergence']}), d AS ({runs.ORACLES['mf04_first_divergence']}), s AS (SELECT first_divergence AS d, row_number() OVER (ORDER BY first_divergence) - 1 AS r, count(*) OVER () AS m FROM d WHERE first_divergence IS NOT NULL) SELECT count(*) AS n_pairs, round(avg(kl), 6) AS mean_kl, (SELECT d FROM s WHERE r = m // 2) AS median_first_divergence FROM k",
    "ag42_checks": f"WITH a AS ({_ARM.format(key='arm', group='arm')}), w AS (SELECT * FROM a WHERE arm = 'warm'), v AS (SELECT 'quality_pass_rate' AS metric, quality_pass_rate AS value, '>=' AS relation, 0.6::DOUBLE AS bound FROM w UNION ALL SELECT 'semantic_placement_rate', semantic_placement_rate, '>=', 0.9 FROM w UNION ALL SELECT 'backend_confirmed_block_rate', backend_confirmed_block_rate, '>=', 0.0 FROM w UNION ALL SELECT 'negative_control_confirmed_rate', negative_control_confirmed_rate, '<=', 0.05 FROM w) SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN (relation = '>=' AND value >= bound) OR (relation = '<=' AND value <= bound) THEN 'passed' ELSE 'failed' END AS status FROM v",
    "so02_names": "SELECT dataset FROM source_records UNION SELECT dataset FROM workload_items",
    "mf08_settle": f"WITH {ITEMS_SQL} SELECT transform, count(*) * 250 / 1000 / 4 AS settle_s FROM items GROUP BY 1",
}
