"""Queries on logs, counters, timelines, statistics and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions import stats
from reprise.functions import text as T
from reprise.functions.selection import exact_percentiles
from reprise.operators import logs, pairing, timeline
from reprise.plans import metrics as M
from reprise.plans import views
from reprise.plans.metrics import _PAIRS, ROWS_SQL
from reprise.plans.text import sql_token_ids
from reprise.plans.views import ITEMS_SQL, REQUESTS_SQL, SOURCES_SQL
from reprise.session import table


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a connector would have written about the requests."""
    r = M.rows(spark, sf_dir)
    line = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    rid, donor = F.col("engine_request_id"), F.lit("d0")
    made = F.array(
        line("INFO donor registered request_id=", rid, " namespace=", F.col("dataset"), " tokens=", F.col("prompt_tokens").cast("string"), " blocks=", F.col("total_blocks").cast("string")),
        F.when(F.col("planner_found"), line("INFO semantic lookup hit request_id=", rid, " donor_id=", donor, " similarity=0.9 kind=span reusable_tokens=", F.col("semantic_candidate_tokens").cast("string"), " reason=near")),
        F.when(F.col("external_confirmed_tokens") > 0, line("INFO materialized request_id=", rid, " donor_id=", donor, " tokens=", F.col("external_confirmed_tokens").cast("string"))),
        F.when(F.col("error").isNotNull(), line("ERROR ", F.col("error"))),
    )
    return r.select("arm", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("line"))


def ag31_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.log_summary(_log_lines(spark, sf_dir), "connector", ["arm"])


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter pages of the workers, as text."""
    r = views.requests(spark, sf_dir, "worker_id", "arm", "total_blocks", "exact_hit_blocks").groupBy("worker_id", "arm").agg(F.sum("total_blocks").alias("q"), F.sum("exact_hit_blocks").alias("h"))
    text = lambda name, v: F.concat(F.lit(name + '{worker="'), "worker_id", F.lit('",note="a \\"b\\"",arm="'), "arm", F.lit('"} '), F.col(v).cast("string"), F.lit(" 1700000000"))
    return r.select("worker_id", F.explode(F.array(F.lit("# TYPE cache:queries counter"), text("cache:queries_total", "q"), text("cache:hits", "h"), F.lit("not a sample"))).alias("line"))


def src06_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.samples(_pages(spark, sf_dir))
    return s.select("name", F.col("labels")["worker"].alias("worker"), F.col("labels")["arm"].alias("arm"), F.col("labels")["note"].alias("note"), "value")


def ag32_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.samples(_pages(spark, sf_dir))
    return s.groupBy("worker_id").agg(logs.counter("cache:queries").alias("queries"), logs.counter("cache:hits").alias("hits"), logs.counter("cache:hits", arm="warm").alias("warm_hits"), logs.counter("cache:none").alias("absent"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots per worker: of the requests before the middle of March, and of all. Some fail, some restarted."""
    r = views.requests(spark, sf_dir, "worker_id", "total_blocks", "exact_hit_blocks", "started_at")
    fold = lambda x: x.groupBy(F.col("worker_id").alias("url")).agg(F.sum("total_blocks").cast("double").alias("queries"), F.sum("exact_hit_blocks").cast("double").alias("hits"))
    before = fold(r.where("started_at < TIMESTAMP '2026-03-15'")).withColumn("error", F.when(F.col("url").endswith("3"), "refused"))
    after = fold(r).withColumn("error", F.lit(None).cast("string")).withColumn("queries", F.when(F.col("url").endswith("7"), 1.0).otherwise(F.col("queries")))
    return before, after


def ag33_counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.counter_deltas(*_snapshots(spark, sf_dir), ["queries", "hits"])


def ag33_fleet_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.fleet_delta(ag33_counter_deltas(spark, sf_dir), "hits", "queries", ["queries", "hits"])


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir, "run_id", "item_id", "started_at", "latency_ms", "error", "prompt_tokens", "ttft_ms")
    start = F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    return r.select("run_id", "item_id", F.col("engine_request_id").alias("id"), start.alias("start_s"), (start + F.coalesce("latency_ms", F.lit(0.0)) / 1000).alias("end_s"), "error", F.col("prompt_tokens").alias("tokens"), "ttft_ms")


def ag40_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = timeline.in_flight(_timed(spark, sf_dir), ["run_id"])
    return f.select("run_id", F.round("wall_s", 3).alias("wall_s"), "most_at_once", F.round("idle_s", 3).alias("idle_s"))


def ag34_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline.throughput(_timed(spark, sf_dir), ["run_id"])
    return t.select("run_id", "requests", "errors", "most_at_once", "wall_s")


def ag34_nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timed(spark, sf_dir).where("ttft_ms IS NOT NULL AND NOT isnan(ttft_ms)")
    return timeline.nearest_rank(t, ["run_id"], "ttft_ms", (50, 90, 99))


def wf07_gap_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of an item within a run, and how many finished requests they are short of five in between."""
    return timeline.gap_shortfall(_timed(spark, sf_dir), ["run_id"], "item_id", 5)


def jn16_nearest_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's latest earlier item of the same source in the stream."""
    i = views.items(spark, sf_dir).select(F.col("item_id").alias("id"), "source_id", F.get_json_object("metadata", "$.stream_position").cast("bigint").alias("position"))
    return timeline.nearest_earlier(i, i, "source_id", "position")


def ag26_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median speedup of clean pairs by mechanism, with a seeded 95 % interval."""
    return stats.bootstrap(M.jn04_clean_pairs(spark, sf_dir).where("NOT control"), ["mechanism"], "ratio", "item_id")


def ag26_poisson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir, "arm", "ttft_ms").where("NOT isnan(ttft_ms)")
    return stats.poisson_mean_interval(r, ["arm"], "ttft_ms", "engine_request_id")


def ag35_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and percentiles of clean pairs' ratios, over all and by length of the prompt."""
    flat = pairing.pairs(M._unaudited(spark, sf_dir).where("arm IN ('cold', 'warm')")).where("status = 'clean'")
    band = F.when(F.col("cold.prompt_tokens") < 300, "short").when(F.col("cold.prompt_tokens") < 900, "middle").otherwise("long")
    s = flat.select(band.alias("band"), (F.col("cold.ttft_ms") / F.col("warm.ttft_ms")).alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    every = s.select(F.explode(F.array("band", F.lit(None).cast("string"))).alias("band"), "x")
    ranks = exact_percentiles(every, "band", "x", {"p05": 0.05, "p50": 0.5}).withColumnRenamed("band", "b").drop("n")
    means = s.rollup("band").agg(F.count("*").alias("n_pairs"), F.avg("x").alias("mean"))
    return means.join(ranks, F.col("band").eqNullSafe(F.col("b"))).drop("b")


def mf03_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every vector's entries, taken for logits of tokens, from the next vector's, one token apart."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    top = lambda shift: F.transform("embedding", lambda v, i: F.struct((i + 1 + shift).cast("bigint").alias("token_id"), v.cast("double").alias("logprob")))
    cold = e.select("vec_id", top(0).alias("cold"))
    warm = e.select((F.col("vec_id") - 1).alias("vec_id"), top(1).alias("warm"))
    return cold.join(warm, "vec_id").select("vec_id", F.round(stats.topk_divergence(F.col("cold"), F.col("warm")), 6).alias("kl"))


def mf04_first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place at which an item's recipient and each of its donors differ, in tokens."""
    donors = views.items(spark, sf_dir).select("item_id", "recipient_prompt", F.posexplode("donor_prompts").alias("donor_no", "d"))
    i = donors.select("item_id", "donor_no", T.token_ids(F.col("recipient_prompt")).alias("a"), T.token_ids(F.col("d.text")).alias("b"))
    return i.select("item_id", "donor_no", stats.first_divergence(F.col("a"), F.col("b")).cast("bigint").alias("first_divergence"))


def so01_prompt_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    d = i.select(F.explode("donor_prompts").alias("d")).select(F.lit("donor").alias("role"), F.length("d.text").cast("bigint").alias("n"))
    return d.unionByName(i.select(F.lit("recipient").alias("role"), F.length("recipient_prompt").cast("bigint").alias("n"))).groupBy("role").agg(F.count("*").alias("n_prompts"), F.sum("n").alias("n_chars"))


def so03_unused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sources(spark, sf_dir).select("source_id").exceptAll(views.items(spark, sf_dir).select("source_id").distinct())


def so04_shared_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sources(spark, sf_dir).select("dataset").intersect(views.items(spark, sf_dir).select("dataset"))


def so05_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All workers of each run, ranked by when they were first seen."""
    from pyspark.sql import Window

    first = views.requests(spark, sf_dir, "run_id", "worker_id", "started_at").groupBy("run_id", "worker_id").agg(F.min("started_at").alias("first_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("first_at", "worker_id")))


_SEC = "epoch_us(started_at) / 1e6"
_T = f"WITH {REQUESTS_SQL}, t AS (SELECT run_id, item_id, engine_request_id AS id, {_SEC} AS start_s, {_SEC} + coalesce(latency_ms, 0) / 1000 AS end_s, error, ttft_ms FROM requests)"
_SWEEP = f"""{_T}, m AS (SELECT run_id, start_s AS t, 1 AS up, 0 AS down FROM t UNION ALL SELECT run_id, end_s, 0, 1 FROM t), b AS (SELECT run_id, t, sum(up) - sum(down) AS d FROM m GROUP BY ALL),
  r AS (SELECT run_id, t, sum(d) OVER (PARTITION BY run_id ORDER BY t) AS n, lead(t) OVER (PARTITION BY run_id ORDER BY t) - t AS gap FROM b),
  f AS (SELECT run_id, max(t) - min(t) AS wall_s, max(n)::BIGINT AS most_at_once, coalesce(sum(gap) FILTER (WHERE n = 0), 0) AS idle_s FROM r GROUP BY 1)"""
_PAGE = f"WITH {REQUESTS_SQL}, c AS (SELECT worker_id, arm, sum(total_blocks)::DOUBLE AS q, sum(exact_hit_blocks)::DOUBLE AS h FROM requests GROUP BY ALL)"
_SNAP = f"""WITH {REQUESTS_SQL}, b AS (SELECT worker_id AS url, sum(total_blocks)::DOUBLE AS queries, sum(exact_hit_blocks)::DOUBLE AS hits, CASE WHEN worker_id LIKE '%3' THEN 'refused' END AS error FROM requests WHERE started_at < TIMESTAMP '2026-03-15' GROUP BY 1),
  a AS (SELECT worker_id AS url, CASE WHEN worker_id LIKE '%7' THEN 1.0 ELSE sum(total_blocks)::DOUBLE END AS queries, sum(exact_hit_blocks)::DOUBLE AS hits FROM requests GROUP BY 1),
  d AS (SELECT coalesce(a.url, b.url) AS url, a.url IS NOT NULL AND b.url IS NOT NULL AND b.error IS NULL AS paired, CASE WHEN b.error IS NULL THEN a.queries - b.queries END AS queries, CASE WHEN b.error IS NULL THEN a.hits - b.hits END AS hits FROM a FULL JOIN b ON a.url = b.url)"""
_RANK = "min(ttft_ms) FILTER (WHERE r = round_even((n - 1) * {p} / 100.0, 0)) AS p{p}"

QUERIES = {
    f.__name__: f
    for f in (ag31_log_summary, src06_samples, ag32_counters, ag33_counter_deltas, ag33_fleet_delta, ag34_throughput, ag34_nearest_ranks, ag40_in_flight, wf07_gap_shortfall, jn16_nearest_donor, ag26_bootstrap, ag26_poisson_interval, ag35_calibration, mf03_divergence, mf04_first_divergence, so01_prompt_union, so03_unused_sources, so04_shared_datasets, so05_first_seen)
}
_N = "count(*) FILTER (WHERE {})".format
_S = "coalesce(sum({0}) FILTER (WHERE {1}), 0)::BIGINT".format
ORACLES = {
    "ag31_log_summary": f"WITH {ROWS_SQL} SELECT arm, count(*) AS donor_registered_events, sum(prompt_tokens)::BIGINT AS donor_registered_tokens, {_N('planner_found')} AS semantic_hit_events, {_S('semantic_candidate_tokens', 'planner_found')} AS semantic_hit_tokens, 0::BIGINT AS advertised_events, 0::BIGINT AS advertised_tokens, 0::BIGINT AS materializing_events, 0::BIGINT AS materializing_tokens, {_N('external_confirmed_tokens > 0')} AS materialized_events, {_S('external_confirmed_tokens', 'external_confirmed_tokens > 0')} AS materialized_tokens, count(error) AS errors, 0::BIGINT AS warnings FROM rows_ GROUP BY 1",
    "src06_samples": f"{_PAGE} SELECT 'cache:queries_total' AS name, worker_id AS worker, arm, 'a \"b\"' AS note, q AS value FROM c UNION ALL SELECT 'cache:hits', worker_id, arm, 'a \"b\"', h FROM c",
    "ag32_counters": f"{_PAGE} SELECT worker_id, sum(q) AS queries, sum(h) AS hits, sum(h) FILTER (WHERE arm = 'warm') AS warm_hits, NULL::DOUBLE AS absent FROM c GROUP BY 1",
    "ag33_counter_deltas": f"{_SNAP} SELECT * FROM d",
    "ag33_fleet_delta": f"{_SNAP} SELECT sum(queries) AS queries, sum(hits) AS hits, {_N('paired')} AS endpoints_paired, {_N('NOT paired')} AS endpoints_failed, coalesce(bool_or(queries < 0 OR hits < 0), false) AS reset, CASE WHEN sum(queries) > 0 THEN sum(hits) / sum(queries) END AS hit_ratio FROM d",
    "ag34_throughput": f"{_SWEEP} SELECT run_id, count(*) AS requests, count(error) AS errors, any_value(most_at_once) AS most_at_once, round_even(any_value(wall_s), 3) AS wall_s FROM t JOIN f USING (run_id) GROUP BY 1",
    "ag34_nearest_ranks": f"{_T}, k AS (SELECT run_id, ttft_ms, row_number() OVER (PARTITION BY run_id ORDER BY ttft_ms) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n FROM t WHERE ttft_ms IS NOT NULL AND NOT isnan(ttft_ms)) SELECT run_id, {', '.join(_RANK.format(p=p) for p in (50, 90, 99))}, avg(ttft_ms) AS mean FROM k GROUP BY 1",
    "ag40_in_flight": f"{_SWEEP} SELECT run_id, round(wall_s, 3) AS wall_s, most_at_once, round(idle_s, 3) AS idle_s FROM f",
    "wf07_gap_shortfall": f"""{_T}, p AS (SELECT a.run_id, a.item_id, a.id, a.start_s, max((b.end_s, b.id)) AS last FROM t a JOIN t b ON a.run_id = b.run_id AND a.item_id = b.item_id AND b.end_s <= a.start_s AND b.end_s > b.start_s AND a.id <> b.id GROUP BY ALL),
      g AS (SELECT p.run_id, p.item_id, p.id, count(*) FILTER (WHERE (t.end_s, t.id) > p.last AND t.end_s <= p.start_s AND t.end_s > t.start_s) AS gap FROM p JOIN t ON p.run_id = t.run_id GROUP BY ALL) SELECT *, greatest(0, 5 - gap) AS shortfall FROM g""",
    "jn16_nearest_donor": f"WITH {ITEMS_SQL}, i AS (SELECT item_id AS id, source_id, (metadata::JSON ->> '$.stream_position')::BIGINT AS position FROM items) SELECT a.id, a.source_id, a.position, b.id AS stage, b.position AS stage_position FROM i a ASOF JOIN i b ON a.source_id = b.source_id AND a.position > b.position",
    "ag35_calibration": f"{_PAIRS}, s AS (SELECT CASE WHEN k.prompt_tokens < 300 THEN 'short' WHEN k.prompt_tokens < 900 THEN 'middle' ELSE 'long' END AS band, ratio AS x FROM clean JOIN c k ON k.item_id = clean.item_id WHERE ratio IS NOT NULL AND NOT isnan(ratio)) SELECT band, count(*) AS n_pairs, avg(x) AS mean, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS p50 FROM s GROUP BY ROLLUP (band)",
    "mf03_divergence": """WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
      u AS (SELECT vec_id, list_append(list_transform(x, lambda v: exp(v::DOUBLE)), exp(list_min(x)::DOUBLE - 1)) AS p, list_prepend(exp(list_min(y)::DOUBLE - 1), list_transform(y, lambda v: exp(v::DOUBLE))) AS q FROM p),
      z AS (SELECT vec_id, list_transform(p, lambda v: v / list_sum(p)) AS p, list_transform(q, lambda v: v / list_sum(q)) AS q FROM u) SELECT vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * ln(p[i] / q[i]))), 6) AS kl FROM z""",
    "so01_prompt_union": f"WITH {ITEMS_SQL}, d AS (SELECT unnest(donor_prompts) AS d FROM items) SELECT 'donor' AS role, count(*) AS n_prompts, sum(length(d.text))::BIGINT AS n_chars FROM d UNION ALL SELECT 'recipient', count(*), sum(length(recipient_prompt))::BIGINT FROM items",
    "so03_unused_sources": f"WITH {SOURCES_SQL} SELECT source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM workload_items)",
    "so04_shared_datasets": "SELECT dataset FROM source_records INTERSECT SELECT dataset FROM workload_items",
    "so05_first_seen": f"WITH {REQUESTS_SQL}, f AS (SELECT run_id, worker_id, min(started_at) AS first_at FROM requests GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_at, worker_id) AS rank FROM f",
}
ORACLES["mf04_first_divergence"] = f"WITH {ITEMS_SQL}, donors AS (SELECT item_id, recipient_prompt, generate_subscripts(donor_prompts, 1)::INT - 1 AS donor_no, unnest(donor_prompts) AS d FROM items), i AS (SELECT item_id, donor_no, {sql_token_ids('recipient_prompt')} AS a, {sql_token_ids('d.text')} AS b FROM donors) SELECT item_id, donor_no, list_min(list_filter(range(0, least(len(a), len(b))), lambda k: a[k + 1] <> b[k + 1])) AS first_divergence FROM i"
