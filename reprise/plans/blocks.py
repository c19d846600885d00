"""Queries on token blocks, collisions and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions import text as T
from reprise.operators import blocks, dedupe
from reprise.plans import views
from reprise.plans.text import sql_blocks, sql_digest, sql_token_ids
from reprise.plans.views import ITEMS_SQL, SOURCES_SQL

_DONORS = "donors AS (SELECT item_id, coalesce(nullif(d.metadata['negative_source_id'], ''), nullif(d.metadata['entity_swap_source_id'], ''), source_id) AS origin, d.text AS text FROM (SELECT item_id, source_id, unnest(donor_prompts) AS d FROM items))"
_BLOCKS = f"""WITH {ITEMS_SQL}, {_DONORS},
  db0 AS (SELECT item_id, origin, {sql_token_ids("text")} AS ids FROM donors),
  db1 AS (SELECT item_id, origin, unnest({sql_blocks("ids", 16)}) AS b FROM db0),
  db AS (SELECT item_id, origin, {sql_digest("b")} AS h, len(list_distinct(b)) < 4 AS deg FROM db1),
  rb0 AS (SELECT item_id, source_id, transform, negative_control, {sql_token_ids("recipient_prompt")} AS ids FROM items),
  rb1 AS (SELECT item_id, source_id, transform, negative_control, unnest(range(0, len(ids) // 16)) AS block_no, ids FROM rb0),
  rb2 AS (SELECT * EXCLUDE (ids), ids[block_no * 16 + 1 : block_no * 16 + 16] AS b FROM rb1),
  rb AS (SELECT * EXCLUDE (b), {sql_digest("b")} AS h, len(list_distinct(b)) < 4 AS deg FROM rb2)"""
_HITS = f"""{_BLOCKS}, own AS (SELECT DISTINCT item_id, h FROM db),
  counted AS (SELECT item_id, count(*) AS total_blocks, count(own.h) AS hit_blocks FROM rb LEFT JOIN own USING (item_id, h) GROUP BY 1),
  hits AS (SELECT item_id, transform, dataset, coalesce(total_blocks, 0) AS total_blocks, coalesce(hit_blocks, 0) AS hit_blocks FROM items LEFT JOIN counted USING (item_id))"""
_VIOLATIONS = f"""{_BLOCKS}, owners AS (SELECT DISTINCT h, item_id AS owner, origin FROM db WHERE NOT deg),
  limits AS (SELECT greatest(2, least(3, count(DISTINCT origin))) AS threshold FROM owners),
  per AS (SELECT h, count(DISTINCT origin) AS n FROM owners GROUP BY 1),
  rare AS (SELECT h FROM per, limits WHERE n < threshold),
  met AS (SELECT rb.*, owner, origin FROM rb JOIN owners USING (h) WHERE NOT deg AND h IN (SELECT h FROM rare)),
  g AS (SELECT item_id, source_id, negative_control, block_no, h, bool_or(owner = item_id) AS own, list_sort(list_distinct(list(owner))) AS owners,
        coalesce(list_sort(list_distinct(list(owner) FILTER (WHERE origin <> source_id))), []) AS foreign_ FROM met GROUP BY ALL),
  v AS (SELECT CASE WHEN negative_control AND own THEN 'negative_control_overlap' WHEN len(foreign_) > 0 THEN 'phantom_cross_source' END AS kind, item_id, source_id, block_no, h AS block_hash,
        CASE WHEN negative_control AND own THEN len(owners) ELSE len(foreign_) END AS n_items, CASE WHEN negative_control AND own THEN owners[1] ELSE foreign_[1] END AS first_item FROM g)"""
# Sources in the order of their ids, and the windows each shares with others.
_EDGES = f"""WITH RECURSIVE {SOURCES_SQL}, t AS (SELECT source_id, {sql_token_ids("context || chr(10) || input")} AS ids FROM sources),
  w0 AS (SELECT source_id, unnest(list_transform(range(1, len(ids) - 14), lambda i: ids[i : i + 15])) AS w FROM t),
  w AS (SELECT DISTINCT source_id, w FROM w0 WHERE len(list_distinct(w)) >= 4),
  edges AS (SELECT DISTINCT b.source_id AS later, a.source_id AS earlier FROM w a JOIN w b ON a.w = b.w AND a.source_id < b.source_id)"""
_KEPT = f"""{_EDGES}, n AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS i FROM sources),
  before AS (SELECT n.i, list(e.earlier) FILTER (WHERE e.earlier IS NOT NULL) AS earlier, any_value(n.source_id) AS source_id FROM n LEFT JOIN edges e ON e.later = n.source_id GROUP BY n.i),
  walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept
    UNION ALL SELECT b.i, CASE WHEN len(list_intersect(coalesce(b.earlier, []), walk.kept)) > 0 THEN walk.kept ELSE list_append(walk.kept, b.source_id) END FROM walk JOIN before b ON b.i = walk.i + 1),
  final AS (SELECT unnest(kept) AS source_id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1))"""


def jn08_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.exact_hits(views.items(spark, sf_dir))


def ag09_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: exact block hit rate by transform, and over all."""
    return blocks.hit_rates(blocks.exact_hits(views.items(spark, sf_dir)))


def jn09_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.collisions(views.items(spark, sf_dir))


def st05_first_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's violations: the first fifty in the order of items and blocks."""
    return blocks.collisions(views.items(spark, sf_dir)).orderBy("item_id", "block_no").limit(blocks.MOST_VIOLATIONS)


def ag38_collision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.collision_report(views.items(spark, sf_dir))


def prj10_degenerate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks.prompt_blocks(views.items(spark, sf_dir), ["transform"], "recipient_prompt")
    return b.groupBy("transform").agg(F.count("*").alias("n_blocks"), F.count_if("degenerate").alias("n_degenerate"))


def _dedupe_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sources(spark, sf_dir)
    return s.select("source_id", "dataset", F.concat("context", F.lit("\n"), "input").alias("material"))


def wf09_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _dedupe_material(spark, sf_dir).select("source_id", T.token_ids(F.col("material")).alias("ids"))
    w = ids.select("source_id", F.explode(T.windows(F.col("ids"), 16)).alias("w")).where(~T.degenerate(F.col("w")))
    return w.groupBy("source_id").agg(F.count("*").alias("n_windows"), F.countDistinct("w").alias("n_distinct"))


def jn10_window_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that share windows of sixteen tokens, and the first that holds one of them."""
    return dedupe.first_overlaps(dedupe.shared_windows(_dedupe_material(spark, sf_dir), "source_id", "material"), "source_id")


def jn10_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources kept by the greedy rule, in the order of their ids."""
    s = _dedupe_material(spark, sf_dir)
    return dedupe.greedy_keep(s, dedupe.shared_windows(s, "source_id", "material"), "source_id")


def ag39_dedupe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = jn10_dedupe(spark, sf_dir).join(views.sources(spark, sf_dir).select("source_id", "dataset"), "source_id")
    return kept.groupBy("dataset").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))


def wf05_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sources of each dataset."""
    return dedupe.cap_per_dataset(views.sources(spark, sf_dir).select("source_id", "dataset"), "source_id", 3).select("dataset", "source_id", "rank")


QUERIES = {
    f.__name__: f
    for f in (ag09_hit_rates, jn08_exact_hits, jn09_collisions, st05_first_collisions, ag38_collision_report, prj10_degenerate_blocks, wf09_windows, jn10_window_overlaps, jn10_dedupe, ag39_dedupe_report, wf05_cap)
}
ORACLES = {
    "jn08_exact_hits": f"{_HITS} SELECT * FROM hits",
    "ag09_hit_rates": f"{_HITS}, r AS (SELECT transform, count(*) AS n_items, sum(total_blocks)::BIGINT AS total_blocks, sum(hit_blocks)::BIGINT AS hit_blocks FROM hits GROUP BY ROLLUP (transform)) SELECT *, CASE WHEN total_blocks > 0 THEN hit_blocks / total_blocks ELSE 0.0 END AS exact_block_hit_rate FROM r",
    "jn09_collisions": f"{_VIOLATIONS} SELECT * FROM v WHERE kind IS NOT NULL",
    "st05_first_collisions": f"{_VIOLATIONS} SELECT * FROM v WHERE kind IS NOT NULL ORDER BY item_id, block_no LIMIT 50",
    "ag38_collision_report": f"{_VIOLATIONS} SELECT (SELECT count(*) FROM items) AS items_checked, (SELECT count(*) FROM db) AS donor_blocks, (SELECT count(*) FROM db WHERE deg) AS degenerate_blocks, (SELECT count(*) FROM per, limits WHERE n >= threshold) AS boilerplate_blocks, (SELECT count(*) FROM v WHERE kind IS NOT NULL) AS n_violations, (SELECT count(*) FROM v WHERE kind IS NOT NULL) = 0 AS passed",
    "prj10_degenerate_blocks": f"{_BLOCKS} SELECT transform, count(*) AS n_blocks, count(*) FILTER (WHERE deg) AS n_degenerate FROM rb GROUP BY 1",
    "wf09_windows": f"{_EDGES} SELECT source_id, count(*) AS n_windows, count(DISTINCT w) AS n_distinct FROM w0 WHERE len(list_distinct(w)) >= 4 GROUP BY 1",
    "jn10_window_overlaps": f"{_EDGES}, several AS (SELECT w, min(source_id) AS first FROM w GROUP BY 1 HAVING count(*) > 1) SELECT source_id, count(*) AS n_windows, min(first) AS first FROM w JOIN several USING (w) GROUP BY 1",
    "jn10_dedupe": f"{_KEPT} SELECT source_id, source_id IN (SELECT source_id FROM final) AS kept FROM sources",
    "ag39_dedupe_report": f"{_KEPT} SELECT dataset, count(*) FILTER (WHERE source_id IN (SELECT source_id FROM final)) AS n_kept, count(*) FILTER (WHERE source_id NOT IN (SELECT source_id FROM final)) AS n_dropped FROM sources GROUP BY 1",
    "wf05_cap": f"WITH {SOURCES_SQL} SELECT dataset, source_id, rank FROM (SELECT dataset, source_id, row_number() OVER (PARTITION BY dataset ORDER BY source_id) AS rank FROM sources) WHERE rank <= 3",
}
