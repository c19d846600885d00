"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

# White space as Python has it, for an engine whose \s is ASCII only; \x01 stands for the \r of \r\n.
_WS = r"\s\x01\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_P3 = rf"""
WITH once AS (
  SELECT s.source_id, any_value(replace(replace(context, chr(13) || chr(10), chr(1) || chr(10)), chr(13), chr(10))) AS t,
         any_value(c.max_segment_chars) AS lim
  FROM source_records s JOIN transform_configs c USING (dataset) GROUP BY 1),
long AS (SELECT * FROM once WHERE length(t) > lim),
parts AS (
  SELECT source_id, lim, unnest(regexp_split_to_array(t, '[{_WS}]*\n[{_WS}]*\n[{_WS}]*')) AS p FROM long),
sentences AS (
  SELECT source_id, lim, p, unnest(regexp_split_to_array(
    regexp_replace(regexp_replace(p, '([.!?])[{_WS}]+', '\1' || chr(2), 'g'), '([。！？])', '\1' || chr(2), 'g'), '\x02')) AS q
  FROM parts),
words AS (SELECT source_id, lim, p, q, unnest(regexp_split_to_array(q, '[{_WS}]+')) AS w FROM sentences),
worst AS (
  SELECT source_id, any_value(lim) AS lim,
    max(length(regexp_replace(p, '^[{_WS}]+|[{_WS}]+$', '', 'g'))) AS p,
    max(length(regexp_replace(q, '^[{_WS}]+|[{_WS}]+$', '', 'g'))) AS q, max(length(w)) AS w
  FROM words GROUP BY 1)
SELECT source_id, CASE WHEN p <= lim THEN 'blank_line' WHEN q <= lim THEN 'sentence' WHEN w <= lim THEN 'word' ELSE 'hard' END AS cut_level
FROM worst
"""

_P7_SIZES = r"""
WITH sizes AS (
  SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]')) AS n FROM documents)
"""

_P7 = _P7_SIZES + "SELECT budget_id, doc_id FROM sizes JOIN pack_budgets ON n > capacity_tokens"

_P7_TOTALS = _P7_SIZES + """
SELECT budget_id, count(DISTINCT doc_id) AS n_documents, sum(greatest(1, ceil(n / capacity_tokens)))::BIGINT AS n_pieces, sum(n)::BIGINT AS n_tokens
FROM sizes CROSS JOIN pack_budgets GROUP BY 1
"""

# Exact percentiles, then rounded to the middle of a 2,048th of their power of two. The error of ranks is 0
# as long as no group is large enough for its digest to be compressed.
_P4_ONCE = """
WITH once AS (
  SELECT engine_request_id, min(dataset) AS dataset, min(transform) AS transform, min(started_at)::DATE AS day, min(ttft_ms) AS x
  FROM request_metrics WHERE ttft_ms IS NOT NULL AND NOT isnan(ttft_ms) GROUP BY 1)
"""
_P4 = (
    _P4_ONCE
    + """,
exact AS (SELECT {keys}, count(*) AS n, {exact} FROM once GROUP BY {keys})
SELECT {keys}, n AS n_values, {values}, 0::BIGINT AS rank_error FROM exact
"""
)
_PERCENTILES = (50, 90, 95, 99)
_P4_EXACT = ", ".join(f"quantile_disc(x, {p / 100}) AS v{p}" for p in _PERCENTILES)
_E = "floor(log2(abs(v{p})))"
_P4_VALUES = ", ".join(f"CASE WHEN v{p} = 0 THEN 0 ELSE sign(v{p}) * pow(2, {_E}) * (1 + (floor((abs(v{p}) / pow(2, {_E}) - 1) * 2048) + 0.5) / 2048) END AS p{p}".format(p=p) for p in _PERCENTILES)
_P4_COMPRESSED = (
    _P4_ONCE
    + f"""
SELECT scope, count(*) AS n_values, {", ".join(f"true AS p{p}_within" for p in _PERCENTILES)}, CASE WHEN scope = 'all' THEN true END AS compressed
FROM (SELECT 'all' AS scope FROM once UNION ALL SELECT 'dataset ' || dataset FROM once) GROUP BY 1
"""
)

_ITEM_TEXTS = """
items AS (SELECT DISTINCT ON (item_id) item_id, recipient_prompt, donor_prompts FROM workload_items),
donors AS (SELECT item_id, donor_prompts, unnest(range(0, len(donor_prompts))) AS n FROM items),
texts AS (
  SELECT item_id, 'recipient' AS part, recipient_prompt AS t FROM items
  UNION ALL SELECT item_id, 'donor ' || n, donor_prompts[n + 1].text FROM donors)
"""

_P1 = f"""
WITH {_ITEM_TEXTS},
places AS (SELECT item_id, t, unnest(range(1, length(t) - 238)) AS i FROM (SELECT DISTINCT item_id, t FROM texts WHERE length(t) >= 240)),
spans AS (SELECT DISTINCT item_id, md5_number(substr(t, i, 240)) AS h FROM places)
SELECT DISTINCT a.item_id AS item_id_a, b.item_id AS item_id_b FROM spans a JOIN spans b ON a.h = b.h AND a.item_id < b.item_id
"""

_P1_COVERAGE = f"""
WITH {_ITEM_TEXTS},
places AS (SELECT item_id, part, unnest(range(1, length(t) - 238)) AS i, t FROM texts WHERE length(t) >= 240),
grams AS (SELECT item_id, part, i, md5_number(substr(t, i, 240)) AS h FROM places),
shared AS (SELECT h FROM grams GROUP BY 1 HAVING count(DISTINCT item_id) > 1),
held AS (SELECT item_id, part, i, lead(i) OVER (PARTITION BY item_id, part ORDER BY i) AS next FROM grams SEMI JOIN shared USING (h)),
counted AS (SELECT item_id, part, sum(least(240, coalesce(next - i, 240))) AS n FROM held GROUP BY ALL)
SELECT item_id AS record_id, part, length(t)::INT AS n_chars, coalesce(n, 0)::INT AS shared_chars FROM texts LEFT JOIN counted USING (item_id, part) WHERE t IS NOT NULL
"""

_P1_LINES = rf"""
WITH {_ITEM_TEXTS},
cut AS (SELECT item_id, part, string_split(regexp_replace(t, '(\r\n|\r|\n)', '\1' || chr(1), 'g'), chr(1)) AS u FROM texts WHERE t IS NOT NULL),
each AS (SELECT item_id, part, unnest(range(1, len(u) + 1)) AS k, u FROM cut),
placed AS (SELECT item_id, part, u[k] AS unit, coalesce(list_sum(list_transform(u[1 : k - 1], lambda x: length(x))), 0) AS start FROM each),
plain AS (SELECT item_id, part, start, length(unit) AS length, trim(regexp_replace(lower(unit), '[\s\x0b\p{{Z}}]+', ' ', 'g')) AS p FROM placed),
firsts AS (SELECT md5(p) AS digest, min((item_id, part, start)) AS first, count(*) AS n_copies FROM plain GROUP BY 1)
SELECT item_id AS record_id, part, start::BIGINT AS start, length, digest, n_copies, first = (item_id, part, start) OR length(p) < 20 AS kept
FROM plain JOIN firsts ON digest = md5(p)
"""

_P5 = r"""
WITH items AS (SELECT DISTINCT ON (item_id) item_id, recipient_prompt AS t FROM workload_items),
w AS (SELECT item_id, list_transform(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM items WHERE t IS NOT NULL),
s AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.item_id < b.item_id GROUP BY ALL)
SELECT a AS item_id_a, b AS item_id_b FROM c JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE 5 * c >= 3 * (x.n + y.n - c)
"""

# Classes of equal sets and groups of linked items, each named by its least item.
_P5_GROUPS = (
    _P5.rsplit("SELECT a AS", 1)[0].rstrip()
    + r""",
e AS (SELECT item_id, list_sort(list(s)) AS l FROM s GROUP BY 1),
k AS (SELECT item_id, min(item_id) OVER (PARTITION BY l) AS class_id FROM e),
linked AS (SELECT a, b FROM c JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b WHERE 5 * c >= 3 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT item_id AS a, item_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON r.b = l.a),
g AS (SELECT a AS item_id, min(b) AS group_id FROM reach GROUP BY 1)
SELECT item_id AS id, class_id, group_id, (SELECT count(*) FROM both_ WHERE both_.a = g.item_id) AS n_links FROM g JOIN k USING (item_id)
"""
).replace("WITH items", "WITH RECURSIVE items", 1)

ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p1_coverage": _P1_COVERAGE,
    "p1_lines": _P1_LINES,
    "p5_found": _P5,
    "p5_groups": _P5_GROUPS,
    "p3_found": _P3,
    "p3_rebuilt": "SELECT DISTINCT ON (source_id) source_id, md5(context) AS text_digest, length(context)::INT AS n_chars, true AS within_limit, true AS overlap_kept FROM source_records WHERE context IS NOT NULL",
    "p4_daily": _P4.format(keys="dataset, transform, day", exact=_P4_EXACT, values=_P4_VALUES),
    "p4_period": _P4.format(keys="dataset, transform", exact=_P4_EXACT, values=_P4_VALUES),
    "p4_compressed": _P4_COMPRESSED,
    "p7_found": _P7,
    "p7_totals": _P7_TOTALS,
}
