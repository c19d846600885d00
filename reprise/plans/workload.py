"""Queries that build workloads out of sources."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.operators import workload as W
from reprise.plans import views
from reprise.plans.text import _REWORD, REWORDINGS
from reprise.plans.views import SOURCES_SQL
from reprise.session import table

# Number of the operator and name of the transform.
TRANSFORMS = {
    "tx01": "exact_repeat", "tx02": "instruction_variant", "tx03": "same_evidence_new_task", "tx04": "leading_evidence_new_task",
    "tx05": "rag_reorder", "tx06": "multi_donor_composite", "tx07": "fuzzy_edit", "tx08": "negative_control",
    "tx09": "entity_swap_control", "tx10": "repeat_shifted", "tx11": "question_paraphrase", "tx12": "sparse_edit",
    "tx13": "fact_paraphrase",
}


def _built(transform: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a transform, prompts by their digests; probes that can't be built with the reason."""
    i = W.build(views.sources(spark, sf_dir), table(spark, sf_dir, "transform_configs"), transform, REWORDINGS)
    donor = F.array_join(F.transform("donors", lambda d: F.concat(d.donor_id, F.lit(":"), F.md5(d.text))), ",")
    return i.select("item_id", "source_id", "transform", donor.alias("donors"), F.md5("recipient").alias("recipient"), F.length("recipient").cast("bigint").alias("n_chars"), "negative_control", *(["failure"] if transform in W.PROBES else []))


def _probed(transform: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact probes of a kind that no dataset of the tables asks for, on all sources; such as can't be built with the reason."""
    configs = table(spark, sf_dir, "transform_configs").withColumn("transforms", F.array(F.lit(transform)))
    i = W.build(views.sources(spark, sf_dir), configs, transform)
    return i.select("item_id", "source_id", "transform", F.md5(F.col("donors")[0]["text"]).alias("donor"), F.md5("recipient").alias("recipient"), "failure")


def jn18_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's next one, and the next of another domain, in cyclic order of ids."""
    return W.neighbours(views.sources(spark, sf_dir))


def _sql(template: str, c: str, q: str) -> str:
    t = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(" + t.replace("{c}", f"' || {c} || '").replace("{q}", f"' || {q} || '") + ")"


_STRIP = r"regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
_SQUEEZE = r"replace(regexp_replace(c, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), '. ', '.' || chr(10))"
_NEAR = f"""{SOURCES_SQL}, o AS (SELECT source_id, coalesce(nullif(metadata['domain'], ''), dataset) AS domain, row_number() OVER (ORDER BY source_id) - 1 AS i, count(*) OVER () AS n FROM sources),
  near AS (SELECT a.source_id, any_value(a.domain) AS domain, any_value(nx.source_id) AS next, any_value(nx.domain) AS next_domain,
    coalesce(arg_min(b.source_id, (b.i - a.i + a.n) % a.n) FILTER (WHERE b.domain <> a.domain), any_value(nx.source_id)) AS other
    FROM o a JOIN o b ON true JOIN o nx ON nx.i = (a.i + 1) % a.n GROUP BY a.source_id)"""
_T = f"""t AS (SELECT s.source_id, s.dataset, {_STRIP.format(x="context")} AS c, {_STRIP.format(x="input")} AS q, {_STRIP.format(x=_REWORD)} AS rq, k.negative_selection, k.transforms FROM sources s JOIN transform_configs k USING (dataset))"""
_ID = "substr(sha256({}), 1, 16)".format
_PROMPTS = {
    "exact_repeat": (_sql(W.BASE, "c", "q"), _sql(W.BASE, "c", "q")),
    "instruction_variant": (_sql(W.BASE, "c", "q"), _sql(W.ANALYST, "c", "q")),
    "same_evidence_new_task": (_sql(W.BASE, "c", "q"), _sql(W.BRIEF, "c", "q")),
    "leading_evidence_new_task": (_sql(W.LEADING_DONOR, "c", "q"), _sql(W.LEADING, "c", "q")),
    "fuzzy_edit": (_sql(W.BASE, "c", "q"), _sql(W.FUZZY, _SQUEEZE, "q")),
    "repeat_shifted": (_sql(W.BASE, "c", "q"), _sql(W.SESSION, "c", "q")),
    "question_paraphrase": (_sql(W.BASE, "c", "q"), _sql(W.SESSION, "c", "rq")),
    "negative_control": ("donor", _sql(W.ANALYST, "c", "q")),
    "entity_swap_control": ("donor", _sql(W.BASE, "c", "q")),
}


def _oracle(transform: str) -> str:
    donor, recipient = _PROMPTS[transform]
    rows = "u AS (SELECT * FROM t)"
    if donor == "donor":
        pick = "CASE WHEN negative_selection = 'cross_domain' THEN other ELSE next END" if transform == "negative_control" else "next"
        swap = "AND domain = next_domain" if transform == "entity_swap_control" else ""
        rows = f"{_NEAR.split(', ', 1)[1]}, v AS (SELECT t.*, {pick} AS pick FROM t JOIN near USING (source_id) WHERE {pick} <> source_id {swap}), b AS (SELECT source_id AS pick, {_sql(W.BASE, 'c', 'q')} AS donor FROM (SELECT source_id, {_STRIP.format(x='context')} AS c, {_STRIP.format(x='input')} AS q FROM sources)), u AS (SELECT * FROM v JOIN b USING (pick))"
    item = _ID(f"dataset || chr(31) || source_id || chr(31) || '{transform}'")
    return f"""WITH {SOURCES_SQL}, {_T}, {rows}, w AS (SELECT {item} AS item_id, source_id, {donor} AS d, {recipient} AS r FROM u WHERE list_contains(transforms, '{transform}'))
      SELECT item_id, source_id, '{transform}' AS transform, {_ID("item_id || chr(31) || 'donor'")} || ':' || md5(d) AS donors, md5(r) AS recipient, length(r) AS n_chars, {str(transform == "negative_control").lower()} AS negative_control FROM w"""


def _filled(template: str, **parts: str) -> str:
    """A template as an SQL expression, with expressions in its places."""
    t = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, x in parts.items():
        t = t.replace(f"{{{k}}}", f"' || {x} || '")
    return f"({t})"


# Segments as the operator cuts them, a step of the recursion for each cut.
_SEGMENTS = rf"""{_T.replace('k.negative_selection', 's.context, k.max_segments AS m, k.min_segment_chars AS l')},
  asked AS (SELECT * FROM t WHERE list_contains(transforms, '{{transform}}')),
  paragraphs AS (SELECT *, list_filter(list_transform(regexp_split_to_array(context, '\n[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]*\n'), lambda x: {_STRIP.format(x="x")}), lambda x: x <> '') AS ps, greatest(l, length(c) // greatest(m, 1)) AS size FROM asked),
  cuts AS (SELECT source_id, 0 AS k, 0 AS start, 0 AS stop FROM paragraphs WHERE len(ps) < m
    UNION ALL SELECT source_id, k + 1, stop, CASE WHEN aim < length(c) AND back > 0 AND stop + length(seen) - back - 1 > stop + l // 2 THEN stop + length(seen) - back ELSE aim END
    FROM (SELECT *, instr(reverse(seen), ' .') AS back FROM (SELECT source_id, k, stop, c, l, least(length(c), stop + size) AS aim, substr(c, stop + 1, least(length(c), least(length(c), stop + size) + 200) - stop) AS seen FROM cuts JOIN paragraphs USING (source_id) WHERE stop < length(c) AND k < greatest(m, 1)))),
  pieces AS (SELECT source_id, list(p ORDER BY k) AS cut FROM (SELECT source_id, k, {_STRIP.format(x="substr(c, start + 1, stop - start)")} AS p FROM cuts JOIN paragraphs USING (source_id) WHERE k > 0) WHERE p <> '' GROUP BY 1),
  parted AS (SELECT paragraphs.*, CASE WHEN len(ps) >= m THEN ps[1:m] ELSE coalesce(cut, [c]) END AS parts FROM paragraphs LEFT JOIN pieces USING (source_id)),
  named AS (SELECT *, {_ID("dataset || chr(31) || source_id || chr(31) || '{transform}'")} AS item_id, length(parts) AS n FROM parted)"""


def _segmented(transform: str) -> str:
    reorder = transform == "rag_reorder"
    head, record, tail = (W.BUNDLE_HEAD, W.BUNDLE_RECORD, W.BUNDLE_TAIL) if reorder else (W.MULTI_HEAD, W.MULTI_RECORD, W.MULTI_TAIL)
    number = "lpad(i::VARCHAR, 2, '0')" if reorder else "i::VARCHAR"
    records = f"list_transform(range(1, n + 1), lambda i: {_filled(record, i=number, c='parts[n + 1 - i]' if reorder else 'parts[i]')})"
    recipient = f"array_to_string(list_concat([{_filled(head)}], {records}, [{_filled(tail, q='q')}]), chr(10))"
    base = f"{_ID('item_id || chr(31) || ' + chr(39) + 'donor' + chr(39))} || ':' || md5({_sql(W.BASE, 'c', 'q')})"
    each = f"list_transform(range(1, n + 1), lambda i: {_ID('item_id || chr(31) || ' + chr(39) + 'segment' + chr(39) + ' || chr(31) || (i - 1)::VARCHAR')} || ':' || md5({_filled(W.SEGMENT_DONOR, i='i::VARCHAR', c='parts[i]')}))"
    donors = base if reorder else f"array_to_string({each}, ',')"
    return f"""WITH RECURSIVE {SOURCES_SQL}, {_SEGMENTS.replace('{transform}', transform)}, w AS (SELECT item_id, source_id, {donors} AS donors, {recipient} AS r FROM named WHERE c IS NOT NULL AND q IS NOT NULL)
      SELECT item_id, source_id, '{transform}' AS transform, donors, md5(r) AS recipient, length(r) AS n_chars, false AS negative_control FROM w"""


QUERIES = {"jn18_neighbours": jn18_neighbours} | {f"{k}_{t}": partial(_built, t) for k, t in TRANSFORMS.items()} | {f"{k}_{t}": partial(_probed, t) for k, t in zip(("tx14", "tx15", "tx16"), W.PROBES[1:])}
ORACLES = {"jn18_neighbours": f"WITH {_NEAR} SELECT * FROM near"} | {f"{k}_{t}": _oracle(t) for k, t in TRANSFORMS.items() if t in _PROMPTS} | {f"{k}_{t}": _segmented(t) for k, t in TRANSFORMS.items() if t in ("rag_reorder", "multi_donor_composite")}
