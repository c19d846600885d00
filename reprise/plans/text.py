"""Queries on the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions import rouge
from reprise.functions import text as T
from reprise.plans import views
from reprise.plans.views import ITEMS_SQL, REQUESTS_SQL, SOURCES_SQL

# Rewordings of questions, in order.
REWORDINGS = (
    ("what was the root cause and how long did mitigation take?", "how long did mitigation take, and what root cause was identified?"),
    ("and what period does it specify?", "and what time period applies?"),
    ("Which clause of agreement", "Identify the clause of agreement"),
    ("What anomalous error code did", "Which anomalous error code did"),
    ("and how many occurrences were counted?", "and what was the occurrence count?"),
    ("What was the customer impact and remediation?", "Describe the remediation and the customer impact."),
    ("Which obligations require legal follow-up?", "List the obligations that need legal follow-up."),
)

_WS = r"\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}"
SQL_TOKENS = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]')"
SQL_ID = "((('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::BIGINT) & 2147483647)"


def sql_token_ids(x: str) -> str:
    return f"list_transform(list_transform({SQL_TOKENS.format(x=x)}, lambda t: sha256(lower(t))), lambda h: {SQL_ID.format(h='h')})"


def sql_digest(ids: str) -> str:
    """Digest of a list of ids."""
    swap = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"
    return f"substr(sha256(unhex(list_aggregate(list_transform(list_transform({ids}, lambda x: lpad(to_hex(x), 8, '0')), lambda h: {swap}), 'string_agg', ''))), 1, 32)"


def sql_blocks(ids: str, size: int) -> str:
    return f"list_transform(range(0, len({ids}) // {size}), lambda i: {ids}[i * {size} + 1 : (i + 1) * {size}])"


def sf01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.sources(spark, sf_dir).select("source_id", T.token_ids(F.col("context")).alias("ids"))
    return ids.select("source_id", F.size("ids").cast("bigint").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"), F.array_max("ids").alias("id_max"))


def sf03_block_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.sources(spark, sf_dir).select("source_id", T.token_ids(F.col("context")).alias("ids"))
    return ids.select("source_id", T.blocks(F.col("ids"), 16).alias("blocks")).select("source_id", F.posexplode("blocks").alias("block_no", "b")).select("source_id", F.col("block_no").cast("bigint").alias("block_no"), T.ids_digest(F.col("b")).alias("block_hash"))


def sf04_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.items(spark, sf_dir)
    made = T.stable_id(F.col("dataset"), F.col("source_id"), F.col("transform"))
    return i.select("item_id", made.alias("derived_id"), T.stable_id(made, F.lit("donor")).alias("donor_id"))


def sf05_request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir, "run_id", "arm", "stream_position", "dataset", "item_id")
    made = T.request_id(F.col("run_id"), F.col("arm"), F.coalesce("stream_position", F.lit(0)), F.col("dataset"), F.col("run_id"), F.col("arm"), F.col("item_id"))
    return r.select("engine_request_id", made.alias("request_id"))


def sf06_derived_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.items(spark, sf_dir).select("item_id", T.derived_int(F.concat(F.lit("fact:"), "item_id"), 100, 999).alias("n"))


def sf07_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir, "item_id").select(T.placed_on(F.col("item_id"), 7).alias("worker"))
    return r.groupBy("worker").agg(F.count("*").alias("n_requests"))


def sf09_normal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.sources(spark, sf_dir).select("source_id", T.normal_words(F.col("context")).alias("w"))
    return w.select("source_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


def sf10_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.items(spark, sf_dir).select(F.explode(T.scored_words(F.col("input"))).alias("stem"))
    return w.groupBy("stem").agg(F.count("*").alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of output and answers, with their number: repeated answers are scored once."""
    out = views.requests(spark, sf_dir, "item_id", "output_text", "transform").where("output_text IS NOT NULL").groupBy("item_id", "transform", "output_text").agg(F.count("*").alias("n"))
    return out.join(views.items(spark, sf_dir).select("item_id", "answers"), "item_id")


def sf11_answer_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("score", T.best_of(F.col("answers"), lambda a: T.answer_recall(F.col("output_text"), a)))
    return s.select("item_id", F.md5("output_text").alias("output"), "n", F.round("score", 6).alias("score"))


def sf12_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("score", T.best_of(F.col("answers"), lambda a: T.token_f1(F.col("output_text"), a)))
    return s.select("item_id", F.md5("output_text").alias("output"), "n", F.round("score", 6).alias("score"))


def sf13_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).select("item_id", "output_text", "n", "answers")
    each = s.select("item_id", "output_text", "n", F.explode_outer(F.filter("answers", lambda a: a.isNotNull() & (a != ""))).alias("a"), F.coalesce(F.size("answers"), F.lit(0)).alias("k"))
    best = each.withColumn("r", rouge.rouge_l("output_text", "a")).groupBy("item_id", "output_text", "n", "k").agg(F.max("r").alias("r"))
    return best.select("item_id", F.md5("output_text").alias("output"), "n", F.when(F.col("k") > 0, F.round(F.coalesce("r", F.lit(0.0)), 6)).alias("score"))


def sf14_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.requests(spark, sf_dir, "output_text").where("output_text IS NOT NULL").select(T.answer_letter(F.col("output_text")).alias("letter"))
    return r.groupBy("letter").agg(F.count("*").alias("n"))


def sf15_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sources(spark, sf_dir).select("source_id", T.sentences(F.col("context")).alias("s"))
    return s.select("source_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def sf17_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.sources(spark, sf_dir)
    return s.select("source_id", F.md5(T.inject_sentence(F.col("context"), F.lit("One more fact."))).alias("digest"))


def sf19_reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("input")
    for old, new in REWORDINGS:
        q = F.replace(q, F.lit(old), F.lit(new))
    return views.items(spark, sf_dir).select("item_id", q.alias("question"))


_SQL_WORDS = r"list_filter(string_split(lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', ' ', 'g')), ' '), lambda w: w <> '')"
_SQL_CUT = "CASE " + " ".join(f"WHEN length(w) > {len(s) + 3} AND ends_with(w, '{s}') THEN substr(w, 1, length(w) - {len(s)})" for s in T.SUFFIXES) + " ELSE w END"
_SQL_STEMS = f"list_transform(list_transform(list_filter({_SQL_WORDS}, lambda w: w NOT IN {T.STOP_WORDS}), lambda w: {_SQL_CUT}), lambda w: CASE WHEN length(w) >= 3 AND w[-1] = w[-2] THEN w[:-2] ELSE w END)"
_SQL_SCORED = f"WITH {REQUESTS_SQL}, {ITEMS_SQL}, scored AS (SELECT item_id, output_text, answers, n FROM (SELECT item_id, transform, output_text, count(*) AS n FROM requests WHERE output_text IS NOT NULL GROUP BY ALL) JOIN items USING (item_id)), each AS (SELECT item_id, output_text, n, coalesce(len(answers), 0) AS k, unnest(CASE WHEN len(list_filter(answers, lambda a: a IS NOT NULL AND a <> '')) > 0 THEN list_filter(answers, lambda a: a IS NOT NULL AND a <> '') ELSE [NULL] END) AS a FROM scored)"


def _sql_best(a: str, b: str, value: str) -> str:
    common = "list_sum(list_transform(list_distinct(list_intersect(x, y)), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w)))))"
    return f"""{_SQL_SCORED}, lists AS (SELECT *, {a} AS x, {b} AS y FROM each),
      values_ AS (SELECT *, coalesce({common}, 0)::DOUBLE AS c, len(x) AS p, len(y) AS q FROM lists),
      one AS (SELECT item_id, output_text, n, k, CASE WHEN a IS NULL OR p = 0 OR q = 0 OR c = 0 THEN 0.0 ELSE {value} END AS s FROM values_)
      SELECT item_id, md5(output_text) AS output, n, CASE WHEN k > 0 THEN round(max(s), 6) END AS score FROM one GROUP BY item_id, output_text, n, k"""


_SQL_SPACES = rf"regexp_replace({{x}}, '[{_WS}]+', ' ', 'g')"
_SQL_PLAIN = rf"trim({_SQL_SPACES}, ' ')"
_SQL_SENTENCES = rf"list_filter(string_split(regexp_replace(regexp_replace({_SQL_PLAIN}, '([.!?]) ', '\1' || chr(2), 'g'), '([。！？])[ ]*', '\1' || chr(2), 'g'), chr(2)), lambda s: s <> '')"
_REWORD = "input"
for _old, _new in REWORDINGS:
    _REWORD = f"replace({_REWORD}, '{_old}', '{_new}')"
_LETTER = r"upper(coalesce(nullif(regexp_extract(output_text, '(?im)^\s*(?:answer|final answer)\s*[:\-]?\s*\(?([A-D])\)?\b', 1), ''), nullif(regexp_extract(output_text, '(?im)^\s*\(?([A-D])\)?\s*[.):]?\s*$', 1), ''), nullif(regexp_extract(output_text, '\b([A-D])\b', 1), '')))"
_CLEAN = "coalesce(nullif(trim(substr(regexp_replace(lower({x}), '[^a-z0-9-]', '-', 'g'), 1, 24), '-'), ''), 'x')"
_STABLE = "substr(sha256({x}), 1, 16)"

# Longest common subsequence: a row of the table per word of y, each entry the best match that ends at or before it.
SQL_LCS = "list_reduce({y}, lambda r, w: list_transform(range(1, len({x}) + 1), lambda j: greatest(r[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: {x}[k] = w), lambda k: coalesce(r[k - 1], 0) + 1)), 0))), list_transform({x}, lambda z: 0::BIGINT))[-1]"
_SQL_ROUGE = f"""{_SQL_SCORED}, p AS (SELECT DISTINCT output_text, a FROM each WHERE a IS NOT NULL), l AS (SELECT output_text, a, {_SQL_WORDS.format(x="output_text")} AS x, {_SQL_WORDS.format(x="a")} AS y FROM p),
  m AS (SELECT output_text, a, len(x) AS n, len(y) AS k, CASE WHEN len(x) > 0 AND len(y) > 0 THEN {SQL_LCS.format(x="x", y="y")} ELSE 0 END AS c FROM l),
  s AS (SELECT output_text, a, CASE WHEN c = 0 THEN 0.0 ELSE 2 * (c / n) * (c / k) / (c / n + c / k) END AS s FROM m)
  SELECT item_id, md5(output_text) AS output, n, CASE WHEN k > 0 THEN round(coalesce(max(s), 0), 6) END AS score FROM each LEFT JOIN s USING (output_text, a) GROUP BY item_id, output_text, n, k"""

QUERIES = {
    f.__name__: f
    for f in (sf01_tokens, sf03_block_hashes, sf04_stable_ids, sf05_request_ids, sf06_derived_ints, sf07_placement, sf09_normal_words, sf10_stems, sf11_answer_recall, sf12_token_f1, sf13_rouge_l, sf14_letters, sf15_sentences, sf17_inject, sf19_reworded)
}
ORACLES = {
    "sf01_tokens": f"WITH {SOURCES_SQL}, t AS (SELECT source_id, {sql_token_ids('context')} AS ids FROM sources) SELECT source_id, len(ids) AS n_tokens, list_sum(ids)::BIGINT AS id_sum, list_max(ids) AS id_max FROM t",
    "sf03_block_hashes": f"WITH {SOURCES_SQL}, t AS (SELECT source_id, {sql_token_ids('context')} AS ids FROM sources), b AS (SELECT source_id, unnest(range(0, len(ids) // 16)) AS block_no, ids FROM t) SELECT source_id, block_no, {sql_digest('ids[block_no * 16 + 1 : block_no * 16 + 16]')} AS block_hash FROM b",
    "sf04_stable_ids": f"WITH {ITEMS_SQL}, d AS (SELECT item_id, {_STABLE.format(x='dataset || chr(31) || source_id || chr(31) || transform')} AS derived_id FROM items) SELECT item_id, derived_id, {_STABLE.format(x='derived_id || chr(31) || ' + chr(39) + 'donor' + chr(39))} AS donor_id FROM d",
    "sf05_request_ids": f"WITH {REQUESTS_SQL} SELECT engine_request_id, concat_ws('-', {_CLEAN.format(x='run_id')}, {_CLEAN.format(x='arm')}, lpad(coalesce(stream_position, 0)::VARCHAR, 6, '0'), {_CLEAN.format(x='dataset')}, {_STABLE.format(x='run_id || chr(31) || arm || chr(31) || item_id')}) AS request_id FROM requests",
    "sf06_derived_ints": f"WITH {ITEMS_SQL} SELECT item_id, 100 + ('0x' || substr(sha256('fact:' || item_id), 1, 8))::BIGINT % 900 AS n FROM items",
    "sf07_placement": f"WITH {REQUESTS_SQL} SELECT (('0x' || substr(sha256(item_id), 1, 16))::UBIGINT % 7)::INT AS worker, count(*) AS n_requests FROM requests GROUP BY 1",
    "sf09_normal_words": f"WITH {SOURCES_SQL}, w AS (SELECT source_id, {_SQL_WORDS.format(x='context')} AS w FROM sources) SELECT source_id, len(w) AS n_words, md5(list_aggregate(w, 'string_agg', ' ')) AS digest FROM w",
    "sf10_stems": f"WITH {ITEMS_SQL}, w AS (SELECT unnest({_SQL_STEMS.format(x='input')}) AS stem FROM items) SELECT stem, count(*) AS n FROM w GROUP BY 1",
    "sf11_answer_recall": _sql_best(_SQL_STEMS.format(x="output_text"), _SQL_STEMS.format(x="a"), "c / q"),
    "sf12_token_f1": _sql_best(_SQL_WORDS.format(x="output_text"), _SQL_WORDS.format(x="a"), "2 * (c / p) * (c / q) / (c / p + c / q)"),
    "sf13_rouge_l": _SQL_ROUGE,
    "sf14_letters": f"WITH {REQUESTS_SQL} SELECT {_LETTER} AS letter, count(*) AS n FROM requests WHERE output_text IS NOT NULL GROUP BY 1",
    "sf15_sentences": f"WITH {SOURCES_SQL}, s AS (SELECT source_id, {_SQL_SENTENCES.format(x='context')} AS s FROM sources) SELECT source_id, len(s) AS n_sentences, md5(list_aggregate(s, 'string_agg', '|')) AS digest FROM s",
    "sf17_inject": f"WITH {SOURCES_SQL}, s AS (SELECT source_id, {_SQL_SENTENCES.format(x='context')} AS s FROM sources) SELECT source_id, md5(list_aggregate(list_concat(s[: len(s) // 2], ['One more fact.'], s[len(s) // 2 + 1 :]), 'string_agg', ' ')) AS digest FROM s",
    "sf19_reworded": f"WITH {ITEMS_SQL} SELECT item_id, {_REWORD} AS question FROM items",
}
