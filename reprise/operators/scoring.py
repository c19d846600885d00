"""Rows out of responses: choices, scores, sources, names and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions import text as T
from reprise.operators import signals as S

# The class of multiple-choice items, sources that count single requests, characters of an output that a row keeps.
CHOICE_CLASS = "longbench_v2_mc"
PER_REQUEST_SOURCES = ("connector_audit",)
OUTPUT_CHARS = 2000
QUALITY_PASS = 0.6
# Where a denominator comes from.
FROM_MANIFEST, FROM_ROWS = "manifest", "rows_present"


def is_multiple_choice(traffic_class: Column, expected_letter: Column) -> Column:
    return F.coalesce(traffic_class == CHOICE_CLASS, F.lit(False)) | expected_letter.isNotNull()


def letter_match(output: Column, answers: Column) -> Column:
    """1.0 if the reply's letter is among the answers, else 0.0; null without answers."""
    given = F.filter(F.transform(answers, lambda a: F.upper(T.strip(a))), lambda a: a.isNotNull() & (a != ""))
    found = F.coalesce(F.array_contains(given, T.answer_letter(F.coalesce(output, F.lit("")))), F.lit(False))
    return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, found.cast("double"))


def response_row(rows: DataFrame, block: int = 16) -> DataFrame:
    """Facts of a request out of its response and item, of rows (output_text, cached_tokens, exact_hit_blocks, answers, choice).

    Replies to multiple-choice items are scored by their letter only, others by their recall of the
    best answer; a score passes from `QUALITY_PASS`, a letter at 1. What was not reported stays null.
    """
    output = F.coalesce("output_text", F.lit(""))
    score = F.when(F.col("choice"), letter_match(output, F.col("answers"))).otherwise(T.best_of(F.col("answers"), lambda a: T.answer_recall(output, a)))
    rows = rows.withColumns({"backend_confirmed_tokens": F.col("cached_tokens"), "backend_confirmed_blocks": F.floor(F.col("cached_tokens") / block), "exact_hit_tokens": F.col("exact_hit_blocks") * block, "quality_score": score})
    return rows.withColumns({"quality_pass": F.col("quality_score") >= F.when(F.col("choice"), 1.0).otherwise(QUALITY_PASS), "output_text": F.substring(output, 1, OUTPUT_CHARS)}).drop("cached_tokens")


def named_in(metadata: Column, keys: tuple[str, ...], default: str) -> Column:
    """The first of some keys of a JSON object that isn't empty, else a default."""
    return F.coalesce(*(F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in keys), F.lit(default))


def source_labels(rows: DataFrame, keys: list[str], label: str = "external_confirmed_tokens_source") -> DataFrame:
    """(keys, sources, per_request): sorted labels, and whether all of them count single requests; null without labels."""
    given = F.nullif(F.col(label), F.lit(""))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(given)).alias("sources"), F.bool_and(F.when(given.isNotNull(), given.isin(*PER_REQUEST_SOURCES))).alias("per_request"))


def paired_ratio(numerator: Column, denominator: Column) -> Column:
    """A ratio that fails the query where the denominator is missing, zero or negative, instead of dropping the pair."""
    bad = ~F.coalesce(denominator > 0, F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad denominator of a pair: "), F.coalesce(denominator.cast("string"), F.lit("null")))).cast("double")).otherwise(numerator / denominator)


def settle_remaining(finished: Column, now: Column, least: Column) -> Column:
    """Seconds that are left of a pause of `least` after an earlier request; all of it if that never finished."""
    return F.greatest(F.lit(0.0), F.when((least > 0) & finished.isNull(), least.cast("double")).when(least > 0, least - (now - finished)).otherwise(0.0))


def target_start_agreement(rows: DataFrame) -> DataFrame:
    """One row: how often the advertised start of a span is the expected one, where both are known; null rate without audit."""
    both = F.col("expected_span_target_start").isNotNull() & F.col("audit_advertised_target_start").isNotNull()
    same = both & (F.col("expected_span_target_start") == F.col("audit_advertised_target_start"))
    joined = F.coalesce(F.bool_or("audit_joined"), F.lit(False))
    return rows.agg(F.when(joined, F.try_divide(F.count_if(same), F.count_if(both))).alias("agreement"), F.when(joined, F.count_if(same)).alias("agreed"), F.count_if(both).alias("claims"))


def opportunity_rates(alignment: DataFrame, class_counts: DataFrame | None = None) -> DataFrame:
    """One row: how often advertises met an opportunity, over the manifest's items of those classes and over the rows present.

    `alignment` is a row of `metrics.alignment_aggregates`, `class_counts` the manifest's
    (traffic_class, n_items). Without a manifest the rows present are the denominator of both.
    """
    if class_counts is None:
        whole = alignment.withColumns({"denominator": F.col("opportunity_rows"), "denominator_source": F.lit(FROM_ROWS)})
    else:
        total = class_counts.agg(F.coalesce(F.sum(F.when(F.col("traffic_class").isin(*S.OPPORTUNITY_CLASSES), F.col("n_items"))), F.lit(0)).alias("denominator"))
        whole = alignment.join(F.broadcast(total)).withColumn("denominator_source", F.lit(FROM_MANIFEST))  # a row each
    of = lambda n, d: F.when(F.col(d) > 0, n / F.col(d))
    rate = of(F.col("aligned"), "denominator")
    return whole.select(
        rate.alias("given_opportunity"),
        of(F.col("aligned") - F.col("aligned_outside_classes"), "denominator").alias("given_opportunity_in_class"),
        "denominator",
        "denominator_source",
        of(F.col("aligned"), "opportunity_rows").alias("given_opportunity_rows_present"),
        F.col("opportunity_rows").alias("rows_present_denominator"),
        rate.alias("boundary_alignment_rate"),
    )


def both_arms_left(items: DataFrame, done: DataFrame, arms: tuple[str, str] = ("cold", "warm")) -> DataFrame:
    """Items that don't have both arms yet: a pair is run again as a whole."""
    pairs = done.where(F.col("arm").isin(*arms)).groupBy("item_id").agg(F.count_distinct("arm").alias("n")).where("n = 2").select("item_id")
    return items.join(pairs, "item_id", "left_anti")


def arm_named(declared: Column, names: list[tuple[str, str]]) -> Column:
    """The arm that a free text names: of (arm, name) the longest name that stands in it as a word, the first of equally long ones; '' if none does."""
    ordered = sorted(names, key=lambda x: -len(x[1]))  # a stable sort
    found = F.lit("")
    for arm, name in reversed(ordered):
        found = F.when(F.regexp_like(F.lower(declared), F.lit(rf"(?<![a-z0-9])\Q{name.lower()}\E(?![a-z0-9])")), arm).otherwise(found)
    return F.when(declared.isNull(), "").otherwise(found)


def metrics_url(url: Column) -> Column:
    bare = F.regexp_replace(url, "/+$", "")
    return F.when(bare.endswith("/metrics"), bare).otherwise(F.concat(bare, F.lit("/metrics")))


def endpoints(urls: DataFrame, url: str, order: str) -> DataFrame:
    """(url, order): each different endpoint once, by the first that names it."""
    return urls.groupBy(metrics_url(F.col(url)).alias("url")).agg(F.min(order).alias(order))


def model_matches(served: Column, expected: Column) -> Column:
    """Whether one model's name holds the other's, or their last parts are equal but for case; null without an expectation."""
    leaf = lambda x: F.lower(F.element_at(F.split(F.regexp_replace(x, "/+$", ""), "/"), -1))
    same = F.contains(served, expected) | F.contains(expected, served) | (leaf(served) == leaf(expected))
    return F.when(expected.isNotNull(), F.when(F.coalesce(served, F.lit("")) == "", False).otherwise(same))
