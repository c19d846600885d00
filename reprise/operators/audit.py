"""Folding connector events to one row per request, and joining them to request rows.

All of it is grouped aggregation on request_id: the "last" of something is `max_by` over the order
key (connector, request_seq, event_seq, line), which aggregates partially before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECLINES = ("semantic_span_declined_unaligned_boundary", "semantic_span_declined_below_min_after_clamp", "semantic_span_boundary_missed")
BOUNDARIES = (*DECLINES, "semantic_span_supply_clamped", "semantic_span_load_advertised")
SKIPPED = "lookup_skipped_"

_PAYLOAD = "already_computed_tokens string, reusable_tokens string, boundary string, token_count string, target_start string, tokens string, blocks_evicted string, prompt_tokens string, declined_reason string, stored_donor_tokens string, n_segments string, n_raw_segments string, segments_beyond_capture string, segments_wrong_donor string, snapped_spans string"


def number(x: Column) -> Column:
    """A whole number out of JSON text: truth values and fractions in quotes are none, plain fractions lose their rest."""
    return F.when(F.regexp_like(x, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.try_to_number(F.trim(x), F.lit("S999999999999999999")).cast("bigint")).when(F.regexp_like(x, F.lit(r"^-?[0-9]+\.[0-9]+$")), F.regexp_extract(x, r"^(-?[0-9]+)", 1).cast("bigint"))


def order_key() -> Column:
    return F.struct("connector_id", F.coalesce("request_seq", F.lit(-1)).alias("r"), F.coalesce("event_seq", F.lit(-1)).alias("e"), "line_id")


def payloads(events: DataFrame) -> DataFrame:
    """Events with the payload's known fields as columns; an unreadable payload has none."""
    p = F.from_json("payload", _PAYLOAD)
    fields = [x.split()[0] for x in _PAYLOAD.split(", ")]
    plain = [F.col(f"p.{f}").alias(f) if f in ("declined_reason", "snapped_spans") else number(F.col(f"p.{f}")).alias(f) for f in fields]
    return events.withColumn("p", p).select("line_id", "event", "connector_id", "request_id", "request_seq", "event_seq", *plain)


def miss_reason() -> Column:
    """Cause of a missed boundary, the first that applies."""
    c = F.col
    spans = F.when(c("snapped_spans").startswith("["), F.json_array_length("snapped_spans"))
    some = lambda x: F.coalesce(c(x), F.lit(0))
    return (
        F.when(c("stored_donor_tokens").isNull() & c("n_raw_segments").isNull() & spans.isNull() & c("segments_beyond_capture").isNull(), "unclassified")
        .when(c("stored_donor_tokens") == 0, "donor_not_captured")
        .when(some("segments_beyond_capture") > 0, "donor_too_short")
        .when(c("segments_beyond_capture").isNull() & (c("n_raw_segments") == 0) & (some("n_segments") > 0) & (some("segments_wrong_donor") == 0), "donor_too_short")
        .when((some("n_raw_segments") > 0) & (F.coalesce(spans, F.lit(0)) == 0), "below_min_semantic_span")
        .otherwise("true_misalignment")
    )


def fold(events: DataFrame) -> DataFrame:
    """One row per request_id. Only materialisations at or after the last advertise count as kept; earlier ones are superseded.

    Events without a request_id concern no request and are left out.
    """
    e = payloads(events).where("request_id IS NOT NULL").withColumn("o", order_key())
    is_ = lambda *names: F.col("event").isin(*names)
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("o")))
    adv, mat, hit, miss = (is_(x) for x in ("semantic_span_load_advertised", "runtime_materialized", "semantic_lookup_hit", "semantic_span_boundary_missed"))
    n = lambda x: F.coalesce(F.col(x), F.lit(0))
    ads = e.where(adv).groupBy("request_id").agg(F.max_by("line_id", "o").alias("advertised_line"))
    named = lambda col, when, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("o", value.alias("v"))))), lambda x: x.v), ",").alias(col)
    kept = F.col("line_id") >= F.coalesce("advertised_line", F.lit(-1))
    rows = e.join(ads, "request_id", "left").groupBy("request_id").agg(
        F.bool_or(is_("request_first_seen")).alias("first_seen"),
        last(F.struct("prompt_tokens"), is_("request_first_seen")).prompt_tokens.alias("prompt_tokens"),
        last(F.struct("boundary"), adv).boundary.alias("advertised_boundary"),
        last(F.struct("target_start"), adv).target_start.alias("advertised_target_start"),
        last(n("token_count"), adv).alias("advertised_tokens"),
        F.count_if(adv).alias("advertise_count"),
        F.count_if(hit).alias("lookup_hits"),
        last(F.struct("already_computed_tokens"), hit).already_computed_tokens.alias("hit_boundary"),
        last(F.struct("reusable_tokens"), hit).reusable_tokens.alias("reusable_tokens"),
        F.count_if(miss).alias("boundary_missed_count"),
        last(F.struct("boundary"), miss).boundary.alias("missed_at"),
        last(miss_reason(), miss).alias("miss_reason"),
        last(F.col("event"), is_(*DECLINES)).alias("decline_event"),
        last(F.col("boundary"), is_(*BOUNDARIES) & F.col("boundary").isNotNull()).alias("last_span_boundary"),
        F.sum(F.when(is_("load_allocated"), n("tokens"))).alias("allocated_tokens"),
        F.when(F.count_if(mat) > 0, F.coalesce(F.sum(F.when(mat & kept, n("tokens"))), F.lit(0))).alias("materialized_tokens"),
        F.coalesce(F.sum(F.when(mat & ~kept, n("tokens"))), F.lit(0)).alias("superseded_tokens"),
        named("declined_reasons", is_("runtime_materialization_declined"), F.coalesce(F.nullif("declined_reason", F.lit("")), F.lit("unspecified"))),
        named("lookup_skipped", F.col("event").startswith(SKIPPED), F.substring("event", F.lit(len(SKIPPED) + 1), F.length("event"))),
        F.coalesce(F.sum(F.when(is_("prefix_cache_blocks_evicted"), n("blocks_evicted"))), F.lit(0)).alias("prefix_blocks_evicted"),
        F.count("*").alias("event_count"),
    )
    # One id for two arrivals: a connector saw it with more than one request_seq.
    reused = e.groupBy("request_id", "connector_id").agg((F.countDistinct("request_seq") > 1).alias("x")).groupBy("request_id").agg(F.bool_or("x").alias("request_id_reused"))
    observed = F.when(F.col("advertise_count") > 0, F.col("advertised_boundary")).otherwise(F.col("last_span_boundary"))
    out = rows.join(reused, "request_id").withColumn("observed_boundary", observed)
    return out.withColumn("hit_boundary", F.when(F.col("lookup_hits") > 0, F.coalesce("hit_boundary", "observed_boundary")))


def normalized_ids(engine_id: Column) -> Column:
    """Ids that a client may have sent for an engine's id: without the handler's prefix, the random
    suffix, the sub-request suffix, in every combination; not the id itself."""
    base = F.array_distinct(F.array(engine_id, F.regexp_replace(engine_id, "^chatcmpl-", ""), F.regexp_replace(engine_id, "^cmpl-", "")))
    bare = F.array_union(base, F.transform(base, lambda x: F.regexp_replace(x, "-[0-9a-f]{8}$", "")))
    every = F.array_union(bare, F.transform(bare, lambda x: F.regexp_replace(x, r"[-_]\d+$", "")))
    return F.array_sort(F.filter(every, lambda x: (x != "") & (x != engine_id)))


def resolve(ids: DataFrame, folded: DataFrame) -> DataFrame:
    """(engine_request_id, match, audited_id): exact, else a unique normalized match, else ambiguous or missing."""
    audited = folded.select("request_id")
    loose = audited.select(F.explode(normalized_ids(F.col("request_id"))).alias("client_id"), "request_id").groupBy("client_id").agg(F.count("*").alias("n"), F.min("request_id").alias("only"))
    exact = ids.select("engine_request_id").join(audited.select(F.col("request_id").alias("exact")), F.col("engine_request_id") == F.col("exact"), "left")
    both = exact.join(loose, F.col("engine_request_id") == F.col("client_id"), "left")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "normalized").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return both.select("engine_request_id", kind.alias("match"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("audited_id"))


def stamp(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """Request rows with what the audit says about them; unmatched ones stay, with audit_joined false."""
    facts = folded.select(
        F.col("request_id").alias("audited_id"),
        F.col("observed_boundary").alias("audit_observed_boundary"),
        F.when(F.col("advertise_count") > 0, F.col("advertised_tokens")).alias("audit_advertised_tokens"),
        F.col("advertised_target_start").alias("audit_advertised_target_start"),
        F.col("allocated_tokens").isNotNull().alias("audit_load_allocated"),
        F.col("materialized_tokens").isNotNull().alias("audit_materialized"),
        F.col("materialized_tokens").alias("_materialized"),
        (F.col("lookup_hits") > 0).alias("audit_lookup_hit"),
        F.col("hit_boundary").alias("audit_hit_boundary"),
        F.col("miss_reason").alias("audit_miss_reason"),
        F.col("missed_at").alias("audit_missed_at"),
        F.col("decline_event").alias("audit_decline_event"),
        F.col("superseded_tokens").alias("audit_superseded_tokens"),
        F.col("prefix_blocks_evicted").alias("audit_blocks_evicted"),
        "request_id_reused",
    )
    out = rows.join(resolve(rows, folded), "engine_request_id").join(facts, "audited_id", "left")
    confirmed = F.coalesce("_materialized", "external_confirmed_tokens")
    return out.withColumn("audit_joined", F.col("audited_id").isNotNull()).withColumn("external_confirmed_tokens", confirmed).drop("_materialized")


def id_echo(rows: DataFrame) -> DataFrame:
    """One row: how often the engine returned a form of the id that was sent."""
    seen = (F.coalesce("engine_response_id", F.lit("")) != "") & (F.coalesce("engine_request_id", F.lit("")) != "")
    same = (F.col("engine_response_id") == F.col("engine_request_id")) | F.array_contains(normalized_ids(F.col("engine_response_id")), F.col("engine_request_id"))
    return rows.agg(F.count_if(seen).alias("rows_checked"), F.count_if(seen & same).alias("rows_echoed"), F.count_if(seen & ~same).alias("rows_mismatched"), F.count_if(~seen).alias("rows_without_response_id"))
