"""Per-arm and audit-derived metrics: each is one aggregation over rows, whatever the grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.operators import signals as S
from reprise.operators.signals import rate, rate0

_SUMS = ("prompt_tokens", "total_blocks", "exact_hit_blocks", "exact_hit_tokens", "semantic_candidate_blocks", "semantic_candidate_tokens", "semantic_eligible_blocks", "semantic_eligible_tokens")


def per_arm_aggregates() -> list[Column]:
    negative = F.coalesce("negative_control", F.lit(False))
    placed = F.col("route_outcome") == "semantic_placement"
    planned = F.coalesce("planner_found", F.lit(False)) | (S.zero("semantic_candidate_blocks") > 0) | (S.zero("semantic_eligible_blocks") > 0) | (S.zero("planner_latency_ms") > 0)
    return [
        F.count("*").alias("request_count"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS),
        F.sum("backend_confirmed_blocks").alias("backend_confirmed_blocks"),
        # Measured at all is decided by the blocks.
        F.when(F.count("backend_confirmed_blocks") > 0, F.coalesce(F.sum("backend_confirmed_tokens"), F.lit(0))).alias("backend_confirmed_tokens"),
        F.sum("external_confirmed_tokens").alias("external_confirmed_tokens"),
        F.bool_or(planned).alias("planned"),
        F.count_if(negative).alias("negative_control_count"),
        F.coalesce(F.sum(F.when(negative, F.col("total_blocks"))), F.lit(0)).alias("negative_control_blocks"),
        F.coalesce(F.sum(F.when(negative, F.col("semantic_eligible_blocks"))), F.lit(0)).alias("negative_control_eligible_blocks"),
        F.count_if(negative & placed).alias("negative_control_placements"),
        F.when(F.count("backend_confirmed_blocks") > 0, F.coalesce(F.sum(F.when(negative, F.col("backend_confirmed_blocks"))), F.lit(0))).alias("negative_control_confirmed_blocks"),
        F.count_if(placed).alias("semantic_placements"),
        F.count_if(F.coalesce("planner_found", F.lit(False))).alias("planner_hits"),
        F.avg(F.when(F.col("planner_latency_ms") > 0, F.col("planner_latency_ms"))).alias("mean_planner_latency_ms"),
        F.avg(F.when(~F.isnan("ttft_ms"), F.col("ttft_ms"))).alias("mean_ttft_ms"),
        F.avg(F.col("quality_pass").cast("int")).alias("quality_pass_rate"),
    ]


def with_rates(a: DataFrame) -> DataFrame:
    c = F.col
    exact, eligible = rate0(c("exact_hit_blocks"), c("total_blocks")), rate0(c("semantic_eligible_blocks"), c("total_blocks"))
    confirmed = F.when(c("backend_confirmed_blocks").isNotNull(), rate0(c("backend_confirmed_blocks"), c("total_blocks")))
    return a.select(
        "*",
        exact.alias("exact_block_hit_rate"),
        rate0(c("semantic_candidate_blocks"), c("total_blocks")).alias("semantic_candidate_block_rate"),
        eligible.alias("semantic_eligible_block_rate"),
        confirmed.alias("backend_confirmed_block_rate"),
        F.when(c("planned"), eligible - exact).alias("semantic_eligible_lift"),
        (confirmed - exact).alias("backend_confirmed_lift"),
        rate0(c("exact_hit_tokens"), c("prompt_tokens")).alias("exact_token_rate"),
        rate0(c("semantic_candidate_tokens"), c("prompt_tokens")).alias("semantic_candidate_token_rate"),
        rate0(c("semantic_eligible_tokens"), c("prompt_tokens")).alias("semantic_eligible_token_rate"),
        F.when(c("external_confirmed_tokens").isNotNull(), rate0(c("external_confirmed_tokens"), c("prompt_tokens"))).alias("external_token_rate"),
        rate0(c("negative_control_eligible_blocks"), c("negative_control_blocks")).alias("negative_control_eligible_rate"),
        rate0(c("negative_control_placements"), c("negative_control_count")).alias("negative_control_placement_rate"),
        F.when(c("negative_control_confirmed_blocks").isNotNull(), rate0(c("negative_control_confirmed_blocks"), c("negative_control_blocks"))).alias("negative_control_confirmed_rate"),
        rate0(c("semantic_placements"), c("request_count")).alias("semantic_placement_rate"),
        rate0(c("planner_hits"), c("request_count")).alias("planner_hit_rate"),
    )


def per_arm(rows: DataFrame) -> DataFrame:
    return with_rates(rows.groupBy("arm").agg(*per_arm_aggregates()))


def by_transform(rows: DataFrame) -> DataFrame:
    """Every transform and all together (transform null) in one pass of grouping sets."""
    return with_rates(rows.rollup("transform").agg(*per_arm_aggregates()))


def considered(rows: DataFrame) -> DataFrame:
    return rows.where(S.audit_class() == "considered")


def alignment_aggregates(joined: Column) -> list[Column]:
    """Boundary alignment, with the numerators and denominators of every rate."""
    n = lambda x: F.count_if(x)
    adv, hit, opp = S.advertised_at_boundary(), S.hit_at_boundary(), S.in_opportunity()
    aligned, hits, chances, outside = n(adv), n(hit), n(opp), n(adv & ~opp)
    said = lambda x: F.when(joined, x)
    supplied = F.col("expected_supplied_tokens").isNotNull() & F.col("audit_advertised_tokens").isNotNull()
    agreed = supplied & (F.col("expected_supplied_tokens") == F.col("audit_advertised_tokens"))
    ranked, head = F.count("wrapper_rank"), n(F.col("wrapper_rank") <= S.SHARED_MAX_RANK)
    return [
        F.count("*").alias("rows_considered"),
        said(rate(aligned, hits)).alias("given_match"),
        said(aligned).alias("aligned"),
        hits.alias("lookup_hits"),
        said(rate(aligned, chances)).alias("given_opportunity"),
        said(outside).alias("aligned_outside_classes"),
        said(rate(aligned - outside, chances)).alias("given_opportunity_in_class"),
        chances.alias("opportunity_rows"),
        rate(head, ranked).alias("wrapper_head_share"),
        (rate(head, ranked) > 0.5).alias("wrapper_head_is_majority"),
        said(rate(n(agreed), n(supplied))).alias("supplied_agreement"),
        said(n(agreed)).alias("supplied_agreed"),
        n(supplied).alias("supplied_claims"),
    ]


def reuse_aggregates(joined: Column) -> list[Column]:
    """Materialised share of what was advertised, by tokens and by requests, and the inputs to propagation."""
    said = lambda x: F.when(joined, x)
    advertised = F.col("audit_advertised_tokens").isNotNull()
    made = advertised & F.coalesce("audit_materialized", F.lit(False))
    promised = F.coalesce(F.sum("audit_advertised_tokens"), F.lit(0))
    kept = F.coalesce(F.sum(F.when(made, F.coalesce("external_confirmed_tokens", F.lit(0)))), F.lit(0))
    probe = S.traffic_class() == S.PROBE
    cached = probe & F.col("external_confirmed_tokens").isNull() & (S.zero("backend_confirmed_tokens") > 0)
    return [
        said(rate(kept, promised)).alias("reuse_token_rate"),
        said(kept).alias("reuse_tokens"),
        said(promised).alias("advertised_tokens"),
        said(rate(F.count_if(made), F.count_if(advertised))).alias("reuse_request_rate"),
        said(F.count_if(made)).alias("reuse_requests"),
        F.count_if(advertised).alias("advertised_requests"),
        said(F.coalesce(F.sum("audit_superseded_tokens"), F.lit(0))).alias("superseded_tokens"),
        said(rate(F.count_if(cached), F.count_if(probe))).alias("cached_without_materialization_rate"),
        F.count_if(probe).alias("probes"),
        said(F.coalesce(F.sum("audit_blocks_evicted"), F.lit(0))).alias("blocks_evicted"),
        said(F.count_if(S.zero("audit_blocks_evicted") > 0)).alias("rows_evicting"),
    ]


def presence(rows: DataFrame) -> DataFrame:
    """One row: how many rows audit metrics may be computed over."""
    k = S.audit_class()
    ok = k == "considered"
    any_ = F.coalesce(F.bool_or(ok), F.lit(False))
    return rows.agg(any_.alias("audit_present"), F.when(any_, F.count_if(ok & F.col("audit_joined"))).alias("rows_joined"), F.count_if(ok).alias("rows_considered"), F.count_if(k == "cold_arm").alias("excluded_cold_arm"), F.count_if(k == "not_joined").alias("excluded_not_joined"))


def by_stratum(rows: DataFrame) -> DataFrame:
    """Alignment of the wrapper strata; a stratum without rows is still there."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(s,) for s in S.STRATA], "stratum string")
    got = considered(rows).groupBy(S.wrapper_stratum().alias("stratum")).agg(F.count("*").alias("rows_considered"), F.count_if(S.advertised_at_boundary()).alias("aligned"), F.count_if(S.hit_at_boundary()).alias("lookup_hits"), F.count_if(S.in_opportunity()).alias("opportunity_rows"))
    whole = names.join(got, "stratum", "left").na.fill(0)
    return whole.select("*", rate(F.col("aligned"), F.col("lookup_hits")).alias("given_match"), rate(F.col("aligned"), F.col("opportunity_rows")).alias("given_opportunity"))


def breakdowns(rows: DataFrame) -> DataFrame:
    """(kind, reason, n): why boundaries were missed and how spans were declined, by the last of each request."""
    c = considered(rows)
    miss = c.where(F.col("audit_miss_reason").isNotNull() & (S.zero("audit_missed_at") > 0)).groupBy(F.lit("miss").alias("kind"), F.col("audit_miss_reason").alias("reason"))
    decline = c.where("audit_decline_event IS NOT NULL").groupBy(F.lit("decline").alias("kind"), F.col("audit_decline_event").alias("reason"))
    return miss.agg(F.count("*").alias("n")).union(decline.agg(F.count("*").alias("n")))
