"""Joining cold and warm arms into pairs, with an account of everything left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions.selection import exact_percentiles
from reprise.operators import signals as S
from reprise.session import materialise

FINGERPRINT = ("dataset", "transform", "negative_control", "donor_count", "total_blocks")


def _one_per_item(rows: DataFrame, pick) -> DataFrame:
    """One row per item and arm, by the least or greatest ordinal: partial aggregation, no window."""
    cols = [c for c in rows.columns if c not in ("item_id", "arm", "ordinal")]
    return rows.groupBy("item_id", "arm").agg(pick(F.struct(*cols, "ordinal"), "ordinal").alias("r")).select("item_id", "arm", "r.*")


def first_rows(rows: DataFrame) -> DataFrame:
    return _one_per_item(rows, F.min_by)


def last_rows(rows: DataFrame) -> DataFrame:
    return _one_per_item(rows, F.max_by)


def sides(rows: DataFrame, how: str) -> DataFrame:
    """(item_id, cold, warm) with each side as a struct."""
    arm = lambda x: rows.where(F.col("arm") == x).select("item_id", F.struct(*[c for c in rows.columns if c != "item_id"]).alias(x))
    return arm("cold").join(arm("warm"), "item_id", how)


def join_arms(rows: DataFrame) -> DataFrame:
    """(item_id, status): paired, mismatch (other fingerprint), only_cold, only_warm; the first row of an item counts."""
    both = sides(first_rows(rows.select("item_id", "arm", "ordinal", *FINGERPRINT)).drop("ordinal"), "full")
    same = F.lit(True)
    for c in FINGERPRINT:
        same = same & F.col(f"cold.{c}").eqNullSafe(F.col(f"warm.{c}"))
    status = F.when(F.col("warm").isNull(), "only_cold").when(F.col("cold").isNull(), "only_warm").when(same, "paired").otherwise("mismatch")
    return both.select("item_id", status.alias("status"))


def duplicates(rows: DataFrame) -> DataFrame:
    """Items that stand several times in an arm, with the first place."""
    return rows.groupBy("arm", "item_id").agg(F.count("*").alias("n"), F.min("ordinal.started_at").alias("first_at")).where("n > 1")


#: What pairs are classified and summed up by; only these columns, and those asked for, are shuffled.
PAIR_COLUMNS = (
    "transform", "traffic_class", "negative_control", "flush_contaminated", "error", "stream_position", "ttft_ms", "queue_time_ms", "prompt_tokens",
    "external_confirmed_tokens", "fuzzy_confirmed_tokens", "backend_confirmed_tokens", "audit_materialized", "audit_joined", "audit_advertised_tokens",
)


def pairs(rows: DataFrame, *also: str) -> DataFrame:
    """Cold rows with their warm twins and the reason, if any, why the pair is not clean. The last row of an item counts.

    Rows have `PAIR_COLUMNS` as far as they are there, and the columns in `also`.
    """
    wanted = [c for c in (*PAIR_COLUMNS, *also) if c in rows.columns]
    both = sides(last_rows(rows.select("item_id", "arm", "ordinal", *wanted)).drop("ordinal"), "left")
    error = lambda x: F.coalesce(F.col(f"{x}.error"), F.lit("")) != ""
    moved = F.col("cold.stream_position") != F.col("warm.stream_position")
    status = (
        F.when(F.col("warm").isNull(), "unpaired")
        .when(F.coalesce("cold.flush_contaminated", F.lit(False)), "contaminated")
        .when(error("cold") | error("warm"), "errored")
        .when(F.coalesce(moved, F.lit(False)), "moved")
        .otherwise("clean")
    )
    return both.withColumn("status", status)


def _given(x: str) -> Column:
    """A time that was measured: not null, not NaN, not 0."""
    return F.coalesce((F.col(x) != 0) & ~F.isnan(x), F.lit(False))


def timed(paired: DataFrame) -> DataFrame:
    """Clean pairs, flat, with what the summary needs; `timed` says whether both times were measured."""
    warm = paired.where("status = 'clean'").select("item_id", "cold", "warm", "warm.*")
    return warm.select(
        "item_id",
        F.coalesce("cold.negative_control", F.lit(False)).alias("control"),
        (_given("cold.ttft_ms") & _given("warm.ttft_ms")).alias("timed"),
        F.col("cold.ttft_ms").alias("cold_ms"),
        F.col("warm.ttft_ms").alias("warm_ms"),
        (F.col("cold.ttft_ms") / F.col("warm.ttft_ms")).alias("ratio"),
        S.is_hit().alias("hit"),
        (S.zero("backend_confirmed_tokens") >= S.HIT_TOKENS).alias("legacy_hit"),
        S.mechanism().alias("mechanism"),
        S.traffic_class().alias("traffic_class"),
        F.col("cold.queue_time_ms").alias("cold_queue_ms"),
        F.col("warm.queue_time_ms").alias("warm_queue_ms"),
    )


def answers(paired: DataFrame) -> DataFrame:
    """(item_id, cold_text, warm_text) of clean pairs that both have an answer; pairs made with output_text."""
    a = paired.where("status = 'clean'").select("item_id", F.col("cold.output_text").alias("cold_text"), F.col("warm.output_text").alias("warm_text"))
    return a.where("cold_text <> '' AND warm_text <> ''")


def status_counts(paired: DataFrame) -> DataFrame:
    return paired.groupBy("status").agg(F.count("*").alias("n_pairs"))


def _with_percentiles(flat: DataFrame, counts: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """`counts` (one row) with exact percentiles: name -> (value, null where it doesn't count; p)."""
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), x.cast("double").alias("v")) for name, (x, _) in wanted.items()))).alias("m")
    values = flat.select(named).select("m.name", "m.v")
    levels = sorted({p for _, p in wanted.values()})
    found = exact_percentiles(values, "name", "v", {f"q{i}": p for i, p in enumerate(levels)})
    # A handful of rows, one per name, turned into one.
    wide = found.agg(*(F.max(F.when(F.col("name") == name, F.col(f"q{levels.index(p)}"))).alias(name) for name, (_, p) in wanted.items()))
    return counts.join(F.broadcast(wide))


def summary(flat: DataFrame) -> DataFrame:
    """One row: times per arm, speedups of blended, hit-only and control pairs, hit accounting."""
    flat = materialise(flat)
    t, blended, control = F.col("timed"), F.col("timed") & ~F.col("control"), F.col("timed") & F.col("control")
    any_hit = F.coalesce("hit", "legacy_hit")
    when = lambda c, x: F.when(c, F.col(x))
    mean = lambda x, c: F.avg(F.when(c, F.col(x)))
    n = F.count_if
    counts = flat.agg(
        n(t).alias("pairs_used"),
        mean("ratio", blended).alias("blended_mean"),
        S.rate(n(blended & any_hit), n(blended)).alias("hit_rate"),
        S.rate(n(blended & F.coalesce("hit", F.lit(False))), n(blended & F.col("hit").isNotNull())).alias("hit_rate_confirmed"),
        n(blended & F.col("hit").isNotNull()).alias("pairs_confirmed"),
        n(blended & F.col("hit").isNull()).alias("pairs_unconfirmed"),
        n(blended & F.col("hit").isNull() & F.col("legacy_hit")).alias("hits_unverified"),
        mean("ratio", blended & any_hit).alias("hit_only_mean"),
        n(control).alias("control_pairs"),
        mean("ratio", control).alias("control_mean"),
    )
    wanted = {
        "cold_p50_ms": (when(t, "cold_ms"), 0.5),
        "cold_p95_ms": (when(t, "cold_ms"), 0.95),
        "warm_p50_ms": (when(t, "warm_ms"), 0.5),
        "warm_p95_ms": (when(t, "warm_ms"), 0.95),
        "blended_median": (when(blended, "ratio"), 0.5),
        "hit_only_median": (when(blended & any_hit, "ratio"), 0.5),
        "control_median": (when(control, "ratio"), 0.5),
        "cold_queue_p50_ms": (F.col("cold_queue_ms"), 0.5),
        "warm_queue_p50_ms": (F.col("warm_queue_ms"), 0.5),
    }
    return _with_percentiles(flat, counts, wanted)


def miss_tax(paired: DataFrame, capture: bool = False) -> DataFrame:
    """One row: median warm minus median cold time of pairs that the audit measured and that were promised nothing.

    Everything is null where no clean warm row had an audit read for it; `capture` restricts the
    population to traffic without reuse.
    """
    w = paired.where("status = 'clean'").select(F.coalesce("cold.negative_control", F.lit(False)).alias("control"), F.col("cold.ttft_ms").alias("cold_ms"), (_given("cold.ttft_ms") & _given("warm.ttft_ms")).alias("timed"), "warm.*")
    w = materialise(w)
    measured = ~F.col("control") & F.coalesce("audit_joined", F.lit(False))
    silent = measured & (S.zero("audit_advertised_tokens") == 0)
    missed = silent & (S.traffic_class() == S.NO_REUSE) if capture else silent
    used = missed & F.col("timed")
    joined = F.coalesce(F.bool_or(F.col("audit_joined").isNotNull()), F.lit(False))
    said = lambda x: F.when(joined, x)
    counts = w.agg(
        joined.alias("joined"),
        said(F.count_if(used)).alias("pairs"),
        said(F.count_if(missed & ~F.col("timed"))).alias("pairs_without_times"),
        said(F.count_if(measured & ~silent)).alias("pairs_advertising"),
        said(F.count_if(~F.col("control") & ~F.coalesce("audit_joined", F.lit(False)))).alias("pairs_not_audited"),
        said(F.count_if(silent & ~missed)).alias("pairs_outside_class"),
        F.count_if("control").alias("pairs_control"),
    )
    value = lambda x: F.when(used, x)
    wanted = {"warm_p50_ms": (value(F.col("ttft_ms")), 0.5), "cold_p50_ms": (value(F.col("cold_ms")), 0.5), "median_of_differences_ms": (value(F.col("ttft_ms") - F.col("cold_ms")), 0.5)}
    out = _with_percentiles(w, counts, wanted).withColumn("miss_tax_ms", F.col("warm_p50_ms") - F.col("cold_p50_ms"))
    measures = ("miss_tax_ms", *wanted)
    return out.select(*(F.when(F.col("joined"), F.col(m)).alias(m) for m in measures), *(c for c in counts.columns if c != "joined"))


def propagation(paired: DataFrame, warm: DataFrame, similarity) -> DataFrame:
    """(status, n): what became of each clean probe pair.

    A probe names a parent item; it is propagated if its warm answer is more similar to what the
    parent was served in the warm arm than to its own cold answer. `similarity` is a function of two
    columns. The rest is left out for the first reason that applies: unlinked, no_served_answer,
    no_warm_answer, no_cold_answer; pairs that are not clean are counted as unclean.
    """
    probe = F.coalesce(F.nullif("cold.traffic_class", F.lit("")), F.nullif("cold.transform", F.lit("")), F.lit("")) == S.PROBE
    p = paired.where(probe).select("item_id", "status", F.coalesce(F.nullif("warm.parent_item_id", F.lit("")), F.nullif("cold.parent_item_id", F.lit(""))).alias("parent"), F.nullif("warm.output_text", F.lit("")).alias("warm_text"), F.nullif("cold.output_text", F.lit("")).alias("cold_text"))
    served = warm.select(F.col("item_id").alias("parent"), F.nullif("output_text", F.lit("")).alias("served"))
    j = p.join(served, "parent", "left")
    status = (
        F.when(F.col("status") != "clean", "unclean")
        .when(F.col("parent").isNull(), "unlinked")
        .when(F.col("served").isNull(), "no_served_answer")
        .when(F.col("warm_text").isNull(), "no_warm_answer")
        .when(F.col("cold_text").isNull(), "no_cold_answer")
    )
    scored = j.withColumn("out", status).withColumn("a", similarity("warm_text", "served")).withColumn("b", similarity("warm_text", "cold_text"))
    return scored.groupBy(F.coalesce("out", F.when(F.col("a") > F.col("b"), "propagated").otherwise("kept")).alias("status")).agg(F.count("*").alias("n"))
