"""Engine logs and counter pages: patterns over lines, then counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What engines write, by engine and kind of event; group 1 is the number of tokens.
PATTERNS = {
    "connector": {
        "donor_registered": r"donor registered request_id=\S+ namespace=\S+ tokens=(\d+) blocks=\d+",
        "semantic_hit": r"semantic lookup hit request_id=\S+ donor_id=\S+ similarity=[0-9.]+ kind=\S+ reusable_tokens=(\d+) reason=\S+",
        "advertised": r"load advertised request_id=\S+ donor_id=\S+ tokens=(\d+)",
        "materializing": r"materializing request_id=\S+ donor_id=\S+ tokens=(\d+)",
        "materialized": r"materialized request_id=\S+ donor_id=\S+ tokens=(\d+)",
    },
    "fuzzy": {
        "donor_registered": r"(?i)(?:\[FUZZY\]\s*)?register_donor(?:_async)?:\s*ok request_id=\S+.*?tokens=(\d+)",
        "semantic_hit": r"(?i)(?:semantic|fuzzy).*?(?:hit|matched).*?(?:similarity|score)=[0-9.]+.*?(?:tokens|matched_tokens|reused_tokens)=(\d+)",
        "radix_hit": r"(?i)\[FUZZY RADIX\]\s*Fuzzy match success:.*?cached=(\d+)",
        "realized": r"(?i)\[FUZZY\]\s*Realized\s+(\d+)\s+fuzzy tokens",
        "segmented": r"(?i)\[FUZZY RADIX\]\s*segmented prefill realized donor phase:.*?donor_tokens=(\d+)\s+target=\[\d+,\d+\).*?direct_paged_kv=\S+",
    },
    "exact": {
        "retrieved": r"(?i)(?:Retrieved|Reusing)\s+(\d+)(?:\s*(?:/|out of(?: total)?)\s*\d+)?\s*tokens",
        "stored": r"(?i)Stor(?:ed|ing)\s+(\d+)(?:\s+out of total\s+\d+)?\s+(?:new\s+)?tokens",
        "hit": r"(?i)(?:cache\s+hit|lookup\s+hit|cache hit tokens|hit tokens).*?[=:\s](\d+)",
    },
}
WARNINGS = ("[E:onnxruntime:", "Non-zero status code returned", "Shape mismatch attempting to re-use buffer")


def line_class(line: Column) -> Column:
    """error, warning or null; an error is never also a warning."""
    warned = F.lit(False)
    for w in WARNINGS:
        warned = warned | line.contains(w)
    return F.when(line.contains("ERROR") | line.contains("Traceback"), "error").when(warned, "warning")


def log_summary(lines: DataFrame, engine: str, keys: list[str] | None = None) -> DataFrame:
    """Counts and token sums of each kind of event in `lines(line, ...)`, errors and warnings.

    One pass: every pattern is one expression, all of them aggregated together. For `fuzzy` engines
    segmented phases count as materialisations if there are any, else realised lines.
    """
    found = {k: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).cast("bigint") for k, p in PATTERNS[engine].items()}
    flat = lines.select(*(keys or []), *(x.alias(k) for k, x in found.items()), line_class(F.col("line")).alias("_class"))
    sums = [c for k in found for c in (F.count(k).alias(f"{k}_events"), F.coalesce(F.sum(k), F.lit(0)).alias(f"{k}_tokens"))]
    out = flat.groupBy(*(keys or [])).agg(*sums, F.count_if(F.col("_class") == "error").alias("errors"), F.count_if(F.col("_class") == "warning").alias("warnings"))
    if engine == "fuzzy":
        use = lambda k: F.when(F.col("segmented_events") > 0, F.col(f"segmented_{k}")).otherwise(F.col(f"realized_{k}"))
        out = out.withColumn("materialized_events", use("events")).withColumn("materialized_tokens", use("tokens"))
    if engine == "exact":
        out = out.withColumn("materialized_events", F.col("retrieved_events")).withColumn("materialized_tokens", F.col("retrieved_tokens"))
    return out


def decision_summary(lines: DataFrame) -> DataFrame:
    """Summary of a JSON decision log `lines(line)`; undecodable lines are warnings if marked, else errors."""
    text = F.trim("line")
    e = F.from_json(text, "event string, found boolean, materialized bigint, requires_rope_correction boolean, rejection_reason string", {"mode": "PERMISSIVE"})
    ok = F.get_json_object(text, "$").isNotNull()
    rows = lines.where(text != "").select(ok.alias("ok"), e.alias("e"), line_class(F.col("line")).alias("c"))
    name = F.coalesce(F.nullif("e.event", F.lit("")), F.lit("unknown"))
    warned = F.col("c") == "warning"
    return rows.agg(
        F.count_if(F.col("ok") & (name == "donor_registered")).alias("donor_registrations"),
        F.count_if(F.col("ok") & (name == "lookup") & F.coalesce("e.found", F.lit(False))).alias("semantic_hits"),
        F.count_if(F.col("ok") & (name == "materialized")).alias("materialization_events"),
        F.coalesce(F.sum(F.when(F.col("ok") & (name == "materialized"), F.col("e.materialized"))), F.lit(0)).alias("materialized_units"),
        F.count_if(F.col("ok") & (name == "materialized") & F.coalesce("e.requires_rope_correction", F.lit(False))).alias("rope_corrections"),
        F.count_if(F.col("ok") & (name == "engine_blend_boundary")).alias("engine_boundaries"),
        F.count_if(F.col("ok") & (F.coalesce("e.rejection_reason", F.lit("")) != "")).alias("rejections"),
        F.count_if(~F.col("ok") & ~F.coalesce(warned, F.lit(False))).alias("errors"),
        F.count_if(~F.col("ok") & warned).alias("warnings"),
    )


# A sample line of the text exposition, and a label.
_SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?[ \t]+(\S+)(?:[ \t]+\S+)?[ \t]*$"
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def samples(lines: DataFrame) -> DataFrame:
    """(name, labels, value) of every sample in a text exposition's `line`s; what is no sample is skipped."""
    text = F.trim(F.col("line"))
    part = lambda i: F.regexp_extract(text, _SAMPLE, i)
    value = F.expr("try_cast(v AS DOUBLE)")
    plain = F.transform(F.regexp_extract_all("l", F.lit(_LABEL), F.lit(2)), lambda x: F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))
    rows = lines.where(~text.startswith("#") & F.regexp_like(text, F.lit(_SAMPLE))).select(*[c for c in lines.columns if c != "line"], part(1).alias("name"), part(2).alias("l"), part(3).alias("v"))
    return rows.withColumn("value", value).where("value IS NOT NULL").withColumn("labels", F.map_from_arrays(F.regexp_extract_all("l", F.lit(_LABEL), F.lit(1)), plain)).drop("l", "v")


def counter(name: str, **labels: str) -> Column:
    """Sum of a counter over its label sets, with or without _total; null where it is absent."""
    wanted = F.col("name").isin(name, f"{name}_total")
    for k, v in labels.items():
        wanted = wanted & (F.col("labels")[k] == v)
    return F.sum(F.when(wanted, F.col("value")))


def counter_deltas(before: DataFrame, after: DataFrame, counters: list[str]) -> DataFrame:
    """Per url: differences of two snapshots (url, error, counters...); null for counters that either lacks.

    A url that either side lacks, or whose scrape failed, is `paired = false`. A negative difference
    is a restarted server: it is shown, not clamped.
    """
    a = before.select("url", F.struct("*").alias("a"))
    b = after.select("url", F.struct("*").alias("b"))
    both = a.join(b, "url", "full")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a.error").isNull() & F.col("b.error").isNull()
    return both.select("url", ok.alias("paired"), *(F.when(ok, F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in counters))


def fleet_delta(deltas: DataFrame, hits: str, queries: str, counters: list[str]) -> DataFrame:
    total = deltas.agg(*(F.sum(c).alias(c) for c in counters), F.count_if("paired").alias("endpoints_paired"), F.count_if(~F.col("paired")).alias("endpoints_failed"), F.coalesce(F.bool_or(F.least(*counters) < 0) if len(counters) > 1 else F.bool_or(F.col(counters[0]) < 0), F.lit(False)).alias("reset"))
    return total.withColumn("hit_ratio", F.when(F.col(queries) > 0, F.col(hits) / F.col(queries)))
