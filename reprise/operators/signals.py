"""What a request row says about reuse. Null is "not measured" and never turned into zero unasked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT_TOKENS = 64
# Names of traffic classes, strata and mechanisms.
OPPORTUNITY_CLASSES = ("same_doc_new_instruction", "revised_doc")
NO_REUSE = "no_reuse"
PROBE = "propagation_probe"
SHARED_MAX_RANK = 1
STRATA = ("shared_wrapper", "ad_hoc", "unstratified")


def zero(name: str) -> Column:
    """A column whose null counts as nothing, where the rule says so."""
    return F.coalesce(F.col(name), F.lit(0))


def traffic_class() -> Column:
    return F.coalesce(F.nullif("traffic_class", F.lit("")), F.nullif("transform", F.lit("")), F.lit(""))


def semantic_tokens() -> Column:
    """Tokens reused by meaning; a row that the audit saw without any is a measured zero, one it did not see is null."""
    fuzzy = zero("fuzzy_confirmed_tokens")
    unmeasured = F.when(F.col("audit_materialized") == F.lit(False), fuzzy).otherwise(F.nullif(fuzzy, F.lit(0)))
    return F.when(F.col("external_confirmed_tokens").isNull(), unmeasured).otherwise(F.greatest("external_confirmed_tokens", fuzzy))


def is_hit() -> Column:
    return semantic_tokens() >= HIT_TOKENS


def mechanism() -> Column:
    """How a row reused, the first that applies."""
    fuzzy, external, prefix = zero("fuzzy_confirmed_tokens"), zero("external_confirmed_tokens"), zero("backend_confirmed_tokens")
    return F.when(fuzzy > prefix, "scatter").when(fuzzy > 0, "head").when(external >= HIT_TOKENS, "external").when(prefix >= HIT_TOKENS, "exact").otherwise("none")


def wrapper_stratum() -> Column:
    return F.when(F.col("wrapper_rank").isNull(), STRATA[2]).when(F.col("wrapper_rank") <= SHARED_MAX_RANK, STRATA[0]).otherwise(STRATA[1])


def advertised_at_boundary() -> Column:
    return (zero("audit_advertised_tokens") > 0) & (zero("audit_observed_boundary") > 0)


def hit_at_boundary() -> Column:
    return F.coalesce("audit_lookup_hit", F.lit(False)) & (zero("audit_hit_boundary") > 0)


def in_opportunity() -> Column:
    return traffic_class().isin(*OPPORTUNITY_CLASSES)


def audit_class() -> Column:
    """Why a row is left out of audit metrics: the cold arm first, then rows no audit was read for."""
    return F.when(F.col("arm") == "cold", "cold_arm").when(F.col("audit_joined").isNull(), "not_joined").otherwise("considered")


def rate(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(whole > 0, part / whole)


def rate0(part: Column, whole: Column) -> Column:
    """0.0 where there is nothing to divide by: the older rates' rule."""
    return F.when(whole != 0, part / whole).otherwise(0.0)
