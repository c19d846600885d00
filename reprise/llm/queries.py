"""Queries of the text operators, and the SQL they are checked against."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm import langid, leaks, neardup, pack, pairs, quantiles, spans, split
from reprise.llm.sql import ORACLES  # noqa: F401
from reprise.session import table


#: Rank error of digests that are compressed at any size of the tables.
COARSE = 0.05


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over their limit, with the level at which they can be cut."""
    return split.oversized(p3_pieces(spark, sf_dir))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_records(table(spark, sf_dir, "source_records"), table(spark, sf_dir, "transform_configs"))


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's text put together again out of its pieces, and whether they keep limit and overlap."""
    return split.rebuilt(p3_pieces(spark, sf_dir), table(spark, sf_dir, "source_records"), table(spark, sf_dir, "transform_configs"))


def p4_daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ttft_ms per dataset, transform and day."""
    return quantiles.digests(quantiles.request_times(table(spark, sf_dir, "request_metrics")), ["dataset", "transform", "day"], "ttft_ms")


def p4_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of ttft_ms per dataset, transform and day."""
    return quantiles.percentiles(p4_daily_digest(spark, sf_dir), ["dataset", "transform", "day"])


def p4_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of ttft_ms per dataset and transform, out of the days' digests."""
    keys = ["dataset", "transform"]
    return quantiles.percentiles(quantiles.merge(p4_daily_digest(spark, sf_dir), keys), keys)


def p4_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether digests of so coarse a rank error that they are compressed keep it, per dataset and over all; out of days' digests."""
    times = quantiles.request_times(table(spark, sf_dir, "request_metrics")).select(F.explode(F.array(F.lit("all"), F.concat(F.lit("dataset "), "dataset"))).alias("scope"), "day", "ttft_ms")
    digest = quantiles.merge(quantiles.digests(times, ["scope", "day"], "ttft_ms", COARSE), ["scope"], COARSE)
    checked = quantiles.rank_check(times, digest, "scope", "ttft_ms", COARSE)
    return checked.withColumn("compressed", F.when(F.col("scope") == "all", F.col("n_nodes") < F.col("n_leaves"))).drop("n_nodes", "n_leaves")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's, or piece's, container for each budget."""
    return pack.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_budgets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that exceed a budget's capacity by themselves."""
    return pack.oversized(p7_packed(spark, sf_dir))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_packed(spark, sf_dir).groupBy("budget_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_pieces"), F.sum("tokens").alias("n_tokens"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used by each budget against the fewest possible."""
    return pack.fill_report(p7_packed(spark, sf_dir), table(spark, sf_dir, "pack_budgets"))


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them, and where."""
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.in_runs(p8_matches(spark, sf_dir)).select("doc_id", "eval_id").distinct()


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_documents(p8_matches(spark, sf_dir))


def p8_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in runs of five words, and those that only seeds with gaps find."""
    return leaks.seed_gain(p8_matches(spark, sf_dir))


def _item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipient prompt and donor texts of items; those of repeated rows come as often."""
    items = table(spark, sf_dir, "workload_items").select("item_id", "recipient_prompt", "donor_prompts")
    own = items.select(F.col("item_id").alias("record_id"), F.lit("recipient").alias("part"), F.col("recipient_prompt").alias("text"))
    donors = items.select(F.col("item_id").alias("record_id"), F.posexplode("donor_prompts").alias("n", "d"))
    return own.union(donors.select("record_id", F.concat(F.lit("donor "), "n"), "d.text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose prompts or donor texts share a stretch of 240 characters."""
    return spans.SharedSpans(_item_texts(spark, sf_dir)).record_pairs().toDF("item_id_a", "item_id_b")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each prompt and donor text, how much other items hold too."""
    return spans.SharedSpans(_item_texts(spark, sf_dir)).coverage()


def p1_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared stretches between classes of equal texts, with offsets."""
    found = spans.SharedSpans(_item_texts(spark, sf_dir)).stretches
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("text_a", "text_b")})


def p1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of prompts and donor texts; all but the earliest of equal ones are marked for removal."""
    return spans.line_units(_item_texts(spark, sf_dir).dropDuplicates(["record_id", "part"]), "line", least=20)


def _prompts(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    items = table(spark, sf_dir, "workload_items").select(F.col("item_id").alias("id"), F.col("recipient_prompt").alias("text"))
    return neardup.NearDuplicates(items, words=3, similarity=Fraction(3, 5))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose prompts share 0.6 of their sequences of three words."""
    return _prompts(spark, sf_dir).pairs().toDF("item_id_a", "item_id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its class, its group of near-duplicates and its number of links."""
    return _prompts(spark, sf_dir).groups()


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, confidence and stretches."""
    documents = table(spark, sf_dir, "documents")
    return langid.label_documents(documents, langid.fit(langid.sample_texts(documents)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong, or that mix languages."""
    return langid.wrong_labels(p9_languages(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective outputs of requests and first answers of items, with the kind of defect."""
    items = table(spark, sf_dir, "workload_items").select("item_id", "input", "answers", "recipient_prompt").dropDuplicates(["item_id"])
    first = F.when(F.size("answers") > 0, F.col("answers")[0])
    columns = (F.col("input").alias("prompt"), F.col("item_id").alias("context_id"))
    answers = items.select(F.col("item_id").alias("record_id"), *columns, first.alias("response"))
    requests = table(spark, sf_dir, "request_metrics").where("error IS NULL").select("engine_request_id", "item_id", "output_text")
    outputs = requests.join(items.select("item_id", "input"), "item_id", "left").select(F.col("engine_request_id").alias("record_id"), *columns, F.col("output_text").alias("response"))
    sample = langid.sample_texts(table(spark, sf_dir, "documents"))
    contexts = items.select(F.col("item_id").alias("context_id"), F.col("recipient_prompt").alias("context"))
    return pairs.pair_defects(outputs.unionByName(answers), sample, contexts)


QUERIES = {
    "p1_found": p1_found,
    "p1_coverage": p1_coverage,
    "p1_stretches": p1_stretches,
    "p1_lines": p1_lines,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_rebuilt": p3_rebuilt,
    "p4_daily": p4_daily,
    "p4_daily_digest": p4_daily_digest,
    "p4_period": p4_period,
    "p4_compressed": p4_compressed,
    "p7_found": p7_found,
    "p7_packed": p7_packed,
    "p7_totals": p7_totals,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p8_documents": p8_documents,
    "p8_gain": p8_gain,
    "p9_found": p9_found,
    "p9_languages": p9_languages,
    "p6_found": p6_found,
}
