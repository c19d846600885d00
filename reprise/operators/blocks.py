"""Token blocks of prompts: exact hits, collisions between sources, reused spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions import text as T

BLOCK = 16
#: A block that stands in donors of so many sources (or of all, at least two) is boilerplate.
BOILERPLATE_SOURCES = 3
MOST_VIOLATIONS = 50


def prompt_blocks(prompts: DataFrame, keys: list[str], text: str, size: int = BLOCK) -> DataFrame:
    """One row per full block: keys, block_no, digest, degenerate."""
    # Ids are a column of their own: within an expression they would be made anew for every block.
    ids = prompts.select(*keys, T.token_ids(F.col(text)).alias("ids"))
    cut = ids.select(*keys, F.posexplode(T.blocks(F.col("ids"), size)).alias("block_no", "b"))
    return cut.select(*keys, "block_no", T.ids_digest(F.col("b")).alias("digest"), T.degenerate(F.col("b")).alias("degenerate"))


def donors_of(items: DataFrame) -> DataFrame:
    """Donor texts with the source they came from."""
    d = items.select("item_id", "source_id", F.explode("donor_prompts").alias("d"))
    origin = F.coalesce(F.nullif(F.col("d.metadata")["negative_source_id"], F.lit("")), F.nullif(F.col("d.metadata")["entity_swap_source_id"], F.lit("")), F.col("source_id"))
    return d.select("item_id", origin.alias("origin"), F.col("d.text").alias("text"))


def exact_hits(items: DataFrame, size: int = BLOCK) -> DataFrame:
    """(item_id, total_blocks, hit_blocks): recipient blocks that stand anywhere in the item's own donors."""
    own = prompt_blocks(donors_of(items), ["item_id"], "text", size).select("item_id", "digest").distinct().withColumn("hit", F.lit(1))
    blocks = prompt_blocks(items, ["item_id"], "recipient_prompt", size)
    hits = blocks.join(own, ["item_id", "digest"], "left").groupBy("item_id").agg(F.count("*").alias("total_blocks"), F.count("hit").alias("hit_blocks"))
    return items.select("item_id", "transform", "dataset").join(hits, "item_id", "left").select("item_id", "transform", "dataset", F.coalesce("total_blocks", F.lit(0)).cast("bigint").alias("total_blocks"), F.coalesce("hit_blocks", F.lit(0)).cast("bigint").alias("hit_blocks"))


def hit_rates(hits: DataFrame) -> DataFrame:
    """Blocks and rates by transform and over all (transform null), in one pass of grouping sets."""
    rolled = hits.rollup("transform").agg(F.count("*").alias("n_items"), F.sum("total_blocks").alias("total_blocks"), F.sum("hit_blocks").alias("hit_blocks"))
    return rolled.withColumn("exact_block_hit_rate", F.when(F.col("total_blocks") > 0, F.col("hit_blocks") / F.col("total_blocks")).otherwise(0.0))


def _donor_blocks(items: DataFrame, size: int) -> DataFrame:
    return prompt_blocks(donors_of(items), ["item_id", "origin"], "text", size)


def collisions(items: DataFrame, size: int = BLOCK) -> DataFrame:
    """Recipient blocks that collide with donors they must not share blocks with, and with how many items.

    Boilerplate is taken out of the owners by counts per digest, and owners are counted by digest
    and origin before they meet recipients, so neither a preamble of every prompt nor a source of
    many items multiplies rows: a digest that is left has fewer than `BOILERPLATE_SOURCES` origins.
    """
    owners = _donor_blocks(items, size).where("NOT degenerate").select("digest", "item_id", "origin").distinct()
    by_digest = owners.groupBy("digest").agg(F.countDistinct("origin").alias("n_origins"))
    total = owners.agg(F.greatest(F.lit(2), F.least(F.lit(BOILERPLATE_SOURCES), F.countDistinct("origin"))).alias("threshold"))
    rare = by_digest.join(F.broadcast(total)).where("n_origins < threshold").select("digest")  # the total is one row
    kept = owners.groupBy("digest", "origin").agg(F.countDistinct("item_id").alias("n"), F.min("item_id").alias("first")).join(rare, "digest")
    own = owners.select("item_id", "digest").distinct().withColumn("own", F.lit(True))
    blocks = prompt_blocks(items, ["item_id", "source_id", "negative_control"], "recipient_prompt", size).where("NOT degenerate").drop("degenerate")
    met = blocks.join(kept, "digest")
    foreign = F.col("origin") != F.col("source_id")
    grouped = met.groupBy("item_id", "source_id", "negative_control", "block_no", "digest").agg(F.sum(F.when(foreign, F.col("n"))).alias("n_foreign"), F.min(F.when(foreign, F.col("first"))).alias("first_foreign"), F.sum("n").alias("n_all"), F.min("first").alias("first_all"))
    known = grouped.join(own, ["item_id", "digest"], "left")
    overlap = F.col("negative_control") & F.col("own").isNotNull()
    kind = F.when(overlap, "negative_control_overlap").when(F.col("n_foreign") > 0, "phantom_cross_source")
    return known.select(kind.alias("kind"), "item_id", "source_id", F.col("block_no").cast("bigint").alias("block_no"), F.col("digest").alias("block_hash"), F.when(overlap, F.col("n_all")).otherwise(F.col("n_foreign")).alias("n_items"), F.when(overlap, F.col("first_all")).otherwise(F.col("first_foreign")).alias("first_item")).where("kind IS NOT NULL")


def collision_report(items: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row: what was checked, and whether any block collides."""
    blocks = _donor_blocks(items, size)
    counts = blocks.agg(F.count("*").alias("donor_blocks"), F.count_if("degenerate").alias("degenerate_blocks"))
    by_digest = blocks.where("NOT degenerate").groupBy("digest").agg(F.countDistinct("origin").alias("n"))
    origins = blocks.where("NOT degenerate").agg(F.greatest(F.lit(2), F.least(F.lit(BOILERPLATE_SOURCES), F.countDistinct("origin"))).alias("threshold"))
    boilerplate = by_digest.join(F.broadcast(origins)).agg(F.count_if(F.col("n") >= F.col("threshold")).alias("boilerplate_blocks"))
    found = collisions(items, size).agg(F.count("*").alias("n_violations"))
    checked = items.agg(F.count("*").alias("items_checked"))
    # Every side is an aggregate of one row.
    return checked.join(F.broadcast(counts)).join(F.broadcast(boilerplate)).join(F.broadcast(found)).withColumn("passed", F.col("n_violations") == 0)


def full_reuse_blocks(reused: Column, total: Column, size: int = BLOCK) -> Column:
    """Blocks all of whose target positions are reused."""
    n = F.floor(total / size).cast("int")
    whole = lambda i: F.size(F.array_intersect(reused, F.sequence(i * size, i * size + size - 1))) == size
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(0), n - 1), whole))).otherwise(0)


def eligible_blocks(actions: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks that a backend could copy whole, from `actions(item_id, ordinal, target_pos, donor_pos, donor_id)`.

    The last action on a target position counts; a block needs all its positions, one donor, and
    consecutive donor positions.
    """
    last = actions.groupBy("item_id", "target_pos").agg(F.max_by(F.struct("donor_pos", "donor_id"), "ordinal").alias("a"))
    by_block = last.groupBy("item_id", F.floor(F.col("target_pos") / size).alias("block_no")).agg(F.count("*").alias("n"), F.countDistinct("a.donor_id").alias("n_donors"), F.countDistinct(F.col("a.donor_pos") - F.col("target_pos")).alias("n_shifts"))
    ok = (F.col("n") == size) & (F.col("n_donors") <= 1) & (F.col("n_shifts") == 1)
    return by_block.groupBy("item_id").agg(F.count_if(ok).alias("eligible_blocks"))
