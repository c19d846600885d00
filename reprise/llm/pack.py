"""Filling containers of fixed capacity with documents: harmonic classes, packed by workers on their own.

Sizes are parted into classes by the reciprocal of the capacity C: class j holds sizes in
(C/(j+1), C/j], so any j of them fit one container. A class's containers take a fixed count of j
documents. What room such a container leaves is topped up with documents of smaller classes before
these open containers of their own. Workers are hash buckets of bounded size that need nothing from
each other; only (doc_id, tokens) is shuffled, never text.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token: a run of letters, digits and "_", or a single other character that is no white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
#: Documents of one worker's bucket, on average.
BUCKET = 20_000
#: Budgets that one pass over the sizes packs for; more of them take more passes.
BUDGETS_AT_ONCE = 1000

PACKED_SCHEMA = "budget_id int, doc_id bigint, piece_no int, n_pieces int, token_start bigint, tokens bigint, container_id bigint"


def token_count(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def fill(sizes: Sequence[int], capacity: int) -> list[int]:
    """Container index of each item; sizes must be within 0..capacity.

    Items are taken in order of size, ties in the order given, so the result is deterministic.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    at = [0] * len(sizes)
    rooms: list[tuple[int, int]] = []  # (room left, container), sorted
    opened, last_class, current, slots, room = 0, 0, -1, 0, 0
    for i in order:
        s = sizes[i]
        cls = capacity // s if s else math.inf
        if cls != last_class and current >= 0:
            bisect.insort(rooms, (room, current))  # the class's last container stays open to smaller ones
            current = -1
        last_class = cls
        if current < 0 or room < s:
            k = bisect.bisect_left(rooms, (s, -1))
            if k < len(rooms):
                left, box = rooms.pop(k)
                at[i] = box
                bisect.insort(rooms, (left - s, box))
                continue
        if current < 0:
            current, slots, room = opened, cls, capacity
            opened += 1
        at[i] = current
        room -= s
        slots -= 1
        if slots <= 0:
            bisect.insort(rooms, (room, current))
            current = -1
    return at


def _packer(budgets: list[tuple[int, int]]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["doc_id", "tokens"])
        ids, tokens = docs["doc_id"].array, docs["tokens"].to_numpy(np.int64)
        out = []
        for budget, capacity in budgets:
            n = np.maximum(1, -(-tokens // capacity))
            doc = np.repeat(np.arange(len(docs)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            size = np.minimum(tokens[doc] - start, capacity)
            box = np.array(fill(size.tolist(), capacity), dtype=np.int64)
            out.append(pd.DataFrame({"budget_id": pd.array([budget] * len(doc), "Int32"), "doc_id": ids.take(doc), "piece_no": piece, "n_pieces": n[doc], "token_start": start, "tokens": size, "container_id": box + (int(key[0]) << 32)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in PACKED_SCHEMA.split(", ")])

    return pack


def pack_documents(documents: DataFrame, budgets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per budget and document, or piece of a document that alone exceeds the capacity.

    Containers are numbered within their budget. Oversized documents are cut into pieces of exactly
    the capacity, the rest of them being packed like any other document. A null text counts as
    empty; an empty text takes no room but still gets a container. Rows with the same doc_id are
    separate items. Budgets with a null or non-positive capacity hold nothing and give no rows;
    other columns are ignored.
    """
    limits = budgets.select("budget_id", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("budget_id", "capacity_tokens")
    buckets = max(1, -(-documents.count() // bucket))
    sizes = documents.select("doc_id", F.coalesce(token_count("text"), F.lit(0)).alias("tokens"))
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(buckets)))
    packed = lambda block: sizes.groupBy("bucket").applyInPandas(_packer(block), PACKED_SCHEMA)
    found, block = None, []
    for r in limits.toLocalIterator():
        block.append((r.budget_id, int(r.capacity_tokens)))
        if len(block) == BUDGETS_AT_ONCE:
            found = packed(block) if found is None else found.unionByName(packed(block))
            block = []
    if block or found is None:
        found = packed(block) if found is None else found.unionByName(packed(block))
    return found


def oversized(packed: DataFrame) -> DataFrame:
    return packed.where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("budget_id", "doc_id")


def containers(packed: DataFrame) -> DataFrame:
    return packed.groupBy("budget_id", "container_id").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("tokens"))


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: containers used, the fewest that could do, and the share of room used."""
    used = containers(packed).groupBy("budget_id").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    limits = budgets.select("budget_id", "capacity_tokens").distinct()
    return used.join(limits, "budget_id").select(
        "budget_id",
        "n_containers",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
    )
