"""Long verbatim spans shared between records, found by hashing units of text.

Whole lines or paragraphs as units can't give every stretch of a minimum length: a stretch may begin
and end within lines. Units here are windows of half that length at places chosen by the text around
them (the least hash among neighbouring windows), so any stretch of the minimum length holds a whole
unit wherever it stands. Units' digests are grouped globally. Shared units of one alignment that
follow each other without a gap make a shared stretch by themselves; only pairs of texts whose units
don't reach the minimum length that way are compared. Where stretches are asked for, every aligned
pair is, and they come out with their offsets in the original.

`line_units` is the plain form: lines or paragraphs, normalised, digests grouped globally, the
earliest ranked occurrence kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.operators.skew import grid_join
from reprise.session import materialise

#: Shortest stretch that counts, in code points.
LEAST = 240
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """`pick` (minimum or maximum) of each `width` neighbours, by doubling."""
    done, span = x, 1
    while span * 2 <= width:
        done = pick(done[: len(done) - span], done[span:])
        span *= 2
    rest = width - span
    return pick(done[: len(done) - rest], done[rest:]) if rest else done


def units(text: str, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(digests, offsets) of the chosen windows; texts shorter than `least` have none.

    A window is chosen if its hash is the least of some `least - k + 1` neighbours, k being its
    length, which depends on nothing outside a stretch of `least` characters.
    """
    x = codes(text).astype(np.uint64)
    if len(x) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = max(1, least // 2)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(x), _BASE, np.uint64))
        upto = np.concatenate([[np.uint64(0)], np.cumsum((x + np.uint64(1)) * powers)])
        # The sum of a window, brought to the powers that it would have at the start of the text.
        hashes = (upto[k:] - upto[:-k]) * np.cumprod(np.full(len(x) - k + 1, _INVERSE, np.uint64))
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
    width = least - k + 1
    low = _sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    chosen = _sliding(np.concatenate([pad, low, pad]), width, np.maximum) == hashes
    # Within a run of one repeated character all windows are equal: its ends suffice.
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = hashes[1:] == hashes[:-1]
    at = np.flatnonzero(chosen & ~(same[:-1] & same[1:]))
    return hashes[at].view(np.int64), at


def stretches(a: np.ndarray, b: np.ndarray, shift: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Longest equal stretches (start in a, start in b, length) where b's offset is a's plus `shift`."""
    low, high = max(0, -shift), min(len(a), len(b) - shift)
    if high - low < least:
        return []
    equal = np.concatenate([[False], a[low:high] == b[low + shift : high + shift], [False]])
    edge = np.flatnonzero(equal[1:] != equal[:-1])
    return [(low + s, low + s + shift, e - s) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) if e - s >= least]


def _unit_rows(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [units(t, least) for t in batch["text"]]
            n = [len(d) for d, _ in found]
            none = [np.zeros(0, np.int64)]
            yield pd.DataFrame({"text_id": np.repeat(batch["text_id"].to_numpy(), n), "digest": np.concatenate([d for d, _ in found] or none), "place": np.concatenate([p for _, p in found] or none)})

    return run


def _compare(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, last, a = [], None, None
            for ta, tb, xa, xb, shifts in batch[["text_a", "text_b", "x_a", "x_b", "shifts"]].itertuples(index=False):
                if ta != last:
                    last, a = ta, codes(xa)
                b = codes(xb)
                out += [(ta, tb, *s) for shift in shifts for s in stretches(a, b, int(shift), least)]
            yield pd.DataFrame(out, columns=["text_a", "text_b", "start_a", "start_b", "length"])

    return run


def _runs(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs of one character, repeated `least` times or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text_id, text in zip(batch["text_id"], batch["text"]):
                x = codes(text)
                edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
                long = np.flatnonzero(np.diff(edge) >= least)
                out += [(text_id, int(x[edge[k]]), int(edge[k]), int(edge[k + 1] - edge[k])) for k in long]
            yield pd.DataFrame(out, columns=["text_id", "character", "start", "length"])

    return run


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n = []
        for spans in batch["spans"]:
            total, upto = 0, 0
            for s in sorted((x["start"], x["end"]) for x in spans):
                total += max(0, s[1] - max(s[0], upto))
                upto = max(upto, s[1])
            n.append(total)
        yield pd.DataFrame({"text_id": batch["text_id"], "shared_chars": n})


def _covered_by_units(places: str, size: int) -> Column:
    """Most characters that units of `size` at sorted places cover without a gap."""
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("most"))

    def step(x: Column, p: Column) -> Column:
        begin = F.when(p <= x.end, x.start).otherwise(p)
        return F.struct(begin.alias("start"), (p + size).alias("end"), F.greatest(x.most, p + size - begin).alias("most"))

    return F.aggregate(places, start, step, lambda x: x.most)


class SharedSpans:
    """Shared stretches of the texts of records.

    `texts` is (record_id, part, text): any number of texts per record. Equal texts are one class;
    stretches are found between classes, so copies cost nothing, however many there are. Texts of
    one record are not compared with each other unless other records hold them too. Repeated rows
    count once. Null record ids and texts are left out; texts shorter than the least length share
    nothing. No text is shuffled more than once for the pairs that units settle.
    """

    def __init__(self, texts: DataFrame, least: int = LEAST):
        self.least = least
        rows = texts.where("record_id IS NOT NULL AND text IS NOT NULL").select(F.col("record_id").cast("string").alias("record_id"), F.col("part").cast("string").alias("part"), F.unhex(F.md5("text")).alias("text_id"), F.char_length("text").alias("n_chars"), "text")
        self.parts = materialise(rows.drop("text").distinct())
        self.owners = self.parts.where(F.col("n_chars") >= least).select("text_id", "record_id").distinct()
        self.unique = materialise(rows.where(F.col("n_chars") >= least).groupBy("text_id").agg(F.first("text").alias("text")))
        posts = self.unique.mapInPandas(_unit_rows(least), "text_id binary, digest bigint, place int")
        # The one record that holds a text, null if several do.
        sole = self.owners.groupBy("text_id").agg(F.when(F.min("record_id") == F.max("record_id"), F.min("record_id")).alias("sole"))
        posts = materialise(posts.join(sole, "text_id"))
        left = posts.select("digest", *(F.col(c).alias(f"{c}_a") for c in ("text_id", "place", "sole")))
        right = posts.select("digest", *(F.col(c).alias(f"{c}_b") for c in ("text_id", "place", "sole")))
        # Different texts of one and the same record only are no pair.
        apart = (F.col("text_id_a") < F.col("text_id_b")) & ~F.coalesce(F.col("sole_a") == F.col("sole_b"), F.lit(False))
        met = grid_join(left, right, "digest", "text_id_a", "text_id_b").where(apart)
        aligned = met.groupBy(F.col("text_id_a").alias("text_a"), F.col("text_id_b").alias("text_b"), (F.col("place_b") - F.col("place_a")).alias("shift")).agg(F.array_sort(F.collect_set("place_a")).alias("places"))
        self.aligned = materialise(aligned.select("text_a", "text_b", "shift", (_covered_by_units("places", max(1, least // 2)) >= least).alias("sure")))

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """Stretches of pairs (text_a, text_b, shifts)."""
        both = pairs.join(self.unique.toDF("text_b", "x_b"), "text_b").join(self.unique.toDF("text_a", "x_a"), "text_a")
        return both.mapInPandas(_compare(self.least), "text_a binary, text_b binary, start_a int, start_b int, length int")

    @cached_property
    def stretches(self) -> DataFrame:
        """(text_a, text_b, start_a, start_b, length): shared stretches between classes of equal texts."""
        return materialise(self._compared(self.aligned.groupBy("text_a", "text_b").agg(F.collect_set("shift").alias("shifts"))))

    @cached_property
    def linked(self) -> DataFrame:
        """(text_a, text_b): pairs of classes that share a stretch."""
        pairs = self.aligned.groupBy("text_a", "text_b").agg(F.max("sure").alias("sure"), F.collect_set("shift").alias("shifts"))
        doubtful = self._compared(pairs.where("NOT sure").drop("sure")).select("text_a", "text_b").distinct()
        return materialise(pairs.where("sure").select("text_a", "text_b").union(doubtful))

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: records that share a stretch."""
        left = self.owners.select(F.col("text_id").alias("text_a"), F.col("record_id").alias("x"))
        right = self.owners.select(F.col("text_id").alias("text_b"), F.col("record_id").alias("y"))
        between = grid_join(grid_join(self.linked, left, "text_a", "text_b", "x"), right, "text_b", "x", "y").select("x", "y")
        copies = grid_join(left.withColumnRenamed("text_a", "t"), right.withColumnRenamed("text_b", "t"), "t", "x", "y").where("x < y").select("x", "y")
        return between.union(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()

    def coverage(self) -> DataFrame:
        """Of each text of each record, how many characters stand in stretches that other records hold too."""
        s = self.stretches
        sides = s.select(F.col("text_a").alias("text_id"), F.col("start_a").alias("start"), "length").union(s.select("text_b", "start_b", "length"))
        # Units align a run of one character at its ends only; where records share one, all of it is shared.
        runs = self.unique.mapInPandas(_runs(self.least), "text_id binary, character int, start int, length int")
        held = runs.select("text_id", "character").distinct().join(self.owners, "text_id").groupBy("character").agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).where("a <> b").select("character")
        sides = sides.union(runs.join(held, "character").select("text_id", "start", "length"))
        spans = sides.select("text_id", F.struct("start", (F.col("start") + F.col("length")).alias("end")).alias("s")).groupBy("text_id").agg(F.collect_set("s").alias("spans"))
        shared = spans.mapInPandas(_covered, "text_id binary, shared_chars int")
        copies = self.owners.groupBy("text_id").agg(F.count("*").alias("n_records"))
        named = self.parts.join(copies, "text_id", "left").join(shared, "text_id", "left")
        n = F.when(F.col("n_records") > 1, F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
        return named.select("record_id", "part", "n_chars", n.alias("shared_chars"))


def line_units(texts: DataFrame, unit: str = "line", least: int = 1) -> DataFrame:
    """Lines or paragraphs of texts, each with its offset, and whether it is the earliest of its kind.

    `texts` is (record_id, part, text). Units are normalised (lower case, white space squeezed) and
    grouped by digest; the first by (record_id, part, offset) is kept, the rest are marked for
    removal. Units of fewer than `least` normalised characters are always kept. Offsets and lengths
    are those of the original text. A group's earliest occurrence is a minimum, taken by partial
    aggregation, so a unit that stands in every record is no hot spot.
    """
    split = r"(?:\r\n|\r|\n)" if unit == "line" else r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*"
    cut = F.split(F.regexp_replace("text", f"({split})", "$1\u0001"), "\u0001")
    rows = texts.where("record_id IS NOT NULL AND text IS NOT NULL").select("record_id", "part", F.posexplode(cut).alias("unit_no", "unit"))
    by = Window.partitionBy("record_id", "part").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.char_length("unit")).over(by), F.lit(0)))
    plain = F.trim(F.regexp_replace(F.lower("unit"), r"[\s\p{Z}]+", " "))
    units_ = placed.select("record_id", "part", "start", F.char_length("unit").alias("length"), F.char_length(plain).alias("n"), F.md5(plain).alias("digest"))
    rank = F.struct("record_id", "part", "start")
    firsts = units_.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n_copies"))
    kept = (F.col("first") == rank) | (F.col("n") < least)
    return units_.join(firsts, "digest").select("record_id", "part", "start", "length", "digest", "n_copies", kept.alias("kept"))
