"""Evaluation passages that stand in training text, found with spaced seeds.

A seed is the hash of the words that a fixed mask picks out of some consecutive ones; the words under
its gaps may be any. Seeds of passages and of documents are tables that are joined. Before the join a
filter of fixed size, made of the passages' seeds, keeps nearly all other seeds of the corpus where
they are. Around the hits of a pair the overlap is followed along the alignment, changed words being
tolerated; runs of equal words within overlaps are chained in the order of both texts.

The shortest mask spans no more words than a run that counts, so no run is missed. Seeds whose gaps
lie on changed words find overlaps that have no such run at all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.operators.skew import grid_join
from reprise.session import materialise

_WORD = re.compile(r"\w+")
#: 1: the word counts; 0: it may be any.
MASKS = ("11011", "1101011", "11100111")
#: Shortest run of equal consecutive words that counts. The first mask spans as many.
RUN = 5
#: Shortest run within an overlap of altered text, and how many words in a row may differ there.
ALTERED_RUN, TOLERATED = 2, 2
#: Share of a passage's words that must be found, and length of the stretch in passages.
SHARE, STRETCH = 0.5, 1.5
#: Bits of the filter: a fixed size, whatever the passages and the corpus.
FILTER_BITS = 24

_SEEDED = "doc_id bigint, text_id binary, words array<bigint>, seeds array<bigint>, places array<int>"
_PASSAGES = "eval_id bigint, passage_id binary, words array<bigint>, seeds array<bigint>, places array<int>"
_VERIFIED = "text_id binary, passage_id binary, words_found int, words_similar int, passage_words int, first_word int, last_word int"


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of the texts, number of words of each text); a word is hashed once."""
    split = [_WORD.findall(t) for t in texts]
    codes, kinds = pd.factorize(np.array([w for x in split for w in x], object))
    hashed = np.array([xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "surrogatepass")) for w in kinds], np.uint64)
    return hashed[codes] if len(kinds) else np.zeros(0, np.uint64), np.array([len(x) for x in split], np.int64)


def seeds(ids: np.ndarray, sizes: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of every seed of texts whose word hashes stand in `ids` one after the other; the mask is part of the hash."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes, owners, places = [np.zeros(0, np.uint64)], [text[:0]], [place[:0]]
    for number, mask in enumerate(masks):
        n = max(0, len(ids) - len(mask) + 1)
        code = np.full(n, number + 1, np.uint64)
        for k in np.flatnonzero(np.array(list(mask)) == "1"):
            code = (code ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        whole = text[:n] == text[len(ids) - n :]  # the mask ends in the text that it begins in
        codes.append(code[whole])
        owners.append(text[:n][whole])
        places.append(place[:n][whole])
    return np.concatenate(codes), np.concatenate(owners), np.concatenate(places)


def _cells(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a seed in the filter."""
    return code & np.uint64((1 << FILTER_BITS) - 1), code >> np.uint64(64 - FILTER_BITS)


class Filter:
    """Which cells passages' seeds fall in: a bit array of fixed size."""

    def __init__(self, cells: np.ndarray):
        self.bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        np.bitwise_or.at(self.bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))

    def passes(self, code: np.ndarray) -> np.ndarray:
        return np.logical_and(*((self.bits[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 for c in _cells(code)))


def wanted_hits(n_words: int) -> int:
    """Places that seeds hit at least where half of `n_words` stand: a run of n words is hit at n - 4 places or more.

    For altered text it is one place for as many words as the longest mask spans.
    """
    return max(1, -(-n_words // 2) // max(RUN, *(len(m) for m in MASKS)))


def runs_on(ids: np.ndarray, text: np.ndarray, shift: int, least: int, hits: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Runs (place in ids, place in text, length) of equal words where a place of `ids` is that of `text` plus `shift`.

    With `hits`, places in `ids`, only runs in overlaps that hold one of them: stretches in which no
    more than `TOLERATED` words in a row differ.
    """
    low, high = max(0, shift), min(len(ids), len(text) + shift)
    equal = np.concatenate([[False], ids[low:high] == text[low - shift : high - shift], [False]])
    edge = np.flatnonzero(equal[1:] != equal[:-1])
    start, end = edge[::2], edge[1::2]
    kept = end - start >= least
    if hits is not None and len(start):
        part = np.concatenate([[0], np.cumsum(start[1:] - end[:-1] > TOLERATED)])
        of = part[np.maximum(np.searchsorted(start, hits - low, side="right") - 1, 0)]
        kept &= np.isin(part, of)
    return [(low + a, low + a - shift, b - a) for a, b in zip(start[kept].tolist(), end[kept].tolist())]


def best_chain(runs: list[tuple[int, int, int]], longest: int, least: int = RUN) -> tuple[int, int, int]:
    """(words, first, end) of the best chain of runs `(doc place, passage place, length)`.

    Chained are pairs of equal words, later ones later in both texts, in parts of at least `least`
    that follow each other along a run; all of them lie within `longest` words of the document. Runs
    may be shortened at either end and the stretch may begin anywhere. For every pair the latest
    start of a chain of each number of words is kept, and prefixes of the passage are looked up in
    logarithmic time.
    """
    runs = sorted(r for r in runs if r[2] >= least)
    if not runs:
        return 0, 0, 0
    (i, _, _), (k, _, n) = runs[0], runs[-1]
    if k + n - i <= longest and all(a + x <= b and p + x <= q for (a, p, x), (b, q, _) in zip(runs, runs[1:])):
        return sum(x for _, _, x in runs), i, k + n
    low = min(j for _, j, _ in runs)
    width = max(j + x for _, j, x in runs) - low
    most = min(width, longest)
    if most < least:
        return 0, 0, 0
    tree = np.full((width + 1, most + 1), -1, np.int64)
    steps: dict[int, list[tuple[int, int]]] = {}
    for r, (i, _, x) in enumerate(runs):
        for t in range(least - 1, x):
            steps.setdefault(i + t, []).append((r, t))
    last: dict[int, np.ndarray] = {}
    waiting: list[tuple[int, int, np.ndarray]] = []
    done, best = 0, (0, 0, 0)
    for at in sorted(steps):
        while done < len(waiting) and waiting[done][0] <= at - least:
            _, k, row = waiting[done]
            while k <= width:
                np.maximum(tree[k], row, out=tree[k])
                k += k & -k
            done += 1
        for r, t in steps[at]:
            j = runs[r][1] + t - low  # place in the passage, from 0
            row = np.full(most + 1, -1, np.int64)
            row[least] = at - least + 1
            k = j + 1 - least
            while k > 0:
                np.maximum(row[least:], tree[k][: most + 1 - least], out=row[least:])
                k -= k & -k
            if t >= least:
                np.maximum(row[1:], last[r][:-1], out=row[1:])
            last[r] = row
            fits = np.flatnonzero(row >= max(0, at + 1 - longest))
            if len(fits) and fits[-1] > best[0]:
                best = (int(fits[-1]), int(row[fits[-1]]), at + 1)
            waiting.append((at, j + 1, row))
    return best


def compare(ids: np.ndarray, text: np.ndarray, hits: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """(words in runs, words in runs of altered overlaps, first, end) of a pair that leaks; None if it doesn't.

    The second number is only looked for where the first is too small, and 0 otherwise.
    """
    longest, wanted = int(len(text) * STRETCH), -(-len(text) // 2)
    by_shift: dict[int, list[int]] = {}
    for i, j in hits:
        by_shift.setdefault(i - j, []).append(i)
    n, low, high = best_chain([r for s in by_shift for r in runs_on(ids, text, s, RUN)], longest)
    if n >= wanted:
        return n, 0, low, high
    m, low, high = best_chain([r for s, at in by_shift.items() for r in runs_on(ids, text, s, ALTERED_RUN, np.array(at))], longest, ALTERED_RUN)
    return (n, m, low, high) if m >= wanted else None


def _hashed(key: str, name: str, test: Callable[[np.ndarray], np.ndarray] | None, least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (key, digest of the words, words, seeds, places) of texts with at least `least` places at which a seed passes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids, sizes = word_hashes(part["text"].tolist())
                code, text, place = seeds(ids, sizes)
                if test is not None:
                    ok = test(code)
                    code, text, place = code[ok], text[ok], place[ok]
                order = np.lexsort((place, text))
                code, text, place = code[order].view(np.int64), text[order], place[order].astype(np.int32)
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
                n_places = np.bincount(text[new], minlength=len(sizes))
                upto, edge = np.cumsum(sizes), np.searchsorted(text, np.arange(len(sizes) + 1))
                out = []
                for n in np.flatnonzero(n_places >= max(1, least)).tolist():
                    own = ids[upto[n] - sizes[n] : upto[n]]
                    low, high = edge[n], edge[n + 1]
                    out.append((part[key].array[n], hashlib.blake2b(own.tobytes(), digest_size=16).digest(), own.view(np.int64), code[low:high], place[low:high]))
                yield pd.DataFrame(out, columns=[key, name, "words", "seeds", "places"]).astype({key: "Int64"})

    return run


def _filtered(shared, least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _hashed("doc_id", "text_id", shared.value.passes, least)(batches)

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _VERIFIED.split(", ")]
    for batch in batches:
        out = []
        for text_id, passage_id, ids, text, hits in batch[["text_id", "passage_id", "words", "passage", "hits"]].itertuples(index=False):
            if found := compare(np.asarray(ids), np.asarray(text), [(h["i"], h["j"]) for h in hits]):
                n, m, low, high = found
                out.append((text_id, passage_id, n, m, len(text), low, high))
        yield pd.DataFrame(out, columns=names)


def leaked_passages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with the evaluation items whose passage they hold, in whole or in part.

    (doc_id, eval_id, words_found, words_similar, passage_words, first_word, last_word). At least half
    of a passage's words stand in the document in passage order within one and a half times the
    passage's length: `words_found` of them in runs of five or more; or, where these are fewer than
    half, `words_similar` in runs of two or more that lie in overlaps around seeds, no more than two
    words in a row differing there, at one hit for every eight words wanted. Places are counted in
    words. Null and empty texts or passages match nothing, nor do passages under five words; repeated
    items count once; each document row is reported on its own, null ids too; other columns are
    ignored.

    Passages and documents of equal words are one class each, so copies cost no comparison. Only
    documents in which enough seeds pass the filter are shuffled, and only seeds that do; a seed that
    many share is spread over a grid.
    """
    texts = items.where("passage IS NOT NULL").select(F.col("eval_id").cast("bigint").alias("eval_id"), F.col("passage").alias("text")).distinct()
    passages = materialise(texts.mapInPandas(_hashed("eval_id", "passage_id", None, 1), _PASSAGES))
    classes = passages.groupBy("passage_id").agg(F.first("words").alias("passage"), F.first("seeds").alias("seeds"), F.first("places").alias("places"))
    wanted = classes.select("passage_id", F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("j"))).alias("s")).select("passage_id", "s.seed", "s.j")
    # Both cells of a seed; as many rows as the filter has cells at most.
    both = F.array(F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int"), F.shiftrightunsigned("seed", 64 - FILTER_BITS).cast("int"))
    cells = wanted.select(F.explode(both).alias("cell")).distinct().toPandas()["cell"].to_numpy(np.int64)
    shared = documents.sparkSession.sparkContext.broadcast(Filter(cells))
    shortest = passages.agg(F.min(F.size("words"))).first()[0]
    rows = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seeded = materialise(rows.mapInPandas(_filtered(shared, wanted_hits(shortest or 0)), _SEEDED))
    unique = seeded.select("text_id", "words", "seeds", "places").dropDuplicates(["text_id"])
    asked = unique.select("text_id", F.explode(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("i"))).alias("s")).select("text_id", "s.seed", "s.i")
    met = grid_join(asked, wanted, "seed", "text_id", "passage_id")
    hits = met.groupBy("text_id", "passage_id").agg(F.collect_set(F.struct("i", "j")).alias("hits"), F.collect_set("i").alias("at"))
    whole = classes.select("passage_id", "passage")
    longest_mask = max(RUN, *(len(m) for m in MASKS))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.size("passage") / 2) / longest_mask))
    pairs = hits.join(whole, "passage_id").where(F.size("at") >= least).drop("at").join(unique.select("text_id", "words"), "text_id")
    found = pairs.mapInPandas(_verify, _VERIFIED)
    return found.join(passages.select("eval_id", "passage_id").distinct(), "passage_id").join(seeded.select("doc_id", "text_id"), "text_id").select("doc_id", "eval_id", "words_found", "words_similar", "passage_words", "first_word", "last_word")


def in_runs(found: DataFrame) -> DataFrame:
    """Of `leaked_passages`, the links whose words stand in runs."""
    return found.where(F.col("words_found") >= F.ceil(F.col("passage_words") / 2))


def leaked_documents(found: DataFrame) -> DataFrame:
    """Per document: the items that leaked into it and the largest share of one."""
    share = F.greatest("words_found", "words_similar") / F.col("passage_words")
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("eval_id")).alias("eval_ids"), F.max(share).alias("largest_share"))


def seed_gain(found: DataFrame) -> DataFrame:
    """Links by runs, and links that runs of equal words alone would have lost."""
    runs = F.col("words_found") >= F.ceil(F.col("passage_words") / 2)
    return found.agg(F.count_if(runs).alias("links_in_runs"), F.count_if(~runs).alias("links_altered"), F.count_if(F.col("words_found") == 0).alias("links_without_runs"))
