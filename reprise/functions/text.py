"""Text columns: tokens, identifiers, normal forms, sentences. All of them but token ids stay in the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from reprise.functions.columns import bound

# White space and word classes written out, as engines' \s and \w differ.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]"
# Words that scoring leaves out, and suffixes it takes off, in order.
STOP_WORDS = ("a", "an", "and", "as", "in", "of", "the", "to", "was", "were")
SUFFIXES = ("ing", "ed", "es", "s")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def tokens(text: Column) -> Column:
    """Words, and other characters one by one."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _little_endian(hex8: Column) -> Column:
    return F.concat(*(F.substring(hex8, at, 2) for at in (7, 5, 3, 1)))


def _ids_of(words: pd.Series) -> pd.Series:
    """31-bit ids of lists of words; a word of a batch is digested once."""
    given = [w for w in words if w is not None]
    codes, kinds = pd.factorize(np.concatenate([np.asarray(w, object) for w in given])) if any(map(len, given)) else (np.zeros(0, np.int64), [])
    by_kind = np.array([int.from_bytes(hashlib.sha256(k.lower().encode("utf-8", "surrogatepass")).digest()[:4], "little") & 0x7FFFFFFF for k in kinds], np.int64)
    parts = iter(np.split(by_kind[codes], np.cumsum([len(w) for w in given])[:-1]) if given else ())
    return pd.Series([None if w is None else next(parts) for w in words], dtype=object)


def token_ids(text: Column) -> Column:
    """31-bit ids: the first four bytes, little-endian, of a token's digest in lower case.

    Tokens are found in the JVM and digested in Arrow batches, each distinct one once.
    """
    return F.pandas_udf(_ids_of, ST.ArrayType(ST.LongType()))(tokens(text))


def ids_digest(ids: Column) -> Column:
    """32 hex digits over ids packed as little-endian 32-bit numbers; '' for none."""
    packed = F.array_join(F.transform(ids, lambda x: _little_endian(F.lpad(F.hex(x), 8, "0"))), "")
    return F.when(F.size(ids) == 0, "").otherwise(F.substring(F.sha2(F.unhex(packed), 256), 1, 32))


def blocks(ids: Column, size: int) -> Column:
    """Full blocks of `size` ids; what is left at the end is dropped. `ids` should be a plain column."""
    n = F.floor(F.size(ids) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ids, i * size + 1, size))).otherwise(F.array().cast("array<array<bigint>>"))


def windows(ids: Column, size: int) -> Column:
    """Every run of `size` ids."""
    n = F.size(ids) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(ids, i, size))).otherwise(F.array().cast("array<array<bigint>>"))


def degenerate(block: Column, least: int = 4) -> Column:
    return F.size(F.array_distinct(block)) < least


def stable_id(*parts: Column) -> Column:
    """16 hex digits over parts that must not be null."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def derived_int(key: Column, low: int, high: int) -> Column:
    """A number in low..high that depends on the key only."""
    return F.lit(low) + F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % (high - low + 1)


def placed_on(key: Column, workers: int) -> Column:
    """Worker of a key: the first eight bytes of its digest, as an unsigned number, modulo the workers."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % workers).cast("int")


def id_token(text: Column) -> Column:
    """At most 24 of [a-z0-9-], without hyphens at the ends; 'x' if nothing is left."""
    clean = F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9-]", "-"), 1, 24)
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^-+|-+$", ""), F.lit("")), F.lit("x"))


def request_id(prefix: Column, arm: Column, ordinal: Column, role: Column, *seed: Column) -> Column:
    return F.concat_ws("-", id_token(prefix), id_token(arm), F.lpad(ordinal.cast("string"), 6, "0"), id_token(role), stable_id(*seed))


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", " ")), " +"), lambda w: w != "")


def stem(word: Column) -> Column:
    cut = word
    for s in reversed(SUFFIXES):
        cut = F.when((F.length(word) > len(s) + 3) & word.endswith(s), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(cut)
    doubled = (F.length(cut) >= 3) & (F.substring(cut, -1, 1) == F.substring(cut, -2, 1))
    return F.when(doubled, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def scored_words(text: Column) -> Column:
    return F.transform(F.filter(normal_words(text), lambda w: ~w.isin(*STOP_WORDS)), lambda w: stem(w))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays, plain columns or variables."""
    count = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def f1(common: Column, n: Column, m: Column) -> Column:
    """Harmonic mean of common/n and common/m; 0 without anything in common."""
    precision, recall = common / n, common / m
    return F.when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def _shared(a: Column, b: Column, score) -> Column:
    """`score` of (common, size of a, size of b), word lists and counts being made once."""
    counted = bound(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(overlap(s.a, s.b).alias("c"), F.size(s.a).alias("n"), F.size(s.b).alias("m")))
    return bound(counted, lambda x: score(x.c, x.n, x.m))


def token_f1(output: Column, answer: Column) -> Column:
    return _shared(normal_words(output), normal_words(answer), f1)


def answer_recall(output: Column, answer: Column) -> Column:
    return _shared(scored_words(output), scored_words(answer), lambda c, n, m: F.when((n == 0) | (m == 0), 0.0).otherwise(c / m))


def best_of(answers: Column, score) -> Column:
    """Best score of the non-empty answers: null without answers, 0 if all are empty."""
    given = F.filter(answers, lambda a: a.isNotNull() & (a != ""))
    best = F.coalesce(F.array_max(F.transform(given, score)), F.lit(0.0))
    return F.when(F.coalesce(F.size(answers), F.lit(0)) <= 0, F.lit(None).cast("double")).otherwise(best)


def answer_letter(text: Column) -> Column:
    """Choice letter of a reply: an 'Answer: X' line, a line of the letter alone, or the first that stands alone."""
    # The three patterns, in order.
    tries = (r"(?im)^\s*(?:answer|final answer)\s*[:\-]?\s*\(?([A-D])\)?\b", r"(?im)^\s*\(?([A-D])\)?\s*[.):]?\s*$", r"\b([A-D])\b")
    return F.upper(F.coalesce(*(F.nullif(F.regexp_extract(text, t, 1), F.lit("")) for t in tries)))


def sentences(text: Column) -> Column:
    """Sentences with white space squeezed; Latin stops need white space after them."""
    plain = strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))
    return F.filter(F.split(plain, rf"(?<=[.!?])[{SPACE}]+|(?<=[。！？])[{SPACE}]*"), lambda s: s != "")


def inject_sentence(text: Column, added: Column) -> Column:
    """The text's sentences with another one put in the middle."""
    s = sentences(text)
    half = F.floor(F.size(s) / 2).cast("int")
    return F.array_join(F.concat(F.slice(s, F.lit(1), half), F.array(added), F.slice(s, half + 1, F.size(s))), " ")
