"""ROUGE-L on columns of texts, in Arrow batches: the dynamic program has no columnar form."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: str) -> tuple[str, ...]:
    return tuple("".join(c.lower() if c.isalnum() else " " for c in text).split())


def longest_common(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Length of the longest common subsequence, on bit vectors: one big-integer step per word of `b`."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = row | masks.get(w, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


@lru_cache(65536)
def rouge_l_score(output: str, reference: str) -> float:
    a, b = words(output), words(reference)
    n = longest_common(a, b) if a and b else 0
    if not n:
        return 0.0
    precision, recall = n / len(a), n / len(b)
    return 2 * precision * recall / (precision + recall)


def _scores(output: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([None if o is None or r is None else rouge_l_score(o, r) for o, r in zip(output, reference)], dtype="Float64")


def rouge_l(output: Column | str, reference: Column | str) -> Column:
    """Null if either text is."""
    return F.pandas_udf(_scores, T.DoubleType())(output, reference)
