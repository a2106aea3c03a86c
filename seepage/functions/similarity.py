"""Sliding-window trigram Jaccard test of the fuzzy candidates.

It runs only on candidate (write, fingerprint) pairs that survived the trigram
filters, over a bounded window range, as an Arrow-batched pandas UDF. A trigram at place j
counts as a new distinct one for exactly the windows that start after its previous
occurrence and hold j, a range: the sizes of all windows' sets and of their
intersections with the value's set are sums of such ranges, without a loop over bytes.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from seepage.functions.constants import FUZZY_DEN, FUZZY_NUM


def _trigrams(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8).astype(np.int64)
    return a[:-2] << 16 | a[1:-1] << 8 | a[2:]


def _distinct_in_windows(grams: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` grams, how many distinct ones of those marked in ``count`` it has."""
    n = len(grams)
    order = np.argsort(grams, kind="stable")
    before = np.full(n, -1)
    same = grams[order[1:]] == grams[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    j = np.flatnonzero(count)
    first, last = np.maximum(before[j] + 1, j - width + 1), j
    step = np.zeros(n + 1, np.int64)
    ok = first <= last
    np.add.at(step, np.maximum(first[ok], 0), 1)
    np.add.at(step, last[ok] + 1, -1)
    return np.cumsum(step)[:n - width + 1]


def window_hit(content: bytes, value: bytes, lo: int, hi: int) -> bool:
    """True iff some window content[i:i+L], lo <= i <= hi, has trigram Jaccard
    >= 9/10 with value; content shorter than value is compared whole, once."""
    n, L = len(content), len(value)
    v = np.unique(_trigrams(value))
    if n < L:
        c = np.unique(_trigrams(content)) if n >= 3 else np.zeros(0, np.int64)
        inter = len(np.intersect1d(c, v, assume_unique=True))
        union = len(c) + len(v) - inter
        return union == 0 or FUZZY_DEN * inter >= FUZZY_NUM * union
    lo, hi = max(0, int(lo)), min(n - L, int(hi))
    if lo > hi:
        return False
    if L < 3:  # no trigrams on either side
        return True
    grams = _trigrams(content[lo:hi + L])
    distinct = _distinct_in_windows(grams, np.ones(len(grams), bool), L - 2)
    inter = _distinct_in_windows(grams, np.isin(grams, v), L - 2)
    return bool((FUZZY_DEN * inter >= FUZZY_NUM * (distinct + len(v) - inter)).any())


# Ship this module's code with the UDF, so workers need no import path to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(BooleanType())
def fuzzy_window_udf(content: pd.Series, value: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """False where the content is null."""
    return pd.Series([c is not None and window_hit(bytes(c), bytes(v), lo_, hi_)
                      for c, v, lo_, hi_ in zip(content, value, lo, hi)], dtype=bool)
