"""Bloom filters of 64-bit keys, built on the executors and broadcast.

Their size is fixed whatever the corpus; a fuller filter lets more rows through to the exact step behind it and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: 16 MB.
FILTER_WORDS = 1 << 21
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a key in the filter."""
    n = np.uint64(FILTER_WORDS * 64)
    a = keys * _M1
    a ^= a >> np.uint64(31)
    b = (keys ^ _M3) * _M2
    b ^= b >> np.uint64(29)
    return a % n, b % n


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64)))
        words, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
        bits = np.zeros(len(words), dtype=np.uint64)
        np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])


def filter_of(keys: DataFrame):
    """The filter, broadcast, of the one long column of ``keys``; at most ``FILTER_WORDS`` rows reach the driver."""
    parts = keys.dropna().mapInArrow(_parts, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, dtype=np.uint64)
    words[parts.column("word").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def passes(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter: all that are, and few others."""
    a, b = _places(keys.view(np.uint64))
    return ((words[a >> np.uint64(6)] >> (a & np.uint64(63))) & (words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)


def may_have(key: Column, words) -> Column:
    """``passes`` as a column, for a long column without nulls; other columns don't travel to Python."""

    @F.pandas_udf("boolean")
    def named(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(keys.to_numpy(dtype=np.int64), words.value))

    return named(key)
