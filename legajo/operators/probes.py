"""Literal passages of a bounded set of items inside a corpus: windows of words held against item hashes in place.

Items' window hashes are sorted and sent to the rows while they are few (checked by count); the corpus's windows never
cross the shuffle, only hits do, and those are compared as texts.  Beyond the bound the hashes of both sides are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many item windows their hashes (8 bytes each) are broadcast.
SENT_WINDOWS = 1 << 21

_WORD = re.compile(r"\w+")


def word_windows(text: str, size: int, step: int = 1) -> list[str]:
    """Windows of ``size`` words in lower case, joined by spaces."""
    words = _WORD.findall(text.replace("İ", "I").lower())
    return [" ".join(words[i : i + size]) for i in range(0, len(words) - size + 1, step)]


def _hashes(windows: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in windows), np.uint64, len(windows)).astype(np.int64)


def hashed(df: DataFrame, key: str, text: str, size: int, step: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, h, ventana): the distinct windows of each text."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for *keys, t in zip(f[key], *(f[c] for c in carry), f[text]):
                ws = list(dict.fromkeys(word_windows(t, size, step)))
                rows += [(*keys, h, w) for h, w in zip(_hashes(ws).tolist(), ws)]
            yield pd.DataFrame(rows, columns=[key, *carry, "h", "ventana"])

    return df.select(key, *carry, text).where(F.col(text).isNotNull()).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry)) + ", h bigint, ventana string")


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of word hashes."""
    n = len(ids) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        out = out * np.uint64(0x100000001B3) + ids[i : i + n]
    return out


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, size: int = 24, step: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, item, carry): documents that hold ``size`` consecutive words of an item, at every ``step`` of the item."""
    probes = hashed(items, item, item_text, size, step, carry)
    spark, kind = documents.sparkSession, dict(documents.dtypes)[key]
    few = probes.limit(SENT_WINDOWS + 1).select("ventana").distinct()
    rolled = None
    if probes.select(F.count(F.lit(1))).first()[0] <= SENT_WINDOWS:
        windows = [r.ventana for r in few.collect()]
        rolled = spark.sparkContext.broadcast(np.unique(np.array([rolling(_word_ids(w.split(" ")), size)[0] for w in windows], np.uint64)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text]):
                words = _WORD.findall(t.replace("İ", "I").lower())
                if len(words) < size:
                    continue
                if rolled is None:
                    at = range(len(words) - size + 1)
                else:
                    h = rolling(_word_ids(words), size)
                    i = np.searchsorted(rolled.value, h)
                    i[i == len(rolled.value)] = 0
                    at = np.flatnonzero(rolled.value[i] == h) if len(rolled.value) else ()
                rows += [(k, w) for w in dict.fromkeys(" ".join(words[i : i + size]) for i in at)]
            yield pd.DataFrame(rows, columns=[key, "ventana"])

    found = documents.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, ventana string")
    return found.join(probes.select(item, *carry, "ventana"), "ventana").select(key, item, *carry).distinct()


class _Ids(dict):
    """64-bit hash of a word; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_IDS = _Ids()


def _word_ids(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_IDS.__getitem__, words), np.uint64, len(words))
