"""Near duplicates: pairs of texts by the five-word shingles that they share."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions import text as T
from ..sources.shared import checkpointed

#: Counters of the sketch that orders shingles, in blocks; they decide how fast pairs are found, never which.
COUNTERS, BLOCK = 1 << 22, 1 << 16
#: Shingles that a pair's prefixes must share.
SHARED = 4
#: Texts of candidate pairs up to which their ids are broadcast.
BROADCAST_IDS = 200_000

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of a text's word hashes."""
    n = len(words) - 4
    s = sum(words[i : n + i] * odd for i, odd in enumerate(_ODD))
    s ^= s >> np.uint64(29)
    s *= _ODD[1]
    return s ^ (s >> np.uint64(32))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _texts(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for i, j in zip(ends[:-1], ends[1:]):
        yield values[i:j]


def levels(hashed: DataFrame) -> bytes:
    """How frequent the shingles of each counter are, in steps of a sixth of a doubling, from (words,) of the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for words in _texts(batch.column(0)):
                if len(words) >= 5:
                    np.add.at(sums, _counter(_shingles(words)), 1)
        for i in range(0, COUNTERS, BLOCK):
            if (part := sums[i : i + BLOCK]).any():
                yield pa.RecordBatch.from_pydict({"b": pa.array([i // BLOCK], pa.int32()), "n": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(n), np.int64)
                sums[b] = sums[b] + part if b in sums else part
        for b, n in sums.items():
            yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "n": pa.array([(6 * np.log2(1 + n)).astype(np.uint8).tobytes()], pa.binary())})

    out = bytearray(COUNTERS)
    for r in hashed.select("words").mapInArrow(count, "b int, n binary").repartition("b").mapInArrow(add, "b int, n binary").toLocalIterator():
        out[r.b * BLOCK : (r.b + 1) * BLOCK] = r.n
    return bytes(out)


def prefixes(hashed: DataFrame) -> DataFrame:
    """(doc_id, h, n, p): each row's words as one hash, its number of different shingles and the first of them, rarest first.

    A similar set shares some of these.  Rows of fewer than five words are left out.
    """
    order = hashed.sparkSession.sparkContext.broadcast(levels(hashed))
    kinds = StructType([hashed.schema["doc_id"], StructField("h", BinaryType()), StructField("n", LongType())])
    ddl = f"doc_id {kinds[0].dataType.simpleString()}, h binary, n bigint, p array<bigint>"
    schema = to_arrow_schema(kinds).append(pa.field("p", pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(order.value, np.uint8)
        for batch in batches:
            rows, hashes, sizes, firsts = [], [], [], []
            for i, words in enumerate(_texts(batch.column(1))):
                if len(words) < 5:
                    continue
                s = np.unique(_shingles(words))
                rows.append(i)
                hashes.append(blake2b(words, digest_size=16).digest())
                sizes.append(len(s))
                firsts.append(s[np.argsort(level[_counter(s)], kind="stable")[: len(s) // 5 + SHARED]])
            if rows:
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                p = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hashes, schema[1].type), pa.array(sizes, pa.int64()), p], schema=schema)

    return hashed.select("doc_id", "words").mapInArrow(run, ddl)


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b): pairs whose prefixes share enough at places that may reach a Jaccard similarity of 0.8, from (doc_id, n, p).

    The join is a merge join by hint: estimates of size don't see how long an array is, so that exploded ones pass for small
    enough to be broadcast.
    """
    prefix = texts.select("doc_id", "n", F.posexplode("p").alias("r", "g")).withColumn("r", F.col("r") + 1)
    a, b = (prefix.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("r").alias(f"r{k}"), "g") for k in "ab")
    fits = "a < b AND 5 * nb >= 4 * na AND 5 * na >= 4 * nb AND 9 * (least(ra, rb) + least(na - ra, nb - rb)) >= 4 * (na + nb)"
    hits = a.join(b.hint("merge"), "g").where(fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("na", "nb")).alias("m"))
    return hits.where(f"c >= least({SHARED}, ceil(0.8 * m))").select("a", "b")


def near_pairs(docs: DataFrame, **more: Column) -> DataFrame:
    """(a, b, parecido, and each of more as name_a, name_b): pairs of different texts, each by its smallest id, with a Jaccard similarity of 0.8 or more, from (doc_id, text).

    Shingles are ordered by a sketch of their frequency, then by their hash; any order that is the same for all texts finds all
    pairs, a rare-first one finds few others.  Of two sets so similar the first four shingles that they share stand among
    the first n - ceil(0.8 n) + 4 of each (all that they must share, where that is fewer).  Only these are shuffled.  Lengths
    and places that can't reach the similarity are left out in the join, and candidates are verified on the whole sets, read
    again from their texts; no pair is lost.  Only the candidates' ids are broadcast; what grows with texts or pairs never is.
    """
    w = T.tokens(F.col("text"))
    hashed = docs.select("doc_id", F.transform(w, lambda x: F.xxhash64(x)).alias("words"))
    texts = prefixes(hashed).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("p").alias("p"))
    pairs = checkpointed(candidates(texts.select("doc_id", "n", "p")))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " "))))
    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", w.alias("w"), *[c.alias(k) for k, c in more.items()]).select("doc_id", grams.alias("g"), *more)
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("g").alias(f"g{x}"), *[F.col(k).alias(f"{k}_{x}") for k in more]).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    total = F.size("ga") + F.size("gb") - common
    return both.where(5 * common >= 4 * total).select("a", "b", F.round(common / total, 6).alias("parecido"), *[f"{k}_{x}" for k in more for x in "ab"])
