"""Problem 7: encoding of the corpus with a public byte-level BPE vocabulary.

Pre-tokens are looked up in two tiers.  A minimal perfect hash over the vocabulary resolves those that are tokens as a
whole; what it doesn't hold goes through byte-pair merging with a heap over linked bytes, in n log n steps whatever
the pre-token's length.  The tables are built once on the driver from the vocabulary file (a fixed size: 50,256
tokens) and sent to the executors as a broadcast variable; a bounded memo in each worker keeps recent pre-tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Keys of one displacement bucket on average, and entries of a worker's memo.
BUCKET, MEMO = 2, 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """The tokens in order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(i): base64.b64decode(t) for t, i in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ids of the vocabulary must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of fixed byte strings by hash and displace: n slots for n keys, one displacement a bucket.

    ``find`` returns a key's number, or -1: the key in the slot is compared, so no other string is taken for a key.
    """

    def __init__(self, keys: list[bytes], seed: int = 0) -> None:
        n = len(keys)
        self.keys, self.n, self.buckets = keys, n, max(1, n // BUCKET)
        while True:
            hashes = [xxhash.xxh64_intdigest(k, seed) for k in keys]
            if len(set(hashes)) < n:
                seed += 1
                continue
            groups: list[list[int]] = [[] for _ in range(self.buckets)]
            for i, h in enumerate(hashes):
                groups[(h >> 40) % self.buckets].append(i)
            slots, shift, free = [-1] * n, [0] * self.buckets, n
            for b, group in sorted(enumerate(groups), key=lambda x: -len(x[1])):
                if len(group) == 1:
                    # what is left over fills the free slots directly: a negative displacement names the slot
                    free -= 1
                    while slots[free] >= 0:
                        free -= 1
                    slots[free], shift[b] = group[0], -1 - free
                elif group and not self._place(group, hashes, slots, shift, b):
                    break
            else:
                break
            seed += 1
        self.seed, self.slots, self.shift = seed, slots, shift

    def _place(self, group: list[int], hashes: list[int], slots: list[int], shift: list[int], bucket: int) -> bool:
        n = self.n
        for d in range(1 << 16):
            at = [((hashes[i] & 0xFFFFFFFF) + d * ((hashes[i] >> 32) | 1)) % n for i in group]
            if len(set(at)) == len(at) and all(slots[a] < 0 for a in at):
                for i, a in zip(group, at):
                    slots[a] = i
                shift[bucket] = d
                return True
        return False

    def find(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.shift[(h >> 40) % self.buckets]
        i = self.slots[-1 - d if d < 0 else ((h & 0xFFFFFFFF) + d * ((h >> 32) | 1)) % self.n]
        return i if self.keys[i] == key else -1


class Encoder:
    """Ids of pre-tokens by two-tier lookup."""

    def __init__(self, keys: list[bytes], index: PerfectHash | None = None) -> None:
        self.index = index or PerfectHash(keys)
        self.memo = _Memo(self)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Byte-pair merging: the pair of lowest id first, of equal ones the leftmost."""
        find, n = self.index.find, len(data)
        end = list(range(1, n + 1))  # end of the part that begins here; 0 once it was merged into its left neighbour
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(data[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            b = end[a]
            if not b or b >= n or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                left[stop] = a
                if (r := find(data[a : end[stop]])) >= 0:
                    heapq.heappush(heap, (r, a, end[stop]))
            p = left[a]
            if p >= 0 and (r := find(data[p:stop])) >= 0:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(find(data[i : end[i]]))
            i = end[i]
        return tuple(out)

    def word(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "replace")
        i = self.index.find(data)
        return (i,) if i >= 0 else self.merge(data)


class _Memo(dict):
    """Ids of recent pre-tokens; emptied when full, so its size is bounded."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.encoder.word(text)
        if len(text) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[text] = ids
        return ids


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[list[bytes], PerfectHash]:
    keys = read_ranks(path)
    return keys, PerfectHash(keys)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, carry: str | None = None) -> DataFrame:
    """(key, ids), and the column ``carry`` if given: the ids of every text as stored; an empty list for empty and null texts.  Repeated rows stay.

    Strings that look like special tokens are ordinary text.  A narrow map: no shuffle, one pass.
    """
    import regex  # noqa: F401  (fails here rather than on an executor)

    spark = documents.sparkSession
    tables = spark.sparkContext.broadcast(_tables(path or vocabulary_path()))
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [F.col(f"`{c}`") for c in ((key, carry) if carry else (key,))]
    around = documents.select(*kept).schema
    target = to_arrow_schema(around).append(pa.field("ids", pa.list_(pa.int32())))
    at_text = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words = regex.compile(PATTERN).findall
        keys, index = tables.value
        memo = Encoder(keys, index).memo
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                flat: list[int] = []
                ends = [0]
                for t in batch.column(at_text).to_pylist():
                    if t:
                        flat.extend(chain.from_iterable(map(memo.__getitem__, words(t))))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(target.field(i).type) for i in range(at_text)), ids], schema=target)

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in around)
    return documents.select(*kept, F.col(f"`{text}`")).mapInArrow(run, ddl + "ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encoded(table(spark, sf_dir, "documents"))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by language: documents and tokens (the corpus's size in tokens)."""
    rows = encoded(table(spark, sf_dir, "documents"), carry="lang")
    return rows.groupBy(F.coalesce(F.lower("lang"), F.lit("und")).alias("lang")).agg(F.count(F.lit(1)).alias("documentos"), F.sum(F.size("ids").cast("bigint")).alias("tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_lengths": p7_lengths}
SQL: dict[str, str] = {}
