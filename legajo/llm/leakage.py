"""Problem 8: passages of evaluation items inside the training text.

Windows of twelve words are hashed through spaced seeds: fixed masks that ignore some positions, so a window whose
ignored words were replaced still hits.  The test items' hashes go into a bit set, sized by their count, that every
training window is held against in place; only the hits are joined with the test windows, and the words around a hit are
compared: all twelve for a leak, most of them for a near leak.  Above BIT_SET_HASHES the bit set would no longer be small,
and the seeds of both sides are joined by shuffle instead.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_text, table

WINDOW = 12
#: Each mask looks at two of four interleaved groups of three positions and ignores the others.  Any two positions lie in at
#: most two groups, which some mask ignores, so a window with one or two replaced words hits through at least one mask.
GROUPS = tuple(tuple(range(g, WINDOW, 4)) for g in range(4))
MASKS = tuple(combinations(range(4), 2))
#: Bits for each hash, so that one window in so many hits by chance; and the smallest bit set.
SPARSE, LEAST_BITS = 64, 1 << 20
#: Up to so many hashes the bit set (128 MB at most, compressed to less) is broadcast.
BIT_SET_HASHES = 1 << 24
#: Windows with at least so many equal words count as near leaks.
NEAR = 10
#: Up to this size of the test windows (checked by count) a hit is joined by broadcast, else by shuffle.
BROADCAST_WINDOWS = 200_000

_MULTIPLIERS = np.array([int.from_bytes(xxhash.xxh64_digest(b"%d" % i), "big") | 1 for i in range(WINDOW)], np.uint64)
_OTHER = re.compile(r"[^\x00-\xff]")


def _byte(b: int) -> int:
    c = chr(b)
    if not c.isalnum():
        return 32
    base = unicodedata.normalize("NFD", c.lower())[0]
    return ord(base) if ord(base) < 256 else b


_FOLD = bytes(_byte(b) for b in range(256))


def _wide(m: re.Match) -> str:
    """A character outside Latin-1: nothing for a combining mark, its base letter, a spelt-out letter, or a gap."""
    c = m.group()
    if unicodedata.combining(c):
        return ""
    base = unicodedata.normalize("NFD", c.lower())[0]
    if not base.isalnum():
        return " "
    return base if ord(base) < 256 else f"þ{ord(base):x}þ"


def words(text: str) -> list[bytes]:
    """Maximal runs of letters and digits, without case and accents."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        data = _OTHER.sub(_wide, text).encode("latin-1", "replace")
    return data.translate(_FOLD).split()


class _Hashes(dict):
    """64-bit hash of a word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def seed_hashes(tokens: list[bytes], masks: int = len(MASKS)) -> np.ndarray:
    """One row for each of the first masks, one column for each window."""
    n = len(tokens) - WINDOW + 1
    if n <= 0:
        return np.empty((masks, 0), np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    parts = [sum(h[p : p + n] * _MULTIPLIERS[p] for p in group) for group in GROUPS]
    out = np.empty((masks, n), np.uint64)
    for m, (a, b) in enumerate(MASKS[:masks]):
        out[m] = parts[a] + parts[b]
        out[m] ^= np.uint64(m)
        out[m] ^= out[m] >> np.uint64(29)
        out[m] *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def test_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campo, id, texto): the texts of the items that count, each once."""
    questions, key = table(spark, sf_dir, "preguntas"), table(spark, sf_dir, "clave_oro")
    parts = (
        questions.select(F.lit("pregunta").alias("campo"), "id", F.col("pregunta").alias("texto")),
        key.select(F.lit("pregunta").alias("campo"), "id", F.col("pregunta").alias("texto")),
        key.select(F.lit("respuesta_esperada").alias("campo"), "id", F.col("respuesta_esperada").alias("texto")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("texto IS NOT NULL").distinct()


def _item_seeds(items: DataFrame, masks: int) -> DataFrame:
    """(h, id, campo, ventana): the seed hashes of the items' windows with the windows' words."""

    def fn(item: object, text: str, field: str) -> Iterator[tuple]:
        tokens = words(text)
        for column, row in enumerate(seed_hashes(tokens, masks).T.astype(np.int64).tolist()):
            window = b" ".join(tokens[column : column + WINDOW]).decode("latin-1")
            for h in row:
                yield h, item, field, window

    kind = dict(items.dtypes)["id"]
    return map_text(items, "id", "texto", f"h bigint, id {kind}, campo string, ventana string", lambda k, t, c: fn(k, t, c), carry=("campo",)).distinct()


def bit_count(hashes: int) -> int:
    """The size of the bit set for so many hashes: a power of two."""
    return max(LEAST_BITS, 1 << (SPARSE * max(1, hashes) - 1).bit_length())


def _bit_set(seeds: DataFrame, size: int) -> bytes:
    """The hashes folded to ``size`` bits; what reaches the driver is one bit set for each partition, never the hashes."""
    schema = pa.schema([("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) % np.uint64(size)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], schema=schema)

    import zlib

    total = np.zeros(size // 8, np.uint8)
    for row in seeds.select("h").coalesce(4).mapInArrow(run, "b binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(row.b), np.uint8)
    return zlib.compress(total.tobytes(), 1)


def hits(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: int = WINDOW) -> DataFrame:
    """(key, id, campo, iguales): documents with an item's passage, and the most equal words of a window.

    ``least`` (NEAR or more) of the window's words must be equal at their places.  Null and short texts have no windows; repeated rows
    and items with equal texts are each reported; empty tables give no rows.
    """
    spark = documents.sparkSession
    exact = least >= WINDOW
    # equal windows hit through every mask: three of them are enough
    masks = 3 if exact else len(MASKS)
    seeds = checkpointed(_item_seeds(items, masks))
    count = seeds.count()
    size = bit_count(count)
    packed = spark.sparkContext.broadcast(_bit_set(seeds, size)) if count <= BIT_SET_HASHES else None
    key_kind = dict(documents.dtypes)[key]
    state: dict = {}

    def fn(k: object, t: str) -> Iterator[tuple]:
        if packed and "bits" not in state:
            import zlib

            state["bits"] = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        tokens = words(t)
        if len(tokens) < WINDOW:
            return
        hashes = seed_hashes(tokens, masks)
        if packed:
            at = hashes % np.uint64(size)
            hit = (state["bits"][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        else:
            hit = np.ones(hashes.shape, np.uint8)
        if exact:
            # equal windows hit through every mask; one of the hits is enough
            hit[0] &= hit[1] & hit[2]
            hit[1:] = 0
        seen = set()
        for m, column in zip(*np.nonzero(hit)):
            window = b" ".join(tokens[column : column + WINDOW]).decode("latin-1")
            if (m, window) not in seen:
                seen.add((m, window))
                yield k, int(hashes[m, column].astype(np.int64)), window

    found = map_text(documents, key, text, f"`{key}` {key_kind}, h bigint, leida string", fn)
    side = F.broadcast(seeds) if count <= BROADCAST_WINDOWS else seeds
    same = F.size(F.filter(F.zip_with(F.split("leida", " "), F.split("ventana", " "), lambda a, b: a == b), lambda x: x))
    return found.join(side, "h").withColumn("iguales", same).where(F.col("iguales") >= least).groupBy(key, "id", "campo").agg(F.max("iguales").alias("iguales"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twelve or more consecutive words of an item, and the item."""
    return hits(table(spark, sf_dir, "documents"), test_windows(spark, sf_dir)).select("doc_id", "id").distinct()


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with up to two replaced words in the window: doc_id, id, campo and the most equal words."""
    return hits(table(spark, sf_dir, "documents"), test_windows(spark, sf_dir), least=NEAR)


QUERIES = {"p8_found": p8_found, "p8_near": p8_near}
SQL = {
    "p8_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT id, pregunta AS t FROM preguntas UNION SELECT id, pregunta FROM clave_oro UNION SELECT id, respuesta_esperada FROM clave_oro),
q AS (SELECT id, regexp_extract_all(strip_accents(lower(t)), '[\p{L}\p{N}]+') AS w FROM t WHERE t IS NOT NULL),
a AS (SELECT DISTINCT id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM q)),
b AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM w))
SELECT DISTINCT doc_id, id FROM a JOIN b USING (g)""",
    # a window with two replaced words keeps one of its three blocks of four words whole
    "p8_near": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT 'pregunta' AS campo, id, pregunta AS t FROM preguntas UNION SELECT 'pregunta', id, pregunta FROM clave_oro UNION SELECT 'respuesta_esperada', id, respuesta_esperada FROM clave_oro),
q AS (SELECT campo, id, regexp_extract_all(strip_accents(lower(t)), '[\p{L}\p{N}]+') AS w FROM t WHERE t IS NOT NULL),
a AS (SELECT DISTINCT campo, id, w[i : i + 11] AS x FROM (SELECT campo, id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM q)),
b AS (SELECT DISTINCT doc_id, w[i : i + 11] AS y FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM w)),
ka AS (SELECT campo, id, x, k, array_to_string(x[4 * k + 1 : 4 * k + 4], ' ') AS g FROM a, range(0, 3) r(k)),
kb AS (SELECT doc_id, y, k, array_to_string(y[4 * k + 1 : 4 * k + 4], ' ') AS g FROM b, range(0, 3) r(k)),
p AS (SELECT DISTINCT doc_id, id, campo, x, y FROM ka JOIN kb USING (k, g)),
n AS (SELECT doc_id, id, campo, len(list_filter(range(1, 13), lambda i: x[i] = y[i])) AS iguales FROM p)
SELECT doc_id, id, campo, max(iguales)::INT AS iguales FROM n WHERE iguales >= 10 GROUP BY 1, 2, 3""",
}
