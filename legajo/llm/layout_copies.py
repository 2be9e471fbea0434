"""Problem 5: copies that differ in white space, case, punctuation or field order only.

Everything is built-in expressions: a canonical key per row, counted exactly with map-side partial counts; keys whose
count passes a bound are hot.  Hot keys are salted into a two-level aggregation, all others go through one shuffle by
key; the representative of a group is its smallest id.  The hot keys' table is bounded by rows / threshold, which the
threshold keeps at HOT_KEYS at most, so it may be broadcast at any scale.  The keys are computed once and written to the
shared checkpoint folder: (id, hash) only, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Upper bound of hot keys (each a hash and two longs), hence of what is broadcast.
HOT_KEYS = 10_000
#: No key with fewer rows is ever hot.
HOT_ROWS = 1_000
SALTS = 64

_LABELLED = r"^[^\p{L}\p{N}]*\p{L}[\p{L}.]*(?: +[\p{L}.]+){0,4}\s*[:=]\s*\S"


def letters_and_digits(c: Column) -> Column:
    """The letters (with combining marks) and digits of a text in order, regardless of case."""
    return F.lower(F.upper(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", "")))


def canonical(text: Column) -> Column:
    """What copies of a text share.

    A text made only of two or more labelled fields is its fields in sorted order; any other text its letters and
    digits.  Fields are separated by line breaks, semicolons or bars.
    """
    parts = F.filter(F.split(text, r"\s*[\n\r;|]\s*"), lambda p: F.length(letters_and_digits(p)) > 0)
    fields = (F.size(parts) > 1) & F.forall(parts, lambda p: F.rlike(p, F.lit(_LABELLED)))
    # most texts can't be all fields: the first separator-free stretch of prose settles it without splitting
    likely = text.rlike(_LABELLED)
    return F.when(likely & fields, F.concat_ws("\u0001", F.array_sort(F.transform(parts, letters_and_digits)))).otherwise(letters_and_digits(text))


def keyed(rows: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(id, k): the hash of what copies share; rows without a text or group are left out."""
    t, g = F.col(f"`{text}`"), F.col(f"`{group}`")
    return rows.where(g.isNotNull() & t.rlike(r"(?U)\S")).select(
        F.col(f"`{key}`").alias("id"), F.unhex(F.sha2(F.concat_ws("\u0002", letters_and_digits(g), canonical(t)), 256)).alias("k")
    )


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed rows as (hot keys with their counts, rows of hot keys, all other rows)."""
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    hot = counts.where(F.col("n") > HOT_ROWS).join(F.broadcast(total), F.col("n") > F.col("total") / HOT_KEYS).select("k")
    small = F.broadcast(hot)
    return hot, rows.join(small, "k", "left_semi"), rows.join(small, "k", "left_anti")


def _representatives(hot_rows: DataFrame) -> DataFrame:
    """(k, id_a, copias) of the hot keys, by key and salt first, then by key."""
    return (
        hot_rows.groupBy("k", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
        .agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("copias"))
        .groupBy("k")
        .agg(F.min("id_a").alias("id_a"), F.sum("copias").alias("copias"))
    )


def copies(rows: DataFrame, key: str = "id", group: str = "doc_id", text: str = "texto") -> DataFrame:
    """(id_a, id_b): the smallest id of each group of copies with each other member.

    Null and blank texts and null groups are never copies; an id that occurs twice in the input stands for one row.
    """
    ids = checkpointed(keyed(rows, key, group, text))
    _, hot_rows, rest = _split(ids)
    pairs = hot_rows.join(F.broadcast(_representatives(hot_rows)), "k").select("id_a", F.col("id").alias("id_b"))
    by_key = rest.withColumn("id_a", F.min("id").over(Window.partitionBy("k"))).select("id_a", F.col("id").alias("id_b"))
    return pairs.unionByName(by_key).where("id_b > id_a")


def groups(rows: DataFrame, key: str = "id", group: str = "doc_id", text: str = "texto") -> DataFrame:
    """One row per record: (id, copias): its smallest id and how many copies it had, itself included."""
    _, hot_rows, rest = _split(checkpointed(keyed(rows, key, group, text)))
    one_level = rest.groupBy("k").agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("copias"))
    return _representatives(hot_rows).unionByName(one_level).select(F.col("id_a").alias("id"), "copias")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of chunks against the smallest id of their group."""
    return copies(table(spark, sf_dir, "chunks"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of chunks once, with the number of its copies."""
    return groups(table(spark, sf_dir, "chunks"))


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}

_KEYED = r"""
WITH partes AS (
  SELECT id, doc_id, texto, list_filter(regexp_split_to_array(texto, '\s*[\n\r;|]\s*'), lambda p: length(regexp_replace(p, '[^\p{L}\p{M}\p{N}]+', '', 'g')) > 0) AS p
  FROM chunks WHERE doc_id IS NOT NULL AND regexp_matches(texto, '[^\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]')
), claves AS (
  SELECT id, concat_ws(chr(2), lower(upper(regexp_replace(doc_id, '[^\p{L}\p{M}\p{N}]+', '', 'g'))),
    CASE WHEN len(p) > 1 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[^\p{L}\p{N}]*\p{L}[\p{L}.]*(?: +[\p{L}.]+){0,4}\s*[:=]\s*\S'))) = 0
    THEN array_to_string(list_sort(list_transform(p, lambda x: lower(upper(regexp_replace(x, '[^\p{L}\p{M}\p{N}]+', '', 'g'))))), chr(1))
    ELSE lower(upper(regexp_replace(texto, '[^\p{L}\p{M}\p{N}]+', '', 'g'))) END) AS k FROM partes
)
"""
SQL = {
    "p5_found": _KEYED + "SELECT id_a, id AS id_b FROM (SELECT id, min(id) OVER (PARTITION BY k) AS id_a FROM claves) WHERE id > id_a",
    "p5_groups": _KEYED + "SELECT min(id) AS id, count(*) AS copias FROM claves GROUP BY k",
}
