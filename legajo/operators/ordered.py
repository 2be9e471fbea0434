"""Running values along an order inside each key, when one key may hold a large part of the rows.

A window by key puts the whole key into one task.  Here rows are range-partitioned by key and order and written once; the
window runs inside each block, and what a block must know of those before (or after) it is carried over as one row per
key and block.  Only keys that span several blocks have such rows, at most two for each block, so they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

BLOCK = "_bloque"
#: A fixed number of blocks; by default the session's shuffle partitions, joined where they are small.
BLOCKS: int | None = None


def blocked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with the number of the range block that holds them, computed once."""
    return checkpointed((df.repartitionByRange(BLOCKS, key, *order) if BLOCKS else df.repartitionByRange(key, *order)).withColumn(BLOCK, F.spark_partition_id()))


def _spanning(rows: DataFrame, key: str, summary: Column, name: str) -> DataFrame:
    """(key, block, name) of keys that span several blocks."""
    per = rows.groupBy(key, BLOCK).agg(summary.alias(name))
    return per.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n > 1").drop("_n")


def _with_carry(rows: DataFrame, key: str, summary: Column, carried: Column) -> DataFrame:
    """Rows with _carry: ``carried`` over the key's other blocks."""
    carry = _spanning(rows, key, summary, "_s").withColumn("_carry", carried).select(F.col(key).alias("_k"), F.col(BLOCK).alias("_b"), "_carry")
    return rows.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("_k")) & (F.col(BLOCK) == F.col("_b")), "left").drop("_k", "_b")


def _before(key: str) -> Window:
    return Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _inside(key: str, order: list[str]) -> Window:
    return Window.partitionBy(key, BLOCK).orderBy(*order)


def forward_filled(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row of its key; null where there is none yet."""
    rows = blocked(df.withColumn("_v", value), key, order)
    rows = _with_carry(rows, key, F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))), F.last("_s", ignorenulls=True).over(_before(key)))
    local = F.last("_v", ignorenulls=True).over(_inside(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(local, "_carry")).drop("_v", "_carry", BLOCK)


def previous_max(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The greatest value of the rows before each row of its key; null for the first."""
    rows = blocked(df, key, order)
    rows = _with_carry(rows, key, F.max(value), F.max("_s").over(_before(key)))
    local = F.max(value).over(_inside(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.greatest(local, "_carry")).drop("_carry", BLOCK)


def next_value(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The value of the row after each row of its key; null for the last."""
    rows = blocked(df, key, order)
    later = Window.partitionBy(key).orderBy(F.desc(BLOCK)).rowsBetween(-1, -1)
    rows = _with_carry(rows, key, F.min_by(value, F.struct(*order)), F.first("_s").over(later))
    w = _inside(key, order)
    last = F.row_number().over(Window.partitionBy(key, BLOCK).orderBy(*[F.desc(o) for o in order])) == 1
    return rows.withColumn(name, F.when(last, F.col("_carry")).otherwise(F.lead(value).over(w))).drop("_carry", BLOCK)


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of the rows before each row of its key; 0 for the first."""
    rows = blocked(df.withColumn("_v", value), key, order)
    rows = _with_carry(rows, key, F.sum("_v"), F.sum("_s").over(_before(key)))
    local = F.sum("_v").over(_inside(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, F.coalesce(local, F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_v", "_carry", BLOCK)


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """The number of each row in its key, from 1."""
    return running_sum(df, key, order, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) + 1)
