"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, shared_folder

__all__ = ["checkpointed", "map_text", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(df: DataFrame, key: str, text: str, schema: str, fn: Callable[[object, str], Iterator[tuple]], *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Flat-map each row's text in Arrow batches; only the needed columns cross to Python.

    ``fn(key, text, *carry)`` yields output tuples in the order of ``schema``.
    Null texts never reach ``fn``.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = [row for args in zip(*columns) if args[1] is not None for row in fn(*args)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

    picked = [F.col(f"`{c}`") for c in (key, text, *carry)]
    return df.select(*picked).mapInArrow(run, schema)
