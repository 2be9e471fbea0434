"""Readers and sinks.  Schemas are given, never inferred, wherever a format has none of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; projections and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, fields: list[str] | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped.  With ``fields`` only those are parsed."""
    wanted = StructType([schema[f] for f in fields]) if fields else schema
    return spark.read.schema(wanted).json(path)


def read_strict_jsonl(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """JSON lines that must parse, with a key that is present and unique; the first breach raises with its place in its file.

    The check is part of the plan: it runs with the query, distributed, and nothing is collected.  A leading byte-order
    mark is dropped.  The place is that of the line's first byte, as a distributed reader knows it.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v"), F.col("_metadata.file_name").alias("_archivo"), (F.col("_metadata.file_block_start")).alias("_bloque")).where(F.trim("v") != "")
    whole = StructType([*schema.fields]).add("_roto", "string")
    parsed = lines.select("v", "_archivo", "_bloque", F.from_json("v", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_roto"}).alias("r")).select("v", "_archivo", "_bloque", "r.*")
    checked = parsed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    at = F.concat(F.lit(" in "), "_archivo", F.lit(" block "), F.col("_bloque").cast("string"), F.lit(": "), F.left("v", F.lit(80)))
    breach = F.when(F.col("_roto").isNotNull(), F.concat(F.lit("not a JSON object"), at)).when(F.col(key).isNull(), F.concat(F.lit("no key"), at)).when(F.col("_n") > 1, F.concat(F.lit("repeated key"), at))
    return checked.withColumn("_mal", F.when(breach.isNotNull(), F.raise_error(breach).cast("string"))).where(F.col("_mal").isNull()).select(*[f.name for f in schema.fields])


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with columns in sorted order; the commit protocol makes the result appear at once."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Whole JSON documents, one a file; a file that doesn't exist is an empty table."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row; numbers that JSON lacks raise."""
    bad = [F.isnan(c) for c, t in df.dtypes if t in ("double", "float")]
    checked = df
    for b in bad:
        checked = checked.where(F.when(F.coalesce(b, F.lit(False)), F.raise_error(F.lit("not a number")).cast("boolean")).otherwise(True))
    write_jsonl(checked, path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header; a file that doesn't exist is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """The union of the parts' columns in first-seen order."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    whole.write.mode("overwrite").option("header", True).csv(path)


def restored(c: Column) -> Column:
    """struct(tipo, entero, decimal, logico, texto) of a CSV cell: empty is null, True and False, integers, decimals, else text."""
    kind = F.when(c.isNull() | (c == ""), "nulo").when(c.isin("True", "False"), "logico").when(c.rlike(r"^-?\d+$"), "entero").when(c.rlike(r"^-?\d+\.\d+$"), "decimal").otherwise("texto")
    return F.struct(kind.alias("tipo"), F.when(kind == "entero", F.try_to_number(c, F.lit("S" + "9" * 18)).cast("bigint")).alias("entero"), F.when(kind == "decimal", c.cast("double")).alias("decimal"), F.when(kind == "logico", c == "True").alias("logico"), F.when(kind == "texto", c).alias("texto"))


def relative(path: Column, folder: str) -> Column:
    """A file's path below a folder."""
    return F.regexp_replace(path, rf"^.*\Q/{folder.rstrip('/').rsplit('/', 1)[-1]}/\E", "")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(archivo, n) of all files below a folder, by relative path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(relative(F.col("path"), folder).alias("archivo"), F.col("length").alias("n"))


def verified_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(archivo, existe, tamano_ok, huella_ok) of expected(archivo, sha256, bytes), archivo being a path below the folder.

    A path that leaves the folder never exists.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    seen = files.select(relative(F.col("path"), folder).alias("archivo"), F.sha2("content", 256).alias("h"), F.col("length").alias("n"))
    inside = ~F.col("archivo").rlike(r"(^|/)\.\.(/|$)|^/")
    joined = expected.join(seen, "archivo", "left").withColumn("h", F.when(inside, F.col("h")))
    return joined.select("archivo", F.col("h").isNotNull().alias("existe"), F.coalesce(F.col("h").isNotNull() & (F.col("n") == F.col("bytes")), F.lit(False)).alias("tamano_ok"), F.coalesce(F.col("h") == F.col("sha256"), F.lit(False)).alias("huella_ok"))


def untracked_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Files below a folder that nothing refers to, by relative path."""
    return listing(spark, folder).select("archivo").join(expected.select("archivo"), "archivo", "left_anti")


def texts_by_id(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(doc_id, texto) of expected(doc_id, archivo, sha256): whole text files below a folder; a missing, altered or outside file raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(relative(F.col("path"), folder).alias("archivo"), F.decode("content", "UTF-8").alias("texto"), F.sha2("content", 256).alias("_h"))
    joined = expected.join(files, "archivo", "left")
    breach = F.when(F.col("archivo").rlike(r"(^|/)\.\.(/|$)|^/"), F.lit("outside the folder: ")).when(F.col("texto").isNull(), F.lit("missing: ")).when(F.col("_h") != F.col("sha256"), F.lit("altered: "))
    return joined.select("doc_id", F.when(breach.isNotNull(), F.raise_error(F.concat(breach, "archivo")).cast("string")).otherwise(F.col("texto")).alias("texto"))


def write_once(df: DataFrame, path: str) -> None:
    """A frozen version: an existing one is never replaced."""
    df.write.mode("errorifexists").parquet(path)


def ordered_lookup(table: DataFrame, key: str, wanted: DataFrame, order: str) -> DataFrame:
    """The rows of wanted keys with the place they were asked in; keys that the table lacks have no row."""
    return wanted.join(table, key)


def page_after(table: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """The next ``size`` rows after a key, in its order; the filter reaches the scan."""
    return (table if after is None else table.where(F.col(key) > after)).orderBy(key).limit(size)


# ---- snapshots and patches ----------------------------------------------------------------------------------------------


def snapshot_id(files: DataFrame, name: str, digest: str, groups: int = 4096) -> DataFrame:
    """(instantanea, archivos): one hash of all files' names and hashes, in two levels so that no task holds them all.

    Names are put into hash groups; each group's sorted lines are hashed, then the groups' hashes in order.
    """
    line = F.concat_ws("\t", name, digest)
    per = files.groupBy(F.pmod(F.xxhash64(name), F.lit(groups)).alias("_g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_g", "_h"))), lambda x: x["_h"]), "\n"), 256).alias("instantanea"), F.coalesce(F.sum("_n"), F.lit(0)).alias("archivos"))


def patched(table: DataFrame, key: str, field: str, evidence: str, patches: DataFrame) -> DataFrame:
    """table with patches(key, esperado, nuevo, prueba) applied to a field, and what became of each (cambio).

    A patch holds only while the field still has the expected value and the row's evidence text holds the patch's proof
    literally; one that was applied before changes nothing.  Rows without a patch have a null cambio.
    """
    p = patches.select(F.col(key).alias("_k"), "esperado", "nuevo", "prueba")
    rows = table.join(p, F.col(key) == F.col("_k"), "left")
    kind = (
        F.when(F.col("_k").isNull(), F.lit(None)).when(F.col(field).eqNullSafe(F.col("nuevo")), "ya_aplicado").when(~F.col(field).eqNullSafe(F.col("esperado")), "valor_distinto")
        .when(~F.coalesce(F.contains(F.col(evidence), F.col("prueba")), F.lit(False)), "sin_prueba").otherwise("aplicado")
    )
    return rows.withColumn("cambio", kind).withColumn(field, F.when(F.col("cambio") == "aplicado", F.col("nuevo")).otherwise(F.col(field))).drop("_k", "esperado", "nuevo", "prueba")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """before's and after's snapshots in one row, with whether they are equal; a run's inputs must not change meanwhile."""
    return before.select(F.col("instantanea").alias("antes")).crossJoin(after.select(F.col("instantanea").alias("despues"))).withColumn("igual", F.col("antes") == F.col("despues"))


def write_index(vectors: DataFrame, path: str, cell: str) -> None:
    """A vector index (key, vector, cell) as Parquet, a folder a cell, so that a search reads only the cells it probes; never replaced."""
    vectors.write.mode("errorifexists").partitionBy(cell).parquet(path)


def read_index(spark: SparkSession, path: str, expected_rows: int, dimension: int, vector: str) -> DataFrame:
    """An index whose rows, dimension and values were checked; a breach raises."""
    index = spark.read.parquet(path)
    seen = index.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count_if(F.exists(vector, lambda x: F.isnan(x))).alias("nan")).first()
    if seen.n != expected_rows or seen.n and (seen.lo, seen.hi, seen.nan) != (dimension, dimension, 0):
        raise ValueError(f"the index isn't what was written: {seen}")
    return index
