"""Queries of readers, sinks, snapshots and patches; what they write goes to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as S
from ..sources import tables as X
from ..sources.shared import shared_folder
from ..sources.tables import read
from .registry import registry

QUERIES, SQL, query = registry()


def _place(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query("SELECT seccion, severidad, count(*) AS n FROM hallazgos GROUP BY 1, 2")
def u01_jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Findings written as JSON lines and two of their fields read again."""
    h, at = read(s, d, "hallazgos"), _place(s, "jsonl")
    X.write_jsonl(h, at)
    return X.read_jsonl(s, at, h.schema, ["seccion", "severidad"]).groupBy("seccion", "severidad").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, formato, pregunta FROM preguntas")
def u02_strict_jsonl(s: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines and read strictly."""
    q, at = read(s, d, "preguntas").select("id", "formato", "pregunta"), _place(s, "estricto")
    X.write_jsonl(q, at)
    return X.read_strict_jsonl(s, at, q.schema)


@query("SELECT n_nationkey::VARCHAR AS clave, n_name AS nombre, NULL::VARCHAR AS region FROM nation UNION ALL SELECT r_regionkey::VARCHAR, NULL, r_name FROM region")
def u03_csv_union(s: SparkSession, d: str) -> DataFrame:
    """Two tables written as one CSV with the union of their columns, and read again."""
    from pyspark.sql.types import StringType, StructField, StructType

    at = _place(s, "csv")
    X.write_csv([read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("clave"), F.col("n_name").alias("nombre")), read(s, d, "region").select(F.col("r_regionkey").cast("string").alias("clave"), F.col("r_name").alias("region"))], at)
    return X.read_csv(s, at, StructType([StructField(c, StringType()) for c in ("clave", "nombre", "region")]))


@query("SELECT tipo, count(*) AS n, coalesce(sum(entero), 0)::BIGINT AS enteros FROM (SELECT CASE WHEN v IS NULL OR v = '' THEN 'nulo' WHEN v IN ('True', 'False') THEN 'logico' WHEN regexp_full_match(v, '-?\\d+') THEN 'entero' WHEN regexp_full_match(v, '-?\\d+\\.\\d+') THEN 'decimal' ELSE 'texto' END AS tipo, try_cast(CASE WHEN regexp_full_match(v, '-?\\d+') THEN v END AS BIGINT) AS entero FROM (SELECT articulo AS v FROM chunks UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'True' ELSE 'False' END FROM chunks)) GROUP BY 1")
def u04_restored_types(s: SparkSession, d: str) -> DataFrame:
    """Kinds of CSV cells: article labels and truth values."""
    c = read(s, d, "chunks")
    v = c.select(F.col("articulo").alias("v")).unionAll(c.select(F.when(F.col("id") % 2 == 0, "True").otherwise("False")))
    return v.select(X.restored(F.col("v")).alias("r")).groupBy("r.tipo").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("r.entero"), F.lit(0)).alias("enteros"))


@query("SELECT n_nationkey::VARCHAR AS doc_id, n_name AS texto FROM nation")
def u05_texts_by_id(s: SparkSession, d: str) -> DataFrame:
    """Text files made from the nations, read by id against their hashes."""
    n, at = read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("texto")), _place(s, "textos")
    n.select("texto", "doc_id").write.partitionBy("doc_id").text(at)
    files = X.listing(s, at).where("archivo LIKE '%.txt'").select("archivo", F.regexp_extract("archivo", r"doc_id=([^/]+)/", 1).alias("doc_id"))
    return X.texts_by_id(s, at, files.join(n.select("doc_id", F.sha2(F.concat("texto", F.lit("\n")), 256).alias("sha256")), "doc_id")).select("doc_id", F.rtrim("texto", F.lit("\n")).alias("texto"))


@query("SELECT n_nationkey::VARCHAR AS doc_id, n_nationkey % 5 <> 0 AS existe, n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 AS tamano_ok, n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AS huella_ok FROM nation")
def u06_file_integrity(s: SparkSession, d: str) -> DataFrame:
    """Files against what is expected of them: some missing, some of another size or hash."""
    n, at = read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("texto")), _place(s, "archivos")
    n.where("doc_id % 5 <> 0").select("texto", "doc_id").write.partitionBy("doc_id").text(at)
    there = X.listing(s, at).where("archivo LIKE '%.txt'").select("archivo", F.regexp_extract("archivo", r"doc_id=([^/]+)/", 1).alias("doc_id"))
    expected = n.join(there, "doc_id", "left").select("doc_id", F.coalesce("archivo", F.concat(F.lit("no/"), "doc_id")).alias("archivo"), F.when(F.expr("doc_id % 7 = 0"), F.lit("x")).otherwise(F.sha2(F.concat("texto", F.lit("\n")), 256)).alias("sha256"), F.when(F.expr("doc_id % 3 = 0"), F.lit(-1)).otherwise(F.octet_length("texto") + 1).alias("bytes"))
    got = X.verified_files(s, at, expected.select("archivo", "sha256", "bytes"))
    return expected.select("doc_id", "archivo").join(got, "archivo").select("doc_id", "existe", "tamano_ok", "huella_ok")


@query("SELECT n_nationkey::VARCHAR AS doc_id FROM nation WHERE n_nationkey % 4 = 0")
def u07_untracked_files(s: SparkSession, d: str) -> DataFrame:
    """Files that no row refers to; equal names in other folders are other files."""
    n, at = read(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("texto")), _place(s, "sueltos")
    n.select("texto", "doc_id").write.partitionBy("doc_id").text(at)
    there = X.listing(s, at).where("archivo LIKE '%.txt'").withColumn("doc_id", F.regexp_extract("archivo", r"doc_id=([^/]+)/", 1))
    return X.untracked_files(s, at, there.where("doc_id % 4 <> 0").select("archivo")).where("archivo LIKE '%.txt'").select(F.regexp_extract("archivo", r"doc_id=([^/]+)/", 1).alias("doc_id"))


@query("SELECT id, doc_id, orden FROM (SELECT c.id, c.doc_id, row_number() OVER (ORDER BY q.id DESC) AS orden FROM preguntas q JOIN chunks c ON c.id = q.id)")
def u08_ordered_lookup(s: SparkSession, d: str) -> DataFrame:
    """Chunks by a list of ids, in the order of the list."""
    from pyspark.sql import Window

    ids = read(s, d, "preguntas").select(F.col("id").cast("bigint").alias("id"))
    got = X.ordered_lookup(read(s, d, "chunks").select("id", "doc_id"), "id", ids, "id")
    return got.select("id", "doc_id", F.row_number().over(Window.orderBy(F.desc("id"))).cast("bigint").alias("orden"))


@query("SELECT id FROM chunks WHERE id > 100 ORDER BY id LIMIT 50")
def u09_keyset_page(s: SparkSession, d: str) -> DataFrame:
    """The fifty chunks after a key."""
    return X.page_after(read(s, d, "chunks").select("id"), "id", 100, 50)


@query("SELECT count(DISTINCT doc_id || chr(9) || f.sha256) AS archivos, true AS igual, true AS cambia FROM (SELECT doc_id, unnest(archivos_raw) AS f FROM manifiesto)")
def u10_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The snapshot of the manifest's files: equal when taken again in another order, another when a hash changes."""
    f = read(s, d, "manifiesto").select("doc_id", F.explode("archivos_raw").alias("f")).select("doc_id", F.col("f.sha256").alias("h")).distinct()
    first = X.snapshot_id(f, "doc_id", "h")
    again = X.unchanged(first, X.snapshot_id(f.orderBy(F.desc("h")), "doc_id", "h"))
    other = X.unchanged(first, X.snapshot_id(f.withColumn("h", F.concat("h", F.lit("0"))), "doc_id", "h"))
    return first.select(F.col("archivos")).crossJoin(again.select("igual")).crossJoin(other.select((~F.col("igual")).alias("cambia")))


@query("SELECT doc_id, CASE WHEN cambio = 'aplicado' THEN length(text) ELSE n_chars END AS n_chars, cambio FROM (SELECT *, CASE WHEN doc_id % 3 > 0 OR text IS NULL THEN NULL WHEN n_chars IS NOT DISTINCT FROM length(text) THEN 'ya_aplicado' WHEN doc_id % 5 = 0 AND n_chars IS DISTINCT FROM -1 THEN 'valor_distinto' WHEN doc_id % 2 = 0 AND NOT contains(text, 'zzz') THEN 'sin_prueba' ELSE 'aplicado' END AS cambio FROM documents)")
def q70_verified_patch(s: SparkSession, d: str) -> DataFrame:
    """Lengths corrected by patches that name the old value and a proof in the text."""
    t = read(s, d, "documents").select("doc_id", "text", "n_chars")
    p = t.where("doc_id % 3 = 0 AND text IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("n_chars")).alias("esperado"), F.length("text").cast("bigint").alias("nuevo"), F.when(F.col("doc_id") % 2 == 0, "zzz").otherwise(F.left("text", F.lit(20))).alias("prueba"))
    return X.patched(t, "doc_id", "n_chars", "text", p).select("doc_id", "n_chars", "cambio")


@query("SELECT count(*) AS filas, count(DISTINCT vec_id) AS claves FROM embeddings WHERE embedding IS NOT NULL")
def u11_index_round_trip(s: SparkSession, d: str) -> DataFrame:
    """A vector index written by cell and read again with its checks."""
    v, at = read(s, d, "embeddings").select("vec_id", "embedding"), _place(s, "indice")
    index = S.with_cells(v, "vec_id", "embedding", S.fit_cells(v, "vec_id", "embedding", 8))
    X.write_index(index, at, "celda")
    first = v.where("embedding IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return X.read_index(s, at, first.n, first.d or 0, "embedding").agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("vec_id").alias("claves"))
