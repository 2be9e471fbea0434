"""Queries of readers, assembly, answers and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import documents as D
from ..sources.tables import read
from ..streaming import incremental as I
from ..sources.shared import shared_folder
from ..operators import probes as P
from .q_text import _BM25, _DENSE_DOCS, _PARENTS, _parents
from .registry import registry

QUERIES, SQL, query = registry()


@query("SELECT n_nationkey, '| clave | nombre |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) || 'Región ' || n_regionkey AS texto FROM nation")
def q43_html_flatten(s: SparkSession, d: str) -> DataFrame:
    """Pages made from the nations: a navigation bar, a table, a paragraph, a footer."""
    page = F.concat(F.lit("<html><nav>Inicio</nav><table><tr><th>clave</th><th>nombre</th></tr>"), F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), F.col("n_name"), F.lit("</td></tr></table><p>Regi&oacute;n "), F.col("n_regionkey").cast("string"), F.lit("</p><footer>pie</footer></html>"))
    return D.converted(read(s, d, "nation").select("n_nationkey", page.alias("html")), "n_nationkey", "html", "html").select("n_nationkey", "texto")


@query("WITH t AS (SELECT doc_id, string_split(array_to_string(list_transform(range(0, greatest(1, ceil(length(text) / 40.0)::BIGINT)), lambda k: substring(text, 40 * k + 1, 40)), chr(12)), chr(12)) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, i::INT AS pagina, coalesce(list_sum(list_transform(p[1 : i - 1], lambda x: length(x) + 1)), 0)::INT AS inicio FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM t)")
def q83_paged_text_all(s: SparkSession, d: str) -> DataFrame:
    """Every text to its end with a form feed after each forty characters; form feeds that the text holds end pages too."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 40)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", 40 * i + 1, F.lit(40)))
    own = F.length("text") - F.length(F.translate("text", "\f", ""))
    rows = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat_ws("\f", cut).alias("t"), (n + own).alias("esperadas"))
    return D.pages(rows, "doc_id", F.col("t"), "esperadas").select("doc_id", "pagina", "inicio")


@query("WITH o AS (SELECT norma_id, doc_id, length(text) AS n FROM documents WHERE norma_id IS NOT NULL AND text IS NOT NULL) SELECT norma_id, doc_id, inicio, inicio + n AS fin FROM (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY norma_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS inicio FROM o)")
def q84_document_assembly(s: SparkSession, d: str) -> DataFrame:
    """Where each text stands in its norm's whole text, parts being set off by a blank line."""
    return D.placed(read(s, d, "documents").where("norma_id IS NOT NULL AND text IS NOT NULL"), "norma_id", "doc_id", "text").select("norma_id", "doc_id", "inicio", "fin")


@query("SELECT norma_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS texto FROM documents WHERE norma_id <> 'decreto_4999_2015' AND text IS NOT NULL GROUP BY 1 HAVING sum(length(text) + 2) <= 20000")
def q84_assembled_texts(s: SparkSession, d: str) -> DataFrame:
    """The whole texts of norms that stay within 20,000 characters; longer ones are left as placed parts."""
    return D.assembled(read(s, d, "documents").where("norma_id <> 'decreto_4999_2015' AND text IS NOT NULL"), "norma_id", "doc_id", "text", 20000)


@query(_BM25 + _DENSE_DOCS + _PARENTS + ", z AS (SELECT q, rango AS orden, doc_id AS id, norma_id FROM pr WHERE rango <= 10), u AS (SELECT norma_id, sum(length(text) + 2) - 2 AS n FROM documents WHERE norma_id IS NOT NULL AND text IS NOT NULL GROUP BY 1) SELECT q::INT AS q, orden, id, CASE WHEN u.n <= 2400 THEN u.n ELSE length(d.text) END::BIGINT AS largo FROM z JOIN documents d ON d.doc_id = z.id LEFT JOIN u ON u.norma_id = z.norma_id")
def q53_passage_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Ten passages for each question, one a norm: the norm's whole text if it is short, else the text that hit."""
    docs = read(s, d, "documents").where("norma_id IS NOT NULL")
    windows = docs.select(F.col("doc_id").alias("id"), F.col("norma_id").alias("unidad"), F.col("text").alias("texto"))
    units = D.assembled(docs.where("text IS NOT NULL"), "norma_id", "doc_id", "text", 2400).select(F.col("norma_id").alias("unidad"), "texto")
    got = A.window_passages(_parents(s, d, 10).select("q", F.col("doc_id").alias("id"), "rango"), windows, units)
    return got.select("q", F.col("orden").cast("bigint").alias("orden"), "id", F.length("texto").cast("bigint").alias("largo"))


@query("WITH i AS (SELECT id, pregunta AS t FROM preguntas UNION SELECT id, respuesta_esperada FROM clave_oro), w AS (SELECT doc_id, regexp_extract_all(lower(replace(text, 'İ', 'I')), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT id, regexp_extract_all(lower(replace(t, 'İ', 'I')), '[\\p{L}\\p{N}_]+') AS w FROM i WHERE t IS NOT NULL), a AS (SELECT DISTINCT id, array_to_string(w[i : i + 23], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 22))) AS i FROM q)), b AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 23], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 22))) AS i FROM w)) SELECT DISTINCT doc_id, id FROM a JOIN b USING (g)")
def q55_leakage_shingles(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold 24 consecutive words of a question or an expected answer: hashes held against in place, hits compared."""
    items = read(s, d, "preguntas").select("id", F.col("pregunta").alias("t")).union(read(s, d, "clave_oro").select("id", "respuesta_esperada"))
    return P.leaks(read(s, d, "documents"), "doc_id", "text", items, "id", "t").select("doc_id", "id")


@query("WITH s AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'open_ended' ELSE formato END AS formato, CASE WHEN id % 3 = 0 THEN 'Z' ELSE 'A' END AS respuesta, id % 5 <> 0 AS con FROM preguntas WHERE id % 11 <> 0 UNION ALL SELECT id, formato, 'A', true FROM preguntas WHERE id % 50 = 0 AND id % 11 <> 0 UNION ALL SELECT 100000, 'semi_open', 'x', true), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM s), j AS (SELECT n.*, q.id AS qid, q.formato AS qf FROM n FULL JOIN preguntas q ON n.id = q.id) SELECT DISTINCT coalesce(id, qid) AS id, unnest(list_filter([CASE WHEN id IS NOT NULL AND qid IS NULL THEN 'desconocido' END, CASE WHEN id IS NULL THEN 'faltante' END, CASE WHEN n > 1 THEN 'repetido' END, CASE WHEN id IS NOT NULL AND qid IS NOT NULL AND formato IS DISTINCT FROM qf THEN 'formato' END, CASE WHEN id IS NOT NULL AND NOT con THEN 'sin_pasajes' END, CASE WHEN formato = 'multiple_choice' AND respuesta NOT IN ('A', 'B', 'C', 'D') THEN 'respuesta' END], lambda x: x IS NOT NULL)) AS problema FROM j")
def q85_submission_problems(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "preguntas")
    passages = lambda c: F.when(c, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")).alias("pasajes")
    base = q.where("id % 11 <> 0").select("id", F.when(F.col("id") % 7 == 0, "open_ended").otherwise(F.col("formato")).alias("formato"), F.when(F.col("id") % 3 == 0, "Z").otherwise("A").alias("respuesta"), passages(F.col("id") % 5 != 0))
    again = q.where("id % 50 = 0 AND id % 11 <> 0").select("id", "formato", F.lit("A").alias("respuesta"), passages(F.lit(True)))
    other = s.range(1).select(F.lit(100000).alias("id"), F.lit("semi_open").alias("formato"), F.lit("x").alias("respuesta"), passages(F.lit(True)))
    return A.problems(base.unionByName(again).unionByName(other), q.select("id", "formato"))


@query("SELECT event_id, props AS json, left(props, length(props) // 2) AS inicio FROM events WHERE props IS NOT NULL AND json_valid(props) AND starts_with(props, '{')")
def q86_json_repair(s: SparkSession, d: str) -> DataFrame:
    """Properties that lack their last bracket, closed again to what they were; those cut in half parse."""
    e = read(s, d, "events").where("props IS NOT NULL AND startswith(props, '{')").where(F.try_parse_json("props").isNotNull())
    whole = A.repaired_json(e.select("event_id", F.expr("left(props, length(props) - 1)").alias("p")), "event_id", "p")
    half = A.repaired_json(e.select("event_id", F.expr("left(props, cast(floor(length(props) / 2) as int))").alias("p")), "event_id", "p").where(F.try_parse_json("json").isNotNull())
    return whole.join(half.select("event_id"), "event_id", "left_semi").join(e.select("event_id", F.expr("left(props, cast(floor(length(props) / 2) as int))").alias("inicio")), "event_id")


@query("SELECT CAST(to_timestamp(floor(epoch(ts) / 600) * 600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS desde, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q87_event_windows(s: SparkSession, d: str) -> DataFrame:
    return I.windowed(read(s, d, "events")).select("desde", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS desde, count(*) AS n FROM y GROUP BY user_id, k")
def q88_sessions(s: SparkSession, d: str) -> DataFrame:
    return I.sessions(read(s, d, "events"))


@query("SELECT doc_id, count(*) AS veces, string_agg(DISTINCT tema, '|' ORDER BY tema) AS temas FROM (SELECT doc_id, unnest(temas) AS tema FROM manifiesto) GROUP BY 1")
def q89_merged_themes(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "manifiesto").select("doc_id", F.explode("temas").alias("tema"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("veces"), F.array_join(F.array_sort(F.collect_set("tema")), "|").alias("temas"))


@query("WITH a AS (SELECT DISTINCT tipo, anio FROM manifiesto WHERE anio IS NOT NULL), r AS (SELECT tipo, min(anio) AS lo, max(anio) AS hi FROM a GROUP BY 1) SELECT r.tipo, y AS falta FROM r, range(1900, 2100) g(y) WHERE y BETWEEN lo AND hi AND NOT EXISTS (SELECT 1 FROM a WHERE a.tipo = r.tipo AND a.anio = y)")
def q90_expected_range(s: SparkSession, d: str) -> DataFrame:
    a = read(s, d, "manifiesto").where("anio IS NOT NULL").select("tipo", "anio").distinct()
    every = a.groupBy("tipo").agg(F.min("anio").alias("lo"), F.max("anio").alias("hi")).select("tipo", F.explode(F.sequence("lo", "hi")).alias("anio"))
    return every.join(a, ["tipo", "anio"], "left_anti").select("tipo", F.col("anio").cast("bigint").alias("falta"))


@query("SELECT h.doc_id, count(*) AS hallazgos, bool_or(severidad = 'CRITICO') AS critico, any_value(m.fuentes) AS fuentes FROM hallazgos h JOIN (SELECT doc_id, count(DISTINCT fuente) AS fuentes FROM manifiesto GROUP BY 1) m USING (doc_id) GROUP BY 1")
def q91_findings_by_document(s: SparkSession, d: str) -> DataFrame:
    m = read(s, d, "manifiesto").groupBy("doc_id").agg(F.count_distinct("fuente").alias("fuentes"))
    h = read(s, d, "hallazgos").where("doc_id <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hallazgos"), F.bool_or(F.col("severidad") == "CRITICO").alias("critico"))
    return h.join(m, "doc_id").select("doc_id", "hallazgos", "critico", "fuentes")


@query("SELECT area, count(*) AS items, count(*) FILTER (EXISTS (SELECT 1 FROM documents t WHERE t.area = k.area)) AS cubiertos FROM clave_oro k WHERE area IS NOT NULL GROUP BY 1")
def q92_weighted_coverage(s: SparkSession, d: str) -> DataFrame:
    there = read(s, d, "documents").select("area").where("area IS NOT NULL").distinct().withColumn("c", F.lit(1))
    return read(s, d, "clave_oro").where("area IS NOT NULL").join(there, "area", "left").groupBy("area").agg(F.count(F.lit(1)).alias("items"), F.count("c").alias("cubiertos"))


@query("SELECT seccion, count(*) AS n FROM hallazgos WHERE doc_id <> '' GROUP BY 1")
def q93_incremental_ingest(s: SparkSession, d: str) -> DataFrame:
    """New files only: the documents are ingested twice through a stream; the second call finds nothing new."""
    import uuid

    base = f"{shared_folder(s)}/ingesta-{uuid.uuid4().hex}"
    source = read(s, d, "hallazgos")
    source.write.parquet(f"{base}/entrada")
    for _ in range(2):
        I.ingest_new(s, f"{base}/entrada", source.schema, f"{base}/salida", f"{base}/estado", lambda x: x.where("doc_id <> ''"))
    return s.read.parquet(f"{base}/salida").groupBy("seccion").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN id % 8 = 0 THEN 'json_invalido' WHEN id % 9 = 0 THEN 'modelo_se_abstiene' WHEN id % 5 = 0 THEN 'sin_respaldo' END AS motivo FROM clave_oro")
def q94_abstention_reasons(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return read(s, d, "clave_oro").select("id", A.abstention(i % 8 != 0, i % 9 == 0, F.when(i % 5 == 0, 1).otherwise(0)).alias("motivo"))


