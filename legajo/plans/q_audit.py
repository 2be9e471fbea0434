"""Queries of audit families, censuses and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import citations as C
from ..operators import probes as P
from ..sources.tables import read
from .q_citations import _REFS, _references
from .registry import registry

QUERIES, SQL, query = registry()

_M = "(SELECT * FROM manifiesto QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fecha_descarga DESC, ingresado_en DESC, url, titulo, md5(archivos_raw::VARCHAR)) = 1)"
_GARBLED = T.GARBLED


def _manifest(s: SparkSession, d: str) -> DataFrame:
    """One row per document: its latest download."""
    m = read(s, d, "manifiesto")
    return m.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in m.columns if c != "doc_id"]), F.struct("fecha_descarga", "ingresado_en")).alias("x")).select("doc_id", "x.*")


_HOSTS = ("turmequi0.example", "quantor1.example", "falconete2.example")
_HOST = "regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://([^/?#]+)', 1)"


@query(
    "WITH m AS (SELECT DISTINCT doc_id, titulo, fuente, url, fecha_consulta, areas, list_sort(list_transform(coalesce(archivos_raw, []), lambda a: a.url_final)) AS finales FROM manifiesto) "
    "SELECT 'A' AS seccion, 'CRITICO' AS severidad, doc_id, 'campos_obligatorios_manifiesto' AS comprobacion, 'faltan: ' || array_to_string(f, ', ') AS detalle FROM (SELECT DISTINCT *, list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL OR {'len(areas) = 0' if c == 'areas' else c + chr(32) + '= ' + chr(39) * 2} THEN '{c}' END" for c in A.REQUIRED) + "], lambda x: x IS NOT NULL) AS f FROM (SELECT DISTINCT " + ", ".join(A.REQUIRED) + " FROM m)) WHERE len(f) > 0 "
    f"UNION ALL SELECT 'A', 'ALTO', doc_id, 'fuente_no_oficial', min(u) FROM (SELECT doc_id, unnest(list_append(finales, url)) AS u FROM m) WHERE u <> '' AND NOT ({' OR '.join(f'ends_with({_HOST}, {h!r})' for h in _HOSTS)}) GROUP BY doc_id "
    "UNION ALL SELECT DISTINCT 'A', 'AVISO', doc_id, 'ley_aprobatoria_de_tratado', titulo FROM m WHERE regexp_matches(titulo, '(?i)\\bpor\\s+medio\\s+de\\s+la\\s+cual\\s+se\\s+aprueba|\\baprueba\\s+(?:el|la|los|las)\\s+[\"“]?(?:convenio|convenci[oó]n|tratado|acuerdo|protocolo|enmienda|estatuto)')"
)
def q112_compliance_findings(s: SparkSession, d: str) -> DataFrame:
    """Family A: compliance of the manifest's rows, repeated ones once."""
    m = read(s, d, "manifiesto")
    required = m.select(*A.REQUIRED, "archivos_raw").distinct()
    rows = A.compliance(required, _HOSTS)
    return rows.distinct()


@query(
    r"""WITH i AS (SELECT id, 'pregunta' AS campo, pregunta AS t FROM preguntas UNION ALL SELECT id, 'respuesta_esperada', respuesta_esperada FROM clave_oro UNION ALL SELECT id, 'opciones', array_to_string(map_values(opciones), ' ') FROM preguntas),
q AS (SELECT id, campo, regexp_extract_all(lower(replace(t, 'İ', 'I')), '[\p{L}\p{N}_]+') AS w FROM i WHERE t IS NOT NULL), a AS (SELECT DISTINCT id, campo, array_to_string(w[k + 1 : k + 24], ' ') AS g FROM (SELECT id, campo, w, unnest(range(0, greatest(0, len(w) - 23), 12)) AS k FROM q)),
b AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 23], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 22))) AS k FROM (SELECT doc_id, regexp_extract_all(lower(replace(text, 'İ', 'I')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL))),
l AS (SELECT DISTINCT doc_id, id AS item, campo FROM a JOIN b USING (g)), f AS (SELECT doc_id, min({'campo': campo, 'item': item}) AS x FROM l GROUP BY 1), o AS (SELECT DISTINCT doc_id FROM documents WHERE tipo IN ('ley', 'decreto'))
SELECT 'A' AS seccion, CASE WHEN x.campo = 'pregunta' OR o.doc_id IS NULL THEN 'CRITICO' ELSE 'AVISO' END AS severidad, f.doc_id::VARCHAR AS doc_id, CASE WHEN x.campo = 'pregunta' OR o.doc_id IS NULL THEN 'fuga_evaluacion' ELSE 'respuesta_cita_fuente_oficial' END AS comprobacion, 'ítem ' || x.item || ' ' || x.campo AS detalle FROM f LEFT JOIN o USING (doc_id)"""
)
def q113_leakage_findings(s: SparkSession, d: str) -> DataFrame:
    """Family A: documents that hold 24 words of an item, at every twelfth word of its question, answer and options."""
    docs = read(s, d, "documents")
    q, k = read(s, d, "preguntas"), read(s, d, "clave_oro")
    items = q.select("id", F.lit("pregunta").alias("campo"), F.col("pregunta").alias("t")).unionByName(k.select("id", F.lit("respuesta_esperada").alias("campo"), F.col("respuesta_esperada").alias("t"))).unionByName(q.select("id", F.lit("opciones").alias("campo"), F.array_join(F.map_values("opciones"), " ").alias("t")))
    leaks = P.leaks(docs, "doc_id", "text", items, "id", "t", 24, 12, ("campo",)).withColumnRenamed("id", "item")
    return A.leakage(leaks, docs.where("tipo IN ('ley', 'decreto')").select("doc_id"))


_INV = "(SELECT DISTINCT norma_id AS doc_id FROM documents WHERE norma_id IS NOT NULL UNION SELECT 'ley_1_1900')"
_ONE = "(SELECT DISTINCT doc_id, archivos_raw FROM manifiesto)"


@query(
    f"""WITH inv AS {_INV}, man AS {_ONE}, h AS (SELECT DISTINCT array_to_string(list_transform(archivos_raw, lambda a: a.sha256), '') AS g, doc_id FROM man), k AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g'), '^co_', '') AS g, doc_id FROM man)
SELECT 'B' AS seccion, 'CRITICO' AS severidad, doc_id, 'sin_descargar' AS comprobacion, '' AS detalle FROM inv WHERE doc_id NOT IN (SELECT doc_id FROM man)
UNION ALL SELECT DISTINCT 'B', 'AVISO', doc_id, 'fuera_del_inventario', '' FROM man WHERE doc_id NOT IN (SELECT doc_id FROM inv)
UNION ALL SELECT 'B', 'ALTO', min(doc_id), 'duplicado_por_contenido', (count(*) - 1)::VARCHAR FROM h WHERE g <> '' GROUP BY g HAVING count(*) > 1
UNION ALL SELECT 'B', 'ALTO', min(doc_id), 'duplicado_por_identidad', (count(*) - 1)::VARCHAR FROM k GROUP BY g HAVING count(*) > 1"""
)
def q114_integrity_findings(s: SparkSession, d: str) -> DataFrame:
    """Family B: the manifest against an inventory made of the norms that texts belong to, and one that is missing."""
    inventory = read(s, d, "documents").where("norma_id IS NOT NULL").select(F.col("norma_id").alias("doc_id")).union(s.range(1).select(F.lit("ley_1_1900")))
    manifest = read(s, d, "manifiesto").select("doc_id", "archivos_raw").distinct()
    return A.integrity(inventory, manifest, s.createDataFrame([], "doc_id string"))


_TEXTS = "SELECT doc_id::VARCHAR AS doc_id, tipo, text AS texto FROM documents WHERE text IS NOT NULL"


@query(
    rf"""WITH t AS ({_TEXTS}), m AS (SELECT doc_id, tipo, length(texto) AS n, regexp_matches(substring(texto, floor(length(texto) * 0.8)::BIGINT + 1), '{A.CLOSING}') OR regexp_matches(texto, '{A.DECIDES}') AS cierra, list_distinct(list_filter(list_transform(regexp_extract_all(texto, '(?im)^[ \t]*art[íi]culo[ \t]+(\d+)', 1), lambda x: try_cast(x AS BIGINT)), lambda x: x < 5000)) AS a FROM t),
r AS (SELECT *, len(a) AS articulos, coalesce(list_max(a), 0) AS maximo, coalesce(list_max(a), 0) - len(list_filter(a, lambda x: x >= 1)) AS huecos FROM m)
SELECT 'C' AS seccion, 'AVISO' AS severidad, doc_id, 'sentencia_sin_parte_resolutiva' AS comprobacion, '' AS detalle FROM r WHERE tipo IN ('sentencia', 'auto') AND NOT cierra
UNION ALL SELECT 'C', 'ALTO', doc_id, 'sentencia_corta', n::VARCHAR FROM r WHERE tipo IN ('sentencia', 'auto') AND n < 8000
UNION ALL SELECT 'C', 'ALTO', doc_id, 'norma_sin_articulos', '' FROM r WHERE tipo IN ('ley', 'decreto', 'acto_legislativo', 'constitucion', 'decision') AND articulos = 0
UNION ALL SELECT 'C', 'AVISO', doc_id, 'huecos_en_numeracion', huecos::VARCHAR FROM r WHERE tipo IN ('ley', 'decreto', 'acto_legislativo', 'constitucion', 'decision') AND articulos > 10 AND huecos / greatest(maximo, 1) > 0.10"""
)
def q115_completeness_findings(s: SparkSession, d: str) -> DataFrame:
    """Family C over the documents."""
    return A.completeness(read(s, d, "documents").select("doc_id", "tipo", F.col("text").alias("texto")))


_WORDS = ", ".join(f"'{w}'" for w in A.FUNCTION_WORDS)


@query(
    rf"""WITH t AS ({_TEXTS}), m AS (SELECT doc_id, length(texto) AS n, len(regexp_extract_all(texto, '{_GARBLED}')) AS malas, length(regexp_replace(texto, '^\s+|\s+$', '', 'g')) AS lleno, len(regexp_extract_all(texto, '{A.FOOTER}')) AS pies, regexp_extract_all(lower(replace(texto, 'İ', 'I')), '[\p{{L}}\p{{N}}_]+') AS w, length(regexp_replace(texto, '[^\p{{Cyrillic}}\p{{Greek}}\p{{Han}}]', '', 'g')) AS o FROM t)
SELECT 'D' AS seccion, 'ALTO' AS severidad, doc_id, 'texto_con_mojibake' AS comprobacion, malas::VARCHAR AS detalle FROM m WHERE malas > 20 OR malas > 1e-4 * n
UNION ALL SELECT 'D', 'ALTO', doc_id, 'texto_ilegible_requiere_ocr', '' FROM m WHERE NOT (n >= 500 AND o <= 0.01 * n AND len(list_filter(w, lambda x: x IN ({_WORDS}))) >= 0.25 * len(w))
UNION ALL SELECT 'D', 'ALTO', doc_id, 'texto_muy_corto', n::VARCHAR FROM m WHERE lleno < 1500
UNION ALL SELECT 'D', 'AVISO', doc_id, 'pie_editorial_en_original', pies::VARCHAR FROM m WHERE pies > 1"""
)
def q116_quality_findings(s: SparkSession, d: str) -> DataFrame:
    """Family D over the documents."""
    return A.quality(read(s, d, "documents").select("doc_id", F.col("text").alias("texto")))


@query(
    _REFS + """, g AS (SELECT clave, count(DISTINCT doc_id) AS documentos FROM r GROUP BY 1), p AS (SELECT DISTINCT regexp_replace(doc_id, '^co_', '') AS clave FROM manifiesto), tg AS (SELECT DISTINCT norma_id AS clave, count(*) OVER (PARTITION BY norma_id) AS items FROM documents WHERE norma_id IS NOT NULL UNION ALL SELECT 'ley_2_1900', 2 UNION ALL SELECT 'ley_3_1900', 1)
SELECT 'E' AS seccion, CASE WHEN items > 1 THEN 'ALTO' ELSE 'AVISO' END AS severidad, clave AS doc_id, 'seed_target_ausente' AS comprobacion, items::VARCHAR AS detalle FROM tg WHERE clave NOT IN (SELECT clave FROM p) UNION ALL SELECT 'E', 'AVISO', clave, 'citada_por_el_corpus_y_ausente', documentos::VARCHAR FROM g WHERE documentos >= 2 AND clave NOT IN (SELECT clave FROM p)"""
)
def q117_coverage_findings(s: SparkSession, d: str) -> DataFrame:
    """Family E: targets made of the norms that texts belong to and two that are missing, and references of two documents or more."""
    targets = read(s, d, "documents").where("norma_id IS NOT NULL").groupBy(F.col("norma_id").alias("clave")).agg(F.count(F.lit(1)).alias("items")).unionByName(s.createDataFrame([("ley_2_1900", 2), ("ley_3_1900", 1)], "clave string, items bigint"))
    return A.coverage(targets, read(s, d, "manifiesto"), C.graph(_references(s, d), "doc_id", "clave"), 2)


@query(
    """WITH c AS (SELECT regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g') AS doc_id, CASE WHEN count(texto) = 0 THEN 'error' ELSE 'extraido' END AS estado, bool_and(coalesce(avisos, '[]') NOT LIKE '%fuente_secundaria%') AS apta FROM chunks GROUP BY 1)
SELECT 'F' AS seccion, 'CRITICO' AS severidad, doc_id, 'no_llego_al_corpus' AS comprobacion, '' AS detalle FROM (SELECT DISTINCT doc_id FROM manifiesto) WHERE doc_id NOT IN (SELECT doc_id FROM c)
UNION ALL SELECT 'F', 'CRITICO', doc_id, 'error_de_extraccion', '' FROM c WHERE estado = 'error' UNION ALL SELECT 'F', 'ALTO', doc_id, 'excluido_de_busqueda', '' FROM c WHERE NOT apta
UNION ALL SELECT 'F', 'CRITICO', '', 'comprobacion_ingesta_fallida', comprobacion FROM (SELECT DISTINCT comprobacion FROM hallazgos WHERE seccion = 'F' AND severidad = 'CRITICO')"""
)
def q118_ingestion_findings(s: SparkSession, d: str) -> DataFrame:
    """Family F: the manifest against the documents that have chunks; checks are those with a critical finding."""
    c = read(s, d, "chunks").groupBy(T.settle_id(F.col("doc_id")).alias("doc_id")).agg(F.when(F.count("texto") == 0, "error").otherwise("extraido").alias("estado"), F.bool_and(~F.coalesce("avisos", F.lit("[]")).contains("fuente_secundaria")).alias("apta"))
    checks = read(s, d, "hallazgos").where("seccion = 'F' AND severidad = 'CRITICO'").select("comprobacion").distinct().withColumn("resultado", F.lit("fallo"))
    return A.ingestion(read(s, d, "manifiesto"), c, checks)


@query(_REFS + ", g AS (SELECT clave, count(DISTINCT doc_id) AS documentos FROM r GROUP BY 1), p AS (SELECT DISTINCT regexp_replace(doc_id, '^co_', '') AS clave FROM manifiesto) SELECT 'G' AS seccion, 'CRITICO' AS severidad, clave AS doc_id, 'grafo_abierto' AS comprobacion, documentos::VARCHAR AS detalle FROM g WHERE documentos >= CASE WHEN starts_with(clave, 'sentencia') THEN 3 ELSE 2 END AND clave NOT IN (SELECT clave FROM p) AND NOT clave LIKE '%_2001' UNION ALL SELECT 'G', 'ALTO', clave, 'exclusion_sin_evidencia', '' FROM g WHERE clave LIKE '%_2001' AND clave LIKE 'ley%'")
def q119_graph_findings(s: SparkSession, d: str) -> DataFrame:
    """Family G: open references, exclusions being those of one year, the laws among them without evidence."""
    g = C.graph(_references(s, d), "doc_id", "clave")
    out = g.where("clave LIKE '%\\_2001'").select("clave", F.lit("cita_errada").alias("motivo"), F.when(~F.col("clave").startswith("ley"), "texto").alias("evidencia"))
    return A.graph_closed(g, read(s, d, "manifiesto"), out, 2, 3)


@query("SELECT severidad, seccion, comprobacion, doc_id, row_number() OVER (ORDER BY CASE severidad WHEN 'CRITICO' THEN 1 WHEN 'ALTO' THEN 2 WHEN 'AVISO' THEN 3 ELSE 99 END, seccion, comprobacion, doc_id) AS puesto FROM (SELECT DISTINCT severidad, seccion, comprobacion, doc_id FROM hallazgos WHERE doc_id <> '') ORDER BY puesto LIMIT 50")
def q120_findings_sort(s: SparkSession, d: str) -> DataFrame:
    """The fifty first findings of the report."""
    from pyspark.sql import Window

    top = A.sorted_findings(read(s, d, "hallazgos").where("doc_id <> ''").select("severidad", "seccion", "comprobacion", "doc_id").distinct()).limit(50)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, A.SEVERITIES)), F.col("severidad")), F.lit(99))
    return top.withColumn("puesto", F.row_number().over(Window.orderBy(order, "seccion", "comprobacion", "doc_id")).cast("bigint"))


@query("SELECT comprobacion, string_agg(s || '=' || n, ', ' ORDER BY s) AS estados FROM (SELECT comprobacion, coalesce(severidad, '(sin dato)') AS s, count(*) AS n FROM hallazgos GROUP BY 1, 2) GROUP BY 1")
def q121_state_counts(s: SparkSession, d: str) -> DataFrame:
    from ..operators import relational as R

    return R.state_counts(read(s, d, "hallazgos"), "comprobacion", "severidad")


_NOW = "(SELECT DISTINCT doc_id, comprobacion, coalesce(detalle, '') AS detalle FROM hallazgos WHERE seccion IN ('D', 'E', 'F'))"
_OLD = "(SELECT DISTINCT doc_id, comprobacion, detalle FROM hallazgos WHERE seccion IN ('A', 'B', 'C', 'D', 'E'))"
_K = r"regexp_replace(lower(trim(regexp_replace(doc_id, '^co_', ''))), '[\s\-_]+', '_', 'g')"


@query(
    f"""WITH old AS (SELECT *, {_K} AS k FROM {_OLD}), now AS (SELECT *, {_K} AS k FROM {_NOW}), d AS (SELECT k, count(DISTINCT doc_id) AS docs FROM now GROUP BY 1), e AS (SELECT k, comprobacion, count(*) AS n, min(detalle) AS lo, max(detalle) AS hi FROM now GROUP BY 1, 2)
SELECT doc_id, old.comprobacion, old.detalle, CASE WHEN old.k = '' THEN 'sin_documento' WHEN docs IS NULL THEN 'documento_retirado' WHEN docs > 1 THEN 'documento_ambiguo' WHEN n IS NULL THEN 'resuelta' WHEN n = 1 AND lo = coalesce(old.detalle, '') THEN 'vigente' WHEN n = 1 THEN 'cambiada' WHEN coalesce(old.detalle, '') BETWEEN lo AND hi THEN 'vigente_varias' ELSE 'cambiada_varias' END AS resultado FROM old LEFT JOIN d USING (k) LEFT JOIN e ON e.k = old.k AND e.comprobacion = old.comprobacion"""
)
def q122_reconciled_alerts(s: SparkSession, d: str) -> DataFrame:
    """Old alerts (sections A to E) against the present ones (D to F)."""
    h = read(s, d, "hallazgos")
    old = h.where("seccion IN ('A', 'B', 'C', 'D', 'E')").select("doc_id", "comprobacion", "detalle").distinct()
    now = h.where("seccion IN ('D', 'E', 'F')").select("doc_id", "comprobacion", F.coalesce("detalle", F.lit("")).alias("detalle")).distinct()
    return A.reconciled(old, now)


@query(
    "SELECT id, motivo, evidencia FROM (SELECT id, CASE " + " ".join(f"WHEN regexp_matches(texto, '{p}') THEN '{n}'" for n, p in A.EXCLUSIONS) + " END AS motivo, CASE " + " ".join(f"WHEN regexp_matches(texto, '{p}') THEN regexp_extract(texto, '(?s){p}.{{0,140}}')" for _, p in A.EXCLUSIONS) + " END AS evidencia FROM chunks) WHERE motivo IS NOT NULL"
)
def q123_exclusion_reasons(s: SparkSession, d: str) -> DataFrame:
    """Texts that give a reason for leaving something out, with the words."""
    return read(s, d, "chunks").select("id", A.excluded_by(F.col("texto")).alias("x")).select("id", "x.*").where("motivo IS NOT NULL")


@query(
    "SELECT id, array_to_string(list_filter([CASE WHEN len(regexp_extract_all(texto, '" + _GARBLED + "')) > 0 THEN 'codificacion_residual_por_revisar' END, CASE WHEN length(regexp_replace(texto, '^\\s+|\\s+$', '', 'g')) < 200 THEN 'texto_corto_por_revisar' END, CASE WHEN id % 7 = 0 THEN 'paginas_sin_texto_suficiente' END, CASE WHEN avisos LIKE '%\"revisar_calidad_OCR\"%' THEN 'revisar_calidad_OCR' END], lambda x: x IS NOT NULL), ',') AS pendientes FROM chunks WHERE texto IS NOT NULL AND NOT regexp_matches(texto, '(?i)esta compilaci[oó]n no incluye el texto|texto de esta norma no se sistematizar[aá]') AND NOT coalesce(avisos, '') LIKE '%paginacion_derivado_no_verificada%' AND NOT coalesce(avisos, '') LIKE '%bytes_no_decodificables%'"
)
def q124_preparation_issues(s: SparkSession, d: str) -> DataFrame:
    """What each prepared chunk must be looked at for."""
    c = read(s, d, "chunks").where(F.col("texto").isNotNull() & ~F.col("texto").rlike(r"(?iu)esta compilaci[oó]n no incluye el texto|texto de esta norma no se sistematizar[aá]") & ~F.coalesce("avisos", F.lit("")).contains("paginacion_derivado_no_verificada") & ~F.coalesce("avisos", F.lit("")).contains("bytes_no_decodificables"))
    issues = A.preparation_issues(F.col("texto"), T.garbled_count(F.col("texto")), F.when(F.col("id") % 7 == 0, 1).otherwise(0), F.coalesce(F.from_json("avisos", "array<string>"), F.array().cast("array<string>")))
    return c.select("id", F.array_join(issues, ",").alias("pendientes"))


_L = "list_filter(string_split(texto, chr(10)), lambda x: regexp_replace(x, '[\\s\\p{Z}]+', '', 'g') <> '')"
_few = lambda p, n: f"len(list_filter(l, lambda x: length(x) <= {n} AND regexp_matches(x, '{p}')))::BIGINT"


@query(
    f"""WITH t AS (SELECT id, texto, {_L} AS l FROM chunks WHERE texto IS NOT NULL), h AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '(?i){A.ARTICLE_LINE}')) AS a, list_transform(l, lambda x: len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM t),
n AS (SELECT *, list_transform(a, lambda x: upper(regexp_extract(x, '(?i)(?:ART[ÍI]CULO|ART\\.)[ \\t]+(?:TRANSITORIO[ \\t]+)?([\\p{{L}}\\d.]+)', 1))) AS r FROM h),
c AS (SELECT id, len(l)::BIGINT AS lineas, len(list_filter(w, lambda x: x > 512))::BIGINT AS lineas_mas_512_palabras, coalesce(list_max(w), 0)::BIGINT AS linea_palabras_max, coalesce(list_max(list_transform(l, lambda x: length(x))), 0)::BIGINT AS linea_caracteres_max, len(list_filter(regexp_split_to_array(texto, '\\n[ \\t]*\\n(?:[ \\t]*\\n)*'), lambda x: regexp_replace(x, '[\\s\\p{{Z}}]+', '', 'g') <> ''))::BIGINT AS bloques, len(a)::BIGINT AS articulos, len(list_distinct(r))::BIGINT AS articulos_rotulos_distintos,
len(list_filter(a, lambda x: regexp_matches(x, '^[ \\t]*["“«]')))::BIGINT AS articulos_entrecomillados, len(list_filter(r, lambda x: regexp_matches(x, '\\d\\.\\d')))::BIGINT AS articulos_jerarquicos, len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 2))::BIGINT AS lineas_tabla, len(regexp_extract_all(texto, '\\[TEXTO TACHADO EN LA FUENTE:'))::BIGINT AS tachados, """
    + ", ".join(f"{_few(f'(?i){A._LEAD}{p}(?:$|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_])', 240)} AS parte_{c}" for c, p in A.PARTS.items()) + ", "
    + ", ".join(f"{_few(f'(?i)^[ {chr(92)}t]*{p}' + A._LEVEL_NUMBER.replace('(?![' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])', '(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])'), 180)} AS nivel_{c}" for c, p in A.LEVELS.items()) + ", "
    + ", ".join(f"len(regexp_extract_all(texto, '(?i){p}'))::BIGINT AS senal_{c}" for c, p in A.SIGNS.items())
    + " FROM n) SELECT *, (" + " + ".join(f"(parte_{c} > 0)::INT" for c in A.PARTS) + ")::BIGINT AS familias_partes, (" + " + ".join(f"(nivel_{c} > 0)::INT" for c in A.LEVELS) + ")::BIGINT AS familias_niveles, parte_antecedentes > 0 AND parte_consideraciones > 0 AND parte_resuelve + parte_falla + parte_decision > 0 AS completa FROM c"
)
def q125_structure_census(s: SparkSession, d: str) -> DataFrame:
    """Lines, articles, tables, parts, levels and signs of every chunk."""
    return A.structure_census(read(s, d, "chunks"), "id", "texto").withColumn("linea_palabras_max", F.col("linea_palabras_max").cast("bigint"))


@query("WITH l AS (SELECT id, i, length(x) - length(replace(x, '|', '')) >= 2 AS t FROM (SELECT id, unnest(string_split(texto, chr(10))) AS x, generate_subscripts(string_split(texto, chr(10)), 1) AS i FROM chunks WHERE texto IS NOT NULL)), m AS (SELECT id, t AND NOT coalesce(lag(t) OVER (PARTITION BY id ORDER BY i), false) AS e FROM l) SELECT id, count(*) FILTER (e) AS bloques FROM m GROUP BY 1")
def q126_table_blocks(s: SparkSession, d: str) -> DataFrame:
    return A.table_blocks(read(s, d, "chunks"), "id", "texto")


@query(
    r"""WITH u AS (SELECT regexp_replace(lower(trim(doc_id)), '[\s\-_]+', '_', 'g') AS doc_id, tipo, articulo, texto, avisos, length(texto) AS n, sha256(texto) AS h FROM chunks WHERE texto IS NOT NULL),
q AS (SELECT tipo, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM u GROUP BY 1), s AS (SELECT h, count(*) AS c FROM u GROUP BY 1),
x AS (SELECT u.*, s.c, (n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1)) AS rara, try_cast(regexp_extract(articulo, '^(\d{1,9})$', 1) AS INT) AS k FROM u LEFT JOIN q USING (tipo) JOIN s USING (h))
SELECT doc_id, count(*) AS unidades, count(articulo) AS articulos_asignados, count(DISTINCT articulo) AS articulos_distintos, count(*) FILTER (articulo IS NULL) AS sin_articulo, count(*) FILTER (regexp_replace(texto, '[\s\p{Z}]+', '', 'g') = '') AS vacias, count(*) FILTER (n < 80) AS menores_80, count(*) FILTER (n > 20000) AS mayores_20000, count(*) FILTER (rara) AS atipicas, min(n)::INT AS longitud_min,
round(quantile_cont(n, 0.25), 2) AS longitud_p25, round(quantile_cont(n, 0.5), 2) AS longitud_mediana, round(quantile_cont(n, 0.95), 2) AS longitud_p95, round(quantile_cont(n, 0.99), 2) AS longitud_p99, max(n)::INT AS longitud_max, sum(n)::BIGINT AS caracteres, sum(len(regexp_extract_all(texto, '""" + _GARBLED + r"""')))::BIGINT AS mojibake, sum(len(regexp_extract_all(texto, '&(?:[aeiouAEIOU](?:acute|ACUTE)|[nN](?:tilde|TILDE)|(?:quot|amp|nbsp))(?:;|\b)')))::BIGINT AS entidades,
sum(len(regexp_extract_all(texto, '[\x00-\x08\x0b\x0c\x0e-\x1f]')))::BIGINT AS controles, count(*) FILTER (c > 1) AS identicas, count(*) FILTER (coalesce(avisos, '[]') <> '[]') AS con_avisos, coalesce(max(k) - min(k) + 1 - count(DISTINCT k), 0)::BIGINT AS huecos, (SELECT min(m.tipo) FROM manifiesto m WHERE m.doc_id = x.doc_id) AS tipo FROM x GROUP BY doc_id"""
)
def q127_document_rows(s: SparkSession, d: str) -> DataFrame:
    """One audit row per document."""
    units = read(s, d, "chunks").withColumn("doc_id", T.settle_id(F.col("doc_id")))
    return A.document_rows(units, read(s, d, "manifiesto").select("doc_id", "tipo"))


@query("SELECT campo, tipo_dato, presentes, presentes >= 0.9 * n AS filtrable FROM (SELECT (SELECT count(*) FROM chunks) AS n, 'tipo' AS campo, 'string' AS tipo_dato, count(*) FILTER (tipo <> '') AS presentes FROM chunks UNION ALL SELECT (SELECT count(*) FROM chunks), 'articulo', 'string', count(*) FILTER (articulo <> '') FROM chunks UNION ALL SELECT (SELECT count(*) FROM chunks), 'seccion', 'string', count(*) FILTER (seccion <> '') FROM chunks UNION ALL SELECT (SELECT count(*) FROM chunks), 'inicio', 'bigint', count(inicio) FROM chunks)")
def q128_filterable_fields(s: SparkSession, d: str) -> DataFrame:
    return A.filterable(read(s, d, "chunks"), ["tipo", "articulo", "seccion", "inicio"])


@query("SELECT seccion, severidad, doc_id, comprobacion, detalle FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, comprobacion ORDER BY CASE severidad WHEN 'CRITICO' THEN 1 WHEN 'ALTO' THEN 2 WHEN 'AVISO' THEN 3 ELSE 99 END, seccion, detalle NULLS FIRST) AS r FROM hallazgos) WHERE r = 1")
def q129_gravest_findings(s: SparkSession, d: str) -> DataFrame:
    return A.first_of_document(read(s, d, "hallazgos"))
