"""Audit families: each rule gives findings (seccion, severidad, doc_id, comprobacion, detalle), and their union is the report.

Rules are filters, joins and aggregates; a family is one union, and a document's findings are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Severities in order, required fields, official hosts, and the kinds with articles and with a decision.
SEVERITIES = ("CRITICO", "ALTO", "AVISO")
REQUIRED = ("doc_id", "titulo", "fuente", "url", "fecha_consulta", "areas")
OFFICIAL = (".gov.co", "comunidadandina.org")
WITH_ARTICLES = ("ley", "decreto", "acto_legislativo", "constitucion", "decision")
JUDICIAL = ("sentencia", "auto")
TREATY = r"(?i)\bpor\s+medio\s+de\s+la\s+cual\s+se\s+aprueba|\baprueba\s+(?:el|la|los|las)\s+[\"“]?(?:convenio|convenci[oó]n|tratado|acuerdo|protocolo|enmienda|estatuto)"
CLOSING = r"(?i)\bnotif[ií]quese|\bc[oó]piese|\bc[uú]mplase|\bcomun[ií]quese"
DECIDES = r"(?i)\bresuelve\b"
FOOTER = r"(?i)normas de uso de la informaci[oó]n aqu[ií] contenida"


def finding(df: DataFrame, section: str, severity: str | Column, check: str, detail: Column, doc: str = "doc_id") -> DataFrame:
    """df's rows as findings of one rule."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(section).alias("seccion"), sev.alias("severidad"), F.col(doc).cast("string").alias("doc_id"), F.lit(check).alias("comprobacion"), detail.cast("string").alias("detalle"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def official(url: Column, hosts: tuple[str, ...] = OFFICIAL) -> Column:
    """Whether a URL's host ends in one of the official ones."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    return reduce(Column.__or__, [h.endswith(o) for o in hosts])


def compliance(documents: DataFrame, hosts: tuple[str, ...] = OFFICIAL) -> DataFrame:
    """A: required fields that are missing, sources that aren't official, norms that approve a treaty."""
    kinds = dict(documents.dtypes)
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0 if kinds[c].startswith("array") else F.col(c).cast("string") == "")
    lacks = F.array_compact(F.array(*[F.when(empty(c), c) for c in REQUIRED]))
    urls = documents.select("doc_id", F.explode(F.array_compact(F.concat(F.array("url"), F.coalesce(F.transform("archivos_raw", lambda a: a["url_final"]), F.array().cast("array<string>"))))).alias("u"))
    bad = urls.where((F.col("u") != "") & ~official(F.col("u"), hosts)).groupBy("doc_id").agg(F.min("u").alias("u"))
    return union(
        finding(documents.withColumn("_f", lacks).where(F.size("_f") > 0), "A", "CRITICO", "campos_obligatorios_manifiesto", F.concat(F.lit("faltan: "), F.array_join("_f", ", "))),
        finding(bad, "A", "ALTO", "fuente_no_oficial", F.col("u")),
        finding(documents.where(F.col("titulo").rlike(T.any_case(TREATY))), "A", "AVISO", "ley_aprobatoria_de_tratado", F.col("titulo")),
    )


def leakage(leaks: DataFrame, official_documents: DataFrame) -> DataFrame:
    """A: one finding for each document that holds an item's passage: critical for a question or outside official sources.

    leaks(doc_id, item, campo); the finding names the first field, then the smallest item.
    """
    first = leaks.groupBy("doc_id").agg(F.min(F.struct("campo", "item")).alias("x")).select("doc_id", "x.campo", "x.item")
    rows = first.join(official_documents.select("doc_id").distinct().withColumn("_o", F.lit(True)), "doc_id", "left")
    critical = (F.col("campo") == "pregunta") | F.col("_o").isNull()
    detail = F.concat_ws(" ", F.lit("ítem"), F.col("item").cast("string"), F.col("campo"))
    return union(finding(rows.where(critical), "A", "CRITICO", "fuga_evaluacion", detail), finding(rows.where(~critical), "A", "AVISO", "respuesta_cita_fuente_oficial", detail))


def _groups(df: DataFrame, by: Column) -> DataFrame:
    """(doc_id, otros): the smallest id of each group of two ids or more, and how many others."""
    return df.select(by.alias("_g"), "doc_id").where("_g IS NOT NULL").distinct().groupBy("_g").agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("otros")).where("otros > 0")


def integrity(inventory: DataFrame, manifest: DataFrame, exclusions: DataFrame) -> DataFrame:
    """B: inventory not downloaded nor excluded, downloads outside the inventory, the same originals or the same norm under two ids."""
    ids = manifest.select("doc_id").distinct()
    missing = inventory.select("doc_id").distinct().join(ids, "doc_id", "left_anti").join(exclusions.select("doc_id"), "doc_id", "left_anti")
    outside = ids.join(inventory.select("doc_id"), "doc_id", "left_anti")
    content = F.nullif(F.array_join(F.transform("archivos_raw", lambda a: a["sha256"]), ""), F.lit(""))
    return union(
        finding(missing, "B", "CRITICO", "sin_descargar", F.lit("")),
        finding(outside, "B", "AVISO", "fuera_del_inventario", F.lit("")),
        finding(_groups(manifest, content), "B", "ALTO", "duplicado_por_contenido", F.col("otros")),
        finding(_groups(manifest, F.regexp_replace(T.settle_id(F.col("doc_id")), "^co_", "")), "B", "ALTO", "duplicado_por_identidad", F.col("otros")),
    )


def numbers(articles: Column) -> Column:
    """struct(articulos, maximo, huecos) of an array of article labels: distinct leading numbers below 5,000, the greatest, and how many of 1 to it are missing."""
    ns = F.array_distinct(F.filter(F.transform(articles, lambda a: F.nullif(F.regexp_extract(a, r"^(\d{1,9})", 1), F.lit("")).cast("int")), lambda n: n.isNotNull() & (n < 5000)))
    top = F.coalesce(F.array_max(ns), F.lit(0))
    return F.struct(F.size(ns).alias("articulos"), top.alias("maximo"), (top - F.size(F.filter(ns, lambda n: n >= 1))).alias("huecos"))


def completeness(texts: DataFrame) -> DataFrame:
    """C: judgments without an ending or below 8,000 characters; norms without articles, or with gaps in a tenth of the numbers of more than ten.

    texts(doc_id, tipo, texto): whole documents; article numbers come from line-anchored headings.
    """
    t = F.col("texto")
    n = F.length(t)
    tail = F.substring(t, F.floor(n * 0.8).cast("int") + 1, n)
    labels = F.transform(F.regexp_extract_all(t, F.lit(T.any_case(r"(?im)^[ \t]*art[íi]culo[ \t]+\d+")), F.lit(0)), lambda x: F.regexp_extract(x, r"(\d+)$", 1))
    m = texts.where(t.isNotNull()).select("doc_id", "tipo", n.alias("n"), (tail.rlike(T.any_case(CLOSING)) | t.rlike(T.any_case(DECIDES))).alias("cierra"), numbers(labels).alias("m")).select("doc_id", "tipo", "n", "cierra", "m.*")
    judicial, norms = m.where(F.col("tipo").isin(*JUDICIAL)), m.where(F.col("tipo").isin(*WITH_ARTICLES))
    gaps = norms.where((F.col("articulos") > 10) & (F.col("huecos") / F.greatest("maximo", F.lit(1)) > 0.10))
    return union(
        finding(judicial.where("NOT cierra"), "C", "AVISO", "sentencia_sin_parte_resolutiva", F.lit("")),
        finding(judicial.where("n < 8000"), "C", "ALTO", "sentencia_corta", F.col("n")),
        finding(norms.where("articulos = 0"), "C", "ALTO", "norma_sin_articulos", F.lit("")),
        finding(gaps, "C", "AVISO", "huecos_en_numeracion", F.col("huecos")),
    )


def quality(texts: DataFrame) -> DataFrame:
    """D: garbled, illegible and very short texts, and more than one editorial footer."""
    t = F.col("texto")
    bad, feet = T.garbled_count(t), F.regexp_count(t, F.lit(T.any_case(FOOTER))).cast("bigint")
    rows = texts.where(t.isNotNull()).select("doc_id", bad.alias("malas"), F.length(t).alias("n"), F.length(F.regexp_replace(t, r"^\s+|\s+$", "")).alias("lleno"), feet.alias("pies"), legible(t).alias("legible"))
    return union(
        finding(rows.where((F.col("malas") > 20) | (F.col("malas") > 1e-4 * F.col("n"))), "D", "ALTO", "texto_con_mojibake", F.col("malas")),
        finding(rows.where("NOT legible"), "D", "ALTO", "texto_ilegible_requiere_ocr", F.lit("")),
        finding(rows.where("lleno < 1500"), "D", "ALTO", "texto_muy_corto", F.col("n")),
        finding(rows.where("pies > 1"), "D", "AVISO", "pie_editorial_en_original", F.col("pies")),
    )


# The function words that legible Spanish has, and the least share of them.
FUNCTION_WORDS = "de la el en que los las del por se con una para su".split()


def legible(t: Column) -> Column:
    """Whether a text is readable: 500 characters, hardly a letter of another alphabet, a quarter of its words function words."""
    words = T.tokens(t)
    few = F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS)))
    other = F.length(F.regexp_replace(t, r"[^\p{IsCyrillic}\p{IsGreek}\p{IsHan}]", ""))
    return (F.length(t) >= 500) & (other <= 0.01 * F.length(t)) & (few >= 0.25 * F.size(words))


def coverage(targets: DataFrame, present: DataFrame, graph: DataFrame, threshold: int) -> DataFrame:
    """E: targets (clave, items) that the corpus lacks, by weight; references at or above the threshold that it lacks."""
    have = present.select(F.regexp_replace("doc_id", "^co_", "").alias("clave")).distinct()
    lost = targets.join(have, "clave", "left_anti").withColumn("doc_id", F.col("clave"))
    cited = graph.where(F.col("documentos") >= threshold).join(have, "clave", "left_anti").withColumn("doc_id", F.col("clave"))
    return union(finding(lost, "E", F.when(F.col("items") > 1, "ALTO").otherwise("AVISO"), "seed_target_ausente", F.col("items")), finding(cited, "E", "AVISO", "citada_por_el_corpus_y_ausente", F.col("documentos")))


def ingestion(manifest: DataFrame, corpus: DataFrame, checks: DataFrame) -> DataFrame:
    """F: downloads that didn't reach the corpus, documents that failed or may not be searched, and failed checks.

    corpus(doc_id, estado, apta), checks(comprobacion, resultado).
    """
    gone = manifest.select("doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_anti")
    failed = checks.where(~F.col("resultado").eqNullSafe("ok")).select(F.lit("").alias("doc_id"), "comprobacion")
    return union(
        finding(gone, "F", "CRITICO", "no_llego_al_corpus", F.lit("")),
        finding(corpus.where("estado = 'error'"), "F", "CRITICO", "error_de_extraccion", F.lit("")),
        finding(corpus.where("apta = false"), "F", "ALTO", "excluido_de_busqueda", F.lit("")),
        finding(failed, "F", "CRITICO", "comprobacion_ingesta_fallida", F.col("comprobacion")),
    )


def graph_closed(graph: DataFrame, present: DataFrame, exclusions: DataFrame, norms: int = 4, judgments: int = 8) -> DataFrame:
    """G: references at or above the threshold of their kind that are neither present nor excluded, and exclusions without reason or evidence."""
    have = present.select(F.regexp_replace("doc_id", "^co_", "").alias("clave")).distinct()
    least = F.when(F.col("clave").startswith("sentencia"), judgments).otherwise(norms)
    open_ = graph.where(F.col("documentos") >= least).join(have, "clave", "left_anti").join(exclusions.select("clave"), "clave", "left_anti").withColumn("doc_id", F.col("clave"))
    bare = exclusions.where((F.coalesce("motivo", F.lit("")) == "") | (F.coalesce("evidencia", F.lit("")) == "")).withColumn("doc_id", F.col("clave"))
    return union(finding(open_, "G", "CRITICO", "grafo_abierto", F.col("documentos")), finding(bare, "G", "ALTO", "exclusion_sin_evidencia", F.lit("")))


def sorted_findings(findings: DataFrame) -> DataFrame:
    """Findings with their place in the report: by severity, section, check and document."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severidad")), F.lit(99))
    return findings.orderBy(order, "seccion", "comprobacion", "doc_id")


# Why a reference is left out, in order, by what its evidence says.
EXCLUSIONS = (
    ("cita_errada", r"(?i)\b(?:cita|referencia) (?:errada|equivocada|incorrecta)|\berror de (?:cita|digitaci[oó]n)"), ("proyecto_de_ley", r"(?i)\bproyecto de (?:ley|acto legislativo)\b"), ("compilada", r"(?i)\bcompilad[oa]s?\b"),
    ("enlace_roto", r"(?i)\b(?:enlace|v[ií]nculo) roto\b|\b404(?:$|[^\p{L}\p{N}_])"), ("sin_texto_oficial", r"(?i)\bsin texto oficial\b|\bno (?:est[aá]|se encuentra) publicad[oa]"),
)


def excluded_by(text: Column, reach: int = 140) -> Column:
    """struct(motivo, evidencia): the first reason that a text gives and up to ``reach`` characters after it; nulls if it gives none."""
    first = F.coalesce(*[F.when(text.rlike(T.any_case(p)), F.struct(F.lit(n).alias("motivo"), F.regexp_extract(text, T.any_case(rf"(?s){p}.{{0,{reach}}}"), 0).alias("evidencia"))) for n, p in EXCLUSIONS])
    return first


def preparation_issues(text: Column, garbled: Column, poor_pages: Column, notes: Column) -> Column:
    """What a prepared document must be looked at for, in order."""
    return F.array_compact(
        F.array(
            F.when(text.rlike(r"(?iu)esta compilaci[oó]n no incluye el texto|texto de esta norma no se sistematizar[aá]"), "fuente_declara_omision_del_texto"), F.when(garbled > 0, "codificacion_residual_por_revisar"), F.when(F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) < 200, "texto_corto_por_revisar"),
            F.when(poor_pages > 0, "paginas_sin_texto_suficiente"), *[F.when(F.array_contains(notes, n), n) for n in ("paginacion_derivado_no_verificada", "revisar_calidad_OCR", "bytes_no_decodificables_en_charset_declarado")],
        )
    )


def reconciled(alerts: DataFrame, now: DataFrame) -> DataFrame:
    """Old alerts (doc_id, comprobacion, detalle) held against the present state (doc_id, comprobacion, detalle): one outcome each, the first that holds.

    Documents match by their settled id: none, one or several present documents; then the check, then the detail.
    """
    key = T.settle_id(F.regexp_replace("doc_id", "^co_", ""))
    docs = now.select(key.alias("k"), "doc_id").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("_docs"))
    state = now.select(key.alias("k"), "comprobacion", F.coalesce("detalle", F.lit("")).alias("_d")).groupBy("k", "comprobacion").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    rows = alerts.withColumn("k", key).join(docs, "k", "left").join(state, ["k", "comprobacion"], "left")
    detail = F.coalesce("detalle", F.lit(""))
    outcome = (
        F.when(F.col("k") == "", "sin_documento").when(F.col("_docs").isNull(), "documento_retirado").when(F.col("_docs") > 1, "documento_ambiguo").when(F.col("_n").isNull(), "resuelta")
        .when((F.col("_n") == 1) & (F.col("_lo") == detail), "vigente").when(F.col("_n") == 1, "cambiada").when((F.col("_lo") <= detail) & (detail <= F.col("_hi")), "vigente_varias").otherwise("cambiada_varias")
    )
    return rows.select("doc_id", "comprobacion", "detalle", outcome.alias("resultado"))


# ---- census of structure -----------------------------------------------------------------------------------------------

# Parts of judgments, levels of norms and signs of state, by line or text.
_LEAD = r"^[ \t]*(?:(?:[IVXLCDM]{1,10}|\d+(?:\.\d+)*)[.)\-:]?[ \t]+)?"
PARTS = {
    "antecedentes": "ANTECEDENTES", "consideraciones": "CONSIDERACIONES", "fundamentos": r"FUNDAMENTOS(?:[ \t]+JUR[ÍI]DICOS)?", "problema_juridico": r"PROBLEMAS?[ \t]+JUR[ÍI]DICOS?", "competencia": "COMPETENCIA", "resuelve": "RESUELVE", "falla": "(?:FALLA|FALLO)", "decision": "DECISI[ÓO]N",
}
LEVELS = {"libro": "LIBRO", "titulo": "T[ÍI]TULO", "capitulo": "CAP[ÍI]TULO", "seccion": "SECCI[ÓO]N", "parte": "PARTE"}
_LEVEL_NUMBER = r"[ \t]+(?:\d|(?:[IVXLCDM]+|[ÚU]NICO|PRELIMINAR|PRIMER[OA]?|SEGUND[OA]|TERCER[OA]?|CUART[OA]|QUINT[OA]|SEXT[OA]|S[ÉE]PTIM[OA]|OCTAV[OA]|NOVEN[OA]|D[ÉE]CIM[OA])(?![\p{L}\p{N}_]))"
SIGNS = {
    "vigencia_anterior": r"(?:vigencia|legislaci[oó]n|texto)[ \t]+anterior", "derogacion": r"\bderogad[oa]s?\b", "inexequibilidad": r"\binexequible(?:s)?\b", "modificacion": r"\bmodificad[oa]s?\b", "notas_vigencia": r"notas?[ \t]+de[ \t]+vigencia", "concordancias": r"\bconcordancias\b",
}
ARTICLE_LINE = r"^[ \t]*[\"“«]?[ \t]*(?:ART[ÍI]CULO|ART\.)[ \t]+(?:TRANSITORIO[ \t]+)?(?:\d+(?:\.\d+)*[A-Z]?[º°ªo]?|[ÚU]NICO|PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[ÉE]PTIMO|OCTAVO|NOVENO|D[ÉE]CIMO)(?:[\s.°ºª:;–—-]|$)"


def structure_census(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text: lines and their words, headings of articles, tables, parts of judgments, levels of norms, signs of state, and quantiles of lines; built-in only."""
    t = F.col(text)
    lines = F.filter(F.split(t, "\n"), lambda x: ~T.blank(x))
    n = lambda a: F.size(a).cast("bigint")
    words = F.transform(F.col("_l"), lambda x: T.word_count(x))
    few = lambda p, most: n(F.filter("_l", lambda x: (F.length(x) <= most) & x.rlike(T.any_case(p))))
    parts = [few(f"(?i){_LEAD}{p}(?![\\p{{L}}\\p{{N}}_])", 240).alias(f"parte_{c}") for c, p in PARTS.items()]
    levels = [few(f"(?i)^[ \\t]*{p}{_LEVEL_NUMBER}", 180).alias(f"nivel_{c}") for c, p in LEVELS.items()]
    signs = [F.regexp_count(t, F.lit(T.any_case(f"(?i){p}"))).cast("bigint").alias(f"senal_{c}") for c, p in SIGNS.items()]
    table = n(F.filter("_l", lambda x: F.length(x) - F.length(F.translate(x, "|", "")) >= 2))
    heads = F.filter("_l", lambda x: x.rlike(T.any_case(f"(?i){ARTICLE_LINE}")))
    number = F.transform(heads, lambda x: F.upper(F.regexp_extract(x, r"(?iu)(?:ART[ÍI]CULO|ART\.)[ \t]+(?:TRANSITORIO[ \t]+)?([\p{L}\d.]+)", 1)))
    rows = df.where(t.isNotNull()).select(key, t, lines.alias("_l")).select(
        key, n("_l").alias("lineas"), n(F.filter(words, lambda w: w > 512)).alias("lineas_mas_512_palabras"), F.coalesce(F.array_max(words), F.lit(0)).alias("linea_palabras_max"), F.coalesce(F.array_max(F.transform("_l", lambda x: F.length(x))), F.lit(0)).cast("bigint").alias("linea_caracteres_max"),
        n(F.filter(F.split(t, r"\n[ \t]*\n(?:[ \t]*\n)*"), lambda x: ~T.blank(x))).alias("bloques"), n(heads).alias("articulos"), n(F.array_distinct(number)).alias("articulos_rotulos_distintos"), n(F.filter(heads, lambda x: x.rlike(r"^[ \t]*[\"“«]"))).alias("articulos_entrecomillados"), n(F.filter(number, lambda x: x.rlike(r"\d\.\d"))).alias("articulos_jerarquicos"),
        table.alias("lineas_tabla"), F.regexp_count(t, F.lit(r"\[TEXTO TACHADO EN LA FUENTE:")).cast("bigint").alias("tachados"), *parts, *levels, *signs,
    )
    has = lambda names, p: sum((F.col(f"{p}_{c}") > 0).cast("int") for c in names)
    return rows.withColumn("familias_partes", has(PARTS, "parte").cast("bigint")).withColumn("familias_niveles", has(LEVELS, "nivel").cast("bigint")).withColumn("completa", (F.col("parte_antecedentes") > 0) & (F.col("parte_consideraciones") > 0) & (F.col("parte_resuelve") + F.col("parte_falla") + F.col("parte_decision") > 0))


def table_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bloques): runs of adjoining table lines of each text; a blank line ends a run."""
    flags = F.transform(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.translate(x, "|", "")) >= 2)
    before = F.concat(F.array(F.lit(False)), F.slice("_f", 1, F.size("_f") - 1))
    starts = F.size(F.filter(F.zip_with("_f", before, lambda a, b: a & ~b), lambda x: x)).cast("bigint")
    return df.where(F.col(text).isNotNull()).select(key, flags.alias("_f")).select(key, starts.alias("bloques"))


def document_rows(units: DataFrame, documents: DataFrame) -> DataFrame:
    """One audit row per document from its units(doc_id, tipo, articulo, texto, avisos) and documents(doc_id, tipo).

    Lengths against the fences of their kind (1.5 interquartile ranges), numbering, repeated and identical units, noise.
    Everything is an aggregate by document; quantiles of lengths are exact.
    """
    n = F.length("texto")
    q = units.where("texto IS NOT NULL").groupBy("tipo").agg(F.percentile(n, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    same = units.where("texto IS NOT NULL").groupBy(F.sha2("texto", 256).alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    reach = 1.5 * (F.col("q")[1] - F.col("q")[0])
    rows = units.where("texto IS NOT NULL").withColumn("_h", F.sha2("texto", 256)).withColumn("_n", n).join(F.broadcast(q), "tipo", "left").join(same, "_h")
    odd = (F.col("_n") < F.col("q")[0] - reach) | (F.col("_n") > F.col("q")[1] + reach)
    number = F.try_to_number(F.nullif(F.regexp_extract("articulo", r"^(\d{1,9})$", 1), F.lit("")), F.lit("9" * 9)).cast("int")
    point = lambda p: F.round(F.percentile("_n", F.lit(p)), 2)
    per = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("unidades"), F.count("articulo").alias("articulos_asignados"), F.count_distinct("articulo").alias("articulos_distintos"), F.count_if(F.col("articulo").isNull()).alias("sin_articulo"), F.count_distinct(number).alias("_k"), F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.count_if(T.blank(F.col("texto"))).alias("vacias"),
        F.count_if(F.col("_n") < 80).alias("menores_80"), F.count_if(F.col("_n") > 20000).alias("mayores_20000"), F.count_if(odd).alias("atipicas"), F.min("_n").alias("longitud_min"), point(0.25).alias("longitud_p25"), point(0.5).alias("longitud_mediana"), point(0.95).alias("longitud_p95"), point(0.99).alias("longitud_p99"), F.max("_n").alias("longitud_max"),
        F.sum("_n").alias("caracteres"), F.sum(T.garbled_count(F.col("texto"))).alias("mojibake"), F.sum(F.regexp_count("texto", F.lit(r"&(?:[aeiouAEIOU](?:acute|ACUTE)|[nN](?:tilde|TILDE)|(?:quot|amp|nbsp))(?:;|\b)")).cast("bigint")).alias("entidades"),
        F.sum(F.regexp_count("texto", F.lit(r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]")).cast("bigint")).alias("controles"), F.count_if(F.col("_c") > 1).alias("identicas"), F.count_if(F.coalesce("avisos", F.lit("[]")) != "[]").alias("con_avisos"),
    )
    return per.withColumn("huecos", F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("_k"), F.lit(0)).cast("bigint")).drop("_k", "_lo", "_hi").join(documents.groupBy("doc_id").agg(F.min("tipo").alias("tipo")), "doc_id", "left")


def filterable(df: DataFrame, fields: list[str]) -> DataFrame:
    """(campo, tipo_dato, presentes, distintos, filtrable): which fields a search may filter by: present in nine rows of ten with few values."""
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n")] + [x for c in fields for x in (F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"p_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"))]
    cell = lambda c: F.struct(F.lit(c).alias("campo"), F.lit(kinds[c]).alias("tipo_dato"), F.col(f"p_{c}").alias("presentes"), (F.col(f"p_{c}") >= 0.9 * F.col("n")).alias("filtrable"))
    return df.agg(*aggs).select(F.explode(F.array(*map(cell, fields))).alias("x")).select("x.*")


def first_of_document(findings: DataFrame) -> DataFrame:
    """The gravest finding of each document and check."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severidad")), F.lit(99))
    w = Window.partitionBy("doc_id", "comprobacion").orderBy(order, "seccion", "detalle")
    return findings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
