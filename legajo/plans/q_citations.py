"""Queries of citations: extraction, scores, the citation graph, identities, backing and audits of answers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as C
from ..operators import segment as G
from ..sources.tables import read
from .registry import registry

QUERIES, SQL, query = registry()

# ---- SQL of the extractor, from the same fixed values -------------------------------------------------------------------

_PLAIN = r"trim(regexp_replace(lower(strip_accents(regexp_replace(coalesce({}, ''), '\p{{M}}', '', 'g'))), '[\s\p{{Z}}]+', ' ', 'g'))"
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(regexp_replace(k, '[\\s-]+', ' ', 'g'), '{'|'.join(w.replace('-', ' ') for w in ws)}') THEN '{k}'" for k, ws in C.KINDS.items()) + " END"
_CODE_OF = "CASE " + " ".join(f"WHEN kind = '{k}' AND n = '{n}' THEN '{c}'" for (k, n), c in C.NUMBERED.items()) + " END"
_NAMED = " UNION ALL ".join(
    f"SELECT k, '{c}' AS clave FROM t WHERE regexp_matches(f, '(?:^|[^\\p{{L}}\\p{{N}}_.])(?:{'|'.join(re.escape(x).replace(chr(92) + ' ', chr(92) + 's+') for x in sorted(ns, key=len, reverse=True))})(?:$|[^\\p{{L}}\\p{{N}}_])')" for c, ns in C.CODES.items()
)


def _bodies_sql(name: str, source: str) -> str:
    """CTEs t_, n_ ... and ``name``(k, clave): the distinct bodies of source(k, f)."""
    t = f"t_{name}"
    return f"""{t} AS ({source}),
n_{name} AS (SELECT k AS id, regexp_extract(x, '{C.NORM}', 1) AS k, regexp_extract(x, '{C.NORM}', 2) AS n, regexp_extract(x, '{C.NORM}', 3) AS y FROM (SELECT k, unnest(regexp_extract_all(f, '{C.NORM}')) AS x FROM {t})),
m_{name} AS (SELECT id, {_KIND} AS kind, n, y FROM n_{name}),
l_{name} AS (SELECT k AS id, regexp_extract(x, '{C.BARE}', 1) AS kind, regexp_extract(x, '{C.BARE}', 2) AS n FROM (SELECT k, unnest(regexp_extract_all(regexp_replace(f, '\\b(ley|decreto)\\s*(?:n[°ºo]?\\.?\\s*)?\\d{{2,5}}\\s*(?:de|del|/|-)\\s*\\d{{4}}', ' ; ', 'g'), '{C.BARE}')) AS x FROM {t})),
j_{name} AS (SELECT k, regexp_extract(x, '{C.JUDGMENT}', 1) AS s, regexp_extract(x, '{C.JUDGMENT}', 2)::INT AS n, regexp_extract(x, '{C.JUDGMENT}', 3) AS y FROM (SELECT k, unnest(regexp_extract_all(f, '{C.JUDGMENT}')) AS x FROM {t})),
{name} AS (SELECT DISTINCT k, clave FROM (
  SELECT id AS k, coalesce({_CODE_OF}, kind || '|' || n || '|' || y) AS clave FROM m_{name}
  UNION ALL SELECT id, {_CODE_OF} FROM l_{name}
  UNION ALL SELECT k, 'jurisprudencia|' || upper(s) || '-' || n || '|' || CASE WHEN length(y) = 2 THEN CASE WHEN y::INT < 50 THEN '20' ELSE '19' END || y ELSE y END FROM j_{name}
  UNION ALL {_NAMED.replace(' FROM t ', f' FROM {t} ')}) WHERE clave IS NOT NULL)"""


def _source(table: str, key: str, column: str) -> str:
    return f"SELECT {key} AS k, {_PLAIN.format(column)} AS f FROM {table} WHERE {column} IS NOT NULL"


_DOCS = "WITH " + _bodies_sql("c", _source("documents", "doc_id", "text"))


def _cites(s: SparkSession, d: str) -> DataFrame:
    return C.bodies(read(s, d, "documents"), "doc_id", "text")


@query(_DOCS + " SELECT k AS doc_id, clave FROM c")
def q58_citation_bodies(s: SparkSession, d: str) -> DataFrame:
    """The distinct norms, codes and judgments that each document cites."""
    return _cites(s, d)


# The norms of a text are set off by marks; what stands 90 characters before and 60 after each is looked at.
_ARTICLES = rf"""WITH t AS ({_source("documents", "doc_id", "text")}),
p AS (SELECT k, string_split(regexp_replace(f, '{C.NORM}', chr(1) || '\0' || chr(2), 'g'), chr(1)) AS p FROM t),
w AS (SELECT k, split_part(p[i], chr(2), 1) AS x, right(replace(array_to_string(p[1 : i - 1], ''), chr(2), ''), 90) AS antes, left(replace(substr(p[i], strpos(p[i], chr(2)) + 1) || array_to_string(p[i + 1 :], ''), chr(2), ''), 60) AS luego FROM (SELECT k, p, unnest(range(2, len(p) + 1)) AS i FROM p)),
g AS (SELECT k, x, regexp_extract(antes, '^(?s:.*)(?:{C.MENTION})([^.;]*)$', 1) AS a, regexp_extract(luego, '^[^\p{{L}}\p{{N}}_]*(?:{C.MENTION})((?s:.{{0,40}}))', 1) AS b FROM w),
u AS (SELECT k, x, unnest(list_concat(regexp_extract_all(regexp_extract(a, '{C.NUMBERS}', 1), '\d+[a-z]?'), regexp_extract_all(regexp_extract(b, '{C.NUMBERS}', 1), '\d+[a-z]?'))) AS articulo FROM g),
r AS (SELECT k AS doc_id, articulo, regexp_extract(x, '{C.NORM}', 1) AS k, regexp_extract(x, '{C.NORM}', 2) AS n, regexp_extract(x, '{C.NORM}', 3) AS y FROM u),
q AS (SELECT doc_id, {_KIND} AS kind, n, y, articulo FROM r)
SELECT DISTINCT doc_id, kind AS cuerpo, n AS numero, y AS anio, articulo FROM q WHERE {_CODE_OF} IS NULL"""


@query(_ARTICLES)
def q58_article_citations(s: SparkSession, d: str) -> DataFrame:
    """The articles of numbered norms that each document cites, before or after the norm."""
    return C.extracted(read(s, d, "documents"), "doc_id", "text").where("articulo IS NOT NULL AND numero IS NOT NULL")


_GOLD = "WITH " + ", ".join(_bodies_sql(n, _source("clave_oro", "id", c)) for n, c in (("a", "respuesta_esperada"), ("b", "legal_basis"), ("r", "pregunta")))
_SETS = ", conj AS (SELECT i.id, coalesce(list_sort(list(DISTINCT a.clave) FILTER (a.clave IS NOT NULL)), []) AS a, coalesce(list_sort(list(DISTINCT b.clave) FILTER (b.clave IS NOT NULL)), []) AS b, coalesce(list_sort(list(DISTINCT r.clave) FILTER (r.clave IS NOT NULL)), []) AS r FROM clave_oro i LEFT JOIN a ON a.k = i.id LEFT JOIN b ON b.k = i.id LEFT JOIN r ON r.k = i.id GROUP BY 1)"
_COUNTS = ", cuentas AS (SELECT id, len(b) AS n_ref, len(a) AS n_citadas, len(list_intersect(a, b)) AS aciertos, len(list_intersect(list_intersect(a, b), r)) AS respaldados, len(list_filter(a, lambda x: list_contains(b, x) AND NOT list_contains(r, x))) AS no_respaldados, len(list_filter(a, lambda x: NOT list_contains(b, x) AND list_contains(r, x))) AS incorrectas, len(list_filter(a, lambda x: NOT list_contains(b, x) AND NOT list_contains(r, x))) AS sin_respaldo FROM {})"


def _gold(s: SparkSession, d: str) -> DataFrame:
    """(id, answer, basis, backed): bodies of the expected answer, of the basis, and of the question as the text shown."""
    k = read(s, d, "clave_oro")
    out = k.select("id")
    for column, name in (("respuesta_esperada", "answer"), ("legal_basis", "basis"), ("pregunta", "backed")):
        out = out.join(C.body_sets(k, "id", column, name), "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", *[F.coalesce(c, none).alias(c) for c in ("answer", "basis", "backed")])


@query(_GOLD + _SETS + _COUNTS.format("conj") + " SELECT *, round(CASE WHEN n_ref > 0 THEN aciertos / n_ref::DOUBLE END, 6) AS recall, round(CASE WHEN n_citadas > 0 THEN aciertos / n_citadas::DOUBLE END, 6) AS precision FROM cuentas")
def q59_citation_score(s: SparkSession, d: str) -> DataFrame:
    """Citations of each expected answer against those of its basis, backed by the question's text."""
    return _gold(s, d).select("id", C.score(F.col("answer"), F.col("basis"), F.col("backed")).alias("s")).select("id", "s.*")


@query(
    _GOLD + _SETS + ", con AS (SELECT id, CASE WHEN id % 9 = 0 OR id % 13 = 0 THEN [] ELSE a END AS a, b, r FROM conj WHERE len(b) > 0)" + _COUNTS.format("con") + """,
  s AS (SELECT count(*) AS items, sum(n_ref)::BIGINT AS n_ref, sum(n_citadas)::BIGINT AS n_citadas, sum(aciertos)::BIGINT AS aciertos, sum(respaldados)::BIGINT AS respaldados, sum(no_respaldados)::BIGINT AS no_respaldados, sum(incorrectas)::BIGINT AS incorrectas, sum(sin_respaldo)::BIGINT AS sin_respaldo FROM cuentas),
  z AS (SELECT *, coalesce((respaldados + 0.5 * no_respaldados) / nullif(n_ref, 0)::DOUBLE, 0) AS rec, coalesce(sin_respaldo / nullif(n_citadas, 0)::DOUBLE, 0) AS tasa FROM s)
SELECT items, n_ref, n_citadas, aciertos, respaldados, no_respaldados, incorrectas, sin_respaldo, round(rec, 4)::DOUBLE AS recall_ponderado, round(tasa, 4)::DOUBLE AS tasa_sin_respaldo, round(greatest(0, rec - 2 * tasa), 4)::DOUBLE AS indice, round(20 * greatest(0, rec - 2 * tasa), 2)::DOUBLE AS puntos FROM z"""
)
def q65_citation_index(s: SparkSession, d: str) -> DataFrame:
    """The citation index of the expected answers as a submission in which some items abstain or are missing."""
    return C.index(_gold(s, d).withColumn("abstains", (F.col("id") % 9 == 0) | (F.col("id") % 13 == 0)))


@query(_GOLD + ", c AS (SELECT i.id, list_sort(list(DISTINCT b.clave) FILTER (b.clave IS NOT NULL)) AS b, list_sort(list(DISTINCT a.clave) FILTER (a.clave IS NOT NULL)) AS a FROM clave_oro i LEFT JOIN a ON a.k = i.id LEFT JOIN b ON b.k = i.id GROUP BY 1) SELECT id, b IS NOT NULL AS con_referencia, coalesce(len(list_filter(b, lambda x: list_contains(coalesce(a, []), x))) > 0, false) AS acierta FROM c")
def q66_open_correct(s: SparkSession, d: str) -> DataFrame:
    """Whether an open answer counts as right for the abstention rule: it names a norm of its basis."""
    return _gold(s, d).select("id", (F.size("basis") > 0).alias("con_referencia"), F.arrays_overlap("answer", "basis").alias("acierta"))


# ---- citation graph ----------------------------------------------------------------------------------------------------

_RAW = r"regexp_replace(text, '[\x{a0}\x{2007}\x{202f}]', ' ', 'g')"
_BILL = rf"(?i)(?:proyecto\s{{1,9}}de\s{{0,9}}{C.GRAPH_NORM.removeprefix('(?i)')})|(?:{C.GRAPH_NORM.removeprefix('(?i)')}{C.BILL_AFTER})"
_N, _CC, _CD, _CS = C.GRAPH_NORM, C.GRAPH_CC, C.GRAPH_CC_DASH, C.GRAPH_CSJ
_YEAR = "CASE WHEN y > 100 THEN y WHEN y >= 91 THEN 1900 + y ELSE 2000 + y END"
_REFS = rf"""WITH t AS (SELECT doc_id, {_RAW} AS f, regexp_replace({_RAW}, '{_BILL}', ' ', 'g') AS g FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, lower(regexp_extract(x, '{_N}', 1)) AS k, replace(regexp_extract(x, '{_N}', 2), '.', '')::BIGINT AS n, regexp_extract(x, '{_N}', 3)::INT AS y FROM (SELECT doc_id, unnest(regexp_extract_all(g, '{_N}')) AS x FROM t)),
j AS ({" UNION ALL ".join(f"SELECT doc_id, lower(regexp_extract(x, '{p}', 1)) AS k, regexp_extract(x, '{p}', 2)::INT AS n, regexp_extract(x, '{p}', 3)::INT AS y FROM (SELECT doc_id, unnest(regexp_extract_all(f, '{p}')) AS x FROM t)" for p in (_CC, _CD))}),
s AS (SELECT doc_id, lower(regexp_extract(x, '{_CS}', 1)) AS k, regexp_extract(x, '{_CS}', 2)::INT AS n, regexp_extract(x, '{_CS}', 3)::INT AS y FROM (SELECT doc_id, unnest(regexp_extract_all(f, '{_CS}')) AS x FROM t)),
r AS (SELECT doc_id, CASE WHEN k LIKE 'acto%' THEN 'acto_legislativo' WHEN k LIKE 'decreto%' THEN 'decreto' ELSE 'ley' END || '_' || n || '_' || y AS clave FROM n WHERE y BETWEEN 1821 AND 2026 AND n > 0
  UNION ALL SELECT doc_id, 'sentencia_cc_' || k || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END || '_' || {_YEAR} FROM j WHERE {_YEAR} BETWEEN 1992 AND 2026 AND n > 0
  UNION ALL SELECT doc_id, 'sentencia_csj_' || k || n || '_' || y FROM s WHERE y BETWEEN 1990 AND 2026)
"""


def _references(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(C.references(F.col("text"))).alias("clave"))


@query(_REFS + "SELECT clave, count(DISTINCT doc_id) AS documentos, count(*) AS menciones FROM r GROUP BY 1")
def q60_graph_degree(s: SparkSession, d: str) -> DataFrame:
    """How many documents refer to a norm or judgment, and how often."""
    return C.graph(_references(s, d), "doc_id", "clave").select("clave", "documentos", "menciones")


@query(_REFS + "SELECT clave, count(DISTINCT doc_id) AS documentos FROM r WHERE clave NOT IN (SELECT regexp_replace(doc_id, '^co_', '') FROM manifiesto) GROUP BY 1 HAVING count(DISTINCT doc_id) >= CASE WHEN starts_with(clave, 'sentencia') THEN 3 ELSE 2 END")
def q61_graph_open(s: SparkSession, d: str) -> DataFrame:
    """References at or above the threshold of their kind that the manifest doesn't hold."""
    known = read(s, d, "manifiesto").select("doc_id")
    g = C.graph(_references(s, d), "doc_id", "clave", known)
    least = F.when(F.col("clave").startswith("sentencia"), 3).otherwise(2)
    return g.where(~F.col("en_corpus") & (F.col("documentos") >= least)).select("clave", "documentos")


@query(_REFS + "SELECT DISTINCT doc_id, clave FROM r WHERE clave IN (SELECT doc_id FROM manifiesto) AND starts_with(clave, 'sentencia')")
def q61_judgments_known(s: SparkSession, d: str) -> DataFrame:
    """References to judgments that the manifest holds under the same key."""
    return _references(s, d).where(F.col("clave").startswith("sentencia")).distinct().join(read(s, d, "manifiesto").select(F.col("doc_id").alias("clave")), "clave", "left_semi").select("doc_id", "clave")


@query(
    _REFS + """, p AS (SELECT clave, doc_id, count(*) AS m FROM r GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY doc_id) AS i FROM p),
a AS (SELECT clave, area, sum(m) AS n FROM p JOIN documents USING (doc_id) WHERE area IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY n DESC, area) AS i FROM a),
c AS (SELECT clave, string_agg(area, ', ' ORDER BY i) AS areas FROM b WHERE i <= 4 GROUP BY 1)
SELECT e.clave, count(*) AS documentos, sum(m)::BIGINT AS menciones, count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE coalesce(tipo, '') NOT IN ('sentencia', 'auto'))) AS primarias, string_agg(doc_id::VARCHAR, ', ' ORDER BY i) FILTER (i <= 5) AS primeros, any_value(areas) AS areas, bool_or(e.clave IN (SELECT regexp_replace(doc_id, '^co_', '') FROM manifiesto)) AS en_corpus FROM e LEFT JOIN c USING (clave) GROUP BY 1"""
)
def q95_citation_top_norms(s: SparkSession, d: str) -> DataFrame:
    """Each norm's node of the citation graph: citing documents, mentions, primary sources, areas and first citers."""
    docs = read(s, d, "documents")
    areas = docs.where("area IS NOT NULL").select("doc_id", "area")
    primary = docs.where(~F.coalesce(F.col("tipo"), F.lit("")).isin("sentencia", "auto")).select("doc_id")
    return C.graph(_references(s, d), "doc_id", "clave", read(s, d, "manifiesto").select("doc_id"), areas, primary)


@query(_REFS + ", g AS (SELECT clave, count(DISTINCT doc_id) AS documentos, count(*) AS menciones FROM r GROUP BY 1) SELECT clave, CASE WHEN starts_with(clave, 'sentencia_cc') THEN 'Sentencia ' || upper(regexp_extract(clave, '_cc_([a-z]+)', 1)) || '-' || regexp_extract(clave, '_cc_[a-z]+(\\d+)', 1) || ' de ' || right(clave, 4) WHEN starts_with(clave, 'sentencia_csj') THEN 'Sentencia ' || upper(regexp_extract(clave, '_csj_([a-z]+)', 1)) || regexp_extract(clave, '_csj_[a-z]+(\\d+)', 1) || '-' || right(clave, 4) ELSE CASE WHEN clave LIKE 'ley%' THEN 'Ley ' WHEN clave LIKE 'dec%' THEN 'Decreto ' ELSE 'Acto legislativo ' END || split_part(clave, '_', -2) || ' de ' || right(clave, 4) END AS norma, row_number() OVER (ORDER BY documentos DESC, menciones DESC, clave) AS puesto FROM g ORDER BY puesto LIMIT 40")
def q60_graph_sort(s: SparkSession, d: str) -> DataFrame:
    """The forty most cited norms by name: by documents, then mentions, then key."""
    top = C.graph(_references(s, d), "doc_id", "clave").orderBy(F.desc("documentos"), F.desc("menciones"), "clave").limit(40)
    return top.select("clave", C.reference_name(F.col("clave")).alias("norma"), F.row_number().over(Window.orderBy(F.desc("documentos"), F.desc("menciones"), "clave")).cast("bigint").alias("puesto"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS de, l_partkey % 100 + 1 AS a FROM lineitem WHERE l_quantity = 50), r AS (SELECT 5::BIGINT AS nodo UNION SELECT e.a FROM r JOIN e ON e.de = r.nodo) SELECT nodo FROM r")
def q62_graph_closure(s: SparkSession, d: str) -> DataFrame:
    """Nodes reachable in a graph with cycles."""
    edges = read(s, d, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("de"), (F.col("l_partkey") % 100 + 1).alias("a")).distinct()
    return C.closure(edges, s.range(1).select(F.lit(5).cast("bigint").alias("nodo")))


@query("WITH RECURSIVE" + _REFS.removeprefix("WITH") + ", e AS (SELECT DISTINCT d.norma_id AS de, r.clave AS a FROM r JOIN documents d USING (doc_id) WHERE d.norma_id IS NOT NULL), z AS (SELECT 'decreto_4999_2015' AS nodo UNION SELECT e.a FROM z JOIN e ON e.de = z.nodo) SELECT nodo FROM z")
def q62_citation_closure(s: SparkSession, d: str) -> DataFrame:
    """All norms that one norm's texts refer to, directly or through the texts of those."""
    norms = read(s, d, "documents").where("norma_id IS NOT NULL").select("doc_id", F.col("norma_id").alias("de"))
    edges = _references(s, d).join(norms, "doc_id").select("de", F.col("clave").alias("a")).distinct()
    return C.closure(edges, s.range(1).select(F.lit("decreto_4999_2015").alias("nodo")))


# ---- identities, backing, names, audits ---------------------------------------------------------------------------------

_UNIQUE = "(SELECT DISTINCT doc_id, tipo, numero, anio, titulo FROM manifiesto)"
_IDENT = f"SELECT doc_id || chr(9) || coalesce(titulo, '') AS k, {_PLAIN.format('replace(tipo, chr(95), chr(32)) || chr(32) || numero || CASE WHEN tipo IN (' + repr('sentencia') + ', ' + repr('auto') + ') THEN chr(32) ELSE chr(32) END || ' + repr('de ') + ' || anio')} AS f FROM {_UNIQUE}"


def _documents(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "manifiesto").select("doc_id", "tipo", "numero", "anio", "titulo").distinct()


@query(
    "WITH " + _bodies_sql("c", f"SELECT doc_id AS k, {_PLAIN.format('CASE WHEN tipo IN (' + chr(39) + 'sentencia' + chr(39) + ',' + chr(39) + 'auto' + chr(39) + ') THEN ' + chr(39) + 'Sentencia ' + chr(39) + ' || coalesce(numero, ' + chr(39) + 'None' + chr(39) + ') || ' + chr(39) + ' de ' + chr(39) + ' || coalesce(anio::VARCHAR, ' + chr(39) + 'None' + chr(39) + ') WHEN tipo IN (' + ', '.join(repr(x) for x in ('ley', 'decreto', 'acto_legislativo', 'resolucion', 'circular', 'acuerdo')) + ') THEN replace(tipo, chr(95), chr(32)) || chr(32) || coalesce(numero, ' + chr(39) + 'None' + chr(39) + ') || ' + chr(39) + ' de ' + chr(39) + ' || coalesce(anio::VARCHAR, ' + chr(39) + 'None' + chr(39) + ') ELSE titulo END')} AS f FROM {_UNIQUE}")
    + " SELECT DISTINCT k AS doc_id, clave FROM c"
)
def q96_document_identity(s: SparkSession, d: str) -> DataFrame:
    """The bodies by which each document of the manifest is known."""
    return C.identities(_documents(s, d)).select("doc_id", C.body_key().alias("clave")).distinct()


_PASSAGES = "SELECT id, texto, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS r, doc_id FROM chunks WHERE texto IS NOT NULL AND doc_id <> 'decreto_4999_2015'"


@query("WITH " + _bodies_sql("c", f"SELECT doc_id AS k, {_PLAIN.format('texto')} AS f FROM ({_PASSAGES}) WHERE r <= 10") + " SELECT DISTINCT k AS doc_id, clave FROM c")
def q97_backing_set(s: SparkSession, d: str) -> DataFrame:
    """The bodies that the first ten passages of each document cite."""
    rows = read(s, d, "chunks").where("texto IS NOT NULL AND doc_id <> 'decreto_4999_2015'")
    ranked = rows.select("doc_id", "texto", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")).alias("r"))
    return C.backing(ranked, "doc_id", "r", "texto").distinct()


@query(_GOLD + f", i AS (SELECT DISTINCT regexp_replace(clave, '^', '') AS clave FROM c_i) SELECT b.k AS id, b.clave, CASE WHEN i.clave IS NOT NULL THEN 'debil' ELSE 'ausente' END AS estado FROM b LEFT JOIN i USING (clave)".replace("c_i", "(SELECT CASE WHEN tipo IN ('sentencia', 'auto') THEN NULL ELSE tipo || '|' || numero || '|' || anio END AS clave FROM manifiesto WHERE tipo IN ('ley', 'decreto', 'resolucion', 'circular', 'acuerdo'))"))
def q98_citation_three_state(s: SparkSession, d: str) -> DataFrame:
    """Each basis's bodies: weak if the inventory of norms holds them, missing otherwise, the inventory being complete."""
    own = C.identities(_documents(s, d).where(F.col("tipo").isin("ley", "decreto", "resolucion", "circular", "acuerdo"))).select(C.body_key().alias("clave"))
    cites = C.bodies(read(s, d, "clave_oro"), "id", "legal_basis")
    return C.three_state(cites, own, True).select("id", "clave", "estado")


_COVER = """, ident AS (SELECT DISTINCT tipo || '|' || numero || '|' || anio AS clave, doc_id FROM manifiesto WHERE tipo IN ('ley', 'decreto', 'resolucion', 'circular', 'acuerdo')),
arts AS (SELECT DISTINCT regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g') AS doc_id, regexp_extract(lower(articulo), '^\\s*(\\d+(?:\\.\\d+)*[a-z]?)', 1) AS articulo FROM chunks WHERE articulo IS NOT NULL)"""


@query(
    "WITH x AS (SELECT id, " + _PLAIN.format("legal_basis") + r" AS f FROM clave_oro WHERE legal_basis IS NOT NULL), y AS (SELECT id, regexp_extract(f, 'articulo (\d+[a-z]?) (?:de la|del|de) (ley|decreto|resolucion|circular|acuerdo) (\d+) de (\d{4})', 1) AS articulo, regexp_extract(f, 'articulo (\d+[a-z]?) (?:de la|del|de) (ley|decreto|resolucion|circular|acuerdo) (\d+) de (\d{4})', 2) || '|' || regexp_extract(f, 'articulo (\d+[a-z]?) (?:de la|del|de) (ley|decreto|resolucion|circular|acuerdo) (\d+) de (\d{4})', 3) || '|' || regexp_extract(f, 'articulo (\d+[a-z]?) (?:de la|del|de) (ley|decreto|resolucion|circular|acuerdo) (\d+) de (\d{4})', 4) AS clave FROM x), z AS (SELECT * FROM y WHERE articulo <> '')"
    + _COVER + " SELECT z.id, z.clave, z.articulo, CASE WHEN NOT EXISTS (SELECT 1 FROM ident i WHERE i.clave = z.clave) THEN 'norma_ausente' WHEN NOT EXISTS (SELECT 1 FROM ident i JOIN arts a ON a.doc_id = i.doc_id WHERE i.clave = z.clave AND a.articulo = z.articulo) THEN 'articulo_ausente' ELSE 'presente' END AS estado FROM z"
)
def q99_coverage_audit(s: SparkSession, d: str) -> DataFrame:
    """Each cited article of a basis: present, article missing or norm missing in the corpus."""
    one = ("ley", "decreto", "resolucion", "circular", "acuerdo")
    plain = r"articulo \d+[a-z]? (?:de la|del|de) (?:ley|decreto|resolucion|circular|acuerdo) \d+ de \d{4}"
    k = read(s, d, "clave_oro").where(T.fold(F.col("legal_basis")).rlike(plain))
    cites = C.extracted(k, "id", "legal_basis").where(F.col("articulo").isNotNull() & F.col("cuerpo").isin(*one)).select("id", C.body_key().alias("clave"), "articulo")
    ident = C.identities(_documents(s, d).where(F.col("tipo").isin(*one))).select(C.body_key().alias("clave"), "doc_id").distinct()
    arts = read(s, d, "chunks").where("articulo IS NOT NULL").select(T.settle_id(F.col("doc_id")).alias("doc_id"), F.regexp_extract(F.lower("articulo"), r"^\s*(\d+(?:\.\d+)*[a-z]?)", 1).alias("articulo")).distinct()
    there = ident.join(arts, "doc_id").select("clave", "articulo").distinct().withColumn("a", F.lit(True))
    norms = ident.select("clave").distinct().withColumn("n", F.lit(True))
    state = F.when(F.col("n").isNull(), "norma_ausente").when(F.col("a").isNull(), "articulo_ausente").otherwise("presente")
    return cites.join(norms, "clave", "left").join(there, ["clave", "articulo"], "left").select("id", "clave", "articulo", state.alias("estado"))


@query(
    r"WITH x AS (SELECT id, regexp_extract(lower(strip_accents(legal_basis)), 'articulo (\d+[a-z]?) ', 1) AS a, regexp_extract(lower(strip_accents(legal_basis)), '(?:ley|resolucion|circular|acuerdo|decreto) \d+ de \d{4}$') AS n FROM clave_oro WHERE regexp_full_match(lower(strip_accents(legal_basis)), 'articulo \d+[a-z]? (?:de la|del|de) (?:ley|resolucion|circular|acuerdo|decreto) \d+ de \d{4}')) "
    "SELECT id, CASE WHEN n LIKE 'resolucion%' THEN 'Resolución' ELSE upper(n[1]) || substr(split_part(n, ' ', 1), 2) END || ' ' || split_part(n, ' ', 2) || ' de ' || split_part(n, ' ', 4) || ', artículo ' || a AS frase FROM x"
)
def q100_citation_sentence(s: SparkSession, d: str) -> DataFrame:
    """The sentence that names each basis of one article."""
    k = read(s, d, "clave_oro").where(T.fold(F.col("legal_basis")).rlike(r"^articulo \d+[a-z]? (?:de la|del|de) (?:ley|resolucion|circular|acuerdo|decreto) \d+ de \d{4}$"))
    return C.sentences_of(C.extracted(k, "id", "legal_basis"), "id")


_ALIAS = r"""WITH n AS (SELECT DISTINCT doc_id, trim(regexp_replace(replace(lower(strip_accents(nombre)), '_', ' '), '[\s\p{Z}]+', ' ', 'g')) AS a FROM (
  SELECT doc_id, tipo || ' ' || coalesce(numero, '') || ' de ' || coalesce(anio::VARCHAR, '') AS nombre FROM manifiesto WHERE tipo IN ('ley', 'decreto') UNION ALL SELECT doc_id, titulo FROM manifiesto WHERE tipo IN ('ley', 'decreto') AND trim(titulo) <> '')),
c AS (SELECT doc_id, CASE WHEN regexp_full_match(a, '(decreto(?:[\s\-‐‑–—]+ley)?|ley)\s+(\d+)\s+de\s+(\d{4})') THEN CASE WHEN starts_with(a, 'decreto') THEN 'decreto' ELSE 'ley' END || ' ' || regexp_extract(a, '(\d+)\s+de', 1)::BIGINT || ' de ' || right(a, 4) ELSE a END AS alias FROM n)
"""


@query(_ALIAS + "SELECT alias, CASE WHEN count(DISTINCT doc_id) = 1 THEN min(doc_id) END AS doc_id FROM c WHERE alias <> '' GROUP BY 1")
def q101_catalogue(s: SparkSession, d: str) -> DataFrame:
    """The names under which norms are known; a name of two documents belongs to neither."""
    return C.catalogue(_documents(s, d))


@query(
    _ALIAS + r""", k AS (SELECT alias, CASE WHEN count(DISTINCT doc_id) = 1 THEN min(doc_id) END AS doc_id FROM c WHERE alias <> '' GROUP BY 1),
x AS (SELECT id, trim(regexp_replace(lower(strip_accents(legal_basis)), '\s+', ' ', 'g')) AS f, lower(strip_accents(pregunta)) AS p FROM clave_oro WHERE regexp_full_match(trim(regexp_replace(lower(strip_accents(legal_basis)), '\s+', ' ', 'g')), 'articulo \d+ (?:de la|del|de) (?:ley|decreto(?:-ley)?) \d+ de \d{4}')),
y AS (SELECT id, regexp_extract(f, 'articulo (\d+)', 1) AS articulo, regexp_extract(f, '(?:ley|decreto(?:-ley)?) \d+ de \d{4}') AS norma, p FROM x)
SELECT y.id, y.norma, k.doc_id, y.articulo, CASE WHEN k.doc_id IS NULL THEN NULL ELSE regexp_matches(regexp_replace(y.p, '\s+', ' ', 'g'), '(?:^|[^\p{L}\p{N}_])' || y.norma || '(?:$|[^\p{L}\p{N}_])') AND regexp_matches(regexp_replace(y.p, '\s+', ' ', 'g'), '\barticulo\s+' || y.articulo || '(?:$|[^\p{L}\p{N}_.]|\.[^\d]|\.$)') END AS respaldada FROM y LEFT JOIN k ON k.alias = CASE WHEN y.norma LIKE 'decreto%' THEN 'decreto' ELSE 'ley' END || ' ' || regexp_extract(y.norma, '(\d+) de', 1)::BIGINT || ' de ' || right(y.norma, 4)"""
)
def q102_citation_audit(s: SparkSession, d: str) -> DataFrame:
    """The bases that name one article of one law or decree, as answers audited against the question as their passage."""
    k = read(s, d, "clave_oro").where(T.fold(F.col("legal_basis")).rlike(r"^articulo \d+ (?:de la|del|de) (?:ley|decreto(?:-ley)?) \d+ de \d{4}$"))
    passage = F.array(F.struct(F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("articulo"), F.col("pregunta").alias("texto")))
    return C.audited(k.select("id", F.col("legal_basis").alias("texto"), passage.alias("pasajes")), C.catalogue(_documents(s, d)))


def _cleaned(s: SparkSession, d: str, keep: bool) -> DataFrame:
    import pandas as pd

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "texto": [C.cleaned(t, C.bodies_of(C.extract(p)), keep, G.sentences) for t, p in zip(f["t"], f["p"])]})

    answer = F.concat_ws(" ", "respuesta_esperada", F.concat(F.lit("Así lo ordena el "), F.col("legal_basis"), F.lit(".")))
    return read(s, d, "clave_oro").where("respuesta_esperada IS NOT NULL").select("id", answer.alias("t"), F.coalesce("pregunta", F.lit("")).alias("p")).mapInPandas(run, "id int, texto string")


@query()
def q103_cleaned_answers(s: SparkSession, d: str) -> DataFrame:
    """Expected answers with their basis added, without the sentences whose citations the question doesn't back."""
    return _cleaned(s, d, False)


@query()
def q104_generalised_answers(s: SparkSession, d: str) -> DataFrame:
    """The same with unbacked norms spoken of in general terms where that removes them."""
    return _cleaned(s, d, True)
