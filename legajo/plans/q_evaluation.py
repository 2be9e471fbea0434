"""Queries of evaluation: recall of references, backing, probes, versions, evidence, policies and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as C
from ..operators import evaluation as V
from ..operators import retrieval as S
from ..sources.tables import read
from . import q_citations as K
from .q_sets import QUERIES as SETS
from .q_sets import SQL as SETS_SQL
from .q_text import _BM25, _DENSE_DOCS, _bm25, _dense_docs
from .registry import registry

QUERIES, SQL, query = registry()

_IDENT = K.SQL["q96_document_identity"].removeprefix("WITH ").rsplit(" SELECT DISTINCT", 1)[0].replace("_c AS", "_i AS").replace("FROM t_c", "FROM t_i").replace("FROM n_c", "FROM n_i").replace("FROM m_c", "FROM m_i").replace("FROM l_c", "FROM l_i").replace("FROM j_c", "FROM j_i").replace("\nc AS", "\ni AS")
_BASIS = K._bodies_sql("b", K._source("clave_oro", "id", "legal_basis"))
_TEXTS = K._bodies_sql("x", K._source("documents", "doc_id", "text"))
_REF = ", ident AS (SELECT d.doc_id AS id, i.clave FROM documents d JOIN i ON i.k = d.norma_id), ref AS (SELECT DISTINCT k AS q, clave FROM b)"


def _reference(s: SparkSession, d: str) -> DataFrame:
    return C.bodies(read(s, d, "clave_oro"), "id", "legal_basis").select(F.col("id").alias("q"), "clave")


def _stands_for(s: SparkSession, d: str) -> DataFrame:
    """(id, clave): the bodies of the norm that each document belongs to."""
    own = C.identities(K._documents(s, d)).select(F.col("doc_id").alias("norma_id"), C.body_key().alias("clave")).distinct()
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), "norma_id").join(own, "norma_id").select("id", "clave")


def _lexical(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d, 10).select("q", F.col("doc_id").alias("id"), "rango")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return _dense_docs(s, d, 10).select("q", F.col("doc_id").alias("id"), "rango")


_RECALL = ", r AS (SELECT ref.q, ref.clave, min(z.rango) AS p FROM ref LEFT JOIN (SELECT bm.q, ident.clave, bm.rango FROM bm JOIN ident ON ident.id = bm.doc_id WHERE bm.rango <= 10) z ON z.q = ref.q AND z.clave = ref.clave GROUP BY 1, 2)"


@query(_BM25 + ", " + _IDENT + ", " + _BASIS + _REF + _RECALL + " SELECT q, count(*) AS referencias, " + ", ".join(f"round(count(*) FILTER (p <= {k}) / count(*)::DOUBLE, 6) AS recall_{k}" for k in (1, 5, 10)) + " FROM r GROUP BY 1")
def v01_norm_recall(s: SparkSession, d: str) -> DataFrame:
    """The share of each question's norms that its first 1, 5 and 10 texts belong to."""
    return V.reference_recall(_lexical(s, d), _stands_for(s, d), _reference(s, d))


_HITS = "SELECT ref.q, min(z.rango) AS puesto FROM (SELECT DISTINCT q FROM ref) ref LEFT JOIN (SELECT l.q, l.rango FROM {} l JOIN {} f ON f.{} = l.doc_id JOIN ref ON ref.q = l.q AND ref.clave = f.clave WHERE l.rango <= 10) z ON z.q = ref.q GROUP BY 1"


@query(_BM25 + ", " + _BASIS + ", " + _TEXTS + ", ref AS (SELECT DISTINCT k AS q, clave FROM b), h AS (" + _HITS.format("bm", "x", "k") + ") SELECT count(*) AS evaluables, round(count(puesto) / count(*)::DOUBLE, 6) AS respaldo, round(coalesce(sum(1.0 / puesto), 0) / count(*), 6)::DOUBLE AS mrr FROM h")
def v02_literal_backing(s: SparkSession, d: str) -> DataFrame:
    """How often one of the first ten texts cites a norm of the question's basis, and how early."""
    said = C.bodies(read(s, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "id")
    return V.backing_metrics(V.first_hits(_lexical(s, d), said, _reference(s, d)))


@query(
    _BM25 + _DENSE_DOCS + ", " + _IDENT + ", " + _BASIS + _REF + ", ha AS (" + _HITS.format("bm", "ident", "id") + "), hb AS (" + _HITS.format("de", "ident", "id") + ") SELECT q, ha.puesto IS NOT NULL AS antes, hb.puesto IS NOT NULL AS despues, CASE WHEN ha.puesto IS NOT NULL AND hb.puesto IS NOT NULL THEN 'igual_bien' WHEN ha.puesto IS NULL AND hb.puesto IS NULL THEN 'igual_mal' WHEN hb.puesto IS NOT NULL THEN 'arreglada' ELSE 'rota' END AS cambio FROM ha JOIN hb USING (q)"
)
def v03_versions(s: SparkSession, d: str) -> DataFrame:
    """How each question fared from the lexical to the dense ranking."""
    ref, own = _reference(s, d), _stands_for(s, d)
    ok = lambda r: V.first_hits(r, own, ref).select("q", F.col("puesto").isNotNull().alias("ok"))
    return V.compared(ok(_lexical(s, d)), ok(_vectors(s, d)), "q", "ok")


_PROBES = _BM25.replace("WITH w AS", "WITH sondas AS (" + SETS_SQL["t24_probes"] + "), w AS", 1).replace("SELECT DISTINCT id AS q, unnest(regexp_extract_all(lower(pregunta)", "SELECT DISTINCT doc_id AS q, unnest(regexp_extract_all(lower(sonda)").replace("AS t FROM preguntas)", "AS t FROM sondas)")


@query(_PROBES + ", r AS (SELECT s.doc_id, min(bm.rango) FILTER (bm.rango <= 10) AS p FROM sondas s LEFT JOIN bm ON bm.q = s.doc_id AND bm.doc_id = s.doc_id GROUP BY 1) SELECT count(*) AS sondas, round(count(*) FILTER (p <= 1) / count(*)::DOUBLE, 6) AS recall_1, round(count(*) FILTER (p <= 5) / count(*)::DOUBLE, 6) AS recall_5, round(count(*) FILTER (p <= 10) / count(*)::DOUBLE, 6) AS recall_10, round(coalesce(sum(1.0 / p), 0) / count(*), 6)::DOUBLE AS mrr_10 FROM r")
def v04_probe_metrics(s: SparkSession, d: str) -> DataFrame:
    """Whether literal probes find the text that they were cut from."""
    probes = SETS["t24_probes"](s, d).select(F.col("doc_id").alias("p"), "sonda")
    got = S.bm25(read(s, d, "documents"), "doc_id", "text", probes, "p", "sonda", 10)
    ranks = probes.select("p").join(got.where("q = doc_id").select(F.col("q").alias("p"), F.col("rango").alias("puesto")), "p", "left")
    return V.probe_metrics(ranks)


@query("SELECT round(sum(p), 2)::DOUBLE AS obtenidos, sum(m)::DOUBLE AS posibles FROM (SELECT round(count(*) / 10.0, 2) AS p, 10.0 AS m FROM region UNION ALL SELECT round(count(*) / 7.0, 2), 20.0 FROM nation)")
def v05_total(s: SparkSession, d: str) -> DataFrame:
    """The sum of components, one of which has no points."""
    one = lambda t, by, m: read(s, d, t).agg(F.round(F.count(F.lit(1)) / by, 2).alias("puntos")).withColumn("maximo", F.lit(m))
    none = s.range(1).select(F.lit(None).cast("double").alias("puntos"), F.lit(30.0).alias("maximo"))
    return V.total(one("region", 10.0, 10.0).unionByName(one("nation", 7.0, 20.0)).unionByName(none))


@query("SELECT id, coalesce(nullif(list_filter(map_keys(opciones), lambda x: x = ['A', 'B', 'C', 'Z'][id % 4 + 1])[1], ''), map_keys(opciones)[1]) AS respuesta, cardinality(opciones)::BIGINT - 1 AS descartes, len(list_filter(list_filter(map_keys(opciones), lambda x: x <> coalesce(nullif(list_filter(map_keys(opciones), lambda y: y = ['A', 'B', 'C', 'Z'][id % 4 + 1])[1], ''), map_keys(opciones)[1])), lambda x: x <> 'B')) AS sin_razon FROM preguntas WHERE opciones IS NOT NULL AND cardinality(opciones) > 0")
def v06_completed_answers(s: SparkSession, d: str) -> DataFrame:
    """Closed answers of which some name no option, completed with the reasons that they lack; option B has one."""
    q = read(s, d, "preguntas").where("opciones IS NOT NULL AND size(opciones) > 0")
    letter = F.element_at(F.array(*map(F.lit, "ABCZ")), F.col("id") % 4 + 1)
    c = q.select("id", "opciones", V.completed(F.map_keys("opciones"), letter, F.create_map(F.lit("B"), F.lit("porque no"))).alias("c"))
    return c.select("id", "c.respuesta", F.size("c.descarte").cast("bigint").alias("descartes"), F.size(F.filter(F.map_values("c.descarte"), lambda x: x == V.NO_REASON)).cast("bigint").alias("sin_razon"))


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AS sirve FROM nation")
def v07_compatible(s: SparkSession, d: str) -> DataFrame:
    """Whether a stored configuration may be used again."""
    k = F.col("n_nationkey")
    stored = F.create_map(F.lit("tamano"), F.when(k % 3 == 0, "320").otherwise("256"), F.lit("revision"), F.when(k % 2 == 0, "a").otherwise(F.lit(None)))
    return read(s, d, "nation").select("n_nationkey", V.compatible(stored, {"tamano": 320, "revision": "a"}).alias("sirve"))


@query("SELECT '| ' || severidad || ' | ' || replace(comprobacion, '|', '\\|') || ' | ' || n || ' |' AS linea FROM (SELECT coalesce(severidad, '') AS severidad, comprobacion, count(*) AS n FROM hallazgos GROUP BY 1, 2)")
def v08_markdown_report(s: SparkSession, d: str) -> DataFrame:
    """Counts of findings as lines of a Markdown table."""
    h = read(s, d, "hallazgos").groupBy(F.coalesce("severidad", F.lit("")).alias("severidad"), "comprobacion").agg(F.count(F.lit(1)).alias("n"))
    return h.select(V.markdown(["severidad", "comprobacion", "n"]).alias("linea"))


_FOLD = "strip_accents(lower(replace(regexp_replace(coalesce({}, ''), '\\p{{M}}+', '', 'g'), 'İ', 'i')))"
_GRAMS = "SELECT {k} AS k, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT {k}, list_filter(regexp_extract_all({f}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM {t})"


@query(
    "WITH d AS (" + _GRAMS.format(k="doc_id", f=_FOLD.format("text"), t="documents") + "), q AS (" + _GRAMS.format(k="id", f=_FOLD.format("pregunta"), t="(SELECT * FROM preguntas WHERE id % 50 = 0)") + """), n AS (SELECT count(*) AS n FROM d),
p AS (SELECT k, t, count(*) AS f FROM (SELECT k, unnest(g) AS t FROM d) GROUP BY 1, 2), i AS (SELECT t, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM p, n GROUP BY t, n),
w AS (SELECT k, t, f * idf AS w FROM p JOIN i USING (t)), l AS (SELECT k, sqrt(sum(w * w)) AS l FROM w GROUP BY 1), u AS (SELECT q, t, f * idf AS u FROM (SELECT k AS q, t, count(*) AS f FROM (SELECT k, unnest(g) AS t FROM q) GROUP BY 1, 2) JOIN i USING (t)), m AS (SELECT q, sqrt(sum(u * u)) AS m FROM u GROUP BY 1),
s AS (SELECT q, w.k, round(sum(w * u) / any_value(l.l * m.m), 6) AS puntaje FROM w JOIN u USING (t) JOIN l ON l.k = w.k JOIN m USING (q) GROUP BY 1, 2)
SELECT q, k AS doc_id, rango FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY puntaje DESC, k) AS rango FROM s) WHERE rango <= 5"""
)
def v09_tfidf_topk(s: SparkSession, d: str) -> DataFrame:
    """The five texts nearest to each fiftieth question by term weights over words and pairs."""
    words = T.folded_tokens(F.translate(F.coalesce("text", F.lit("")), "İ", "i"))
    asked = read(s, d, "preguntas").where("id % 50 = 0")
    got = V.tfidf_top(read(s, d, "documents"), "doc_id", words, asked, "id", T.folded_tokens(F.translate("pregunta", "İ", "i")), 5)
    return got.select("q", "doc_id", F.col("rango").cast("bigint").alias("rango"))


def _heads(s: SparkSession, d: str) -> DataFrame:
    first = read(s, d, "chunks").where("texto IS NOT NULL").groupBy(T.settle_id(F.col("doc_id")).alias("doc_id")).agg(F.min_by("texto_busqueda", F.struct("inicio", "id")).alias("texto"))
    one = read(s, d, "manifiesto").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("tipo", "numero", "anio", "titulo")])
    return V.headers(one.join(first, "doc_id", "left"))


@query()
def v10_document_headers(s: SparkSession, d: str) -> DataFrame:
    """How each document of the manifest names itself: in its first chunk, else by its title or names."""
    return _heads(s, d)


@query()
def v11_evidence(s: SparkSession, d: str) -> DataFrame:
    """The first five texts of each question, each after its norm's header if it doesn't name the norm."""
    docs = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("norma_id").alias("doc_id"), F.col("text").alias("texto"))
    passages = _lexical(s, d).withColumnRenamed("rango", "orden").join(docs, "id")
    own = C.identities(K._documents(s, d)).select("doc_id", C.body_key().alias("clave")).distinct()
    said = C.bodies(docs, "id", "texto")
    return V.evidence(passages, own, said, _heads(s, d).select("doc_id", "tipo_evidencia", "texto"))


@query("WITH o AS (SELECT norma_id, length(text)::BIGINT AS c, sum(length(text)) OVER (PARTITION BY norma_id ORDER BY doc_id)::BIGINT AS t FROM documents WHERE norma_id IS NOT NULL AND text IS NOT NULL) SELECT norma_id, count(*) AS quedan, sum(c)::BIGINT AS usado FROM o WHERE t <= 6000 GROUP BY 1")
def v12_pack_prefix(s: SparkSession, d: str) -> DataFrame:
    """What is left of each norm's texts when they are dropped from the end until 6,000 characters hold them."""
    from ..operators import ordered as O

    docs = read(s, d, "documents").where("norma_id IS NOT NULL AND text IS NOT NULL").select("norma_id", "doc_id", F.length("text").cast("bigint").alias("c"))
    run = O.running_sum(docs, "norma_id", ["doc_id"], F.col("c"), "antes").where(F.col("antes") + F.col("c") <= 6000)
    return run.groupBy("norma_id").agg(F.count(F.lit(1)).alias("quedan"), F.sum("c").alias("usado"))


_AUDIT = K.SQL["q99_coverage_audit"]


@query("SELECT count(*) AS citas, count(*) FILTER (estado = 'presente') AS presentes, count(*) FILTER (estado = 'articulo_ausente') AS sin_articulo, count(*) FILTER (estado = 'norma_ausente') AS sin_norma, count(DISTINCT id) FILTER (estado = 'presente') AS preguntas, round(count(*) FILTER (estado = 'presente') / nullif(count(*), 0)::DOUBLE, 6) AS razon FROM (" + _AUDIT + ")")
def v13_coverage_summary(s: SparkSession, d: str) -> DataFrame:
    """How many cited articles the corpus holds, and of how many questions."""
    a = K.QUERIES["q99_coverage_audit"](s, d)
    n = lambda v: F.count_if(F.col("estado") == v)
    return a.agg(F.count(F.lit(1)).alias("citas"), n("presente").alias("presentes"), n("articulo_ausente").alias("sin_articulo"), n("norma_ausente").alias("sin_norma"), F.count_distinct(F.when(F.col("estado") == "presente", F.col("id"))).alias("preguntas"), F.round(F.try_divide(n("presente").cast("double"), F.count(F.lit(1)).cast("double")), 6).alias("razon"))


@query("SELECT clave, count(*) AS n FROM (" + _AUDIT + ") WHERE estado <> 'presente' GROUP BY 1 ORDER BY n DESC, clave LIMIT 15")
def v14_top_uncovered(s: SparkSession, d: str) -> DataFrame:
    """The fifteen norms with most articles that the corpus lacks."""
    return K.QUERIES["q99_coverage_audit"](s, d).where("estado <> 'presente'").groupBy("clave").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "clave").limit(15)


@query("WITH " + _BASIS + ", " + _IDENT + ", t AS (SELECT b.clave, k.formato = 'multiple_choice' AS banco FROM b JOIN clave_oro k ON k.id = b.k), g AS (SELECT clave, count(*) FILTER (banco) AS peso, bool_or(banco) AS banco FROM t GROUP BY 1) SELECT clave, peso, CASE WHEN banco THEN 'banco' ELSE 'muestra' END AS origen FROM g WHERE clave NOT IN (SELECT clave FROM i)")
def v15_missing_targets(s: SparkSession, d: str) -> DataFrame:
    """Norms that bases cite and the manifest lacks: those of closed items with their number, then those of the others without weight."""
    cited = _reference(s, d).join(read(s, d, "clave_oro").select(F.col("id").alias("q"), (F.col("formato") == "multiple_choice").alias("banco")), "q")
    own = C.identities(K._documents(s, d)).select(C.body_key().alias("clave")).distinct()
    bank = cited.where("banco").groupBy("clave").agg(F.count(F.lit(1)).alias("peso")).withColumn("origen", F.lit("banco"))
    sample = cited.where("NOT banco").select("clave").distinct().join(bank, "clave", "left_anti").select("clave", F.lit(0).cast("bigint").alias("peso"), F.lit("muestra").alias("origen"))
    return bank.unionByName(sample).join(own, "clave", "left_anti")


@query("SELECT id FROM preguntas WHERE id % 3 <> 0")
def v16_pending(s: SparkSession, d: str) -> DataFrame:
    """Questions without a result under the same configuration; those of another configuration don't count."""
    from ..operators import answers as A

    q = read(s, d, "preguntas")
    mark = lambda c: T.json_hash(("pregunta", F.col("pregunta")), ("id", F.col("id")), ("config", F.lit(c)))
    done = q.where("id % 3 = 0").select(mark("a").alias("h")).unionAll(q.where("id % 3 = 1").select(mark("b").alias("h")))
    return A.pending(q.select("id", mark("a").alias("h")), done, "h").select("id")
