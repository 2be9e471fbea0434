"""Text, segmentation, retrieval, citation, audit and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as S
from ..operators.near import near_pairs
from ..sources.shared import checkpointed
from ..sources.tables import read
from .registry import registry

QUERIES, SQL, query = registry()

_W = r"[\p{L}\p{N}_]+"
_FOLD = r"trim(regexp_replace(translate(lower({}), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_W}'))::BIGINT AS palabras, length(text)::BIGINT AS caracteres FROM documents WHERE text IS NOT NULL")
def q33_tokens_census(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).alias("palabras"), F.length("text").cast("bigint").alias("caracteres"))


@query(f"SELECT id, {_FOLD.format('pregunta')} AS plano FROM preguntas")
def q34_fold(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "preguntas").select("id", T.fold(F.col("pregunta")).alias("plano"))


@query("SELECT id, len(regexp_extract_all(texto, '" + T.GARBLED + "'))::BIGINT AS n FROM chunks WHERE regexp_matches(texto, '" + T.GARBLED + "')")
def q35_mojibake(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").where(F.col("texto").rlike(T.GARBLED)).select("id", T.garbled_count(F.col("texto")).alias("n"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)::DOUBLE, 6) AS letras FROM documents WHERE length(text) > 0")
def q36_alpha_ratio(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("length(text) > 0").select("doc_id", F.round(T.letter_ratio(F.col("text")), 6).alias("letras"))


@query(r"WITH x AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: t IN ('de','la','el','en','que','los','las','del','por','se','con','una','para','su'))) AS f, length(regexp_replace(text, '[^\p{Cyrillic}\p{Greek}\p{Han}]', '', 'g')) AS o FROM documents WHERE text IS NOT NULL) SELECT doc_id, n >= 500 AND o <= 0.01 * n AND f >= 0.25 * w AS legible FROM x")
def q37_legibility(s: SparkSession, d: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    function = F.size(F.filter(words, lambda t: t.isin(*"de la el en que los las del por se con una para su".split())))
    other = F.length(F.regexp_replace("text", r"[^\p{IsCyrillic}\p{IsGreek}\p{IsHan}]", ""))
    n = F.length("text")
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", ((n >= 500) & (other <= 0.01 * n) & (function >= 0.25 * F.size(words))).alias("legible"))


@query(r"SELECT id, len(list_filter(string_split(texto, chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}]+', '', 'g') <> ''))::BIGINT AS lineas FROM chunks WHERE texto IS NOT NULL")
def q38_lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").where("texto IS NOT NULL").select("id", T.full_lines(F.col("texto")).alias("lineas"))


@query(f"SELECT t, count(DISTINCT doc_id) AS docs, count(*) AS veces FROM (SELECT doc_id, unnest(regexp_extract_all(lower(replace(text, 'İ', 'I')), '{_W}')) AS t FROM documents) GROUP BY 1")
def q45_postings(s: SparkSession, d: str) -> DataFrame:
    return S.postings(read(s, d, "documents"), "doc_id", "text").groupBy("t").agg(F.count(F.lit(1)).alias("docs"), F.sum("f").alias("veces"))


_BM25 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_W}') AS w FROM documents),
est AS (SELECT count(*) AS n, greatest(1.0, avg(len(w))) AS media FROM w),
qt AS (SELECT DISTINCT id AS q, unnest(regexp_extract_all(lower(pregunta), '{_W}')) AS t FROM preguntas),
p AS (SELECT doc_id, len(w) AS largo, unnest(w) AS t FROM w), tf AS (SELECT doc_id, largo, t, count(*) AS f FROM p WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
pt AS (SELECT q, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * largo / media))), 6) AS puntaje FROM qt JOIN tf USING (t) JOIN df USING (t), est GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY puntaje DESC, doc_id) AS rango FROM pt)
"""


def _bm25(s: SparkSession, d: str, k: int) -> DataFrame:
    return S.bm25(read(s, d, "documents"), "doc_id", "text", read(s, d, "preguntas"), "id", "pregunta", k)


@query(_BM25 + "SELECT q, doc_id, rango FROM bm WHERE rango <= 3")
def q46_bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d, 3).select("q", "doc_id", F.col("rango").cast("bigint").alias("rango"))


_DOT = "SELECT a.vec_id AS q, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS puntaje, b.label, a.label AS etiqueta FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"
_DENSE = f"WITH p AS ({_DOT}), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY puntaje DESC, vec_id) AS rango FROM p) "


def _dense(s: SparkSession, d: str, k: int) -> DataFrame:
    v = read(s, d, "embeddings").select("vec_id", "embedding")
    return S.dense_top(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), k)


@query(_DENSE + "SELECT q, vec_id, rango FROM r WHERE rango <= 10")
def q48_dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d, 10).select("q", "vec_id", F.col("rango").cast("bigint").alias("rango"))


@query()
def q49_neighbor_recall(s: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten neighbours that the inverted-file index finds; every row is indexed."""
    v = read(s, d, "embeddings").select("vec_id", "embedding")
    queries = v.where("vec_id % 50 = 0")
    return S.neighbour_overlap(_dense(s, d, 10), S.ivf_top(v, "vec_id", "embedding", queries, 10, 16, 10), "vec_id")


@query(f"WITH p AS ({_DOT}), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY puntaje DESC, vec_id) AS rango FROM p WHERE label = etiqueta) SELECT q, vec_id, rango FROM r WHERE rango <= 5")
def q50_category_filtered(s: SparkSession, d: str) -> DataFrame:
    """Exact search among the rows of the query's own label."""
    e = read(s, d, "embeddings").select("vec_id", "embedding", "label").where("label IS NOT NULL")
    return S.dense_top(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 5, "label").select("q", "vec_id", F.col("rango").cast("bigint").alias("rango"))


# A second, independent ranking of the documents: the vector of a document's number, asked with the vector of the question's.
_DENSE_DOCS = """, dd AS (SELECT a.vec_id AS q, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS puntaje FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT id FROM preguntas)),
de AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY puntaje DESC, doc_id) AS rango FROM dd)
"""


def _dense_docs(s: SparkSession, d: str, k: int) -> DataFrame:
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = v.join(read(s, d, "preguntas").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return S.dense_top(v, "doc_id", "embedding", asked, k).select(F.col("q").cast("int").alias("q"), "doc_id", "rango")


@query(_BM25 + _DENSE_DOCS + ", u AS (SELECT q, doc_id, rango FROM bm WHERE rango <= 10 UNION ALL SELECT q, doc_id, rango FROM de WHERE rango <= 10), f AS (SELECT q, doc_id, round(sum(1.0 / (60 + rango)), 9)::DOUBLE AS puntaje FROM u GROUP BY 1, 2) SELECT q::INT AS q, doc_id, rango FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY puntaje DESC, doc_id) AS rango FROM f) WHERE rango <= 5")
def q51_rrf(s: SparkSession, d: str) -> DataFrame:
    """The lexical and the dense ranking of each question fused by reciprocal ranks."""
    lists = [_bm25(s, d, 10), _dense_docs(s, d, 10)]
    return S.fuse(lists, "doc_id", 5).select("q", "doc_id", F.col("rango").cast("bigint").alias("rango"))


_PARENTS = """, l AS (SELECT 1 AS l, q, doc_id, rango FROM bm WHERE rango <= 20 UNION ALL SELECT 0, q, doc_id, rango FROM de WHERE rango <= 20), lp AS (SELECT l, q, norma_id, doc_id, rango FROM l JOIN documents USING (doc_id) WHERE norma_id IS NOT NULL),
p1 AS (SELECT * FROM lp QUALIFY row_number() OVER (PARTITION BY l, q, norma_id ORDER BY rango) = 1), p2 AS (SELECT *, row_number() OVER (PARTITION BY l, q ORDER BY rango) AS r FROM p1),
pf AS (SELECT q, norma_id, round(sum(1.0 / (60 + r)), 9)::DOUBLE AS puntaje, arg_min(doc_id, l) AS doc_id FROM p2 GROUP BY 1, 2),
pr AS (SELECT q, norma_id, doc_id, row_number() OVER (PARTITION BY q ORDER BY puntaje DESC, norma_id) AS rango FROM pf)
"""


def _parents(s: SparkSession, d: str, k: int) -> DataFrame:
    parents = read(s, d, "documents").select("doc_id", "norma_id").where("norma_id IS NOT NULL")
    return S.fuse_parents([_dense_docs(s, d, 20).join(parents, "doc_id"), _bm25(s, d, 20).select("q", "doc_id", "rango").join(parents, "doc_id")], "doc_id", "norma_id", k)


@query(_BM25 + _DENSE_DOCS + _PARENTS + "SELECT q::INT AS q, norma_id, doc_id, rango FROM pr WHERE rango <= 5")
def q52_rrf_parent(s: SparkSession, d: str) -> DataFrame:
    """Both rankings reduced to distinct norms before they are fused; a norm is shown by its best text of the dense list, else of the lexical one."""
    return _parents(s, d, 5).select("q", "norma_id", "doc_id", F.col("rango").cast("bigint").alias("rango"))


@query(_BM25 + ", s AS (SELECT q, doc_id, round((doc_id * 7919 + q) % 11, 0) AS p, rango FROM bm WHERE rango <= 10) SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY p DESC, rango) AS estable, row_number() OVER (PARTITION BY q ORDER BY p DESC, doc_id) AS por_id FROM s")
def q130_reranked(s: SparkSession, d: str) -> DataFrame:
    """The first ten of each question ordered anew by a given score with ties: by former rank, and by id."""
    base = _bm25(s, d, 10).select("q", "doc_id", "rango")
    score = (F.col("doc_id") * 7919 + F.col("q")) % 11
    stable = S.reranked(base, "doc_id", score, 10, True).select("q", "doc_id", F.col("rango").cast("bigint").alias("estable"))
    return stable.join(S.reranked(base, "doc_id", score, 10, False).select("q", "doc_id", F.col("rango").cast("bigint").alias("por_id")), ["q", "doc_id"])


_BM25_FOLDED = _BM25.replace("lower(coalesce(text, ''))", "strip_accents(lower(replace(regexp_replace(coalesce(text, ''), '\\p{M}+', '', 'g'), 'İ', 'i')))").replace("lower(pregunta)", "strip_accents(lower(regexp_replace(pregunta, '\\p{M}+', '', 'g')))")


@query(_BM25_FOLDED + "SELECT q, doc_id, rango FROM bm WHERE rango <= 3")
def q47_bm25_folded(s: SparkSession, d: str) -> DataFrame:
    """The three best documents for each question, accents disregarded."""
    docs = read(s, d, "documents").withColumn("text", F.translate("text", "İ", "i"))
    return S.bm25(docs, "doc_id", "text", read(s, d, "preguntas"), "id", "pregunta", 3, T.folded_tokens).select("q", "doc_id", F.col("rango").cast("bigint").alias("rango"))


@query("WITH RECURSIVE o AS (SELECT norma_id, doc_id, length(text)::BIGINT AS c, row_number() OVER (PARTITION BY norma_id ORDER BY doc_id) AS r FROM documents WHERE norma_id IS NOT NULL AND text IS NOT NULL), p AS (SELECT norma_id, r, CASE WHEN c <= 6000 THEN c ELSE 0 END AS usado, (c <= 6000)::INT AS n FROM o WHERE r = 1 UNION ALL SELECT o.norma_id, o.r, CASE WHEN usado + c <= 6000 THEN usado + c ELSE usado END, n + (usado + c <= 6000)::INT FROM p JOIN o ON o.norma_id = p.norma_id AND o.r = p.r + 1) SELECT norma_id, max(usado)::BIGINT AS usado, max(n)::BIGINT AS quedan FROM p GROUP BY 1")
def q54_pack_context_all(s: SparkSession, d: str) -> DataFrame:
    """All documents of each norm, in order, packed greedily into 6,000 characters."""
    docs = read(s, d, "documents").where("norma_id IS NOT NULL AND text IS NOT NULL").select("norma_id", "doc_id", F.length("text").cast("bigint").alias("c"))
    return S.pack_sorted(docs, "norma_id", "doc_id", "c", 6000)


@query("WITH c AS (SELECT doc_id, count(*) FILTER (texto IS NOT NULL AND regexp_replace(texto, '[\\s\\p{Z}]+', '', 'g') <> '') AS n FROM (SELECT regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g') AS doc_id, texto FROM chunks) GROUP BY 1), m AS (SELECT DISTINCT regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g') AS doc_id FROM manifiesto) SELECT m.doc_id, CASE WHEN n IS NULL THEN 'ausente' WHEN n = 0 THEN 'sin_texto' WHEN n < 5 THEN 'parcial' ELSE 'cubierto' END AS estado FROM m LEFT JOIN c USING (doc_id)")
def q63_coverage_states(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "chunks").groupBy(T.settle_id(F.col("doc_id")).alias("doc_id")).agg(F.count_if(~T.blank(F.col("texto"))).alias("n"))
    m = read(s, d, "manifiesto").select(T.settle_id(F.col("doc_id")).alias("doc_id")).distinct()
    state = F.when(F.col("n").isNull(), "ausente").when(F.col("n") == 0, "sin_texto").when(F.col("n") < 5, "parcial").otherwise("cubierto")
    return m.join(c, "doc_id", "left").select("doc_id", state.alias("estado"))


_SUB = "SELECT id, CASE id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS dada, id % 9 = 0 AS abstiene FROM preguntas WHERE id % 13 <> 0"


def _submission(s: SparkSession, d: str) -> DataFrame:
    """A submission made from the questions' ids: some abstain, some are missing."""
    return read(s, d, "preguntas").where("id % 13 <> 0").select("id", F.element_at(F.array(*map(F.lit, "ABCD")), F.col("id") % 4 + 1).alias("dada"), (F.col("id") % 9 == 0).alias("abstiene"))


@query(f"SELECT area, count(*) AS n, round(avg(CASE WHEN dada = respuesta_correcta AND NOT abstiene THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS exactitud FROM clave_oro LEFT JOIN ({_SUB}) USING (id) WHERE formato = 'multiple_choice' GROUP BY 1")
def q64_closed_accuracy(s: SparkSession, d: str) -> DataFrame:
    k = read(s, d, "clave_oro").where("formato = 'multiple_choice'").join(_submission(s, d), "id", "left")
    right = F.when((F.col("dada") == F.col("respuesta_correcta")) & ~F.col("abstiene"), 1.0).otherwise(0.0)
    return k.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("exactitud"))


@query(f"WITH x AS (SELECT coalesce(abstiene, true) AS ab, coalesce(dada = respuesta_correcta, false) AS ok FROM clave_oro LEFT JOIN ({_SUB}) USING (id) WHERE formato = 'multiple_choice') SELECT count(*) FILTER (NOT ab AND ok) AS tn, count(*) FILTER (ab AND NOT ok) AS tp, count(*) FILTER (ab AND ok) AS fp, count(*) FILTER (NOT ab AND NOT ok) AS fn, round(10 * (count(*) FILTER (NOT ab AND ok) + 0.5 * count(*) FILTER (ab)) / count(*), 6)::DOUBLE AS puntos FROM x")
def q66_abstention(s: SparkSession, d: str) -> DataFrame:
    k = read(s, d, "clave_oro").where("formato = 'multiple_choice'").join(_submission(s, d), "id", "left").select(F.coalesce("abstiene", F.lit(True)).alias("ab"), F.coalesce(F.col("dada") == F.col("respuesta_correcta"), F.lit(False)).alias("ok"))
    ab, ok = F.col("ab"), F.col("ok")
    return k.agg(F.count_if(~ab & ok).alias("tn"), F.count_if(ab & ~ok).alias("tp"), F.count_if(ab & ok).alias("fp"), F.count_if(~ab & ~ok).alias("fn"), F.round(10 * (F.count_if(~ab & ok) + 0.5 * F.count_if(ab)) / F.count(F.lit(1)), 6).alias("puntos"))


@query(_DENSE + "SELECT q, round(count(*) FILTER (label = etiqueta) / 10.0, 6)::DOUBLE AS recall10, round(max(CASE WHEN label = etiqueta THEN 1.0 / rango ELSE 0 END), 6)::DOUBLE AS mrr10, round(sum(CASE WHEN label = etiqueta THEN 1 / log2(rango + 1) ELSE 0 END) / sum(1 / log2(rango + 1)), 6)::DOUBLE AS ndcg10 FROM r WHERE rango <= 10 GROUP BY 1")
def q67_recall_mrr_ndcg(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "embeddings").select("vec_id", "label")
    r = _dense(s, d, 10).join(e, "vec_id").join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("etiqueta")), "q")
    hit, gain = F.col("label") == F.col("etiqueta"), 1 / F.log2(F.col("rango") + 1)
    return r.groupBy("q").agg(F.round(F.count_if(hit) / 10.0, 6).alias("recall10"), F.round(F.max(F.when(hit, 1.0 / F.col("rango")).otherwise(0.0)), 6).alias("mrr10"), F.round(F.sum(F.when(hit, gain).otherwise(0.0)) / F.sum(gain), 6).alias("ndcg10"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS media, round(median(value), 6) AS mediana, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS maximo, count(*) FILTER (value > 22) AS excedidos FROM events GROUP BY 1")
def q68_budget_summary(s: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("media"), F.round(F.median(v), 6).alias("mediana"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.max(v).alias("maximo"), F.count_if(v > 22).alias("excedidos"))


@query("SELECT coalesce(p.id, k.id) AS id, p.pregunta IS DISTINCT FROM k.pregunta AS pregunta_cambia, p.area IS DISTINCT FROM k.area AS area_cambia FROM preguntas p FULL JOIN clave_oro k ON p.id = k.id")
def q69_run_diff(s: SparkSession, d: str) -> DataFrame:
    p, k = read(s, d, "preguntas").alias("p"), read(s, d, "clave_oro").alias("k")
    return p.join(k, F.col("p.id") == F.col("k.id"), "full_outer").select(F.coalesce("p.id", "k.id").alias("id"), (~F.col("p.pregunta").eqNullSafe(F.col("k.pregunta"))).alias("pregunta_cambia"), (~F.col("p.area").eqNullSafe(F.col("k.area"))).alias("area_cambia"))


@query("SELECT id, formato, pregunta FROM preguntas WHERE length(trim(pregunta)) > 0")
def q73_question_projection(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "preguntas").where(F.length(F.trim("pregunta")) > 0).select("id", "formato", "pregunta")


@query("SELECT id, pregunta || chr(10) || coalesce(array_to_string(list_transform(list_sort(map_entries(opciones)), lambda e: e.key || '. ' || e.value), chr(10)), '') AS consulta, trim(pregunta, ' ' || chr(9) || chr(10) || chr(13)) || coalesce(chr(10) || nullif(array_to_string(list_transform(list_sort(map_entries(opciones)), lambda e: e.value), chr(10)), ''), '') AS sin_claves FROM preguntas WHERE pregunta IS NOT NULL")
def q74_options_query_text(s: SparkSession, d: str) -> DataFrame:
    """A question with its options: with their keys, and, stripped, without."""
    entries = F.array_sort(F.map_entries("opciones"))
    options = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")
    values = F.nullif(F.array_join(F.transform(entries, lambda e: e["value"]), "\n"), F.lit(""))
    stripped = F.regexp_replace("pregunta", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return read(s, d, "preguntas").where("pregunta IS NOT NULL").select("id", F.concat("pregunta", F.lit("\n"), F.coalesce(options, F.lit(""))).alias("consulta"), F.concat(stripped, F.coalesce(F.concat(F.lit("\n"), values), F.lit(""))).alias("sin_claves"))


@query("SELECT event_id, event_type FROM events WHERE props IS NOT NULL AND json_valid(props)")
def q75_json_fence_parse(s: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("respuesta:\n```json\n"), F.col("props"), F.lit("\n```"))
    got = F.try_parse_json(T.first_json_object(fenced))
    return read(s, d, "events").where("props IS NOT NULL").where(got.isNotNull()).select("event_id", "event_type")


_NEAR = f"""WITH w AS (SELECT min(doc_id) AS doc_id, w FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 5 GROUP BY w),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, (SELECT unnest(range(1, (SELECT max(len(w)) FROM w) + 1)) AS i) r WHERE i + 4 <= len(w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
"""


@query(
    _NEAR + """, j AS (SELECT a, b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS parecido FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.9 * (x.n + y.n - c)),
t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT a, b, parecido FROM j JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE length(x.t) BETWEEN 100 AND 30000 AND length(y.t) BETWEEN 100 AND 30000 AND least(length(x.t), length(y.t)) >= 0.9 * greatest(length(x.t), length(y.t)) AND (left(x.t, 80) = left(y.t, 80) OR right(x.t, 80) = right(y.t, 80))"""
)
def q76_near_dup_blocking(s: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts with a similarity of 0.9 that begin or end alike (80 characters) and have lengths within a tenth.

    The blocks are a condition on the pairs that the similarity join finds, so no block is too large to be looked at.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[\s\p{Z}]+", " "))
    pairs = near_pairs(read(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), n=F.length(plain), i=F.left(plain, F.lit(80)), f=F.right(plain, F.lit(80)))
    both = pairs.where("parecido >= 0.9 AND n_a BETWEEN 100 AND 30000 AND n_b BETWEEN 100 AND 30000")
    return both.where("least(n_a, n_b) >= 0.9 * greatest(n_a, n_b) AND (i_a = i_b OR f_a = f_b)").select("a", "b", "parecido")


@query(_NEAR + "SELECT a, b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS parecido FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)")
def q77_near_dup_jaccard(s: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts (each by its smallest id) with a Jaccard similarity of 0.8 or more; q77_near_dup_members links every document."""
    return near_pairs(read(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))


@query(
    _NEAR + f""", t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE text IS NOT NULL),
m AS (SELECT t.doc_id, w.doc_id AS clase, count(*) OVER (PARTITION BY w.doc_id) AS copias FROM t JOIN w ON t.w = w.w),
k AS (SELECT DISTINCT clase, copias FROM m),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
v AS (SELECT clase, sum(copias) AS otros FROM (SELECT a AS clase, b AS vecina FROM l UNION ALL SELECT b, a FROM l) e JOIN (SELECT clase AS vecina, copias FROM k) USING (vecina) GROUP BY 1)
SELECT doc_id, clase, copias, (copias - 1 + coalesce(otros, 0))::BIGINT AS enlaces FROM m LEFT JOIN v USING (clase)"""
)
def q77_near_dup_members(s: SparkSession, d: str) -> DataFrame:
    """Every document of five words or more: the class of its equal texts (their smallest id), the class's size, and its links.

    A link is another document, be it a copy or a near copy, with a similarity of 0.8 or more.  All joins are merge joins by
    hint: classes grow with the texts, and their size is estimated from the compressed files.
    """
    texts = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    words = texts.select("doc_id", T.tokens(F.col("text")).alias("w"))
    docs = checkpointed(words.select("doc_id", F.size("w").alias("n"), F.unhex(F.sha2(F.array_join("w", " "), 256)).alias("h"))).where("n >= 5").select("doc_id", "h")
    classes = docs.groupBy("h").agg(F.min("doc_id").alias("clase"), F.count(F.lit(1)).alias("copias"))
    pairs = near_pairs(texts).select("a", "b")
    edges = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("clase"), F.col("b").alias("vecina")), F.struct(F.col("b").alias("clase"), F.col("a").alias("vecina")))).alias("e")).select("e.*")
    near = edges.join(classes.select(F.col("clase").alias("vecina"), "copias").hint("merge"), "vecina").groupBy("clase").agg(F.sum("copias").alias("otros"))
    sized = classes.join(near.hint("merge"), "clase", "left").select("h", "clase", "copias", (F.col("copias") - 1 + F.coalesce("otros", F.lit(0))).alias("enlaces"))
    return docs.join(sized.hint("merge"), "h").select("doc_id", "clase", "copias", "enlaces")


@query("SELECT linea, count(*) AS n, count(DISTINCT id) AS fragmentos FROM (SELECT id, trim(unnest(string_split(texto, chr(10)))) AS linea FROM chunks) WHERE length(linea) BETWEEN 5 AND 140 GROUP BY 1 HAVING count(*) >= 3")
def q78_repeated_lines(s: SparkSession, d: str) -> DataFrame:
    lines = read(s, d, "chunks").select("id", F.explode(F.split("texto", "\n")).alias("l")).select("id", F.trim("l").alias("linea")).where("length(linea) BETWEEN 5 AND 140")
    per = lines.groupBy("linea", "id").agg(F.count(F.lit(1)).alias("m"))
    return per.groupBy("linea").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("fragmentos")).where("n >= 3")


@query("SELECT 'D' AS seccion, 'ALTO' AS severidad, id, comprobacion FROM (SELECT id, unnest(list_filter([CASE WHEN length(texto) < 100 THEN 'corto' END, CASE WHEN len(regexp_extract_all(texto, '" + T.GARBLED + "')) > 20 THEN 'ilegible' END, CASE WHEN fin - inicio <> length(texto) THEN 'desplazado' END, CASE WHEN texto IS NULL OR regexp_replace(texto, '[\\s\\p{Z}]+', '', 'g') = '' THEN 'vacio' END], lambda x: x IS NOT NULL)) AS comprobacion FROM chunks)")
def q56_quality_findings(s: SparkSession, d: str) -> DataFrame:
    t = F.col("texto")
    rules = F.array_compact(F.array(F.when(F.length(t) < 100, "corto"), F.when(T.garbled_count(t) > 20, "ilegible"), F.when(F.col("fin") - F.col("inicio") != F.length(t), "desplazado"), F.when(t.isNull() | T.blank(t), "vacio")))
    return read(s, d, "chunks").select(F.lit("D").alias("seccion"), F.lit("ALTO").alias("severidad"), "id", F.explode(rules).alias("comprobacion"))


@query("SELECT coalesce(severidad, '(sin dato)') AS severidad, comprobacion, count(*) AS n, count(DISTINCT nullif(doc_id, '')) AS documentos FROM hallazgos GROUP BY 1, 2")
def q57_findings_report(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "hallazgos").groupBy(F.coalesce("severidad", F.lit("(sin dato)")).alias("severidad"), "comprobacion").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.nullif(F.col("doc_id"), F.lit(""))).alias("documentos"))


@query("WITH a AS (SELECT m.doc_id, unnest(archivos_raw) AS f FROM manifiesto m) SELECT doc_id, f.archivo AS archivo, f.http_status BETWEEN 200 AND 299 AS bajado, f.encoding IS NULL AS sin_codificacion, f.texto_derivado IS NOT NULL AS derivado FROM a")
def q79_raw_files(s: SparkSession, d: str) -> DataFrame:
    f = F.col("f")
    return read(s, d, "manifiesto").select("doc_id", F.explode("archivos_raw").alias("f")).select("doc_id", f["archivo"].alias("archivo"), f["http_status"].between(200, 299).alias("bajado"), f["encoding"].isNull().alias("sin_codificacion"), f["texto_derivado"].isNotNull().alias("derivado"))


@query("SELECT doc_id, fecha_descarga, veces FROM (SELECT doc_id, max(fecha_descarga) AS fecha_descarga, count(*) AS veces FROM manifiesto GROUP BY 1)")
def q80_latest_download(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "manifiesto").groupBy("doc_id").agg(F.max("fecha_descarga").alias("fecha_descarga"), F.count(F.lit(1)).alias("veces"))


@query("SELECT coalesce(CASE WHEN texto IS NULL OR regexp_replace(texto, '[\\s\\p{Z}]+', '', 'g') = '' THEN 'sin_texto' WHEN regexp_matches(texto, '^[0-9[:punct:][:space:]]+$') THEN 'solo_numero_o_signos' WHEN avisos LIKE '%numeracion_discontinua%' THEN 'segmentacion_por_revisar' WHEN tipo IN ('ley', 'decreto') AND articulo IS NULL THEN 'norma_sin_articulo' END, 'admitido') AS motivo, count(*) AS n FROM chunks GROUP BY 1")
def q81_admission_filter(s: SparkSession, d: str) -> DataFrame:
    t = F.col("texto")
    reason = (
        F.when(t.isNull() | T.blank(t), "sin_texto").when(t.rlike(r"^[0-9\p{Punct}\s]+$"), "solo_numero_o_signos").when(F.col("avisos").contains("numeracion_discontinua"), "segmentacion_por_revisar")
        .when(F.col("tipo").isin("ley", "decreto") & F.col("articulo").isNull(), "norma_sin_articulo").otherwise("admitido")
    )
    return read(s, d, "chunks").groupBy(reason.alias("motivo")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, fuente FROM manifiesto WHERE doc_id IN (SELECT doc_id FROM manifiesto GROUP BY 1 HAVING count(DISTINCT fuente) > 1)")
def q82_source_conflicts(s: SparkSession, d: str) -> DataFrame:
    m = read(s, d, "manifiesto").select("doc_id", "fuente")
    return m.join(m.groupBy("doc_id").agg(F.count_distinct("fuente").alias("n")).where("n > 1").select("doc_id"), "doc_id", "left_semi")
