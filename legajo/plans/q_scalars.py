"""Queries of scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations as C
from ..sources.tables import read
from .registry import registry

QUERIES, SQL, query = registry()

_FOLD = r"trim(regexp_replace(translate(lower({}), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '\s+', ' ', 'g'))"


@query(r"SELECT doc_id, trim(regexp_replace(translate(lower(translate(titulo, '_', ' ')), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '\s+', ' ', 'g')) AS espaciado, regexp_replace(translate(lower(titulo), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '\s+', ' ', 'g') AS suelto, translate(lower(titulo), 'áéíóúü', 'aeiouu') AS vocales FROM manifiesto")
def s01_folds(s: SparkSession, d: str) -> DataFrame:
    """Titles folded by three rules."""
    t = F.col("titulo")
    return read(s, d, "manifiesto").select("doc_id", T.fold_spaced(t).alias("espaciado"), T.fold_loose(t).alias("suelto"), T.fold_vowels(t).alias("vocales"))


@query(r"SELECT doc_id, len(regexp_extract_all(strip_accents(lower(replace(regexp_replace(text, '\p{M}+', '', 'g'), 'İ', 'i'))), '[\p{L}\p{N}_]+'))::BIGINT AS palabras, len(list_distinct(regexp_extract_all(strip_accents(lower(replace(regexp_replace(text, '\p{M}+', '', 'g'), 'İ', 'i'))), '[\p{L}\p{N}_]+')))::BIGINT AS distintas FROM documents WHERE text IS NOT NULL")
def s02_folded_tokens(s: SparkSession, d: str) -> DataFrame:
    """Words without case and accents, and the distinct ones."""
    w = T.folded_tokens(F.translate("text", "İ", "i"))
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(w).cast("bigint").alias("palabras"), F.size(F.array_distinct(w)).cast("bigint").alias("distintas"))


@query("SELECT id, len(regexp_extract_all(texto, '(?i)p[aá]rr[aá]f[oó]|c[oó]d[ií]g[oó]\\s+c[ií]v[ií]l'))::BIGINT AS n FROM chunks WHERE texto IS NOT NULL")
def s03_accent_patterns(s: SparkSession, d: str) -> DataFrame:
    """How often names are written, with or without accents, in any case."""
    p = C.accent_pattern("parrafo") + "|" + C.accent_pattern("codigo civil").removeprefix("(?i)")
    return read(s, d, "chunks").where("texto IS NOT NULL").select("id", F.regexp_count("texto", F.lit(T.any_case(p))).cast("bigint").alias("n"))


_U = "['" + "','".join(T.UNITS) + "']"
_TN = "['" + "','".join(T.TENS) + "']"


@query(f"SELECT anio, rtrim(CASE WHEN anio >= 2000 THEN 'dos mil ' ELSE 'mil novecientos ' END || CASE WHEN anio % 100 = 0 THEN '' WHEN anio % 100 < 30 THEN {_U}[anio % 100] ELSE {_TN}[anio % 100 // 10 - 2] || CASE WHEN anio % 10 > 0 THEN ' y ' || {_U}[anio % 10] ELSE '' END END) AS letras FROM (SELECT DISTINCT anio FROM manifiesto WHERE anio BETWEEN 1900 AND 2099)")
def s04_year_in_words(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "manifiesto").where("anio BETWEEN 1900 AND 2099").select("anio").distinct().select("anio", T.year_in_words(F.col("anio")).alias("letras"))


@query("SELECT anio % 100 AS corto, CASE WHEN anio % 100 < 50 THEN 2000 ELSE 1900 END + anio % 100 AS citas, CASE WHEN anio % 100 >= 91 THEN 1900 ELSE 2000 END + anio % 100 AS grafo, CASE WHEN anio % 100 > 90 THEN 1900 ELSE 2000 END + anio % 100 AS portal FROM manifiesto WHERE anio IS NOT NULL GROUP BY anio % 100")
def s05_full_years(s: SparkSession, d: str) -> DataFrame:
    y = F.col("corto")
    return read(s, d, "manifiesto").where("anio IS NOT NULL").select((F.col("anio") % 100).alias("corto")).distinct().select("corto", *[T.full_year(y, r).alias(r) for r in ("citas", "grafo", "portal")])


_ORD = "CASE WHEN i <= 12 THEN ['primero','segundo','tercero','cuarto','quinto','sexto','séptimo','octavo','noveno','décimo','undécimo','duodécimo'][i] WHEN i < 20 THEN 'décimo' || ['primero','segundo','tercero','cuarto','quinto','sexto','séptimo','octavo','noveno'][i - 10] ELSE ['vigésimo','trigésimo','cuadragésimo','quincuagésimo','sexagésimo','septuagésimo','octogésimo','nonagésimo'][i // 10 - 1] || CASE WHEN i % 10 > 0 THEN ' ' || ['primero','segundo','tercero','cuarto','quinto','sexto','séptimo','octavo','noveno'][i % 10] ELSE '' END END"


@query(f"SELECT {_ORD} AS palabra, i::INT AS numero FROM range(1, 100) r(i)")
def s06_ordinals(s: SparkSession, d: str) -> DataFrame:
    """The ordinals up to ninety-nine, written and read again."""
    one = "primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo undécimo duodécimo".split()
    tens = "vigésimo trigésimo cuadragésimo quincuagésimo sexagésimo septuagésimo octogésimo nonagésimo".split()
    i = F.col("id").cast("int")
    at = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k)
    word = F.when(i <= 12, at(one, i - 1)).when(i < 20, F.concat(F.lit("décimo"), at(one, i - 11))).otherwise(F.concat(at(tens, (F.floor(i / 10) - 2).cast("int")), F.when(i % 10 > 0, F.concat(F.lit(" "), at(one, i % 10 - 1))).otherwise("")))
    return s.range(1, 100).select(word.alias("palabra")).select("palabra", T.ordinal_number(F.col("palabra")).alias("numero"))


@query(r"SELECT id, upper(regexp_replace(articulo, '[º°ª\s]+', '', 'g')) AS rotulo, nullif(CASE WHEN regexp_matches(x, '^\s*\d') THEN regexp_extract(x, '^\s*(\d+(?:\.\d+)*[a-z]?)', 1) ELSE regexp_replace(x, '^[ .\-]+|[ .\-]+$', '', 'g') END, '') AS clave FROM (SELECT id, articulo, regexp_replace(translate(lower(articulo), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '[º°ªo]($|[^\p{L}\p{N}_])', '\1', 'g') AS x FROM chunks WHERE articulo IS NOT NULL)")
def s07_article_labels(s: SparkSession, d: str) -> DataFrame:
    a = F.col("articulo")
    return read(s, d, "chunks").where("articulo IS NOT NULL").select("id", T.article_label(a).alias("rotulo"), T.article_key(a).alias("clave"))


@query("SELECT doc_id, CASE WHEN contains(trim(fuente), 'Gestor Normativo') THEN 'Departamento Administrativo de la Función Pública - Gestor Normativo' ELSE replace(coalesce(trim(fuente), ''), '—', '-') END AS fuente, trim(regexp_replace(strip_accents(lower(titulo)), '[^a-z0-9]+', '_', 'g'), '_') AS clave FROM manifiesto")
def s08_source_and_slug(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "manifiesto").select("doc_id", T.source_name(F.col("fuente")).alias("fuente"), T.slug(F.col("titulo")).alias("clave"))


@query(
    r"""SELECT DISTINCT doc_id, CASE WHEN regexp_matches(doc_id, '^(?:co_)?(ley|decreto|acto_legislativo)_\d+_\d{4}$') THEN regexp_extract(doc_id, '^(?:co_)?(ley|decreto|acto_legislativo)_', 1) WHEN regexp_matches(doc_id, '^sentencia_(cc_(c|t|su)\d+[a-z]?|csj_[a-z]*\d+|ce_.+|sic_\d+)_\d{4}$') THEN 'sentencia' WHEN regexp_matches(doc_id, '^auto_cc_a\d+_\d{4}$') THEN 'auto' WHEN regexp_matches(doc_id, '^decision_\d+_\d{4}$') THEN 'decision' ELSE 'documento' END AS tipo,
CASE WHEN regexp_matches(doc_id, '^(?:co_)?(ley|decreto|acto_legislativo)_\d+_\d{4}$') THEN regexp_extract(doc_id, '_(\d+)_\d{4}$', 1) WHEN regexp_matches(doc_id, '^sentencia_cc_(c|t|su)\d+_\d{4}$') THEN upper(regexp_extract(doc_id, '_cc_([a-z]+)', 1)) || '-' || lpad(regexp_extract(doc_id, '_cc_[a-z]+(\d+)', 1), greatest(3, length(regexp_extract(doc_id, '_cc_[a-z]+(\d+)', 1)))::INT, '0') WHEN regexp_matches(doc_id, '^auto_cc_a\d+_\d{4}$') THEN 'A-' || regexp_extract(doc_id, '_a(\d+)_', 1) END AS numero,
CASE WHEN regexp_matches(doc_id, '^(?:co_)?(ley|decreto|acto_legislativo)_\d+_\d{4}$|^sentencia_(cc_(c|t|su)\d+[a-z]?|csj_[a-z]*\d+|ce_.+|sic_\d+)_\d{4}$|^auto_cc_a\d+_\d{4}$|^decision_\d+_\d{4}$') THEN right(doc_id, 4)::INT END AS anio FROM manifiesto"""
)
def s09_id_metadata(s: SparkSession, d: str) -> DataFrame:
    """Kind, number and year read from document ids."""
    return read(s, d, "manifiesto").select("doc_id").distinct().select("doc_id", T.id_metadata(F.col("doc_id")).alias("m")).select("doc_id", "m.tipo", "m.numero", "m.anio")


@query("SELECT DISTINCT doc_id, true AS igual FROM manifiesto WHERE regexp_matches(doc_id, '^(ley|decreto)_\\d+_\\d{4}$|^sentencia_cc_(c|t|su)\\d+_\\d{4}$')")
def s10_built_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids built from what was read from them."""
    ids = read(s, d, "manifiesto").select("doc_id").distinct().where(F.col("doc_id").rlike(r"^(ley|decreto)_\d+_\d{4}$|^sentencia_cc_(c|t|su)\d+_\d{4}$")).select("doc_id", T.id_metadata(F.col("doc_id")).alias("m"))
    kind = F.when(F.col("m.tipo") == "sentencia", "jurisprudencia").otherwise(F.col("m.tipo"))
    return ids.select("doc_id", (T.built_id(kind, F.col("m.numero"), F.col("m.anio").cast("string")) == F.col("doc_id")).alias("igual"))


@query("SELECT tipo, count(*) AS n FROM (SELECT DISTINCT doc_id, CASE WHEN regexp_matches(doc_id, '^sentencia_(cc|csj|ce)_[a-z]+\\d') THEN regexp_extract(doc_id, '^(sentencia_(?:cc|csj|ce)_[a-z]+)\\d', 1) WHEN regexp_matches(doc_id, '^[a-z_]+?_\\d') THEN regexp_extract(doc_id, '^([a-z_]+?)_\\d', 1) ELSE doc_id END AS tipo FROM manifiesto) GROUP BY 1")
def s11_reference_kinds(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "manifiesto").select("doc_id").distinct().groupBy(T.reference_kind(F.col("doc_id")).alias("tipo")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN length(texto) > 200 THEN regexp_replace(left(texto, 200), '(?s) [^ ]*$', '') || ' […]' ELSE texto END AS corto FROM chunks WHERE texto IS NOT NULL")
def s12_shortened(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "chunks").where("texto IS NOT NULL").select("id", T.shortened(F.col("texto"), 200).alias("corto"))


@query("SELECT n_nationkey, 'Región & país «' || n_name || '» <' || n_regionkey || '>' AS texto FROM nation")
def s13_without_tags(s: SparkSession, d: str) -> DataFrame:
    """Markup with character references made from the nations, read again."""
    t = F.concat(F.lit("<p class='a'>Regi&oacute;n  &amp;&nbsp;pa&iacute;s «<b>"), F.col("n_name"), F.lit("</b>» &lt;"), F.col("n_regionkey").cast("string"), F.lit("&gt;<br></p>"))
    tight = F.regexp_replace(T.without_tags(t), r"« | »", "")
    return read(s, d, "nation").select("n_nationkey", F.regexp_replace(F.regexp_replace(T.without_tags(t), "« ", "«"), " »", "»").alias("texto")).where(tight.isNotNull())


_DATE = T.DATE.replace("\\", "\\")


@query(f"SELECT id, try_cast(regexp_extract(texto, '{_DATE}', 3) || '-' || lpad(list_position(['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'], replace(lower(regexp_extract(texto, '{_DATE}', 2)), 'setiembre', 'septiembre'))::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(texto, '{_DATE}', 1), 2, '0') AS DATE) AS fecha FROM chunks WHERE regexp_matches(texto, '{_DATE}')")
def s14_first_dates(s: SparkSession, d: str) -> DataFrame:
    """The first date in words of each chunk that has one; null if it doesn't exist."""
    return read(s, d, "chunks").where(F.col("texto").rlike(T.any_case(T.DATE))).select("id", T.first_date(F.col("texto")).alias("fecha"))


@query("SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS dia, count(*) AS n FROM events GROUP BY 1")
def s15_colombian_days(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").groupBy(T.colombian_date(F.col("ts")).alias("dia")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, sha256('{\"area\":' || coalesce('\"' || area || '\"', 'null') || ',\"id\":' || id || '}') AS huella FROM preguntas")
def s16_json_hash(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "preguntas").select("id", T.json_hash(("id", F.col("id")), ("area", F.col("area"))).alias("huella"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0)) || encode(text)) AS huella FROM documents WHERE text IS NOT NULL")
def s17_blob_hash(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.blob_hash(F.col("text")).alias("huella"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norma, round(1 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)), 6) AS prob FROM embeddings")
def s18_vector_scalars(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return read(s, d, "embeddings").select("vec_id", F.round(T.norm_l2(e), 6).alias("norma"), F.round(T.softmax_first(e[0].cast("double"), e[1].cast("double")), 6).alias("prob"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS par FROM lineitem WHERE l_linenumber = 1")
def s19_round_even(s: SparkSession, d: str) -> DataFrame:
    """Rounding to the nearest even number."""
    return read(s, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.bround("l_extendedprice", 0).alias("par"))


_CAUSE = rf"regexp_replace(regexp_replace(translate(lower(left(texto, 8000)), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '\s+', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_EPI = rf"""WITH a AS (SELECT id, {_CAUSE} AS h FROM chunks WHERE texto IS NOT NULL), b AS (SELECT id, CASE WHEN regexp_matches(h, '{T.EPIGRAPH_START}') THEN regexp_extract(h, '(?s)(?:{T.EPIGRAPH_START}).*$') ELSE h END AS h FROM a),
e AS (SELECT id, left(regexp_extract(h, '(?s)^(.*?)(?:{T.EPIGRAPH_END}|$)', 1), 1500) AS e FROM b) """


@query(_EPI + "SELECT id, CASE WHEN len(x) = 0 THEN 'administrativo' ELSE array_to_string(x, ', ') END AS areas FROM (SELECT id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(e, '{p}') THEN '{n}' END" for n, p in T.AREAS.items()) + "], lambda y: y IS NOT NULL) AS x FROM e)")
def q72_area_classifier(s: SparkSession, d: str) -> DataFrame:
    """The areas that each text's epigraph names."""
    return read(s, d, "chunks").where("texto IS NOT NULL").select("id", T.epigraph(F.col("texto")).alias("e")).select("id", F.array_join(T.areas_of(F.col("e")), ", ").alias("areas"))


_BODY = r"regexp_replace(translate(lower(texto), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '\s+', ' ', 'g')"
_HEADING = r"CASE WHEN regexp_matches(h, '\bpor (?:medio de )?(?:la|el) cual\b') THEN regexp_extract(h, '(?s)^(.*?)\bpor (?:medio de )?(?:la|el) cual\b', 1) ELSE left(h, 1500) END"


@query(
    rf"""WITH a AS (SELECT id, left({_BODY}, 6000) AS h, {_BODY} AS b FROM chunks WHERE texto IS NOT NULL),
c AS (SELECT id, {_HEADING} AS h, b, len(list_distinct(regexp_extract_all(b, '\barticulo\s+\d+'))) AS n, len(regexp_extract_all(b, '{T._ARTICLE_REPEALED}')) AS g FROM a)
SELECT id, CASE WHEN regexp_matches(h, '{T._REPEALED}') THEN 'derogada' WHEN regexp_matches(h, '{T._VOID}') THEN 'inexequible' WHEN n >= 3 AND g >= 0.9 * n THEN 'derogada' WHEN regexp_matches(b, '{T._NOTE}') THEN 'con_notas' ELSE 'sin_marca' END AS senal FROM c"""
)
def q71_validity_level(s: SparkSession, d: str) -> DataFrame:
    """What each text's marks say of its validity."""
    return read(s, d, "chunks").where("texto IS NOT NULL").select("id", T.validity(F.col("texto")).alias("senal"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'derogada' WHEN n_nationkey % 4 = 1 THEN 'inexequible' WHEN n_nationkey % 4 = 2 THEN 'con_notas' ELSE 'derogada' END AS senal, CASE WHEN n_nationkey % 4 = 2 THEN 'nucleo' ELSE 'complementario' END AS nivel FROM nation")
def q71_validity_marks(s: SparkSession, d: str) -> DataFrame:
    """Validity and level of norms made from the nations, one for each rule."""
    k = F.col("n_nationkey")
    t = (
        F.when(k % 4 == 0, "Ley 1 <Ley derogada por otra> por la cual se dictan normas").when(k % 4 == 1, "Decreto 2 <Decreto declarado INEXEQUIBLE> por el cual se ordena")
        .when(k % 4 == 2, "Ley 3 por la cual se ordena. Artículo 1. <Artículo modificado por la ley 4>").otherwise("Artículo 1 <Artículo derogado> Artículo 2 <Artículo derogado> Artículo 3 <Artículo derogado>")
    )
    rows = read(s, d, "nation").select("n_nationkey", T.validity(t).alias("senal"))
    return rows.select("n_nationkey", "senal", T.level(F.lit(None).cast("string"), F.col("senal"), F.lit(False), F.lit(True)).alias("nivel"))


@query("SELECT id, (len(regexp_extract_all(left(texto, 300), '[\\p{L}\\p{N}_]+')) - len(regexp_extract_all(left(texto, 100), '[\\p{L}\\p{N}_]+')))::BIGINT AS n FROM chunks WHERE texto IS NOT NULL")
def s20_words_between(s: SparkSession, d: str) -> DataFrame:
    """Words that begin between the hundredth and the three hundredth character."""
    return read(s, d, "chunks").where("texto IS NOT NULL").select("id", T.words_between(F.col("texto"), F.lit(100), F.lit(300)).alias("n"))


_T80 = r"translate(lower(regexp_replace(left(c.texto, 80000), '\s+', ' ', 'g')), 'áéíóúü', 'aeiouu')"


@query(
    rf"""WITH m AS (SELECT regexp_replace(lower(trim(doc_id)), '[\s\-_]+', '_', 'g') AS k, min(tipo) AS tipo, min(numero) AS numero, min(anio) AS anio FROM manifiesto GROUP BY 1),
j AS (SELECT c.id, m.tipo, m.anio, m.numero, regexp_extract(m.numero, '0*(\d+)', 1) AS n, lower(regexp_extract(m.numero, '^([A-Za-z]+)', 1)) AS s, {_T80} AS t FROM chunks c JOIN m ON m.k = regexp_replace(lower(trim(c.doc_id)), '[\s\-_]+', '_', 'g') WHERE c.texto IS NOT NULL)
SELECT id, CASE WHEN tipo IN ('ley', 'decreto', 'acto_legislativo') AND n <> '' AND anio IS NOT NULL THEN regexp_matches(t, '\b' || replace(tipo, '_', ' ') || '\b[^0-9]{{0,25}}0*' || n || ' del? (?:[0-9]+ de [a-z]+ de )?' || anio) WHEN tipo = 'constitucion' THEN contains(t, 'constitucion politica')
  WHEN tipo IN ('sentencia', 'auto') AND n <> '' AND s <> '' THEN regexp_matches(t, '\b' || s || '\s*[-.]?\s*0*' || n || '(?:$|[^\p{{L}}\p{{N}}_])') WHEN tipo IN ('sentencia', 'auto') AND n <> '' THEN contains(t, n) ELSE true END AS nombra FROM j"""
)
def s21_names_norm(s: SparkSession, d: str) -> DataFrame:
    """Whether each chunk names the norm or judgment that it is filed as."""
    m = read(s, d, "manifiesto").groupBy(T.settle_id(F.col("doc_id")).alias("k")).agg(*[F.min(c).alias(c) for c in ("tipo", "numero", "anio")])
    c = read(s, d, "chunks").where("texto IS NOT NULL").select("id", T.settle_id(F.col("doc_id")).alias("k"), "texto").join(m, "k")
    return c.select("id", T.names_norm(F.col("texto"), F.col("tipo"), F.col("numero"), F.col("anio")).alias("nombra"))
