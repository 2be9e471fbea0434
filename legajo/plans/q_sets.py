"""Queries of joins, set operations, choices and aggregates over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from ..sources.tables import read
from .registry import registry

QUERIES, SQL, query = registry()

_FIELDS = ("doc_id", "titulo", "tipo", "numero", "anio", "organo_emisor", "vigencia", "fuente", "url", "areas", "temas")
_kind = lambda c: "lista" if c in ("areas", "temas") else "numero" if c == "anio" else "texto"


@query(" UNION ALL ".join(f"SELECT '{c}' AS campo, count(*) AS total, n AS nulos, v AS vacios, l AS listas_vacias, n + v + l AS faltan, round(100.0 * (n + v + l) / count(*), 4)::DOUBLE AS porcentaje FROM manifiesto, (SELECT count(*) FILTER ({c} IS NULL) AS n, {f'count(*) FILTER ({c} = {chr(39)}{chr(39)})' if _kind(c) == 'texto' else '0::BIGINT'} AS v, {f'count(*) FILTER (len({c}) = 0)' if _kind(c) == 'lista' else '0::BIGINT'} AS l FROM manifiesto) GROUP BY n, v, l" for c in _FIELDS))
def t01_missingness_census(s: SparkSession, d: str) -> DataFrame:
    """Missing values of eleven fields: nulls, empty strings and empty lists."""
    return R.censused(read(s, d, "manifiesto"), _FIELDS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, coalesce(nullif({c}::VARCHAR, ''), '(sin dato)') AS valor, count(*) AS n FROM manifiesto GROUP BY 2" for c in ("tipo", "numero", "anio", "organo_emisor", "fuente", "vigencia", "vigencia_fuente", "nivel", "redistribuir_raw", "edicion_con_anotaciones", "licencia_fuente")))
def t02_distributions(s: SparkSession, d: str) -> DataFrame:
    """Values of eleven variables in long form."""
    return R.value_counts(read(s, d, "manifiesto"), ("tipo", "numero", "anio", "organo_emisor", "fuente", "vigencia", "vigencia_fuente", "nivel", "redistribuir_raw", "edicion_con_anotaciones", "licencia_fuente"))


_MEASURES = {
    "docs": "count(*)", "chars": "sum(n_chars)", "sin_texto": "count_if(text IS NULL)", "sin_area": "count_if(area IS NULL)", "sin_anio": "count_if(anio IS NULL)", "sin_idioma": "count_if(lang IS NULL)", "cortos": "count_if(length(text) < 200)", "largos": "count_if(length(text) > 3000)",
    "desplazados": "count_if(n_chars <> length(text))", "normas": "count_if(tipo IN ('ley', 'decreto'))", "judiciales": "count_if(tipo IN ('sentencia', 'auto'))", "maximo": "max(length(text))", "minimo": "min(length(text))", "fuentes": "count(DISTINCT source)",
}


@query("SELECT tipo, area, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in _MEASURES.items()) + " FROM documents GROUP BY GROUPING SETS ((tipo), (area))")
def t03_rollup_measures(s: SparkSession, d: str) -> DataFrame:
    """Fourteen measures by kind and by area, in one pass over both groupings."""
    return read(s, d, "documents").groupingSets([["tipo"], ["area"]], "tipo", "area").agg(*[F.expr(e).cast("bigint").alias(n) for n, e in _MEASURES.items()])


@query("SELECT l_returnflag, l_linestatus, count(*) AS filas, sum(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END)::BIGINT AS hechos, count(*)::BIGINT AS total, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS auditables, CASE WHEN l_returnflag <> 'N' THEN round(sum(CASE WHEN l_quantity < 25 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) END AS razon FROM lineitem GROUP BY 1, 2")
def t04_resources(s: SparkSession, d: str) -> DataFrame:
    """Sums by composite key with a ratio that is null where a row couldn't be audited."""
    li = read(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") < 25, 1).otherwise(0).alias("h"), F.lit(1).alias("t"), F.when(F.col("l_returnflag") != "N", 1).alias("a"))
    return R.resources(li, ["l_returnflag", "l_linestatus"], "h", "t", "a")


_PARTS = "SELECT DISTINCT doc_id, 'https://a.example/' || doc_id AS url, CASE WHEN length(doc_id) % 3 > 0 THEN titulo END AS resumen, 0 AS p FROM manifiesto WHERE length(doc_id) % 2 = 0 UNION ALL SELECT DISTINCT doc_id, 'https://b.example/' || doc_id, min(titulo) OVER (PARTITION BY doc_id), 1 FROM manifiesto"


@query("WITH a AS (SELECT DISTINCT doc_id, 'https://a.example/' || doc_id AS url, NULL::VARCHAR AS resumen, 0 AS p FROM manifiesto WHERE length(doc_id) % 2 = 0), b AS (SELECT doc_id, 'https://b.example/' || doc_id AS url, min(titulo) AS resumen, 1 AS p FROM manifiesto GROUP BY 1) SELECT b.doc_id, coalesce(a.url, b.url) AS url, b.resumen, CASE WHEN a.url IS NULL THEN '' ELSE b.url END AS alternas FROM b LEFT JOIN a USING (doc_id)")
def t05_first_wins(s: SparkSession, d: str) -> DataFrame:
    """The same document from two sources: the first one's address, the other's as alternate, a null summary filled."""
    m = read(s, d, "manifiesto")
    first = m.where("length(doc_id) % 2 = 0").select("doc_id").distinct().select("doc_id", F.concat(F.lit("https://a.example/"), "doc_id").alias("url"), F.lit(None).cast("string").alias("resumen"))
    second = m.groupBy("doc_id").agg(F.min("titulo").alias("resumen")).select("doc_id", F.concat(F.lit("https://b.example/"), "doc_id").alias("url"), "resumen")
    return R.first_wins([first, second], "doc_id", "url").select("doc_id", "url", "resumen", "alternas")


@query("SELECT llave, min(prioridad) AS prioridad FROM (SELECT s_suppkey AS llave, 1 AS prioridad FROM supplier UNION ALL SELECT c_custkey, 2 FROM customer UNION ALL SELECT p_partkey, 3 FROM part) WHERE llave NOT IN (SELECT n_nationkey FROM nation) AND llave NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1")
def t06_disjoint_union(s: SparkSession, d: str) -> DataFrame:
    """Three lists by priority without the keys of two exclusion sets."""
    one = lambda t, c: read(s, d, t).select(F.col(c).cast("bigint").alias("llave"))
    return R.disjoint_union([one("supplier", "s_suppkey"), one("customer", "c_custkey"), one("part", "p_partkey")], "llave", one("nation", "n_nationkey"), read(s, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").cast("bigint")))


@query("SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, coalesce(b.s_name, a.s_name) AS s_name, coalesce(b.s_nationkey, a.s_nationkey) AS s_nationkey FROM (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 3 > 0) a FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'otro' END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN 1 END::INT AS s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) b ON a.s_suppkey = b.s_suppkey")
def t07_overlay(s: SparkSession, d: str) -> DataFrame:
    """An inventory overlaid by another, field by field."""
    t = read(s, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))
    extra = t.where("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "otro").alias("s_name"), F.when(F.col("s_suppkey") % 5 == 0, 1).alias("s_nationkey"))
    return R.overlaid(t.where("s_suppkey % 3 > 0"), extra, "s_suppkey")


@query("WITH b AS (SELECT seccion, comprobacion, count(*) AS n FROM hallazgos GROUP BY 1, 2), x AS (SELECT seccion, comprobacion, 0::BIGINT AS n FROM b WHERE seccion IN ('A', 'B')) SELECT * FROM b WHERE seccion NOT IN ('A', 'B') UNION ALL SELECT * FROM x")
def t08_replace_by_key(s: SparkSession, d: str) -> DataFrame:
    """Rows with the same composite key replaced."""
    b = read(s, d, "hallazgos").groupBy("seccion", "comprobacion").agg(F.count(F.lit(1)).alias("n"))
    return R.replaced(b, b.where("seccion IN ('A', 'B')").withColumn("n", F.lit(0).cast("bigint")), ["seccion", "comprobacion"])


@query("WITH a AS (SELECT DISTINCT doc_id AS v FROM manifiesto), b AS (SELECT DISTINCT norma_id AS v FROM documents WHERE norma_id IS NOT NULL) SELECT 'sobra' AS lado, v AS valor FROM a WHERE v NOT IN (SELECT v FROM b) UNION ALL SELECT 'falta', v FROM b WHERE v NOT IN (SELECT v FROM a)")
def t09_set_equality(s: SparkSession, d: str) -> DataFrame:
    """What keeps the manifest's ids and the documents' norms from being equal sets."""
    return R.set_difference(read(s, d, "manifiesto").select("doc_id"), read(s, d, "documents").where("norma_id IS NOT NULL").select("norma_id"))


@query("WITH r AS (SELECT tipo || ' ' || anio AS alias, count(DISTINCT doc_id) AS n, min(doc_id) AS t FROM manifiesto WHERE anio IS NOT NULL GROUP BY 1), l AS (SELECT DISTINCT tipo || ' ' || anio AS alias FROM documents WHERE tipo IS NOT NULL AND anio IS NOT NULL) SELECT alias, CASE WHEN n = 1 THEN t END AS doc_id, coalesce(n, 0) AS coincidencias FROM l LEFT JOIN r USING (alias)")
def t10_match_cardinality(s: SparkSession, d: str) -> DataFrame:
    """Aliases matched to none, one or several documents."""
    alias = F.concat_ws(" ", "tipo", F.col("anio").cast("string")).alias("alias")
    left = read(s, d, "documents").where("tipo IS NOT NULL AND anio IS NOT NULL").select(alias).distinct()
    return R.matched(left, read(s, d, "manifiesto").where("anio IS NOT NULL").select(alias, "doc_id"), "alias", "doc_id")


@query(
    "WITH m AS (SELECT DISTINCT doc_id, tipo, anio, fuente FROM manifiesto), a AS (SELECT doc_id AS k, CASE WHEN count(DISTINCT fuente) = 1 THEN min(fuente) END AS f FROM m GROUP BY 1), b AS (SELECT tipo, anio, CASE WHEN count(DISTINCT fuente) = 1 THEN min(fuente) END AS f FROM m GROUP BY 1, 2), c AS (SELECT tipo, CASE WHEN count(DISTINCT fuente) = 1 THEN min(fuente) END AS f FROM m GROUP BY 1) "
    "SELECT t.doc_id, coalesce(a.f, b.f, c.f) AS fuente, CASE WHEN a.f IS NOT NULL THEN 1 WHEN b.f IS NOT NULL THEN 2 WHEN c.f IS NOT NULL THEN 3 END::INT AS via FROM documents t LEFT JOIN a ON a.k = t.norma_id LEFT JOIN b ON b.tipo = t.tipo AND b.anio = t.anio LEFT JOIN c ON c.tipo = t.tipo"
)
def t11_cascade(s: SparkSession, d: str) -> DataFrame:
    """A text's source by its norm, else by kind and year, else by kind, each only if unique."""
    m = read(s, d, "manifiesto")
    return R.cascade(read(s, d, "documents").select("doc_id", "norma_id", "tipo", "anio"), "doc_id", [(m.select(F.col("doc_id").alias("norma_id"), "fuente"), ["norma_id"], "fuente"), (m.select("tipo", "anio", "fuente"), ["tipo", "anio"], "fuente"), (m.select("tipo", "fuente"), ["tipo"], "fuente")], "fuente")


@query("WITH o AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS a, list(DISTINCT l_suppkey) FILTER (l_linenumber = 1) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS contiene FROM o WHERE b IS NOT NULL")
def t12_containment(s: SparkSession, d: str) -> DataFrame:
    """Whether an order's suppliers hold that of its first line."""
    o = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("b"))
    return o.where("size(b) > 0").select("l_orderkey", R.contains_all(F.col("b"), F.col("a")).alias("contiene"))


@query("WITH v AS (SELECT unnest(['a', 'b', 'c']) AS variante), q AS (SELECT id, length(pregunta) AS n FROM preguntas WHERE pregunta IS NOT NULL) SELECT variante, count(*) AS preguntas, round(avg(n * CASE variante WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END), 6) AS media FROM q, v GROUP BY 1")
def t13_variants(s: SparkSession, d: str) -> DataFrame:
    """Each question under three variants."""
    q = read(s, d, "preguntas").where("pregunta IS NOT NULL").select(F.length("pregunta").alias("n"), F.explode(F.array(*map(F.lit, "abc"))).alias("variante"))
    weight = F.when(F.col("variante") == "a", 1).when(F.col("variante") == "b", 2).otherwise(3)
    return q.groupBy("variante").agg(F.count(F.lit(1)).alias("preguntas"), F.round(F.avg(F.col("n") * weight), 6).alias("media"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_totalprice > 100000) DESC, o_totalprice DESC, o_orderkey) = 1")
def t14_tuple_max(s: SparkSession, d: str) -> DataFrame:
    """The order of each customer that is first by three criteria."""
    return R.argmax(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc(F.col("o_totalprice") > 100000), F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("WITH g AS (SELECT l_linestatus, round(0.6 * avg(l_discount) + 0.4 * avg(l_tax), 6) AS utilidad, count(*) AS memoria FROM lineitem GROUP BY 1) SELECT l_linestatus, utilidad FROM g ORDER BY utilidad DESC, memoria, l_linestatus LIMIT 1")
def t15_argmax_fallbacks(s: SparkSession, d: str) -> DataFrame:
    """The best configuration by a weighted utility, ties by size, then name."""
    g = read(s, d, "lineitem").groupBy("l_linestatus").agg(F.round(0.6 * F.avg("l_discount") + 0.4 * F.avg("l_tax"), 6).alias("utilidad"), F.count(F.lit(1)).alias("memoria"))
    return g.orderBy(F.desc("utilidad"), "memoria", "l_linestatus").limit(1).select("l_linestatus", "utilidad")


@query("SELECT 'mayor' AS extremo, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS puesto, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 10 UNION ALL SELECT 'menor', row_number() OVER (ORDER BY o_totalprice, o_orderkey)::INT, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= 10")
def t16_extremes(s: SparkSession, d: str) -> DataFrame:
    """The ten greatest and smallest orders."""
    return R.extremes(read(s, d, "orders"), "o_totalprice", "o_orderkey", 10)


@query("SELECT doc_id, grupo FROM (SELECT DISTINCT doc_id, CASE WHEN bool_or(NOT redistribuir_raw) OVER (PARTITION BY doc_id) THEN 'restringido' WHEN bool_or(nivel = 'complementario') OVER (PARTITION BY doc_id) THEN 'excluido' ELSE 'elegido' END AS grupo FROM manifiesto)")
def t17_eligibility(s: SparkSession, d: str) -> DataFrame:
    """Documents elected, excluded and restricted."""
    m = read(s, d, "manifiesto").groupBy("doc_id").agg(F.bool_or(~F.col("redistribuir_raw")).alias("r"), F.bool_or(F.col("nivel") == "complementario").alias("c"))
    return m.select("doc_id", F.when(F.col("r"), "restringido").when(F.col("c"), "excluido").otherwise("elegido").alias("grupo"))


@query("WITH p AS (SELECT DISTINCT f.sha256 AS h FROM (SELECT unnest(archivos_raw) AS f FROM manifiesto) WHERE f.http_status = 404), a AS (SELECT doc_id, unnest(archivos_raw) AS f FROM manifiesto) SELECT doc_id, bool_or(f.sha256 IN (SELECT h FROM p)) AS restringido FROM a GROUP BY 1")
def t18_source_restriction(s: SparkSession, d: str) -> DataFrame:
    """Documents of which a file has a pinned content hash."""
    a = read(s, d, "manifiesto").select("doc_id", F.explode("archivos_raw").alias("f")).select("doc_id", F.col("f.sha256").alias("h"), F.col("f.http_status").alias("st"))
    pinned = a.where("st = 404").select("h").distinct().withColumn("p", F.lit(True))
    return a.join(pinned, "h", "left").groupBy("doc_id").agg(F.bool_or(F.coalesce("p", F.lit(False))).alias("restringido"))


@query("SELECT c.id, coalesce(c.avisos NOT LIKE '%no_apta%', true) AND coalesce(m.n <> 'complementario', true) AS apta FROM chunks c LEFT JOIN (SELECT regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g') AS k, min(nivel) AS n FROM manifiesto GROUP BY 1) m ON m.k = regexp_replace(lower(trim(c.doc_id)), '[\\s\\-_]+', '_', 'g')")
def t19_searchable(s: SparkSession, d: str) -> DataFrame:
    """Units that may be searched: their own flag and their document's, true where one is missing."""
    m = read(s, d, "manifiesto").groupBy(T.settle_id(F.col("doc_id")).alias("k")).agg(F.min("nivel").alias("n"))
    c = read(s, d, "chunks").select("id", T.settle_id(F.col("doc_id")).alias("k"), "avisos").join(m, "k", "left")
    return c.select("id", (F.coalesce(~F.col("avisos").contains("no_apta"), F.lit(True)) & F.coalesce(F.col("n") != "complementario", F.lit(True))).alias("apta"))


@query("SELECT event_type, user_id, count(*) AS n, max(coalesce(epoch(prox) - epoch(ts), 0))::BIGINT AS tramo FROM (SELECT *, lead(date_trunc('second', ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prox FROM (SELECT event_id, user_id, event_type, date_trunc('second', ts) AS ts FROM events)) GROUP BY 1, 2")
def t20_interval_lengths(s: SparkSession, d: str) -> DataFrame:
    """The longest time from an event to the user's next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(s, d, "events").select("event_id", "user_id", "event_type", F.date_trunc("second", "ts").alias("ts")).withColumn("prox", F.lead("ts").over(w))
    gap = F.coalesce(F.unix_timestamp("prox") - F.unix_timestamp("ts"), F.lit(0))
    return e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.max(gap).cast("bigint").alias("tramo"))


@query("SELECT k.id, k.n IS NULL AND NOT (k.area IS NULL) AS falta FROM (SELECT c.id, c.area, d.n FROM clave_oro c LEFT JOIN (SELECT area, count(*) AS n FROM documents WHERE area IS NOT NULL GROUP BY 1) d ON d.area = c.area) k")
def t21_missing_targets(s: SparkSession, d: str) -> DataFrame:
    """Items whose area no document covers."""
    areas = read(s, d, "documents").where("area IS NOT NULL").groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    return read(s, d, "clave_oro").select("id", "area").join(areas, "area", "left").select("id", (F.col("n").isNull() & F.col("area").isNotNull()).alias("falta"))


@query("SELECT id, coalesce(length(texto) >= 300 AND (regexp_matches(texto, '(?i)art[íi]culo') OR regexp_matches(texto, '(?i)resuelve')), false) AS valido FROM chunks")
def t22_pattern_validator(s: SparkSession, d: str) -> DataFrame:
    """Texts of a minimum size that hold any of the expected patterns."""
    from ..operators import answers as A

    return read(s, d, "chunks").select("id", A.fits(F.col("texto"), [r"(?i)art[íi]culo", r"(?i)resuelve"], 300).alias("valido"))


@query("SELECT m.doc_id, bool_or(h.doc_id IS NOT NULL) AS recuperado FROM manifiesto m LEFT JOIN (SELECT DISTINCT norma_id AS doc_id FROM documents WHERE area = 'laboral') h ON h.doc_id = m.doc_id GROUP BY 1")
def t23_inventory_flags(s: SparkSession, d: str) -> DataFrame:
    """Inventory rows flagged by whether a retrieval holds them."""
    got = read(s, d, "documents").where("area = 'laboral' AND norma_id IS NOT NULL").select(F.col("norma_id").alias("doc_id")).distinct().withColumn("h", F.lit(True))
    return read(s, d, "manifiesto").select("doc_id").distinct().join(got, "doc_id", "left").select("doc_id", F.coalesce("h", F.lit(False)).alias("recuperado"))


@query("WITH p AS (SELECT tipo, doc_id, row_number() OVER (PARTITION BY tipo ORDER BY sha256(doc_id::VARCHAR)) AS r FROM documents WHERE length(text) >= 160 AND tipo IS NOT NULL) SELECT d.tipo, d.doc_id, substring(d.text, least(length(d.text) // 3, 200) + 1, 120) AS sonda FROM p JOIN documents d USING (doc_id) WHERE r <= 3")
def t24_probes(s: SparkSession, d: str) -> DataFrame:
    """Literal probes: three texts of each kind in hash order, and 120 characters from their first third."""
    rows = read(s, d, "documents").where("length(text) >= 160 AND tipo IS NOT NULL").select("tipo", "doc_id", "text")
    w = Window.partitionBy("tipo").orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    picked = rows.select("tipo", "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 3").select("doc_id")
    start = F.least(F.floor(F.length("text") / 3), F.lit(200)).cast("int")
    return rows.join(picked, "doc_id", "left_semi").select("tipo", "doc_id", F.substring("text", start + 1, F.lit(120)).alias("sonda"))


@query("WITH u AS (SELECT regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g') AS doc_id, id FROM chunks WHERE length(texto) BETWEEN 160 AND 1200), g AS (SELECT doc_id FROM u GROUP BY 1 HAVING count(*) >= 4) SELECT doc_id, id FROM u JOIN g USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sha256(id::VARCHAR)) <= 4")
def t25_decoder_probes(s: SparkSession, d: str) -> DataFrame:
    """Four units in hash order of each document that has four of middling length."""
    u = read(s, d, "chunks").where("length(texto) BETWEEN 160 AND 1200").select(T.settle_id(F.col("doc_id")).alias("doc_id"), "id")
    w = Window.partitionBy("doc_id").orderBy(F.sha2(F.col("id").cast("string"), 256))
    ranked = u.withColumn("r", F.row_number().over(w)).where("r <= 4")
    enough = u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("doc_id")
    return ranked.join(enough, "doc_id", "left_semi").select("doc_id", "id")
