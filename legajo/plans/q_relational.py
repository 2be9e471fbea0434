"""Relational queries: profiles, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered as O
from ..operators import relational as R
from ..sources.tables import read
from .registry import registry

QUERIES, SQL, query = registry()


_MANIFEST = ("doc_id", "titulo", "numero", "organo_emisor", "fuente", "nivel", "vigencia_fuente")


@query(" UNION ALL ".join(f"SELECT '{c}' AS campo, count(*) AS total, count(*) FILTER ({c} IS NULL) AS nulos, count(*) FILTER ({c} = '') AS vacios FROM manifiesto" for c in _MANIFEST))
def q01_manifest_profile(s: SparkSession, d: str) -> DataFrame:
    return R.missingness(read(s, d, "manifiesto"), _MANIFEST)


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, coalesce(nullif({c}, ''), '(sin dato)') AS valor, count(*) AS n FROM manifiesto GROUP BY 2" for c in ("tipo", "fuente", "nivel", "vigencia")))
def q02_value_distributions(s: SparkSession, d: str) -> DataFrame:
    return R.value_counts(read(s, d, "manifiesto"), ("tipo", "fuente", "nivel", "vigencia"))


@query("SELECT l_returnflag, 0.5::DOUBLE AS punto, round(quantile_cont(l_extendedprice, 0.5), 3) AS valor FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 0.95::DOUBLE, round(quantile_cont(l_extendedprice, 0.95), 3) FROM lineitem GROUP BY 1")
def q03_quantiles_by_group(s: SparkSession, d: str) -> DataFrame:
    return R.quantiles(read(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.5, 0.95))


@query("WITH o AS (SELECT o_totalprice v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT max(v) FILTER (i = least(n - 1, floor(0.95 * n))) AS por_indice, max(v) FILTER (i = ceil(0.95 * n) - 1) AS por_techo FROM o")
def q04_nearest_rank_p95(s: SparkSession, d: str) -> DataFrame:
    return R.nearest_rank(read(s, d, "orders"), "o_totalprice", 0.95)


@query("SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (text IS NULL) AS sin_texto FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def q05_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("text").isNull()).alias("sin_texto"))


_SEV = ("CRITICO", "ALTO", "AVISO")


@query("SELECT seccion, " + ", ".join(f"count(*) FILTER (severidad = '{v}') AS \"{v}\"" for v in _SEV) + " FROM hallazgos GROUP BY 1")
def q06_crosstab(s: SparkSession, d: str) -> DataFrame:
    return R.crosstab(read(s, d, "hallazgos"), F.col("seccion"), "severidad", _SEV)


@query("WITH x AS (SELECT DISTINCT doc_id, unnest(areas) AS a FROM manifiesto) SELECT x.a, y.a AS b, count(*) AS n FROM x JOIN x y USING (doc_id) WHERE x.a < y.a GROUP BY 1, 2")
def q07_cooccurrence_pairs(s: SparkSession, d: str) -> DataFrame:
    return R.cooccurrence(read(s, d, "manifiesto").select("doc_id", F.explode("areas").alias("area")), "doc_id", "area")


@query("WITH q AS (SELECT tipo, quantile_cont(length(text), 0.25) AS q1, quantile_cont(length(text), 0.75) AS q3 FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, d.tipo, length(text)::BIGINT AS largo FROM documents d JOIN q ON d.tipo = q.tipo WHERE length(text) > q3 + 1.5 * (q3 - q1) OR length(text) < q1 - 1.5 * (q3 - q1)")
def q08_iqr_outliers(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", "tipo", F.length("text").cast("bigint").alias("largo"))
    q = docs.groupBy("tipo").agg(F.percentile("largo", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    reach = 1.5 * (F.col("q")[1] - F.col("q")[0])
    return docs.join(q, "tipo").where((F.col("largo") > F.col("q")[1] + reach) | (F.col("largo") < F.col("q")[0] - reach)).select("doc_id", "tipo", "largo")


@query("WITH c AS (SELECT doc_id, count(*) AS n FROM hallazgos WHERE doc_id <> '' GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, doc_id) AS k FROM c) SELECT round(100.0 * sum(n) FILTER (k <= 10) / sum(n), 6)::DOUBLE AS parte FROM r")
def q09_concentration_top10(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "hallazgos").where("doc_id <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "doc_id").limit(10).agg(F.sum("n").alias("t"))
    return top.crossJoin(c.agg(F.sum("n").alias("s"))).select(F.round(100.0 * F.col("t") / F.col("s"), 6).alias("parte"))


@query("SELECT sha256(text) AS huella, count(*) AS n, min(doc_id) AS menor FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q10_duplicate_groups(s: SparkSession, d: str) -> DataFrame:
    return R.duplicate_groups(read(s, d, "documents"), F.col("text"), "doc_id")


@query("SELECT doc_id, h.n FROM documents d JOIN (SELECT sha256(text) AS k, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) h ON sha256(d.text) = h.k")
def q11_duplicate_rows(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("k"))
    return docs.join(docs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "k").select("doc_id", "n")


_FIRST_MANIFEST = "(SELECT doc_id, arg_min(tipo, ingresado_en || coalesce(titulo, '')) AS m_tipo FROM manifiesto GROUP BY 1)"
_SETTLED = r"regexp_replace(lower(trim(doc_id)), '[\s\-_]+', '_', 'g')"


@query(f"SELECT c.id, {_SETTLED.replace('doc_id', 'c.doc_id')} AS doc_id, m.veces FROM chunks c JOIN (SELECT {_SETTLED} AS k, count(*) AS veces FROM manifiesto GROUP BY 1) m ON m.k = {_SETTLED.replace('doc_id', 'c.doc_id')}")
def q12_lookup_join(s: SparkSession, d: str) -> DataFrame:
    m = read(s, d, "manifiesto").groupBy(T.settle_id(F.col("doc_id")).alias("doc_id")).agg(F.count(F.lit(1)).alias("veces"))
    return read(s, d, "chunks").select("id", T.settle_id(F.col("doc_id")).alias("doc_id")).join(m, "doc_id").select("id", "doc_id", "veces")


@query("SELECT c_custkey, coalesce(n, 0) AS pedidos, round(coalesce(t, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q13_left_merge_null0(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    return read(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("pedidos"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT DISTINCT doc_id FROM manifiesto m WHERE EXISTS (SELECT 1 FROM hallazgos h WHERE h.doc_id = m.doc_id AND severidad = 'CRITICO')")
def q14_semi(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "manifiesto").select("doc_id").join(read(s, d, "hallazgos").where("severidad = 'CRITICO'").select("doc_id"), "doc_id", "left_semi").distinct()


@query("SELECT DISTINCT doc_id FROM manifiesto m WHERE NOT EXISTS (SELECT 1 FROM documents t WHERE t.norma_id = m.doc_id)")
def q15_anti(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "manifiesto").select("doc_id").join(read(s, d, "documents").select(F.col("norma_id").alias("doc_id")), "doc_id", "left_anti").distinct()


_OLD = "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 7 <> 0"
_NEW = "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 11 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 9 <> 0"


@query(
    f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, '' AS campo, CASE WHEN a.s_suppkey IS NULL THEN 'agregado' ELSE 'retirado' END AS cambio FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_suppkey IS NULL OR b.s_suppkey IS NULL "
    "UNION ALL SELECT a.s_suppkey, 's_name', 'cambiado' FROM a JOIN b ON a.s_suppkey = b.s_suppkey WHERE coalesce(a.s_name, '') <> coalesce(b.s_name, '') UNION ALL SELECT a.s_suppkey, 's_nationkey', 'cambiado' FROM a JOIN b ON a.s_suppkey = b.s_suppkey WHERE a.s_nationkey <> b.s_nationkey"
)
def q16_full_outer_diff(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "supplier")
    old = t.where("s_suppkey % 7 <> 0").select("s_suppkey", "s_name", "s_nationkey")
    new = t.where("s_suppkey % 9 <> 0").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS s_name"), F.expr("CASE WHEN s_suppkey % 11 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey"))
    return R.snapshot_diff(old, new, "s_suppkey", ("s_name", "s_nationkey"))


@query("SELECT CASE WHEN a AND b THEN 'igual_bien' WHEN NOT a AND NOT b THEN 'igual_mal' WHEN b THEN 'arreglada' ELSE 'rota' END AS clase, count(*) AS n FROM (SELECT id, id % 3 <> 0 AS a, id % 4 <> 0 AS b FROM preguntas) GROUP BY 1")
def q17_transition_class(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "preguntas")
    first, second = q.select("id", (F.col("id") % 3 != 0).alias("a")), q.select("id", (F.col("id") % 4 != 0).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "igual_bien").when(~F.col("a") & ~F.col("b"), "igual_mal").when(F.col("b"), "arreglada").otherwise("rota")
    return first.join(second, "id").groupBy(kind.alias("clase")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT doc_id, k * 900 AS a, least(k * 900 + 1000, length(text)) AS b FROM documents, range(0, 40) r(k) WHERE k * 900 < length(text)), p AS (SELECT doc_id, k * 1400 AS a, least(k * 1400 + 1400, length(text)) AS b FROM documents, range(0, 40) r(k) WHERE k * 1400 < length(text)) SELECT s.doc_id, s.a AS s_a, s.b AS s_b, p.a AS p_a, p.b AS p_b, greatest(s.a, p.a) AS desde, least(s.b, p.b) AS hasta FROM s JOIN p ON s.doc_id = p.doc_id AND s.a < p.b AND p.a < s.b")
def q18_interval_overlap(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").where("length(text) > 0").select("doc_id", F.length("text").cast("bigint").alias("n"))

    def cut(step: int, size: int) -> DataFrame:
        return docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(step).cast("bigint"))).alias("a")).select("doc_id", "a", F.least(F.col("a") + size, F.col("n")).alias("b"))

    return R.interval_overlap(cut(900, 1000), cut(1400, 1400), "doc_id", 2000)


@query("SELECT e.event_id, b.k AS tramo FROM events e JOIN (SELECT k, k * 25 AS a, k * 25 + 25 AS b FROM range(0, 40) r(k)) b ON e.value >= b.a AND e.value < b.b")
def q19_point_in_interval(s: SparkSession, d: str) -> DataFrame:
    spans = s.range(40).select(F.col("id").alias("tramo"), (F.col("id") * 25).alias("a"), (F.col("id") * 25 + 25).alias("b"))
    points = read(s, d, "events").select("event_id", "value", F.floor(F.col("value") / 25).alias("k"))
    return points.join(F.broadcast(spans), F.col("k") == F.floor(F.col("a") / 25)).where("value >= a AND value < b").select("event_id", "tramo")


@query("SELECT split_part(p_name, ' ', 1) AS alias, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) END AS destino FROM part GROUP BY 1")
def q20_alias_ambiguous_null(s: SparkSession, d: str) -> DataFrame:
    return R.unique_alias(read(s, d, "part"), F.substring_index("p_name", " ", 1), "p_partkey")


@query(r"SELECT doc_id, dominio, dominio = sitio OR ends_with(dominio, '.' || sitio) AS esperado FROM (SELECT DISTINCT doc_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', '') AS dominio FROM manifiesto WHERE url IS NOT NULL) CROSS JOIN (SELECT 'example' AS sitio)")
def q21_suffix_domain_match(s: SparkSession, d: str) -> DataFrame:
    sites = s.createDataFrame([("example",)], "sitio string")
    hosts = read(s, d, "manifiesto").where("url IS NOT NULL").select("doc_id", T.host(F.col("url")).alias("dominio")).distinct()
    return hosts.join(F.broadcast(sites)).select("doc_id", "dominio", ((F.col("dominio") == F.col("sitio")) | F.col("dominio").endswith(F.concat(F.lit("."), F.col("sitio")))).alias("esperado"))


@query("SELECT llave, min(prioridad) AS prioridad, arg_min(nombre, prioridad) AS nombre FROM (SELECT n_nationkey::BIGINT AS llave, n_name AS nombre, 1 AS prioridad FROM nation UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT c_custkey, c_name, 3 FROM customer) GROUP BY 1")
def q22_priority_union(s: SparkSession, d: str) -> DataFrame:
    parts = (("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))
    return R.priority_union([read(s, d, t).select(F.col(k).cast("bigint").alias("llave"), F.col(n).alias("nombre")) for t, k, n in parts], "llave")


@query("WITH o AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_linenumber <= 3) AS a, list(DISTINCT l_suppkey) FILTER (l_linenumber >= 3) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_intersect(a, b))::BIGINT AS comunes, len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x)))::BIGINT AS solo_a FROM o WHERE a IS NOT NULL AND b IS NOT NULL")
def q23_set_algebra(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") >= 3, F.col("l_suppkey"))).alias("b"))
    return o.where("size(a) > 0 AND size(b) > 0").select("l_orderkey", F.size(F.array_intersect("a", "b")).cast("bigint").alias("comunes"), F.size(F.array_except("a", "b")).cast("bigint").alias("solo_a"))


_BY_DOC = f"(SELECT id, {_SETTLED} AS doc_id, inicio, fin, seccion FROM chunks)"


def _by_doc(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return read(s, d, "chunks").select("id", T.settle_id(F.col("doc_id")).alias("doc_id"), *columns)


@query(f"SELECT id, doc_id, inicio, coalesce(lead(inicio) OVER (PARTITION BY doc_id ORDER BY inicio, id), fin) AS hasta FROM {_BY_DOC}")
def q24_lead_units(s: SparkSession, d: str) -> DataFrame:
    """Each fragment's end: where the document's next one begins, or its own."""
    return O.next_value(_by_doc(s, d, "inicio", "fin"), "doc_id", ["inicio", "id"], "inicio", "sig").select("id", "doc_id", "inicio", F.coalesce("sig", "fin").alias("hasta"))


@query(f"SELECT id, last_value(nullif(seccion, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS vigente FROM {_BY_DOC}")
def q25_forward_fill(s: SparkSession, d: str) -> DataFrame:
    """The section in force at each fragment of a document."""
    return O.forward_filled(_by_doc(s, d, "seccion"), "doc_id", ["id"], F.nullif(F.col("seccion"), F.lit("")), "vigente").select("id", "vigente")


@query(f"WITH x AS (SELECT doc_id, id, inicio, max(fin) OVER (PARTITION BY doc_id ORDER BY inicio, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hasta FROM {_BY_DOC}) SELECT doc_id, id, hasta AS desde, inicio AS hueco FROM x WHERE inicio > hasta")
def q28_running_coverage(s: SparkSession, d: str) -> DataFrame:
    """Gaps that no earlier fragment of the document covers."""
    got = O.previous_max(_by_doc(s, d, "inicio", "fin"), "doc_id", ["inicio", "id"], "fin", "desde")
    return got.where("inicio > desde").select("doc_id", "id", "desde", F.col("inicio").alias("hueco"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turno FROM documents")
def q29_round_robin(s: SparkSession, d: str) -> DataFrame:
    """The turn of each document in its source's queue."""
    return O.numbered(read(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"], "turno").select("doc_id", "source", "turno")


@query("WITH x AS (SELECT DISTINCT tipo, anio FROM manifiesto WHERE anio IS NOT NULL), y AS (SELECT *, lead(anio) OVER (PARTITION BY tipo ORDER BY anio) AS s FROM x) SELECT tipo, anio + 1 AS desde, s - 1 AS hasta FROM y WHERE s > anio + 1")
def q26_gaps(s: SparkSession, d: str) -> DataFrame:
    return R.gaps(read(s, d, "manifiesto").where("anio IS NOT NULL"), ["tipo"], "anio")


@query("WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS isla FROM m) SELECT user_id, isla, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2")
def q27_islands(s: SparkSession, d: str) -> DataFrame:
    return R.islands(read(s, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type")).groupBy("user_id", "isla").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("SELECT tipo, doc_id FROM (SELECT tipo, doc_id, row_number() OVER (PARTITION BY tipo ORDER BY sha256(doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 5")
def q30_hash_sample(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("tipo").orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    return read(s, d, "documents").select("tipo", "doc_id", F.row_number().over(w).alias("r")).where("r <= 5").select("tipo", "doc_id")


@query("WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), c AS (SELECT lang, i, n, row_number() OVER (ORDER BY (i > 1)::INT, n / i::DOUBLE DESC, lang) AS r FROM n, range(1, 201) g(i) WHERE i <= n), t AS (SELECT lang, count(*) AS cupos FROM c WHERE r <= 200 OR i = 1 GROUP BY 1), p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS puesto FROM documents WHERE lang IS NOT NULL) SELECT lang, doc_id, puesto FROM p JOIN t USING (lang) WHERE puesto <= cupos")
def q31_dhondt_stratified(s: SparkSession, d: str) -> DataFrame:
    return R.stratified(read(s, d, "documents").where("lang IS NOT NULL").select("lang", "doc_id"), "lang", "doc_id", 200).withColumn("puesto", F.col("puesto").cast("bigint"))


@query("WITH RECURSIVE h AS (SELECT id, sha256(id::VARCHAR) AS x, 0 AS i, 0 AS m FROM preguntas UNION ALL SELECT id, x, i + 1, (m * 16 + instr('0123456789abcdef', x[i + 1]) - 1) % 10 FROM h WHERE i < 64) SELECT id, m < 7 AS desarrollo FROM h WHERE i = 64")
def q32_hash_split(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "preguntas").select("id", (T.hash_bucket(F.col("id"), 10) < 7).alias("desarrollo"))
