"""Queries of windows, packers and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment as G
from ..sources.tables import read
from .registry import registry

QUERIES, SQL, query = registry()

_WS = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
_HEAD = r"^[ \t]*(?:Art[íi]culo|ART[ÍI]CULO|Art\.)[ \t]+[0-9]"


@query(f"SELECT id, count(*) AS candidatos FROM (SELECT id, unnest(string_split(texto, chr(10))) AS l FROM chunks) WHERE regexp_matches(l, '{_HEAD}') GROUP BY 1")
def q39_article_candidates_line(s: SparkSession, d: str) -> DataFrame:
    """Lines that begin like an article's heading."""
    return read(s, d, "chunks").select("id", F.explode(F.split("texto", "\n")).alias("l")).where(F.col("l").rlike(_HEAD)).groupBy("id").agg(F.count(F.lit(1)).alias("candidatos"))


@query(
    rf"""WITH RECURSIVE b AS (SELECT doc_id, text, length(regexp_extract(text, '^[{_WS}]*')) AS a, length(regexp_replace(text, '[{_WS}]+$', '')) AS z FROM documents WHERE regexp_matches(text, '[^{_WS}]')),
w AS (SELECT doc_id, text, z, 1 AS n, a AS inicio, NULL::BIGINT AS fin, a + 1000 AS tope FROM b UNION ALL
  SELECT doc_id, text, z, n + 1, CASE WHEN corte >= z THEN z ELSE CASE WHEN regexp_matches(substring(text, atras, 1), '^[{_WS}]$') OR NOT regexp_matches(substring(text, atras + 1, corte - atras), '[{_WS}]') THEN atras ELSE atras + length(regexp_extract(substring(text, atras + 1, corte - atras), '^[^{_WS}]*[{_WS}]')) END END, NULL, NULL FROM
  (SELECT *, greatest(inicio + 1, corte - 100) AS atras FROM (SELECT *, CASE WHEN inicio + 1000 >= z THEN z ELSE coalesce((SELECT inicio + 500 + length(x) - strpos(reverse(x), ' ') FROM (SELECT translate(substring(text, inicio + 501, 501), chr(10), ' ') AS x) WHERE contains(x, ' ')), inicio + 1000) END AS corte FROM w WHERE inicio < z)) WHERE corte < z)
SELECT doc_id, n, inicio, CASE WHEN inicio + 1000 >= z THEN z ELSE coalesce((SELECT inicio + 500 + length(x) - strpos(reverse(x), ' ') FROM (SELECT translate(substring(text, inicio + 501, 501), chr(10), ' ') AS x) WHERE contains(x, ' ')), inicio + 1000) END AS fin FROM w"""
)
def q40_char_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of 1,000 characters that share 100."""
    return G.spans(read(s, d, "documents"), "doc_id", "text", "caracteres")


def _packer_sql(overlap: int) -> str:
    """Greedy packing of words, each with its count of counted words, up to 90 and with an overlap."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^{_WS}]+') AS w FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, w, list_transform(w, lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{N}}_]+'))) AS k FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, w, list_transform(range(1, len(k) + 1), lambda i: list_sum(k[1 : i])) AS s FROM c),
p AS (SELECT doc_id, w, s, 1 AS n, 1 AS i FROM s UNION ALL
  SELECT doc_id, w, s, n + 1, CASE WHEN {overlap} = 0 THEN j + 1 ELSE greatest(i + 1, least(j, j + 1 - len(list_filter(range(i + 1, j + 1), lambda b: s[j] - s[b - 1] <= {overlap})))) END FROM
  (SELECT *, greatest(i, len(list_filter(s, lambda x: x - coalesce(s[i - 1], 0) <= 90))) AS j FROM p) WHERE j < len(s))
SELECT doc_id, n, list_sum(list_transform(w[i : greatest(i, len(list_filter(s, lambda x: x - coalesce(s[i - 1], 0) <= 90)))], lambda x: length(x)))::BIGINT AS letras FROM p"""


def _packed(s: SparkSession, d: str, name: str) -> DataFrame:
    docs = read(s, d, "documents").select("doc_id", "text")
    got = G.spans(docs, "doc_id", "text", name).join(docs, "doc_id")
    return got.select("doc_id", "n", F.length(F.regexp_replace(F.expr("substring(text, inicio + 1, fin - inicio)"), r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", "")).cast("bigint").alias("letras"))


@query(_packer_sql(0))
def q41_word_windows_fixed(s: SparkSession, d: str) -> DataFrame:
    """Pieces of ninety words."""
    return _packed(s, d, "fijo")


@query(_packer_sql(20))
def q41_word_windows_overlap(s: SparkSession, d: str) -> DataFrame:
    """Pieces of ninety words that share up to twenty."""
    return _packed(s, d, "fijo_solape")


@query()
def q42_chunk_diagnostics(s: SparkSession, d: str) -> DataFrame:
    """Pieces, words, coverage, redundancy and clean boundaries of every strategy."""
    docs, out = read(s, d, "documents"), None
    for name in (*G.STRATEGIES, "caracteres"):
        row = G.diagnostics(docs, "doc_id", "text", name)
        out = row if out is None else out.unionByName(row)
    return out


@query()
def q43_article_units(s: SparkSession, d: str) -> DataFrame:
    """Units of every chunk by the family of its kind: articles and sections of norms, paragraphs of judgments, blocks of others."""
    return G.units(read(s, d, "chunks"), "id", "texto", "tipo")


@query(f"SELECT id, 0::BIGINT AS inicio, length(texto)::BIGINT AS fin, 0::BIGINT AS huecos FROM chunks WHERE regexp_matches(texto, '[^{_WS}]')")
def q44_unit_invariants(s: SparkSession, d: str) -> DataFrame:
    """Units adjoin each other from a text's beginning to its end."""
    w = Window.partitionBy("id").orderBy("orden")
    got = G.units(read(s, d, "chunks"), "id", "texto", "tipo").withColumn("previo", F.lag("fin").over(w))
    return got.groupBy("id").agg(F.min("inicio").alias("inicio"), F.max("fin").alias("fin"), F.count_if(F.col("inicio") != F.col("previo")).alias("huecos"))


_FAMILY = "CASE WHEN tipo IN ('sentencia', 'auto', 'providencia', 'fallo') THEN 'jurisprudencia' WHEN tipo IN ('ley', 'decreto', 'acto_legislativo', 'constitucion', 'acuerdo', 'resolucion', 'decision') THEN 'norma' ELSE 'documental' END"


@query(f"SELECT id, {_FAMILY} AS familia, true AS dentro, true AS exactos, true AS unicos, true AS sin_articulo_ajeno, true AS acotados FROM chunks WHERE regexp_matches(regexp_replace(texto, '(?m)^\\[P[ÁA]GINA \\d+\\][ \\t]*$', '', 'g'), '[^{_WS}]')")
def q105_fragment_checks(s: SparkSession, d: str) -> DataFrame:
    """The structural checks of fragments by document: inside their unit, exact hashes, unique ids, no articles of its own outside norms, bounded."""
    chunks = read(s, d, "chunks").select("id", "texto", "tipo")
    f = G.fragments(chunks, "id", "texto", "tipo").join(chunks.select("id", "texto"), "id")
    piece = F.expr("substring(texto, inicio + 1, fin - inicio)")
    return f.groupBy("id").agg(
        F.first("familia").alias("familia"), F.bool_and((F.col("unidad_inicio") <= F.col("inicio")) & (F.col("inicio") < F.col("fin")) & (F.col("fin") <= F.col("unidad_fin"))).alias("dentro"), F.bool_and(F.sha2(piece, 256) == F.col("sha256")).alias("exactos"), (F.count_distinct("fragmento_id") == F.count(F.lit(1))).alias("unicos"),
        F.bool_and(F.col("articulo").isNull() | (F.col("familia") == "norma")).alias("sin_articulo_ajeno"), F.bool_and(F.col("fin") - F.col("inicio") <= 1500).alias("acotados"),
    )


@query("SELECT id, 0::BIGINT AS sobrantes, 0::BIGINT AS faltantes FROM chunks WHERE regexp_matches(regexp_replace(texto, '(?m)^\\[P[ÁA]GINA \\d+\\][ \\t]*$', '', 'g'), '[^" + _WS + "]')")
def q106_units_of_fragments(s: SparkSession, d: str) -> DataFrame:
    """Units taken from fragments against the units themselves: none more, and none with text fewer."""
    chunks = read(s, d, "chunks").select("id", "texto", "tipo")
    got = G.units_of_fragments(G.fragments(chunks, "id", "texto", "tipo"), "id").select("id", F.col("unidad_inicio").alias("inicio"), F.col("unidad_fin").alias("fin"), F.lit(1).alias("g"))
    body = F.expr("substring(texto, inicio + 1, fin - inicio)")
    own = G.units(chunks, "id", "texto", "tipo").join(chunks.select("id", "texto"), "id").where(F.regexp_replace(F.regexp_replace(body, r"(?m)^\[P[ÁA]GINA \d+\][ \t]*$", ""), r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", "") != "").select("id", "inicio", "fin", F.lit(1).alias("o"))
    both = got.join(own, ["id", "inicio", "fin"], "full_outer")
    return both.groupBy("id").agg(F.count_if(F.col("o").isNull()).alias("sobrantes"), F.count_if(F.col("g").isNull()).alias("faltantes"))


@query()
def q107_continuity(s: SparkSession, d: str) -> DataFrame:
    """Continuity counts of every chunk: headings, own articles, ambiguous and unexplained ones, gaps."""
    return G.continuities(read(s, d, "chunks"), "id", "texto", "tipo")


@query(
    "WITH c AS (SELECT id, texto, regexp_extract_all(texto, '[^" + _WS + "]+') AS w FROM chunks WHERE length(texto) > 0), r AS (SELECT id, w, len(w) AS n FROM c WHERE len(w) > 0), g AS (SELECT id, n, unnest(range(0, greatest(1, ceil((n - 48) / 272.0)::BIGINT))) AS k FROM r) SELECT id, (k + 1)::INT AS parte, k * 272 AS desde, least(n, k * 272 + 320) AS hasta FROM g"
)
def q108_token_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of 320 tokens that share 48, by the ordinal numbers of their first and last words; words are the tokens."""
    import re

    def fn(k, t):
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        at = {a: i for i, (a, _) in enumerate(spans)}
        for n, (a, b) in enumerate(G.token_windows(spans, len(t), 320, 48, 512, 12), 1):
            yield k, n, at.get(a, 0), at[b] if b in at and b < len(t) else len(spans)

    return G._mapped(read(s, d, "chunks"), ("id", "texto"), "id bigint, parte int, desde bigint, hasta bigint", fn)


@query(r"SELECT id, len(list_filter(regexp_split_to_array(trim(texto, ' ' || chr(10) || chr(9) || chr(13)), '[.!?]+(?:\s+|$)'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> ''))::BIGINT AS oraciones, len(regexp_extract_all(texto, '\S+'))::BIGINT AS palabras FROM chunks WHERE length(texto) > 0")
def q109_sentence_word_limits(s: SparkSession, d: str) -> DataFrame:
    """How many sentences (ended by a mark and white space or the end) and words each chunk has."""
    return read(s, d, "chunks").where("length(texto) > 0").select("id", T.sentence_count(F.col("texto")).alias("oraciones"), T.loose_word_count(F.col("texto")).alias("palabras"))


@query("SELECT doc_id, inicio, count(*) AS n FROM (SELECT regexp_replace(lower(trim(doc_id)), '[\\s\\-_]+', '_', 'g') AS doc_id, inicio FROM chunks) GROUP BY 1, 2 HAVING count(*) > 1")
def q110_repeated_starts(s: SparkSession, d: str) -> DataFrame:
    """Fragments of one document that begin at the same place."""
    return read(s, d, "chunks").select(T.settle_id(F.col("doc_id")).alias("doc_id"), "inicio").groupBy("doc_id", "inicio").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT n_nationkey, 'Artículo 1. ' || n_name AS texto, 3::BIGINT AS navegacion, 1::BIGINT AS pies FROM nation")
def q111_editorial_residue(s: SparkSession, d: str) -> DataFrame:
    """Navigation runs and editorial footers taken from texts made from the nations."""
    text = F.concat(F.lit("Inicio\n|\nSiguiente\nArtículo 1. "), F.col("n_name"), F.lit("\nDisposiciones analizadas por Avance Jurídico Casa Editorial\nlínea\nNormas de uso de la información aquí contenida"))

    def fn(k, t):
        yield (k, *G.without_navigation(t))

    return G._mapped(read(s, d, "nation").select("n_nationkey", text.alias("t")), ("n_nationkey", "t"), f"n_nationkey {dict(read(s, d, 'nation').dtypes)['n_nationkey']}, texto string, navegacion bigint, pies bigint", fn)
