"""Evaluation: retrieval against references, evidence with headers, policies on answers, totals and comparisons of versions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import citations as C


def reference_recall(ranking: DataFrame, found: DataFrame, reference: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(q, referencias, recall_k...): the share of each question's references (q, clave) that the first k ranked texts stand for.

    ranking(q, id, rango), found(id, clave).  A question without references has none to recall and no row.
    """
    best = ranking.where(F.col("rango") <= max(cuts)).join(found, "id").groupBy("q", "clave").agg(F.min("rango").alias("_r"))
    hit = reference.select("q", "clave").distinct().join(best, ["q", "clave"], "left")
    n = F.count(F.lit(1))
    return hit.groupBy("q").agg(n.alias("referencias"), *[F.round(F.count_if(F.col("_r") <= k) / n, 6).alias(f"recall_{k}") for k in cuts])


def first_hits(ranking: DataFrame, found: DataFrame, reference: DataFrame, cut: int = 10) -> DataFrame:
    """(q, puesto): the rank of the first text among ``cut`` that holds a reference of each question that has any; null if none does."""
    hit = ranking.where(F.col("rango") <= cut).join(found, "id").join(reference.select("q", "clave").distinct(), ["q", "clave"], "left_semi")
    return reference.select("q").distinct().join(hit.groupBy("q").agg(F.min("rango").alias("puesto")), "q", "left")


def backing_metrics(hits: DataFrame, cut: int = 10) -> DataFrame:
    """(evaluables, respaldo, mrr) of first hits: the share of questions with one, and the mean reciprocal rank."""
    p = F.when(F.col("puesto") <= cut, F.col("puesto"))
    return hits.agg(F.count(F.lit(1)).alias("evaluables"), F.round(F.try_divide(F.count(p).cast("double"), F.count(F.lit(1)).cast("double")), 6).alias("respaldo"), F.round(F.try_divide(F.coalesce(F.sum(1.0 / p), F.lit(0.0)), F.count(F.lit(1)).cast("double")), 6).alias("mrr"))


def probe_metrics(ranks: DataFrame) -> DataFrame:
    """(sondas, recall_1, recall_5, recall_10, mrr_10) of probes' ranks (puesto, null if not found)."""
    p, n = F.col("puesto"), F.count(F.lit(1)).cast("double")
    return ranks.agg(F.count(F.lit(1)).alias("sondas"), *[F.round(F.count_if(p <= k) / n, 6).alias(f"recall_{k}") for k in (1, 5, 10)], F.round(F.coalesce(F.sum(F.when(p <= 10, 1.0 / p)), F.lit(0.0)) / n, 6).alias("mrr_10"))


def transition(before: Column, after: Column) -> Column:
    """How a question fared from one version to the next."""
    return F.when(before & after, "igual_bien").when(~before & ~after, "igual_mal").when(after, "arreglada").otherwise("rota")


def compared(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, antes, despues, cambio) of two versions' truth values by key; a version that lacks a key counts as false there."""
    a, b = first.select(F.col(key), F.col(value).alias("antes")), second.select(F.col(key), F.col(value).alias("despues"))
    no = lambda c: F.coalesce(c, F.lit(False))
    joined = a.join(b, key, "full_outer").select(key, no("antes").alias("antes"), no("despues").alias("despues"))
    return joined.withColumn("cambio", transition(F.col("antes"), F.col("despues")))


def total(components: DataFrame) -> DataFrame:
    """(obtenidos, posibles) of components(puntos, maximo): those without points don't count as possible."""
    there = F.col("puntos").isNotNull()
    return components.agg(F.round(F.coalesce(F.sum("puntos"), F.lit(0.0)), 2).alias("obtenidos"), F.coalesce(F.sum(F.when(there, F.col("maximo"))), F.lit(0.0)).alias("posibles"))


# ---- headers that name a document --------------------------------------------------------------------------------------

#: Longest header, longest line looked at, and how far into a text headers and broken headers are looked for.
HEADER, LINE, REACH, BROKEN_REACH = 700, 600, 12_000, 4_000
_LINE = re.compile(r"[^\n]+")


def header_span(text: str, own: frozenset[tuple]) -> tuple[int, int] | None:
    """The literal stretch at a text's head that names the document by its bodies.

    The first run of lines that names all bodies which single lines name; if none is short enough, the line with a code's
    name, else the first; if no line names one, the shortest run of lines that names most of them together.
    """
    if not own:
        return None
    named = [(m.start(), m.end(), own & C.bodies_of(C.extract(m.group()))) for m in _LINE.finditer(text[:REACH]) if len(m.group()) <= LINE]
    named = [x for x in named if x[2]]
    if named:
        goal = frozenset().union(*(h for *_, h in named))
        for i, (a, *_) in enumerate(named):
            seen: set = set()
            for _, b, h in named[i:]:
                if b - a > HEADER:
                    break
                seen |= h
                if seen == goal:
                    return a, b
        a, b, _ = min(named, key=lambda x: (all(body[0] not in C.NAMES for body in x[2]), x[0]))
        return a, b
    lines = [m.span() for m in _LINE.finditer(text[:BROKEN_REACH])]
    runs = [(a, b, len(own & C.bodies_of(C.extract(text[a:b])))) for i, (a, _) in enumerate(lines) for _, b in lines[i:] if b - a <= HEADER]
    runs = [r for r in runs if r[2]]
    if not runs:
        return None
    full = [r for r in runs if r[2] == len(own)]
    a, b, _ = min(full or runs, key=lambda r: (r[1] - r[0], r[0]))
    return a, b


def headers(documents: DataFrame) -> DataFrame:
    """(doc_id, tipo_evidencia, inicio, fin, texto): how each of documents(doc_id, tipo, numero, anio, titulo, texto) names itself.

    A literal stretch of its text, else its title or the names of its bodies if those say all of them; none otherwise.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, k, n, y, title, text in zip(f.doc_id, f.tipo, f.numero, f.anio, f.titulo, f.texto):
                own = C.identity(k, n, None if pd.isna(y) else int(y), title)
                span = header_span(text or "", own)
                if span:
                    rows.append((d, "cabecera_fuente", *span, text[span[0] : span[1]]))
                    continue
                names = "; ".join(filter(None, (_name(b) for b in sorted(own, key=lambda b: (b[0] not in C.NAMES, str(b))))))
                for said in ((title or "").strip(), names):
                    if said and own and own <= C.bodies_of(C.extract(said)):
                        rows.append((d, "cabecera_normalizada", None, None, said))
                        break
            yield pd.DataFrame(rows, columns=["doc_id", "tipo_evidencia", "inicio", "fin", "texto"]).astype({"inicio": "Int64", "fin": "Int64"})

    return documents.select("doc_id", "tipo", "numero", "anio", "titulo", "texto").mapInPandas(run, "doc_id string, tipo_evidencia string, inicio bigint, fin bigint, texto string")


def _name(body: tuple) -> str | None:
    kind, number, year = body
    if kind in C.NAMES:
        return C.NAMES[kind]
    if kind == "jurisprudencia":
        return f"Sentencia {number} de {year}"
    return f"{C.KIND_NAMES[kind]} {number} de {year}" if kind in C.KIND_NAMES and number and year else None


def evidence(passages: DataFrame, own: DataFrame, said: DataFrame, heads: DataFrame, units: int = 5) -> DataFrame:
    """(q, lugar, tipo_evidencia, doc_id, texto): the first passages of each question, each after its document's header if its text doesn't name the document.

    passages(q, orden, doc_id, id, texto), own(doc_id, clave), said(id, clave) the bodies that passages cite, heads(doc_id,
    tipo_evidencia, texto).
    """
    kept = passages.where(F.col("orden") <= units)
    lacks = kept.select("q", "orden", "doc_id", "id").join(own, "doc_id").join(said, ["id", "clave"], "left_anti").select("q", "orden", "doc_id").distinct()
    before = lacks.join(heads, "doc_id").select("q", "orden", F.lit(0).alias("_s"), "tipo_evidencia", "doc_id", "texto")
    rows = before.unionByName(kept.select("q", "orden", F.lit(1).alias("_s"), F.lit("unidad").alias("tipo_evidencia"), "doc_id", "texto"))
    return rows.select("q", F.row_number().over(Window.partitionBy("q").orderBy("orden", "_s")).alias("lugar"), "tipo_evidencia", "doc_id", "texto")


# ---- policies on answers -------------------------------------------------------------------------------------------------

# Fixed value: why an option is discarded where the answer gives no reason.
NO_REASON = "No corresponde al supuesto descrito en la pregunta."


def completed(letters: Column, answer: Column, reasons: Column) -> Column:
    """struct(respuesta, descarte) of a closed item: the first letter where the answer is none of them, and a reason for every other letter."""
    given = F.when(F.array_contains(letters, answer), answer).otherwise(F.get(letters, F.lit(0)))
    rest = F.filter(F.array_sort(letters), lambda x: x != given)
    why = F.transform(rest, lambda x: F.coalesce(F.nullif(F.trim(F.try_element_at(reasons, x)), F.lit("")), F.lit(NO_REASON)))
    return F.struct(given.alias("respuesta"), F.map_from_arrays(rest, why).alias("descarte"))


def compatible(stored: Column, wanted: dict[str, object]) -> Column:
    """Whether a stored configuration (a map of strings) has every wanted value; a missing one is no match."""
    return reduce(Column.__and__, [F.coalesce(F.try_element_at(stored, F.lit(k)) == F.lit(str(v)), F.lit(False)) for k, v in wanted.items()], F.lit(True))


def markdown(columns: list[str]) -> Column:
    """A row as a line of a Markdown table; bars inside cells are escaped, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))


# ---- term weights --------------------------------------------------------------------------------------------------------


def grams(tokens: Column) -> Column:
    """The words of two letters or more of a text and their pairs."""
    words = F.filter(tokens, lambda w: F.length(w) >= 2)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def tfidf_top(docs: DataFrame, key: str, words: Column, queries: DataFrame, qid: str, qwords: Column, k: int) -> DataFrame:
    """(q, key, puntaje, rango): cosine of term weights over words and pairs: count times ln((1 + n) / (1 + df)) + 1.

    Weights and lengths are aggregates over (text, term); the queries' terms pick what is joined for scores.
    """
    p = docs.select(key, F.explode(grams(words)).alias("t")).groupBy(key, "t").agg(F.count(F.lit(1)).alias("f"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = p.groupBy("t").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("t", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = p.join(idf, "t").select(key, "t", (F.col("f") * F.col("idf")).alias("w"))
    length = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    asked = queries.select(F.col(qid).alias("q"), F.explode(grams(qwords)).alias("t")).groupBy("q", "t").agg(F.count(F.lit(1)).alias("f")).join(idf, "t").select("q", "t", (F.col("f") * F.col("idf")).alias("u"))
    norm = asked.groupBy("q").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("m"))
    dots = weighted.join(asked, "t").groupBy("q", key).agg(F.sum(F.col("w") * F.col("u")).alias("s"))
    scored = dots.join(length, key).join(norm, "q").select("q", key, F.round(F.col("s") / (F.col("l") * F.col("m")), 6).alias("puntaje"))
    w = Window.partitionBy("q").orderBy(F.desc("puntaje"), key)
    return scored.withColumn("rango", F.row_number().over(w)).where(F.col("rango") <= k)
