"""Citations: extraction as (cuerpo, numero, anio, articulo), graph references, document identity, scores and closure.

Two extractors with different rules: ``extracted`` reads answers and bases (codes by name, article numbers beside a
norm), which needs positions and so runs over Arrow batches; ``references`` reads whole corpora for the citation graph and
is built-in expressions only.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import checkpointed

# The wordings of each kind of norm.
KINDS = {
    "ley": ("ley", "leyes"),
    "decreto": ("decreto ley", "decreto-ley", "decreto legislativo", "decreto unico reglamentario", "decreto reglamentario", "decreto"),
    "acto_legislativo": ("acto legislativo",),
    "resolucion": ("resolucion",),
    "circular": ("circular externa", "circular"),
    "acuerdo": ("acuerdo",),
}
# Codes and the names they are cited by.
CODES = {
    "constitucion": ("constitucion politica", "constitucion nacional", "constitucion", "c.p.", "cp", "c.n.", "carta politica"),
    "codigo_civil": ("codigo civil", "c.c.", "cc", "c.c"),
    "codigo_penal": ("codigo penal", "ley 599 de 2000", "c.p.p", "codigo penal colombiano"),
    "codigo_procedimiento_penal": ("codigo de procedimiento penal", "ley 906 de 2004", "cpp"),
    "codigo_comercio": ("codigo de comercio", "codigo del comercio", "c.co.", "cco"),
    "codigo_sustantivo_trabajo": ("codigo sustantivo del trabajo", "c.s.t.", "cst"),
    "codigo_procesal_trabajo": ("codigo procesal del trabajo", "cpts", "cpt"),
    "codigo_general_proceso": ("codigo general del proceso", "ley 1564 de 2012", "cgp"),
    "cpaca": ("codigo de procedimiento administrativo y de lo contencioso administrativo", "ley 1437 de 2011", "cpaca"),
    "estatuto_tributario": ("estatuto tributario", "decreto 624 de 1989", "e.t.", "et"),
    "codigo_infancia": ("codigo de la infancia y la adolescencia", "ley 1098 de 2006"),
    "codigo_nacional_policia": ("codigo nacional de seguridad y convivencia ciudadana", "codigo nacional de policia", "ley 1801 de 2016"),
    "codigo_disciplinario": ("codigo general disciplinario", "codigo disciplinario unico", "ley 1952 de 2019"),
    "estatuto_consumidor": ("estatuto del consumidor", "estatuto de proteccion al consumidor", "ley 1480 de 2011"),
    "decision_andina_486": ("decision 486 de la comision de la comunidad andina", "decision andina 486", "decision 486"),
}
# Norms that are a code, by kind and number.
NUMBERED = {
    ("ley", "599"): "codigo_penal",
    ("ley", "906"): "codigo_procedimiento_penal",
    ("ley", "1564"): "codigo_general_proceso",
    ("ley", "1437"): "cpaca",
    ("ley", "1098"): "codigo_infancia",
    ("ley", "1801"): "codigo_nacional_policia",
    ("ley", "1952"): "codigo_disciplinario",
    ("decreto", "624"): "estatuto_tributario",
    ("ley", "1480"): "estatuto_consumidor",
}
# Names of codes in full, and of kinds.
NAMES = {
    "constitucion": "Constitución Política", "codigo_civil": "Código Civil", "codigo_penal": "Código Penal", "codigo_procedimiento_penal": "Código de Procedimiento Penal", "codigo_comercio": "Código de Comercio", "codigo_sustantivo_trabajo": "Código Sustantivo del Trabajo", "codigo_procesal_trabajo": "Código Procesal del Trabajo", "codigo_general_proceso": "Código General del Proceso",
    "cpaca": "Código de Procedimiento Administrativo y de lo Contencioso Administrativo", "estatuto_tributario": "Estatuto Tributario", "codigo_infancia": "Código de la Infancia y la Adolescencia", "codigo_nacional_policia": "Código Nacional de Policía", "codigo_disciplinario": "Código General Disciplinario", "estatuto_consumidor": "Estatuto del Consumidor", "decision_andina_486": "Decisión 486 de la Comisión de la Comunidad Andina",
}
KIND_NAMES = {"ley": "Ley", "decreto": "Decreto", "acto_legislativo": "Acto Legislativo", "resolucion": "Resolución", "circular": "Circular", "acuerdo": "Acuerdo"}

# How norms, judgments and articles are written; the reach in characters of an article beside a norm.
_WORDINGS = "|".join(sorted((w for ws in KINDS.values() for w in ws), key=len, reverse=True)).replace(" ", r"\s+")
_SIGN = r"\s*(?:n[°ºo]?\.?\s*)?"
NORM = rf"\b({_WORDINGS}){_SIGN}(\d{{1,5}})\s*(?:de|del|/|-)\s*(\d{{4}})\b"
BARE = rf"\b(ley|decreto){_SIGN}(\d{{2,5}})\b"
JUDGMENT = r"\b(c|t|su|sl|sc|sp|stc|stl|ac|au)\s*[-\s]?\s*(\d{1,5})\s*(?:de|del|/|-)\s*(\d{2,4})\b"
MENTION = r"\b(?:arts?\b\.?|art[ií]culos?\b)"
NUMBERS = r"^[\s:.,;\-]*(\d+[a-z]?(?:\s*(?:,|y|e)\s*\d+[a-z]?)*)"
BEFORE, AFTER, LISTED = 90, 60, 40

_NORM, _JUDGMENT, _MENTION, _NUMBERS = re.compile(NORM), re.compile(JUDGMENT), re.compile(MENTION), re.compile(NUMBERS)
_BARE = re.compile(BARE + r"(?!\s*(?:de|del|/|-)\s*\d{4})")
_NUMBER = re.compile(r"\d+[a-z]?")
_KIND = {re.sub(r"[\s-]+", " ", w): k for k, ws in KINDS.items() for w in ws}
_NAMED = {c: [(n, re.compile(r"(?<![\w.])" + re.escape(n).replace(r"\ ", r"\s+") + r"(?!\w)")) for n in sorted(ns, key=len, reverse=True)] for c, ns in CODES.items()}

CITE = "cuerpo string, numero string, anio string, articulo string"


def plain(text: str) -> str:
    """Lower case without accents, white space collapsed and trimmed."""
    low = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn") if not text.isascii() else text
    return " ".join(low.lower().split())


class _Articles:
    """Where a text names articles; looked up by the place of a norm."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans = [m.span() for m in _MENTION.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def _listed(self, a: int, b: int) -> list[str]:
        m = _NUMBERS.match(self.text[a:b])
        return _NUMBER.findall(m.group(1)) if m else []

    def beside(self, a: int, b: int) -> list[str]:
        """The numbers of the last mention before a norm, unless a sentence or clause ends between, and of the next one if only marks stand between."""
        out: list[str] = []
        i = bisect_left(self.starts, a) - 1
        if i >= 0 and self.starts[i] >= a - BEFORE and not {".", ";"} & set(self.text[self.spans[i][1] : a]):
            out += self._listed(self.spans[i][1], a)
        i = bisect_left(self.starts, b)
        if i < len(self.starts) and self.spans[i][1] <= b + AFTER and not any(c.isalnum() or c == "_" for c in self.text[b : self.starts[i]]):
            out += self._listed(self.spans[i][1], min(b + AFTER, self.spans[i][1] + LISTED))
        return out


def _bodies_at(text: str) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, body) of everything cited in a plain text."""
    for m in _NORM.finditer(text):
        kind = _KIND[re.sub(r"[\s-]+", " ", m.group(1))]
        code = NUMBERED.get((kind, m.group(2)))
        yield m.start(), m.end(), (code, None, None) if code else (kind, m.group(2), m.group(3))
    for m in _BARE.finditer(text):
        if code := NUMBERED.get((m.group(1), m.group(2))):
            yield m.start(), m.end(), (code, None, None)
    for code, names in _NAMED.items():
        for name, pattern in names:
            # a code's longest name that occurs stands for all its names
            spans = [m.span() for m in pattern.finditer(text)] if name.split(" ")[0] in text else []
            if spans:
                yield from ((a, b, (code, None, None)) for a, b in spans)
                break


def extract(text: str | None) -> set[tuple]:
    """The distinct (cuerpo, numero, anio, articulo) that a text cites; none for null and empty texts."""
    t = plain(text or "")
    found: set[tuple] = set()
    articles = None
    for a, b, body in _bodies_at(t):
        articles = articles or _Articles(t)
        found.update((*body, n) for n in articles.beside(a, b) or [None])
    for m in _JUDGMENT.finditer(t):
        year = m.group(3) if len(m.group(3)) != 2 else ("20" if int(m.group(3)) < 50 else "19") + m.group(3)
        found.add(("jurisprudencia", f"{m.group(1).upper()}-{int(m.group(2))}", year, None))
    return found


def bodies_of(cites: set[tuple]) -> set[tuple]:
    return {c[:3] for c in cites}


def extracted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cuerpo, numero, anio, articulo): one row for each distinct citation of each row's text.  A narrow map."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *c) for k, t in zip(f[key], f[text]) for c in sorted(extract(t), key=str)]
            yield pd.DataFrame(rows, columns=[key, "cuerpo", "numero", "anio", "articulo"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, {CITE}")


def body_key(prefix: str = "") -> Column:
    """A citation's body as one string: kind, number and year joined by bars, what is missing left out."""
    return F.concat_ws("|", f"{prefix}cuerpo", f"{prefix}numero", f"{prefix}anio")


def bodies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clave): the distinct bodies that each row's text cites."""
    return extracted(df, key, text).select(key, body_key().alias("clave")).distinct()


def body_sets(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(key, name): the sorted array of a row's bodies; rows that cite none are left out."""
    return extracted(df, key, text).groupBy(key).agg(F.array_sort(F.collect_set(body_key())).alias(name))


def score(answer: Column, basis: Column, backed: Column) -> Column:
    """An answer's bodies against those of its basis and of the passages shown: counts, recall and precision (null without base).

    Hits are in the basis; what isn't is incorrect if a passage backs it, else unbacked.
    """
    n = lambda a: F.size(a).cast("bigint")
    hits, others = F.array_intersect(answer, basis), F.array_except(answer, basis)
    return F.struct(
        n(basis).alias("n_ref"), n(answer).alias("n_citadas"), n(hits).alias("aciertos"), n(F.array_intersect(hits, backed)).alias("respaldados"), n(F.array_except(hits, backed)).alias("no_respaldados"),
        n(F.array_intersect(others, backed)).alias("incorrectas"), n(F.array_except(others, backed)).alias("sin_respaldo"),
        F.round(F.try_divide(n(hits).cast("double"), n(basis).cast("double")), 6).alias("recall"), F.round(F.try_divide(n(hits).cast("double"), n(answer).cast("double")), 6).alias("precision"),
    )


def index(items: DataFrame, points: float = 20.0) -> DataFrame:
    """The citation index of a submission: items(basis, answer, backed arrays, abstains) in one row.

    Items without a citable basis don't count; one that abstains or is missing adds to the references only.  Weighted
    recall (an unbacked hit counts half) less twice the rate of unbacked citations, never below zero, times the points.
    """
    none = F.array().cast("array<string>")
    rows = items.where(F.size("basis") > 0).select(score(F.when(F.col("abstains"), none).otherwise(F.coalesce("answer", none)), F.col("basis"), F.coalesce("backed", none)).alias("s")).select("s.*")
    sums = rows.agg(F.count(F.lit(1)).alias("items"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_ref", "n_citadas", "aciertos", "respaldados", "no_respaldados", "incorrectas", "sin_respaldo")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    recall, rate = ratio(F.col("respaldados") + 0.5 * F.col("no_respaldados"), F.col("n_ref")), ratio(F.col("sin_respaldo"), F.col("n_citadas"))
    gross = F.greatest(F.lit(0.0), recall - 2 * rate)
    return sums.select("*", F.round(recall, 4).alias("recall_ponderado"), F.round(rate, 4).alias("tasa_sin_respaldo"), F.round(gross, 4).alias("indice"), F.round(points * gross, 2).alias("puntos"))


# ---- graph references ------------------------------------------------------------------------------------------------

# How a corpus names norms and judgments.
_MONTH = r"(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)"
GRAPH_NORM = (
    r"(?i)\b(ley(?:\s+estatutaria|\s+org[aá]nica)?|decreto(?:[\s-]+ley|\s+legislativo|\s+reglamentario|\s+[uú]nico(?:\s+reglamentario)?)?|acto\s+legislativo)\s+(?:n[uú]mero\s+|no\.?\s*|n[°º]\.?\s*)?"
    rf"(\d{{1,2}}(?:\.\d{{3}})+|\d{{1,5}})\s*(?:de|del)\s+(?:\d{{1,2}}\s+de\s+{_MONTH}\s+(?:de|del)\s+)?(\d{{4}})\b"
)
GRAPH_CC = r"\b(SU|C|T)\s*[-.]?\s*(\d{1,4})\s*(?:/|de|del)\s*((?:19|20)\d{2}|\d{2})\b"
GRAPH_CC_DASH = r"\b([Ss][Uu]|[CcTt])\s*[-.]\s*(\d{1,4})\s*-\s*((?:19|20)\d{2}|\d{2})\b"
GRAPH_CSJ = r"\b(SL|SC|SP|STL|STC|STP|AL|AC|AP)\s?-?\s?(\d{2,5})\s*-\s*((?:19|20)\d{2})\b"
#: A bill: its number is the proceeding's, no norm's.
BILL_AFTER = r"[\s,\-–—(]*(?:de\s+(?:la|el)\s+)?(?:Senado|C[aá]mara)\b"


def references(text: Column) -> Column:
    """Every reference of a text as keys like the corpus's document ids, repeated as often as they occur; built-in only.

    Norms of 1821 to 2026, bills excluded, dotted numbers read; judgments of both courts, two-digit years from 91 on
    belong to the last century.  Null gives null.
    """
    hard = "\u00a0\u2007\u202f"
    text = F.when(text.rlike(f"[{hard}]"), F.translate(text, hard, "   ")).otherwise(text)
    part = lambda p, i: lambda x: F.regexp_extract(x, p, i)
    bills = T.any_case(rf"(?i)proyecto\s{{1,9}}de\s{{0,9}}{GRAPH_NORM}")
    laws = lambda t: F.when(t.rlike("(?i)proyecto"), F.regexp_replace(t, bills, " ")).otherwise(t)
    norm = T.any_case(rf"{GRAPH_NORM}(?!(?i:{BILL_AFTER}))")
    wording = T.any_case(GRAPH_NORM)
    kind = lambda x: F.when(F.lower(x).startswith("acto"), "acto_legislativo").when(F.lower(x).startswith("decreto"), "decreto").otherwise("ley")

    def one(x: Column) -> Column:
        number = F.regexp_replace(part(wording, 2)(x), r"\.", "").cast("bigint")
        year = part(wording, 3)(x).cast("int")
        return F.when(year.between(1821, 2026) & (number > 0), F.concat_ws("_", kind(x), number.cast("string"), year.cast("string")))

    def judgment(p: str) -> callable:
        def f(x: Column) -> Column:
            y, number = part(p, 3)(x).cast("int"), part(p, 2)(x).cast("int")
            year = F.when(y > 100, y).when(y >= 91, 1900 + y).otherwise(2000 + y)
            return F.when(year.between(1992, 2026) & (number > 0), F.concat(F.lit("sentencia_cc_"), F.lower(part(p, 1)(x)), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")), F.lit("_"), year.cast("string")))

        return f

    def supreme(x: Column) -> Column:
        year = part(GRAPH_CSJ, 3)(x).cast("int")
        return F.when(year.between(1990, 2026), F.concat(F.lit("sentencia_csj_"), F.lower(part(GRAPH_CSJ, 1)(x)), part(GRAPH_CSJ, 2)(x).cast("int").cast("string"), F.lit("_"), year.cast("string")))

    # judgments are looked for in one pass; what each is, its own few characters tell
    every = f"(?=[ASCTsct])(?:{GRAPH_CC}|{GRAPH_CC_DASH}|{GRAPH_CSJ})"
    court = lambda x: F.when(x.rlike(f"^{GRAPH_CC}$"), judgment(GRAPH_CC)(x)).when(x.rlike(f"^{GRAPH_CC_DASH}$"), judgment(GRAPH_CC_DASH)(x)).otherwise(supreme(x))
    found = lambda t: F.concat(F.transform(F.regexp_extract_all(laws(t), F.lit(norm), F.lit(0)), one), F.transform(F.regexp_extract_all(t, F.lit(every), F.lit(0)), court))
    return F.array_compact(T.once(text, found))


def reference_name(key: Column) -> Column:
    """A reference's name in words."""
    cc, csj = r"^sentencia_cc_([a-z]+)(\d+)_(\d{4})$", r"^sentencia_csj_([a-z]+)(\d+)_(\d{4})$"
    g = lambda p, i: F.regexp_extract(key, p, i)
    norm = r"^([a-z_]+?)_(\d+)_(\d{4})$"
    kind = F.regexp_replace(g(norm, 1), "_", " ")
    return (
        F.when(key.rlike(cc), F.concat(F.lit("Sentencia "), F.upper(g(cc, 1)), F.lit("-"), g(cc, 2), F.lit(" de "), g(cc, 3)))
        .when(key.rlike(csj), F.concat(F.lit("Sentencia "), F.upper(g(csj, 1)), g(csj, 2), F.lit("-"), g(csj, 3)))
        .otherwise(F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 99), F.lit(" "), g(norm, 2), F.lit(" de "), g(norm, 3)))
    )


def inventory_key(doc_id: Column) -> Column:
    """A document's id as references spell it: without the country's prefix."""
    return F.regexp_replace(doc_id, "^co_", "")


def graph(cites: DataFrame, source: str, target: str, known: DataFrame | None = None, areas: DataFrame | None = None, primary: DataFrame | None = None) -> DataFrame:
    """One row per cited norm: citing documents, mentions, those among primary sources, four chief areas, first five citers, whether it is known.

    cites holds a row per mention.  Counting combines before the shuffle: (target, source) first, then target; examples
    and areas are ranked lists of bounded length, never collected groups.  The pairs are written once and read for each.
    """
    per = checkpointed(cites.groupBy(target, source).agg(F.count(F.lit(1)).alias("m")))
    if primary is not None:
        per = per.join(primary.select(F.col(primary.columns[0]).alias(source), F.lit(1).alias("_p")).distinct(), source, "left")
    else:
        per = per.withColumn("_p", F.lit(None).cast("int"))
    out = per.groupBy(target).agg(F.count(F.lit(1)).alias("documentos"), F.sum("m").alias("menciones"), F.count("_p").alias("primarias"))
    w = Window.partitionBy(target)
    first = per.select(target, source).withColumn("r", F.row_number().over(w.orderBy(source))).where("r <= 5").groupBy(target).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(source).cast("string").alias("s")))), lambda x: x["s"]), ", ").alias("primeros"))
    out = out.join(first, target)
    if areas is not None:
        by_area = per.join(areas, source).groupBy(target, "area").agg(F.sum("m").alias("n"))
        ranked = by_area.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "area"))).where("r <= 4").groupBy(target).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "area"))), lambda x: x["area"]), ", ").alias("areas"))
        out = out.join(ranked, target, "left")
    if known is not None:
        out = out.join(known.select(inventory_key(F.col(known.columns[0])).alias(target)).distinct().withColumn("_k", F.lit(True)), target, "left").withColumn("en_corpus", F.col("_k").isNotNull()).drop("_k")
    return out


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from seeds over (de, a): anti-join rounds until nothing is new; lineage is cut in the shared folder.

    The number of rounds is the depth of the graph; each moves only its frontier.
    """
    reached = checkpointed(seeds.select("nodo").distinct())
    frontier = reached
    while True:
        frontier = checkpointed(frontier.join(edges, F.col("nodo") == F.col("de")).select(F.col("a").alias("nodo")).distinct().join(reached, "nodo", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = checkpointed(reached.unionByName(frontier))


# ---- identity, names and sentences -----------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def identity(kind: str | None, number: str | None, year: int | None, title: str | None) -> frozenset[tuple]:
    """The bodies by which a document is known: from its kind, number and year; a code's also from a title that is the code's name."""
    k, t = (kind or "").replace("_", " "), plain(title or "")
    if k == "constitucion":
        own = {("constitucion", None, None)}
    elif k in ("ley", "decreto", "decreto ley", "acto legislativo", "resolucion", "circular", "acuerdo"):
        own = bodies_of(extract(f"{k} {number} de {year}"))
    elif k == "decision" and str(number) == "486":
        own = {("decision_andina_486", None, None)}
    elif k in ("sentencia", "auto"):
        own = bodies_of(extract(f"Sentencia {number} de {year}"))
    else:
        own = bodies_of(extract(title))
    if t.startswith(("codigo", "estatuto", "constitucion")):
        named = {b for b in bodies_of(extract(t)) if b[0] in NAMES}
        own |= named if len(named) == 1 else set()
    return frozenset(own)


def identities(documents: DataFrame) -> DataFrame:
    """(doc_id, cuerpo, numero, anio) of documents(doc_id, tipo, numero, anio, titulo); documents without a body have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, *b) for d, k, n, y, t in zip(f.doc_id, f.tipo, f.numero, f.anio, f.titulo) for b in sorted(identity(k, n, None if pd.isna(y) else int(y), t), key=str)]
            yield pd.DataFrame(rows, columns=["doc_id", "cuerpo", "numero", "anio"])

    return documents.select("doc_id", "tipo", "numero", "anio", "titulo").mapInPandas(run, "doc_id string, cuerpo string, numero string, anio string")


def body_name() -> Column:
    """A body's name that extraction reads back as the same body; null for kinds without one."""
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    kinds = F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv])
    c, n, y = F.col("cuerpo"), F.col("numero"), F.col("anio")
    return F.coalesce(names[c], F.when(c == "jurisprudencia", F.concat(F.lit("Sentencia "), n, F.lit(" de "), y)), F.concat(kinds[c], F.lit(" "), n, F.lit(" de "), y))


def sentences_of(cites: DataFrame, key: str) -> DataFrame:
    """(key, frase): the sentence that names a row's citations: norms in order of name, each with its articles."""
    named = cites.withColumn("nombre", body_name()).where("nombre IS NOT NULL").withColumn("_o", F.coalesce(F.regexp_extract("articulo", r"^\d+", 0).cast("bigint"), F.lit(0)))
    per = named.groupBy(key, "nombre").agg(F.transform(F.array_sort(F.collect_set(F.when(F.col("articulo").isNotNull(), F.struct("_o", "articulo")))), lambda x: x["articulo"]).alias("a"))
    n = F.size("a")
    listed = F.concat(F.array_join(F.slice("a", 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" y "), F.element_at("a", -1))
    part = F.when(n == 0, F.col("nombre")).when(n == 1, F.concat("nombre", F.lit(", artículo "), F.col("a")[0])).otherwise(F.concat("nombre", F.lit(", artículos "), listed))
    return per.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nombre", part.alias("p")))), lambda x: x["p"]), "; ").alias("frase"))


def backing(passages: DataFrame, key: str, rank: str, text: str, first: int = 10) -> DataFrame:
    """(key, clave): the bodies that the first passages of each row cite."""
    return bodies(passages.where(F.col(rank) <= first), key, text)


# ---- audit of answers against passages -------------------------------------------------------------------------------

# Norms as answers name them, and how an article stands beside them.
AUDIT_NORM = re.compile(r"\b(decreto(?:[\s\-‐‑–—]+ley)?|ley)\s+(\d+)\s+de\s+(\d{4})\b")
_ARTICLE_BEFORE = re.compile(r"articulo\s+(\d+(?:\.\d+)*[a-z]?)[º°]?\s+(?:de\s+la|de|del)\s*$")
_ARTICLE_AFTER = re.compile(r"\s*[,.:]?\s*articulo\s+(\d+(?:\.\d+)*[a-z]?)")


def spaced(text: object) -> str:
    """Plain text in which underscores are spaces too."""
    return " ".join(plain(str(text or "")).replace("_", " ").split())


def norm_key(name: str) -> str:
    """The key under which a catalogue holds a norm's name."""
    name = spaced(name)
    m = AUDIT_NORM.fullmatch(name)
    return f"{m.group(1)[:7] if m.group(1).startswith('decreto') else m.group(1)} {int(m.group(2))} de {m.group(3)}" if m else name


def catalogue(documents: DataFrame) -> DataFrame:
    """(alias, doc_id): the names of norms; an alias of two documents belongs to neither (doc_id null)."""
    kinds = ("ley", "decreto", "decreto ley", "decreto-ley", "constitucion", "decision")
    d = documents.where(F.col("tipo").isin(*kinds))
    names = d.select("doc_id", F.explode(F.array_compact(F.array(F.concat_ws(" ", "tipo", F.coalesce("numero", F.lit("")), F.lit("de"), F.coalesce(F.col("anio").cast("string"), F.lit(""))), F.nullif(F.trim("titulo"), F.lit(""))))).alias("nombre"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "alias": [norm_key(n) for n in f.nombre]})

    keyed = names.mapInPandas(run, "doc_id string, alias string").where("alias <> ''").distinct()
    return keyed.groupBy("alias").agg(F.when(F.count(F.lit(1)) == 1, F.first("doc_id")).alias("doc_id"))


def audit_answer(text: str, aliases: dict[str, str | None], passages: list[dict]) -> list[tuple]:
    """(norma, doc_id, articulo, respaldada) of each norm an answer names, held against its first ten passages.

    Longer names win over shorter ones that they contain.  A norm that the catalogue knows as none or as two documents is
    undetermined (null).  A passage backs a norm that it is part of or names, with the article if one is named: 42 isn't 420.
    """
    t = spaced(text)
    taken: list[tuple[int, int, str, str | None]] = [(m.start(), m.end(), m.group(), aliases.get(norm_key(m.group()))) for m in AUDIT_NORM.finditer(t)]
    for name in sorted((a for a in aliases if a in t), key=lambda a: (-len(a), a)):
        for m in re.finditer(r"(?<!\w)" + re.escape(name) + r"(?!\w)", t):
            if not any(m.start() < b and m.end() > a for a, b, _, _ in taken):
                taken.append((m.start(), m.end(), name, aliases[name]))
    shown = [(p.get("doc_id"), spaced(p.get("articulo")), spaced(p.get("texto"))) for p in passages[:10]]
    out = []
    for a, b, name, doc in sorted(taken, key=lambda x: x[:3]):
        m = _ARTICLE_BEFORE.search(t[max(0, a - 100) : a]) or _ARTICLE_AFTER.match(t[b : b + 70])
        article = m.group(1) if m else None
        backed = None
        if doc is not None:
            here = re.compile(r"(?<!\w)" + re.escape(name) + r"(?!\w)")
            said = article and re.compile(r"\barticulo\s+" + re.escape(article) + r"(?!\w|\.\d)")
            backed = any(body and (d in (doc, f"{doc}.txt") or here.search(body)) and (not article or label == article or said.search(body)) for d, label, body in shown)
        out.append((name, doc, article, backed))
    return out


def _edges(name: str) -> str:
    """A name without marks at its ends: the key by which answers and catalogue meet."""
    return re.sub(r"^\W+|\W+$", "", name)


def audited(answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, norma, doc_id, articulo, respaldada) of answers(id, texto, pasajes: array<struct<doc_id, articulo, texto>>).

    An answer meets only the names that it holds: its runs of words, up to the longest name's count, are joined with the
    catalogue by key.  Answers are what grows; the catalogue is never broadcast.
    """
    kind = dict(answers.dtypes)["id"]
    longest = aliases.agg(F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(0))).first()[0]

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = set()
            for i, t in zip(f["id"], f["texto"]):
                ws = spaced(t or "").split(" ")
                rows.update((i, _edges(" ".join(ws[a : a + n]))) for a in range(len(ws)) for n in range(1, longest + 1) if a + n <= len(ws))
                rows.update((i, norm_key(m.group())) for m in AUDIT_NORM.finditer(" ".join(ws)))
            yield pd.DataFrame(sorted(rows, key=str), columns=["id", "k"])

    edge = F.regexp_replace("alias", r"(?U)^\W+|\W+$", "")
    near = answers.select("id", "texto").mapInPandas(runs, f"id {kind}, k string").join(aliases.withColumn("k", edge), "k").select("id", "alias", "doc_id").distinct()
    joined = answers.join(near.groupBy("id").agg(F.collect_list(F.struct("alias", "doc_id")).alias("alias")), "id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t, ps, al in zip(f["id"], f["texto"], f["pasajes"], f["alias"]):
                known = {x["alias"]: x["doc_id"] for x in al} if al is not None else {}
                out += [(i, *c) for c in audit_answer(t or "", known, list(ps) if ps is not None else [])]
            yield pd.DataFrame(out, columns=["id", "norma", "doc_id", "articulo", "respaldada"])

    return joined.select("id", "texto", "pasajes", "alias").mapInPandas(run, f"id {kind}, norma string, doc_id string, articulo string, respaldada boolean")


def three_state(cites: DataFrame, inventory: DataFrame, complete: bool) -> DataFrame:
    """cites with estado: weak (the norm is in the inventory), missing (it isn't, and the inventory is complete), unknown otherwise."""
    there = inventory.select("clave").distinct().withColumn("_h", F.lit(True))
    return cites.join(there, "clave", "left").withColumn("estado", F.when(F.col("_h"), "debil").when(F.lit(complete), "ausente").otherwise("desconocido")).drop("_h")


# ---- cleaning answers ------------------------------------------------------------------------------------------------

_TILDES = {"a": "[aá]", "e": "[eé]", "i": "[ií]", "o": "[oó]", "u": "[uúü]", "n": "[nñ]"}


def accent_pattern(name: str) -> str:
    """A pattern for a plain name that accepts accents, any case and any white space."""
    return "(?i)" + "".join(_TILDES.get(c) or (r"\s+" if c == " " else re.escape(c)) for c in name)


# What a mention without backing is replaced by.
_JUDGMENT_WORDS, _NORM_WORDS, _CODE_WORDS = "la jurisprudencia aplicable", "la norma aplicable", "la legislación aplicable"
_MENTIONS = (
    (re.compile(r"(?i)\b(?:la\s+)?sentencia\s+(?:de\s+unificaci[oó]n\s+)?(?:C|T|SU|SL|SC|SP|STC|STL|STP|AC|AL|AP|AU)\s*-?\s*\d{1,5}\s*(?:de|del|/|-)\s*\d{2,4}\b"), _JUDGMENT_WORDS),
    (re.compile(r"(?i)\b(?:C|T|SU|SL|SC|SP|STC|STL)\s*-\s*\d{1,5}\s*(?:de|/|-)\s*\d{2,4}\b"), _JUDGMENT_WORDS),
    (re.compile(r"(?i)\b(?:la\s+|el\s+)?(?:ley|decreto(?:[\s-]+ley)?|acto\s+legislativo|resoluci[oó]n|acuerdo|circular(?:\s+externa)?)\s+(?:n[°ºo]\.?\s*)?\d{1,5}\s*(?:de|del|/|-)\s*\d{4}\b"), _NORM_WORDS),
)


def _unbacked(text: str, backed: set[tuple]) -> set[tuple]:
    return bodies_of(extract(text)) - backed


def without_mentions(sentence: str, backed: set[tuple]) -> str | None:
    """A sentence whose unbacked norms are spoken of in general terms; null if one is still named."""
    for pattern, general in _MENTIONS:
        sentence = pattern.sub(lambda m, g=general: g if _unbacked(m.group(), backed) else m.group(), sentence)
    for code in sorted({b[0] for b in _unbacked(sentence, backed)} & set(CODES)):
        for name in sorted(CODES[code], key=len, reverse=True):
            if len(name) > 4:  # shorter names are too ambiguous
                sentence = re.sub(r"(?i)(?<![\w.])(?:el\s+|la\s+)?" + accent_pattern(name).removeprefix("(?i)") + r"(?!\w)", _CODE_WORDS, sentence)
    return None if _unbacked(sentence, backed) else sentence


def cleaned(text: str, backed: set[tuple], keep: bool, split: callable) -> str:
    """An answer without unbacked citations: their sentences are dropped, or, if ``keep``, put in general terms where that removes them."""
    out = []
    for s in split(text.strip()):
        if not _unbacked(s, backed):
            out.append(s)
        elif keep and (general := without_mentions(s, backed)):
            out.append(general[:1].upper() + general[1:])
    return " ".join(out).strip()
