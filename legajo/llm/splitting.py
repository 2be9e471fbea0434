"""Problem 3: splitting oversized texts at natural boundaries by agglomerative merging.

A text is first cut into atomic segments (articles, paragraphs, sentences; words only where a sentence is too long,
characters only where a word is).  A heap holds the boundaries between neighbours, the weakest first; a boundary
disappears while what it joins, plus the overlap, fits the limit.  What remains are pieces cut at the strongest
boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_text, table

LIMIT = 1500
OVERLAP = 200

HARD, WORD, SENTENCE, PARAGRAPH, ARTICLE = range(5)
_UNITS = r"(?:primer[oa]?|segund[oa]|tercer[oa]?|cuart[oa]|quint[oa]|sext[oa]|s[eé]ptim[oa]|octav[oa]|noven[oa])"
_TENS = r"(?:d[eé]cim[oa]|vig[eé]sim[oa]|trig[eé]sim[oa]|cuadrag[eé]sim[oa]|quincuag[eé]sim[oa]|sexag[eé]sim[oa]|septuag[eé]sim[oa]|octog[eé]sim[oa]|nonag[eé]sim[oa]|cent[eé]sim[oa])"
_LABEL = rf"(?:transitorio\s+)?(?:\d+(?:\.\d+)*[A-Z]?|[uú]nico|{_TENS}(?:[ \t]*{_UNITS})?|und[eé]cim[oa]|duod[eé]cim[oa]|{_UNITS})"
HEADING = re.compile(rf"(?im)^[ \t]*art(?:[íi]culo|\.)[ \t]+({_LABEL})(?=[ \t]*[º°o]?[ \t]*[.:\-–—]|[ \t]*[º°])")
BREAKS = (
    (PARAGRAPH, re.compile(r"\n\s*")),
    (SENTENCE, re.compile(r"(?<=[.;:!?…»\"])\s+(?=[\"«¿¡(]?[A-ZÁÉÍÓÚÜÑ0-9a-z])")),
    (WORD, re.compile(r"\s+")),
)


def boundaries(text: str, budget: int) -> list[tuple[int, int]]:
    """(offset, strength) of the cuts that leave no atomic segment above the budget, with 0 and len(text) at the ends."""
    marks = {m.start(): ARTICLE for m in HEADING.finditer(text) if m.start()}
    for strength, pattern in BREAKS[:2]:
        for m in pattern.finditer(text):
            marks.setdefault(m.end(), strength)
    marks.pop(0, None)
    marks.pop(len(text), None)
    cuts = [(0, ARTICLE), *sorted(marks.items()), (len(text), ARTICLE)]
    out = [cuts[0]]
    for (a, _), (b, strength) in zip(cuts, cuts[1:]):
        if b - a > budget:
            at = a
            for m in BREAKS[2][1].finditer(text, a, b):
                while m.end() - at > budget:
                    at += budget
                    out.append((at, HARD))
                if a < m.end() < b:
                    at = m.end()
                    out.append((at, WORD))
            while b - at > budget:
                at += budget
                out.append((at, HARD))
        out.append((b, strength))
    return out


def overlap_start(text: str, floor: int, cut: int, overlap: int) -> int:
    """Where a piece that is cut at ``cut`` begins: at the first word start in the ``overlap`` characters before it."""
    low = max(floor, cut - overlap)
    if low <= floor or text[low - 1 : low].isspace() and not text[low : low + 1].isspace():
        return low
    m = re.compile(r"\s+(?=\S)").search(text, low, cut)
    return m.end() if m and m.end() < cut else low


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Half-open spans of the pieces; one span if the text is within the limit.

    The pieces cover the whole text in order, none is above the limit, and each begins up to ``overlap`` characters
    before the one before it ends.  Where a cut falls inside a word longer than the limit the overlap is exact.
    """
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must be above the overlap, which can't be negative")
    if len(text) <= limit:
        return [(0, len(text))]
    budget = limit - overlap
    cuts = boundaries(text, budget)
    n = len(cuts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def entry(i: int) -> tuple[int, int, int]:
        """The cut's strength, then what merging over it would make, then its place."""
        return cuts[i][1], cuts[after[i]][0] - cuts[before[i]][0], i

    heap = [entry(i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        now = cuts[after[i]][0] - cuts[before[i]][0]
        if now != size:
            heapq.heappush(heap, (strength, now, i))
            continue
        # the first piece has no overlap to carry
        if now + (overlap if before[i] else 0) > limit:
            continue
        alive[i] = False
        p, q = before[i], after[i]
        after[p], before[q] = q, p
    kept = [cuts[i][0] for i in range(n) if alive[i]]
    out = [(0, kept[1])]
    for a, b in zip(kept[1:], kept[2:]):
        out.append((overlap_start(text, out[-1][0] + 1, a, overlap), b))
    return out


def pieces(chunks: DataFrame, key: str = "id", text: str = "texto", label: str = "articulo", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Numbered pieces of every text above the limit: key, pieza (from 1), articulo, inicio, fin (half-open), texto.

    articulo is that of the last article heading before the piece's own part, else the row's.  Null, empty and short
    texts have no pieces; a text of one endless word is cut by characters; repeated rows are each split.  No shuffle.
    """

    def fn(k: object, t: str, article: str) -> Iterator[tuple]:
        heads = [(m.start(), m.group(1)) for m in HEADING.finditer(t)]
        at, last = 0, 0
        for n, (a, b) in enumerate(split(t, limit, overlap), 1):
            while at < len(heads) and heads[at][0] <= last:
                article = heads[at][1]
                at += 1
            yield k, n, article, a, b, t[a:b]
            last = b

    kind = dict(chunks.dtypes)[key]
    rows = chunks.where(F.char_length(F.col(f"`{text}`")) > limit)
    return map_text(rows, key, text, f"`{key}` {kind}, pieza int, articulo string, inicio bigint, fin bigint, texto string", fn, carry=(label,))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks above the limit: those that come out in pieces."""
    return pieces(table(spark, sf_dir, "chunks")).where("pieza = 1").select("id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return pieces(table(spark, sf_dir, "chunks"))


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every oversized chunk add up to: where they begin and end, gaps, pieces above the limit, overlaps above 200 and texts that aren't the chunk's."""
    w = Window.partitionBy("id").orderBy("pieza")
    rows = pieces(table(spark, sf_dir, "chunks")).select("id", "pieza", "inicio", "fin", F.length("texto").alias("n"), F.lag("fin").over(w).alias("previo"), F.lag("inicio").over(w).alias("antes"))
    bad = lambda c: F.count_if(c)
    return rows.groupBy("id").agg(F.min("inicio").alias("inicio"), F.max("fin").alias("fin"), bad(F.col("inicio") > F.col("previo")).alias("huecos"), bad(F.col("fin") - F.col("inicio") > LIMIT).alias("largas"), bad((F.col("previo") - F.col("inicio") > OVERLAP) | (F.col("inicio") <= F.col("antes"))).alias("solapes"), bad(F.col("n") != F.col("fin") - F.col("inicio")).alias("otras"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_cover": p3_cover}
SQL = {
    "p3_found": "SELECT id FROM chunks WHERE length(texto) > 1500",
    "p3_cover": "SELECT id, 0::BIGINT AS inicio, length(texto)::BIGINT AS fin, 0::BIGINT AS huecos, 0::BIGINT AS largas, 0::BIGINT AS solapes, 0::BIGINT AS otras FROM chunks WHERE length(texto) > 1500",
}
