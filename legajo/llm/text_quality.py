"""Problem 9: statistics of text quality and the posterior type of each text.

One pass counts what the statistics need.  Thresholds on them are noisy labelling functions that each vote for one
type or abstain; how far to trust each is learnt by expectation-maximization on their agreements over all texts.  A
text's votes are a bit pattern, so what the driver sees is one count per pattern, at most 2^16 whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_text, table

CLASSES = ("prosa", "lista", "tabla", "basura")
PROSE, LIST, TABLE, JUNK = range(4)
ITERATIONS = 40

_WORD = re.compile(r"[^\W\d_]+")
_ENDING = re.compile(r"[.;:!?…][\"»”)\]]*$")
_SENTENCE = re.compile(r"[.!?;:…][\"»”)\]]*(?=\s|$)")
_MARK = re.compile(r"(?:[-–—•*·▪◦○●►✓>](?=\s*\w)|o(?= [A-ZÁÉÍÓÚÑ])|\(?[a-zA-Z]{1,2}[.)]|\(?\d{1,4}(?:\.\d+)*\s?[.)º°\]:]-?|\(\d+\)|\[\d+\]|\(?[ivxlcIVXLC]{1,6}[.)]|§|№)\s*(?=\S)")
_LEADERS = re.compile(r"(?:\.{3,}|…+|(?:\. ){3,}|_{3,})\s*\d+$")
_CODE = re.compile(r"[{}]\s*$|^\s*(?:(?:var|let|const|function|return|import)\b(?=.*[=(){};])|if\s*\((?=.*[{};])|\}|<\/?\w+|\$\(|@media|[.#]\w+\s*\{)|\w\([^()]*\);$|=>|</\w+>|\w\([^)\s]*\)\s*[;{]|&\w+;|<\w+[^>]*>")
_GAPS = re.compile(r" {2,}|\t")

STATS = (
    "palabras bigint, longitud_media double, simbolos double, lineas_puntuadas double, comunes double, lineas bigint, por_linea double, marcas double, celdas double, repetidas double, distintas double, frases double, raras double, codigo double, mezcladas double, patron int"
)


_ENDS = frozenset(".;:!?…\"»”)]")
#: Every line that _CODE takes as code has one of these marks, a parenthesis and a semicolon, or one of the words at its start.
_CODE_MARKS, _CODE_WORDS = "{}<>=&@#$", ("var", "let", "const", "function", "return", "import", "if")
#: Longest list of common words: it is fixed and given, and travels to the workers.
COMMON_WORDS = 100_000


def _code(line: str) -> bool:
    """Whether a stripped line looks like code."""
    return (line.startswith(_CODE_WORDS) or ";" in line and "(" in line or any(m in line for m in _CODE_MARKS)) and _CODE.search(line) is not None


class _Odd(dict):
    """Whether a token is strange; decided once for each of the recent short tokens, emptied when full."""

    def __missing__(self, token: str) -> bool:
        odd = len(token) > 1 and _STRANGE.search(token) is not None
        if len(token) <= 32:
            if len(self) >= 200_000:
                self.clear()
            self[token] = odd
        return odd


_ODD = _Odd()


def measure(text: str, common: frozenset[str]) -> tuple:
    """The statistics of one text, shares from 0 to 1.

    A word is a maximal run of letters; symbols are what is neither letter, digit nor white space, among what isn't
    white space; lines that hold only white space don't count.  A text without words or lines has zeros.
    """
    words = _WORD.findall(text.replace("İ", "I").lower())
    n = len(words)
    counts = Counter(words)
    letters = sum(map(len, words))
    tokens = text.split()
    solid = sum(map(len, tokens))
    digits = sum(map(text.count, "0123456789"))
    symbols = max(0, solid - letters - digits)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    ended = marked = cells = coded = 0
    widths: Counter = Counter()
    for raw in lines:
        line = raw.strip()
        ended += line[-1] in _ENDS and bool(_ENDING.search(line))
        marked += bool(_MARK.match(line)) or line[-1].isdigit() and (".." in line or "…" in line or "__" in line or ". ." in line) and bool(_LEADERS.search(line))
        coded += _code(line)
        k = 1
        for sep in ("|", "\t", ";"):
            if sep in line:
                k = max(k, len([c for c in line.strip("|").split(sep) if c.strip()]))
        if k < 2 and "  " in line or ";" in line and line.endswith(";"):
            k = max(1, len([c for c in _GAPS.split(line) if c.strip()]))
        if len(line) > 40 * k:
            k = 1  # clauses, not cells
        cells += k >= 2
        widths[k] += 1
    top_width = max((v for k, v in widths.items() if k >= 2), default=0)
    top = max(counts.values(), default=0)
    sentences = len(_SENTENCE.findall(text))
    mixed = sum(map(_ODD.__getitem__, tokens))
    longest = max(map(len, tokens), default=0)
    rare = 1.0 if longest > 60 and longest > 0.3 * solid else 0.0
    return (
        n, letters / n if n else 0.0, symbols / max(1, solid), ended / m if lines else 0.0, sum(c for w, c in counts.items() if w in common) / max(1, n), len(lines), n / m,
        marked / m, max(0.0, (cells + top_width) / (2 * m)), top / max(1, n), len(counts) / max(1, n), sentences / max(1, n), rare, coded / m, mixed / max(1, len(tokens)),
    )


_STRANGE = re.compile(r"&#\d+;|\\[xu][0-9a-f]{2}|%[0-9A-F]{2}(?![\w%])|(?<!\S)(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{4}(?!\S)|[A-Za-zÀ-ÿ](?:[#@~%^*¤¬¦§±†‡‰•µ¶=+]|;(?=\w))|[#@~%^*¤¬¦±†‡‰•¶][A-Za-zÀ-ÿ]|[A-Za-z][Ѐ-ӿ　-鿿]|[Ѐ-ӿ　-鿿][A-Za-zÀ-ÿ]|[a-z]\d+[A-Za-z]+\d|[A-Za-z]\d[A-Za-z]\d|([^\w\s])\1{4,}|[þðøæ][a-zß]*[þðøæß]|[a-z][A-Z][a-z]?[A-Z][a-z]")


# Each labelling function: the type it votes for and its threshold on the statistics.
FUNCTIONS = (
    (PROSE, lambda s: s["comunes"] >= 0.3 and s["palabras"] >= 8 and s["distintas"] > 0.15),
    (PROSE, lambda s: s["frases"] > 0.008 and s["por_linea"] >= 6 and s["palabras"] >= 6),
    (PROSE, lambda s: s["por_linea"] >= 9 and s["celdas"] < 0.3 and s["mezcladas"] < 0.05),
    (PROSE, lambda s: s["marcas"] < 0.5 and s["celdas"] < 0.5 and s["comunes"] >= 0.15 and (s["lineas_puntuadas"] > 0.1 or s["lineas"] <= 2)),
    (LIST, lambda s: s["marcas"] >= 0.7 and s["lineas"] >= 4),
    (LIST, lambda s: s["lineas"] >= 4 and s["por_linea"] < 8 and s["celdas"] < 0.3 and s["codigo"] < 0.3 and s["repetidas"] < 0.6 and s["simbolos"] < 0.25 and s["mezcladas"] < 0.1 and s["palabras"] >= 5),
    (LIST, lambda s: s["lineas"] >= 4 and s["marcas"] >= 0.5 and s["por_linea"] < 12 and s["celdas"] < 0.6),
    (TABLE, lambda s: s["celdas"] >= 0.75 and s["lineas"] >= 3 and s["marcas"] < 0.8),
    (TABLE, lambda s: s["celdas"] >= 0.6 and s["por_linea"] < 12 and s["lineas"] >= 3 and s["lineas_puntuadas"] < 0.3),
    (TABLE, lambda s: s["celdas"] >= 0.9 and s["codigo"] < 0.3 and s["lineas"] >= 2),
    (JUNK, lambda s: s["repetidas"] >= 0.6 and s["palabras"] >= 10),
    (JUNK, lambda s: s["simbolos"] >= 0.35 and s["celdas"] < 0.9 or s["palabras"] == 0 and s["celdas"] < 0.5),
    (JUNK, lambda s: s["mezcladas"] >= 0.25 or s["raras"] > 0),
    (JUNK, lambda s: s["comunes"] < 0.03 and s["palabras"] >= 12 and s["lineas"] <= 3),
    (JUNK, lambda s: s["codigo"] >= 0.5 and s["lineas"] >= 2 or s["codigo"] >= 0.3 and s["simbolos"] >= 0.12),
    (JUNK, lambda s: s["distintas"] < 0.12 and s["palabras"] >= 20 and s["celdas"] < 0.6 and s["marcas"] < 0.5),
)
_NAMES = [c.split()[0] for c in STATS.split(", ")]


def pattern(stats: tuple) -> int:
    """The votes as bits."""
    s = dict(zip(_NAMES, stats))
    return sum(1 << i for i, (_, holds) in enumerate(FUNCTIONS) if holds(s))


def learn(patterns: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Class priors, and each function's chance of voting by true class, from counts of vote patterns.

    Expectation-maximization over a latent class with functions that err independently given it; it starts from a
    majority of votes, so a class keeps its meaning.  Without any text the start is returned.
    """
    target = np.array([c for c, _ in FUNCTIONS])
    k = len(CLASSES)
    prior = np.full(k, 1 / k)
    chance = np.where(np.arange(k)[:, None] == target[None, :], 0.8, 0.04)
    if not patterns:
        return prior, chance
    bits = (np.array(list(patterns))[:, None] >> np.arange(len(FUNCTIONS))) & 1
    weight = np.array(list(patterns.values()), float)
    for _ in range(ITERATIONS):
        post = posterior(bits, prior, chance)
        mass = weight[:, None] * post
        total = mass.sum(0)
        prior = (total + 1) / (total + 1).sum()
        # a weak prior keeps a function from turning against its own class
        strength = 0.01 * weight.sum() / k + 2
        start = np.where(np.arange(k)[:, None] == target[None, :], 0.8, 0.04)
        chance = (mass.T @ bits + strength * start) / (total[:, None] + strength)
        chance = np.clip(chance, 0.005, 0.995)
    return prior, chance


def posterior(bits: np.ndarray, prior: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Chance of each class for each row of votes."""
    own = bits @ np.array([[c == k for k in range(len(CLASSES))] for c, _ in FUNCTIONS], float)
    log = np.log(prior)[None, :] + bits @ np.log(chance).T + (1 - bits) @ np.log1p(-chance).T
    # a type that nothing voted for is no candidate; prose is what a text is without evidence
    log = np.where((own > 0) | (np.arange(len(CLASSES)) == PROSE), log, -1e9)
    log -= log.max(1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(1, keepdims=True)


def statistics(documents: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text that isn't null or blank: key, the statistics, and the votes (patron).  A narrow map.

    The common words are a fixed list; only its words travel, and a list of more than COMMON_WORDS raises.
    """
    listed = frozenset(r[0] for r in common.select(F.lower("palabra")).where("palabra IS NOT NULL").distinct().limit(COMMON_WORDS + 1).collect())
    if len(listed) > COMMON_WORDS:
        raise ValueError(f"more than {COMMON_WORDS} common words")
    kind = dict(documents.dtypes)[key]

    def fn(k: object, t: str) -> Iterator[tuple]:
        if t.strip():
            s = measure(t, listed)
            yield (k, *s, pattern((*s, 0)))

    return map_text(documents, key, text, f"`{key}` {kind}, {STATS}", fn)


def typed(documents: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """statistics() with clase, the type of highest posterior, and confianza, that posterior.

    The statistics are written once to the shared checkpoint folder; the vote patterns (2^16 at most) are counted there and
    joined back with their class.
    """
    kept = checkpointed(statistics(documents, common, key, text))
    counts = {r.patron: r["n"] for r in kept.groupBy("patron").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior, chance = learn(counts)
    seen = sorted(counts)
    rows = []
    if seen:
        post = posterior((np.array(seen)[:, None] >> np.arange(len(FUNCTIONS))) & 1, prior, chance)
        rows = [(p, CLASSES[int(i)], float(x)) for p, i, x in zip(seen, post.argmax(1), post.max(1))]
    classes = documents.sparkSession.createDataFrame(rows, "patron int, clase string, confianza double")
    return kept.join(F.broadcast(classes), "patron").select(*kept.columns, "clase", "confianza")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are nearly all list, table or junk, with their class."""
    return typed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "palabras_comunes")).where("clase <> 'prosa'").select("doc_id", "clase")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and class of every document that has a text."""
    return typed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "palabras_comunes"))


def p9_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five plain statistics of every document that has a text, rounded."""
    stats = statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "palabras_comunes"))
    return stats.select("doc_id", "palabras", *[F.round(c, 6).alias(c) for c in ("longitud_media", "simbolos", "lineas_puntuadas", "comunes")])


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p9_plain": p9_plain}
SQL = {
    "p9_plain": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS w, regexp_replace(text, '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+', '', 'g') AS s,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$', '', 'g')), lambda x: x <> '') AS l
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT list(DISTINCT lower(palabra)) AS c FROM palabras_comunes WHERE palabra IS NOT NULL)
SELECT doc_id, len(w)::BIGINT AS palabras, round(CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE END, 6)::DOUBLE AS longitud_media,
  round(length(regexp_replace(s, '[\p{L}\p{Nl}\p{No}0-9]', '', 'g')) / length(s)::DOUBLE, 6)::DOUBLE AS simbolos,
  round(len(list_filter(l, lambda x: regexp_matches(x, '[.;:!?…]["»”)\]]*$'))) / len(l)::DOUBLE, 6)::DOUBLE AS lineas_puntuadas,
  round(len(list_filter(w, lambda x: list_contains(c, x))) / greatest(1, len(w))::DOUBLE, 6)::DOUBLE AS comunes
FROM t, c WHERE length(s) > 0"""
}
