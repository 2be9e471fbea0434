"""Problem 1: text that was decoded with the wrong character encoding.

Characters are mapped back to the bytes of the legacy code page that produced them, a byte-structure automaton walks
those bytes and reports the maximal well-formed UTF-8 spans, and only those spans are decoded again (repeatedly, for
text that was mangled more than once).  What one byte per character stands for (a Windows file read as Mac, DOS or
Cyrillic) has no multibyte structure; a second lane maps such words back through the code-page pair and accepts them
when every foreign character becomes a Spanish letter in a fitting case and place.  U+FFFD and lead bytes whose
continuation was dropped can't be recovered; they are marked with U+FFFD and reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

LOST = "�"
CYRILLIC = re.compile(r"[Ѐ-џ]")
SPANISH = "áéíóúüñÁÉÍÓÚÜÑ"
ORDINARY = SPANISH + "¿¡«»°º"
#: Code pages through which UTF-8 was misread.
MULTIBYTE = ("cp1252", "cp437", "cp850", "mac_roman", "cp1251")
#: (read as, written in): single-byte text misread as another single-byte code page.
SINGLE = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"))
#: Characters that ordinary typography also puts inside or beside words: no evidence of their own.
WEAK = frozenset("—–‒‐’‘“”·°´¸…¡¿«»ºª¬\xad\xa0„‚˜ˆ¢£¤¼½¾")
ENDING = re.compile(r"(?:[cstgxnl]i[óÓ][nN]|[íÍ][aA][sS]?|[óÓ]|[áÁ][nN]?|[cC]t?[íÍ][cC]ul[oO]s?|[íÍ][cC][oOaA][sS]?|[íÍ]dic[oa]s?|ó[mgn]ic[oa]s?)$|^ART[ÍI]CULO|^CAPÍTULO|^(?:Art|art|par|cap|Cap|t|T)[íáÍÁ](?:culo|grafo|tulo)s?$")


def _page(codec: str) -> dict[str, int]:
    """Character to byte, for the upper half of a code page; C1 controls stand for bytes the page leaves undefined."""
    out: dict[str, int] = {chr(b): b for b in range(0x80, 0xA0)} if codec == "cp1252" else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


PAGES = {c: _page(c) for c in {*MULTIBYTE, *(r for r, _ in SINGLE)}}
RUNS = {c: re.compile("[" + "".join(map(re.escape, PAGES[c])) + "]{2,}") for c in MULTIBYTE}
#: Characters that stand for the lead byte of a multibyte character.
LEADS = {c: frozenset(x for x, b in PAGES[c].items() if 0xC2 <= b <= 0xF4) for c in MULTIBYTE}


def _automaton() -> list[list[int]]:
    """UTF-8 as a table of states by byte: 0 is a character boundary, -1 rejects."""
    boundary, one, two, three, after_e0, after_ed, after_f0, after_f4 = range(8)
    table = [[-1] * 256 for _ in range(8)]

    def arc(state: int, low: int, high: int, to: int) -> None:
        table[state][low : high + 1] = [to] * (high + 1 - low)

    for low, high, to in ((0xC2, 0xDF, one), (0xE0, 0xE0, after_e0), (0xE1, 0xEC, two), (0xED, 0xED, after_ed), (0xEE, 0xEF, two), (0xF0, 0xF0, after_f0), (0xF1, 0xF3, three), (0xF4, 0xF4, after_f4)):
        arc(boundary, low, high, to)
    arc(one, 0x80, 0xBF, boundary)
    arc(two, 0x80, 0xBF, one)
    arc(three, 0x80, 0xBF, two)
    arc(after_e0, 0xA0, 0xBF, one)
    arc(after_ed, 0x80, 0x9F, one)
    arc(after_f0, 0x90, 0xBF, two)
    arc(after_f4, 0x80, 0x8F, two)
    return table


AUTOMATON = _automaton()


def spans(data: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of well-formed multibyte characters in high bytes."""
    at, n = 0, len(data)
    while at < n:
        start = done = at
        state, i = 0, at
        while i < n and (state := AUTOMATON[state][data[i]]) >= 0:
            i += 1
            if not state:
                done = i
        if done > start:
            yield start, done
        at = done if done > start else start + 1


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    """The script of a letter, '' for all else."""
    return unicodedata.name(c, "").split(" ")[0].removesuffix("-") if unicodedata.category(c)[0] in "LM" else ""


def _ordinary(piece: str, read: str, codec: str) -> bool:
    """Whether the misread form of a well-formed span may be ordinary text itself, so that it proves nothing.

    What decodes to Latin letters with marks, typography or symbols was garbled: no source writes such pairs.  Other
    alphabets prove themselves by two letters or more of one script; a single ideograph by a misread form that isn't all
    typography and Spanish letters.  Undefined characters prove nothing.
    """
    common = all(0x80 <= o < 0xA0 and codec == "cp1252" or 0xA0 <= o <= 0x17F or 0x2010 <= o <= 0x27BF or c in "ƒˆ˜\ufeff" + LOST or o >= 0x1F300 for c in piece for o in (ord(c),))
    if common:
        return False
    letters = [x for x in map(_script, piece) if x]
    if any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in piece) or not letters:
        return True
    strange = any(c not in WEAK and c not in ORDINARY for c in read)
    if len(letters) >= 2:
        # a run of the code page's own alphabet, or of letters from many alphabets, is a source's text
        return not strange or len(set(letters) - {"LATIN", "HIRAGANA", "KATAKANA"}) > 1
    return not (strange and len(read) >= 3 and letters[0] in ("CJK", "HANGUL", "HIRAGANA", "KATAKANA"))


def _plausible(piece: str, read: str, beside: str, codec: str) -> bool:
    """Whether a well-formed span was garbled: its misreading isn't ordinary text, and isn't part of a Cyrillic word."""
    return not _ordinary(piece, read, codec) and not (codec == "cp1251" and CYRILLIC.search(beside))


def _decode_runs(text: str, codec: str) -> tuple[str, int]:
    page, count = PAGES[codec], 0

    def mend(m: re.Match) -> str:
        nonlocal count
        run = m.group()
        data = bytes(page[c] for c in run)
        out, last = [], 0
        for a, b in spans(data):
            piece = data[a:b].decode("utf-8")
            beside = text[max(0, m.start() + a - 1) : m.start() + a] + text[m.start() + b : m.start() + b + 1]
            if _plausible(piece, run[a:b], beside, codec):
                out += [run[last:a], piece]
                last = b
                count += 1
        return "".join([*out, run[last:]])

    return RUNS[codec].sub(mend, text), count


@lru_cache(maxsize=65536)
def _single(word: str) -> tuple[tuple[str, str, bool], ...]:
    """(read as, decoded word, strong) for each code-page pair that turns all foreign characters into fitting ones."""
    found = []
    for read, wrote in SINGLE:
        page, out, letters, strong, ok = PAGES[read], [], 0, False, True
        for i, c in enumerate(word):
            prev, nxt = word[i - 1 : i] if i else "", word[i + 1 : i + 2]
            if c < "\x80" or c in SPANISH and not (c.isupper() and (prev.islower() or prev.isalpha() and nxt.islower())):
                out.append(c)
                continue
            b = page.get(c)
            try:
                d = bytes([b]).decode(wrote) if b is not None else ""
            except UnicodeDecodeError:
                d = ""
            if d and d in SPANISH and (prev.isalpha() or nxt.isalpha()):
                fits = not (d.isupper() and prev.isalpha() and prev.islower()) and not (d.islower() and prev.isalpha() and prev.isupper() and nxt.isupper())
                fits = fits and not (d.islower() and not prev and nxt.isupper()) and not (d.isupper() and prev.isalpha() and nxt.isalpha() and nxt.islower())
                if fits:
                    out.append(d)
                    letters += 1
                    strong |= c not in WEAK
                    continue
            elif d and d in "º°" and prev.isdigit():
                out.append(d)
                strong |= c not in WEAK
                letters += 1
                continue
            elif d and (d in "¿¡«" and (not prev or not prev.isalnum()) or d in "»" and not nxt.isalnum() or d in "–·"):
                out.append(d)
                continue
            elif c in ORDINARY or c in "\xad¬‐–—…“”":
                out.append(c)
                continue
            ok = False
            break
        if ok and letters:
            found.append((read + ">" + wrote, "".join(out), strong))
    return tuple(found)


ODD = re.compile(r"[^\s\x00-\x7f" + ORDINARY + r"]|[a-záéíóúñ][ÁÉÍÓÚÜÑ]|[A-Z][ÁÉÍÓÚÜÑ][a-z]")
WORD = re.compile(r"\S+")
#: UTF-8 leads of accented letters whose continuation byte was dropped on the way.
HEADLESS = re.compile(r"(?<=[a-záéíóúñ])[ÃÂ](?![\x80-\xbf])|(?<=[A-ZÑ]{2})Ã(?=[B-DF-NP-RT-Z]|A\b)|(?<=[a-z])├(?![\w])")


def repair(text: str) -> tuple[str, int, int, str]:
    """Text as its source wrote it, spans mended, places lost, and the code pages involved ('' if none).

    Empty text comes back unchanged.
    """
    if text.isascii():
        return text, 0, 0, ""
    lost, mended, pages = text.count(LOST), 0, []
    # each pass takes the code page that explains most, and shortens the text, so this ends
    while True:
        chars, tries = set(text), []
        for codec in MULTIBYTE:
            if not chars.isdisjoint(LEADS[codec]):
                out, n = _decode_runs(text, codec)
                if n:
                    tries.append((len(out), codec, out, n))
        if not tries:
            break
        _, codec, text, n = min(tries, key=lambda t: (t[0], MULTIBYTE.index(t[1])))
        mended += n
        pages.append(f"utf-8>{codec}")
    votes: dict[str, list[tuple[str, bool]]] = {}
    if ODD.search(text):
        for word in text.split():
            if not word.isascii() and ODD.search(word):
                for pair, decoded, strong in _single(word):
                    votes.setdefault(pair, []).append((decoded, strong))
    best, weight = "", 0
    for pair, found in votes.items():
        score = sum(4 if s else 2 if ENDING.search(d.strip(".,;:()«»?\"")) else 1 for d, s in found)
        # typographic marks alone prove nothing unless they complete a Spanish ending
        if (any(s for _, s in found) or any(ENDING.search(d.strip(".,;:()«»?\"")) for d, _ in found)) and score > weight:
            best, weight = pair, score
    if best:
        read, wrote = best.split(">")
        page = PAGES[read]

        def again(m: re.Match) -> str:
            nonlocal mended
            word, out = m.group(), []
            if word.isascii() or not ODD.search(word):
                return word
            for pair, decoded, _ in _single(word):
                if pair == best:
                    mended += 1
                    return decoded
            if len(word) == 1 and CYRILLIC.match(word) and read == "cp1251":
                mended += 1
                return bytes([page[word]]).decode(wrote)
            for i, c in enumerate(word):
                d = bytes([page[c]]).decode(wrote, "ignore") if c in page and c not in ORDINARY else ""
                edge = not word[i - 1 : i].isalnum() if i else True
                out.append(d if d in tuple("¿¡«") and edge or d in tuple("»ºª°") else c)
            return "".join(out)

        text = WORD.sub(again, text)
        pages.append(best)
    text, n = HEADLESS.subn(LOST, text)
    lost += n
    return text, mended, lost, ",".join(dict.fromkeys(pages))


#: Superset of what the operator can act on; keeps clean rows out of Python.
SUSPECT = r"[ÁÉÍÓÚÜÑáéíóúñ][«»¿¡°º\x{ad}\x{a0}©–•]|[^\x00-\x7fáéíóúüñÁÉÍÓÚÜÑ«»¿¡°º\x{ad}\x{a0}©–•●📎]|[a-záéíóúñ][ÁÉÍÓÚÜÑ]|[A-Z][ÁÉÍÓÚÜÑ][a-z]"
_SUSPECT = re.compile(SUSPECT.replace("x{ad}", "xad").replace("x{a0}", "xa0"))


def suspicious(text: str) -> bool:
    """Whether repair() could change the text or report a loss."""
    return _SUSPECT.search(text) is not None


def repaired(chunks: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """One row per affected text: key, restored text, spans mended, places lost, code pages.

    Null, empty and plain-ASCII texts are never affected.  Repeated rows give repeated results.  A narrow map: no shuffle.
    """

    def fn(k: object, t: str) -> Iterator[tuple]:
        out, mended, lost, pages = repair(t)
        if mended or lost:
            yield k, out, mended, lost, pages

    kind = dict(chunks.dtypes)[key]
    rows = chunks.where(F.col(f"`{text}`").rlike(SUSPECT))
    return map_text(rows, key, text, f"`{key}` {kind}, restaurado string, reparados int, perdidos int, paginas string", fn)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose text holds a sequence that arose from a wrong decoding."""
    return repaired(table(spark, sf_dir, "chunks")).select("id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks with the text as the source wrote it, lost places marked."""
    return repaired(table(spark, sf_dir, "chunks"))


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
SQL: dict[str, str] = {}
