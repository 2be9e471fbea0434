"""Document readers and text normalisation: HTML, DOCX and paged text to canonical text with provenance."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered as O

BLOCK = frozenset("p div li tr br h1 h2 h3 h4 h5 h6 table section article ul ol blockquote".split())
SKIP = frozenset("script style nav footer form noscript head".split())
STRUCK = frozenset("s strike del".split())
#: Largest XML part of a DOCX that is read.
XML_BYTES = 64 << 20


def normalise(text: str) -> str:
    """NFC, line feeds for all line ends, no control characters or invisible marks, white space collapsed per line, no empty lines."""
    text = re.sub(r"\r\n?|\f", "\n", unicodedata.normalize("NFC", text))
    text = re.sub(r"[\x00-\x08\x0b\x0e-\x1f\x7f­​﻿]", "", text)
    return "\n".join(x for x in (re.sub(r"[^\S\n]+", " ", line).strip() for line in text.split("\n")) if x)


class _Flatten(HTMLParser):
    """Visible text; struck text is marked; plain rectangular tables become Markdown, other rows cells joined by bars."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.tables: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIP:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag == "table":
            if self.tables:
                self.tables[-1]["plain"] = False
            self.tables.append({"rows": [], "plain": True, "head": True, "outer": self.out})
            self.out = []
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([])
            self.out = []
        elif tag in ("td", "th") and self.tables and self.tables[-1]["rows"]:
            if any(k in ("colspan", "rowspan") and v != "1" for k, v in attrs):
                self.tables[-1]["plain"] = False
            if len(self.tables[-1]["rows"]) == 1:
                self.tables[-1]["head"] &= tag == "th"
            self.out = []
        elif tag in STRUCK:
            self.out.append("[TEXTO TACHADO EN LA FUENTE: ")
        elif tag in BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag in ("td", "th") and self.tables and self.tables[-1]["rows"]:
            self.tables[-1]["rows"][-1].append(" ".join("".join(self.out).split()))
            self.out = []
        elif tag == "table" and self.tables:
            t = self.tables.pop()
            rows = [r for r in t["rows"] if r]
            self.out = t["outer"]
            if t["plain"] and len(rows) > 1 and len(rows[0]) > 1 and len({len(r) for r in rows}) == 1:
                lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
                if t["head"]:
                    lines.insert(1, "|" + " --- |" * len(rows[0]))
            else:
                lines = [" | ".join(r) for r in rows]
            self.out.append("\n" + "\n".join(lines) + "\n")
        elif tag in STRUCK:
            self.out.append("]")
        elif tag in BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(page: str) -> str:
    """The page's text; entities without a semicolon are read too, malformed markup never fails."""
    p = _Flatten()
    p.feed(re.sub(r"&([aeiouAEIOU]acute|[nN]tilde)(?!;)", r"&\1;", page))
    p.close()
    while p.tables:
        p.handle_endtag("table")
    return normalise("".join(p.out))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
_INLINE = {_W + "t": None, _W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n", _W + "noBreakHyphen": "-"}


def _docx_lines(node: ElementTree.Element, out: list[str]) -> None:
    """Lines below a node: a paragraph's text, a table row's cells joined by bars; what is an alternative to shown content is left out."""
    for child in node:
        if child.tag == _FALLBACK:
            continue
        if child.tag == _W + "p":
            out.append("")
            _docx_inline(child, out)
        elif child.tag == _W + "tr":
            cells = []
            for cell in child.iter(_W + "tc"):
                inner: list[str] = []
                _docx_lines(cell, inner)
                cells.append(" ".join(" ".join(inner).split()))
            out.append(" | ".join(cells))
        else:
            _docx_lines(child, out)


def _docx_inline(node: ElementTree.Element, out: list[str]) -> None:
    """A paragraph's text onto the last line; paragraphs inside it (text boxes) become lines after it."""
    own, boxes = len(out) - 1, []
    for child in node:
        if child.tag == _FALLBACK:
            continue
        if child.tag in _INLINE:
            out[own] += _INLINE[child.tag] or child.text or ""
        elif child.tag == _W + "txbxContent":
            boxes.append(child)
        else:
            held = len(out)
            sub = [""]
            _docx_inline(child, sub)
            out[own] += sub[0]
            out[held:held] = sub[1:]
    for box in boxes:
        _docx_lines(box, out)


def docx_text(content: bytes) -> str:
    """Paragraphs, tables, text boxes and notes of a DOCX; a document type declaration or an oversized part raises."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for part in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml"):
            if part not in z.namelist():
                continue
            if z.getinfo(part).file_size > XML_BYTES:
                raise ValueError(f"{part} is too large")
            data = z.read(part)
            if b"<!DOCTYPE" in data:
                raise ValueError("a document type declaration isn't allowed")
            _docx_lines(ElementTree.fromstring(data), out)
    return normalise("\n".join(out))


# How a page names its character set.
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", re.I)


def decoded(content: bytes, declared: str | None = None) -> tuple[str, str, int]:
    """(text, character set, replaced): UTF-8 if the bytes are, else what the page declares, else what the manifest says, else a Latin code page.

    Bytes that the declared set doesn't know are replaced and counted; an unknown name is passed over.
    """
    try:
        return content.decode("utf-8-sig"), "utf-8", 0
    except UnicodeDecodeError:
        pass
    m = _META.search(content[:4096])
    for name in ((m.group(1).decode("ascii") if m else None), declared):
        try:
            if name:
                text = content.decode(name, "replace")
                return text, name.lower(), text.count("\ufffd")
        except LookupError:
            continue
    return content.decode("cp1252", "replace"), "cp1252", 0


def word_package(content: bytes) -> str:
    """The texts of the DOCX files of a ZIP in order of name; members whose path leaves the package are refused."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            if name.startswith(("/", "\\")) or ".." in re.split(r"[\\/]", name):
                raise ValueError(f"{name} is outside the package")
            if name.lower().endswith(".docx"):
                out.append(docx_text(z.read(name)))
    return "\n\n".join(out)


def converted(df: DataFrame, key: str, content: str, kind: str) -> DataFrame:
    """(key, texto, error): content by reader ('html' of strings, 'pagina' (HTML bytes in any character set), 'docx' and 'paquete' of bytes); a failure is a row, not an end."""
    read = {"html": html_text, "pagina": lambda c: html_text(decoded(bytes(c))[0]), "docx": lambda c: docx_text(bytes(c)), "paquete": lambda c: word_package(bytes(c))}[kind]

    def one(c: object) -> tuple[str | None, str | None]:
        try:
            return (read(c) if c is not None else None), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(c) for c in f[content]]
            yield pd.DataFrame({key: f[key], "texto": [t for t, _ in got], "error": [e for _, e in got]})

    return df.select(key, content).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, texto string, error string")


def pages(df: DataFrame, key: str, text: str, expected: str) -> DataFrame:
    """(key, pagina, inicio, texto) of text whose pages end in form feeds; the page number is null unless their count is the expected one."""
    parts = F.split(text, "\f")
    # each form feed's place by one walk over the characters
    starts = F.concat(F.array(F.lit(0)), F.array_compact(F.transform(F.split(text, ""), lambda c, i: F.when(c == "\f", i + 1))))
    page = F.explode(F.transform(F.col("p"), lambda t, i: F.struct(F.when(F.size("p") == F.col(expected), i + 1).alias("pagina"), F.get("s", i).alias("inicio"), t.alias("texto"))))
    return df.select(key, expected, parts.alias("p"), starts.alias("s")).select(key, page.alias("x")).select(key, "x.pagina", "x.inicio", "x.texto")


def placed(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """parts with (inicio, fin) of each in its document's whole text, in which a blank line stands between parts.

    Only lengths are summed along the order, in range blocks, so a document of any size stays distributed.
    """
    n = F.length(text).cast("bigint")
    at = O.running_sum(parts.select(key, order, n.alias("_n")), key, [order], F.col("_n") + 2, "inicio")
    return at.select(key, order, "inicio", (F.col("inicio") + F.col("_n")).alias("fin"))


def assembled(parts: DataFrame, key: str, order: str, text: str, limit: int) -> DataFrame:
    """(key, texto): whole texts of the documents that have at most ``limit`` characters, blank lines counted; others aren't gathered."""
    sizes = parts.groupBy(key).agg(F.sum(F.length(text) + 2).alias("_t")).where(F.col("_t") <= limit).select(key)
    grouped = parts.join(sizes, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"))
    return grouped.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("texto"))
