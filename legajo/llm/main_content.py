"""Problem 2: page boilerplate mixed with main content.

A tree builder turns a page into nested blocks.  Markup goes through an HTML parser whose implied end tags are
supplied; text that a portal already rendered to lines goes through the same builder, where the look of a line implies
the tag that must have enclosed it (a navigation bar, a breadcrumb, a control, a side block with its items, a footer,
or main content) and closes what it can't nest in.  Visibility rules hide the portal's blocks; the renderer emits the
rest in order with block spacing, list marks and aligned table cells.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import map_text, table
from .encoding_repair import LOST, repair, suspicious

# ---- tree ----------------------------------------------------------------------------------------------------------

BLOCKS = frozenset("address article aside blockquote body caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("aside button footer form head nav noscript script select style svg template title".split())
#: An opening tag of the key ends an open tag of the value, as far up as the container.
IMPLIED_END = {
    "li": ({"li", "p"}, {"ul", "ol", "aside", "nav"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    **{t: ({"p"}, {"td", "th", "li", "body"}) for t in ("p", "div", "ul", "ol", "table", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dl")},
    **{t: ({"p", "aside", "nav", "footer"}, {"body"}) for t in ("aside", "main:line")},
}
#: A tag that may only occur inside one of these is given its first as parent.
IMPLIED_PARENT = {"tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "li": ("ul", "ol", "aside", "nav")}


@dataclass(slots=True)
class Node:
    tag: str
    hidden: bool = False
    children: list = field(default_factory=list)


class Builder:
    """Nested blocks from a stream of open, close and text events."""

    def __init__(self) -> None:
        self.root = Node("body")
        self.stack = [self.root]

    def open(self, tag: str, hidden: bool = False) -> None:
        ends, limits = IMPLIED_END.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in limits:
                break
            if self.stack[i].tag in ends:
                del self.stack[i:]
        parents = IMPLIED_PARENT.get(tag)
        if parents and self.stack[-1].tag not in parents:
            self.open(parents[0])
        node = Node(tag, hidden or tag in HIDDEN or self.stack[-1].hidden)
        self.stack[-1].children.append(node)
        self.stack.append(node)

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def text(self, value: object) -> None:
        self.stack[-1].children.append(value)


class _Markup(HTMLParser):
    NAMES = re.compile(r"\b(?:menu|nav|breadcrumb|cookie|footer|sidebar|share|social|banner|widget|skip)\b", re.I)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.builder = Builder()
        #: By line of the source: its visible text, and whether hidden text stands in it.
        self.shown: dict[int, str] = {}
        self.veiled: set[int] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.builder.text("\n")
        elif tag not in VOID:
            a = {k: v or "" for k, v in attrs}
            style = a.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or a.get("role") in ("navigation", "banner", "contentinfo", "search", "complementary")
            self.builder.open(tag, hidden or tag not in ("body", "html", "main", "article") and bool(self.NAMES.search(a.get("class", "").replace("-", " ").replace("_", " ") + " " + a.get("id", ""))))

    def handle_endtag(self, tag: str) -> None:
        self.builder.close(tag)

    def handle_data(self, data: str) -> None:
        hidden = self.builder.stack[-1].hidden
        for n, piece in enumerate(data.split("\n"), self.getpos()[0]):
            if piece.strip():
                if hidden:
                    self.veiled.add(n)
                else:
                    self.shown[n] = self.shown.get(n, "") + piece
        self.builder.text(data)


def _rows(table_node: Node) -> Iterator[list[str]]:
    for child in table_node.children:
        if isinstance(child, Node) and not child.hidden:
            if child.tag == "tr":
                yield [" ".join(_plain(c).split()) for c in child.children if isinstance(c, Node) and not c.hidden]
            else:
                yield from _rows(child)


def _plain(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "" if c.hidden else _plain(c) for c in node.children)


def _render(node: Node, out: list[str]) -> None:
    inline: list[str] = []

    def flush() -> None:
        text = "\n".join(" ".join(x.split()) for x in "".join(inline).split("\n")).strip() if node.tag != "pre" else "".join(inline).strip("\n")
        inline.clear()
        if text:
            out.append("- " + text if node.tag == "li" else text)

    for child in node.children:
        if isinstance(child, str):
            inline.append(child if child == "\n" or node.tag == "pre" else re.sub(r"\s+", " ", child))
        elif child.hidden:
            continue
        elif child.tag == "table":
            flush()
            rows = [r for r in _rows(child) if any(r)]
            widths = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows), default=0))]
            out += ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows]
        elif child.tag in BLOCKS:
            flush()
            _render(child, out)
        else:
            inline.append(_plain(child))
    flush()


MARKUP = re.compile(r"<(?:html|body|div|p|nav|ul|table|main|article|section|br)\b[^<>]*>", re.I)


def render_markup(page: str) -> str:
    """The visible text of an HTML page."""
    out: list[str] = []
    _render(_parsed(page).builder.root, out)
    return "\n".join(out)


def _parsed(page: str) -> _Markup:
    parser = _Markup()
    parser.feed(page)
    parser.close()
    return parser


def markup_lines(page: str) -> list[int]:
    """Numbers of the lines of an HTML page that hold the portal's text only: hidden by their tags, or boilerplate by the look of what they show."""
    parser = _parsed(page)
    last = page.count("\n") + 1
    shown = build_lines("\n".join(parser.shown.get(n, "") for n in range(1, last + 1)))[1]
    return sorted({n for n in parser.veiled if n not in parser.shown} | set(shown))


# ---- lines whose look implies their block --------------------------------------------------------------------------

# Words that portals of the domain put into menus, side blocks and controls, folded to plain lower case.
MENU = (
    "acerca de", "atencion a la ciudadania", "ayuda", "biblioteca", "blog", "boletines", "conceptos", "contacto", "contactenos", "convocatorias", "datos abiertos", "directorio", "eventos", "gaceta", "glosario", "inicio", "intranet", "jurisprudencia", "mapa del sitio",
    "noticias", "normatividad", "participa", "politica de privacidad", "pqrsd", "preguntas frecuentes", "prensa", "quienes somos", "relatoria", "rendicion de cuentas", "servicios", "terminos de uso", "tramites", "tramites y servicios", "transparencia",
)
SIDE = ("archivo por ano", "articulos relacionados", "categorias", "documentos relacionados", "enlaces de interes", "etiquetas", "lo mas consultado", "lo mas leido", "normas relacionadas", "publicaciones recientes", "tambien le puede interesar", "temas relacionados", "ultimas noticias", "vea tambien")
CONTROL = (
    "a- a a+", "alto contraste", "anterior", "buscar", "buscar en el sitio", "cambiar idioma", "cargar mas resultados", "cerrar", "cerrar sesion", "compartir", "compartir en facebook", "compartir en redes", "compartir en twitter", "copiar enlace", "descargar", "descargar en pdf", "enviar por correo", "escuchar el texto",
    "imprimir", "imprimir esta pagina", "ingresar", "iniciar sesion", "ir al contenido", "leer mas", "menu", "menu principal", "registrese", "reportar un error", "saltar al contenido", "saltar al contenido principal", "siganos", "siganos en", "siguiente", "suscribase al boletin",
    "ver mas", "ver todos", "ver version movil", "version movil", "volver", "volver arriba",
)
NORM = r"(?:ley|decreto(?:-ley)?|decreto ley|sentencia|circular|concepto|auto|resolucion|acuerdo)"

_term = "(?:" + "|".join(sorted(map(re.escape, MENU), key=len, reverse=True)) + ")"
BAR = re.compile(rf"(?:[·|»>/•\-–:;,.=]*\s*{_term}\b\s*[·|»>/•\-–:;,.=]*\s*)+")
CRUMB = re.compile(rf"(?:(?:usted )?esta (?:aqui|en)|ruta)\s*[:=]?\s*.{{0,40}}[>»/].{{0,120}}|(?:{_term}\s*[>»/]\s*)+[a-z][a-z ]{{2,40}}\.?")
BUTTON = re.compile(
    r"(?:" + "|".join(sorted(map(re.escape, CONTROL), key=len, reverse=True)) + r")[.:;]?"
    r"|(?:visitas|lecturas|descargas)\s*[:=]?\s*\d[\d.]*|(?:comentarios|me gusta|compartido)\s*[(\[]?\s*\d+\s*[)\]]?|¿?le fue util este (?:contenido|documento)\??\s*si\W*no\.?|pagina \d+ de \d+ resultados?"
)
COOKIE = re.compile(
    r"(?:(?:valoramos su experiencia|su privacidad es importante|este (?:sitio|portal) (?:usa|utiliza|emplea)|utilizamos|usamos|al continuar navegando|al seguir navegando|we use|this (?:site|portal|website) uses|cookies necesarias)\b.*"
    r"(?:cookies?|galletas|rastreadores|tecnologias de seguimiento|privac).*|(?:\[?acept(?:o|ar|ar todas)\]?|rechazar|\[?no acepto\]?|configurar|entendido|mas informacion|accept all|reject|settings)(?:[·|\s]+(?:\[?acept(?:o|ar|ar todas)\]?|rechazar|\[?no acepto\]?|configurar|entendido|mas informacion|accept all|reject|settings))*)"
)
FOOTER = re.compile(
    r"(?:©|\(c\)|copyright)\s*\d{4}\b.*|linea gratuita\W*\d.{0,50}|pbx\W*\d[\d\W]*|terminos de uso\W.*politica de privacidad.*|vigilado por .{3,60}|correo institucional\W.*@?.*|codigo postal\W*\d.*\bnit\b.*|sede electronica de .{3,80}|calle \d+.{0,12}\d.*horario.*"
    r"|.{3,60}\bversion \d+\.\d+\W+desarrollado por .*|powered by .*|desarrollado por .{3,60}|sitio optimizado para .*|ultima actualizacion\W.{3,40}|todos los derechos reservados\.?|horario de atencion\W.*|nit\W*[\d.\-]+"
)
ITEM = re.compile(rf"\d{{4}}\s*\(\s*\d+\s*\)|boletin n[.º°\s]*\d+|[»>•·]\s*[a-z].{{2,70}}|[»>•·]?\s*{NORM} \d+\s*/\s*\d{{4}}|{NORM} \d+ de \d{{4}}\s*[-–—]\s*[a-z].{{2,60}}")
NAME = re.compile(rf"{NORM} \d+ de \d{{4}}|[a-z]+(?: [a-z]+){{0,5}}")
MARK = re.compile(r"[·|»>/•©@(\[¿:=]")


_WORDS = sorted({w for x in (*MENU, *SIDE, *CONTROL, "linea gratuita última actualizacion codigo postal sede electronica cookies galletas informaticas politica analiticas utilizamos trafico usted esta aqui en boletin util") for w in x.split()})


@lru_cache(maxsize=50_000)
def _guess(word: str) -> str:
    """A word with lost letters as the only word of the fixed lists that fits it, else as it is."""
    if word == LOST:
        return "»"
    fits = re.compile(re.escape(word.strip(".,;:|()")).replace(LOST, ".")).fullmatch
    found = [w for w in _WORDS if fits(w)]
    return word.replace(word.strip(".,;:|()"), found[0]) if len(found) == 1 else word.replace(LOST, "o" if word.startswith("n.") else "")


@lru_cache(maxsize=200_000)
def _fold(line: str) -> str:
    """Lower case without accents and runs of space; º and © stay."""
    if LOST in line:
        line = " ".join(_guess(w) if LOST in w else w for w in line.lower().split())
    out = line.lower() if line.isascii() else "".join(c for c in unicodedata.normalize("NFD", line.lower()) if not "̀" <= c <= "ͯ")
    return " ".join(out.split())


#: Items of a bar in any wording: what separates them, and what one looks like.
SEPARATOR = re.compile(r"\s*[·»>•›]\s*|\s+[|/]\s+")
LINK = re.compile(r"[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑa-záéíóúñ]+(?: [A-ZÁÉÍÓÚÑa-záéíóúñ]+){0,3}")
#: A notice on cookies in any wording: it names them and speaks to the visitor of consent, visits or settings.
CONSENT = re.compile(r"(?=.*\bcookies?\b)(?=.*\b(?:acept|consent|naveg|experiencia|preferencias|configur|visitantes?|accept|agree|settings|browsing|experience))(?:este|esta|nuestro|nuestra|al|si|usamos|utilizamos|empleamos|para|we|our|this|by|us[oa]|las|los|aceptas?|acepte)\b")


def _bar(line: str) -> bool:
    """Whether a line is a bar of links whatever their words: three items or more, each a short capitalised name."""
    items = [x for x in SEPARATOR.split(line.strip().strip("·»>•›|/ ")) if x]
    return len(items) >= 3 and all(map(LINK.fullmatch, items))


@lru_cache(maxsize=100_000)
def implied_block(line: str) -> str:
    """The block a rendered line must have come from: nav, bar (nav unless it stands in a table), button, footer, side (a side block's title), item, name (an item only inside a side block) or main."""
    if not line.strip():
        return ""
    f = _fold(line)
    if f in SIDE or f.rstrip(":.") in SIDE:
        return "side"
    if BUTTON.fullmatch(f):
        return "button"
    if BAR.fullmatch(f) or CRUMB.fullmatch(f):
        return "nav"
    if FOOTER.fullmatch(f):
        return "footer"
    if COOKIE.fullmatch(f) or "cookie" in f and CONSENT.match(f):
        return "button"
    if _bar(line):
        return "bar"
    if ITEM.fullmatch(f):
        return "item"
    first = line.lstrip()[:1]
    if first.isupper() and len(f) <= 60 and NAME.fullmatch(f) and not line.strip().isupper():
        return "name"
    return "main"


def build_lines(text: str) -> tuple[Node, list[int]]:
    """The tree of a rendered text, its leaves being (line number, line), and the numbers of the hidden lines."""
    b = Builder()
    hidden: list[int] = []
    lines = text.split("\n")
    for n, raw in enumerate(lines, 1):
        line = raw.rstrip("\r")
        kind = implied_block(line)
        if kind == "bar":
            # a bar, or a row among rows of a table
            row = "|" in line and any(x.count("|") >= 2 for x in (*lines[max(0, n - 2) : n - 1], *lines[n : n + 1]))
            kind = "main" if row else "nav"
        if kind == "name":
            # a bare name is a side block's item or, between prose lines, part of them
            kind = "item" if any(x.tag == "aside" for x in b.stack) else "main"
        if not kind:
            b.text((n, raw))
            continue
        if kind == "item":
            if not any(x.tag == "aside" for x in b.stack):
                b.open("aside")
            b.open("li")
        elif kind == "side":
            b.open("aside")
        elif kind == "main":
            b.open("main:line")
        else:
            b.open({"nav": "nav", "footer": "footer", "button": "nav"}[kind])
        b.text((n, raw))
        if kind != "main":
            hidden.append(n)
        if kind in ("main", "nav", "footer", "button"):
            b.close("main:line" if kind == "main" else {"nav": "nav", "footer": "footer", "button": "nav"}[kind])
    return b.root, hidden


def _visible(node: Node, out: list[str]) -> None:
    for child in node.children:
        if isinstance(child, Node):
            if not child.hidden:
                _visible(child, out)
        else:
            out.append(child[1])


def main_body(text: str) -> tuple[str, list[int]]:
    """Main body of a page's text and the numbers of the boilerplate lines (from 1).

    Garbled lines are classified by their repaired form and emitted as they are.  Empty text gives an empty body.
    """
    if MARKUP.search(text):
        shown: list[str] = []
        _visible(build_lines(render_markup(text))[0], shown)
        return "\n".join(shown), markup_lines(text)
    readable = repair(text)[0] if suspicious(text) else text
    if readable.count("\n") != text.count("\n"):
        readable = text
    root, hidden = build_lines(readable)
    if not hidden:
        return text, []
    if readable is not text:
        drop = set(hidden)
        body = [x for n, x in enumerate(text.split("\n"), 1) if n not in drop]
    else:
        body = []
        _visible(root, body)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip("\n"), hidden


def boilerplate(chunks: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """One row per boilerplate line: key, linea.  Null and blank texts and blank lines give none.  A narrow map."""
    kind = dict(chunks.dtypes)[key]

    def fn(k: object, t: str) -> Iterator[tuple]:
        return ((k, n) for n in main_body(t)[1])

    return map_text(chunks, key, text, f"`{key}` {kind}, linea bigint", fn)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portal's lines in chunks."""
    return boilerplate(table(spark, sf_dir, "chunks"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk that had boilerplate or markup, with its main body and the number of lines removed."""

    def fn(k: object, t: str) -> Iterator[tuple]:
        body, hidden = main_body(t)
        if hidden or body != t:
            yield k, body, len(hidden)

    return map_text(table(spark, sf_dir, "chunks"), "id", "texto", "id bigint, cuerpo string, quitadas bigint", fn)


QUERIES = {"p2_found": p2_found, "p2_bodies": p2_bodies}
SQL: dict[str, str] = {}
