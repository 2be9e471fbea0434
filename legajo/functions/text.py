"""Text scalars as Column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Garbling left by UTF-8 read as a Latin code page.
GARBLED = "�|Ã[\u0080-¿]|Â[\u0080-¿]|â[€\u0080-¿]"
ACCENTED, BARE = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"


def fold(c: Column) -> Column:
    """Lower case without Spanish accents, white space collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, BARE), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words in lower case, accents kept."""
    return F.regexp_extract_all(F.lower(F.replace(c, F.lit("İ"), F.lit("I"))), F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def garbled_count(c: Column) -> Column:
    """Garbled sequences and replacement characters."""
    return F.regexp_count(c, F.lit(GARBLED)).cast("bigint")


def letter_ratio(c: Column) -> Column:
    """Letters by characters; null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(c, r"[^\p{L}]", "")).cast("double"), F.length(c).cast("double"))


def any_case(pattern: str) -> str:
    """A pattern whose disregard of case covers accented letters too, as this engine's patterns need it said."""
    return pattern.replace("(?i)", "(?iu)").replace("(?im)", "(?imu)").replace("(?i:", "(?iu:")


def article_label(c: Column) -> Column:
    """An article's label without ordinal signs and spaces, in upper case."""
    return F.upper(F.regexp_replace(c, r"[º°ª\s]+", ""))


def blank(c: Column) -> Column:
    """Whether a text holds nothing but white space of any kind; null for null."""
    return F.regexp_replace(c, r"[\s\p{Z}]+", "") == ""


def full_lines(c: Column) -> Column:
    """Lines that hold more than white space."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: ~blank(x))).cast("bigint")


def host(url: Column) -> Column:
    """Host of a URL in lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def settle_id(c: Column) -> Column:
    """A document id in its settled spelling: lower case, underscores, no white space at the ends."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def missing(c: Column) -> Column:
    """Null or empty string."""
    return c.isNull() | (c.cast("string") == "")


def hash_bucket(c: Column, buckets: int) -> Column:
    """The whole SHA-256 of a value as a number, modulo ``buckets``: folded digit by digit, exact at 256 bits."""
    digits = F.transform(F.split(F.sha2(c.cast("string"), 256), ""), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0), lambda a, d: F.pmod(a * 16 + d, F.lit(buckets)))


def first_json_object(c: Column) -> Column:
    """The JSON object inside a Markdown fence, else from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1))


def sentence_count(c: Column) -> Column:
    """Stretches of text between marks that white space or the end follows."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.size(F.filter(F.split(trimmed, r"[.!?]+(?:\s+|$)"), lambda x: F.regexp_replace(x, r"\s+", "") != "")).cast("bigint")


def loose_word_count(c: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_count(c, F.lit(r"\S+")).cast("bigint")


# ---- folding, four rules ------------------------------------------------------------------------------------------------


def _without_marks(low: int, high: int) -> tuple[str, str]:
    """Letters of a code range that carry marks, and their bases, by Unicode's decompositions."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(low, high)]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and d != c]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_MARKED, _BASES = ("".join(x) for x in zip(_without_marks(0xC0, 0x250), _without_marks(0x1E00, 0x1F00)))


def fold_all(c: Column) -> Column:
    """Lower case of any Latin alphabet without marks, combining ones too."""
    return F.translate(F.lower(F.regexp_replace(c, r"\p{M}+", "")), _MARKED, _BASES)


def fold_spaced(c: Column) -> Column:
    """fold() in which underscores are spaces too."""
    return fold(F.translate(c, "_", " "))


def fold_loose(c: Column) -> Column:
    """Lower case without accents, white space collapsed but not trimmed."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, BARE), r"\s+", " ")


def fold_vowels(c: Column) -> Column:
    """Lower case without the accents of vowels; ñ and white space stay."""
    return F.translate(F.lower(c), "áéíóúü", "aeiouu")


def folded_tokens(c: Column) -> Column:
    """Words without case and accents."""
    return F.regexp_extract_all(fold_all(c), F.lit(WORD), F.lit(0))


# ---- numbers and years in words -----------------------------------------------------------------------------------------

# Spanish number words.
UNITS = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve veinte veintiuno veintidos veintitres veinticuatro veinticinco veintiseis veintisiete veintiocho veintinueve".split()
TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()


def year_in_words(y: Column) -> Column:
    """A year of 1900 to 2099 in words without accents, as in mil novecientos noventa y ocho."""
    rest = F.pmod(y.cast("int"), F.lit(100))
    ten, unit = F.floor(rest / 10).cast("int"), F.pmod(rest, F.lit(10))
    units, tens = F.array(*map(F.lit, UNITS)), F.array(*map(F.lit, TENS))
    tail = F.when(rest == 0, "").when(rest < 30, F.get(units, rest - 1)).otherwise(F.concat(F.get(tens, ten - 3), F.when(unit > 0, F.concat(F.lit(" y "), F.get(units, unit - 1))).otherwise("")))
    return F.rtrim(F.concat(F.when(y >= 2000, "dos mil ").otherwise("mil novecientos "), tail))


def full_year(y: Column, rule: str) -> Column:
    """A two-digit year in full: 'citas' up to 49 in this century, 'grafo' from 91 on in the last, 'portal' above 90 in the last."""
    last = {"citas": y >= 50, "grafo": y >= 91, "portal": y > 90}[rule]
    return F.when(y >= 100, y).when(last, 1900 + y).otherwise(2000 + y)


_ORDINALS = "primero segundo tercero cuarto quinto sexto septimo octavo noveno decimo undecimo duodecimo".split()
_ORDINAL_TENS = "vigesimo trigesimo cuadragesimo quincuagesimo sexagesimo septuagesimo octogesimo nonagesimo".split()


def ordinal_number(c: Column) -> Column:
    """A Spanish ordinal of one or two words as a number; null for other words."""
    table = {w: i for i, w in enumerate(_ORDINALS, 1)} | {"primer": 1, "tercer": 3} | {"decimo" + w: 10 + i for i, w in enumerate(_ORDINALS[:9], 1)} | {w: 10 * i for i, w in enumerate(_ORDINAL_TENS, 2)}
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    words = F.split(fold(c), " ")
    first, second = known[F.get(words, F.lit(0))], known[F.get(words, F.lit(1))]
    return F.when(F.size(words) == 1, first).when((F.size(words) == 2) & (first >= 10) & (second < 10), first + second)


def article_key(c: Column) -> Column:
    """An article's label for comparing: lower case without accents and ordinal signs; its number, else the trimmed words, else null."""
    t = F.regexp_replace(F.translate(F.lower(c), ACCENTED, BARE), r"(?U)[º°ªo](?![\p{L}\p{N}_])", "")
    n = F.regexp_extract(t, r"^\s*(\d+(?:\.\d+)*[a-z]?)", 1)
    return F.nullif(F.when(n != "", n).otherwise(F.regexp_replace(t, r"^[ .\-]+|[ .\-]+$", "")), F.lit(""))


# ---- ids ----------------------------------------------------------------------------------------------------------------



def id_metadata(c: Column) -> Column:
    """struct(tipo, numero, anio, organo) read from a document id; kind 'documento' where no family fits."""
    g = lambda p, i: F.regexp_extract(c, p, i)
    norm, cc, auto = r"^(?:co_)?(ley|decreto|acto_legislativo)_(\d+)_(\d{4})$", r"^sentencia_cc_(c|t|su)(\d+)([a-z]?)_(\d{4})$", r"^auto_cc_a(\d+)_(\d{4})$"
    csj, ce, sic, decision = r"^sentencia_csj_([a-z]*)(\d+)_(\d{4})$", r"^sentencia_ce_(.+)_(\d{4})$", r"^sentencia_sic_(\d+)_(\d{4})$", r"^decision_(\d+)_(\d{4})$"
    three = lambda n: F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    bare = lambda n: F.regexp_replace(n, r"^0+(?=\d)", "")

    def row(kind: Column | str, number: Column, year: Column, issuer: Column | str) -> Column:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(as_col(kind).alias("tipo"), number.alias("numero"), year.cast("int").alias("anio"), as_col(issuer).alias("organo"))

    issuer = F.when(g(norm, 1) == "decreto", "Presidencia de la República").otherwise("Congreso de la República")
    return (
        F.when(c.rlike(norm), row(g(norm, 1), g(norm, 2), g(norm, 3), issuer))
        .when(c == "co_constitucion_1_1991", row("constitucion", F.lit("1991"), F.lit(1991), "Asamblea Nacional Constituyente"))
        .when(c.rlike(cc), row("sentencia", F.concat(F.upper(g(cc, 1)), F.lit("-"), three(bare(g(cc, 2))), F.upper(g(cc, 3))), g(cc, 4), "Corte Constitucional"))
        .when(c.rlike(auto), row("auto", F.concat(F.lit("A-"), g(auto, 1)), g(auto, 2), "Corte Constitucional"))
        .when(c.rlike(csj), row("sentencia", F.concat(F.upper(g(csj, 1)), g(csj, 2)), g(csj, 3), "Corte Suprema de Justicia"))
        .when(c.rlike(ce), row("sentencia", F.upper(g(ce, 1)), g(ce, 2), "Consejo de Estado"))
        .when(c.rlike(sic), row("sentencia", g(sic, 1), g(sic, 2), "Superintendencia de Industria y Comercio"))
        .when(c.rlike(decision), row("decision", g(decision, 1), g(decision, 2), "Comisión de la Comunidad Andina"))
        .otherwise(row("documento", F.lit(None).cast("string"), F.lit(None), F.lit(None).cast("string")))
    )


def built_id(kind: Column, number: Column, year: Column) -> Column:
    """The document id of a body: judgments of the constitutional court padded to three digits, others bare; null without a number."""
    chamber, digits = F.lower(F.regexp_extract(number, r"^([A-Za-z]+)-", 1)), F.regexp_extract(number, r"(\d+)$", 1).cast("bigint").cast("string")
    cc = F.concat(F.lit("sentencia_cc_"), chamber, F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits), F.lit("_"), year)
    csj = F.concat(F.lit("sentencia_csj_"), chamber, digits, F.lit("_"), year)
    return F.when(kind == "jurisprudencia", F.when(chamber.isin("c", "t", "su"), cc).otherwise(csj)).otherwise(F.concat(kind, F.lit("_"), digits, F.lit("_"), year))


def reference_kind(c: Column) -> Column:
    """The kind of a reference's key: court and chamber of a judgment, else what stands before the number, else the key."""
    j = r"^sentencia_(cc|csj|ce)_([a-z]+)\d"
    other = F.regexp_extract(c, r"^([a-z_]+?)_\d", 1)
    return F.when(c.rlike(j), F.concat(F.lit("sentencia_"), F.regexp_extract(c, j, 1), F.lit("_"), F.regexp_extract(c, j, 2))).otherwise(F.when(other != "", other).otherwise(c))


def source_name(c: Column) -> Column:
    """A source's canonical name: the portal of public administration under one name, dashes plain, trimmed; null gives empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    plain = F.translate(t, "áéíóúÁÉÍÓÚ", "aeiouAEIOU")
    return F.when(F.contains(t, F.lit("Gestor Normativo")) | F.contains(plain, F.lit("Funcion Publica")), "Departamento Administrativo de la Función Pública - Gestor Normativo").otherwise(F.translate(t, "—", "-"))


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(fold_all(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def without_tags(c: Column) -> Column:
    """Text without markup tags, the common character references read, white space collapsed."""
    t = F.regexp_replace(c, r"<[^<>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("aacute", "á"), ("eacute", "é"), ("iacute", "í"), ("oacute", "ó"), ("uacute", "ú"), ("ntilde", "ñ"), ("amp", "&")):
        t = F.regexp_replace(t, f"&{name};", char)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def shortened(c: Column, limit: int) -> Column:
    """A text above the limit cut at its last space before, with a mark that it goes on."""
    head = F.left(c, F.lit(limit))
    cut = F.regexp_replace(head, r"(?s) [^ ]*$", "")
    return F.when(F.length(c) > limit, F.concat(cut, F.lit(" […]"))).otherwise(c)


# ---- dates --------------------------------------------------------------------------------------------------------------

MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
DATE = r"(?i)\b(\d{1,2}) de (enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre) del? (\d{4})\b"


def first_date(c: Column) -> Column:
    """The first date in words of a text; null if there is none or it doesn't exist."""
    g = lambda i: F.regexp_extract(c, any_case(DATE), i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_replace(F.lower(g(2)), "setiembre", "septiembre"))
    return F.when(g(1) != "", F.try_to_date(F.concat_ws("-", g(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(g(1), 2, "0")), "yyyy-MM-dd"))


def colombian_date(ts: Column) -> Column:
    """The date in Colombia (UTC-5) of a moment in UTC."""
    return F.to_date(ts - F.expr("INTERVAL 5 HOURS"))


# ---- hashes and mathematics ----------------------------------------------------------------------------------------------


def json_hash(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of named fields: keys sorted, no spaces, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]), {"ignoreNullFields": "false"}), 256)


def blob_hash(c: Column) -> Column:
    """SHA-1 of content as version control hashes it: with its kind and length before it."""
    data = F.encode(c, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(c).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def norm_l2(v: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def softmax_first(a: Column, b: Column) -> Column:
    """The first of two logits as a probability."""
    return 1 / (1 + F.exp(b - a))


def once(value: Column, use) -> Column:
    """use(value) with the value computed a single time however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def holds_any(text: Column, pattern: str) -> Column:
    """Whether a text matches an alternation; alternatives of plain letters are looked up as such, which costs far less."""
    import re

    parts = re.split(r"\|(?![^(]*\))", pattern)
    plain = [p for p in parts if re.fullmatch(r"[a-z ]+", p)]
    rest = [p for p in parts if p not in plain]
    out = text.rlike("|".join(rest)) if rest else F.lit(False)
    for p in plain:
        out = F.contains(text, F.lit(p)) | out
    return out


# ---- rules on texts ------------------------------------------------------------------------------------------------------

# Areas and the words that name them, in order.
AREAS = {
    "tributario": r"impuest|tribut|\brenta\b|\biva\b|gravamen|contribucion|\bdian\b|aduan|retencion en la fuente|timbre|predial|industria y comercio|sobretasa|estampilla",
    "laboral": r"trabaj|laboral|empleo|salari|pension|seguridad social|cesantia|prestaciones sociales|sindic|riesgos (?:laborales|profesionales)|subsidio familiar|carrera administrativa",
    "penal": r"penal|delito|\bpenas?\b|carcel|penitenci|crimin|estupefacientes|extincion de dominio|narcotrafic|terroris|lavado de activos|corrupcion",
    "procesal": r"procedimiento|\bproceso|procesal|jurisdicci|juzgad|jueces|conciliaci|arbitraje|administracion de justicia|accion de tutela|acciones populares|rama judicial|casacion|descongestion",
    "comercial": r"sociedad|comerci|mercantil|empresa|insolvencia|reorganizacion|financier|bancari|seguros|mercado de valores|camaras? de comercio|contador|titulos valores|cooperativ|emprendimiento|factura",
    "civil": r"civil|contrato|propiedad horizontal|bienes|registro|notari|arrendamiento|vivienda|obligaciones|sucesion|responsabilidad civil|tierras|baldios|catastro|propiedad raiz",
    "familia": r"familia|matrimonio|menores? de edad|nin[oa]s|infancia|adolescen|adopci|alimentos|mujer|violencia intrafamiliar|divorcio|union marital|adulto mayor|discapacidad|genero|paternidad",
    "mercados": r"consumidor|competencia desleal|libre competencia|practicas comerciales restrictivas|datos personales|habeas data|propiedad intelectual|derechos? de autor|propiedad industrial|marcas?\b|patente|publicidad|telecomunicaciones|tecnologias de la informacion|comercio electronico|proteccion de datos",
    "constitucional": r"estatutaria|reforma constitucional|constitucion politica|derechos fundamentales|participacion ciudadana|referendo|plebiscito|partidos politicos|mecanismos de participacion|acto legislativo|paz|victimas",
    "administrativo": r"administrativ|contratacion (?:estatal|publica)|funcion publica|servidores publicos|municipi|departament|ministerio|presupuest|regalias|contralor|disciplinari|policia|servicios publicos|entidades? territorial|ordenamiento territorial|electoral|salud|educacion|transporte|planeacion|descentralizacion",
}
EPIGRAPH_START = r"\bpor (?:medio de )?(?:la|el) cual\b|\bpor la que\b|\bsobre\b|\bmediante (?:la|el) cual\b"
EPIGRAPH_END = r"\bel congreso de (?:colombia|la republica)\b|\bel presidente de la republica\b|\bdecreta\s*:|\bresumen de notas\b|\bjurisprudencia vigencia\b|\barticulo (?:1|primero|unico)(?:$|[^\p{L}\p{N}_])"


def epigraph(c: Column) -> Column:
    """What a norm says of itself: from its opening formula to its first article or enacting clause, 1,500 characters at most, of the first 8,000."""
    head = F.regexp_replace(fold_loose(F.left(c, F.lit(8000))), r"<[^>]*>", " ")
    body = once(head, lambda h: once(F.regexp_extract(h, rf"(?s)(?:{EPIGRAPH_START}).*$", 0), lambda b: F.when(b != "", b).otherwise(h)))
    return F.left(F.regexp_extract(body, rf"(?s)^(.*?)(?:{EPIGRAPH_END}|$)", 1), F.lit(1500))


def areas_of(text: Column) -> Column:
    """The areas that an epigraph names, in order; administrative law where none is."""
    found = once(text, lambda t: F.array_compact(F.array(*[F.when(holds_any(t, p), n) for n, p in AREAS.items()])))
    return once(found, lambda a: F.when(F.size(a) == 0, F.array(F.lit("administrativo"))).otherwise(a))


# How a source marks norms and articles that no longer hold.
_REPEALED = r"<\s*(?:ley|decreto|decreto ley|acto legislativo|norma|codigo)\b[^>]{0,60}\bderogad[oa]"
_VOID = r"<\s*(?:ley|decreto|decreto ley|acto legislativo|norma)\b[^>]{0,60}\binexequible\b"
_ARTICLE_REPEALED = r"<\s*articulo\s+(?:derogado|subrogado)|<\s*articulo[^>]{0,40}\binexequible\b"
_NOTE = r"<\s*(?:articulo|inciso|numeral|literal|paragrafo)[^>]{0,40}\b(?:modificado|derogado|adicionado|inexequible|exequible|subrogado)"


def validity(c: Column) -> Column:
    """What a source's marks say of a norm: repealed or void as a whole (in its heading, or nine in ten of its three articles or more), with notes, or no mark."""
    def of(body: Column) -> Column:
        head = F.left(body, F.lit(6000))
        before = F.regexp_extract(head, r"(?s)^(.*?)\bpor (?:medio de )?(?:la|el) cual\b", 1)
        heading = F.when(head.rlike(r"\bpor (?:medio de )?(?:la|el) cual\b"), before).otherwise(F.left(head, F.lit(1500)))
        articles = F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\barticulo\s+\d+"), F.lit(0))))
        repealed = (articles >= 3) & (F.regexp_count(body, F.lit(_ARTICLE_REPEALED)) >= 0.9 * articles)
        # every mark is a remark between angle brackets
        marked = F.when(heading.rlike(_REPEALED), "derogada").when(heading.rlike(_VOID), "inexequible").when(repealed, "derogada").when(body.rlike(_NOTE), "con_notas").otherwise("sin_marca")
        return F.when(F.contains(body, F.lit("<")), marked).otherwise("sin_marca")

    return once(fold_loose(c), of)


def level(scope: Column, state: Column, bulk: Column, cited: Column) -> Column:
    """Whether a norm belongs to the core: not those of other scopes or without force, nor those of a bulk source that nothing cites."""
    return F.when(scope.isin("tratado_internacional", "honorifica", "ambiental") | state.isin("derogada", "inexequible"), "complementario").when(bulk & ~cited, "complementario").otherwise("nucleo")


def words_between(text: Column, start: Column, end: Column) -> Column:
    """How many words begin in a half-open stretch of a text."""
    return word_count(F.left(text, end.cast("int"))) - word_count(F.left(text, start.cast("int")))


def names_norm(text: Column, kind: Column, number: Column, year: Column) -> Column:
    """Whether a text's first 80,000 characters name the norm or judgment that it is filed as; true for kinds without a rule.

    Norms by kind, number and year, a full date between them allowed; judgments by chamber and number, in any of their
    spellings; a constitution by its name.
    """
    t = fold_vowels(F.regexp_replace(F.left(text, F.lit(80000)), r"\s+", " "))
    n, y = F.regexp_extract(number, r"0*(\d+)", 1), year.cast("string")
    norm = F.concat(F.lit(r"\b"), F.translate(kind, "_", " "), F.lit(r"\b[^0-9]{0,25}0*"), n, F.lit(r" del? (?:[0-9]+ de [a-z]+ de )?"), y)
    chamber = F.lower(F.regexp_extract(number, r"^([A-Za-z]+)", 1))
    judgment = F.concat(F.lit(r"\b"), chamber, F.lit(r"\s*[-.]?\s*0*"), n, F.lit(r"(?:$|[^\p{L}\p{N}_])"))
    known = (n != "") & y.isNotNull()
    return (
        F.when(kind.isin("ley", "decreto", "acto_legislativo") & known, F.regexp_like(t, norm)).when(kind == "constitucion", t.contains("constitucion politica"))
        .when(kind.isin("sentencia", "auto") & (n != "") & (chamber != ""), F.regexp_like(t, judgment)).when(kind.isin("sentencia", "auto") & (n != ""), t.contains(n)).otherwise(F.lit(True))
    )
