"""Problem 6: template residue, filler, error pages and demands for scripts.

One multi-pattern automaton holds the phrases (several languages) of error, blocking, session, maintenance, filler and
script-required texts, and the delimiters that open template fields.  A text is excluded when the phrases cover a high
share of its readable length; a legal text that merely speaks of such things is covered little.  A field left unfilled
counts wherever it stands: the automaton finds its delimiter and the field's own grammar verifies it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, table

#: Share of a text's letters that phrases must cover.
COVERAGE = 0.4
#: Share of letters in pseudo-Latin words from which a text without function words is filler as a whole, and its least words.
SALAD, SALAD_WORDS = 0.3, 8

# How portals, servers and page templates word messages, by kind.  A bracket lists alternatives, so a rule
# stands for all its wordings; rules are folded to lower case without accents and matched on word boundaries.
PHRASES = {
    "error": (
        "(http|error|codigo|code|status|erreur|erro|fehler|) (http|de|) (400|401|403|404|405|406|408|409|410|413|414|415|429|431|451|500|501|502|503|504|505|508|511)",
        "(pagina|documento|recurso|archivo|enlace|contenido|sitio|norma|expediente|registro) (no encontrado|no encontrada|no existe|inexistente|no disponible|no valido|eliminado|retirado)", "(el|la|este|esta) (recurso|pagina|documento|archivo|enlace|contenido|norma) (solicitado|solicitada|buscado|que busca|consultado|consultada|requerido|) (ya|) (no existe|no esta disponible|no se encuentra disponible|fue eliminado|fue movida|fue movido|no fue encontrado|no fue encontrada)",
        "(no existe|) o (fue|ha sido) (trasladado|movido|eliminado|retirado|trasladada|movida|eliminada)", "no se (encontro|encontraron|hallo|hallaron|obtuvieron) (ningun|) (resultado|resultados|registro|registros|coincidencias|documentos|contenido|la pagina|el documento|el archivo|el recurso)",
        "(para|con|en) (la|el|su|los|las|esta|este) (norma|busqueda|consulta|documento|criterios|termino|palabra|pagina|radicado|filtro) (consultada|consultado|solicitada|solicitado|indicada|indicado|realizada|ingresada|ingresados|buscada|)", "su (busqueda|consulta) no (arrojo|produjo|obtuvo) (resultados|ningun resultado)", "sin resultados",
        "(ha ocurrido|ocurrio|se ha producido|se produjo|se presento|se ha presentado|hubo) un (error|problema|fallo|inconveniente|evento) (inesperado|interno|tecnico|desconocido|en el servidor|en el sistema|)", "al (cargar|abrir|procesar|descargar|mostrar|consultar|leer|generar|obtener|guardar|enviar) (el|la|los|su) (archivo|documento|pagina|contenido|norma|informacion|solicitud|consulta|anexo|texto|datos) (adjunto|solicitado|solicitada|consultada|consultado|)",
        "(comuniquese|contacte|contactese|pongase en contacto|informe) (con|al|a) (el|) (administrador|soporte|area de soporte|webmaster|mesa de ayuda) (tecnico|) (del|de la|) (portal|sitio|sistema|pagina|aplicacion|)", "(lo sentimos|disculpe|disculpas|ups|oops)", "no (pudimos|fue posible|se pudo|podemos|es posible) (atender|procesar|completar|mostrar|cargar|abrir|realizar|establecer|encontrar) (su|la|el) (consulta|solicitud|conexion|pagina|documento|contenido|archivo|peticion)",
        "(por favor|) (intente|intentelo|vuelva a intentar|vuelva a intentarlo|reintente) (de nuevo|nuevamente|otra vez|) (mas tarde|en unos minutos|en unos instantes|)", "error (interno|fatal|inesperado|desconocido|critico) (del|de) (servidor|sistema|aplicacion|la aplicacion)", "error (interno|fatal|inesperado|desconocido)", "error en (la aplicacion|el servidor|el sistema|la consulta|la base de datos|el proceso)", "(el|) (servicio|servidor|sistema|sitio) (temporalmente|) no (esta|se encuentra|) disponible",
        "acceso (prohibido|no autorizado|restringido al sistema)", "(usted|) no (tiene|cuenta con) (permiso|permisos|autorizacion) (para|de) (acceder|ver|consultar|ingresar) (a|) (esta pagina|este recurso|este contenido|este documento|)", "solicitud (incorrecta|invalida|no valida|mal formada)", "tiempo de espera (agotado|excedido)", "puerta de enlace (incorrecta|no valida)", "demasiadas (solicitudes|peticiones|conexiones)", "no se pudo (abrir|establecer) la conexion", "no se pudo conectar (con|al|a) (el|la|) (servidor|base de datos|servicio)",
        "(the|) (requested|) (page|file|url|document|resource|content|item) (you requested|you are looking for|) (was|is|could|has|does|) (not found|not be found|not exist|been removed|been moved|not available|no longer available) (on this server|)", "not found", "internal server error", "bad gateway", "gateway (timeout|time out)", "service (temporarily|) unavailable", "access (denied|forbidden)", "bad request", "too many requests", "no results (found|were found)", "request (timeout|timed out)", "method not allowed", "you (don t|do not) have permission to (access|view)",
        "something went wrong", "(an|) (unexpected|internal|unknown) error (has|) (occurred|happened)", "an error occurred", "please (try again|contact) (later|the administrator|support|the site administrator)", "please slow down", "please try again", "request id", "failed to (open stream|load|connect|fetch)", "no such file or directory", "(uncaught|unhandled) (exception|error)", "stack trace", "traceback most recent call last", "fatal error", "undefined (variable|index|function|method|offset)", "you have an error in your sql syntax", "(connection|socket) (refused|timed out|reset by peer)", "could not connect",
        "pagina nao encontrada", "(o documento|a pagina|o arquivo) (solicitado|solicitada|) nao (existe|foi encontrado|foi encontrada)", "acesso negado", "erro interno do servidor", "servico (indisponivel|temporariamente indisponivel)", "ocorreu um erro (inesperado|)", "tente novamente (mais tarde|)", "nenhum resultado encontrado", "page (non trouvee|introuvable)", "acces refuse", "une erreur (est survenue|s est produite)", "veuillez reessayer plus tard", "erreur interne du serveur", "seite (wurde|) nicht gefunden", "zugriff verweigert", "ein fehler ist aufgetreten", "pagina non trovata", "accesso negato", "si e verificato un errore",
        "страница не найдена", "доступ запрещен", "произошла ошибка", "внутренняя ошибка сервера", "η σελιδα δεν βρεθηκε", "页面不存在", "页面未找到", "找不到页面", "访问被拒绝", "服务器内部错误", "ページが見つかりません", "アクセスが拒否されました", "페이지를 찾을 수 없습니다", "الصفحة غير موجودة",
    ),
    "blocking": (
        "(un|espere un) momento (por favor|)", "(estamos|) (verificando|comprobando|validando) (que|si|su|) (usted|) (no|) (es un robot|es humano|es una persona|navegador|identidad|conexion)", "(verifique|confirme|compruebe|demuestre) que (usted|) (no es un robot|es humano|es una persona)", "no soy un robot", "(escriba|ingrese|digite|introduzca) los (caracteres|digitos|numeros|simbolos) (de|que ve en|que aparecen en|que muestra) la imagen (para continuar|)", "su (direccion ip|ip|direccion|equipo|red|acceso) (ha sido|fue|esta) (bloqueada|bloqueado|restringida)",
        "(solicitud|acceso|conexion) (bloqueada|bloqueado)", "trafico inusual (desde|de) su (red|equipo|conexion|direccion)", "ray id", "cloudflare", "por razones de seguridad", "checking (your browser|if the site connection is secure) (before accessing|)", "(please|) (verify|confirm|prove) (that|) you are (a|) human", "are you a robot", "i m not a robot", "unusual traffic (from your computer network|)", "(your ip|you|your access|your request|your ip address) (has|have) been blocked", "attention required", "just a moment", "request blocked", "the request could not be satisfied", "incident id", "(enter|type) the characters (you see|in the image|shown)", "complete the captcha",
        "verifique que voce nao e um robo", "verifiez que vous etes humain", "bitte bestatigen sie dass sie kein roboter sind", "подтвердите что вы не робот", "请完成验证", "请输入验证码",
    ),
    "session": (
        "(su|la|tu) sesion (ha|) (caducado|expirado|expiro|caduco|finalizado|terminado|vencido|sido cerrada) (por inactividad|)", "sesion (expirada|finalizada|caducada|vencida|cerrada)", "(vuelva|debe volver) a (ingresar|iniciar sesion|autenticarse|identificarse|entrar) (para ver el documento|para continuar|al sistema|)", "(debe|) (inicie|iniciar) sesion para (continuar|ver este contenido|ver el documento|acceder)", "debe (iniciar sesion|autenticarse|identificarse|registrarse)", "(ingrese|digite|introduzca) su (usuario|correo|cuenta) y (contrasena|clave)",
        "your session (has|) (expired|timed out|ended) (due to inactivity|)", "session (expired|timed out)", "(please|you must|you need to) (log in|login|sign in|be logged in) (again|to continue|to view this document|)", "sua sessao (expirou|foi encerrada)", "faca login (novamente|para continuar|)", "votre session a expire", "veuillez vous reconnecter", "ihre sitzung ist abgelaufen", "сессия истекла", "会话已过期",
    ),
    "maintenance": (
        "(estamos|nos encontramos|sitio|portal|pagina|servicio|sistema|servidor|aplicacion) en (mantenimiento|construccion) (programado|)", "(realizando|estamos realizando|por) (labores|tareas|trabajos) de mantenimiento", "(regresaremos|volveremos|estaremos de vuelta|estaremos de regreso) (pronto|el|en breve|en unos minutos)", "disculpe (las molestias|los inconvenientes)", "(ofrecemos|presentamos) disculpas por (las molestias|los inconvenientes)", "(under|down for|scheduled) maintenance", "we (will|ll) be (right|) back (soon|shortly|)", "under construction", "em manutencao", "voltaremos em breve", "en maintenance", "wartungsarbeiten", "ведутся технические работы", "系统维护中", "メンテナンス中",
    ),
    "script": (
        "su navegador (no es compatible|no soporta|no admite|no permite|tiene deshabilitado|tiene desactivado) (o tiene bloqueado|o tiene desactivado|)", "(el|la) (texto|contenido|pagina|documento|visor) (de la norma|del documento|) no (puede|se puede) (mostrarse|mostrar|visualizarse|cargarse)", "(para|) (ver|consultar|usar|visualizar|acceder a) (este|esta|el) (contenido|pagina|sitio|portal|documento|aplicacion) (debe|necesita|es necesario|tiene que) (habilitar|activar|permitir|tener)", "(este|esta|el|la) (portal|sitio|pagina|aplicacion|visor|servicio) (requiere|necesita|exige|precisa)", "(activelo|habilitelo|permitalo) y (recargue|actualice|vuelva a cargar) (la pagina|)", "(recargue|actualice) la pagina", "(active|habilite|permita|encienda) (el|la|los|) (javascript|java script|scripts|ejecucion de scripts)",
        "you need to (enable|turn on|allow)", "to (run|use|view) this (app|site|page|document|application|website)", "(please|) (enable|turn on|allow) (javascript|it|scripts|scripting)", "your browser (does not support|doesn t support|has disabled|is not supported)", "or it is disabled", "(please|) enable it to view this document", "is required to (view|use|run) this (page|site|app|document)", "(is|are) disabled in your browser", "this (site|page|app|portal|website) requires", "noscript", "voce precisa habilitar", "habilite o javascript", "seu navegador nao suporta", "este site requer", "(veuillez|) activer javascript", "votre navigateur ne prend pas en charge", "bitte aktivieren sie javascript", "(cargando|abriendo) (el|) (visor|documento|contenido|pagina) (de documentos|de la norma|)", "si el (visor|documento|contenido) no (aparece|carga|se muestra)", "включите javascript", "请启用 javascript", "javascriptを有効にしてください",
    ),
    "filler": (
        # the public lorem ipsum and the passage of Cicero's De finibus that it is cut from
        "(lorem|ipsum|dolor|sit|amet|consectetur|consectetuer|adipiscing|adipisicing|elit|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum|perspiciatis|unde|omnis|iste|natus|voluptatem|accusantium|doloremque|laudantium|totam|aperiam|eaque|ipsa|inventore|veritatis|architecto|beatae|explicabo|nemo|ipsam|quia|voluptas|aspernatur|fugit|consequuntur|magni|dolores|eos|ratione|sequi|nesciunt|neque|porro|quisquam|dolorem|numquam|eius|modi|tempora|incidunt|magnam|aliquam|quaerat|nostrum|exercitationem|ullam|corporis|suscipit|laboriosam|aliquid|commodi|consequatur|autem|vel|eum|iure|quam|nihil|molestiae|illum|vero|accusamus|iusto|odio|dignissimos|ducimus|blanditiis|praesentium|voluptatum|deleniti|atque|corrupti|quos|quas|molestias|excepturi|occaecati|similique|mollitia|dolorum|fuga|harum|quidem|rerum|facilis|expedita|distinctio|libero|tempore|soluta|nobis|eligendi|optio|cumque|impedit|minus|quod|maxime|placeat|facere|possimus|assumenda|repellendus|temporibus|quibusdam|officiis|debitis|necessitatibus|saepe|eveniet|voluptates|repudiandae|recusandae|itaque|earum|hic|tenetur|sapiente|delectus|reiciendis|voluptatibus|maiores|alias|perferendis|doloribus|asperiores|repellat)",
        "(este es un|esto es un|) (texto|parrafo|contenido|documento|titulo) (de|a modo de) (ejemplo|muestra|prueba|relleno) (para la seccion|)", "(este es un|) texto (provisional|simulado|ficticio|temporal) (de la plantilla|)", "(escriba|inserte|ingrese|coloque|agregue|anada|digite) (aqui|su|el) (su|el|la|) (texto|descripcion|contenido|titulo|resumen) (aqui|)", "aqui va (el|la|su) (contenido|texto|descripcion|titulo|resumen) (de la norma|del documento|)", "(contenido|texto|informacion|documento) (pendiente|en preparacion|en construccion|por definir) (de cargue|de publicacion|de carga|)", "pendiente de (cargue|carga|publicacion)", "sin contenido", "proximamente disponible",
        "this is a placeholder", "placeholder text", "(sample|dummy|filler|example) text", "your (text|content|title) here", "(insert|add|enter|type) (your|) (text|content|description) here", "content goes here", "coming soon", "texto de exemplo", "insira (seu|o) texto aqui", "texte d exemple", "votre texte ici", "beispieltext", "el veloz murcielago hindu comia feliz cardillo y kiwi", "the quick brown fox jumps over the lazy dog",
    ),
}
#: Words that are ordinary in legal text: they only add to the coverage of a text that a telling phrase is in.
WEAK = {
    "error": ("referencia", "http", "error", "warning", "on line", "acceso denegado", "forbidden", "unauthorized", "id", "code", "sql"),
    "blocking": ("captcha", "ray", "para continuar"),
    "maintenance": ("en mantenimiento", "mantenimiento programado", "temporalmente"),
    "script": ("javascript", "java script", "los scripts", "scripts", "la ejecucion de scripts", "en su navegador", "debe (habilitar|activar)", "compruebe que", "(este|esta) activo", "is required", "to continue", "active", "habilite", "documento", "cargando", "loading", "please wait"),
    "filler": ("sed", "do", "ut", "et", "enim", "ad", "ex", "ea", "in", "eu", "non", "qui", "id", "est", "proximamente"),
}
#: What programs print: calls of a stack, source lines, statements.  Verified on the text as stored; never telling alone.
TRACES = (
    re.compile(r"\bat [\w$]+(?:\.[\w$<>]+)+\([^()\n]*\)|\b[\w$]+(?:\.[\w$]+)*(?:Exception|Error)\b(?=[:\s]|$)|\bFile \"[^\"\n]+\", line \d+(?:, in \S+)?"),
    re.compile(r"\bin (?:[A-Z]:)?[\\/][\w.\\/-]+ on line \d+|\binclude\([^()\n]*\)|\b\w+\.(?:php|aspx?|jsp)\b"),
    re.compile(r"\b(?:SELECT\b[^;\n]*\bFROM\b|INSERT INTO\b|UPDATE\b[^;\n]*\bSET\b|DELETE FROM\b)[^;\n]*"),
    re.compile(r"(?i)\b(?:micro)?(?:servicio|service)s?\s+\w+:\s+(?=[A-Z]{2,}-\d)|\b[A-Z]{2,6}-\d{3,6}\b(?=:)"),
)
#: Function words of the languages that texts come in; pseudo-Latin has none of them.
FUNCTION = frozenset("de la el los las del que y en por para con un una se no su lo al the of and to is for with from that os da dos das em uma que pelo pela le les des du une der die das und".split())


_QUICK = (" de ", " la ", " el ", " que ", " the ", " of ")


def expanded(rule: str) -> list[str]:
    """The wordings that a rule stands for."""
    out = [""]
    for literal, choices in re.findall(r"([^()]+)|\(([^()]*)\)", rule):
        out = [a + b for a in out for b in (choices.split("|") if choices or not literal else [literal])]
    return out


#: Delimiter that opens a field, and the grammar of the whole field there (case-insensitive unless marked); what closes a
#: field bounds it, not a length.
_NAME = r"[a-z][\w.]+"
FIELDS = (
    ("{{", re.compile(rf"\{{\{{[\s>#/&^]*{_NAME}(?:\s*\|[^{{}}]*)?\s*\}}\}}", re.I)),
    ("{%", re.compile(r"\{%-?\s*[a-z]+[^{}%\n]*%\}", re.I)),
    ("<%", re.compile(r"<%[=#-]?[^<>%\n]+%>")),
    ("${", re.compile(rf"\$\{{\s*{_NAME}\s*\}}", re.I)),
    ("$p{", re.compile(rf"\$[pfv]\{{\s*{_NAME}\s*\}}", re.I)),
    ("{", re.compile(r"(?<![{$%\w])\{[a-z][a-z_]{2,}\d*\}(?!\})", re.I)),
    ("[[", re.compile(r"\[\[\s*[a-z][a-z_ .]+\s*\]\]", re.I)),
    ("<<", re.compile(r"<<\s*[a-z][a-z_ .]+\s*>>", re.I)),
    ("&lt;", re.compile(r"(?:&lt;){1,2}\s*[a-z][a-z_ .]+\s*(?:&gt;){1,2}", re.I)),
    ("@model.", re.compile(r"@model\.[a-z]\w+", re.I)),
    ("%", re.compile(r"(?<!\w)%[A-Z][A-Z_]{2,}%(?!\w)|(?<!\w)%[a-z]+_[a-z_]+%(?!\w)")),
    ("#", re.compile(r"(?<!\w)#[A-Z][A-Z_]{2,}#(?!\w)")),
    ("__", re.compile(r"(?<!\w)__[A-Z][A-Z_]+[A-Z]__(?!\w)")),
    ("[insert", re.compile(r"\[\s*insert(?:ar|e)?\b[^\[\]\n]+\]", re.I)),
    ("[complet", re.compile(r"\[\s*complet(?:ar|e)\b[^\[\]\n]+\]", re.I)),
    ("[diligenci", re.compile(r"\[\s*diligenci(?:ar|e)\b[^\[\]\n]*\]", re.I)),
    ("[indi", re.compile(r"\[\s*indi(?:car|que)\b[^\[\]\n]*\]", re.I)),
    ("[escrib", re.compile(r"\[\s*escrib(?:ir|a)\b[^\[\]\n]*\]", re.I)),
    ("aqui]", re.compile(r"\[[a-záéíóúñ_ ]{2,} aqu[ií]\]", re.I)),
    ("here]", re.compile(r"\[[a-z_ ]{2,} here\]", re.I)),
    ("[●", re.compile(r"\[\s*●\s*\]")),
    ("[•", re.compile(r"\[\s*•\s*\]")),
    ("xxxxx", re.compile(r"(?<!\w)x{5,}(?!\w)", re.I)),
    ("«", re.compile(r"«[A-Z]{3,}(?:_[A-Z]{2,})*»")),
)
_GRAMMAR = dict(FIELDS)


#: Latin-1 byte to what it folds to: an ASCII letter or digit, or a space.
_PLAIN = bytes(ord(c) if (c := unicodedata.normalize("NFD", chr(b).lower())[0]).isascii() and c.isalnum() else 32 for b in range(256))


def _wide(text: str) -> str:
    """fold() of a text beyond Latin-1: letters of every script stay, ideographs stand alone."""
    out = []
    for c in unicodedata.normalize("NFKD", text.lower()):
        if not c.isalnum():
            out.append("" if unicodedata.combining(c) else " ")
        else:
            out.append(f" {c} " if c >= "\u2e80" else c)
    return " ".join("".join(out).split())


#: Letters beyond Latin-1 that aren't those of a Latin alphabet's typography.
_BEYOND = re.compile(r"[\u0100-\u02af\u0370-\u1fff\u2e80-\ud7ff\uf900-\ufdff\ufe70-\uffef\U00010000-\U0003ffff]")


def fold(text: str) -> str:
    """Lower case without accents, everything but letters and digits a space, words separated by one space."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        if _BEYOND.search(text):
            return _wide(text)
        data = text.encode("latin-1", "replace")
    return b" ".join(data.translate(_PLAIN).split()).decode("ascii")


@lru_cache(maxsize=1)
def _automata() -> tuple:
    """Both automata, built once per Python worker."""
    import ahocorasick

    phrases = ahocorasick.Automaton()
    for telling, groups in ((False, WEAK), (True, PHRASES)):
        for kind, rules in groups.items():
            for rule in rules:
                for p in filter(None, map(fold, expanded(rule))):
                    sure = telling and not p.isdigit()
                    phrases.add_word(f" {p} ", (kind, len(p), sure))
    phrases.make_automaton()
    openers = ahocorasick.Automaton()
    for mark, _ in FIELDS:
        openers.add_word(mark, mark)
    openers.make_automaton()
    return phrases, openers


def fields(text: str) -> Iterator[str]:
    """The fields left unfilled in a text."""
    lowered = text.lower().replace("í]", "i]")
    for mark in dict.fromkeys(m for _, m in _automata()[1].iter(lowered)):
        for m in _GRAMMAR[mark].finditer(text):
            yield m.group()


@lru_cache(maxsize=1)
def _stems() -> frozenset[str]:
    """Stems of the public filler's words: their first four letters, or the word where it is shorter."""
    return frozenset(w[:4] for w in expanded(PHRASES["filler"][0])) | {"sed", "sit", "eius", "eaqu"}


def _salad(words: list[str]) -> bool:
    """Whether words are pseudo-Latin: none is a function word and enough letters stand in words with a stem of the public filler."""
    if len(words) < SALAD_WORDS or not FUNCTION.isdisjoint(words):
        return False
    stems = _stems()
    return sum(len(w) for w in words if w[:4] in stems) >= SALAD * sum(map(len, words))


def residue(text: str) -> tuple[str, float]:
    """(kind, covered share): 'field' or the kind with most covered letters, '' for a text that is neither."""
    if next(fields(text), None):
        return "field", 1.0
    spaced = f" {fold(text)} "
    kinds: dict[str, int] = {}
    covered, last, telling = 0, 0, False
    hits = sorted(((end - n, end, kind, sure) for end, (kind, n, sure) in _automata()[0].iter(spaced)), key=lambda h: (h[0], -h[1]))
    for start, end, kind, sure in hits:
        telling |= sure
        if end > last:
            gain = sum(map(len, filter(str.isalpha, spaced[max(start, last) : end].split())))
            covered += gain
            kinds[kind] = kinds.get(kind, 0) + gain
            last = end
    if not any(w in spaced for w in _QUICK) and _salad([w for w in spaced.split() if w.isalpha()]):
        return "filler", 1.0
    if not telling:
        return "", 0.0
    readable = max(1, sum(len(w) for w in spaced.split() if w.isalpha()))
    share = covered / readable
    if share < 1 and any(t.search(text) for t in TRACES):
        printed = sum(sum(map(len, filter(str.isalpha, fold(m.group()).split()))) for t in TRACES for m in t.finditer(text))
        share = min(1.0, (covered + printed) / readable)
    return (max(kinds, key=lambda k: (kinds[k], k)), min(1.0, share)) if share >= COVERAGE else ("", share)


def residues(chunks: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """One row per text that is template residue: key, clase, cobertura.

    Null, empty and blank texts are none; repeated rows give repeated results.  A narrow map: no shuffle.
    """

    def fn(k: object, t: str) -> Iterator[tuple]:
        kind, share = residue(t)
        if kind:
            yield k, kind, share

    return map_text(chunks.where(F.trim(F.col(f"`{text}`")) != ""), key, text, f"`{key}` {dict(chunks.dtypes)[key]}, clase string, cobertura double", fn)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold an unfilled field or consist of filler, a message or a demand for scripts."""
    return residues(table(spark, sf_dir, "chunks")).select("id")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that stay: id and doc_id of every chunk without template residue (null and blank ones stay)."""
    chunks = table(spark, sf_dir, "chunks").select("id", "doc_id", "texto")

    def fn(k: object, t: str, doc: str) -> Iterator[tuple]:
        if not residue(t)[0]:
            yield k, doc

    return map_text(chunks.withColumn("texto", F.coalesce("texto", F.lit(""))), "id", "texto", "id bigint, doc_id string", fn, carry=("doc_id",))


QUERIES = {"p6_found": p6_found, "p6_kept": p6_kept}
SQL: dict[str, str] = {}
