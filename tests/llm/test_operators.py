"""Each training-text operator on small cases: its rule, nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import random

import pytest

from legajo.llm import encoding_repair as P1
from legajo.llm import layout_copies as P5
from legajo.llm import leakage as P8
from legajo.llm import main_content as P2
from legajo.llm import ocr_repair as P4
from legajo.llm import splitting as P3
from legajo.llm import template_residue as P6
from legajo.llm import text_quality as P9
from legajo.llm import tokenizing as P7

#: Columns that the operators use inside under the same names.
CLASH = ", w string, k string, h string, n string, t string"
EXTRA = ("w", "k", "h", "n", "t")


def chunks(spark, texts, docs=None):
    rows = [(i, (docs or {}).get(i, "d1"), t, None, *EXTRA) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "id bigint, doc_id string, texto string, articulo string" + CLASH)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in enumerate(texts, 1)], "doc_id bigint, text string" + CLASH)


SPANISH = "El artículo 3.º señaló: «la acción de nulidad caducó» según el párrafo único; ¿cuándo expiró?"


@pytest.mark.parametrize("codec", ["cp1252", "cp437", "cp850", "mac_roman", "cp1251"])
def test_repair_round_trip(codec):
    garbled = SPANISH.encode("utf-8").decode(codec, "ignore")
    if garbled.encode(codec, "ignore") == SPANISH.encode("utf-8"):
        assert P1.repair(garbled)[0] == SPANISH


def test_repair_twice_garbled():
    twice = "señaló".encode().decode("cp1252").encode().decode("cp1252")
    assert P1.repair(twice)[0] == "señaló"


@pytest.mark.parametrize("text", ["PADRÃO & FILHOS, São Tomé", "un déjà vu y cobros à la carte", "la raíz √2 y ½, cuadro └ inferior", "signo mixto «ЛУНА»", "El cuadro │ 50 │ 34 │", "", "plain"])
def test_source_text_is_left_alone(text):
    assert P1.repair(text) == (text, 0, 0, "")


def test_single_byte_and_lost():
    assert P1.repair("La correcciÛn aritmÈtica")[0] == "La corrección aritmética"
    assert P1.repair("decisi�n")[2] == 1


def test_repair_frame(spark):
    got = {r.id: r for r in P1.repaired(chunks(spark, ["decisiÃ³n", None, "", "limpio", "decisiÃ³n"])).collect()}
    assert set(got) == {1, 5} and got[1].restaurado == "decisión"
    assert P1.repaired(chunks(spark, ["x"]).limit(0)).count() == 0


PAGE = "Usted está aquí: Inicio > Normatividad > Objeto\nSaltar al contenido principal\nArtículo 1. El menú de inicio del portal no obliga.\nRESUELVE:\n\na) el plano;\nLo más consultado\nLey 545 de 2025\nTítulo habilitante\n© 2019 Normateca. Todos los derechos reservados"


def test_boilerplate(spark):
    got = [(r.id, r.linea) for r in P2.boilerplate(chunks(spark, [PAGE, None, "", "  \n "])).orderBy("linea").collect()]
    assert got == [(1, n) for n in (1, 2, 7, 8, 9, 10)]
    assert P2.main_body(PAGE)[0].startswith("Artículo 1.")


def test_markup_tree():
    page = "<html><body><nav><a>Inicio</a></nav><main><p>Uno<p>Dos<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>largo<td>z</table></main><div style='display: none'>no</div><footer>pie</footer>"
    assert P2.render_markup(page) == "Uno\nDos\n- a\n- b\nx      y\nlargo  z"


def cover(text, limit=1500, overlap=200):
    spans = P3.split(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, b), (c, d) in zip(spans, spans[1:]):
        assert c <= b and b - c <= overlap and d - c <= limit
    return spans


def test_split_invariants():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9000)
        cover("".join(rng.choice("abc .\nñ;") for _ in range(n)))
    for text in ("x" * 20_000, " " * 5_000, "\n" * 4_000, "a b " * 2_000):
        cover(text)


def test_split_prefers_articles():
    text = "Artículo 1. " + "palabra " * 100 + "\nArtículo 2. " + "otra " * 150
    assert [a for a, _ in cover(text, 1300, 100)][0] == 0 and text[cover(text, 1300, 100)[0][1] :].lstrip().startswith("Artículo 2")


def test_pieces_frame(spark):
    got = P3.pieces(chunks(spark, ["corto", None, "", "y " * 1000])).collect()
    assert {r.id for r in got} == {4} and [r.pieza for r in got] == [1, 2]
    with pytest.raises(ValueError):
        P3.split("x", 100, 100)


def test_scan_lines():
    text = "el contrato se noti-\n— 131 —\n\nRepública - Rama Judicial\nfica al deudor.\na) uno;\nla página 58 de 412 del folleto"
    lines = text.split("\n")
    skip = set(P4.furniture(lines))
    assert skip == {1, 3} and P4.broken(lines, skip, set()) == [0]
    assert P4.rebuild(text, {}, set()).startswith("el contrato se notifica al deudor.")


def test_scan_headers_of_any_wording(spark):
    numbered = "la parte tiene derecho a la carga de la\nEstatuto agrario del sector de  283\n160\nprueba recae en quien alega."
    capitals = "la multa no será infe-\nPág. 115 de 412\n\nCOMPENDIO RURAL DE REGIONES\nrior a un salario."
    for text, skip in ((numbered, {1, 2}), (capitals, {1, 3})):
        assert set(P4.furniture(text.split("\n"))) == skip
    plain = "según dijo el\nTribunal Superior de Bogotá en lo que\n160\nrespecta a la multa"
    assert 1 not in P4.furniture(plain.split("\n"))
    texts = [f"la frase {i} sigue en el\nMemorias del Concejo Rural\n{i}\nrenglón de abajo." for i in range(10, 14)]
    running = P4.headers(chunks(spark, texts))
    assert running == {"Memorias del Concejo Rural"} and P4.furniture(texts[0].split("\n"), running) == [1, 2]
    assert P4.headers(chunks(spark, texts[:1] * 5)) == frozenset()


def test_scan_headers_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    titles = ["Memorias del Concejo Rural", "Boletín del Archivo General", "Anales de la Junta Marítima"]
    texts = [f"la frase {i} sigue en el\n{h}\n{i}\nrenglón de abajo." for h in titles for i in range(10, 14)] + ["Anales de la Junta Marítima\nla frase acaba aquí."]
    df = chunks(spark, texts).select("id", "texto")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    whole = {r.id: r.lineas for r in P4.noise(df).collect()}
    rebuilt = {r.id: r.texto for r in P4.p4_rebuilt(spark, str(tmp_path)).collect()}
    assert set(whole.values()) == {1, 2} and len(whole) == 13 and len(P4.headers(df)) == 3
    monkeypatch.setattr(P4, "KNOWN_WORDS", 1)
    assert {r.id: r.lineas for r in P4.noise(df).collect()} == whole
    assert {r.id: r.texto for r in P4.p4_rebuilt(spark, str(tmp_path)).collect()} == rebuilt


def test_scan_words(spark):
    word = "la notificación de la sentencia se ordenó"
    texts = [word] * 200 + ["la notif!cación se ordenó", "la sentencla quedó", None, "", "la notificacion se ordeno", "serial SL1O-152B"]
    got = {r.id: {x.w: x.real for x in r.palabras} for r in P4.noise(chunks(spark, texts)).collect()}
    assert got == {201: {"notif!cación": "notificación"}, 202: {"sentencla": "sentencia"}}
    assert P4.noise(chunks(spark, ["x"]).limit(0)).count() == 0


def test_scan_words_of_other_confusions(spark):
    word = "la registraduría de la brígida notifique la sentencia"
    texts = [word] * 200 + ["la registradurla", "la 8rígida", "la sentenc1a quedó"]
    got = {r.id: {x.w: x.real for x in r.palabras} for r in P4.noise(chunks(spark, texts)).collect()}
    assert got == {201: {"registradurla": "registraduría"}, 202: {"8rígida": "brígida"}, 203: {"sentenc1a": "sentencia"}}


def test_scan_rebuilt_as_found(spark, tmp_path):
    texts = ["el río cimarrón del franco-tirador y el franco-tirador"] * 200 + ["el río cima-\nrróri del puerto", "del franco-\ntirador"]
    chunks(spark, texts).select("id", "texto").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {r.id: r.texto for r in P4.p4_rebuilt(spark, str(tmp_path)).collect()}[201] == "el río cimarrón del puerto"
    assert {r.id for r in P4.p4_found(spark, str(tmp_path)).collect()} == {r.id for r in P4.p4_rebuilt(spark, str(tmp_path)).collect()}


def test_copies(spark):
    texts = ["Ley Uno: texto", "ley   uno texto", "ley única texto", "Sala: A\nFecha: 1", "FECHA = 1; sala = a", None, " ", "Ley Uno: texto"]
    got = {(r.id_a, r.id_b) for r in P5.copies(chunks(spark, texts, {8: "D-1", 2: "d_1"})).collect()}
    assert got == {(1, 2), (1, 8), (4, 5)}
    groups = {r.id: r.copias for r in P5.groups(chunks(spark, texts)).collect()}
    assert groups == {1: 3, 3: 1, 4: 2}


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(P5, "HOT_ROWS", 3)
    texts = ["igual"] * 9 + ["otra", "otra"]
    got = {(r.id_a, r.id_b) for r in P5.copies(chunks(spark, texts)).collect()}
    assert got == {(1, i) for i in range(2, 10)} | {(10, 11)}
    assert {r.id: r.copias for r in P5.groups(chunks(spark, texts)).collect()} == {1: 9, 10: 2}


@pytest.mark.parametrize(
    "text,kind",
    [
        ("El señor {{nombre}} alegó", "field"), ("fue de [INSERTAR FECHA] mensuales", "field"), ("HTTP 404 Página no encontrada", "error"), ("You need to enable JavaScript to run this app.", "script"), ("Su sesión ha caducado por inactividad.", "session"),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit", "filler"), ("La expresión {x | x > 3} fue usada [sic] por «[...] el declarante [...]»", ""), ("Se probó que el enlace mostraba el mensaje «error 404: página no encontrada» cuando el deudor quiso consultar el acto.", ""), ("", ""), ("ÑÑÑ", ""),
    ],
)
def test_residue(text, kind):
    assert P6.residue(text)[0] == kind


def test_residue_frame(spark):
    assert [r.id for r in P6.residues(chunks(spark, ["{{x}} y {{fecha}}", None, "", "  ", "texto legal " * 50_000])).collect()] == [1]


def test_perfect_hash():
    keys = [bytes([a, b]) for a in range(60) for b in range(60)]
    index = P7.PerfectHash(keys)
    assert [index.find(k) for k in keys] == list(range(len(keys))) and sorted(index.slots) == list(range(len(keys)))
    assert index.find(b"zzz") == -1


def test_encoding(spark):
    tiktoken = pytest.importorskip("tiktoken")
    keys = P7.read_ranks(P7.vocabulary_path())
    reference = tiktoken.Encoding("own", pat_str=P7.PATTERN, mergeable_ranks={k: i for i, k in enumerate(keys)}, special_tokens={})
    texts = [SPANISH, "<|endoftext|> aquí", "a" * 3000, "ñ" * 500 + "😀", "  \n x", "", None, SPANISH]
    got = {r.doc_id: r.ids for r in P7.encoded(documents(spark, texts)).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts, 1)}


ITEM = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece"


def test_leak(spark):
    items = spark.createDataFrame([("pregunta", 7, ITEM), ("pregunta", 8, "corto"), ("pregunta", 9, ITEM.upper())], "campo string, id int, texto string")
    texts = ["Antes. UNO, dos; trés cuatro (cinco) seis siete ocho nueve diez once doce fin", "uno dos tres cuatro cinco OTRA siete ocho nueve diez once doce", "nada " * 200, None, "", ITEM]
    docs = documents(spark, texts)
    assert {(r.doc_id, r.id) for r in P8.hits(docs, items).collect()} == {(1, 7), (1, 9), (6, 7), (6, 9)}
    assert {(r.doc_id, r.iguales) for r in P8.hits(docs, items, least=P8.NEAR).where("id = 7").collect()} == {(1, 12), (2, 11), (6, 12)}
    assert P8.hits(docs, items.limit(0)).count() == 0 and P8.hits(docs.limit(0), items).count() == 0


def test_near_leak_every_pair(spark):
    item = ITEM.split()[:12]
    texts = []
    for a in range(12):
        for b in range(a, 12):
            texts.append(" ".join("otra" if i in (a, b) else w for i, w in enumerate(item)))
    items = spark.createDataFrame([("pregunta", 7, " ".join(item))], "campo string, id int, texto string")
    got = {r.doc_id: r.iguales for r in P8.hits(documents(spark, texts), items, least=P8.NEAR).collect()}
    assert got == {i: sum(x == y for x, y in zip(t.split(), item)) for i, t in enumerate(texts, 1)} and len(got) == 78


def test_words():
    assert P8.words("Ñandú, 3.º año—Éxito") == [b"nandu", b"3", "º".encode("latin-1"), b"ano", b"exito"]


def test_types(spark):
    prose = "La sociedad omitió informar la situación de control y el término debía contarse desde la ejecutoria. " * 6
    texts = [prose] * 30 + ["\n".join(f"{i}. Ley {i} de 1990" for i in range(1, 20)), "\n".join(f"{i}\t{i * 7}\t$ {i}.000" for i in range(1, 20)), "clic " * 100, "#" * 50 + "\n" + "~" * 40, None, "", " \n"]
    common = spark.createDataFrame([(w, "es") for w in "la el de y en que los".split()], "palabra string, lang string")
    got = {r.doc_id: r.clase for r in P9.typed(documents(spark, texts), common).collect()}
    assert [got[i] for i in (1, 31, 32, 33, 34)] == ["prosa", "lista", "tabla", "basura", "basura"] and len(got) == 34
    assert P9.typed(documents(spark, texts).limit(0), common).count() == 0


def test_statistics():
    s = dict(zip(P9._NAMES, P9.measure("La ley rige.\nDos palabras", frozenset({"la"}))))
    assert (s["palabras"], s["lineas"], s["lineas_puntuadas"], s["comunes"]) == (5, 2, 0.5, 0.2)
