"""Citations, audits of answers and the graph on golden cases."""

import pytest
from legajo.operators import citations as C
from legajo.operators import segment as G
from legajo.plans import catalog
from pyspark.sql import functions as F

CASES = [
    ("Art. 41 de la Ley 1563 de 2012", {("ley", "1563", "2012", "41")}),
    ("Ley 1480 de 2011. Art. 23.", {("estatuto_consumidor", None, None, "23")}),
    ("artículo 404 del Código Penal", {("codigo_penal", None, None, "404")}),
    ("artículos 13, 15 y 42 del Decreto 100 de 1980", {("decreto", "100", "1980", n) for n in ("13", "15", "42")}),
    ("la Ley 599 en su artículo 3", {("codigo_penal", None, None, None)}),
    ("Sentencia C-355 de 2006 y T 760/08, SU-214/95", {("jurisprudencia", "C-355", "2006", None), ("jurisprudencia", "T-760", "2008", None), ("jurisprudencia", "SU-214", "1995", None)}),
    ("el artículo 5. La Ley 80 de 1993 rige", {("ley", "80", "1993", None)}),
    ("Decreto-Ley 2663 de 1950, Circular Externa 7 del 2019", {("decreto", "2663", "1950", None), ("circular", "7", "2019", None)}),
    ("Código de Procedimiento Penal", {("codigo_procedimiento_penal", None, None, None)}),
    ("", set()), (None, set()), ("nada que citar", set()),
]


@pytest.mark.parametrize("text,found", CASES)
def test_extract(text, found):
    assert C.extract(text) == found


def test_extracted_frame(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0])], "id int, t string")
    got = C.extracted(df, "id", "t")
    assert got.where("id = 0").count() == 2 and got.where(f"id = {len(CASES) - 2}").count() == 0
    assert C.extracted(df.limit(0), "id", "t").count() == 0


def test_references(spark):
    text = "Ley 1.564 de 2012; Decreto único reglamentario 1082 del 26 de mayo de 2015; Proyecto de Ley 111 de 2006; Ley 112 de 2006 Senado; Acto Legislativo 01 de 2005; C-355/06 y SU917-10, SL3385-2022; Ley 9 de 1700; T-1/95"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(C.references(F.col("t")).alias("r")).collect()
    assert sorted(got[0].r) == sorted(["ley_1564_2012", "decreto_1082_2015", "acto_legislativo_1_2005", "sentencia_cc_c355_2006", "sentencia_csj_sl3385_2022", "sentencia_cc_t001_1995"])
    assert got[1].r is None and got[2].r == []


def test_graph_counts_mentions(spark):
    cites = spark.createDataFrame([(1, "ley_1_1990"), (1, "ley_1_1990"), (2, "ley_1_1990"), (2, "ley_2_1990")], "doc_id int, clave string")
    areas = spark.createDataFrame([(1, "civil"), (2, "penal")], "doc_id int, area string")
    got = {r.clave: r for r in C.graph(cites, "doc_id", "clave", spark.createDataFrame([("co_ley_1_1990",)], "doc_id string"), areas, cites.select("doc_id").where("doc_id = 1")).collect()}
    g = got["ley_1_1990"]
    assert (g.documentos, g.menciones, g.primarias, g.primeros, g.areas, g.en_corpus) == (2, 3, 1, "1, 2", "civil, penal", True) and not got["ley_2_1990"].en_corpus


def test_index(spark):
    rows = [(["a"], ["a", "x"], ["a"], False), (["b", "c"], ["b"], [], False), (["d"], ["d"], ["d"], True), ([], ["z"], [], False), (["e"], None, None, False)]
    got = C.index(spark.createDataFrame(rows, "basis array<string>, answer array<string>, backed array<string>, abstains boolean")).collect()[0]
    assert (got.items, got.n_ref, got.n_citadas, got.aciertos, got.respaldados, got.no_respaldados, got.sin_respaldo) == (4, 5, 3, 2, 1, 1, 1)
    assert got.indice == 0.0 and got.puntos == 0.0 and got.recall_ponderado == 0.3


ALIASES = {"ley 80 de 1993": "ley_80_1993", "codigo civil": "ley_57_1887", "ley 1 de 2000": None, "codigo civil comercial": "otro"}


@pytest.mark.parametrize(
    "text,passages,want",
    [
        ("artículo 42 de la Ley 80 de 1993", [{"doc_id": "ley_80_1993", "articulo": "420", "texto": "artículo 420 dice"}], [("ley 80 de 1993", "ley_80_1993", "42", False)]),
        ("artículo 42 de la Ley 80 de 1993", [{"doc_id": "ley_80_1993", "articulo": "42", "texto": "dice"}], [("ley 80 de 1993", "ley_80_1993", "42", True)]),
        ("Ley 80 de 1993, artículo 42", [{"doc_id": None, "articulo": None, "texto": "la Ley 80 de 1993, en su artículo 42, ordena"}], [("ley 80 de 1993", "ley_80_1993", "42", True)]),
        ("la Ley 1 de 2000", [{"doc_id": "x", "articulo": None, "texto": "Ley 1 de 2000"}], [("ley 1 de 2000", None, None, None)]),
        ("el código civil comercial", [{"doc_id": "ley_57_1887", "articulo": None, "texto": "t"}], [("codigo civil comercial", "otro", None, False)]),
        ("la Ley 80 de 1993", [{"doc_id": "z", "articulo": None, "texto": "t"}] * 10 + [{"doc_id": "ley_80_1993", "articulo": None, "texto": "t"}], [("ley 80 de 1993", "ley_80_1993", None, False)]),
        ("", [], []),
    ],
)
def test_audit(text, passages, want):
    assert C.audit_answer(text, ALIASES, passages) == want


def test_audited_frame_equals_plain(spark):
    aliases = spark.createDataFrame(list(ALIASES.items()), "alias string, doc_id string")
    texts = ["artículo 42 de la Ley 80 de 1993 y el código civil, según la Ley 1 de 2000.", "el código civil comercial", None, "nada"]
    rows = [(i, t, [("ley_80_1993", "42", "algo")]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, texto string, pasajes array<struct<doc_id: string, articulo: string, texto: string>>")
    got = sorted((r.id, r.norma, r.doc_id, r.articulo, r.respaldada) for r in C.audited(df, aliases).collect())
    want = sorted((i, *c) for i, t in enumerate(texts) for c in C.audit_answer(t or "", ALIASES, [{"doc_id": "ley_80_1993", "articulo": "42", "texto": "algo"}]))
    assert got == want


def test_cleaned():
    backed = C.bodies_of(C.extract("Ley 80 de 1993"))
    text = "Procede según la Ley 80 de 1993. La Ley 7 de 1990 lo impide. Sin norma alguna."
    assert C.cleaned(text, backed, False, G.sentences) == "Procede según la Ley 80 de 1993. Sin norma alguna."
    assert C.cleaned(text, backed, True, G.sentences) == "Procede según la Ley 80 de 1993. La norma aplicable lo impide. Sin norma alguna."
    assert C.without_mentions("según el Código Civil", set()) == "según la legislación aplicable" and C.cleaned("", set(), True, G.sentences) == ""


@pytest.mark.parametrize("name,least", [("q103_cleaned_answers", False), ("q104_generalised_answers", True)])
def test_cleaned_answers_cite_nothing_unbacked(spark, tmp_path, name, least):
    rows = [(1, "Ley 9 de 1990", "Manda la Ley 3 de 1991. Es todo.", "pregunta"), (2, None, "Sin citas.", None), (3, None, None, None)]
    spark.createDataFrame(rows, "id int, legal_basis string, respuesta_esperada string, pregunta string").write.parquet(f"{tmp_path}/clave_oro.parquet")
    got = {r.id: r.texto for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and not C.extract(got[1]) and got[2] == "Sin citas." and ("norma aplicable" in got[1]) is least


def test_identity_and_names(spark):
    docs = spark.createDataFrame([("a", "ley", "1564", 2012, "x"), ("b", "sentencia", "C-12", 2001, None), ("c", "concepto", None, None, "sobre la Ley 5 de 1990"), ("d", "decreto", "410", 1971, "Código de Comercio"), ("e", None, None, None, None)], "doc_id string, tipo string, numero string, anio int, titulo string")
    got = {(r.doc_id, r.cuerpo) for r in C.identities(docs).collect()}
    assert got == {("a", "codigo_general_proceso"), ("b", "jurisprudencia"), ("c", "ley"), ("d", "decreto"), ("d", "codigo_comercio")}
    cites = C.extracted(spark.createDataFrame([(1, "El Código Civil rige. Los artículos 2 y 13 de la Ley 80 de 1993 también. El artículo 9 de la Resolución 5 de 2001 no")], "id int, t string"), "id", "t")
    assert C.sentences_of(cites, "id").collect()[0].frase == "Código Civil; Ley 80 de 1993, artículos 2 y 13; Resolución 5 de 2001, artículo 9"
