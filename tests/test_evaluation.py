"""Evaluation operators on golden cases."""

import pytest
from legajo.operators import citations as C
from legajo.operators import evaluation as V
from pyspark.sql import functions as F

OWN = frozenset({("ley", "890", "2004")})


@pytest.mark.parametrize(
    "text,own,want",
    [
        ("República\nLEY 890 DE 2004\npor la cual", OWN, "LEY 890 DE 2004"),
        ("República\nLEY 890\nDE 2004\npor la cual", OWN, "LEY 890\nDE 2004"),
        ("Sin nombre alguno", OWN, None), ("", OWN, None), ("LEY 890 DE 2004", frozenset(), None),
        ("Decreto 410 de 1971\nCÓDIGO DE COMERCIO\ntexto", frozenset({("decreto", "410", "1971"), ("codigo_comercio", None, None)}), "Decreto 410 de 1971\nCÓDIGO DE COMERCIO"),
        ("Decreto 410 de 1971\n" + "x" * 650 + "\n" + "y" * 100 + "\nCÓDIGO DE COMERCIO", frozenset({("decreto", "410", "1971"), ("codigo_comercio", None, None)}), "CÓDIGO DE COMERCIO"),
    ],
)
def test_header_span(text, own, want):
    span = V.header_span(text, own)
    assert (text[span[0] : span[1]] if span else None) == want


def test_headers_frame(spark):
    rows = [("a", "ley", "890", 2004, "t", "LEY 890 DE 2004\nTexto"), ("b", "ley", "5", 1990, "Ley 5 de 1990", "nada"), ("c", "ley", "6", 1990, "otro título", None), ("d", None, None, None, None, None)]
    got = {r.doc_id: (r.tipo_evidencia, r.inicio, r.texto) for r in V.headers(spark.createDataFrame(rows, "doc_id string, tipo string, numero string, anio int, titulo string, texto string")).collect()}
    assert got == {"a": ("cabecera_fuente", 0, "LEY 890 DE 2004"), "b": ("cabecera_normalizada", None, "Ley 5 de 1990"), "c": ("cabecera_normalizada", None, "Ley 6 de 1990")}


def test_evidence_order(spark):
    p = spark.createDataFrame([(1, 1, "a", 10, "uno"), (1, 2, "b", 11, "dos"), (1, 6, "a", 12, "seis")], "q int, orden int, doc_id string, id int, texto string")
    own = spark.createDataFrame([("a", "ley|1|2000"), ("b", "ley|2|2000")], "doc_id string, clave string")
    said = spark.createDataFrame([(11, "ley|2|2000")], "id int, clave string")
    heads = spark.createDataFrame([("a", "cabecera_fuente", "LEY 1"), ("b", "cabecera_fuente", "LEY 2")], "doc_id string, tipo_evidencia string, texto string")
    got = [(r.lugar, r.tipo_evidencia, r.texto) for r in V.evidence(p, own, said, heads).orderBy("lugar").collect()]
    assert got == [(1, "cabecera_fuente", "LEY 1"), (2, "unidad", "uno"), (3, "unidad", "dos")]


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "q int, id int, rango int")
    found = spark.createDataFrame([(8, "x"), (8, "x"), (7, "z")], "id int, clave string")
    ref = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x")], "q int, clave string")
    got = {r.q: (r.referencias, r.recall_1, r.recall_5) for r in V.reference_recall(ranking, found, ref).collect()}
    assert got == {1: (2, 0.0, 0.5), 2: (1, 0.0, 0.0), 3: (1, 0.0, 0.0)}
    m = V.backing_metrics(V.first_hits(ranking, found, ref)).collect()[0]
    assert (m.evaluables, m.respaldo, m.mrr) == (3, 0.333333, 0.166667)
    assert V.backing_metrics(V.first_hits(ranking, found, ref.limit(0))).collect()[0].respaldo is None
    a, b = spark.createDataFrame([(1, True), (2, False), (3, None)], "q int, ok boolean"), spark.createDataFrame([(1, False), (2, True), (4, True)], "q int, ok boolean")
    assert {r.q: r.cambio for r in V.compared(a, b, "q", "ok").collect()} == {1: "rota", 2: "arreglada", 3: "igual_mal", 4: "arreglada"}
    t = V.total(spark.createDataFrame([(1.5, 10.0), (None, 30.0)], "puntos double, maximo double")).collect()[0]
    assert (t.obtenidos, t.posibles) == (1.5, 10.0)


def test_completed(spark):
    df = spark.createDataFrame([("Z", {"B": " ", "C": "c"}), ("B", None), (None, {})], "r string, d map<string, string>")
    got = [r.c for r in df.select(V.completed(F.array(*map(F.lit, "ABC")), F.col("r"), F.coalesce("d", F.create_map().cast("map<string, string>"))).alias("c")).collect()]
    assert got[0].respuesta == "A" and got[0].descarte == {"B": V.NO_REASON, "C": "c"}
    assert got[1].respuesta == "B" and set(got[1].descarte) == {"A", "C"} and got[2].respuesta == "A"


def test_names_read_back():
    for code, name in C.NAMES.items():
        assert (code, None, None) in C.bodies_of(C.extract(name))
