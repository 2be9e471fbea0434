"""Operators on small cases: ties, nulls, hot keys, and plain versions to hold them against."""

import io
import json
import random
import zipfile

import numpy as np
import pytest
from legajo.functions import text as T
from legajo.operators import answers as A
from legajo.operators import audit as U
from legajo.operators import documents as D
from legajo.operators import ordered as O
from legajo.operators import probes as P
from legajo.operators import relational as R
from legajo.operators import retrieval as S
from legajo.sources import tables as X
from legajo.streaming import incremental as I
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def rows_of_hot_key(n=3000):
    rng = random.Random(5)
    return [("caliente" if i % 3 else f"k{i % 40}" if i % 2 else None, i, rng.choice([None, rng.randrange(1000)])) for i in range(n)]


def by_key(rows):
    groups = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((o, v))
    return groups


def test_ordered_values_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCKS", 7)
    rows = rows_of_hot_key()
    df = spark.createDataFrame(rows, "k string, o int, v int")
    fill = {r.o: r.f for r in O.forward_filled(df, "k", ["o"], F.col("v"), "f").collect()}
    top = {r.o: r.m for r in O.previous_max(df, "k", ["o"], "v", "m").collect()}
    nxt = {r.o: r.s for r in O.next_value(df, "k", ["o"], "o", "s").collect()}
    num = {r.o: r.n for r in O.numbered(df, "k", ["o"], "n").collect()}
    for values in by_key(rows).values():
        last = most = None
        for i, (o, v) in enumerate(values):
            assert top[o] == most and num[o] == i + 1 and nxt[o] == (values[i + 1][0] if i + 1 < len(values) else None)
            last = v if v is not None else last
            assert fill[o] == last
            most = v if most is None else most if v is None else max(most, v)
    assert O.blocked(df, "k", ["o"]).where("k = 'caliente'").select(O.BLOCK).distinct().count() > 1
    assert O.numbered(df.limit(0), "k", ["o"], "n").count() == 0


def test_leaks_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice("uno dos tres cuatro Cinco".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(6)] + [(6, None)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(30)] + [(30, None), (31, "")]
    want = {(d, i) for d, t in docs if t for i, q in items if q and set(P.word_windows(q, 5, 2)) & set(P.word_windows(t, 5))}
    a, b = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(items, "i int, q string")
    assert {(r.d, r.i) for r in P.leaks(a, "d", "t", b, "i", "q", 5, 2).collect()} == want and want
    monkeypatch.setattr(P, "SENT_WINDOWS", 0)
    assert {(r.d, r.i) for r in P.leaks(a, "d", "t", b, "i", "q", 5, 2).collect()} == want
    assert P.leaks(a.limit(0), "d", "t", b, "i", "q").count() == 0 and P.leaks(a, "d", "t", b.limit(0), "i", "q").count() == 0


def test_closed_json():
    rng = random.Random(2)

    def value(d=0):
        r = rng.random()
        if d > 3 or r < 0.3:
            return rng.choice(['texto "con" \\ cosas', "ñandú", "", "a,b:{c}[d]"])
        if r < 0.45:
            return rng.choice([1, -2.5, True, None, 1e10])
        return [value(d + 1) for _ in range(rng.randrange(4))] if r < 0.7 else {rng.choice("abcdef") * rng.randrange(1, 4): value(d + 1) for _ in range(rng.randrange(4))}

    for _ in range(1500):
        v = {"x": value(), "y": value()}
        t = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        assert json.loads(A.closed_json(t)) == v and A.closed_json(t + " sobra }") == t
        json.loads(A.closed_json(t[: rng.randrange(1, len(t))]))
    assert A.closed_json("") == "" and A.closed_json('{"a": "b') == '{"a": "b"}' and A.closed_json('{"a": 1, "b') == '{"a": 1}'


def test_reserved_fields(spark):
    df = spark.createDataFrame([(1, ("a", "b"), [("x",)])], "id int, o struct<Respuesta: string, otra: string>, l array<struct<clave: string>>")
    names = frozenset({"respuesta", "clave"})
    assert A.reserved_fields(df.schema, names) == ["o.Respuesta", "l.clave"]
    assert A.whitelisted(df, ["id", "nada"], names).columns == ["id"]
    with pytest.raises(ValueError):
        A.whitelisted(df, ["id", "o"], names)


def vectors(n=400, d=8, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, d))
    return [(i, (centers[i % 6] + 0.3 * rng.normal(size=d)).tolist(), "ab"[i % 2]) for i in range(n)]


def test_dense_and_groups_brute_force(spark):
    rows = vectors() + [(900, None, "a"), (901, [1.0], "a")]
    df = spark.createDataFrame(rows, "id int, v array<double>, g string")
    q = df.where("id % 50 = 0")
    m = {i: np.array(v) for i, v, _ in rows if v and len(v) == 8}
    group = {i: g for i, _, g in rows}
    for by in (None, "g"):
        got = {(r.q, r.rango): r.id for r in S.dense_top(df, "id", "v", q.where("id < 900"), 4, by).collect()}
        for a in range(0, 400, 50):
            rank = sorted((i for i in m if not by or group[i] == group[a]), key=lambda i: (-round(float(m[a] @ m[i]), 6), i))[:4]
            assert [got[a, r] for r in range(1, 5)] == rank


def test_inverted_file_recall(spark):
    df = spark.createDataFrame(vectors(2000), "id int, v array<float>, g string")
    q = df.where("id % 50 = 0")
    exact = S.dense_top(df, "id", "v", q, 10)
    got = S.neighbour_overlap(exact, S.ivf_top(df, "id", "v", q, 10, 24, 8), "id").agg(F.avg("recall")).first()[0]
    assert got >= 0.9
    assert S.ivf_top(df.limit(0), "id", "v", q.limit(0), 10).count() == 0


def test_fused_parents(spark):
    mk = lambda rows: spark.createDataFrame(rows, "q int, id int, p string, rango int")
    dense, lexical = mk([(1, 10, "a", 1), (1, 11, "a", 2), (1, 12, "b", 3)]), mk([(1, 13, "b", 1), (1, 14, "c", 2)])
    got = [(r.p, r.id) for r in S.fuse_parents([dense, lexical], "id", "p", 3).orderBy("rango").collect()]
    assert got == [("b", 12), ("a", 10), ("c", 14)]


def test_relational_small(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "u2")], "k int, r string, url string")
    b = spark.createDataFrame([(1, "y", "v1"), (3, "z", "v3")], "k int, r string, url string")
    got = {r.k: (r.url, r.r, r.alternas) for r in R.first_wins([a, b], "k", "url").collect()}
    assert got == {1: (None, "x", "v1"), 2: ("u2", None, ""), 3: ("v3", "z", "")} or got[2] == ("u2", None, "")
    assert {(r.k, r.r) for r in R.overlaid(a.drop("url"), b.drop("url"), "k").collect()} == {(1, "y"), (2, None), (3, "z")}
    assert R.set_difference(a.select("k"), a.select("k")).count() == 0
    kept = R.replaced(spark.createDataFrame([(1, None, 5), (2, "a", 6)], "i int, s string, n int"), spark.createDataFrame([(1, None, 9)], "i int, s string, n int"), ["i", "s"])
    assert {(r.i, r.n) for r in kept.collect()} == {(1, 9), (2, 6)}
    assert {r.extremo for r in R.extremes(a.withColumn("v", F.col("k") * 2), "v", "k", 1).collect()} == {"mayor", "menor"}


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>' + body + "</w:body></w:document>")
    return out.getvalue()


def test_docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    box = f"<w:p><w:r><w:t>antes</w:t></w:r><mc:AlternateContent><mc:Choice><w:txbxContent>{p('caja')}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{p('caja')}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:p>"
    content = docx(p("uno") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>" + box)
    assert D.docx_text(content) == "uno\na | b\nantes\ncaja"
    with pytest.raises(ValueError):
        bad = io.BytesIO()
        with zipfile.ZipFile(bad, "w") as z:
            z.writestr("word/document.xml", "<!DOCTYPE x><a/>")
        D.docx_text(bad.getvalue())
    pack = io.BytesIO()
    with zipfile.ZipFile(pack, "w") as z:
        z.writestr("b.docx", docx(p("dos")))
        z.writestr("a.docx", docx(p("uno")))
    assert D.word_package(pack.getvalue()) == "uno\n\ndos"
    with zipfile.ZipFile(pack, "w") as z:
        z.writestr("../a.docx", content)
    with pytest.raises(ValueError):
        D.word_package(pack.getvalue())


def test_character_sets(spark):
    page = "<p>ñandú</p>"
    assert D.decoded(page.encode())[:2] == (page, "utf-8") and D.decoded(b"\xef\xbb\xbfx")[0] == "x"
    declared = b'<meta charset="iso-8859-15">' + page.encode("iso-8859-15")
    assert D.decoded(declared)[1] == "iso-8859-15" and "ñandú" in D.decoded(declared)[0]
    assert D.decoded(page.encode("cp1252"), "nadie")[1] == "cp1252" and D.decoded(page.encode("latin-1"), "latin-1")[0] == page
    df = spark.createDataFrame([(1, bytearray(page.encode("cp1252"))), (2, None), (3, bytearray(b""))], "id int, c binary")
    got = {r.id: (r.texto, r.error) for r in D.converted(df, "id", "c", "pagina").collect()}
    assert got == {1: ("ñandú", None), 2: (None, None), 3: ("", None)}


def test_sources(spark, tmp_path):
    schema = StructType([StructField("id", IntegerType()), StructField("t", StringType())])
    df = spark.createDataFrame([(1, "a"), (2, None)], schema)
    X.write_json(df, f"{tmp_path}/j")
    assert X.read_json(spark, f"{tmp_path}/j", schema).count() == 2 and X.read_json(spark, f"{tmp_path}/no", schema).count() == 0
    with pytest.raises(Exception):
        X.write_json(spark.createDataFrame([(float("nan"),)], "x double"), f"{tmp_path}/nan")
    X.write_once(df, f"{tmp_path}/v1")
    with pytest.raises(Exception):
        X.write_once(df, f"{tmp_path}/v1")
    folder = tmp_path / "raiz"
    (folder / "a").mkdir(parents=True)
    (folder / "b").mkdir()
    (folder / "a" / "x.txt").write_text("uno")
    (folder / "b" / "x.txt").write_text("dos")
    import hashlib

    h = hashlib.sha256(b"uno").hexdigest()
    ask = spark.createDataFrame([("a/x.txt", h, 3), ("b/x.txt", h, 3), ("c/x.txt", h, 3), ("../raiz/a/x.txt", h, 3)], "archivo string, sha256 string, bytes int")
    got = {r.archivo: (r.existe, r.tamano_ok, r.huella_ok) for r in X.verified_files(spark, str(folder), ask).collect()}
    assert got == {"a/x.txt": (True, True, True), "b/x.txt": (True, True, False), "c/x.txt": (False,) * 3, "../raiz/a/x.txt": (False,) * 3}
    assert [r.archivo for r in X.untracked_files(spark, str(folder), ask.where("archivo = 'a/x.txt'")).collect()] == ["b/x.txt"]
    ok = ask.where("archivo = 'a/x.txt'").withColumn("doc_id", F.lit(1))
    assert X.texts_by_id(spark, str(folder), ok).collect()[0].texto == "uno"
    for bad in ("b/x.txt", "c/x.txt", "../raiz/a/x.txt"):
        with pytest.raises(Exception):
            X.texts_by_id(spark, str(folder), ask.where(F.col("archivo") == bad).withColumn("doc_id", F.lit(1))).collect()


def test_patch_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", "dice b"), (2, "x", "dice b"), (3, "a", "nada"), (4, "a", None), (5, None, "dice b")], "k int, v string, e string")
    p = spark.createDataFrame([(i, "a", "b", "dice") for i in range(1, 5)] + [(5, None, "b", "dice")], "k int, esperado string, nuevo string, prueba string")
    once = X.patched(t, "k", "v", "e", p)
    assert {r.k: (r.v, r.cambio) for r in once.collect()} == {1: ("b", "aplicado"), 2: ("x", "valor_distinto"), 3: ("a", "sin_prueba"), 4: ("a", "sin_prueba"), 5: ("b", "aplicado")}
    again = X.patched(once.drop("cambio"), "k", "v", "e", p)
    assert {r.k: r.cambio for r in again.collect()}[1] == "ya_aplicado"


def test_reconciliation(spark):
    cols = "doc_id string, comprobacion string, detalle string"
    old = spark.createDataFrame([("a", "c1", "x"), ("a", "c2", "x"), ("b", "c1", None), ("co_a", "c1", "y"), ("", "c1", "x"), ("d", "c1", "x"), ("e", "c1", "m")], cols)
    now = spark.createDataFrame([("a", "c1", "x"), ("D", "c1", "x"), ("d", "c1", "x"), ("e", "c1", "a"), ("e", "c1", "z")], cols)
    got = sorted((r.doc_id, r.comprobacion, r.resultado) for r in U.reconciled(old, now).collect())
    assert got == sorted([("a", "c1", "vigente"), ("a", "c2", "resuelta"), ("b", "c1", "documento_retirado"), ("co_a", "c1", "cambiada"), ("", "c1", "sin_documento"), ("d", "c1", "documento_ambiguo"), ("e", "c1", "vigente_varias")])


def test_findings_of_empty_tables(spark):
    texts = spark.createDataFrame([], "doc_id string, tipo string, texto string")
    assert U.completeness(texts).count() == 0 and U.quality(texts).count() == 0
    assert U.structure_census(spark.createDataFrame([(1, ""), (2, None)], "id int, t string"), "id", "t").count() == 1


def test_scalar_edges(spark):
    df = spark.createDataFrame([("archivo.tar.gz", "", "Ley ORGÁNICA"), ("sin", None, None)], "p string, v string, t string")
    got = df.select(T.suffix(F.col("p")).alias("s"), T.missing(F.col("v")).alias("m"), T.fold_all(F.col("t")).alias("f")).collect()
    assert [(r.s, r.m, r.f) for r in got] == [(".gz", True, "ley organica"), ("", True, None)]
    assert spark.range(1).select(T.first_date(F.lit("el 31 de febrero de 2001")).alias("x")).collect()[0].x is None


def test_deduplicated_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    I.deduplicated(stream, "k").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
