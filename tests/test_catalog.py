"""Queries against their SQL on the smallest tables, and the operators' own cases."""

import glob
import os
import re

import pytest

from legajo.functions import text as T
from legajo.operators import citations as C
from legajo.operators import relational as R
from legajo.operators import retrieval as S
from legajo.plans import catalog
from legajo.sources import tables
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

DATA = os.environ.get("LEGAJO_TEST_DATA", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    theirs = con.sql(catalog.SQL[name])
    columns = sorted(theirs.columns)
    expected = sorted(repr(tuple(plain(r[theirs.columns.index(c)]) for c in columns)) for r in theirs.fetchall())
    ours = catalog.QUERIES[name](spark, DATA)
    assert sorted(ours.columns) == columns
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in ours.collect()) == expected


def test_ann_recall(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    got = catalog.QUERIES["q49_neighbor_recall"](spark, DATA).agg(F.avg("recall")).first()[0]
    assert got >= 0.9


def test_near_dup_members(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    near = " ".join(words[:-1])
    rows = [(1, " ".join(words)), (2, " ".join(words).upper()), (3, near), (4, near + "."), (5, "otro texto que nadie más copia"), (6, "igual a su copia y ya"), (7, "Igual a su copia, y ya"), (8, "muy corto"), (9, None)]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.clase, r.copias, r.enlaces) for r in catalog.QUERIES["q77_near_dup_members"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2, 3), 2: (1, 2, 3), 3: (3, 2, 3), 4: (3, 2, 3), 5: (5, 1, 0), 6: (6, 2, 1), 7: (6, 2, 1)}


def test_near_pairs_brute_force(spark, tmp_path):
    import random

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randrange(6, 70))
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randrange(1, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(other + rng.choices(vocab, k=rng.randrange(0, 3)))
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(" ".join(t), (i, {tuple(t[k : k + 5]) for k in range(len(t) - 4)}))
    items = sorted(sets.values())
    want = {(a, b): round(len(x & y) / len(x | y), 6) for k, (a, x) in enumerate(items) for b, y in items[k + 1 :] if len(x & y) >= 0.8 * len(x | y)}
    got = {(r.a, r.b): r.parecido for r in catalog.QUERIES["q77_near_dup_jaccard"](spark, str(tmp_path)).collect()}
    assert got == want and want


def near_texts(spark, folder):
    import random

    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=400)) for _ in range(200)]
    texts += [f"{t} fin {i}" for i, t in enumerate(texts[:20])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return {(i, 200 + i) for i in range(20)}


def test_near_pairs_write_few_shingles(spark, tmp_path):
    from legajo.sources.shared import shared_folder

    want = near_texts(spark, tmp_path)
    folder = shared_folder(spark).removeprefix("file:")
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    before = held()
    df = catalog.QUERIES["q77_near_dup_jaccard"](spark, str(tmp_path))
    assert {(r.a, r.b) for r in df.collect()} == want
    # 220 sets of 396 hashes would be 697,000 bytes
    assert held() - before < 50_000


def test_near_blocking_writes_few_shingles(spark, tmp_path):
    from legajo.sources.shared import shared_folder

    want = near_texts(spark, tmp_path)
    folder = shared_folder(spark).removeprefix("file:")
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    before = held()
    df = catalog.QUERIES["q76_near_dup_blocking"](spark, str(tmp_path))
    assert {(r.a, r.b) for r in df.collect()} == want
    assert held() - before < 50_000


def test_near_members_write_few_shingles(spark, tmp_path):
    from legajo.sources.shared import shared_folder

    links = [i for pair in near_texts(spark, tmp_path) for i in pair]
    folder = shared_folder(spark).removeprefix("file:")
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    before = held()
    df = catalog.QUERIES["q77_near_dup_members"](spark, str(tmp_path))
    assert {r.doc_id: (r.clase, r.copias, r.enlaces) for r in df.collect()} == {i: (i, 1, int(i in links)) for i in range(220)}
    assert held() - before < 50_000


def broadcast_joins(spark, run):
    """Kinds of the broadcast joins that ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [x.physicalPlanDescription() for x in (store.executionsList().apply(i) for i in range(before, store.executionsCount()))]
    assert plans
    return {kind for p in plans for kind in re.findall(r"Broadcast\w+Join (\w+)", p.partition("== Initial Plan ==")[0])}


def test_near_blocking_broadcasts_ids_only(spark, tmp_path):
    near_texts(spark, tmp_path)
    assert broadcast_joins(spark, lambda: catalog.QUERIES["q76_near_dup_blocking"](spark, str(tmp_path)).collect()) <= {"LeftSemi"}


def test_near_members_broadcast_ids_only(spark, tmp_path):
    near_texts(spark, tmp_path)
    assert broadcast_joins(spark, lambda: catalog.QUERIES["q77_near_dup_members"](spark, str(tmp_path)).collect()) <= {"LeftSemi"}


def test_near_blocking_lengths(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"palabra{i}" for i in range(3000))
    rows = [(1, base), (2, f"{base} fin"), (3, "a b c d e f g h i j k"), (4, "a b c d e f g h i j k l"), (5, long), (6, f"{long} fin"), (7, f"Otro {base.replace('w59', 'fin')}"), (8, f"{base.upper()}{' .' * 40}")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b) for r in catalog.QUERIES["q76_near_dup_blocking"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2)}


@pytest.mark.parametrize("level", [0, None])
def test_near_pairs_of_any_order(spark, tmp_path, monkeypatch, level):
    import random

    from legajo.operators import near

    order = bytes(near.COUNTERS) if level == 0 else random.Random(3).randbytes(near.COUNTERS)
    want = near_texts(spark, tmp_path)
    monkeypatch.setattr(near, "levels", lambda hashed: order)
    assert {(r.a, r.b) for r in catalog.QUERIES["q77_near_dup_jaccard"](spark, str(tmp_path)).collect()} == want


def test_pages_of_whole_texts(spark, tmp_path):
    texts = {1: "x" * 161, 2: "corto", 3: "a\fb" + "y" * 80, 4: "", 5: None, 6: "z" * 80}
    spark.createDataFrame(list(texts.items()), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in catalog.QUERIES["q83_paged_text_all"](spark, str(tmp_path)).orderBy("doc_id", "pagina").collect():
        got.setdefault(r.doc_id, []).append((r.pagina, r.inicio))
    assert {k: [p for p, _ in v] for k, v in got.items()} == {1: [1, 2, 3, 4, 5], 2: [1], 3: [1, 2, 3, 4], 4: [1], 6: [1, 2]}
    assert [i for _, i in got[1]] == [0, 41, 82, 123, 164] and [i for _, i in got[3]] == [0, 2, 41, 82]


def test_pack_all_rows(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), "x" * rng.randrange(1, 3000)) for i in range(120)] + [(120, "z", "x" * 7000)]
    spark.createDataFrame(rows, "doc_id int, norma_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for _, g, t in rows:
        u, n = want.get(g, (0, 0))
        want[g] = (u + len(t), n + 1) if u + len(t) <= 6000 else (u, n)
    assert {r.norma_id: (r.usado, r.quedan) for r in catalog.QUERIES["q54_pack_context_all"](spark, str(tmp_path)).collect()} == want


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)] + [(24, 3)], "de bigint, a bigint")
    assert sorted(r.nodo for r in C.closure(edges, spark.createDataFrame([(0,)], "nodo bigint")).collect()) == list(range(25))


def test_rrf_order_and_ties(spark):
    lists = [spark.createDataFrame([(1, a, i) for i, a in enumerate(x, 1)], "q int, id int, rango int") for x in ([3, 1], [1, 2])]
    assert [r.id for r in S.fuse(lists, "id", 2).orderBy("rango").collect()] == [1, 3]
    lists = [spark.createDataFrame([(1, a, 1)], "q int, id int, rango int") for a in (5, 4)]
    assert [r.id for r in S.fuse(lists, "id", 2).orderBy("rango").collect()] == [4, 5]


def test_bm25_numbers(spark):
    docs = spark.createDataFrame([(1, "artículo 42"), (2, "artículo 24"), (3, None)], "id int, t string")
    q = spark.createDataFrame([(1, "artículo 42"), (2, "")], "q int, t string")
    got = S.bm25(docs, "id", "t", q, "q", "t", 5).orderBy("q", "rango").collect()
    assert [r.id for r in got] == [1, 2] and {r.q for r in got} == {1}


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, None, None, 2])], "g string, i int, v int")
    assert [r.isla for r in R.islands(df, ["g"], ["i"], F.col("v")).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    n = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4)], "g string, n int")
    assert [(r.desde, r.hasta) for r in R.gaps(n, ["g"], "n").collect()] == [(2, 3)]


def test_scalars(spark):
    df = spark.createDataFrame([("  ÁRBOL\n ñandú ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.fold(F.col("t"))).collect()] == ["arbol nandu", None]
    import hashlib

    got = spark.range(20).select("id", T.hash_bucket(F.col("id"), 10).alias("b")).collect()
    assert all(r.b == int(hashlib.sha256(str(r.id).encode()).hexdigest(), 16) % 10 for r in got)


def test_strict_jsonl(spark, tmp_path):
    schema = StructType([StructField("id", IntegerType()), StructField("t", StringType())])
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('﻿{"id": 1, "t": "x"}\n\n{"id": 2, "t": null}\n', encoding="utf-8")
    assert tables.read_strict_jsonl(spark, str(good), schema).count() == 2
    for line in ('{"id": 1', '{"t": "x"}', '{"id": 2}\n{"id": 2}'):
        bad.write_text('{"id": 9}\n' + line + "\n")
        with pytest.raises(Exception):
            tables.read_strict_jsonl(spark, str(bad), schema).collect()
    assert tables.read_csv(spark, str(tmp_path / "no.csv"), schema).count() == 0
