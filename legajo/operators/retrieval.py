"""Lexical and dense retrieval, fusion, passages and packing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
RRF = 60
#: What is broadcast at a time: entries of a block of lexical queries (term and query, 16 bytes each), and bytes of query vectors.
QUERY_ENTRIES = 2_000_000
QUERY_BYTES = 32 << 20
#: Scores, and entries that add up to them, that a worker holds at a time.
SCORES = 4 << 20
#: Vectors that a coarse quantizer is fitted on at most; every vector is indexed.
FIT_VECTORS = 20_000


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _batch(columns: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.tolist(), f.type) for c, f in zip(columns, schema)], schema=schema)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t, f, largo): one row per term of a text; combined map-side."""
    words = docs.select(key, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("w")).withColumn("largo", F.size("w").cast("bigint"))
    return words.select(key, "largo", F.explode("w").alias("t")).groupBy(key, "largo", "t").agg(F.count(F.lit(1)).alias("f"))


def query_terms(queries: DataFrame, qid: str, text: str) -> DataFrame:
    return queries.select(F.col(qid).alias("q"), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("t"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, qid: str, qtext: str, k: int, tokens=T.tokens) -> DataFrame:
    """(q, key, puntaje, rango): the k best texts of each query, ties by key; texts without a common term aren't ranked.

    Terms travel as 64-bit hashes, so texts reach Python as flat arrays of numbers.  Queries pass in blocks of bounded
    entries.  For each block one pass counts the texts, their length and in how many each of its terms occurs; a second
    weighs the terms of each text and adds them up by query, so what is shuffled is k rows per query and batch, never
    postings.  Lengths count all tokens; a text without tokens counts with length 0.
    """
    hashes = lambda c: F.transform(tokens(c), lambda t: F.xxhash64(t))
    rows = docs.select(key, hashes(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    terms = queries.select(F.col(qid).alias("q"), F.array_distinct(hashes(F.col(qtext))).alias("ts")).where("size(ts) > 0")
    kind, block, entries, found = dict(terms.dtypes)["q"], [], 0, []
    for row in terms.toLocalIterator():
        block.append((row.q, row.ts))
        entries += len(row.ts)
        if entries >= QUERY_ENTRIES:
            found.append(_bm25_block(rows, key, block, k, kind))
            block, entries = [], 0
    if block or not found:
        found.append(_bm25_block(rows, key, block, k, kind))
    return top(reduce(DataFrame.unionByName, found), "q", key, "puntaje", k)


def _term_counts(column: pa.ListArray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the wanted (sorted) terms in a batch of texts, by place, and each text's length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.searchsorted(wanted, flat)
    at[at == len(wanted)] = 0
    hit = wanted[at] == flat if len(wanted) else np.zeros(len(flat), bool)
    pairs, counts = np.unique(np.repeat(np.arange(len(lengths)), lengths)[hit] * max(1, len(wanted)) + at[hit], return_counts=True)
    return pairs // max(1, len(wanted)), pairs % max(1, len(wanted)), counts, lengths


def _census(rows: DataFrame, wanted: np.ndarray) -> tuple[int, float, np.ndarray]:
    """(texts, mean length of at least 1, texts by term) of the wanted (sorted) terms, counted in one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    schema = _schema("i bigint, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        counts = np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            _, term, _, lengths = _term_counts(batch.column(0), terms)
            counts[: len(terms)] += np.bincount(term, minlength=len(terms))[: len(terms)]
            counts[-2:] += len(lengths), lengths.sum()
        some = np.flatnonzero(counts)
        if len(some):
            yield _batch((some, counts[some]), schema)

    got = np.zeros(len(wanted) + 2, np.int64)
    for r in rows.select("w").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        got[r.i] = r.n
    n, total = int(got[-2]), int(got[-1])
    return n, max(1.0, total / n) if n else 1.0, got[:-2]


def _bm25_block(rows: DataFrame, key: str, block: list, k: int, q_kind: str) -> DataFrame:
    wanted, at = np.unique(np.array([t for _, ts in block for t in ts], np.int64), return_inverse=True)
    n, mean, df = _census(rows, wanted)
    # the queries of each term, term after term
    asked = np.repeat(np.arange(len(block)), [len(ts) for _, ts in block])[np.argsort(at, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(wanted)))]).astype(np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((np.array([q for q, _ in block]), wanted, np.log(1 + (n - df + 0.5) / (df + 0.5)), starts, asked.astype(np.int32)))
    ddl = f"q {q_kind}, `{key}` {dict(rows.dtypes)[key]}, puntaje double"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, terms, idf, starts, asked = sent.value
        if not len(qids):
            return
        # so many texts at a time that their scores take 32 MB at most
        step = max(1, min(512, SCORES // len(qids)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                text, term, f, lengths = _term_counts(batch.column(1), terms)
                weight = idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * lengths[text] / mean))
                scores = np.zeros(batch.num_rows * len(qids))
                holders = starts[term + 1] - starts[term]
                done = np.cumsum(holders)
                # entries of texts and queries, so many at a time
                cuts = np.searchsorted(done, np.arange(SCORES, done[-1] + SCORES, SCORES)) if len(done) else []
                low = 0
                for high in [*np.minimum(np.array(cuts, int) + 1, len(term)), len(term)]:
                    part = slice(low, high)
                    m = holders[part]
                    place = np.repeat(starts[term[part]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum()) if high > low else np.zeros(0, np.int64)
                    scores += np.bincount(np.repeat(text[part], m) * len(qids) + asked[place], np.repeat(weight[part], m), len(scores))
                    low = high
                scores = np.round(scores.reshape(batch.num_rows, len(qids)), 6)
                keys = np.array(batch.column(0).to_pylist())
                order = np.lexsort((np.broadcast_to(keys[:, None], scores.shape), -scores), axis=0)[:k]
                best = np.take_along_axis(scores, order, 0).ravel()
                q = np.broadcast_to(qids[None, :], order.shape).ravel()
                some = best > 0
                yield _batch((q[some], keys[order].ravel()[some], best[some]), schema)

    return rows.mapInArrow(run, ddl)


def top(scores: DataFrame, q: str, key: str, score: str, k: int) -> DataFrame:
    """The k best of each query by score, ties by key; group limits apply before the shuffle."""
    w = Window.partitionBy(q).orderBy(F.desc(score), key)
    return scores.withColumn("rango", F.row_number().over(w)).where(F.col("rango") <= k)


def dense_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, group: str | None = None, probes: str | None = None) -> DataFrame:
    """(q, key, puntaje, rango): exact inner-product search of a query set (key, vector) against all rows.

    Blocks of queries of bounded size are sent to the rows: each partition multiplies matrices and keeps its k best, so what
    is shuffled is k rows per query and batch.  With ``group`` a query sees the rows of its own group only; with ``probes``
    (an array column of the queries) those of the groups that it lists.  Rows never move by group, so a hot one is no
    hot key.  Null vectors and vectors of another dimension are left out.
    """
    kind = dict(vectors.dtypes)[key]
    extra = [F.col(probes) if probes else F.array(group)] if group else []
    block, size, found = [], 0, []
    for row in queries.select(key, vector, *extra).where(F.col(vector).isNotNull()).toLocalIterator():
        block.append(tuple(row))
        size += 8 * len(row[1])
        if size >= QUERY_BYTES:
            found.append(_dense_block(vectors, key, vector, kind, block, k, group))
            block, size = [], 0
    if block or not found:
        found.append(_dense_block(vectors, key, vector, kind, block, k, group))
    return top(reduce(DataFrame.unionByName, found), "q", key, "puntaje", k)


def _dense_block(vectors: DataFrame, key: str, vector: str, kind: str, block: list, k: int, group: str | None) -> DataFrame:
    members: dict = {}
    for j, row in enumerate(block):
        for g in row[2] if group else (None,):
            members.setdefault(g, []).append(j)
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], float), members))
    ddl = f"q {kind}, `{key}` {kind}, puntaje double"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, m, members = sent.value
        if not len(qids):
            return
        for batch in batches:
            groups = batch.column(2).to_pylist() if group else [None] * batch.num_rows
            by: dict = {}
            for i, v, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), groups):
                if v is not None and len(v) == m.shape[1] and g in members:
                    by.setdefault(g, []).append((i, v))
            for g, pairs in by.items():
                js = members[g]
                keys = np.array([i for i, _ in pairs])
                scores = np.round(np.array([v for _, v in pairs], float) @ m[js].T, 6)
                order = np.lexsort((np.broadcast_to(keys[:, None], scores.shape), -scores), axis=0)[:k]
                q = np.broadcast_to(qids[js][None, :], order.shape).ravel()
                yield _batch((q, keys[order].ravel(), np.take_along_axis(scores, order, 0).ravel()), schema)

    return vectors.select(key, vector, *([group] if group else [])).mapInArrow(run, ddl)


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int, seed: int = 5) -> np.ndarray:
    """Centroids of a coarse quantizer: k-means on the FIT_VECTORS vectors of smallest key hash, a bounded sample."""
    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(FIT_VECTORS).select(vector).collect()
    x = np.array([r[0] for r in rows], float)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(12):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def with_cells(vectors: DataFrame, key: str, vector: str, centroids: np.ndarray, n: int = 1) -> DataFrame:
    """(key, vector, celda): each vector with its n nearest cells, the nearest alone (an int) if n is 1."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)
    ddl = f"`{key}` {dict(vectors.dtypes)[key]}, `{vector}` array<float>, celda {'int' if n == 1 else 'array<int>'}"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            pairs = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and c.size and len(v) == c.shape[1]]
            if pairs:
                near = np.argsort(-(np.array([v for _, v in pairs]) @ c.T - 0.5 * (c * c).sum(1)), 1)[:, :n]
                cells = near[:, 0].tolist() if n == 1 else near.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([i for i, _ in pairs], [v for _, v in pairs], cells), schema)], schema=schema)

    return vectors.select(key, F.col(vector).cast("array<float>").alias(vector)).mapInArrow(run, ddl)


def ivf_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, cells: int = 64, probes: int = 16) -> DataFrame:
    """As dense_top over the rows of each query's nearest cells: an inverted-file index of all rows."""
    centroids = fit_cells(vectors, key, vector, cells)
    index = with_cells(vectors, key, vector, centroids)
    asked = with_cells(queries, key, vector, centroids, max(2, min(probes, len(centroids)))).withColumnRenamed("celda", "celdas")
    return dense_top(index, key, vector, asked, k, "celda", "celdas")


def neighbour_overlap(exact: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(q, recall): the share of a query's exact neighbours that another ranking holds."""
    hit = exact.join(found.select("q", key).withColumn("_h", F.lit(1)), ["q", key], "left")
    return hit.groupBy("q").agg(F.round(F.count("_h") / F.count(F.lit(1)), 6).alias("recall"))


def fuse(rankings: list[DataFrame], key: str, k: int, constant: int = RRF) -> DataFrame:
    """(q, key, puntaje, rango): reciprocal-rank fusion of (q, key, rango) lists, ties by key."""
    whole = reduce(DataFrame.unionByName, [r.select("q", key, "rango") for r in rankings])
    return top(whole.groupBy("q", key).agg(F.round(F.sum(1.0 / (constant + F.col("rango"))), 9).alias("puntaje")), "q", key, "puntaje", k)


def first_of_parent(ranking: DataFrame, parent: str, keep: int) -> DataFrame:
    """A ranking of distinct parents: the best row of each, ranks counted anew, the first ``keep``."""
    best = ranking.withColumn("_r", F.row_number().over(Window.partitionBy("q", parent).orderBy("rango"))).where("_r = 1").drop("_r")
    return best.withColumn("rango", F.row_number().over(Window.partitionBy("q").orderBy("rango"))).where(F.col("rango") <= keep)


def fuse_parents(rankings: list[DataFrame], key: str, parent: str, k: int, keep: int = 100) -> DataFrame:
    """(q, parent, key, puntaje, rango): fusion at parent level.

    Each ranking (q, key, parent, rango), the preferred one first, becomes one of distinct parents with ranks counted anew;
    those are fused, and a parent is shown by its best row of the first ranking that has it.
    """
    firsts = [first_of_parent(r.select("q", key, parent, "rango"), parent, max(keep, k)).withColumn("_l", F.lit(i)) for i, r in enumerate(rankings)]
    whole = reduce(DataFrame.unionByName, firsts)
    scored = whole.groupBy("q", parent).agg(F.round(F.sum(1.0 / (RRF + F.col("rango"))), 9).alias("puntaje"), F.min_by(key, F.struct("_l", "rango")).alias(key))
    return top(scored, "q", parent, "puntaje", k)


def reranked(ranking: DataFrame, key: str, score: Column, k: int, stable: bool) -> DataFrame:
    """A ranking ordered anew by a pair's score: ties by key, or, if stable, by the former rank."""
    w = Window.partitionBy("q").orderBy(F.desc("_s"), "rango" if stable else key)
    return ranking.withColumn("_s", score).withColumn("nuevo", F.row_number().over(w)).where(F.col("nuevo") <= k).withColumn("rango", F.col("nuevo")).drop("_s", "nuevo")


def pack(items: Column, cost: str, budget: int) -> Column:
    """Greedy packing of an ordered array of structs: one that doesn't fit is skipped, later ones may fit."""
    empty = F.struct(F.lit(0).cast("bigint").alias("usado"), F.array().cast("array<bigint>").alias("quedan"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["usado"] + x[cost] <= budget
        return F.struct(F.when(fits, acc["usado"] + x[cost]).otherwise(acc["usado"]).alias("usado"), F.when(fits, F.concat(acc["quedan"], F.array(x["id"]))).otherwise(acc["quedan"]).alias("quedan"))

    return F.aggregate(items, empty, step)


def pack_sorted(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """(group, usado, quedan): greedy packing of all rows of each group in order; a hot group is a sorted stream, never an array."""
    kind = dict(df.dtypes)[group]
    schema = _schema(f"`{group}` {kind}, usado bigint, quedan bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            rows = []
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or state[0] != g:
                    if state:
                        rows.append(state)
                    state = [g, 0, 0]
                if state[1] + c <= budget:
                    state[1] += c
                    state[2] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(state, schema)], schema=schema)

    return df.repartition(group).sortWithinPartitions(group, order).select(group, cost).mapInArrow(run, f"`{group}` {kind}, usado bigint, quedan bigint")
