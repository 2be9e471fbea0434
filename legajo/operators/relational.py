"""Relational operators that the engine names: each takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(campo, total, nulos, vacios): one pass over the rows, unpivoted afterwards."""
    parts = [F.count(F.lit(1)).alias("total")]
    for c in columns:
        parts += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_if(F.col(c).cast("string") == "").alias(f"v_{c}")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col("total"), F.col(f"n_{c}").alias("nulos"), F.col(f"v_{c}").alias("vacios")) for c in columns]))
    return df.agg(*parts).select(rows.alias("r")).select("r.*")


def value_counts(df: DataFrame, columns: Sequence[str], empty: str = "(sin dato)") -> DataFrame:
    """(variable, valor, n) in long form, one shuffle for all variables."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(empty)).alias("valor")) for c in columns])
    return df.select(F.explode(cells).alias("x")).groupBy("x.variable", "x.valor").agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], digits: int = 3) -> DataFrame:
    """Linear-interpolation quantiles by group, one row for each point."""
    got = df.groupBy(*by).agg(F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in points])).alias("q"))
    return got.select(*by, F.posexplode("q").alias("i", "v")).select(*by, F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("i") + 1).alias("punto"), F.round("v", digits).alias("valor"))


def nearest_rank(df: DataFrame, value: str, p: float) -> DataFrame:
    """Both nearest-rank definitions: 0-based int(p n) capped at n - 1, and ceil(p n) - 1; by distinct values with counts, never by one sorted window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # distinct values are numbered range by range, so no task holds them all
    spread = counts.withColumn("b", F.floor(F.log2(F.abs(F.col(value)) + 1) * 64) * F.signum(F.col(value)))
    base = spread.groupBy("b").agg(F.sum("n").alias("m"))
    before = base.withColumn("antes", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "antes")
    cum = spread.join(before, "b").withColumn("hasta", F.col("antes") + F.sum("n").over(Window.partitionBy("b").orderBy(value)))
    low = cum.crossJoin(F.broadcast(total))
    first = F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
    second = F.ceil(F.lit(p) * F.col("total")) - 1
    return low.agg(F.min(F.when(F.col("hasta") > first, F.col(value))).alias("por_indice"), F.min(F.when(F.col("hasta") > second, F.col(value))).alias("por_techo"))


def crosstab(df: DataFrame, rows: Column, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``column``'s values side by side; the values are given, so no extra job looks for them."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def cooccurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, n): how many keys hold both items.  Pairs arise inside a key, of its distinct items."""
    sets = df.select(key, item).distinct()
    a, b = sets.select(key, F.col(item).alias("a")), sets.select(key, F.col(item).alias("b"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(df: DataFrame, content: Column, key: str) -> DataFrame:
    """(huella, n, menor): contents that occur more than once, with their count and smallest key."""
    return df.select(F.sha2(content, 256).alias("huella"), F.col(key)).where("huella IS NOT NULL").groupBy("huella").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("menor")).where("n > 1")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, campo, cambio): rows added, removed and fields changed; null and empty count as equal."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    norm = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))
    changed = F.filter(F.array(*[F.when(norm("a", f) != norm("b", f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kinds = F.when(F.col(f"a.{key}").isNull(), F.array(F.struct(F.lit("").alias("campo"), F.lit("agregado").alias("cambio")))).when(
        F.col(f"b.{key}").isNull(), F.array(F.struct(F.lit("").alias("campo"), F.lit("retirado").alias("cambio")))
    ).otherwise(F.transform(changed, lambda f: F.struct(f.alias("campo"), F.lit("cambiado").alias("cambio"))))
    return joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), F.explode(kinds).alias("k")).select(key, "k.campo", "k.cambio")


def unique_alias(df: DataFrame, alias: Column, target: str) -> DataFrame:
    """(alias, destino): null where an alias stands for more than one target."""
    return df.groupBy(alias.alias("alias")).agg(F.when(F.count_distinct(target) == 1, F.min(target)).alias("destino"))


def priority_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which the first part that has a key wins; prioridad tells which.

    The winner is a maximum, so the choice is combined before the shuffle.
    """
    tagged = [p.withColumn("prioridad", F.lit(i)) for i, p in enumerate(parts, 1)]
    rest = [c for c in parts[0].columns if c != key]
    whole = reduce(DataFrame.unionByName, tagged)
    return whole.groupBy(key).agg(F.min(F.struct("prioridad", *rest)).alias("x")).select(key, "x.*")


def interval_overlap(spans: DataFrame, parts: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of half-open intervals (a, b) that overlap, clipped: an equi-join on key and bucket, each pair kept in its first common bucket."""
    cut = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key]).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{p}_a") / bucket), F.floor((F.col(f"{p}_b") - 1) / bucket))))
    left = cut(spans.where("a < b"), "s")
    right = cut(parts.where("a < b"), "p")
    start = F.greatest("s_a", "p_a")
    joined = left.join(right, [key, "bucket"]).where((F.col("s_a") < F.col("p_b")) & (F.col("p_a") < F.col("s_b")) & (F.floor(start / bucket) == F.col("bucket")))
    return joined.drop("bucket").withColumn("desde", start).withColumn("hasta", F.least("s_b", "p_b"))


def gaps(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """(by, desde, hasta): missing runs between distinct integers of a group."""
    w = Window.partitionBy(*by).orderBy(number)
    return df.select(*by, number).distinct().withColumn("sig", F.lead(number).over(w)).where(F.col("sig") > F.col(number) + 1).select(*by, (F.col(number) + 1).alias("desde"), (F.col("sig") - 1).alias("hasta"))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], same: Column) -> DataFrame:
    """Adds isla: the number of the maximal run of rows for which ``same`` keeps its value."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_v", same).withColumn("_c", F.when(F.col("_v").eqNullSafe(F.lag("_v").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    return marked.withColumn("isla", F.sum("_c").over(w)).drop("_v", "_c")


def stratified(df: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """D'Hondt sample: seats go to the next largest quotient n / (i + 1), at least one a stratum; rows by hash order.

    Only quotients that can win (at most ``size`` a stratum) are ranked; rows are ranked within their stratum.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    seats = sizes.select(stratum, F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(size)))).alias("i"), "n")
    ranked = seats.select(stratum, "i", F.row_number().over(Window.orderBy((F.col("i") > 1).cast("int"), F.desc(F.col("n") / F.col("i")), stratum)).alias("r"))
    taken = ranked.where((F.col("r") <= size) | (F.col("i") == 1)).groupBy(stratum).agg(F.count(F.lit(1)).alias("cupos"))
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256))
    # no stratum has more seats than the sample: the constant limit keeps so many rows a partition before the shuffle
    ranked_rows = df.withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= size)
    return ranked_rows.join(taken, stratum).where("puesto <= cupos").select(stratum, key, "puesto")


def censused(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(campo, total, nulos, vacios, listas_vacias, faltan, porcentaje): missing is null, an empty string or an empty list; one pass."""
    kinds = dict(df.dtypes)
    parts = [F.count(F.lit(1)).alias("total")]
    for c in columns:
        text, many = kinds[c] == "string", kinds[c].startswith(("array", "map"))
        parts += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), (F.count_if(F.col(c) == "") if text else F.lit(0).cast("bigint")).alias(f"v_{c}"), (F.count_if(F.size(c) == 0) if many else F.lit(0).cast("bigint")).alias(f"l_{c}")]
    cell = lambda c: F.struct(F.lit(c).alias("campo"), F.col("total"), F.col(f"n_{c}").alias("nulos"), F.col(f"v_{c}").alias("vacios"), F.col(f"l_{c}").alias("listas_vacias"))
    rows = df.agg(*parts).select(F.explode(F.array(*map(cell, columns))).alias("r")).select("r.*")
    gone = F.col("nulos") + F.col("vacios") + F.col("listas_vacias")
    return rows.withColumn("faltan", gone).withColumn("porcentaje", F.round(100.0 * F.try_divide(gone, F.col("total")), 4))


def first_wins(parts: Sequence[DataFrame], key: str, alternates: str) -> DataFrame:
    """Union in which the first part that has a key wins; a null field is filled from the next part that has it, and the others' values of ``alternates`` are kept as a sorted set.

    Everything is a minimum by part, so it combines before the shuffle; only the alternates of a key are collected, one for each part.
    """
    whole = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in parts[0].columns if c not in (key, alternates)]
    filled = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in rest]
    out = whole.groupBy(key).agg(F.min_by(alternates, "_p").alias(alternates), F.collect_set(F.col(alternates)).alias("_a"), *filled)
    return out.withColumn("alternas", F.array_join(F.array_sort(F.array_except("_a", F.array(alternates))), "|")).drop("_a")


def disjoint_union(parts: Sequence[DataFrame], key: str, *excluded: DataFrame) -> DataFrame:
    """Union in which the first part that has a key wins, without the keys of any exclusion set."""
    out = priority_union(parts, key)
    for e in excluded:
        out = out.join(e.select(F.col(e.columns[0]).alias(key)), key, "left_anti")
    return out


def overlaid(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The fields of ``extra`` over those of ``base`` by key; a null of ``extra`` leaves the base's value."""
    fields = [c for c in base.columns if c != key]
    b, e = base.select(F.col(key).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in fields]), extra.select(F.col(key).alias("_e"), *[F.col(c).alias(f"e_{c}") for c in fields])
    return b.join(e, F.col("_b") == F.col("_e"), "full_outer").select(F.coalesce("_b", "_e").alias(key), *[F.coalesce(f"e_{c}", f"b_{c}").alias(c) for c in fields])


def replaced(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``base`` whose composite key isn't in ``new``, and the rows of ``new``; null keys match null keys."""
    kept = base.alias("b").join(new.select(*keys).distinct().alias("n"), reduce(Column.__and__, [F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]), "left_anti")
    return kept.unionByName(new.select(*base.columns))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(lado, valor): distinct values that one side lacks; no row if the sets are equal."""
    v = lambda d: d.select(F.col(d.columns[0]).alias("valor")).distinct()
    return v(a).join(v(b), "valor", "left_anti").select(F.lit("sobra").alias("lado"), "valor").unionByName(v(b).join(v(a), "valor", "left_anti").select(F.lit("falta").alias("lado"), "valor"))


def matched(left: DataFrame, right: DataFrame, key: str, target: str) -> DataFrame:
    """left with ``target`` where exactly one distinct right value matches, and how many do (coincidencias)."""
    per = right.groupBy(key).agg(F.count_distinct(target).alias("_n"), F.min(target).alias("_t"))
    return left.join(per, key, "left").withColumn("coincidencias", F.coalesce("_n", F.lit(0))).withColumn(target, F.when(F.col("_n") == 1, F.col("_t"))).drop("_n", "_t")


def cascade(left: DataFrame, row: str, lookups: Sequence[tuple[DataFrame, Sequence[str], str]], target: str) -> DataFrame:
    """left with the target of the first lookup (rows, keys, target column) that gives exactly one, and which (via)."""
    out = left
    for i, (rows, keys, column) in enumerate(lookups):
        per = rows.groupBy(*keys).agg(F.when(F.count_distinct(column) == 1, F.min(column)).alias(f"_t{i}"))
        out = out.join(per, list(keys), "left")
    found = F.coalesce(*[F.col(f"_t{i}") for i in range(len(lookups))])
    via = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull(), F.lit(i + 1)) for i in range(len(lookups))])
    return out.select(row, found.alias(target), via.alias("via"))


def contains_all(needed: Column, present: Column) -> Column:
    """Whether a set holds every element of another."""
    return F.size(F.array_except(needed, present)) == 0


def state_counts(df: DataFrame, check: str, state: str) -> DataFrame:
    """(check, estados): the counts of each state of a check, as one text in order of state."""
    per = df.groupBy(check, state).agg(F.count(F.lit(1)).alias("n"))
    cell = F.struct(F.coalesce(F.col(state), F.lit("(sin dato)")).alias("s"), F.col("n"))
    return per.groupBy(check).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: F.concat_ws("=", x["s"], x["n"].cast("string"))), ", ").alias("estados"))


def resources(df: DataFrame, keys: Sequence[str], done: str, all_: str, audited: str) -> DataFrame:
    """Sums by composite key, how many rows could be audited, and the ratio done / all: null if all is 0 or a row couldn't be audited."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("filas"), F.sum(done).alias("hechos"), F.sum(all_).alias("total"), F.count(audited).alias("auditables"))
    return out.withColumn("razon", F.when(F.col("auditables") == F.col("filas"), F.round(F.try_divide(F.col("hechos").cast("double"), F.col("total").cast("double")), 6)))


def interval_words(df: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """df with the size between a row's place and the next one's of its key; the last goes to the end (``size`` of the whole)."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("tramo", F.coalesce(F.lead(order).over(w), F.col(size)) - F.col(order))


def argmax(df: DataFrame, by: Sequence[str], best: Sequence[Column]) -> DataFrame:
    """The row of each group that is first by the given orders; ranked with a limit, so it combines before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*best)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def extremes(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """(extremo, puesto, key, value): the k greatest and smallest values, ties by key."""
    def side(name: str, order: Column) -> DataFrame:
        top = df.where(F.col(value).isNotNull()).orderBy(order, key).limit(k)
        return top.select(F.lit(name).alias("extremo"), F.row_number().over(Window.orderBy(order, key)).alias("puesto"), key, value)

    return side("mayor", F.desc(value)).unionByName(side("menor", F.asc(value)))
