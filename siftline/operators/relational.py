"""Joins, ordered aggregates, windows, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, words_nonword, words_ws

# --- joins ---------------------------------------------------------------------------------------


def not_done(source: DataFrame, done: DataFrame, key: str, error: str | None = None) -> DataFrame:
    """Rows of ``source`` that ``done`` lacks; rows of ``done`` with an error count as lacking."""
    if error and error in done.columns:
        done = done.where(F.col(error).isNull())
    return source.join(done.select(key).distinct(), key, "left_anti")


def after_done(source: DataFrame, done: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that come after every row already done, in the source's order."""
    last = source.join(done.select(key).distinct(), key, "left_semi").agg(F.max(order).alias("last_done"))
    return source.crossJoin(F.broadcast(last)).where(F.col("last_done").isNull() | (F.col(order) > F.col("last_done"))).drop("last_done")


def outer_combine(left: DataFrame, right: DataFrame, keys: list[str], combine: dict[str, Column]) -> DataFrame:
    """Full outer join on ``keys`` with combined columns."""
    joined = left.join(right, keys, "full_outer")
    return joined.select(*keys, *[c.alias(n) for n, c in combine.items()])


def asof_nearest(left: DataFrame, right: DataFrame, by: str, on: str, value: str, tie: str, out: str | None = None) -> DataFrame:
    """Every left row with the right row of its key that is nearest in ``on``; of equally near ones the earlier.

    One shuffle by key: both sides are laid on one line, and running last and first values give the neighbours on either side.
    Right rows with equal ``on`` are decided by ``tie``: the last of them looking back, the first looking forward.
    """
    out = out or f"near_{value}"
    r = right.select(F.col(by), F.col(on), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(on).alias("on"), F.col(value).alias("v")).alias("_hit"))
    cols = F.struct(*[F.col(c) for c in left.columns])
    side = left.select(F.col(by), F.col(on), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"), cols.alias("_row"))
    line = r.withColumn("_row", F.lit(None).cast(side.schema["_row"].dataType)).unionByName(side)
    back = Window.partitionBy(by).orderBy(on, "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(by).orderBy(F.desc(on), F.desc("_side"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = line.select("_row", F.col(on).alias("_on"), F.last("_hit", True).over(back).alias("_b"), F.last("_hit", True).over(ahead).alias("_a")).where(F.col("_row").isNotNull())
    timed = left.schema[on].dataType.simpleString().startswith("timestamp")
    place = (lambda c: F.unix_micros(c.cast("timestamp"))) if timed else (lambda c: c)
    gap = lambda c: F.abs(place(F.col("_on")) - place(c["on"]))
    take_back = F.col("_b").isNotNull() & (F.col("_a").isNull() | (gap(F.col("_b")) <= gap(F.col("_a"))))
    return near.select("_row.*", F.when(take_back, F.col("_b.v")).otherwise(F.col("_a.v")).alias(out), F.when(take_back, F.col("_b.on")).otherwise(F.col("_a.on")).alias(f"{out}_{on}"))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "Unknown") -> DataFrame:
    """``df`` with ``value`` from ``table``, or the default. The optimizer broadcasts the table if its size allows."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def overwrite_sources(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """``new`` in place of all rows of its sources."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new, allowMissingColumns=True)


def manifest_changes(local: DataFrame, remote: DataFrame, path: str = "path", digest: str = "md5") -> DataFrame:
    """Files that the remote side lacks or has with other content."""
    return local.join(remote.select(path, digest), [path, digest], "left_anti")


# --- ordered aggregates --------------------------------------------------------------------------


def concat_groups(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "\n", out: str = "text") -> DataFrame:
    """Texts of each group joined in order; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    joined = F.array_join(F.transform(rows, lambda r: r["_t"]), separator)
    return df.where(F.col(text).isNotNull()).groupBy(*keys).agg(joined.alias(out))


def corpus_stats(df: DataFrame, by: str, text: str = "text", total: bool = True) -> DataFrame:
    """Documents, lines, words and characters of each group, and of all under a null group."""
    base = df.select(by, F.size(lines(F.col(text))).cast("long").alias("l"), F.size(words_ws(F.col(text))).cast("long").alias("w"), F.length(text).cast("long").alias("c"))
    grouped = base.rollup(by) if total else base.groupBy(by)
    return grouped.agg(
        F.count("*").alias("documents"), F.sum("l").alias("lines"), F.sum("w").alias("words"), F.sum("c").alias("chars"), F.round(F.avg("l"), 6).alias("mean_lines"), F.round(F.avg("w"), 6).alias("mean_words")
    )


def vocabulary(df: DataFrame, text: str = "text", approximate: bool = False) -> DataFrame:
    """Words in all and distinct words."""
    words = df.select(F.explode(F.filter(words_nonword(F.col(text)), lambda w: w != "")).alias("w"))
    distinct = F.approx_count_distinct("w") if approximate else F.countDistinct("w")
    return words.agg(F.count("*").alias("words"), distinct.alias("vocabulary"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) with bins 1..bins; 0 and bins + 1 hold what lies outside."""
    return df.select(F.width_bucket(value.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns or df.columns])


def pair_rules(baskets: DataFrame, basket: str, item: str, support: float = 0.0025, confidence: float = 0.15) -> DataFrame:
    """(a, b, n, support, confidence, lift): association rules of pairs. Rare items go before pairs are formed."""
    rows = baskets.select(F.col(basket).alias("k"), F.col(item).alias("i")).distinct()
    total = rows.select(F.countDistinct("k").alias("total"))
    ones = rows.groupBy("i").agg(F.count("*").alias("n1")).crossJoin(F.broadcast(total)).where(F.col("n1") >= F.col("total") * support)
    kept = rows.join(ones.select("i"), "i", "left_semi")
    pairs = kept.select("k", F.col("i").alias("a")).join(kept.select("k", F.col("i").alias("b")), "k").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    found = pairs.join(ones.select(F.col("i").alias("a"), F.col("n1").alias("na"), "total"), "a").join(ones.select(F.col("i").alias("b"), F.col("n1").alias("nb")), "b")
    out = found.select("a", "b", "n", F.round(F.col("n") / F.col("total"), 6).alias("support"), F.round(F.col("n") / F.col("na"), 6).alias("confidence"), F.round(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")), 6).alias("lift"))
    return out.where((F.col("support") >= support) & (F.col("confidence") >= confidence))


def frequent_itemsets(baskets: DataFrame, basket: str, item: str, support: float = 0.0025, confidence: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Frequent item sets of every size and their rules, by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets.groupBy(basket).agg(F.collect_set(item).alias("items")))
    return model.freqItemsets, model.associationRules


def pool_vectors(df: DataFrame, key: str, vector: str, how: str = "mean") -> DataFrame:
    """One vector a group: mean, median or max of each dimension."""
    agg = {"mean": F.avg("x"), "median": F.median("x"), "max": F.max("x")}[how]
    dims = df.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(F.round(agg.cast("double"), 6).alias("x"))
    return dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vector))


# --- windows -------------------------------------------------------------------------------------


def running_number(df: DataFrame, by: list[str], order: list[str], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def fill_forward(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def sentence_buffer(df: DataFrame, by: str, pos: str, text: str, delimiter: str = "[:;.]", tail: bool = True) -> DataFrame:
    """Consecutive lines joined until one holds a delimiter; (by, buffer, text). ``tail`` keeps a last buffer without one."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    flagged = df.withColumn("_ends", F.col(text).rlike(delimiter).cast("int"))
    rows = flagged.withColumn("buffer", F.coalesce(F.sum("_ends").over(w), F.lit(0)).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(text).alias("_t")))), lambda r: r["_t"]), "")
    out = rows.groupBy(by, "buffer").agg(joined.alias(text), F.max("_ends").alias("_done"))
    return (out if tail else out.where("_done = 1")).drop("_done")


def bad_transitions(df: DataFrame, by: str, pos: str, kind: str, allowed: set[tuple[str, str]]) -> DataFrame:
    """Rows whose kind may not follow the kind before."""
    before = F.coalesce(F.lag(kind).over(Window.partitionBy(by).orderBy(pos)), F.lit("START"))
    fine = F.concat_ws(">", "before", F.col(kind)).isin([f"{a}>{b}" for a, b in sorted(allowed)])
    return df.withColumn("before", before).where(~fine)


# --- samples and splits --------------------------------------------------------------------------


def draw(key: Column, seed: int | str = 0) -> Column:
    """A value that orders rows at random but always alike."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def sample_k(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement; an error if there are fewer. Only the k best of each partition are gathered."""
    if df.limit(k).count() < k:
        raise ValueError(f"{k} rows were asked for, there are fewer")
    return df.orderBy(draw(F.col(key), seed), key).limit(k)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose draw lies below a fraction; no shuffle, and the same rows each time."""
    return df.where(F.conv(F.substring(draw(F.col(key), seed), 1, 8), 16, 10).cast("double") < fraction * 2**32)


def sample_with_replacement(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def sample_per_group(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw(F.col(key), seed), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def split_sets(df: DataFrame, by: str, key: str, validation: float = 0.05, test: float = 0.05, seed: int = 0) -> DataFrame:
    """``split``: exact shares of every group become validation and test, the rest train."""
    w = Window.partitionBy(by)
    out = df.withColumns({"_r": F.row_number().over(w.orderBy(draw(F.col(key), seed), key)), "_n": F.count("*").over(w)})
    v, t = F.floor(F.col("_n") * validation), F.floor(F.col("_n") * test)
    return out.withColumn("split", F.when(F.col("_r") <= v, "validation").when(F.col("_r") <= v + t, "test").otherwise("train")).drop("_r", "_n")


def balanced_groups(df: DataFrame, key: str, groups: int, copies: int = 2, seed: int = 0) -> DataFrame:
    """Every row in ``copies`` different groups of equal size: (key, slot, group). For assignments of a bounded number of items to people."""
    n = F.row_number().over(Window.orderBy(draw(F.col(key), seed), key)) - 1
    slots = df.select(key, n.alias("_n")).select(key, "_n", F.explode(F.array(*[F.lit(i).cast("long") for i in range(copies)])).alias("slot"))
    return slots.select(key, "slot", F.pmod(F.col("_n") * copies + F.col("slot"), F.lit(groups)).cast("long").alias("group"))


def nearest(df: DataFrame, query: Column, vector: str, key: str, k: int) -> DataFrame:
    """The k rows nearest to a vector by Euclidean distance."""
    d = F.sqrt(F.aggregate(F.zip_with(F.col(vector), query, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2))), F.lit(0.0), lambda a, x: a + x))
    return df.select(key, F.round(d, 6).alias("distance")).orderBy("distance", key).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null beside a zero vector."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.try_divide(dot, size(a) * size(b))
