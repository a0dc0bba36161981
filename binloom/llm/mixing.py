"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets copies = target of its source / words of its source, at most 2. The whole part is taken as it is; the
fractions of a source are rounded by the pivotal method: two fractions meet, mass moves at random (unbiased) from one to
the other until one of them is 0 or 1, and the other meets the next. Mass is counted in words, so a source's words are
kept but for its last fraction, and each document keeps its expectation. Fractions of like size meet, large ones first:
a block holds about BLOCK documents of one source and one size class, what each block leaves over (one fraction at most)
goes up a tree of such blocks, and the last fraction of a source, mostly a short document, is rounded by itself. Giants,
documents with more than 1 / GIANTS of their source's words, would be left over too often: each in turn meets the rest of
its source as one partner, is rounded, and the rest's common fraction takes up the difference. All draws are hashes of the two documents,
so reruns agree however rows are dealt.

Defined results: a null text has 0 words and takes 0; a null source is a source, the last; repeated rows are documents of
their own; an empty table gives an empty table; a source without words has target 0. Other columns may have any name: resample
leaves all as they are, mix replaces those named as one that it adds. Only DataFrame operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, no_more_than, read, settle

BLOCK = 256
#: Size classes per factor e.
CLASSES = 24
GIANTS = 32
#: Repeated rows of one kind that are numbered in one task, and rows up to which a table is sent to all executors.
HOT, SENT = 10_000, 500_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source.

    A target is the lesser of most * size and rate * weight with one common rate: sources in the order of size / weight
    reach their limit first, so the rate is the one of the first prefix of limited sources whose next source isn't.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    rate = (F.lit(share) * everything - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.withColumn("rate", rate)
    free = F.max(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("rate"))).over(Window.partitionBy())
    return w.select("source", "source_size", F.least(F.col("limit"), F.coalesce(free * F.col("weight"), F.col("limit"))).alias("target"))


def _draw(a: Column, b: Column, seed: int) -> Column:
    """Uniform in [0, 1) for a pair of units."""
    return F.shiftrightunsigned(F.xxhash64(a, b, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)


UNIT = "struct<order:double,key:bigint,base:bigint,p:double>"
DONE = "array<struct<base:bigint,taken:boolean>>"


def _round_block(units: Column, seed: int) -> Column:
    """Fold the units of a block, in their order, to a struct of rest (the one fraction left, or null) and done."""
    eps = 1e-9

    def settled(x: Column, p: Column) -> Column:
        return F.struct(x["base"].alias("base"), (p > 0.5).alias("taken"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("order", "key", "base")], p.alias("p")).cast(UNIT)

    def step(s: Column, x: Column) -> Column:
        a = s["rest"]
        a_words, x_words = -a["order"], -x["order"]
        # as many words as either direction lets pass until one of the two is 0 or 1
        up = F.least((F.lit(1.0) - x["p"]) * x_words, a["p"] * a_words)
        down = F.least(x["p"] * x_words, (F.lit(1.0) - a["p"]) * a_words)
        moved = F.when(_draw(a["key"], x["key"], seed) * (up + down) < down, up).otherwise(-down)
        pa, px = a["p"] - moved / a_words, x["p"] + moved / x_words
        whole = lambda p: (p < eps) | (p > 1 - eps)
        as_state = lambda rest, *ended: F.struct(
            rest.cast(UNIT).alias("rest"), (F.concat(s["done"], F.array(*ended)) if ended else s["done"]).cast(DONE).alias("done")
        )
        return (
            F.when(a.isNull(), as_state(x))
            .when(whole(pa) & whole(px), as_state(F.lit(None), settled(a, pa), settled(x, px)))
            .when(whole(px), as_state(with_p(a, pa), settled(x, px)))
            .otherwise(as_state(with_p(x, px), settled(a, pa)))
        )

    start = F.struct(F.lit(None).cast(UNIT).alias("rest"), F.array().cast(DONE).alias("done"))
    return F.aggregate(units, start, step)


def rounded(units: DataFrame, seed: int = 17) -> DataFrame:
    """Units (source, size, key, base, p) with 0 < p < 1 to (base, taken), one row each."""
    unit = F.struct((-F.col("size")).cast("double").alias("order"), "key", "base", "p").cast(UNIT)
    level = units.withColumn("class", F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) * CLASSES).cast("int"))
    filled = level.groupBy(F.col("source").alias("s"), F.col("class").alias("c")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    filled = settle(filled, "classes")
    widest = filled.agg(F.max("blocks")).first()[0] or 1
    level = level.join(filled, level["source"].eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")))
    level = level.select("source", "class", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"), unit.alias("unit"))
    depth, done = math.ceil(math.log(widest, BLOCK)), []
    # blocks of a class, then blocks of blocks, then the classes of a source
    for up in range(depth + 2):
        by = ["source", "class", "block"] if up <= depth else ["source"]
        block = level.groupBy(*by).agg(F.array_sort(F.collect_list("unit")).alias("units"))
        out = settle(block.select(*by, _round_block(F.col("units"), seed + up).alias("r")).select(*by, "r.rest", "r.done"), "pivots")
        done.append(out.select(F.explode("done").alias("d")).select("d.base", "d.taken"))
        path = ["class", F.floor(F.col("block") / BLOCK).alias("block")] if up < depth else []
        level = out.where("rest is not null").select("source", *path, F.col("rest").alias("unit"))
    alone = _draw(F.col("unit.key"), F.col("unit.key"), seed)
    result = level.select("unit.base", (alone < F.col("unit.p")).alias("taken"))
    for d in done:
        result = result.union(d)
    return result


def _giants(units: DataFrame, seed: int, most: float) -> DataFrame:
    """Giants (source, source_size, target, size, key, row), fewer than GIANTS a source, largest first: their copies, and what is left.

    One row per source: rest (words and target of all other documents) and done (key, copies).
    """
    state = "struct<words:double,target:double,done:array<struct<key:bigint,copies:bigint>>>"

    def step(s: Column, x: Column) -> Column:
        size = (-x["order"]).cast("double")
        share = s["target"] / s["words"]
        rest = s["words"] - size
        copies = F.floor(share) + (_draw(x["key"], x["row"], seed) < share - F.floor(share)).cast("bigint")
        # what the rest can't take or give up stays with the giant
        copies = F.greatest(copies, F.ceil((s["target"] - most * rest) / size - 1e-9))
        copies = F.least(copies, F.greatest(F.floor(s["target"] / size + 0.5), F.lit(0)), F.lit(int(most))).cast("bigint")
        left = F.greatest(F.lit(0.0), F.least(s["target"] - copies * size, most * rest))
        one = F.array(F.struct(x["key"].alias("key"), copies.alias("copies")))
        return F.struct(rest.alias("words"), left.alias("target"), F.concat(s["done"], one).alias("done")).cast(state)

    each = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "row")))
    by = units.groupBy("source").agg(F.first("source_size").cast("double").alias("words"), F.first("target").alias("target"), each.alias("giants"))
    start = F.struct("words", "target", F.array().cast("array<struct<key:bigint,copies:bigint>>").alias("done")).cast(state)
    return by.select("source", F.aggregate("giants", start, step).alias("s"))


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """rows with out, which counts the rows of each key from 1. A key of more than HOT rows is counted in several parts.

    Rows are dealt into parts by their place in the table, so rows must come in the same order each time, as from files.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT)
    hot = settle(hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / HOT).alias("_parts")), "hot")
    if hot.isEmpty():
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(key)).cast("bigint"))
    names = [F.col(c) for c in rows.columns]
    # the place comes first, as a join may deal rows anew
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).join(no_more_than(hot, SENT), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.select(*names, "_hot", F.coalesce(F.pmod("_at", "_parts"), F.lit(0)).alias("_part"))
    sizes = dealt.where("_hot is not null").groupBy("_hot", "_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("_hot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = settle(sizes.select(F.col("_hot").alias("_of"), F.col("_part").alias("_p"), F.coalesce(ahead, F.lit(0)).alias("_before")), "before")
    dealt = dealt.withColumn(out, F.row_number().over(Window.partitionBy(key, "_part").orderBy(key)))
    dealt = dealt.join(no_more_than(before, SENT), (F.col("_hot") == F.col("_of")) & (F.col("_part") == F.col("_p")), "left")
    return dealt.select(*names, (F.col(out) + F.coalesce("_before", F.lit(0))).cast("bigint").alias(out))


def _mixed(docs: DataFrame, kept: list[str], weights: tuple, share: float, most: float, seed: int) -> DataFrame:
    """The kept columns as c0, c1, ... with size, source_size, target and copies.

    Rows move once: repeated rows are numbered where they meet the counts of their kind. Rows without their texts are
    written, so that words are counted once.
    """
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    rows = docs.select(*carried, F.col("source").alias("_source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("_key"))
    rows = numbered(rows, "_key", "_row")
    if "text" not in kept:
        rows = settle(rows, "rows")
    small = rows.select(F.col("_source").alias("source"), "size", "_key", "_row")
    small = small if "text" not in kept else settle(small, "sizes")
    goal = settle(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    goal = goal.select(F.col("source").alias("_goal"), "source_size", "target")
    known = small.join(goal, small["source"].eqNullSafe(F.col("_goal"))).drop("_goal")
    giant = F.col("size") * GIANTS > F.col("source_size")
    large = settle(_giants(known.where(giant).select("source", "source_size", "target", "size", F.col("_key").alias("key"), F.col("_row").alias("row")), seed, most), "giants")
    fixed = large.select(F.explode("s.done").alias("d")).groupBy(F.col("d.key").alias("_key")).agg(F.sum("d.copies").alias("_sum"), F.count("*").alias("_of"))
    left = large.select(F.col("source").alias("_left"), "s.words", F.col("s.target").alias("rest"))
    goal = goal.join(left, F.col("_goal").eqNullSafe(F.col("_left")), "left")
    words, rest = F.coalesce("words", "source_size"), F.coalesce("rest", "target")
    copies = F.when(words > 0, F.least(rest / words, F.lit(float(most)))).otherwise(F.lit(0.0))
    # a hair below a whole number is that number
    goal = settle(goal.select("_goal", "source_size", "target", F.floor(copies + 1e-12).alias("whole"), copies.alias("exact")), "goals")
    units = small.join(goal, small["source"].eqNullSafe(F.col("_goal"))).where(~giant).withColumn("p", F.col("exact") - F.col("whole")).where("p > 1e-12 and size > 0")
    unit_key = F.when(F.col("_row") == 1, F.col("_key")).otherwise(F.xxhash64("_key", "_row"))
    taken = rounded(units.select("source", "size", unit_key.alias("key"), F.col("_key").alias("base"), "p"), seed)
    more = taken.where("taken").groupBy(F.col("base").alias("_key")).agg(F.count("*").alias("_more"))
    more = more.select("_key", "_more", F.lit(None).cast("bigint").alias("_sum"), F.lit(None).cast("bigint").alias("_of"))
    more = more.union(fixed.select("_key", F.lit(None).cast("bigint").alias("_more"), "_sum", "_of"))
    out = rows.join(more, "_key", "left").join(goal, F.col("_source").eqNullSafe(F.col("_goal")))
    # repeated giants share what they take
    big = F.expr("_sum div _of") + (F.col("_row") <= F.col("_sum") % F.col("_of")).cast("bigint")
    n = F.coalesce(big, F.col("whole") + (F.col("_row") <= F.coalesce("_more", F.lit(0))).cast("bigint"))
    return out.select(*[f"c{i}" for i in range(len(kept))], "size", "source_size", "target", n.cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (needed: doc_id, source, text) with size, source_size, target and copies, a bigint, appended.

    keep names the columns to carry, by default all. Columns named as one of the four are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "copies")]
    out = _mixed(docs, kept, weights, share, most, seed)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", "copies")


def resample(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of docs with all their columns as they are, each as often as the mix takes it."""
    out = _mixed(docs, docs.columns, weights, share, most, seed).where("copies > 0")
    out = out.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
