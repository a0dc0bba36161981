"""Histograms as DataFrames, one row per key and non-empty bin: recording, merging, subtracting, omission correction.

A table of histograms has the key columns, `bin` and `cnt`, and `n` if counters are capped: `cnt` stops at the cap then,
`n` doesn't, as totals count every sample. Merging is a grouped sum, so map-side combination, rollups over keys and
streaming updates give exactly what a single pass would.

Keys may have any name but those of RESERVED. Operators call them _key0, _key1, ... while they work, so that no column of
their own meets one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins as B
from ..geometry import U64, Geometry

#: Fixed: the largest count of each counter type.
CAPS = {"u8": 255, "u16": 65535, "u32": 4294967295, "u64": U64}
RESERVED = {"bin", "cnt", "n"}


def _plain(keys) -> tuple[str, ...]:
    return tuple(f"_key{i}" for i in range(len(keys)))


def renamed(keys) -> list[Column]:
    """The keys under the names that operators use."""
    return [F.col(f"`{k}`").alias(p) for k, p in zip(keys, _plain(keys), strict=True)]


@dataclass(frozen=True)
class Histograms:
    bins: DataFrame
    geometry: Geometry
    keys: tuple[str, ...] = field(default=())
    counter: str | None = None

    @property
    def total(self) -> str:
        """The column that totals add up."""
        return "n" if self.counter else "cnt"

    def __post_init__(self):
        if clash := RESERVED.intersection(k.lower() for k in self.keys):
            raise ValueError(f"a key can't be called {', '.join(sorted(clash))}")

    def with_bins(self, bins: DataFrame) -> Histograms:
        return replace(self, bins=bins)

    @property
    def counts(self) -> list[str]:
        return ["cnt", "n"] if self.counter else ["cnt"]

    def plain(self) -> Histograms:
        """The same with keys _key0, _key1, ..."""
        return replace(self, bins=self.bins.select(*renamed(self.keys), "bin", *self.counts), keys=_plain(self.keys))

    def named(self, keys) -> Histograms:
        """The same with these names of the keys."""
        keys = tuple(keys)
        columns = [F.col(p).alias(k) for p, k in zip(self.keys, keys, strict=True)]
        return replace(self, bins=self.bins.select(*columns, "bin", *self.counts), keys=keys)


def with_named_keys(table: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions from histograms to a table: they see keys that meet no column of theirs. A key can't have a result column's name."""

    @functools.wraps(table)
    def run(h: Histograms, *args, **how) -> DataFrame:
        out = table(h.plain(), *args, **how)
        plain = _plain(h.keys)
        rest = [c for c in out.columns if c not in plain]
        if clash := {c.lower() for c in rest}.intersection(k.lower() for k in h.keys):
            raise ValueError(f"a key can't be called {', '.join(sorted(clash))} here")
        return out.select(*[F.col(p).alias(k) for p, k in zip(plain, h.keys, strict=True)], *[F.col(f"`{c}`") for c in rest])

    return run


def _summed(rows: DataFrame, keys: tuple, weight: Column, counter: str | None) -> DataFrame:
    """Rows with a bin to bins with counts. Uncapped counts are BIGINT and fail on overflow; capped ones are DECIMAL."""
    if counter is None:
        return rows.groupBy(*keys, "bin").agg(F.sum(weight).alias("cnt"))
    n = F.least(F.sum(weight.cast(B.UNSIGNED)), F.lit(Decimal(U64))).cast(B.UNSIGNED)
    out = rows.groupBy(*keys, "bin").agg(n.alias("n"))
    return out.select(*keys, "bin", F.least("n", F.lit(Decimal(CAPS[counter]))).alias("cnt"), "n")


def record(df: DataFrame, value: str | Column, geometry: Geometry, keys=(), weight: str | Column | None = None, saturate: bool = False, counter: str | None = None) -> Histograms:
    """Record a value (BIGINT) of each row, `weight` times, in the histogram of its keys.

    A value without a bin fails the job, or with saturate counts as the geometry's high. Null values and weights of 0
    count for nothing. Negative values stand for 2^63 and above.
    """
    keys = tuple(keys)
    v = B._col(value)
    w = F.lit(1).cast("bigint") if weight is None else B._col(weight)
    at = B.bin_index(B.clamped(v, geometry), geometry) if saturate else B.checked_bin_index(v, geometry)
    rows = df.select(*renamed(keys), at.alias("bin"), w.alias("_w")).where("bin is not null and _w > 0")
    return Histograms(_summed(rows, _plain(keys), F.col("_w"), counter), geometry, _plain(keys), counter).named(keys)


def _spread(rows: DataFrame, g: Geometry, keys: tuple, interval: int, counter: str | None) -> Histograms:
    """Rows (plain keys, _v, _w) with all that an interval implies: v, v - interval, v - 2 interval, ... down to the interval.

    A row for each term, or for each bin between those of the interval and of v with the number of terms in it, whichever
    is less: at most `bins` rows a value whatever its size. They are summed by bin before the one shuffle, so what moves
    is bins, not samples.
    """
    top = B.checked_bin_index("_v", g)
    if interval <= 0:
        rows = rows.select(*keys, top.alias("bin"), "_w")
        return Histograms(_summed(rows, keys, F.col("_w"), counter), g, keys, counter)
    several = F.col("_v") > interval
    first = F.when(several, F.least(F.lit(g.index(interval)), top)).otherwise(top)
    terms = F.when(several, F.expr(f"_v div {interval}")).otherwise(F.lit(1).cast("bigint"))
    out = rows.select(*keys, "_v", "_w", several.alias("_several"), (F.col("_v") % interval).alias("_r"), terms.alias("_m"), first.alias("_first"), top.alias("_top"))
    out = out.withColumn("_by_term", F.col("_m") <= F.col("_top") - F.col("_first") + 1)
    steps = F.when(F.col("_by_term"), F.col("_m") - 1).otherwise(F.col("_top") - F.col("_first"))
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), steps)).alias("_j"))
    term = F.when(F.col("_several"), F.col("_r") + (F.col("_j") + 1) * interval).otherwise(F.col("_v"))
    at = F.when(F.col("_by_term"), B.bin_index(term, g)).otherwise((F.col("_first") + F.col("_j")).cast("int"))
    # by bins: terms are r + j * interval, 1 <= j <= m; those up to the bin's end less those before it
    i, r, m = (F.col("_first") + F.col("_j")).cast("int"), F.col("_r"), F.col("_m")
    up_to = lambda x: F.when(x < r, F.lit(0)).otherwise(F.least(m, F.call_function("div", x - r, F.lit(interval))))
    n = F.when(F.col("_by_term"), F.lit(1)).otherwise(up_to(B.bin_high(i, g)) - up_to(B.bin_low(i, g) - 1))
    out = out.withColumn("bin", at)
    out = out.select(*keys, "bin", (n * F.col("_w")).alias("_w")).where("_w > 0")
    return Histograms(_summed(out, keys, F.col("_w"), counter), g, keys, counter)


def record_correct(df: DataFrame, value: str | Column, geometry: Geometry, interval: int, keys=(), weight: str | Column | None = None, counter: str | None = None) -> Histograms:
    """Record with the samples that a stalled writer left out, one expected each interval."""
    keys = tuple(keys)
    w = F.lit(1).cast("bigint") if weight is None else B._col(weight).cast("bigint")
    rows = df.select(*renamed(keys), B._col(value).alias("_v"), w.alias("_w")).where("_v is not null and _w > 0")
    return _spread(rows, geometry, _plain(keys), interval, counter).named(keys)


def corrected(h: Histograms, interval: int) -> Histograms:
    """The same for values already recorded: each stands for the largest value of its bin."""
    p = h.plain()
    rows = p.bins.select(*p.keys, B.bin_high("bin", h.geometry).alias("_v"), F.col(h.total).cast("bigint").alias("_w"))
    return _spread(rows, h.geometry, p.keys, interval, h.counter).named(h.keys)


def new_from(h: Histograms) -> Histograms:
    """Empty histograms of the same geometry, keys and counter."""
    return h.with_bins(h.bins.limit(0))


def cleared(h: Histograms) -> Histograms:
    """What is left when all counts are taken away: clearing and resetting are the same here, as extremes are those of the bins."""
    return new_from(h)


def set_to(h: Histograms, other: Histograms) -> Histograms:
    """The samples of other in place of those of h, in the geometry and with the counter of h. Keys are those of h, by name."""
    return add(new_from(h), other)


def set_to_corrected(h: Histograms, other: Histograms, interval: int) -> Histograms:
    return add_correct(new_from(h), other, interval)


def rebin(h: Histograms, geometry: Geometry, error: str = "OtherAddendValueExceedsRange") -> Histograms:
    """The counts in another geometry's bins; each bin goes where its smallest value belongs."""
    if h.geometry.same_bins(geometry) and (geometry.auto_resize or geometry.bins >= h.geometry.bins):
        return replace(h, geometry=geometry)
    i = B.bin_index(B.bin_low("bin", h.geometry), geometry)
    at = i if geometry.auto_resize else F.when(i < geometry.bins, i).otherwise(F.raise_error(F.lit(error)).cast("int"))
    p = h.plain()
    rows = p.bins.select(*p.keys, at.alias("bin"), F.col(h.total).alias("_w"))
    return Histograms(_summed(rows, p.keys, F.col("_w"), h.counter), geometry, p.keys, h.counter).named(h.keys)


def add(h: Histograms, *others: Histograms) -> Histograms:
    """Histograms of the same keys added, in the geometry of the first and with its counter.

    Of capped addends the counts that they kept are added, to uncapped ones; an uncapped addend's count is its number of samples.
    """
    p = h.plain()
    bins = p.bins
    kind = h.bins.schema["cnt"].dataType
    for other in others:
        theirs = rebin(other, h.geometry)
        theirs = theirs.with_bins(theirs.bins.select(*[F.col(f"`{k}`") for k in h.keys], "bin", *theirs.counts))
        theirs = replace(theirs, keys=h.keys).plain().bins
        counts = [F.col("cnt").cast(kind).alias("cnt"), F.col("n" if other.counter else "cnt").cast(kind).alias("n")][: len(h.counts)]
        bins = bins.unionByName(theirs.select(*p.keys, "bin", *counts))
    return p.with_bins(_summed(bins, p.keys, F.col(h.total), h.counter)).named(h.keys)


def add_correct(h: Histograms, other: Histograms, interval: int) -> Histograms:
    return add(h, corrected(rebin(other, h.geometry), interval))


def merge(h: Histograms, keys=()) -> Histograms:
    """Add up over the keys that are left out."""
    keys, p = tuple(keys), h.plain()
    kept = tuple(p.keys[h.keys.index(k)] for k in keys)
    return Histograms(_summed(p.bins, kept, F.col(h.total), h.counter), h.geometry, kept, h.counter).named(keys)


def rollup(h: Histograms) -> Histograms:
    """Histograms of all leading parts of the keys, nulls for what is added up (and `level`, the number of keys left).

    The bins are read once: each is counted in all its levels by one grouping.
    """
    p = h.plain()
    levels = [[*p.keys[:k], "bin"] for k in range(len(p.keys), -1, -1)]
    left = F.lit(len(p.keys)) - sum((F.grouping(k) for k in p.keys), F.lit(0))
    if h.counter is None:
        out = p.bins.groupingSets(levels, *p.keys, "bin").agg(F.sum("cnt").alias("cnt"), left.cast("int").alias("level"))
    else:
        n = F.least(F.sum(F.col("n").cast(B.UNSIGNED)), F.lit(Decimal(U64))).cast(B.UNSIGNED)
        out = p.bins.groupingSets(levels, *p.keys, "bin").agg(n.alias("n"), left.cast("int").alias("level"))
        out = out.withColumn("cnt", F.least("n", F.lit(Decimal(CAPS[h.counter]))))
    out = out.select(*p.keys, F.col("level").alias("_level"), "bin", *h.counts)
    return Histograms(out, h.geometry, (*p.keys, "_level"), h.counter).named((*h.keys, "level"))


def subtract(h: Histograms, other: Histograms) -> Histograms:
    """Counts of other taken from those of h; more than h has, or a value that h can't hold, fails the job, as a whole."""
    other = rebin(other, h.geometry, "SubtrahendValueExceedsMinuendRange")
    p = h.plain()
    theirs = other.bins.select(*renamed(h.keys), "bin", F.col("cnt").alias("less"), F.col(other.total).alias("fewer"))
    joined = _outer(p.bins, theirs, [*p.keys, "bin"])
    left = F.coalesce("cnt", F.lit(0)) - F.coalesce("less", F.lit(0))
    cnt = F.when(left >= 0, left).otherwise(F.raise_error(F.lit("SubtrahendCountExceedsMinuendCount")).cast("bigint"))
    cols = [cnt.cast(h.bins.schema["cnt"].dataType).alias("cnt")]
    if h.counter:
        cols.append(F.greatest(F.coalesce("n", F.lit(0)) - F.coalesce("fewer", F.lit(0)), F.lit(0)).cast(B.UNSIGNED).alias("n"))
    return p.with_bins(joined.select(*p.keys, "bin", *cols).where("cnt > 0")).named(h.keys)


def _outer(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join in which null keys are equal, by one grouped pass over the union (a bin occurs once on each side)."""
    rows = a.unionByName(b, allowMissingColumns=True)
    return rows.groupBy(*on).agg(*[F.max(c).alias(c) for c in rows.columns if c not in on])


def same(a: Histograms, b: Histograms) -> bool:
    """Whether two tables hold equal histograms; runs two jobs."""
    if (a.geometry.low, a.geometry.sigfig) != (b.geometry.low, b.geometry.sigfig):
        return False
    cols = [*a.keys, "bin", "cnt"]
    x, y = (h.bins.select(*[F.col(f"`{c}`") for c in cols if c != "cnt"], F.col("cnt").cast(B.UNSIGNED).alias("cnt")) for h in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


@with_named_keys
def packed(h: Histograms) -> DataFrame:
    """One row per key: bins as an array of (bin, cnt), in order, and the total."""
    return h.bins.groupBy(*h.keys).agg(F.array_sort(F.collect_list(F.struct("bin", "cnt"))).alias("bins"), F.sum(h.total).alias("total"))


def unpacked(df: DataFrame, geometry: Geometry, keys=(), counter: str | None = None) -> Histograms:
    keys = tuple(keys)
    rows = df.select(*renamed(keys), F.explode("bins").alias("_b")).select(*_plain(keys), "_b.bin", F.col("_b.cnt").alias("_w"))
    return Histograms(_summed(rows, _plain(keys), F.col("_w"), counter), geometry, _plain(keys), counter).named(keys)
