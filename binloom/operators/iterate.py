"""Walks through histograms as tables: recorded bins, all bins, linear and logarithmic steps, quantile ticks.

Each row has value (the end of the step), quantile (share of samples up to there), quantile_iterated_to, count_at_value
(of the step's last bin) and count_since_last. An empty histogram without keys has the rows of its first steps, with quantiles
that are not a number; recorded and quantile steps have none. (Keys without bins aren't in the table.) Steps and ticks are laid next to the bins in one window per key; no bin is
joined with all steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins as B
from ..geometry import U64
from .hist import Histograms, with_named_keys
from .stats import cumulative

#: Levels of a logarithmic walk that are made at once.
LEVELS = 10_000
COLUMNS = ("value", "quantile", "quantile_iterated_to", "count_at_value", "count_since_last")


def _rows(df: DataFrame, keys: tuple, value: Column, at: Column, since: Column, iterated: Column | None = None) -> DataFrame:
    q = F.when(F.col("total") == 0, F.lit(math.nan)).otherwise(F.col("cum").cast("double") / F.nullif("total", F.lit(0)).cast("double"))
    return df.select(
        *keys, value.alias("value"), q.alias("quantile"), (q if iterated is None else iterated).alias("quantile_iterated_to"),
        at.alias("count_at_value"), since.alias("count_since_last"),
    )


def _present(h: Histograms) -> Histograms:
    """The one histogram of a table without keys with an empty first bin if it has no bins; others as they are."""
    if h.keys:
        return h
    kind = h.bins.schema
    none = F.array(F.struct(F.lit(0).cast("int").alias("bin"), *[F.lit(0).cast(kind[c].dataType).alias(c) for c in h.counts]))
    all_ = h.bins.agg(F.collect_list(F.struct("bin", *h.counts)).alias("bins"))
    return h.with_bins(all_.select(F.explode(F.when(F.size("bins") == 0, none).otherwise(F.col("bins"))).alias("b")).select("b.bin", *[F.col(f"b.{c}") for c in h.counts]))


@with_named_keys
def recorded(h: Histograms) -> DataFrame:
    """One row per non-empty bin."""
    return _rows(cumulative(h), h.keys, B.bin_high("bin", h.geometry), F.col("cnt"), F.col("cnt"))


@with_named_keys
def every_bin(h: Histograms) -> DataFrame:
    """One row per bin, empty ones included, to the last bin of the geometry (of an automatic one, to the bucket of the largest value)."""
    g, h = h.geometry, _present(h)
    by = Window.partitionBy(*h.keys).orderBy("bin")
    whole = Window.partitionBy(*h.keys)
    c = cumulative(h).withColumn("next", F.lead("bin").over(by)).withColumn("before", F.lag("cum").over(by))
    if g.auto_resize:  # bins are added by whole buckets
        bucket = F.floor(F.max("bin").over(whole) / g.half)
        end = (F.greatest(bucket, F.lit(1)).cast("int") + 1) * g.half
    else:
        end = F.lit(g.bins)
    c = c.withColumn("end", end)
    first = F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.col("bin"))
    c = c.select("*", F.explode(F.sequence(first, F.coalesce("next", "end") - 1)).alias("i"))
    at = F.when(F.col("i") == F.col("bin"), F.col("cnt")).otherwise(F.lit(0))
    c = c.withColumn("cum", F.when(F.col("i") < F.col("bin"), F.lit(0)).otherwise(F.col("cum")))
    return _rows(c, h.keys, B.bin_high("i", g), at, at)


def _at_levels(h: Histograms, levels: DataFrame) -> DataFrame:
    """Levels (keys, _k, _level, _at: a bin) with the counts up to their bins, by one window over bins and levels together."""
    kind = h.bins.schema["cnt"].dataType
    c = cumulative(h).select(*h.keys, F.col("bin").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_k"), F.lit(None).cast("bigint").alias("_level"), "cnt", "cum", "total", F.col("bin").alias("_own"))
    empty = [F.lit(None).cast(c.schema[x].dataType).alias(x) for x in ("cnt", "cum", "total", "_own")]
    both = c.unionByName(levels.select(*h.keys, "_at", F.lit(1).alias("_kind"), "_k", "_level", *empty))
    # a key that is null is a key: windows take nulls as equal
    by = Window.partitionBy(*h.keys).orderBy("_at", "_kind", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda x: F.last(x, ignorenulls=True).over(by)
    whole = Window.partitionBy(*h.keys)
    both = both.select(*h.keys, "_kind", "_k", "_level", "_at", last("_own").alias("_own"), last("cnt").alias("_found"), last("cum").alias("cum"), F.max("total").over(whole).alias("total"))
    rows = both.where("_kind = 1").withColumn("cum", F.coalesce("cum", F.lit(0)).cast(kind))
    steps = Window.partitionBy(*h.keys).orderBy("_k")
    rows = rows.withColumn("_since", F.col("cum") - F.coalesce(F.lag("cum").over(steps), F.lit(0)))
    at = F.when(F.col("_own") == F.col("_at"), F.col("_found")).otherwise(F.lit(0))
    return _rows(rows, h.keys, F.col("_level"), at, F.col("_since"))


def _ends(h: Histograms) -> DataFrame:
    return h.bins.groupBy(*h.keys).agg(F.max("bin").alias("_top"))


@with_named_keys
def linear(h: Histograms, step: int) -> DataFrame:
    """Steps of one width: values step - 1, 2 step - 1, ... until the last sample's bin is passed."""
    if step <= 0:
        raise ValueError("step must be above 0")
    g, h = h.geometry, _present(h)
    after = lambda i: B.bin_low(i, g)
    ends = _ends(h)
    # the first step that ends at or beyond the smallest value of the last bin, and the last one within its end's bin
    ends = ends.withColumn("_low", after("_top")).withColumn("_first", F.greatest(F.lit(1).cast("bigint"), F.expr(f"(_low + {step}) div {step}")))
    ends = ends.withColumn("_end", F.least(B.bin_index(F.col("_first") * step - 1, g), F.lit(g.last)))
    beyond = after(F.col("_end") + 1)
    ends = ends.withColumn("_beyond", beyond).withColumn("_k", F.greatest(F.col("_first"), F.expr(f"_beyond div {step}")))
    levels = ends.select(*h.keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_k"))).alias("_k"))
    levels = levels.withColumn("_level", F.col("_k") * step - 1).withColumn("_at", F.least(B.bin_index("_level", g), F.lit(g.last)))
    return _at_levels(h, levels)


def logarithmic_levels(start: int, base: float) -> Iterator[np.ndarray]:
    """start - 1, then each start * base^k (multiplied up one by one), cut to a whole number, less 1, as unsigned numbers, in parts."""
    reach = float(start)
    yield np.array([start - 1], np.uint64)
    factors = np.full(LEVELS + 1, base)
    while True:
        factors[0] = reach
        with np.errstate(over="ignore"):
            reached = np.multiply.accumulate(factors)[1:]
        reach = reached[-1]
        low = reached < 2.0**64
        out = np.full(len(reached), U64 - 1, np.uint64)
        out[low] = reached[low].astype(np.uint64) - np.uint64(1)
        yield out


def _levels_up_to(start: int, base: float):
    """Rows (keys, _until: unsigned) with the levels of each up to the first that reaches it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.columns[:-1]
            until = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                k = 0
                for levels in logarithmic_levels(start, base):
                    n = int(np.searchsorted(levels, until[i], "left")) + 1
                    part = levels[:n]
                    one = [c.take(pa.array(np.full(len(part), i))) for c in keys]
                    yield pa.RecordBatch.from_arrays([*one, pa.array(np.arange(k, k + len(part))), pa.array(part.view(np.int64))], [*batch.schema.names[:-1], "_k", "_level"])
                    k += len(part)
                    if n <= len(levels):
                        break

    return run


@with_named_keys
def logarithmic(h: Histograms, start: int, base: float) -> DataFrame:
    """Steps that grow by a factor, until the last sample's bin is reached.

    Levels are made where the keys are, each key's up to its own last bin.
    """
    if start <= 0 or base <= 1.0:
        raise ValueError("start must be above 0, base above 1")
    g, h = h.geometry, _present(h)
    ends = _ends(h).select(*h.keys, B.bin_low("_top", g).alias("_until"))
    kinds = "".join(f"`{k}` {h.bins.schema[k].dataType.simpleString()}, " for k in h.keys)
    levels = ends.mapInArrow(_levels_up_to(start, base), f"{kinds}_k bigint, _level bigint")
    return _at_levels(h, levels.withColumn("_at", F.least(B.bin_index("_level", g), F.lit(g.last))))


def quantile_ticks(ticks_per_half: int) -> list[float]:
    """Quantiles from 0 to 1, so many for each half of what remains to 1."""
    q, out = 0.0, [0.0]
    while q < 1.0:
        halvings = int(math.log2(1.0 / (1.0 - q))) + 1
        after = q + 1.0 / (ticks_per_half * 2.0**halvings)
        q = 1.0 if after == q else min(after, 1.0)
        out.append(q)
    return out


@with_named_keys
def quantile_steps(h: Histograms, ticks_per_half: int) -> DataFrame:
    """For each tick the bin that reaches it, up to the first that needs the last bin, then 1.0."""
    if ticks_per_half <= 0:
        raise ValueError("ticks must be above 0")
    g, ticks = h.geometry, quantile_ticks(ticks_per_half)
    by = Window.partitionBy(*h.keys).orderBy("bin")
    c = cumulative(h).withColumn("q", F.col("cum").cast("double") / F.col("total").cast("double"))
    c = c.withColumn("before", F.lag("q", 1, -1.0).over(by)).withColumn("is_last", F.lead("bin").over(by).isNull())
    here = F.filter(F.array(*[F.lit(t) for t in ticks]), lambda t: (t > F.col("before")) & (t <= F.col("q")))
    first = F.slice(here, 1, 1)
    # the last bin ends the walk: its first tick, and 1.0
    end = F.when(F.element_at(first, 1) == 1.0, first).otherwise(F.concat(first, F.array(F.lit(1.0))))
    c = c.withColumn("hit", F.when(F.col("is_last"), end).otherwise(here)).where(F.size("hit") > 0)
    c = c.select("*", F.explode("hit").alias("tick"))
    since = F.col("cum") - F.coalesce(F.lag("cum").over(Window.partitionBy(*h.keys).orderBy("tick", "bin")), F.lit(0))
    c = c.withColumn("since", since)
    return _rows(c, h.keys, B.bin_high("bin", g), F.col("cnt"), F.col("since"), F.col("tick"))
