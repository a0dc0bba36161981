"""Statistics of histograms: totals, extremes, moments, quantiles, shares and counts.

All work on the non-empty bins. A running count per key is one window over bins, never over samples; every rank or bound
asked for is then a conditional aggregate of the same pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins as B
from .hist import Histograms, with_named_keys


def cumulative(h: Histograms) -> DataFrame:
    """Bins with `cum` (count up to the bin) and `total` of their key."""
    running = Window.partitionBy(*h.keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*h.keys)
    kind = "decimal(20,0)" if h.counter else "bigint"
    return h.bins.select("*", F.sum("cnt").over(running).cast(kind).alias("cum"), F.sum(h.total).over(whole).cast(kind).alias("total"))


@with_named_keys
def summary(h: Histograms) -> DataFrame:
    """Per key: total, min, max, min_nz (null if all are 0), mean and population stdev of bin medians."""
    g = h.geometry
    whole = Window.partitionBy(*h.keys)
    weight = F.col("cnt").cast("decimal(20,0)")
    median = B.unsigned(B.bin_median("bin", g))
    rows = h.bins.select(*h.keys, "bin", "cnt", F.col(h.total).alias("n"), median.alias("median"))
    sums = rows.select("*", F.sum(F.col("median") * weight).over(whole).cast("double").alias("first"), F.sum("n").over(whole).cast("double").alias("size"))
    mean = F.col("first") / F.col("size")
    out = sums.groupBy(*h.keys).agg(
        F.sum("n").alias("total"), F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.min(F.when(F.col("bin") > 0, F.col("bin"))).alias("nz"),
        F.first(mean).alias("mean"), F.sqrt(F.sum((F.col("median").cast("double") - mean) ** 2 * F.col("cnt").cast("double")) / F.first("size")).alias("stdev"),
    )
    return out.select(
        *h.keys, "total", F.when(F.col("lo") == 0, F.lit(0).cast("bigint")).otherwise(B.bin_low("lo", g)).alias("min"), B.bin_high("hi", g).alias("max"),
        F.when(F.col("nz").isNotNull(), B.bin_low("nz", g)).alias("min_nz"), "mean", "stdev",
    )


def _rank(q: float, total: Column) -> Column:
    """Which of the counts in order a quantile stands for; below 0 and not a number like 0, above 1 like 1."""
    if math.isnan(q) or q <= 0:
        return F.lit(1).cast("bigint")
    return F.greatest(F.ceil(F.lit(float(min(q, 1.0))) * total.cast("double")), F.lit(1)).cast("bigint")


@with_named_keys
def value_at_quantiles(h: Histograms, quantiles: list[float], strict: bool = False) -> DataFrame:
    """Per key and quantile (a row each): the value that so large a share of the samples doesn't exceed.

    The largest value of the bin that has the rank, at 0 the smallest of the first bin. Ranks beyond what capped counters
    hold take the last bin. strict stops at the first quantile that is less than its predecessor.
    """
    asked = list(quantiles)
    if strict:
        for i in range(1, len(asked)):
            if asked[i] < asked[i - 1]:
                asked = asked[:i]
                break
    if not asked:
        raise ValueError("no quantiles")
    c = cumulative(h)
    at = [F.coalesce(F.min(F.when(F.col("cum") >= _rank(q, F.col("total")), F.col("bin"))), F.max("bin")).alias(f"q{i}") for i, q in enumerate(asked)]
    wide = c.groupBy(*h.keys).agg(*at)
    value = lambda i, q: B.bin_low(f"q{i}", h.geometry) if q == 0 else B.bin_high(f"q{i}", h.geometry)
    rows = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), value(i, q).alias("value")) for i, q in enumerate(asked)])
    return wide.select(*h.keys, F.explode(rows).alias("r")).select(*h.keys, "r.quantile", "r.value")


def value_at_quantile(h: Histograms, quantile: float) -> DataFrame:
    return value_at_quantiles(h, [quantile])


def value_at_percentiles(h: Histograms, percentiles: list[float], strict: bool = False) -> DataFrame:
    out = value_at_quantiles(h, [p / 100 for p in percentiles], strict)
    return out.select(*h.keys, (F.col("quantile") * 100).alias("percentile"), "value")


@with_named_keys
def shares_below(h: Histograms, values: list[int]) -> DataFrame:
    """Per key and value: quantile_below, the share of samples in bins up to the value's."""
    g = h.geometry
    sums = [F.sum(F.when(F.col("bin") <= g.index_or_last(v), F.col("cnt"))).alias(f"s{i}") for i, v in enumerate(values)]
    wide = h.bins.groupBy(*h.keys).agg(F.sum(h.total).alias("total"), *sums)
    rows = F.array(*[F.struct(B.signed(v).alias("value"), (F.coalesce(f"s{i}", F.lit(0)).cast("double") / F.col("total").cast("double")).alias("quantile_below")) for i, v in enumerate(values)])
    out = wide.select(*h.keys, F.explode(rows).alias("r")).select(*h.keys, "r.value", "r.quantile_below")
    return out.withColumn("percentile_below", F.col("quantile_below") * 100)


@with_named_keys
def counts_between(h: Histograms, ranges: list[tuple[int, int]]) -> DataFrame:
    """Per key and range: samples in the bins from low's to high's, 0 if low is above high. Only those bins are read."""
    g = h.geometry
    at = [(g.index_or_last(a), g.index_or_last(b)) for a, b in ranges]
    sums = [F.coalesce(F.sum(F.when(F.col("bin").between(a, b), F.col("cnt"))), F.lit(0)).alias(f"s{i}") for i, (a, b) in enumerate(at)]
    wide = h.bins.groupBy(*h.keys).agg(*sums)
    rows = F.array(*[F.struct(B.signed(a).alias("low"), B.signed(b).alias("high"), F.col(f"s{i}").alias("count")) for i, (a, b) in enumerate(ranges)])
    return wide.select(*h.keys, F.explode(rows).alias("r")).select(*h.keys, "r.low", "r.high", "r.count")


def counts_at(h: Histograms, values: list[int]) -> DataFrame:
    out = counts_between(h, [(v, v) for v in values])
    return out.select(*h.keys, F.col("low").alias("value"), "count")
