"""Histograms over streams: what writers record, counted per time window and key, and snapshots of each window as log intervals.

A writer's call is a row: its weight, whether it saturates, its expected interval and whether it takes samples away are
columns and arguments of the query that counts. What writers have sent is in the result once the batch that read it is
done; refresh waits for that, for as long as one likes.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions import bins as B
from ..functions.names import fresh
from ..geometry import Geometry
from ..operators.hist import Histograms, record, record_correct
from ..operators.stats import summary
from ..sources.codec import encoded
from ..sources.interval_log import Header, write_log


def written(
    df: DataFrame, value: str | Column, geometry: Geometry, keys=(), weight: str | Column | None = None, saturate: bool = False,
    counter: str | None = None, interval: int = 0, minus: Column | None = None,
) -> Histograms:
    """The histogram that writers make of rows, of a table or a stream: one grouped sum.

    interval > 0 adds the samples that a stalled writer left out. minus tells the rows whose samples are taken away; a bin
    that would hold less than nothing fails the job (such rows can't be counted by capped counters).
    """
    if minus is None:
        return record_correct(df, value, geometry, interval, keys, weight, counter) if interval > 0 else record(df, value, geometry, keys, weight, saturate, counter)
    if counter:
        raise ValueError("capped counters can't take samples away")
    (away,) = fresh([*df.columns, *keys], "away")
    rows = df.withColumn(away, F.coalesce(minus, F.lit(False)))
    both = written(rows, value, geometry, (*keys, away), weight, saturate, None, interval)
    left = F.sum(F.when(F.col(away), -F.col("cnt")).otherwise(F.col("cnt")))
    if df.isStreaming:  # a stream has one grouped sum: the signed rows are summed as they are
        w = F.lit(1).cast("bigint") if weight is None else B._col(weight).cast("bigint")
        if interval > 0:
            raise ValueError("a stream that takes samples away has no expected interval")
        at = B.bin_index(B.clamped(value, geometry), geometry) if saturate else B.checked_bin_index(value, geometry)
        signed = rows.select(*[F.col(f"`{k}`") for k in keys], at.alias("bin"), F.when(F.col(away), -w).otherwise(w).alias("cnt")).where("bin is not null and cnt <> 0")
        bins = signed.groupBy(*keys, "bin").agg(F.sum("cnt").alias("cnt"))
    else:
        bins = both.bins.groupBy(*[F.col(f"`{k}`") for k in keys], "bin").agg(left.alias("cnt"))
    checked = F.when(F.col("cnt") >= 0, F.col("cnt")).otherwise(F.raise_error(F.lit("SubtrahendCountExceedsMinuendCount")).cast("bigint"))
    return Histograms(bins.withColumn("cnt", checked).where("cnt <> 0"), geometry, tuple(keys))


def windowed(
    df: DataFrame, value: str | Column, geometry: Geometry, ts: str, width: str | None, keys=(), slide: str | None = None, late: str | None = None,
    gap: str | None = None, **how,
) -> Histograms:
    """Histograms per window of event time and key, for tables and streams alike; how: the other arguments of record, or interval.

    Windows are of one width, overlapping with a slide, or with gap instead of a width sessions that end when nothing comes
    for so long. The keys of the result are `start` and `end` of the window, then keys. late is the watermark of a stream;
    state is one counter per open window, key and non-empty bin.
    """
    rows = df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] != "timestamp" else df
    if late is not None:
        rows = rows.withWatermark(ts, late)
    (w,) = fresh([*df.columns, *keys], "window")
    if gap:
        # a session is of a key, whatever the bins; its rows meet in one grouped sum over session, keys and bin only if bins don't split it
        if df.isStreaming:
            raise ValueError("sessions are cut on tables; streams have windows of a width")
        of = rows.where(F.col(ts).isNotNull() & B._col(value).isNotNull()).groupBy(F.session_window(ts, gap).alias(w), *[F.col(f"`{k}`") for k in keys]).agg(F.lit(1))
        plain = fresh(rows.columns, *[f"of{i}" for i in range(len(keys))])
        of = of.select(w, *[F.col(f"`{k}`").alias(p) for k, p in zip(keys, plain, strict=True)])
        meets = (F.col(ts) >= F.col(f"{w}.start")) & (F.col(ts) < F.col(f"{w}.end"))
        for k, p in zip(keys, plain, strict=True):
            meets = meets & F.col(f"`{k}`").eqNullSafe(F.col(p))
        rows = rows.join(of, meets)
    else:
        rows = rows.withColumn(w, F.window(ts, width, slide) if slide else F.window(ts, width))
    h = written(rows, value, geometry, (w, *keys), **how)
    start, end = F.col(f"{w}.start").alias("start"), F.col(f"{w}.end").alias("end")
    return Histograms(h.bins.select(start, end, *[F.col(f"`{k}`") for k in keys], "bin", *h.counts), geometry, ("start", "end", *keys), h.counter)


def merged_stream(df: DataFrame, value: str | Column, geometry: Geometry, keys=(), **how) -> Histograms:
    """The running histogram of all writers' samples; what a query of the sink sees is what finished batches delivered."""
    return written(df, value, geometry, keys, **how)


def refresh(query: StreamingQuery, seconds: float | None = None) -> bool:
    """Wait until the sink has all that writers had sent when this was called; with seconds, no longer than that.

    Whether the sink has it all. What a batch has delivered stays delivered; the query goes on.
    """
    failed: list[Exception] = []

    def wait() -> None:
        try:
            query.processAllAvailable()
        except Exception as bad:
            failed.append(bad)

    waiter = threading.Thread(target=wait, daemon=True)
    waiter.start()
    waiter.join(seconds)
    if failed:
        raise failed[0]
    return not waiter.is_alive()


def intervals(h: Histograms, tag: str | None = None, compress: bool = True) -> DataFrame:
    """Windowed histograms as log intervals (tag, start_sec, duration_sec, max, payload)."""
    label = F.col(tag).cast("string") if tag else F.lit(None).cast("string")
    both = encoded(h, compress).join(summary(h).select(*h.keys, "max"), list(h.keys))
    seconds = F.unix_micros("start").cast("decimal(29,9)") / 1_000_000
    length = (F.unix_micros("end") - F.unix_micros("start")).cast("decimal(29,9)") / 1_000_000
    return both.select(label.alias("tag"), seconds.cast("decimal(29,9)").alias("start_sec"), length.cast("decimal(29,9)").alias("duration_sec"), "max", "payload")


def log_sink(h: Histograms, folder: str, checkpoint: str, tag: str | None = None, header: Header | None = None) -> DataStreamWriter:
    """A writer that puts the windows that each batch closes into a log of the batch's own, written whole or not at all."""

    def snapshot(batch: DataFrame, number: int) -> None:
        write_log(intervals(h.with_bins(batch), tag), f"{folder}/batch={number}", header)

    return h.bins.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(snapshot)
