"""Interval logs: text files of encoded histograms over time.

Header lines give comments and optionally a start time, a base time and a divisor for the maximum; then come a legend and
one line per interval: an optional tag, start and length in seconds, the interval's maximum over the divisor, and the
encoded histogram in base64. Readers need no payload to select intervals: it stays text until it is decoded.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors

#: Fixed: the legend and the first line of the format.
LEGEND = '"StartTimestamp","Interval_Length","Interval_Max","Interval_Compressed_Histogram"'
FORMAT = "#[Histogram log format version 1.2]"
SECONDS = r"(\d+)\.(\d+)"
NUMBER = r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"
TIME = {"start": rf"^#\[StartTime: {SECONDS} ", "base": rf"^#\[BaseTime: {SECONDS} "}
INTERVAL = rf"^(?:Tag=([^,]*),)?{SECONDS},{SECONDS},({NUMBER}),(.*?)\r*$"
SCHEMA = "line_no bigint, kind string, tag string, start_sec decimal(29,9), duration_sec decimal(29,9), max double, payload string"


def three_digits(x: float | Decimal) -> str:
    """Exactly three decimals, exact halves to even."""
    return str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_EVEN))


@dataclass
class Header:
    comments: tuple[str, ...] = ()
    start_time: Decimal | None = None
    base_time: Decimal | None = None
    max_divisor: float = 1.0

    def lines(self) -> list[str]:
        out = [f"#{line}" for comment in self.comments for line in comment.split("\n")]
        if self.start_time is not None:
            out.append(f"#[StartTime: {three_digits(self.start_time)} (seconds since epoch)]")
        if self.base_time is not None:
            out.append(f"#[BaseTime: {three_digits(self.base_time)} (seconds since epoch)]")
        if self.max_divisor != 1.0:
            out.append(f"#[MaxValueDivisor: {three_digits(self.max_divisor)}]")
        return [FORMAT, *out, LEGEND]


def interval_line(start: Decimal, duration: Decimal, largest: int, payload: bytes, tag: str | None = None, max_divisor: float = 1.0) -> str:
    if tag is not None and re.search(r"[, \r\n]", tag):
        raise errors.LogError("a tag has no comma, space or line end")
    if not (max_divisor and math.isfinite(largest / max_divisor)):
        raise errors.MaxValueNotFormattable(f"{largest} over {max_divisor}")
    head = f"Tag={tag}," if tag is not None else ""
    return f"{head}{three_digits(start)},{three_digits(duration)},{three_digits(largest / max_divisor)},{base64.b64encode(payload).decode()}"


def interval_lines(df: DataFrame, max_divisor: float = 1.0) -> DataFrame:
    """(tag, start_sec, duration_sec, max, payload BINARY) to lines, with start_sec and tag to order them by."""
    @F.pandas_udf("string")
    def run(tag: pd.Series, start: pd.Series, duration: pd.Series, largest: pd.Series, payload: pd.Series) -> pd.Series:
        rows = zip(tag, start, duration, largest, payload, strict=True)
        return pd.Series([interval_line(s, d, int(m), bytes(p), t, max_divisor) for t, s, d, m, p in rows])

    seconds = lambda c: F.col(c).cast("decimal(29,9)")
    line = run("tag", seconds("start_sec"), seconds("duration_sec"), F.col("max").cast("decimal(20,0)"), "payload")
    return df.select(seconds("start_sec").alias("start_sec"), "tag", line.alias("value"))


def write_log(df: DataFrame, path: str, header: Header | None = None) -> None:
    """Write intervals as one ordered log: a single part file that starts with the header.

    Histograms are encoded where they are; only the lines move to the one task that writes them.
    """
    header = header or Header()
    spark = df.sparkSession
    lines = interval_lines(df, header.max_divisor).select("start_sec", "tag", "value", F.lit(1).alias("part"), F.lit(0).alias("at"))
    top = spark.createDataFrame([(None, None, line, 0, i) for i, line in enumerate(header.lines())], "start_sec decimal(29,9), tag string, value string, part int, at int")
    top.unionByName(lines).repartition(1).sortWithinPartitions("part", "at", "start_sec", F.col("tag").asc_nulls_first()).select("value").write.mode("overwrite").text(path)


def _seconds(line: Column, pattern: str, group: int) -> Column:
    """Whole seconds and at most nine digits of the fraction, the rest cut off."""
    whole, part = F.regexp_extract(line, pattern, group), F.regexp_extract(line, pattern, group + 1)
    return F.concat(whole, F.lit("."), F.substring(part, 1, 9)).cast("decimal(29,9)")


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines to entries: kind is start, base, interval, ignored (comments, the legend) or corrupt. Lines keep their other columns."""
    x = F.col(line)
    kind = (
        F.when(x.rlike(TIME["start"]), "start")
        .when(x.rlike(TIME["base"]), "base")
        .when(x.rlike(INTERVAL), "interval")
        .when(x.startswith("#") | x.startswith('"StartTimestamp"'), "ignored")
        .otherwise("corrupt")
    )
    part = lambda k, g: F.regexp_extract(x, INTERVAL, g)
    on = F.col("kind") == "interval"
    start = F.when(on, _seconds(x, INTERVAL, 2)).when(F.col("kind") == "start", _seconds(x, TIME["start"], 1)).when(F.col("kind") == "base", _seconds(x, TIME["base"], 1))
    return lines.withColumn("kind", kind).withColumns({
        "tag": F.when(on & x.startswith("Tag="), part("tag", 1)),
        "start_sec": start,
        "duration_sec": F.when(on, _seconds(x, INTERVAL, 4)),
        "max": F.when(on, part("max", 6).cast("double")),
        "payload": F.when(on, part("payload", 7)),
    })


def read_log(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Entries of log files, a line each, in parallel. A line that is none fails the job, or with permissive is kept as `corrupt`.

    Line numbers grow within a file, not without gaps.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"), F.col("_metadata.file_path").alias("file"))
    out = parsed(lines).where("kind <> 'ignored'")
    if not permissive:
        bad = F.raise_error(F.concat(F.lit("ParseError: "), F.substring("value", 1, 200))).cast("string")
        out = out.withColumn("kind", F.when(F.col("kind") == "corrupt", bad).otherwise(F.col("kind")))
    return out


def placed_in_time(entries: DataFrame) -> DataFrame:
    """Intervals with unix_sec, their start since the epoch, and since_start, by the start and base times that precede them.

    With a base time a start is relative to it; without one, to the epoch. A later header replaces an earlier one.
    """
    heads = entries.where("kind in ('start', 'base')").groupBy("file")
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "start_sec"))).alias("heads")).withColumnRenamed("file", "of")
    # a row for each file that has headers; the intervals stay where they are read
    out = entries.where("kind = 'interval'").join(heads, F.col("file") == F.col("of"), "left")
    before = lambda kind: F.filter("heads", lambda x: (x["kind"] == kind) & (x["line_no"] < F.col("line_no")))
    last = lambda kind: F.get(before(kind), F.size(before(kind)) - 1)["start_sec"]
    out = out.withColumn("start_time", last("start")).withColumn("base_time", last("base")).drop("heads", "of")
    unix = (F.coalesce("base_time", F.lit(0)) + F.col("start_sec")).cast("decimal(29,9)")
    return out.withColumn("unix_sec", unix).withColumn("since_start", (unix - F.coalesce("start_time", F.lit(0))).cast("decimal(29,9)"))


def entries_of(text: str) -> Iterator[tuple]:
    """Strict reading of one log as a whole: (kind, tag, start, duration, max, payload), ended by ParseError at a byte's offset.

    A last line without its line end is an error, as it may have been cut off.
    """
    offset = 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        body = line.removesuffix("\n")
        if line == body:
            raise errors.ParseError(offset)
        cut = lambda whole, part: Decimal(f"{whole}.{part[:9]}")
        if m := re.match(TIME["start"], body):
            yield "start", None, cut(*m.groups()), None, None, None
        elif m := re.match(TIME["base"], body):
            yield "base", None, cut(*m.groups()), None, None, None
        elif m := re.match(INTERVAL, body):
            tag, a, b, c, d, largest, payload = m.groups()
            yield "interval", tag, cut(a, b), cut(c, d), float(largest), payload
        elif not body.startswith(("#", '"StartTimestamp"')):
            raise errors.ParseError(offset)
        offset += len(line.encode())


def read_log_strict(spark: SparkSession, path: str) -> DataFrame:
    """Entries up to the first bad line of each file, then a row of kind `error` with the byte offset in line_no. A task a file."""
    def run(batches):
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["file"], pdf["value"], strict=True):
                n = 0
                try:
                    for entry in entries_of(text):
                        rows.append((name, n, *entry))
                        n += 1
                except errors.ParseError as bad:
                    rows.append((name, bad.offset, "error", None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["file", "line_no", "kind", "tag", "start_sec", "duration_sec", "max", "payload"])

    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return files.mapInPandas(run, f"file string, {SCHEMA}")
