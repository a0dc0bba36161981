"""The percentile report: a line per quantile tick and a footer, as text; and a small command line.

python -m binloom.report serialize --sigfig 3 [--low N --high N --resize --compress] SOURCE TARGET
python -m binloom.report quantiles [--ticks 5 --precision 20] SOURCE
"""

from __future__ import annotations

import argparse
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bins as B
from .geometry import Geometry
from .operators.hist import Histograms, record, with_named_keys
from .operators.iterate import quantile_steps
from .operators.stats import summary


def _lines(precision: int):
    """Lines of ticks. Numbers are written from their exact values, exact halves to even."""

    @F.pandas_udf("string")
    def run(value: pd.Series, quantile: pd.Series, iterated: pd.Series, count: pd.Series) -> pd.Series:
        def line(v: int, q: float, t: float, n: int) -> str:
            left = f"{1 / (1 - t):14.2f}" if t < 1 else f"{'∞':>14}"
            return f"{v:12d} {q:1.{precision}f} {t:1.{precision}f} {n:10d} {left}"

        return pd.Series([line(int(v), float(q), float(t), int(n)) for v, q, t, n in zip(value, quantile, iterated, count, strict=True)])

    return run


@F.pandas_udf("string")
def _moments(mean: pd.Series, stdev: pd.Series) -> pd.Series:
    return pd.Series([f"#[Mean       = {m:12.2f}, StdDeviation   = {s:12.2f}]" for m, s in zip(mean, stdev, strict=True)])


@with_named_keys
def quantile_lines(h: Histograms, ticks: int = 5, precision: int = 20) -> DataFrame:
    """(keys, line_no, line): header, ticks, footer."""
    width = precision + 2
    by = Window.partitionBy(*h.keys).orderBy("quantile_iterated_to", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = quantile_steps(h, ticks).withColumn("cum", F.sum("count_since_last").over(by)).withColumn("line_no", F.row_number().over(by))
    line = _lines(precision)(B.unsigned("value"), "quantile", "quantile_iterated_to", F.col("cum").cast("decimal(20,0)"))
    body = rows.select(*h.keys, "line_no", line.alias("line"))
    s = summary(h)
    head = f"{'Value':>12} {'QuantileValue':>{width}} {'QuantileIteration':>{width}} {'TotalCount':>10} {'1/(1-Quantile)':>14}"
    g = h.geometry
    foot = [
        F.format_string("#[Max        = %12d, Total count    = %12d]", "max", F.col("total").cast("bigint")),
        F.format_string("#[Buckets    = %12d, SubBuckets     = %12d]", F.lit(g.buckets), F.lit(g.bins)),
    ]
    frame = F.array(F.struct(F.lit(-1).alias("n"), F.lit(head).alias("t")), F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), F.struct(F.lit(2**30).alias("n"), F.col("moments").alias("t")), *[F.struct(F.lit(2**30 + i).alias("n"), t.alias("t")) for i, t in enumerate(foot, 1)])
    rest = s.withColumn("moments", _moments("mean", "stdev")).select(*h.keys, F.explode(frame).alias("r")).select(*h.keys, F.col("r.n").alias("line_no"), F.col("r.t").alias("line"))
    return body.unionByName(rest)


def main(argv: list[str]) -> None:
    from .sources.codec import decode, encoded
    from .sources.numbers import read_numbers

    parser = argparse.ArgumentParser(prog="binloom.report")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("serialize")
    one.add_argument("--low", type=int, default=1)
    one.add_argument("--high", type=int, default=2**63 - 1)
    one.add_argument("--sigfig", type=int, default=3)
    one.add_argument("--resize", action="store_true")
    one.add_argument("--compress", action="store_true")
    one.add_argument("source")
    one.add_argument("target")
    two = commands.add_parser("quantiles")
    two.add_argument("--ticks", type=int, default=5)
    two.add_argument("--precision", type=int, default=20)
    two.add_argument("source")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "serialize":
        g = Geometry(a.low, a.high, a.sigfig, a.resize)
        row = encoded(record(read_numbers(spark, a.source), "value", g), a.compress).first()
        from .sources.codec import encode

        with open(a.target, "wb") as out:
            out.write(bytes(row["payload"]) if row else encode([], g, a.compress))
        return
    with open(a.source, "rb") as data:
        g, bins = decode(data.read())
    h = Histograms(spark.createDataFrame(bins, "bin int, cnt bigint"), g)
    for row in quantile_lines(h, a.ticks, a.precision).orderBy("line_no").collect():
        print(row["line"])


if __name__ == "__main__":
    main(sys.argv[1:])
