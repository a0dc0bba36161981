"""Query catalogue over the driver tables: each key pairs a Spark plan with the SQL that checks it.

Prices and values become whole cents first. The geometry is 1 upwards, three digits, unless a query says otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions import sql
from ..geometry import Geometry
from ..operators import hist as H
from ..operators import iterate as I
from ..operators import stats as S
from ..sources import codec, interval_log, numbers
from ..streaming import windows

G = Geometry(1, 2**62, 3)
SMALL = Geometry(1, 5_000_000, 2)
QS = [0.0, 0.5, 0.9, 0.99, 0.999, 1.0]
PS = [0.0, 25.0, 50.0, 75.0, 99.0, 100.0]
INTERVAL = 100


def cents(c: str):
    return F.floor(F.col(c) * 100 + 0.5).cast("bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, geometry: Geometry = G, **how) -> H.Histograms:
    rows = table(spark, sf_dir, "events").select("event_type", cents("value").alias("v"))
    return H.record(rows, "v", geometry, ["event_type"], **how)


def orders(spark: SparkSession, sf_dir: str, geometry: Geometry = G, **how) -> H.Histograms:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", cents("o_totalprice").alias("v"))
    return H.record(rows, "v", geometry, ["o_orderpriority"], **how)


def lineitem(spark: SparkSession, sf_dir: str, *keys, weighted: bool = False, geometry: Geometry = G, **how) -> H.Histograms:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", cents("l_extendedprice").alias("v"), F.col("l_quantity").cast("bigint").alias("w"))
    return H.record(rows, "v", geometry, keys, weight="w" if weighted else None, **how)


def part_sizes(spark: SparkSession, sf_dir: str) -> H.Histograms:
    return H.record(table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("v")), "v", Geometry(1, 64, 1))


# -- SQL pieces --

U = {3: (2047, 11, 1024), 2: (255, 8, 128), 1: (31, 5, 16)}
CENTS = "cast(floor({} * 100 + 0.5) as bigint)"
EV = f"select event_type, {CENTS.format('value')} as v from events"
OR = f"select o_orderpriority, {CENTS.format('o_totalprice')} as v from orders"
LI = f"select l_returnflag, l_linestatus, {CENTS.format('l_extendedprice')} as v, cast(l_quantity as bigint) as w from lineitem"


def bin_sql(v: str, sigfig: int = 3) -> str:
    mask, bits, half = U[sigfig]
    b = f"(length(bin(({v}) | {mask})) - {bits})"
    return f"cast(({b} + 1) * {half} + (({v}) >> {b}) - {half} as integer)"


def low_sql(i: str, sigfig: int = 3) -> str:
    half = U[sigfig][2]
    return f"(case when ({i}) < {half} then cast({i} as bigint) else cast(({i}) % {half} + {half} as bigint) << cast(({i}) // {half} - 1 as integer) end)"


def high_sql(i: str, sigfig: int = 3) -> str:
    half = U[sigfig][2]
    return f"({low_sql(i, sigfig)} + (case when ({i}) < {half} then 1 else cast(1 as bigint) << cast(({i}) // {half} - 1 as integer) end) - 1)"


def median_sql(i: str, sigfig: int = 3) -> str:
    half = U[sigfig][2]
    return f"({low_sql(i, sigfig)} + (case when ({i}) < {2 * half} then 0 else cast(1 as bigint) << cast(({i}) // {half} - 2 as integer) end))"


def bins_sql(rows: str, key: str, weight: str = "1", sigfig: int = 3) -> str:
    """Common table expression b of bins."""
    k = f"{key}, " if key else ""
    return f"b as (select {k}{bin_sql('v', sigfig)} as bin, cast(sum({weight}) as bigint) as cnt from ({rows}) group by {k}2)" if key else f"b as (select {bin_sql('v', sigfig)} as bin, cast(sum({weight}) as bigint) as cnt from ({rows}) group by 1)"


def cum_sql(key: str) -> str:
    part = f"partition by {key}" if key else ""
    return f"c as (select *, cast(sum(cnt) over ({part} order by bin) as bigint) as cum, cast(sum(cnt) over ({part}) as bigint) as total from b)"


def quantiles_sql(rows: str, key: str, asked: list[float], column: str, scale: float = 1.0, weight: str = "1") -> str:
    values = ", ".join(f"(cast({q!r} as double), cast({q / scale!r} as double))" for q in asked)
    return f"""with {bins_sql(rows, key, weight)}, {cum_sql(key)}, q(a, q) as (values {values}),
    f as (select {key}, a, q, min(bin) as bin from c, q where cum >= greatest(1, ceil(q * cast(total as double))) group by 1, 2, 3)
    select {key}, a as {column}, case when q = 0 then {low_sql('bin')} else {high_sql('bin')} end as value from f"""


def steps_sql(rows: str, key: str, levels: str) -> str:
    """Levels (key, k, level, pos) to iteration rows."""
    return f"""with {bins_sql(rows, key)}, {cum_sql(key)}, m as (select {key}, max(bin) as top from b group by 1), lv as ({levels}),
    j as (select lv.{key}, k, level, max(total) as total, cast(coalesce(sum(cnt) filter (where bin <= pos), 0) as bigint) as cum, cast(coalesce(sum(cnt) filter (where bin = pos), 0) as bigint) as here
      from lv join c on c.{key} = lv.{key} group by 1, 2, 3)
    select {key}, level as value, cast(cum as double) / cast(total as double) as quantile, cast(cum as double) / cast(total as double) as quantile_iterated_to,
      here as count_at_value, cast(cum - coalesce(lag(cum) over (partition by {key} order by k), 0) as bigint) as count_since_last from j"""


def omission_sql(rows: str, key: str) -> str:
    i = INTERVAL
    return f"select {key}, unnest(case when v > {i} then generate_series({i} + v % {i}, v, {i}) else [v] end) as v from ({rows})"


def encoded_bins(h: H.Histograms, compress: bool) -> H.Histograms:
    return codec.decoded_histograms(codec.encoded(h, compress), h.geometry, keys=h.keys)


def ilog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode as log lines, parse them, decode the payloads: the bins of each event type come back."""
    h = events(spark, sf_dir)
    both = codec.encoded(h, True).join(S.summary(h).select("event_type", "max"), "event_type")
    lines = interval_log.interval_lines(both.select(F.col("event_type").alias("tag"), F.lit(1).alias("start_sec"), F.lit(1).alias("duration_sec"), "max", "payload"))
    entries = interval_log.parsed(lines.select("value")).where("kind = 'interval'").select(F.col("tag").alias("event_type"), F.unbase64("payload").alias("payload"))
    return codec.decoded_histograms(entries, h.geometry, keys=["event_type"]).bins


def interval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("ts", cents("value").alias("v"))
    h = windows.windowed(rows, "v", G, "ts", "1 day")
    out = S.value_at_quantiles(h, [0.99]).join(S.summary(h).select("start", "end", "total"), ["start", "end"])
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "total", F.col("value").alias("p99"))


def equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(cents("value").alias("v")).distinct()
    return v.select(
        "v", B.bin_index("v", G).alias("bin"), B.lowest_equivalent("v", G).alias("lowest"), B.highest_equivalent("v", G).alias("highest"), B.median_equivalent("v", G).alias("median"),
        B.next_non_equivalent("v", G).alias("next"), B.equivalent_range("v", G).alias("width"), B.equivalent("v", F.col("v") + 1, G).alias("same_as_next"),
    )


def split(spark: SparkSession, sf_dir: str, geometry: Geometry = G) -> tuple[H.Histograms, H.Histograms]:
    """Line items returned and those not, keyed by line status."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", cents("l_extendedprice").alias("v"))
    of = lambda keep, g: H.record(rows.where(keep), "v", g, ["l_linestatus"])
    return of("l_returnflag = 'R'", G), of("l_returnflag <> 'R'", geometry)


def subtract_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = lineitem(spark, sf_dir, "l_linestatus")
    return H.subtract(both, split(spark, sf_dir)[0]).bins


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..report import quantile_lines

    return quantile_lines(events(spark, sf_dir), 2, 6)


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lineitem(spark, sf_dir, "l_returnflag", weighted=True, geometry=SMALL, saturate=True, counter="u8")
    return h.bins.select("l_returnflag", "bin", F.col("cnt").cast("bigint").alias("cnt"), F.col("n").cast("bigint").alias("n"))


def restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that a decoded histogram has."""
    return S.summary(encoded_bins(orders(spark, sf_dir), False)).select("o_orderpriority", "total", "min", "max", "min_nz")


def summary_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(orders(spark, sf_dir))


def corrected_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", cents("l_extendedprice").alias("v"), F.col("l_quantity").cast("bigint").alias("w"))
    return H.record_correct(rows, "v", G, 1_000_000, ["l_returnflag"], weight="w").bins


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What automatic geometries of two digits grow to, as their encoded form tells."""
    h = orders(spark, sf_dir, Geometry.auto(2))
    d = codec.encoded(h).select("o_orderpriority", codec.decoded("payload").alias("d"))
    return d.select("o_orderpriority", "d.sigfig", F.col("d.low").cast("bigint").alias("low"), F.col("d.high").cast("bigint").alias("high"), F.col("d.total").cast("bigint").alias("total"))


def in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(cents("value").alias("v")).distinct()
    return v.select("v", B.in_range("v", Geometry(1, 5000, 2)).alias("held"), B.clamped("v", Geometry(1, 5000, 2)).alias("clamped"))


def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as lines of text, every third with white space around it, and a blank line after every order."""
    v = cents("o_totalprice").cast("string")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), v, F.lit(" "))).otherwise(v)
    lines = table(spark, sf_dir, "orders").select(F.explode(F.array(line, F.lit(" "))).alias("value"))
    return H.record(numbers.numbers_in(lines), "value", G).bins


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and interval lines of a log with a row for each nation, its name the payload."""
    rows = table(spark, sf_dir, "nation").select(
        F.when(F.col("n_regionkey") > 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("tag"), (F.col("n_nationkey") + 0.125).alias("start_sec"), F.lit(1.5).alias("duration_sec"),
        (F.col("n_nationkey") * 1001).alias("max"), F.encode("n_name", "UTF-8").alias("payload"),
    )
    header = interval_log.Header(("one\ntwo",), Decimal("12.5"), Decimal("7.25"), 8.0)
    top = spark.createDataFrame([(line,) for line in header.lines()], "value string")
    return top.union(interval_log.interval_lines(rows, header.max_divisor).select("value"))


def log_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file a region, with start times, base times in some, later ones that replace them, comments and intervals of several forms."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    text = lambda c: c.cast("string")
    lines = F.array(
        F.concat(F.lit("#[StartTime: "), text(r), F.lit(".500 (seconds since epoch), Mon]")),
        F.when(r % 2 == 0, F.concat(F.lit("#[BaseTime: "), text(n * 10), F.lit(".2500000009 (seconds since epoch)]"))).otherwise(F.lit("# a comment")),
        F.concat(F.when(n % 2 == 0, F.concat(F.lit("Tag=n"), text(n), F.lit(","))).otherwise(F.lit("")), text(n), F.lit(".1278901234567,1.0,"), F.when(n % 3 == 0, F.lit("1e3")).otherwise(F.lit("+2.")), F.lit(",AA\r")),
        F.lit('"StartTimestamp","Interval_Length"'),
    )
    rows = table(spark, sf_dir, "nation").select(text(r).alias("file"), n.alias("n"), F.posexplode(lines).alias("k", "value"))
    entries = interval_log.parsed(rows.select("file", "value", (F.col("n") * 10 + F.col("k")).cast("bigint").alias("line_no"))).where("kind <> 'ignored'")
    placed = interval_log.placed_in_time(entries)
    seconds = lambda c: (F.col(c) * 1_000_000_000).cast("bigint")
    return placed.select("line_no", "tag", seconds("start_sec").alias("start_ns"), "max", "payload", seconds("unix_sec").alias("unix_ns"), seconds("since_start").alias("since_ns"))


def empty_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of a histogram without samples: rows of their first steps, with quantiles that are not a number."""
    rows = table(spark, sf_dir, "part").where("p_size < 0").select(F.col("p_size").cast("bigint").alias("v"))
    h = H.record(rows, "v", Geometry(4, 64, 1))
    out = None
    for name, walk in (("all", I.every_bin(h)), ("linear", I.linear(h, 2)), ("log", I.logarithmic(h, 10, 2.0)), ("recorded", I.recorded(h)), ("quantiles", I.quantile_steps(h, 5))):
        part = walk.select(F.lit(name).alias("walk"), "value", F.isnan("quantile").alias("undefined"), "count_at_value", "count_since_last")
        out = part if out is None else out.union(part)
    return out


def in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins made, encoded and decoded by SQL functions."""
    sql.register(spark, G, "lat")
    table(spark, sf_dir, "events").select("event_type", cents("value").alias("v")).createOrReplaceTempView("lat_events")
    return spark.sql("""
        with b as (select event_type, lat_index(v) as bin, count(*) as cnt from lat_events group by all),
        p as (select event_type, collect_list(struct(bin, cnt)) as bins from b group by all),
        e as (select event_type, payload from p, lateral lat_encode(bins))
        select event_type, d.bin, d.cnt, lat_low(d.bin) as low, lat_high(d.bin) as high, lat_median(d.bin) as median, lat_width(d.bin) as width
        from e, lateral lat_decode(payload) d""")


def written_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of weighted samples that saturate."""
    rows = table(spark, sf_dir, "events").select("ts", cents("value").alias("v"), (F.col("user_id") % 3).alias("w"))
    h = windows.windowed(rows, "v", Geometry(1, 10_000, 2), "ts", "10 days", slide="5 days", weight="w", saturate=True)
    return S.summary(h).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "total", "max")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("ts", "event_type", cents("value").alias("v"))
    h = windows.windowed(rows, "v", G, "ts", None, ["event_type"], gap="2 hours")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return S.summary(h).select("event_type", text("start").alias("begins"), text("end").alias("ends"), "total", "max")


def taken_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers that record all line items and take those returned away again."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", cents("l_extendedprice").alias("v"))
    both = rows.withColumn("less", F.lit(False)).union(rows.where("l_returnflag = 'R'").withColumn("less", F.lit(True)))
    return windows.written(both, "v", G, ["l_linestatus"], minus=F.col("less")).bins


def stream_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent through a stream to a running histogram, read once the stream has taken them all in."""
    schema = table(spark, sf_dir, "events").schema
    sent = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    h = windows.merged_stream(sent.select("event_type", cents("value").alias("v")), "v", G, ["event_type"])
    name = f"merged_{uuid.uuid4().hex}"
    query = h.bins.writeStream.outputMode("complete").format("memory").queryName(name).start()
    try:
        if not windows.refresh(query, 600):
            raise TimeoutError("the stream hasn't taken in all events")
        # a table of bins, whatever the number of events
        return spark.createDataFrame(spark.table(name).toPandas(), h.bins.schema)
    finally:
        query.stop()


def log_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("ts", "event_type", cents("value").alias("v"))
    lines = windows.intervals(windows.windowed(rows, "v", G, "ts", "1 day", ["event_type"]), "event_type")
    of = lambda c: F.col(c).cast("bigint").alias(c)
    # as a day, which doesn't depend on the session's time zone as seconds do
    day = F.date_format(F.timestamp_seconds("start_sec"), "yyyy-MM-dd").alias("day")
    return lines.select("tag", day, of("duration_sec"), "max", (F.octet_length("payload") > 8).alias("framed"))


def tags_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    since = B.epoch_seconds(F.col("ts").cast("timestamp")) - B.epoch_seconds(F.to_timestamp(F.lit("2024-01-01")))
    return rows.select("event_id", B.valid_tag("event_type").alias("type_is_tag"), B.valid_tag("props").alias("props_is_tag"), F.round(since, 3).alias("seconds"))


SHAPES = [(1, 2, 0), (1, 3_600_000_000, 3), (1, 2**62, 5), (512, 10**6, 2), (1000, 10**12, 3), (1 << 20, 1 << 40, 1), (4, 64, 1)]


def geometry_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(low, high, sigfig, (g := Geometry(low, high, sigfig)).unit_bits, g.sub_count, g.buckets, g.bins) for low, high, sigfig in SHAPES]
    return spark.createDataFrame(rows, "low bigint, high bigint, sigfig int, unit_bits int, sub_count int, buckets int, distinct_values int")


FINE = 1.002


def fine_levels() -> list[int]:
    reach, out = 1000.0, [999]
    while out[-1] < 10_000_000:
        reach *= FINE
        out.append(int(reach) - 1)
    return out


def log_sql(levels: list[int]) -> str:
    rows = ", ".join(f"({k}, {x}, {levels[k - 1] if k else 'null'})" for k, x in enumerate(levels))
    return f"""select event_type, k, level, pos from m, (select k, cast(level as bigint) as level, {bin_sql('cast(level as bigint)')} as pos, coalesce({bin_sql('cast(prev as bigint)')}, -1) as before from (values {rows}) l(k, level, prev)) where before < top"""


LOG_LEVELS = [99, *(100 * 2**k - 1 for k in range(1, 57))]
TICKS = [t for t in I.quantile_ticks(5)]

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {
    "record_bins_events": (lambda s, d: events(s, d).bins, f"with {bins_sql(EV, 'event_type')} select * from b"),
    "record_n_lineitem": (lambda s, d: lineitem(s, d, "l_returnflag", weighted=True).bins, f"with {bins_sql(LI, 'l_returnflag', 'w')} select * from b"),
    "saturating_record_orders": (
        lambda s, d: orders(s, d, Geometry(1, 10_000_000, 3), saturate=True).bins,
        f"with {bins_sql(f'select o_orderpriority, case when {bin_sql("v")} >= {Geometry(1, 10_000_000, 3).bins} then 10000000 else v end as v from ({OR})', 'o_orderpriority')} select * from b",
    ),
    "capped_counters": (
        capped,
        f"with r as (select l_returnflag, case when {bin_sql('v', 2)} >= {SMALL.bins} then {SMALL.high} else v end as v, w from ({LI})), {bins_sql('select * from r', 'l_returnflag', 'w', 2)} select l_returnflag, bin, least(cnt, 255) as cnt, cnt as n from b",
    ),
    "len_min_max": (
        lambda s, d: summary_of_orders(s, d).select("o_orderpriority", "total", "min", "max", "min_nz"),
        f"with {bins_sql(OR, 'o_orderpriority')} select o_orderpriority, cast(sum(cnt) as bigint) as total, {low_sql('min(bin)')} as min, {high_sql('max(bin)')} as max, {low_sql('min(bin) filter (where bin > 0)')} as min_nz from b group by 1",
    ),
    "mean_stdev": (
        lambda s, d: summary_of_orders(s, d).select("o_orderpriority", F.round("mean", 3).alias("mean"), F.round("stdev", 3).alias("stdev")),
        f"""with {bins_sql(OR, 'o_orderpriority')}, m as (select o_orderpriority, cast(sum({median_sql('bin')} * cast(cnt as hugeint)) as double) / cast(sum(cnt) as double) as mean, cast(sum(cnt) as double) as n from b group by 1)
        select o_orderpriority, round(max(mean), 3) as mean, round(sqrt(sum((cast({median_sql('bin')} as double) - mean) ** 2 * cnt) / max(n)), 3) as stdev from b join m using (o_orderpriority) group by 1""",
    ),
    "value_at_quantiles": (lambda s, d: S.value_at_quantiles(events(s, d), QS), quantiles_sql(EV, "event_type", QS, "quantile")),
    "value_at_quantile": (lambda s, d: S.value_at_quantile(orders(s, d), 0.95), quantiles_sql(OR, "o_orderpriority", [0.95], "quantile")),
    "value_at_percentiles": (
        lambda s, d: S.value_at_percentiles(lineitem(s, d, "l_returnflag"), PS),
        quantiles_sql(LI, "l_returnflag", PS, "percentile", 100.0),
    ),
    "quantile_below": (
        lambda s, d: S.shares_below(events(s, d), [100, 5000, 40000]).select("event_type", "value", "quantile_below"),
        f"with {bins_sql(EV, 'event_type')}, x(value) as (values (cast(100 as bigint)), (5000), (40000)) select event_type, value, cast(coalesce(sum(cnt) filter (where bin <= {bin_sql('value')}), 0) as double) / cast(sum(cnt) as double) as quantile_below from b, x group by 1, 2",
    ),
    "percentile_below": (
        lambda s, d: S.shares_below(events(s, d), [2500]).select("event_type", "value", "percentile_below"),
        f"with {bins_sql(EV, 'event_type')} select event_type, cast(2500 as bigint) as value, cast(coalesce(sum(cnt) filter (where bin <= {bin_sql('cast(2500 as bigint)')}), 0) as double) / cast(sum(cnt) as double) * 100 as percentile_below from b group by 1",
    ),
    "count_between": (
        lambda s, d: S.counts_between(events(s, d), [(100, 5000), (5000, 100), (30000, 10**9)]),
        f"with {bins_sql(EV, 'event_type')}, x(low, high) as (values (cast(100 as bigint), cast(5000 as bigint)), (5000, 100), (30000, 1000000000)) select event_type, low, high, cast(coalesce(sum(cnt) filter (where bin between {bin_sql('low')} and {bin_sql('high')}), 0) as bigint) as count from b, x group by 1, 2, 3",
    ),
    "count_at": (
        lambda s, d: S.counts_at(events(s, d), [1000, 10007]),
        f"with {bins_sql(EV, 'event_type')}, x(value) as (values (cast(1000 as bigint)), (10007)) select event_type, value, cast(coalesce(sum(cnt) filter (where bin = {bin_sql('value')}), 0) as bigint) as count from b, x group by 1, 2",
    ),
    "equivalents": (
        equivalents,
        f"""with x as (select distinct v, {bin_sql('v')} as bin from ({EV})) select v, bin, {low_sql('bin')} as lowest, {high_sql('bin')} as highest, {median_sql('bin')} as median, {high_sql('bin')} + 1 as next,
        {high_sql('bin')} + 1 - {low_sql('bin')} as width, bin = {bin_sql('v + 1')} as same_as_next from x""",
    ),
    "iter_recorded": (
        lambda s, d: I.recorded(events(s, d)),
        f"with {bins_sql(EV, 'event_type')}, {cum_sql('event_type')} select event_type, {high_sql('bin')} as value, cast(cum as double) / cast(total as double) as quantile, cast(cum as double) / cast(total as double) as quantile_iterated_to, cnt as count_at_value, cnt as count_since_last from c",
    ),
    "iter_all": (
        lambda s, d: I.every_bin(part_sizes(s, d)),
        f"""with {bins_sql('select cast(p_size as bigint) as v from part', '', '1', 1)}, a as (select cast(range as integer) as i from range({Geometry(1, 64, 1).bins}))
        select {high_sql('i', 1)} as value, cast(coalesce(sum(cnt) filter (where bin <= i), 0) as double) / cast(sum(cnt) as double) as quantile, cast(coalesce(sum(cnt) filter (where bin <= i), 0) as double) / cast(sum(cnt) as double) as quantile_iterated_to,
        cast(coalesce(sum(cnt) filter (where bin = i), 0) as bigint) as count_at_value, cast(coalesce(sum(cnt) filter (where bin = i), 0) as bigint) as count_since_last from b, a group by i""",
    ),
    "iter_linear": (
        lambda s, d: I.linear(events(s, d), 1000),
        steps_sql(EV, "event_type", f"""select event_type, k, k * 1000 - 1 as level, {bin_sql('k * 1000 - 1')} as pos from (select event_type, unnest(generate_series(1, greatest(k0, {low_sql(f"{bin_sql('k0 * 1000 - 1')} + 1")} // 1000))) as k
        from (select event_type, greatest(1, ({low_sql('top')} + 1000) // 1000) as k0 from m))"""),
    ),
    "iter_log": (
        lambda s, d: I.logarithmic(events(s, d), 100, 2.0),
        steps_sql(EV, "event_type", log_sql(LOG_LEVELS[:40])),
    ),
    "iter_quantiles": (
        lambda s, d: I.quantile_steps(events(s, d), 5),
        f"""with {bins_sql(EV, 'event_type')}, {cum_sql('event_type')}, t(t) as (values {', '.join(f'(cast({t!r} as double))' for t in TICKS)}),
        p as (select event_type, t, min(bin) as bin from c, t where cast(cum as double) / cast(total as double) >= t group by 1, 2), m as (select event_type, max(bin) as top from b group by 1),
        f as (select event_type, min(t) as first from p join m using (event_type) where bin = top group by 1),
        r as (select p.event_type, t, bin from p join f using (event_type) where t <= first union all select event_type, 1.0, top from f join m using (event_type) where first < 1.0)
        select r.event_type, {high_sql('r.bin')} as value, cast(cum as double) / cast(total as double) as quantile, t as quantile_iterated_to, cnt as count_at_value,
        cast(cum - coalesce(lag(cum) over (partition by r.event_type order by t), 0) as bigint) as count_since_last from r join c on c.event_type = r.event_type and c.bin = r.bin""",
    ),
    "record_correct": (
        lambda s, d: H.record_correct(table(s, d, "events").select("event_type", cents("value").alias("v")), "v", G, INTERVAL, ["event_type"]).bins,
        f"with {bins_sql(omission_sql(EV, 'event_type'), 'event_type')} select * from b",
    ),
    "clone_correct": (
        lambda s, d: H.corrected(events(s, d), INTERVAL).bins,
        f"with {bins_sql(omission_sql(f'select event_type, {high_sql("bin")} as v from (select event_type, {bin_sql("v")} as bin from ({EV}))', 'event_type'), 'event_type')} select * from b",
    ),
    "add_correct": (
        lambda s, d: H.add_correct(events(s, d), events(s, d), INTERVAL).bins,
        f"with {bins_sql(f'{EV} union all {omission_sql(f'select event_type, {high_sql("bin")} as v from (select event_type, {bin_sql("v")} as bin from ({EV}))', 'event_type')}', 'event_type')} select * from b",
    ),
    "add_hist": (lambda s, d: H.add(*split(s, d)).bins, f"with {bins_sql(LI, 'l_linestatus')} select * from b"),
    "rebin_add": (
        lambda s, d: H.add(*split(s, d, Geometry(1, 2**40, 2))).bins,
        f"""with {bins_sql(f"select l_linestatus, v from ({LI}) where l_returnflag = 'R' union all select l_linestatus, {low_sql('bin', 2)} as v from (select l_linestatus, {bin_sql('v', 2)} as bin from ({LI}) where l_returnflag <> 'R')", 'l_linestatus')} select * from b""",
    ),
    "subtract_hist": (subtract_hist, f"""with {bins_sql(f"select * from ({LI}) where l_returnflag <> 'R'", 'l_linestatus')} select * from b"""),
    "sum_rollup": (
        lambda s, d: H.rollup(lineitem(s, d, "l_returnflag", "l_linestatus")).bins.select("l_returnflag", "l_linestatus", "level", "bin", "cnt"),
        f"select l_returnflag, l_linestatus, cast(2 - grouping(l_returnflag) - grouping(l_linestatus) as integer) as level, {bin_sql('v')} as bin, count(*) as cnt from ({LI}) group by grouping sets ((l_returnflag, l_linestatus, 4), (l_returnflag, 4), (4))",
    ),
    "sum_hist": (lambda s, d: H.merge(events(s, d)).bins, f"with {bins_sql(EV, '')} select * from b"),
    "equality": (
        lambda s, d: s.createDataFrame([(H.same(events(s, d), encoded_bins(events(s, d), True)), H.same(events(s, d), H.corrected(events(s, d), INTERVAL)))], "same boolean, other boolean"),
        "select true as same, false as other",
    ),
    "interval_windows": (
        interval_windows,
        f"""with {bins_sql(f"select strftime(ts, '%Y-%m-%d') as day, {CENTS.format('value')} as v from events", 'day')}, {cum_sql('day')} select day, max(total) as total, {high_sql('min(bin) filter (where cum >= greatest(1, ceil(cast(0.99 as double) * cast(total as double))))')} as p99 from c group by 1""",
    ),
    "v2_roundtrip": (lambda s, d: encoded_bins(events(s, d), False).bins, f"with {bins_sql(EV, 'event_type')} select * from b"),
    "v2_deflate_roundtrip": (lambda s, d: encoded_bins(orders(s, d), True).bins, f"with {bins_sql(OR, 'o_orderpriority')} select * from b"),
    "decoded_summary": (
        restated,
        f"with {bins_sql(OR, 'o_orderpriority')} select o_orderpriority, cast(sum(cnt) as bigint) as total, {low_sql('min(bin)')} as min, {high_sql('max(bin)')} as max, {low_sql('min(bin) filter (where bin > 0)')} as min_nz from b group by 1",
    ),
    "ilog_roundtrip": (ilog_roundtrip, f"with {bins_sql(EV, 'event_type')} select * from b"),
    "iter_log_fine": (lambda s, d: I.logarithmic(events(s, d), 1000, FINE), steps_sql(EV, "event_type", log_sql(fine_levels()))),
    "iter_empty": (
        empty_walks,
        f"""select 'all' as walk, (case when i < 32 then i else ((i % 16 + 16) << cast(i // 16 - 1 as integer)) end) * 4 + (case when i < 32 then 1 else cast(1 as bigint) << cast(i // 16 - 1 as integer) end) * 4 - 1 as value,
        true as undefined, cast(0 as bigint) as count_at_value, cast(0 as bigint) as count_since_last from (select range as i from range({Geometry(4, 64, 1).bins}))
        union all select 'linear', v, true, 0, 0 from (values (1), (3)) x(v) union all select 'log', 9, true, 0, 0""",
    ),
    "record_n_correct": (
        corrected_lineitem,
        f"with {bins_sql(f'select l_returnflag, unnest(case when v > 1000000 then generate_series(1000000 + v % 1000000, v, 1000000) else [v] end) as v, w from ({LI})', 'l_returnflag', 'w')} select * from b",
    ),
    "set_to": (
        lambda s, d: H.set_to(events(s, d), events(s, d, Geometry(1, 2**40, 2))).bins,
        f"""with {bins_sql(f"select event_type, {low_sql('bin', 2)} as v from (select event_type, {bin_sql('v', 2)} as bin from ({EV}))", 'event_type')} select * from b""",
    ),
    "set_to_corrected": (
        lambda s, d: H.set_to_corrected(events(s, d, saturate=True), events(s, d), INTERVAL).bins,
        f"with {bins_sql(omission_sql(f'select event_type, {high_sql("bin")} as v from (select event_type, {bin_sql("v")} as bin from ({EV}))', 'event_type'), 'event_type')} select * from b",
    ),
    "clear_then_add": (lambda s, d: H.add(H.cleared(events(s, d)), events(s, d), H.new_from(events(s, d))).bins, f"with {bins_sql(EV, 'event_type')} select * from b"),
    "auto_resize": (
        grown,
        f"select o_orderpriority, cast(2 as integer) as sigfig, cast(1 as bigint) as low, (cast(1 as bigint) << length(bin(max(v) | 255))) - 1 as high, count(*) as total from ({OR}) group by 1",
    ),
    "range_errors": (
        in_range,
        f"select distinct v, {bin_sql('v', 2)} < {Geometry(1, 5000, 2).bins} as held, case when {bin_sql('v', 2)} < {Geometry(1, 5000, 2).bins} then v else 5000 end as clamped from ({EV})",
    ),
    "number_lines": (number_lines, f"with {bins_sql(OR, '')} select * from b"),
    "log_lines": (
        log_lines,
        """select unnest(['#[Histogram log format version 1.2]', '#one', '#two', '#[StartTime: 12.500 (seconds since epoch)]', '#[BaseTime: 7.250 (seconds since epoch)]', '#[MaxValueDivisor: 8.000]',
        '"StartTimestamp","Interval_Length","Interval_Max","Interval_Compressed_Histogram"']) as value
        union all select case when n_regionkey > 0 then 'Tag=r' || n_regionkey || ',' else '' end || n_nationkey || '.125,1.500,' || printf('%.3f', n_nationkey * 1001 / 8.0) || ',' || base64(encode(n_name)) from nation""",
    ),
    "log_placed": (
        log_placed,
        """with x as (select *, cast(n_nationkey as bigint) * 1000000000 + 127890123 as start_ns, case when n_regionkey % 2 = 0 then cast(n_nationkey as bigint) * 10000000000 + 250000000 else 0 end as base_ns from nation)
        select cast(n_nationkey * 10 + 2 as bigint) as line_no, case when n_nationkey % 2 = 0 then 'n' || n_nationkey end as tag, start_ns, case when n_nationkey % 3 = 0 then 1000.0 else 2.0 end as max, 'AA' as payload,
        base_ns + start_ns as unix_ns, base_ns + start_ns - cast(n_regionkey as bigint) * 1000000000 - 500000000 as since_ns from x""",
    ),
    "sql_functions": (
        in_sql,
        f"with {bins_sql(EV, 'event_type')} select event_type, bin, cnt, {low_sql('bin')} as low, {high_sql('bin')} as high, {median_sql('bin')} as median, {high_sql('bin')} + 1 - {low_sql('bin')} as width from b",
    ),
    "written_windows": (
        written_windows,
        f"""with r as (select strftime(time_bucket(interval 5 days, ts, timestamp '1970-01-01') - to_days(5 * k), '%Y-%m-%d') as day, {CENTS.format('value')} as v, user_id % 3 as w from events, (values (0), (1)) x(k)),
        z as (select day, w, case when {bin_sql('v', 2)} >= {Geometry(1, 10_000, 2).bins} then 10000 else v end as v from r where w > 0), {bins_sql('select * from z', 'day', 'w', 2)}
        select day, cast(sum(cnt) as bigint) as total, {high_sql('max(bin)', 2)} as max from b group by 1""",
    ),
    "session_windows": (
        sessions,
        f"""with e as (select event_type, epoch_us(ts) as t, {CENTS.format('value')} as v from events), f as (select *, case when t - lag(t) over (partition by event_type order by t) < 7200000000 then 0 else 1 end as new from e),
        g as (select *, sum(new) over (partition by event_type order by t) as k from f)
        select event_type, strftime(make_timestamp(min(t)), '%Y-%m-%d %H:%M:%S.%f') as begins, strftime(make_timestamp(max(t) + 7200000000), '%Y-%m-%d %H:%M:%S.%f') as ends, count(*) as total, {high_sql(f"max({bin_sql('v')})")} as max from g group by event_type, k""",
    ),
    "stream_merged": (stream_merged, f"with {bins_sql(EV, 'event_type')} select * from b"),
    "log_intervals": (
        log_intervals,
        f"""with r as (select event_type, date_trunc('day', ts) as day, {CENTS.format('value')} as v from events)
        select event_type as tag, strftime(day, '%Y-%m-%d') as day, cast(86400 as bigint) as duration_sec, {high_sql(f"max({bin_sql('v')})")} as max, true as framed from r group by event_type, day""",
    ),
    "tags_and_times": (
        tags_and_times,
        "select event_id, not regexp_matches(event_type, '[, \\r\\n]') as type_is_tag, not regexp_matches(props, '[, \\r\\n]') as props_is_tag, round(epoch_us(ts) / 1e6 - 1704067200, 3) as seconds from events",
    ),
    "geometry_facts": (
        geometry_facts,
        f"""with x(low, high, sigfig) as (values {', '.join(f'(cast({a} as bigint), cast({b} as bigint), cast({c} as integer))' for a, b, c in SHAPES)}),
        y as (select *, cast(length(bin(low)) - 1 as integer) as unit_bits, length(bin(2 * cast(pow(10, sigfig) as bigint) - 1)) as bits from x),
        z as (select *, cast(greatest(1, length(bin(high)) - bits - unit_bits + 1) as integer) as buckets from y)
        select low, high, sigfig, unit_bits, cast(1 << bits as integer) as sub_count, buckets, cast((buckets + 1) * (1 << (bits - 1)) as integer) as distinct_values from z""",
    ),
    "written_minus": (taken_away, f"""with {bins_sql(f"select * from ({LI}) where l_returnflag <> 'R'", 'l_linestatus')} select * from b"""),
    "report": (
        report_lines,
        f"""with {bins_sql(EV, 'event_type')}, {cum_sql('event_type')}, t(t) as (values {', '.join(f'(cast({t!r} as double))' for t in I.quantile_ticks(2))}),
        p as (select event_type, t, min(bin) as bin from c, t where cast(cum as double) / cast(total as double) >= t group by 1, 2), m as (select event_type, max(bin) as top from b group by 1),
        f as (select event_type, min(t) as first from p join m using (event_type) where bin = top group by 1),
        r as (select p.event_type, t, bin from p join f using (event_type) where t <= first union all select event_type, 1.0, top from f join m using (event_type) where first < 1.0),
        x as (select r.event_type, t, row_number() over (partition by r.event_type order by t) as line_no, {high_sql('r.bin')} as value, cum, cast(cum as double) / cast(total as double) as q from r join c on c.event_type = r.event_type and c.bin = r.bin),
        a as (select event_type, cast(sum({median_sql('bin')} * cast(cnt as hugeint)) as double) / cast(sum(cnt) as double) as mean, cast(sum(cnt) as bigint) as n, max(bin) as top from b group by 1),
        z as (select event_type, max(mean) as mean, sqrt(sum((cast({median_sql('bin')} as double) - mean) ** 2 * cnt) / max(n)) as stdev, max(n) as n, max(top) as top from b join a using (event_type) group by 1)
        select event_type, cast(line_no as integer) as line_no, printf('%12d %1.6f %1.6f %10d ', value, q, t, cum) || case when t < 1.0 then printf('%14.2f', 1.0 / (1.0 - t)) else lpad('∞', 14, ' ') end as line from x
        union all select event_type, -1, '       Value QuantileValue QuantileIteration TotalCount 1/(1-Quantile)' from z
        union all select event_type, 0, '' from z
        union all select event_type, 1073741824, printf('#[Mean       = %12.2f, StdDeviation   = %12.2f]', mean, stdev) from z
        union all select event_type, 1073741825, printf('#[Max        = %12d, Total count    = %12d]', {high_sql('top')}, n) from z
        union all select event_type, 1073741826, printf('#[Buckets    = %12d, SubBuckets     = %12d]', {G.buckets}, {G.bins}) from z""",
    ),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
