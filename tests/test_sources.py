import base64
import os
import random
import zlib
from decimal import Decimal

import pytest

from binloom import errors
from binloom.geometry import U64, Geometry
from binloom.operators import hist as H
from binloom.sources import codec, interval_log
from binloom.sources.numbers import read_numbers

WIDE = Geometry(1, U64, 3)
#: The encoded lines and bytes in these tests are those of the format.
LINE = "1.235,5.670,100.000,HISTEwAAAAMAAAAAAAAAAwAAAAAAAAAB//////////8/8AAAAAAAAM8PAg=="


def test_numbers_in_groups():
    for n, want in ((6, "06"), (127, "7f"), (256, "8002"), (U64, "ff" * 9)):
        assert codec.varint(n).hex() == want
    for n, want in ((0, 0), (-1, 1), (1, 2), (2**63 - 1, U64 - 1), (-(2**63), U64)):
        assert codec.zigzag(n) == want and codec.unzigzag(want) == n
    rng = random.Random(1)
    for _ in range(500):
        n = rng.getrandbits(rng.randint(1, 64))
        assert codec.read_varint(codec.varint(n), 0) == (n, len(codec.varint(n)))


def test_known_bytes():
    data = codec.encode([(1000, 1)], WIDE)
    assert base64.b64encode(data).decode() == LINE.rsplit(",", 1)[1]
    small = Geometry(1, 2047, 3)
    assert codec.encode([], small)[40:] == b"\0" and len(codec.encode([], small)) == 41
    assert codec.encode([(2047, 1)], small)[40:] == codec.varint(codec.zigzag(-2047)) + b"\2"
    assert codec.encode([(0, 1), (2047, 1)], small)[40:] == b"\2" + codec.varint(codec.zigzag(-2046)) + b"\2"
    assert len(codec.encode([(i, 1) for i in range(2048)], small)) == 40 + 2048
    with pytest.raises(errors.CountNotSerializable):
        codec.encode([(1, 2**63)], small)


def test_round_trips():
    rng = random.Random(2)
    for compress in (False, True):
        for _ in range(30):
            g = Geometry(rng.choice([1, 1000]), U64, rng.choice([0, 2, 3, 5]))
            bins = [(i, rng.getrandbits(rng.randint(1, 63)) or 1) for i in sorted(rng.sample(range(g.bins), min(50, g.bins)))]
            assert codec.decode(codec.encode(bins, g, compress)) == (g, bins)


def test_many_numbers_at_once():
    rng = random.Random(5)
    for top in (7, 20, 56, 63):
        lists = [[(i, rng.getrandbits(rng.randint(1, top)) or 1) for i in sorted(rng.sample(range(3000), rng.choice([0, 1, 5, 40])))] for _ in range(30)]
        flat = [p for x in lists for p in x]
        got = codec.payloads(*(codec.np.array([p[k] for p in flat], codec.np.int64) for k in (0, 1)), codec.np.array([len(x) for x in lists]))
        for x, data in zip(lists, got, strict=True):
            want, at = b"", 0
            for i, n in x:
                want += (b"" if i == at else b"\0" if i == at + 1 else codec.varint(codec.zigzag(at - i))) + codec.varint(codec.zigzag(n))
                at = i + 1
            assert data == (want or b"\0")
            signed = codec.numbers_of(data).tolist()
            assert [n for n in signed if n > 0] == [n for _, n in x]
    extremes = [U64, 0, 1, 1 << 63, (1 << 63) - 1, 127, 128]
    assert codec.numbers_of(b"".join(map(codec.varint, extremes))).tolist() == [codec.unzigzag(n) for n in extremes]
    with pytest.raises(errors.Truncated):
        codec.numbers_of(b"\x05\x80")


def test_bad_payloads():
    good = codec.encode([(3, 300)], Geometry(1, 2047, 3))
    for data, error in (
        (b"1234567890", errors.InvalidCookie), (good[:20], errors.Truncated), (good[:-1], errors.Truncated), (good[:8] + b"\0\0\0\1" + good[12:], errors.UnsupportedFeature),
        (good[:16] + bytes(8) + good[24:], errors.InvalidParameters), (codec.struct.pack(">II", codec.COMPRESSED, 5) + b"abcde", errors.Truncated),
    ):
        with pytest.raises(error):
            codec.decode(data)
    with pytest.raises(errors.UnsuitableCounterType):
        codec.decode(good, "u8")
    inner = zlib.compress(codec.struct.pack(">II", codec.COMPRESSED, 0) + bytes(40))
    with pytest.raises(errors.InvalidCookie):
        codec.decode(codec.struct.pack(">II", codec.COMPRESSED, len(inner)) + inner)
    with pytest.raises(errors.EncodedArrayTooLong):
        codec.decode(codec.encode([(5000, 1)], Geometry(1, U64, 3))[:24] + (2047).to_bytes(8) + codec.encode([(5000, 1)], Geometry(1, U64, 3))[32:])


def test_columns(spark):
    df = spark.createDataFrame([("a", 5), ("a", 70_000), ("b", 1)], "k string, v bigint")
    h = H.record(df, "v", Geometry(1, 10**6, 3), ["k"])
    for compress in (False, True):
        back = codec.decoded_histograms(codec.encoded(h, compress), h.geometry, keys=["k"])
        assert H.same(h, back)
    huge = spark.createDataFrame([(1, 2**62)] * 4, "v bigint, w bigint")
    with pytest.raises(Exception, match="CountNotSerializable"):
        codec.encoded(H.record(huge, "v", Geometry.auto(3), weight="w", counter="u64")).collect()
    capped = H.record(huge, "v", Geometry.auto(3), weight="w", counter="u16")
    assert codec.encoded(capped).select(codec.decoded("payload", "u16").alias("d")).first().d.total == 65535
    nothing = spark.createDataFrame([(None,), (bytes(codec.encode([], WIDE)),)], "payload binary").select(codec.decoded("payload").alias("d")).collect()
    assert [(r.d.total, r.d.bins) for r in nothing] == [(None, None), (0, [])]
    auto = H.record(df, "v", Geometry.auto(3))
    d = codec.encoded(auto).select(codec.decoded("payload").alias("d")).first().d
    assert d.high >= 70_000 and d.total == 3
    with pytest.raises(Exception, match="InvalidCookie"):
        spark.createDataFrame([(b"12345678",)], "payload binary").select(codec.decoded("payload")).collect()


def test_log_lines():
    payload = codec.encode([(1000, 1)], WIDE)
    assert interval_log.interval_line(Decimal("1.234567890"), Decimal("5.67"), 1000, payload, None, 10.0) == LINE
    empty = interval_log.interval_line(Decimal("1.234"), Decimal("5.678"), 0, codec.encode([], WIDE), "t")
    assert empty == "Tag=t,1.234,5.678,0.000,HISTEwAAAAEAAAAAAAAAAwAAAAAAAAAB//////////8/8AAAAAAAAAA="
    with pytest.raises(errors.LogError):
        interval_log.interval_line(Decimal(1), Decimal(1), 0, b"", "a b")
    head = interval_log.Header(("one\ntwo",), Decimal("123.456789012"), Decimal("123.456789012"), 1000.0).lines()
    assert head[1:3] == ["#one", "#two"]
    assert head[3:5] == ["#[StartTime: 123.457 (seconds since epoch)]", "#[BaseTime: 123.457 (seconds since epoch)]"]
    assert head[5].startswith("#[MaxValueDivisor: ")
    assert interval_log.three_digits(0.0625) == "0.062"


TEXT = f"""#a comment
#[StartTime: 100.500 (seconds since epoch)]
"StartTimestamp","Interval_Length"
Tag=x,0.1278901234567,1.5,2.769,AAAA\r
#[BaseTime: 1000.250 (seconds since epoch)]
{LINE}
"""


def test_parsing(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(TEXT.encode())
    rows = interval_log.read_log(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["start", "interval", "base", "interval"]
    assert (rows[1].tag, str(rows[1].start_sec), rows[1].payload, rows[1]["max"]) == ("x", "0.127890123", "AAAA", 2.769)
    placed = interval_log.placed_in_time(interval_log.read_log(spark, str(tmp_path / "a.log"))).orderBy("line_no").collect()
    assert [float(r.unix_sec) for r in placed] == [0.127890123, 1001.485]
    assert float(placed[1].since_start) == pytest.approx(900.985)
    strict = interval_log.read_log_strict(spark, str(tmp_path / "a.log")).collect()
    assert [r.kind for r in strict] == ["start", "interval", "base", "interval"]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "b.log").write_text("#Foo\nBar\n")
    with pytest.raises(Exception, match="ParseError"):
        interval_log.read_log(spark, str(tmp_path / "b.log")).collect()
    kept = interval_log.read_log(spark, str(tmp_path / "b.log"), permissive=True).collect()
    assert [(r.kind, r.value) for r in kept] == [("corrupt", "Bar")]
    with pytest.raises(errors.ParseError) as bad:
        list(interval_log.entries_of("#Foo\nBar\n"))
    assert bad.value.offset == 5
    assert [(r.kind, r.line_no) for r in interval_log.read_log_strict(spark, str(tmp_path / "b.log")).collect()] == [("error", 5)]
    with pytest.raises(errors.ParseError):
        list(interval_log.entries_of("1.0,1.0,1.0,AA"))


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", Decimal("2.5"), Decimal("1"), Decimal(70), bytearray(b"xy")), (None, Decimal("1.5"), Decimal("1"), Decimal(60), bytearray(b"z"))], "tag string, start_sec decimal(29,9), duration_sec decimal(29,9), max decimal(20,0), payload binary")
    interval_log.write_log(df, str(tmp_path / "log"), interval_log.Header(start_time=Decimal(5), max_divisor=10.0))
    rows = interval_log.read_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()
    assert [(r.kind, r.tag, r.payload, r["max"]) for r in rows] == [("start", None, None, None), ("interval", None, "eg==", 6.0), ("interval", "a", "eHk=", 7.0)]


def test_placing_many_headers(spark, tmp_path):
    """The last header of each kind before a line counts, in each file by itself."""
    rng = random.Random(6)
    for f in "abc":
        (tmp_path / f"{f}.log").write_text("".join(rng.choice([f"#[StartTime: {k}.0 (s\n", f"#[BaseTime: {k}.5 (s\n", f"{k}.25,1.0,1.0,AA\n", "# c\n"]) for k in range(40)))
    got = {(r.file[-5:], str(r.start_sec)): (float(r.unix_sec), float(r.since_start)) for r in interval_log.placed_in_time(interval_log.read_log(spark, str(tmp_path) + "/*.log")).collect()}
    seen = 0
    for f in "abc":
        start = base = 0.0
        for entry in interval_log.entries_of((tmp_path / f"{f}.log").read_text()):
            start, base = float(entry[2]) if entry[0] == "start" else start, float(entry[2]) if entry[0] == "base" else base
            if entry[0] == "interval":
                assert got[f"{f}.log", str(entry[2].quantize(Decimal("0.000000001")))] == (base + float(entry[2]), base + float(entry[2]) - start)
                seen += 1
    assert seen == len(got) > 10


def test_maximum_that_cant_be_written():
    with pytest.raises(errors.MaxValueNotFormattable):
        interval_log.interval_line(Decimal(1), Decimal(1), 5, b"", None, 0.0)


def test_sql_functions(spark):
    from binloom.functions import sql

    for g in (Geometry(1, U64, 3), Geometry(1000, 2**40, 2), Geometry.auto(0)):
        names = sql.register(spark, g, "t")
        xs = [0, 1, 999, 2047, 2048, 4097, 10**6, 2**40 - 1, 2**62]
        spark.createDataFrame([(x,) for x in xs], "v bigint").createOrReplaceTempView("t_values")
        for r in spark.sql("select v, t_index(v) as i, t_low(t_index(v)) as low, t_high(t_index(v)) as high, t_median(t_index(v)) as median, t_width(t_index(v)) as width from t_values").collect():
            assert (r.i, r.low, r.high, r.median, r.width) == (g.index(r.v), g.lowest(r.v), g.highest(r.v), g.median(r.v), g.width(r.v))
        assert len(names) == 7
    back = spark.sql("select d.* from (select e.payload from values (array(named_struct('bin', 3, 'cnt', 5L), named_struct('bin', 1, 'cnt', 2L))) x(bins), lateral t_encode(bins) e), lateral t_decode(payload) d").collect()
    assert sorted((r["bin"], r.cnt) for r in back) == [(1, 2), (3, 5)]


def test_numbers_source(spark, tmp_path):
    (tmp_path / "n.txt").write_text(f"1\n\n 22 \n{U64}\n")
    assert sorted(r.value for r in read_numbers(spark, str(tmp_path / "n.txt")).collect()) == [-1, 1, 22]
    (tmp_path / "bad.txt").write_text("1\nx\n")
    with pytest.raises(Exception, match="not a whole number"):
        read_numbers(spark, str(tmp_path / "bad.txt")).collect()


def test_report(spark, tmp_path, capsys):
    from binloom.report import main

    (tmp_path / "n.txt").write_text("\n".join(map(str, range(1, 101))))
    target = os.fspath(tmp_path / "h.bin")
    main(["serialize", "--resize", "--compress", str(tmp_path / "n.txt"), target])
    main(["quantiles", "--ticks", "2", "--precision", "6", target])
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].split() == ["Value", "QuantileValue", "QuantileIteration", "TotalCount", "1/(1-Quantile)"]
    assert "∞" in lines[-4] and lines[-3].startswith("#[Mean       =        50.50, StdDeviation   =        28.87]")
    assert "Total count    =          100" in lines[-2]
