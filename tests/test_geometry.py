import random

import pytest

from binloom import errors
from binloom.functions import bins as B
from binloom.geometry import U64, Geometry


@pytest.mark.parametrize(
    ("low", "high", "sigfig", "sub_count", "buckets", "bins", "unit"),
    [
        (1, 2, 0, 2, 2, 3, 0), (1, 2000, 3, 2048, 1, 2048, 0), (1, U64, 0, 2, 64, 65, 0), (1, U64, 3, 2048, 54, 56320, 0), (1, U64, 5, 2**18, 47, 6291456, 0),
        (1000, U64, 0, 2, 55, 56, 9), (1000, U64, 5, 2**18, 38, 37 * 2**17 + 2**18, 9), (1000, 10_000_000, 3, 2048, 5, 4 * 1024 + 2048, 9),
        (U64 // 4, U64, 0, 2, 2, 3, 62), (2**45, U64, 5, 2**18, 2, 2**17 + 2**18, 45),
    ],
)
def test_shape(low, high, sigfig, sub_count, buckets, bins, unit):
    g = Geometry(low, high, sigfig)
    assert (g.sub_count, g.buckets, g.bins, g.unit_bits) == (sub_count, buckets, bins, unit)


def test_automatic_growth():
    g = Geometry.auto(3)
    assert g.bins_to(2**62 - 1) == 54272
    assert g.bins_to(U64) == 56320
    assert g.resized(2**62 - 1).high >= 2**62 - 1


@pytest.mark.parametrize(
    ("args", "error"),
    [((0, 10, 0), errors.LowIsZero), ((2**63, U64, 0), errors.LowExceedsMax), ((10, 15, 0), errors.HighLessThanTwiceLow), ((1, 1, 3), errors.HighLessThanTwiceLow), ((1, 100, 6), errors.SigFigExceedsMax), ((2**53, 2**63, 3), errors.CannotRepresentSigFigBeyondLow)],
)
def test_invalid(args, error):
    with pytest.raises(error):
        Geometry(*args)


def test_equivalence_classes():
    for scale in (1, 1024):
        g = Geometry(scale, 3_600_000_000 * scale, 3)
        for v, want in ((1, 1), (2500, 2), (8191, 4), (8192, 8), (10000, 8)):
            assert g.width(v * scale) == want * scale
        for v, want in ((10007, 10000), (10009, 10008)):
            assert g.lowest(v * scale) == want * scale
        for v, want in ((8180, 8183), (8191, 8191), (8193, 8199), (9995, 9999), (10007, 10007), (10008, 10015)):
            assert g.highest(v * scale) == want * scale + scale - 1
    g = Geometry(1, 3_600_000_000, 3)
    assert [g.median(v) for v in (4, 5, 4000, 8000, 10007)] == [4, 5, 4001, 8002, 10004]
    assert Geometry(1024, 3_600_000_000 * 1024, 3).median(4 * 1024) == 4 * 1024 + 512
    assert g.highest(U64) == U64 and g.highest(U64 - 1) == U64 - 1


def test_bins_and_values_agree():
    rng = random.Random(1)
    for low, sigfig in ((1, 0), (1, 3), (1, 5), (1000, 3), (4, 2)):
        g = Geometry(low, U64, sigfig)
        for _ in range(300):
            v = rng.getrandbits(rng.randint(1, 64))
            i = g.index(v)
            assert g.value_of(i) <= v <= g.highest(v) and g.index(g.value_of(i)) == i
            assert g.next(v) == U64 or g.index(g.next(v)) == i + 1


def test_columns_agree_with_the_geometry(spark):
    rng = random.Random(2)
    values = [0, 1, 2, 2047, 2048, 2**31, 2**62 - 1, 2**63 - 1, 2**63, U64 - 1, U64] + [rng.getrandbits(rng.randint(1, 64)) for _ in range(300)]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "v bigint")
    plain = lambda x: x + (1 << 64) if x < 0 else x
    for g in (Geometry(1, U64, 3), Geometry(1, U64, 0), Geometry(1000, U64, 5), Geometry(2**45, U64, 5)):
        rows = df.select(
            "v", B.bin_index("v", g).alias("i"), B.lowest_equivalent("v", g).alias("low"), B.highest_equivalent("v", g).alias("high"), B.median_equivalent("v", g).alias("mid"), B.next_non_equivalent("v", g).alias("next"),
            B.bin_low(B.bin_index("v", g), g).alias("bl"), B.bin_high(B.bin_index("v", g), g).alias("bh"), B.bin_median(B.bin_index("v", g), g).alias("bm"), B.unsigned("v").alias("u"), B.equivalent_range("v", g).alias("w"),
        ).collect()
        for v, r in zip(values, rows, strict=True):
            assert int(r.u) == v
            assert r.i == g.index(v)
            assert (plain(r.low), plain(r.high), plain(r.mid), plain(r.next), plain(r.w)) == (g.lowest(v), g.highest(v), g.median(v), g.next(v), g.width(v)), (g, v)
            assert (plain(r.bl), plain(r.bm)) == (g.lowest(v), g.median(v))
            assert plain(r.bh) == min(g.highest(g.lowest(v)), U64 - 1)


def test_tags_and_percent(spark):
    df = spark.createDataFrame([("a",), ("a b",), ("a,b",), ("a\nb",), ("",)], "t string")
    assert [r[0] for r in df.select(B.valid_tag("t")).collect()] == [True, False, False, False, True]
    assert spark.range(1).select(B.to_percentile(B.to_quantile(B.F.lit(25.0)))).first()[0] == 25.0
