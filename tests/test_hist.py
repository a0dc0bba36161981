import math
import random

import pytest
from pyspark.sql import functions as F

from binloom.geometry import U64, Geometry
from binloom.operators import hist as H
from binloom.operators import iterate as I
from binloom.operators import stats as S
from tests.model import Model

G = Geometry(1, 3_600_000_000, 3)


def values(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "v bigint")


def weighted(spark, pairs):
    return spark.createDataFrame(pairs, "v bigint, w bigint")


def bins(h):
    return {r["bin"]: int(r["cnt"]) for r in h.bins.collect()}


@pytest.fixture(scope="module")
def stall(spark):
    """A hundred seconds of good answers, then a stall of a hundred seconds.

    Fixed values: this data set, and what the tests below expect of it (numbers of samples, bins and steps, quantiles).
    """
    rows = weighted(spark, [(1000, 10_000), (100_000_000, 1)])
    raw = H.record(rows, "v", G, weight="w")
    return raw, H.record_correct(rows, "v", G, 10_000, weight="w"), H.corrected(raw, 10_000)


def one(df):
    return df.collect()[0]


def near(a, b):
    return abs(a - b) <= 0.001 * abs(b)


def test_totals_and_moments(stall):
    raw, hist, post = stall
    r, h = one(S.summary(raw)), one(S.summary(hist))
    assert (r.total, h.total, one(S.summary(post)).total) == (10_001, 20_000, 20_000)
    assert near(r["mean"], (1e7 + 1e8) / 10_001) and near(h["mean"], (1000 + 5e7) / 2)
    mean = (1e7 + 1e8) / 10_001
    assert near(r.stdev, math.sqrt((10_000 * (1000 - mean) ** 2 + (1e8 - mean) ** 2) / 10_001))


def test_quantiles_of_the_stall(stall):
    raw, hist, _ = stall
    got = {r.quantile: r.value for r in S.value_at_quantiles(raw, [0.3, 0.99, 0.9999, 0.99999]).collect()}
    assert near(got[0.3], 1000) and near(got[0.99], 1000) and near(got[0.9999], 1000) and near(got[0.99999], 1e8)
    got = {r.quantile: r.value for r in S.value_at_quantiles(hist, [0.3, 0.5, 0.75, 0.9, 0.99, 0.99999, 1.0]).collect()}
    assert (got[0.75], got[0.9], got[0.99], got[1.0]) == (50003967, 80019455, 98041855, 100007935)
    assert near(got[0.3], 1000) and near(got[0.99999], 1e8)


def test_shares_and_ranges_of_the_stall(stall):
    raw, hist, _ = stall
    share = lambda h: one(S.shares_below(h, [5000])).quantile_below
    assert abs(share(raw) - 0.9999) < 1e-4 and abs(share(hist) - 0.5) < 1e-4
    asked = [(5000, 150_000_000), (1000, 1000), (10_000, 10_010), (150_000_000, 5000)]
    assert [r["count"] for r in S.counts_between(raw, asked).collect()] == [1, 10_000, 0, 0]
    assert [r["count"] for r in S.counts_between(hist, asked).collect()] == [10_000, 10_000, 1, 0]


def test_walks_of_the_stall(stall):
    raw, hist, post = stall
    assert I.recorded(raw).count() == 2 and I.recorded(hist).count() == 4228
    rows = I.linear(raw, 100_000).orderBy("value").collect()
    assert len(rows) == 1000 and rows[0].count_since_last == 10_000 and rows[999].count_since_last == 1
    for step, n in ((10_000, 10_000), (1000, 100_007)):
        rows = I.linear(hist, step).collect()
        assert len(rows) == n and sum(r.count_since_last for r in rows) == 20_000
    rows = I.logarithmic(raw, 10_000, 2.0).orderBy("value").collect()
    assert len(rows) == 15 and rows[0].count_since_last == 10_000 and rows[14].count_since_last == 1
    assert sum(r.count_since_last for r in I.logarithmic(hist, 10_000, 2.0).collect()) == 20_000
    assert sum(bins(post).values()) == 20_000


def triples(df):
    return [(r.value, r.count_since_last, r.count_at_value) for r in df.orderBy("quantile_iterated_to", "value").collect()]


def by_value(df):
    return [(r.value, r.count_since_last, r.count_at_value) for r in df.orderBy("value").collect()]


def test_logarithmic_tables(spark):
    h = H.record(values(spark, [1, 2, 20, 25, 31, 1500, 1600, 1700, 4095]), "v", Geometry(1, 4095, 3))
    assert by_value(I.logarithmic(h, 1, 2.0)) == [(0, 0, 0), (1, 1, 1), (3, 1, 0), (7, 0, 0), (15, 0, 0), (31, 3, 1), (63, 0, 0), (127, 0, 0), (255, 0, 0), (511, 0, 0), (1023, 0, 0), (2047, 3, 0), (4095, 1, 1)]
    assert by_value(I.logarithmic(h, 1, 10.0)) == [(0, 0, 0), (9, 2, 0), (99, 3, 0), (999, 0, 0), (9999, 4, 1)]
    assert len(by_value(I.logarithmic(h, 4, 2.0))) == 11


def test_linear_table(spark):
    h = H.record(values(spark, [3, 4, 7, 24, 25, 61, 62, 63]), "v", Geometry(1, 63, 1))
    assert by_value(I.linear(h, 8)) == [(7, 3, 1), (15, 0, 0), (23, 0, 0), (31, 2, 0), (39, 0, 0), (47, 0, 0), (55, 0, 0), (63, 3, 2)]


def test_quantile_tables(spark):
    h = H.record(values(spark, range(4096)), "v", Geometry(1, 4095, 3))
    rows = I.quantile_steps(h, 2).collect()
    assert len(rows) == 25 and sum(r.count_since_last for r in rows) == 4096
    h = H.record(weighted(spark, [(1, 1), (1000, 1_000_000)]), "v", G, weight="w")
    got = [(r.value, r.count_since_last, r.count_at_value, r.quantile_iterated_to) for r in I.quantile_steps(h, 2).orderBy("quantile_iterated_to").collect()]
    assert got == [(1, 1, 1, 0.0), (1000, 1_000_000, 1_000_000, 0.25), (1000, 0, 1_000_000, 1.0)]
    h = H.record(values(spark, [1]), "v", G)
    assert triples(I.quantile_steps(h, 2)) == [(1, 1, 1), (1, 0, 1)]
    assert I.quantile_steps(H.record(values(spark, [1]).limit(0), "v", G), 2).count() == 0


def test_tick_lists():
    assert [len(I.quantile_ticks(t)) for t in (1, 2, 5, 100)] == [55, 106, 255, 4646]


def test_every_bin(spark):
    g = Geometry(1, 4095, 3)
    rows = I.every_bin(H.record(values(spark, [1, 2, 2, 4000]), "v", g)).orderBy("value").collect()
    assert len(rows) == g.bins
    assert [(r.value, r.count_at_value) for r in rows if r.count_at_value] == [(1, 1), (2, 2), (4001, 1)]
    assert rows[0].quantile == 0.0 and rows[-1].quantile == 1.0


def test_random_walks_agree_with_the_model(spark):
    rng = random.Random(3)
    for _ in range(4):
        g = Geometry(rng.choice([1, 1, 4, 100]), 10**7, rng.choice([1, 2, 3]))
        xs = [rng.randint(0, 10 ** rng.randint(1, 6)) for _ in range(60)]
        m = Model(g)
        for x in xs:
            m.record(x)
        h = H.record(values(spark, xs), "v", g)
        assert bins(h) == m.counts
        qs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0, 1.5, -0.5]
        assert {r.quantile: r.value for r in S.value_at_quantiles(h, qs).collect()} == {q: m.quantile(q) if q != -0.5 else m.high(min(m.counts)) for q in qs}
        start = rng.randint(1, 50)
        levels = [int(x) for _, part in zip(range(2), I.logarithmic_levels(start, 3.0)) for x in part]
        assert by_value(I.logarithmic(h, start, 3.0)) == m.walk(lambda k: levels[k])
        i = rng.choice([1, 7, 1000, 50_000])
        n = Model(g)
        for x in xs:
            n.correct(x, i)
        assert bins(H.record_correct(values(spark, xs), "v", g, i)) == n.counts


def test_omission_by_bins_agrees_with_terms(spark):
    g = Geometry(1, 2**40, 1)
    xs = [1, 9, 10, 11, 12_345, 10**6, 10**6 + 3]
    m = Model(g)
    for x in xs:
        m.correct(x, 10)
    assert bins(H.record_correct(values(spark, xs), "v", g, 10)) == m.counts
    assert bins(H.record_correct(values(spark, [5]), "v", g, 0)) == {g.index(5): 1}


def test_out_of_range(spark):
    g = Geometry(1, 100_000, 3)
    assert bins(H.record(values(spark, [2**17 - 1]), "v", g)) == {g.last: 1}
    with pytest.raises(Exception, match="ValueOutOfRange"):
        H.record(values(spark, [2**17]), "v", g).bins.collect()
    assert bins(H.record(values(spark, [2**17, 2**40]), "v", g, saturate=True)) == {g.index(100_000): 2}
    assert bins(H.record(values(spark, [-1]), "v", Geometry.auto(3))) == {56319: 1}
    low = Geometry(512, 10**6, 3)
    assert [r["count"] for r in S.counts_at(H.record(values(spark, [1]), "v", low), [511]).collect()] == [1]


def test_nulls_empty_and_min_max(spark):
    h = H.record(values(spark, [None, 5, None, 0]), "v", G)
    s = one(S.summary(h))
    assert (s.total, s.min, s.max, s.min_nz) == (2, 0, 5, 5)
    assert one(S.summary(H.record(values(spark, [0]), "v", G))).min_nz is None
    empty = H.record(values(spark, [1]).limit(0), "v", G)
    assert S.summary(empty).count() == 0 or one(S.summary(empty)).total is None
    assert I.recorded(empty).count() == 0


def test_counters_stop_at_their_cap(spark):
    h = H.record(weighted(spark, [(1, 200), (2, 300), (2, 1)]), "v", G, weight="w", counter="u8")
    got = {r["bin"]: (int(r["cnt"]), int(r["n"])) for r in h.bins.collect()}
    assert got == {1: (200, 200), 2: (255, 301)}
    assert int(one(S.summary(h)).total) == 501
    assert one(S.value_at_quantiles(h, [1.0])).value == 2
    huge = H.record(spark.createDataFrame([(1, 2**62), (1, 2**62), (1, 2**62), (1, 2**62), (3, 1)], "v bigint, w bigint"), "v", G, weight="w", counter="u64")
    assert {r["bin"]: int(r["cnt"]) for r in huge.bins.collect()} == {1: U64, 3: 1}


def test_algebra(spark):
    a, b = [1, 5, 5, 1000, 70_000], [5, 1000, 99_999]
    ha, hb = H.record(values(spark, a), "v", G), H.record(values(spark, b), "v", G)
    both = H.add(ha, hb)
    assert bins(both) == bins(H.record(values(spark, a + b), "v", G))
    assert H.same(H.subtract(both, hb), ha) and not H.same(both, ha)
    with pytest.raises(Exception, match="SubtrahendCountExceedsMinuendCount"):
        H.subtract(ha, hb).bins.collect()
    coarse = Geometry(1, 3_600_000_000, 1)
    m = Model(coarse)
    for x in a:
        m.record(G.lowest(x))
    assert bins(H.rebin(ha, coarse)) == m.counts
    with pytest.raises(Exception, match="OtherAddendValueExceedsRange"):
        H.add(H.record(values(spark, [1]), "v", Geometry(1, 100, 3)), ha).bins.collect()
    assert bins(H.unpacked(H.packed(ha), G)) == bins(ha)
    assert bins(H.add_correct(ha, hb, 1000)) == bins(H.add(ha, H.corrected(hb, 1000)))


def test_keys_and_rollup(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", None, 7), (None, None, 7)], "k string, j string, v bigint")
    h = H.record(df, "v", G, ["k", "j"])
    up = {(r.k, r.j, r.level, r["bin"]): r.cnt for r in H.rollup(h).bins.collect()}
    assert up[(None, None, 0, 1)] == 2 and up[(None, None, 0, 7)] == 2 and up[("a", None, 1, 1)] == 2 and up[("b", None, 2, 7)] == 1
    assert H.subtract(h, h).bins.count() == 0
    assert len(S.value_at_quantiles(h, [0.5]).collect()) == 4
    assert len(I.logarithmic(h, 1, 2.0).where("k is null").collect()) == 4


def test_strict_quantiles_stop_at_a_descent(spark):
    h = H.record(values(spark, [1, 2, 3]), "v", G)
    assert [r.quantile for r in S.value_at_quantiles(h, [0.5, 0.5, 1.0, 0.2, 1.0], strict=True).collect()] == [0.5, 0.5, 1.0]
    for bad in (lambda: I.linear(h, 0), lambda: I.logarithmic(h, 1, 1.0), lambda: I.quantile_steps(h, 0)):
        with pytest.raises(ValueError):
            bad()


def test_logarithmic_walk_with_a_base_near_one(spark):
    """Far more levels than a plan could hold, made one after another as the walk of one process would."""
    g = Geometry(low=1, high=2**62, sigfig=1)
    h = H.record(spark.createDataFrame([("a", 3), ("b", 2**61), ("b", 5)], "k string, v bigint"), "v", g, ["k"])
    rows = I.logarithmic(h, 1, 1.0002)
    assert {(r.k, r.n) for r in rows.groupBy("k").agg({"count_since_last": "sum"}).withColumnRenamed("sum(count_since_last)", "n").collect()} == {("a", 1), ("b", 2)}
    reach, want = 1.0, [0]
    while g.index(want[-1]) < g.index(2**61):
        reach *= 1.0002
        want.append(int(reach) - 1)
    assert [r.value for r in rows.where("k = 'b'").orderBy("value", "quantile").collect()] == want and len(want) > 200_000


def test_walks_at_the_end_of_the_range(spark):
    h = H.record(values(spark, [-1, 1]), "v", Geometry.auto(3))
    rows = I.logarithmic(h, 1, 2.0).collect()
    assert len(rows) == 65 and sum(r.count_since_last for r in rows) == 2


def test_walks_of_an_empty_histogram(spark):
    for g, steps in ((Geometry(1, 4095, 3), 1), (Geometry(16, 4095, 3), 4)):
        empty = H.record(values(spark, [1]).limit(0), "v", g)
        rows = I.every_bin(empty).collect()
        assert len(rows) == g.bins and all(math.isnan(r.quantile) and r.count_at_value == 0 for r in rows)
        rows = I.logarithmic(empty, 100, 2.0).collect()
        assert [(r.value, r.count_since_last) for r in rows] == [(99, 0)] and math.isnan(rows[0].quantile_iterated_to)
        rows = I.linear(empty, 4).collect()
        assert len(rows) == steps and all(math.isnan(r.quantile) for r in rows)
        assert I.recorded(empty).count() == 0 and I.quantile_steps(empty, 5).count() == 0
    assert I.every_bin(H.record(values(spark, [1]).limit(0), "v", Geometry.auto(3))).count() == 2048
    keyed = H.record(spark.createDataFrame([], "k string, v bigint"), "v", G, ["k"])
    assert I.every_bin(keyed).count() == 0 and I.logarithmic(keyed, 1, 2.0).count() == 0


#: Names that operators use or have used for columns of their own.
NAMES = ["low", "high", "v", "w", "several", "r", "m", "first", "top", "by_term", "j", "median", "size", "mean2", "lo", "hi", "nz", "q0", "s0", "cum", "before", "next", "end", "i", "q", "is_last",
         "hit", "tick", "since", "_k", "_level", "_at", "_kind", "_own", "_found", "_top", "_low", "_first", "_end", "_w", "_v", "less", "fewer", "lvl", "_key0", "a.b", "with space", "BINS"]


def test_keys_of_any_name(spark):
    """All names as keys of one table, against a key k."""
    rows = [("x", 7), ("x", 1234), ("y", 8), (None, 250)]
    plain = spark.createDataFrame(rows, "k string, value_of bigint")
    df = plain.select(*[F.col("k").alias(n) for n in NAMES], "value_of")
    h, want = H.record(df, "value_of", G, NAMES), H.record(plain, "value_of", G, ["k"])

    def table(t, keys):
        rest = sorted(c for c in t.columns if c not in keys)
        assert t.columns[: len(keys)] == list(keys) or set(keys) <= set(t.columns)
        out = []
        for r in t.collect():
            of = {r[t.columns.index(k)] for k in keys}
            assert len(of) == 1
            out.append((str(of.pop()), *(str(r[t.columns.index(c)]) for c in rest)))
        return sorted(out)

    same = lambda f: table(f(h, df, NAMES), NAMES) == table(f(want, plain, ["k"]), ["k"])
    assert same(lambda h, df, k: H.record_correct(df, "value_of", G, 100, k).bins)
    assert same(lambda h, *_: H.add(h, H.corrected(h, 100)).bins) and same(lambda h, *_: H.subtract(H.add(h, h), h).bins)
    assert same(lambda h, *_: S.summary(h)) and same(lambda h, *_: H.rebin(h, Geometry(1, 10**9, 2)).bins)
    assert same(lambda h, *_: I.linear(h, 100)) and same(lambda h, *_: I.logarithmic(h, 1, 2.0)) and same(lambda h, *_: I.quantile_steps(h, 2))
    assert same(lambda h, *_: S.value_at_quantiles(h, [0.5])) and same(lambda h, *_: S.shares_below(h, [10])) and same(lambda h, *_: I.recorded(h))


def test_reserved_names(spark):
    df = spark.createDataFrame([("x", 7)], "bin string, v bigint")
    with pytest.raises(ValueError, match="bin"):
        H.record(df, "v", G, ["bin"])
    with pytest.raises(ValueError, match="mean"):
        S.summary(H.record(df.withColumnRenamed("bin", "mean"), "v", G, ["mean"]))


def test_set_to_clear_and_mixed_counters(spark):
    a, b = H.record(values(spark, [1, 5, 1000]), "v", G), H.record(values(spark, [7, 7, 90_000]), "v", Geometry(1, 10**6, 2))
    assert bins(H.set_to(a, b)) == bins(H.rebin(b, G)) and H.set_to(a, b).geometry == G
    assert bins(H.set_to_corrected(a, b, 1000)) == bins(H.corrected(H.rebin(b, G), 1000))
    for empty in (H.cleared(a), H.new_from(a)):
        assert bins(empty) == {} and bins(H.add(empty, a)) == bins(a)
    with pytest.raises(Exception, match="OtherAddendValueExceedsRange"):
        H.set_to(H.record(values(spark, [1]), "v", Geometry(1, 100, 3)), b).bins.collect()
    capped = H.record(weighted(spark, [(1, 300), (2, 3)]), "v", G, weight="w", counter="u8")
    free = H.record(weighted(spark, [(1, 10), (2, 5)]), "v", G, weight="w")
    assert {r["bin"]: (int(r["cnt"]), int(r["n"])) for r in H.add(capped, free).bins.collect()} == {1: (255, 310), 2: (8, 8)}
    assert bins(H.add(free, capped)) == {1: 265, 2: 8}


def test_weighted_corrections(spark):
    m, pairs = Model(G), [(1000, 3), (55_555, 2), (7, 1)]
    for v, n in pairs:
        m.correct(v, 1000, n)
    assert bins(H.record_correct(weighted(spark, [*pairs, (5, 0)]), "v", G, 1000, weight="w")) == m.counts
