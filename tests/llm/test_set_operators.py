import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.llm import common, jaccard, mixing, quality, quantised, revisits
from tests.llm.test_text_operators import ODD, WORDS, text_of


def classes(links, nodes):
    at = {n: n for n in nodes}

    def top(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (200, 180), (60, 300)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3)]
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        real = [e for e in edges if None not in e and e[0] != e[1]]
        assert got == classes(real, {x for e in real for x in e})
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_scratch_tables_are_freed(spark):
    import os

    at = lambda df: df.binloom_path.removeprefix("file://")
    with common.scratch():
        a, b = common.settle(spark.range(3)), common.settle(spark.range(4), lasting=True)
        c = common.settle(spark.range(5))
        common.drop_settled(c)
        assert os.path.exists(at(a)) and not os.path.exists(at(c))
    assert not os.path.exists(at(a)) and b.count() == 4
    common.drop_settled(b)
    assert not os.path.exists(at(b))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_names_that_are_free():
    assert common.fresh(["a", "_n", "__N"], "n", "n", "a") == ["___n", "____n", "_a"]


# -- Jaccard join --


def sets_of(text):
    w = (text or "").encode().lower().split()
    if len(w) >= 5:
        return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
    return {b" ".join(w)} if w else set()


def brute_force(rows):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(sets_of(t))
    ids = sorted(sets)
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    links = [(a, b) for a in ids for b in ids if a < b and any(near(x, y) for x in sets[a] for y in sets[b])]
    return classes(links, ids)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_op8_equals_brute_force(spark, sf_dir, seed):
    rng = random.Random(seed)
    base, passage = text_of(rng, 80), text_of(rng, 60)
    texts = list(ODD)
    texts += [edited(rng, base, rng.randint(0, 4)) for _ in range(60)]  # near copies, at the limit and beyond
    texts += [base] * 5 + [base.upper(), base.replace(" ", "\n\t ")]
    texts += [text_of(rng, rng.randint(20, 60)) + " " + passage for _ in range(25)]  # a passage in common
    texts += [passage, passage + " tail", "x " + passage]
    texts += ["a b c", "A  b c", "a b c d", "a b c d e", "a b c d e f"]
    chain = text_of(rng, 60).split()
    texts += [" ".join(chain[k : k + 50]) for k in range(0, 10, 2)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[7], (rows[9][0], texts[30]), (None, base), (None, None)]
    got = jaccard.op8_jaccard_join(spark, sf_dir(rows)).collect()
    want = brute_force(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    n = defaultdict(list)
    for i, t in rows:
        n[i].append(len(sets_of(t)))
    for r in got:
        assert r.n_shingles in n[r.doc_id] and (r.doc_id is not None or r.component_id is None)


def test_near_copies_in_a_large_group(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 5)
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    monkeypatch.setattr(jaccard, "TURNS", 1)
    rng = random.Random(3)
    base = text_of(rng, 100)
    rows = [(i, edited(rng, base, rng.randint(0, 3))) for i in range(80)] + [(100 + i, edited(rng, base, 5 + i % 6)) for i in range(40)]
    got = {r.doc_id: r.component_id for r in jaccard.op8_jaccard_join(spark, sf_dir(rows)).collect()}
    assert got == brute_force(rows)


def numbers_of_links(rows):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(sets_of(t))
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    return {a: sum(a != b and any(near(x, y) for x in sets[a] for y in sets[b]) for b in sets) for a in sets}


@pytest.mark.parametrize("part", [1024, 7])
def test_op8_counts_links_inside_components(spark, sf_dir, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(12)
    base, other = text_of(rng, 100), text_of(rng, 50)
    texts = [edited(rng, base, rng.randint(0, 5)) for _ in range(60)] + [base] * 4 + [edited(rng, other, k % 3) for k in range(12)] + ["", None, "a b", "A b"]
    rows = list(enumerate(texts))
    # documents of several texts, exact repeats of a row, and rows without an id
    rows += [(3, other), (70, base), (200, texts[5]), (200, texts[9]), (201, texts[5]), (201, other), rows[8], rows[8], (None, base)]
    got = jaccard.op8_jaccard_join(spark, sf_dir(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_links) for r in got} == set(numbers_of_links(rows).items()) | {(None, 0)}


def test_op8_groups_of_several_components_and_negative_ids(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jaccard, "TURNS", 0)
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    rng, known = random.Random(13), jaccard.WordHashes()
    head = [f"h{k}" for k in range(16)]
    prefix = lambda t: tuple(jaccard.shingles(t, known)[: jaccard.prefix_length(24, 75)])
    lowest, alike = prefix(" ".join(head)), []
    while len(alike) < 2:
        t = " ".join(head + [f"t{rng.randrange(10**9)}" for _ in range(12)])
        if prefix(t)[:7] == lowest[:7] and len(jaccard.shingles(t, known)) == 24:
            alike.append(t)
    near = alike[0].rsplit(" ", 1)[0] + " other"
    while prefix(near) == prefix(alike[0]):
        near = "z " + near
    # a group of two components had the number -1 - 5, which is a component as well
    rows = [(5, alike[0]), (7, alike[1]), (-6, near)]
    got = {r.doc_id: r.component_id for r in jaccard.op8_jaccard_join(spark, sf_dir(rows)).collect()}
    assert got == brute_force(rows) == {5: -6, 7: 7, -6: -6}


def join_rows(spark, run):
    """The most rows that a join made while run() went, besides its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    before = ids()
    out, most = run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for i in ids() - before:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for k in range(nodes.size()):
            metrics = nodes.apply(k).metrics()
            if nodes.apply(k).name().startswith("SortMergeJoin") or "HashJoin" in nodes.apply(k).name():
                for j in range(metrics.size()):
                    if metrics.apply(j).name() == "number of output rows":
                        got = values.get(metrics.apply(j).accumulatorId())
                        most = max(most, int(got.get().replace(",", "")) if got.isDefined() else 0)
    return out, most


def test_op8_texts_that_are_nearly_near_are_not_paired_by_each_common_shingle(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jaccard, "TURNS", 0)
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = " ".join(word() for _ in range(300))
    # a passage of most of each text, yet of too little; edits of a text, some of them near
    texts = [passage + " " + " ".join(word() for _ in range(90)) for _ in range(60)]
    for k in range(4):
        base = " ".join(word() for _ in range(400))
        texts += [edited(rng, base, rng.randint(4, 18)) for _ in range(15)]
    rows = list(enumerate(texts))
    got, most = join_rows(spark, lambda: {r.doc_id: r.component_id for r in jaccard.op8_jaccard_join(spark, sf_dir(rows)).collect()})
    assert got == brute_force(rows)
    assert len({*got.values()}) > 64
    # lists of prefixes have about 100 rows a text; paired by each common shingle, 2,190 pairs made 26,469 rows
    assert most < 12_500


def test_op8_empty_and_one_of_each(spark, sf_dir, docs_of):
    assert jaccard.op8_jaccard_join(spark, sf_dir([])).count() == 0
    rng = random.Random(4)
    a, b = text_of(rng, 40), text_of(rng, 40)
    docs = docs_of([(5, a), (2, a), (9, b), (9, b), (7, None), (8, None), (None, a)])
    assert sorted(r.doc_id or -1 for r in jaccard.one_of_each(docs).collect()) == [-1, 2, 7, 8, 9]


def test_one_of_each_with_repeated_and_null_ids(spark, docs_of):
    rng = random.Random(14)
    a, b, c = (text_of(rng, 40) for _ in range(3))
    docs = docs_of([(2, a), (5, a), (5, b), (6, c), (6, c), (7, None), (7, None), (None, a), (None, a), (None, c)])
    kept = sorted((r.doc_id or -1, r.text or "") for r in jaccard.one_of_each(docs).collect())
    assert kept == sorted([(2, a), (5, b), (6, c), (7, ""), (-1, a), (-1, c)])


# -- mixing --


def test_targets_by_repeated_sharing(spark):
    rng = random.Random(5)
    for _ in range(8):
        sizes = {f"s{i:02}": rng.choice([0, 1, 10, 1000, rng.randint(1, 5000)]) for i in range(rng.randint(1, 9))} | ({None: 50} if rng.random() < 0.5 else {})
        order = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
        goal, free, left = {}, set(order), 1.5 * sum(sizes.values())
        while free:
            rate = left / sum(weight[k] for k in free)
            full = {k for k in free if rate * weight[k] > 2 * sizes[k]}
            if not full:
                goal |= {k: rate * weight[k] for k in free}
                break
            goal |= {k: 2.0 * sizes[k] for k in full}
            left -= sum(2 * sizes[k] for k in full)
            free -= full
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        for r in got:
            assert r.target == pytest.approx(goal[r.source], rel=1e-9, abs=1e-9)


def test_op3_mix(spark, sf_dir):
    rng = random.Random(6)
    rows = [(i, text_of(rng, max(1, int(rng.lognormvariate(3, 0.8)))), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(2000, None, "en", "a"), (2001, "", "en", "zz")] + [(3, "same text", "en", "b")] * 7
    path = sf_dir(rows)
    got = mixing.op3_mixing(spark, path).collect()
    again = mixing.op3_mixing(spark, path).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    source = {i: s for i, _, _, s in rows}
    taken, goal, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(largest[s], 1)
        if t > 2000:
            assert taken[s] == pytest.approx(t, rel=0.02)


def test_rounding_keeps_expectations_and_words(spark):
    units = spark.range(600).select(F.lit("s").alias("source"), (F.col("id") % 40 + 1).alias("size"), F.xxhash64("id").alias("key"), F.col("id").alias("base"), F.lit(0.3).alias("p"))
    hits = np.zeros(600)
    for seed in range(6):
        rows = mixing.rounded(units, seed * 100).collect()
        assert len(rows) == 600
        words = sum(r.base % 40 + 1 for r in rows if r.taken)
        assert words == pytest.approx(0.3 * sum(i % 40 + 1 for i in range(600)), abs=40)
        for r in rows:
            hits[r.base] += r.taken
    assert hits.sum() == pytest.approx(0.3 * 6 * 600, rel=0.1) and hits.max() < 6


def test_resampling(spark, docs_of):
    rng = random.Random(7)
    docs = docs_of([(i, text_of(rng, 20), "en", "ab"[i % 2]) for i in range(60)])
    out = mixing.resample(docs)
    assert out.columns == docs.columns and 60 <= out.count() <= 120
    assert mixing.resample(docs.limit(0)).count() == 0


HELPERS = ["whole", "exact", "size", "source_size", "target", "copies", "_copy", "_key", "_row", "_source", "_more", "_sum", "_of", "rest", "words", "c0", "_n", "_nth", "_at", "_part", "_hot", "_goal", "_left", "path", "unit"]


def test_mixing_leaves_other_columns_as_they_are(spark, docs_of):
    rng = random.Random(71)
    docs = docs_of([(i, text_of(rng, 20), "en", "ab"[i % 2]) for i in range(40)])
    for c in HELPERS:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in HELPERS)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 40 and all(r.whole == f"whole{r.doc_id}" and r._key == f"_key{r.doc_id}" and isinstance(r.copies, int) for r in mixed)


def test_repeated_rows_are_numbered_in_parts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "HOT", 7)
    rng = random.Random(72)
    keys = spark.createDataFrame([(k,) for k in [1] * 50 + [2] * 9 + [3] * 7 + list(range(10, 40))], "k bigint").repartition(5).select("k")
    path = sf_dir([(1, "same words here", "en", "a")] * 60 + [(i, text_of(rng, 30), "en", rng.choice("ab")) for i in range(2, 80)])
    keys.write.parquet(path + "/keys")
    got = defaultdict(list)
    for r in mixing.numbered(spark.read.parquet(path + "/keys"), "k", "n").collect():
        got[r.k].append(r.n)
    assert all(sorted(v) == [*range(1, len(v) + 1)] for v in got.values()) and len(got[1]) == 50
    rows = mixing.op3_mixing(spark, path).collect()
    assert len(rows) == 138
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source_size, r.target] += r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= 31 for (_, target), n in taken.items()) and all(n == size for (size, _), n in sizes.items())


# -- vectors --


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_op6_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quantised, "PART", 40)
    monkeypatch.setattr(quantised, "PROBES", 100)
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(20) for _ in range(250)]
    for _ in range(12):
        centre = rng.standard_normal(20)
        x += [centre + rng.standard_normal(20) * rng.uniform(0.1, 0.45) for _ in range(15)]
    x += [x[3], x[3] * 2, x[260], -x[5]]
    centre = rng.standard_normal(20)
    x += [centre + rng.standard_normal(20) * 0.25 for _ in range(150)]
    x = np.array(x, np.float32)
    bad = [None, [], [0.0] * 20, [float("nan")] * 20, [float("inf")] + [1.0] * 19, [None] * 20, [1.0, 2.0]]
    rows = [(i * 2, v.tolist(), 0) for i, v in enumerate(x)] + [(10_001 + 2 * i, v, 0) for i, v in enumerate(bad)] + [(None, x[3].tolist(), 0)]
    got = quantised.near_vectors(vectors(spark, rows), lists=12, nprobe=12).collect()
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = classes([(2 * a, 2 * b) for a, b in zip(*np.nonzero(np.triu(link)), strict=True)], [2 * i for i in range(len(x))])
    by = {r.vec_id: r for r in got}
    for i in range(len(x)):
        r = by[2 * i]
        assert (r.n_links, r.component_id, r.kept) == (link[i].sum(), want[2 * i], want[2 * i] == 2 * i)
    for i in range(len(bad)):
        r = by[10_001 + 2 * i]
        assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert (by[None].n_links, by[None].component_id, by[None].kept) == (0, None, False)


def test_codes_lose_nothing():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 17))
    q = quantised.Quantiser(x, 5)
    u = quantised.unit(x)
    home = quantised.nearest(u.astype(np.float32), q.centres)
    codes, error = q.encode(u.astype(np.float32), home)
    for cell in range(5):
        mine = home == cell
        links = quantised._linked(q, cell, u, u[mine], codes[mine], error[mine], 0.6)
        assert (links == (u @ u[mine].T >= 0.6)).all()


def near_the_limit(n, d, seed):
    """Pairs of unit vectors whose cosines are 0.9 but for some 1e-12."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        a, b = rng.standard_normal(d), rng.standard_normal(d)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9 + (1e-12 if k % 2 else -1e-12)
        out += [a, c * a + np.sqrt(1 - c * c) * b]
    return out


def test_op6_double_precision_and_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(quantised, "LENGTHS", 2)
    x = near_the_limit(40, 24, 20)
    x += [v * 1e300 for v in near_the_limit(2, 24, 21)]  # beyond what floats hold
    rng = np.random.default_rng(22)
    for d in (3, 5, 5, 5, 7, 7, 9):
        v = rng.standard_normal(d)
        x += [v, v * 3, -v]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in quantised.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    for k in range(42):
        assert (got[2 * k].n_links, got[2 * k + 1].n_links) == ((1, 1) if k % 2 else (0, 0))
    unit = [v / np.linalg.norm(v) for v in x[84:]]
    for i, v in enumerate(unit, 84):
        assert got[i].n_links == sum(len(v) == len(w) and v @ w >= 0.9 for w in unit) - 1
    assert got[85].component_id == 84 and len({len(v) for v in unit}) == 4


def test_op6_recall_with_two_levels_of_lists(spark):
    rng = np.random.default_rng(23)
    centres = rng.standard_normal((300, 32))
    x = np.concatenate([c + rng.standard_normal((10, 32)) * 0.2 for c in centres]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for fine in (4, 16):
        got = quantised.near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), lists=60, fine=fine).collect()
        recall = sum(r.n_links for r in got) / ((u @ u.T >= 0.9).sum() - len(x))
        assert 0.9 <= recall <= 1


def test_op6_recall_on_the_embeddings_table(spark):
    """Links found with production parameters, against all pairs."""
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(sf + "/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack([np.asarray(v, float) for v in table["embedding"]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r.n_links for r in quantised.op6_product_quantisation(spark, sf).collect()}
    want = dict(zip(table["vec_id"].tolist(), link.sum(axis=1).tolist(), strict=True))
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.9 * sum(want.values())


def test_vectors_empty_and_recall_with_few_probes(spark):
    assert quantised.near_vectors(vectors(spark, [])).count() == 0
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([c + rng.standard_normal((12, 32)) * 0.2 for c in centres]).astype(np.float32)
    got = quantised.near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), lists=40, nprobe=4).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert sum(r.n_links for r in got) >= 0.95 * ((u @ u.T >= 0.9).sum() - len(x))


# -- quality --


def test_quality_follows_evidence_and_sites(spark, docs_of):
    rng = random.Random(11)
    good = lambda: ". ".join(text_of(rng, 12).capitalize() for _ in range(5))
    junk = lambda: " ".join(w + "###" for w in text_of(rng, 40).split())
    rows, labels = [], []
    for i in range(400):
        ok = rng.random() < 0.5
        rows.append((i, good() if ok else junk(), "en", rng.choice("ab")))
        labels.append((i, int(ok) if i % 2 else None, 0))
    # two sites of middling texts: one labelled good throughout, one bad
    for i in range(400, 500):
        rows.append((i, "word", "en", "good" if i % 2 else "bad"))
        labels.append((i, i % 2 if i < 480 else None, 0))
    rows += [(900, "word", "en", "good"), (901, None, None, None), (None, "word", "en", "bad")]
    table = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs_of(rows), table, F.col("source"), F.col("lang")).collect()}
    truth = {i: "###" not in (t or "") for i, t, *_ in rows[:400]}
    assert np.mean([(got[i].quality >= 0.5) == truth[i] for i in truth if i % 2 == 0]) > 0.95
    assert got[900].quality > got[None].quality and got[900].host_rate > 0.5 > got[None].host_rate
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 for r in got.values())


def strength_of(sites, parents):
    """Method of moments over (n, s) sites: the pseudo-count that explains their spread around the parents' rates."""
    n, s = np.array(sites, float).T
    p, rate = np.array(parents), s / n
    inside = (n * p * (1 - p)).sum() / n.sum()
    between = ((n * (rate - p) ** 2).sum() - len(n) * inside) / max(1e-9, n.sum() - (n**2).sum() / n.sum())
    return min(1e4, max(1.0, inside / between - 1 if between > 1e-9 else 1e4))


def test_op5_equals_brute_force(spark, tmp_path, docs_of):
    """The query's evidence against a model fitted apart, and its posteriors against plain sums over hosts and paths."""
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(300):
        host, lang = rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["en", "fr", None])
        good = rng.random() < {"a": 0.8, "b": 0.3}.get(host, 0.5)
        rows.append((i, " ".join(rng.choice(WORDS[:15] if good else WORDS[10:]) for _ in range(rng.randint(0, 30))), lang, host))
        if rng.random() < 0.6:
            labels.append((i, int(good) if rng.random() < 0.9 else None, 0))
    rows += [(1000, None, None, None), (None, "a b", "en", "a"), rows[4], rows[4]]
    labels += [(5, 0, 0), (5, 1, 0), (None, 1, 0)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op5_site_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    told = defaultdict(list)
    for i, q, _ in labels:
        if i is not None and q is not None:
            told[i].append(q)
    y = {i: float(np.mean(v)) for i, v in told.items()}
    x = np.array([np.float32(quality.features(t)) for i, t, *_ in rows if i in y], float)
    target = np.array([y[i] for i, *_ in rows if i in y])
    mean, scale, w = quality.fit_logistic(x, target)
    prior = np.log(target.mean() / (1 - target.mean()))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    own, hosts, paths, parent = [], defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2)), {}
    for i, t, lang, host in rows:
        v = np.array(np.float32(quality.features(t)), float)
        z = np.clip((np.r_[v, v[: quality.N_SHAPE] ** 2] - mean) / scale, -6, 6)
        evidence = z @ w[:-1] + w[-1] - prior
        weight, p = (1.0, y[i]) if i in y else (quality.UNLABELLED, sigmoid(evidence + prior))
        path = "/".join(k for k in (host, lang) if k is not None)
        hosts[host] += (weight, weight * p)
        paths[host, path] += (weight, weight * p)
        own.append((i, t, host, path, evidence, weight, p))
    everything = sum(hosts.values())
    rate = (everything[1] + 0.5) / (everything[0] + 1)
    to_global = strength_of([*hosts.values()], [rate] * len(hosts))
    to_host = strength_of([*paths.values()], [min(1 - 1e-6, max(1e-6, hosts[h][1] / hosts[h][0])) for h, _ in paths])
    want = []
    for i, t, host, path, evidence, weight, p in own:
        host_rate = (hosts[host][1] - weight * p + to_global * rate) / (hosts[host][0] - weight + to_global)
        path_rate = (paths[host, path][1] - weight * p + to_host * host_rate) / (paths[host, path][0] - weight + to_host)
        odds = min(1 - 1e-9, max(1e-9, path_rate))
        want.append((-1 if i is None else i, host or "", path, evidence, host_rate, path_rate, sigmoid(np.log(odds / (1 - odds)) + evidence)))
    key = lambda r: (r[0], r[1], r[2])
    rows_of = sorted(((-1 if r.doc_id is None else r.doc_id, r.host or "", r.path, r.evidence, r.host_rate, r.path_rate, r.quality) for r in got), key=key)
    for a, b in zip(rows_of, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-4, abs=1e-6)
    assert all(r.good == (r.quality >= 0.5) for r in got)


def test_quality_without_labels_and_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.judge(docs_of([(1, "a b"), (2, None)]), none, F.col("source"), F.col("lang")).collect()
    assert [r.evidence for r in rows] == [0.0, 0.0] and all(r.quality == pytest.approx(0.5) for r in rows)
    assert quality.judge(docs_of([]), none, F.col("source"), F.col("lang")).count() == 0


def test_shrinkage_strength(spark):
    sites = spark.createDataFrame([(100.0, 50.0), (100.0, 52.0), (100.0, 49.0)], "n double, s double")
    spread = spark.createDataFrame([(100.0, 5.0), (100.0, 95.0), (100.0, 50.0)], "n double, s double")
    assert quality.strength(sites, F.lit(0.5)) > 100 > 10 > quality.strength(spread, F.lit(0.5))


# -- revisits --

START = datetime(2024, 1, 1)
RECORDS = "record_id bigint, kind string, url string, at timestamp, digest string, headers map<string,string>"


def test_canonical_urls(spark):
    same = ["http://WWW.Example.com:80/a/b/?b=2&a=1&utm_source=x#top", "https://example.com/a/b?a=1&b=2", "example.com/a/b/?a=1&b=2&gclid=5"]
    rows = spark.createDataFrame([(u,) for u in same], "u string").select(revisits.canonical(F.col("u"))).collect()
    assert {r[0] for r in rows} == {"example.com/a/b?a=1&b=2"}


def test_revisits_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        kind, url = rng.choice(["response", "revisit"]), rng.choice(["http://hot.com/", "http://hot.com", None] + [f"http://e.com/{k}" for k in range(6)])
        at = None if rng.random() < 0.03 else START + timedelta(minutes=rng.randrange(0, 3000, 5))
        headers = rng.choice([None, {}, {"ETag": rng.choice(['"a"', 'W/"a"', '"b"']), "Age": str(i), "Content-Length": "5"}, {"Last-Modified": rng.choice("xy"), "X": "1"}])
        rows.append((i, kind, url, at, rng.choice([None, "d1", "d2"]), headers))
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    name = lambda u: None if u is None else u.removeprefix("http://").rstrip("/")
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for i, kind, url, at, digest, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and url is not None and name(r[2]) == name(url) and at is not None and r[3] is not None and r[3] < at]
        r = got[i]
        if not earlier:
            assert (r.status, r.refers_to, r.headers) == ("missing", None, None)
            continue
        found = max(earlier, key=lambda r: (r[3], r[0]))
        mine, theirs = low(headers), low(found[5])
        tag = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
        pairs = [(tag(mine), tag(theirs)), (mine.get("last-modified"), theirs.get("last-modified")), (digest, found[4])]
        agrees = next((a == b for a, b in pairs if a is not None and b is not None), None)
        assert r.status == {None: "unchecked", True: "resolved", False: "mismatch"}[agrees]
        if agrees is not False:
            assert r.refers_to == found[0]
            assert r.headers == theirs | {k: v for k, v in mine.items() if k not in revisits.KEPT_HEADERS}
    assert revisits.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_bodies(spark):
    resolved = spark.createDataFrame([(1, 7), (2, None)], "record_id int, refers_to bigint")
    bodies = spark.createDataFrame([(7, "text")], "record_id bigint, body string")
    assert {r.record_id: r.body for r in revisits.with_bodies(resolved, bodies).collect()} == {1: "text", 2: None}
