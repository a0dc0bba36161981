import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from binloom.llm import packing, secrets
from tests.llm.test_text_operators import language_rows, text_of


def rows():
    rng = random.Random(1)
    out = [(i, t, lang, f"s{i % 3}") for i, t, lang in language_rows(240, 2)]
    base = text_of(rng, 60)
    out += [(500 + i, base, "en", "s1") for i in range(4)] + [(510, base + " end", "en", "s2")]
    out += [(600, "123 456", "en", "s0"), (601, None, None, None), (602, "the key token = deadbeefdeadbeefdeadbeef01 was here the end", "en", "s0")]
    return out


def test_stages_take_effect_one_after_the_other(spark, docs_of, tmp_path):
    docs = docs_of(rows())
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], None).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for df in seen]
    assert set(ids[0]) - set(ids[1]) == {600, 601}
    assert set(ids[1]) - set(ids[2]) == {501, 502, 503, 510} and len(ids[2]) == len(set(ids[2]))
    assert sorted(ids[3]) == sorted(ids[2])
    clean = {r.doc_id: r for r in seen[3].collect()}
    assert secrets.MASK in clean[602].text and "deadbeef" not in clean[602].text and clean[602].n_chars == len(clean[602].text)
    size = {r.doc_id: len(r.text.split()) for r in seen[3].collect()}
    times = Counter(ids[4])
    assert max(times.values()) <= 2 and set(times) <= set(ids[3])
    assert abs(sum(size[i] * k for i, k in times.items()) / sum(size.values()) - 1.5) < 0.05
    # what was packed is the mixed texts, token by token
    known = packing.Words(packing.tokenizer_path())
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    want = Counter()
    for i, k in times.items():
        want[(i, known.ids(pa.array([texts[i]]), 1)[0].astype("<u4").tobytes())] += k
    got = Counter((r.doc_id, bytes(r.ids)) for r in seen[5].collect())
    assert got == want


#: Names of columns that the stages add or have added while they work.
NAMES = ["score", "lang_pred", "_lang", "_score", "_text", "_gone", "gone", "_row", "c0", "size", "source_size", "target", "copies", "whole", "exact", "_key", "_nth", "secrets", "_spans", "_base", "_m", "id", "n", "sig", "key"]


def test_other_columns_pass_through_all_stages(spark, docs_of, tmp_path):
    """Extra columns under any name, null ids, null and empty texts, repeated rows and a long text: nothing crashes, nothing else changes."""
    extra = [(None, "the tion ing was er the ing", "en", "s0"), (None, None, None, None), (700, "", "en", None), (701, "the tion " * 30_000, "en", "s2"), (1, rows()[1][1], "en", "s1"), (1, rows()[1][1], "en", "s1")]
    docs = docs_of(rows() + extra)
    for c in NAMES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, None).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        found = now.collect()
        assert found and all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for r in found for c in NAMES)
    assert {701, None} <= {r.doc_id for r in found}
    assert corpus_pipeline.pack(spark, now, None).agg(F.sum("length")).first()[0] > 60_000


def test_arrow_batches_are_only_lowered(spark):
    key, most = corpus_pipeline.ARROW
    before = spark.conf.get(key)
    try:
        for now, then in (("67108864b", most), ("64m", most), ("1000", 1000)):
            spark.conf.set(key, now)
            corpus_pipeline.small_batches(spark)
            assert int(spark.conf.get(key).rstrip("b")) == then
    finally:
        spark.conf.set(key, before)


def test_run_equals_the_stages(spark, docs_of, tmp_path):
    docs_of(rows()).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    at = Counter()
    for r in sorted(out, key=lambda r: r.offset):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert out and max(at.values()) <= packing.LIMIT
    docs_of([]).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
