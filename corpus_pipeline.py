"""A corpus pipeline: language ID, near duplicates, secrets, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and is written as Parquet
before the next one reads it. All but the last return the columns of documents; the last returns the pieces of the
packed sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm import jaccard, langid, mixing, packing, secrets
from binloom.llm.common import drop_settled, fresh, read, scratch, settle
from binloom.llm.lattice import crc_remainder

#: Documents whose best language has less probability than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.35
#: Texts that go to a Python process at once, in bytes: executors that run one stage after another have little to spare.
ARROW = ("spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound of an Arrow batch to that of this pipeline, for what its stages run from now on."""
    key, most = ARROW
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; training leaves out a quarter of the rows, as the operator's query does."""
    small_batches(spark)
    net = langid.fit(docs, crc_remainder("doc_id", 4) != 2)
    found = langid.identify(docs, net, least=LEAST_LANGUAGE_SCORE, out=tuple(fresh(docs.columns, "lang", "score")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the texts; n_chars follows."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the pieces, and where each goes."""
    small_batches(spark)
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [("language", language), ("deduplicate", deduplicate), ("redact", redact), ("mix", mix), ("pack", pack)]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written before the next one reads it; what a stage has written besides goes with it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = settle(stage(spark, docs, sf_dir), name, lasting=True)
        if before is not None:
            drop_settled(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
