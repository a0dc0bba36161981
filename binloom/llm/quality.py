"""Quality by hierarchical empirical Bayes: a document's own evidence on top of what its site is like.

A logistic model of the text's words, hashed to BUCKETS, and of its shape, trained on labelled rows, gives each document a
log-likelihood ratio. Sites are two
levels deep, host and path. Each level's documents (labels where there are any, else the model's probability at a lower
weight) are summed by grouped aggregation; a path's rate of good documents is shrunk to its host's, a host's to the
global rate, with strengths estimated from the spread between sites (method of moments). A document's own share is taken
out of its site's sums. The posterior log odds are those of the site plus the document's ratio.

Training uses at most TRAIN_ROWS labelled rows (those of lowest hash); everything else covers all rows.

Defined results: a null text counts as empty; null hosts and paths are sites of their own; a doc_id with several labels has
their mean, null labels count for nothing, rows with a null doc_id have no label; repeated rows are judged each. Without
labels of both kinds the evidence is 0 and the global rate one half.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_settled, read, settle, tidied

TRAIN_ROWS = 20_000
#: Weight of a document without a label in its site's sums.
UNLABELLED = 0.25
PUNCTUATION = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Numbers of a text: its shape, and the shares of its words by hash. The model has the shape's squares, too.
N_SHAPE, BUCKETS = 14, 128


def features(text: str | None) -> list[float]:
    """Shape of a text (sizes in logs, shares between 0 and 1), then the square roots of its words' shares by hash.

    A word is without case and without punctuation at its ends.
    """
    b = (text or "").encode("utf-8", "replace")
    n = max(1, len(b))
    seen = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    words, lines = b.split(), b.split(b"\n")
    k = max(1, len(words))
    counts = Counter(words)
    most = counts.most_common(1)[0][1] if words else 0
    upper, lower, digits = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    plain = int(seen[[44, 46, 39, 45]].sum())
    white = int(seen[[9, 10, 11, 12, 13, 32]].sum())
    symbols = n - upper - lower - digits - plain - white - int(seen[128:].sum())
    kinds = Counter(lines)
    hashed = np.zeros(BUCKETS)
    for word, times in counts.items():
        hashed[zlib.crc32(word.strip(PUNCTUATION).lower()) % BUCKETS] += times
    return [
        np.log1p(len(words)), np.log(n / k), upper / n, digits / n, plain / n, max(0, symbols) / n, int(seen[128:].sum()) / n, white / n,
        len(counts) / k, most / k, len(kinds) / len(lines), np.log1p(k / len(lines)), int(seen[124]) / k, sum(len(w) > 20 for w in counts) / k,
        *np.sqrt(hashed / k).tolist(),
    ]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            rows = [features(t) for t in part.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(rows, pa.list_(pa.float32()))], ["id", "host", "path", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (constant last) of a logistic model in the features and the shape's squares, by Newton's method."""
    x = np.hstack([x, x[:, :N_SHAPE] ** 2])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _evidence(x: Column, model: tuple | None) -> Column:
    """Log-likelihood ratio: the model's log odds less those of its training rows."""
    if model is None:
        return F.lit(0.0)
    (mean, scale, w), prior = model
    x = x.cast("array<double>")
    every = F.concat(x, F.transform(F.slice(x, 1, N_SHAPE), lambda v: v * v))
    fixed = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s"), F.lit(float(v)).alias("w")) for m, s, v in zip(mean, scale, w[:-1], strict=True)])
    terms = F.zip_with(every, fixed, lambda v, c: F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (v - c["m"]) / c["s"])) * c["w"])
    return F.aggregate(terms, F.lit(float(w[-1] - prior)), lambda s, t: s + t)


def strength(sites: DataFrame, parent: Column) -> float:
    """Pseudo-count that pulls sites (n, s) to their parent's rate, by the method of moments. One row reaches the driver."""
    rate = F.col("s") / F.col("n")
    r = sites.where("n > 0").select(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (rate - parent) ** 2).alias("spread"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("inside"), F.sum(F.col("n") ** 2).alias("nn"),
    ).first()
    if not r["k"] or not r["n"]:
        return 1.0
    inside = r["inside"] / r["n"]
    between = (r["spread"] - r["k"] * inside) / max(1e-9, r["n"] - r["nn"] / r["n"])
    return float(min(1e4, max(1.0, inside / between - 1 if between > 1e-9 else 1e4)))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, host, path, evidence, host_rate, path_rate, quality): quality is the posterior probability of a good document."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(f"`{text}`").alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("of")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    shapes = rows.mapInArrow(tidied(_shapes), "id bigint, host string, path string, x array<float>")
    shapes = settle(shapes.join(known, F.col("id") == F.col("of"), "left").drop("of"), "shapes")
    sample = shapes.where("y is not null").select("id", "x", "y").orderBy(F.xxhash64("id", F.lit("train")), "id").limit(TRAIN_ROWS).collect()
    x, y = np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample])
    model = None
    if len(y) and 0 < y.mean() < 1:
        model = fit_logistic(x, y), float(np.log(y.mean() / (1 - y.mean())))
    base = model[1] if model else 0.0
    own = shapes.withColumn("evidence", _evidence(F.col("x"), model))
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    weight = F.when(F.col("y").isNotNull(), F.lit(1.0)).otherwise(F.lit(UNLABELLED))
    own = own.withColumn("w", weight).withColumn("p", F.coalesce("y", sigmoid(F.col("evidence") + base))).drop("x", "y")
    own = settle(own, "evidence")
    drop_settled(shapes)

    paths = settle(own.groupBy("host", "path").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("p")).alias("s")), "paths")
    hosts = settle(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (all_["s"] + 0.5) / (all_["n"] + 1) if all_["n"] else 0.5
    to_global = strength(hosts, F.lit(rate))
    of_host = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    both = paths.join(of_host, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    inner = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("hs") / F.col("hn")))
    to_host = strength(both, inner)
    sites = both.select(F.col("host").alias("h"), F.col("path").alias("q"), "hn", "hs", F.col("n").alias("pn"), F.col("s").alias("ps"))
    joined = own.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    share = F.col("w") * F.col("p")
    host_rate = (F.col("hs") - share + to_global * rate) / (F.col("hn") - F.col("w") + to_global)
    joined = joined.withColumn("host_rate", host_rate).withColumn("path_rate", (F.col("ps") - share + to_host * F.col("host_rate")) / (F.col("pn") - F.col("w") + to_host))
    odds = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("path_rate")))
    posterior = sigmoid(F.log(odds / (1 - odds)) + F.col("evidence"))
    return joined.select(F.col("id").alias(key), "host", "path", "evidence", "host_rate", "path_rate", posterior.alias("quality"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source (host) and language within it (path), with the labels' quality."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return judge(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang")).withColumn("good", F.col("quality") >= 0.5)
