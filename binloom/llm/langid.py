"""Language identification by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes. Each byte has a learned vector; filters of several widths slide over a window,
each filter's maximum over the window goes on, and a softmax gives the labels' probabilities. A text's probabilities are
the means of its windows', weighted by their bytes. The network is trained in numpy on the driver, on a bounded sample of the
labelled rows' windows: whole texts are cut, and about TRAIN_WINDOWS windows, as many of each label, are chosen by hash.

Defined results: a text that is null or has no letter (a character that Unicode calls one: digits, fractions and number signs
aren't) is `und`, with score 0; so is every text if there is no labelled row. With one label, every text with a letter has
it, with score 1. The MOST_LABELS most frequent labels are learned. Repeated rows are predicted each. Other columns are
carried along under any name; those called lang_pred and score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read, tidied

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DIM = 8
#: Bounds of what training brings to the driver, whatever the input.
TRAIN_WINDOWS, MOST_LABELS = 16_000, 1000


def lettered(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class ByteConv:
    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.widest = max(WIDTHS)
        n = len(WIDTHS) * FILTERS
        shape = (self.widest, DIM, n)
        self.mask = np.zeros(shape, np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "emb": draw(256, DIM, scale=0.5),
            "conv": draw(*shape, scale=0.3) * self.mask,
            "conv_b": np.zeros(n, np.float32),
            "out": draw(n, len(labels), scale=0.3),
            "out_b": np.zeros(len(labels), np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows * bytes, widest * DIM): each byte's vector and those after it, zero bytes after the last."""
        n, w = x.shape
        e = np.zeros((n, w + self.widest - 1, DIM), np.float32)
        e[:, :w] = self.p["emb"][x]
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, w, self.widest * DIM), (s[0], s[1], s[2])).reshape(n * w, -1)

    def forward(self, x: np.ndarray) -> tuple:
        n, w = x.shape
        cols = self._columns(x)
        a = (cols @ self.p["conv"].reshape(self.widest * DIM, -1)).reshape(n, w, -1)
        top = a.max(axis=1) + self.p["conv_b"]
        h = np.maximum(top, 0)
        z = h @ self.p["out"] + self.p["out_b"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), h, top, a, cols

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 128])[0] for i in range(0, len(x), 128)])

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 4) -> ByteConv:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                grads = self._gradients(x[at], y[at])
                step += 1
                now = rate * (0.5 ** (epoch / 3))
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, w = x.shape
        p, h, top, a, cols = self.forward(x)
        dz = p.copy()
        dz[np.arange(n), y] -= 1
        dz /= n
        dtop = (dz @ self.p["out"].T) * (top > 0)
        # only the place of a filter's maximum gets a gradient
        at = a.argmax(axis=1)
        rows = np.arange(n)[:, None] * w + at
        picked = cols[rows.reshape(-1)].reshape(n, a.shape[2], -1)
        dconv = np.einsum("nf,nfk->kf", dtop, picked).reshape(self.mask.shape) * self.mask
        dcols = dtop[:, :, None] * self.p["conv"].reshape(-1, a.shape[2]).T[None]
        demb = np.zeros_like(self.p["emb"])
        padded = np.pad(x, ((0, 0), (0, self.widest - 1)))
        for j in range(self.widest):
            inside = (at + j < w).reshape(-1)
            byte = padded[np.arange(n)[:, None], at + j].reshape(-1)
            np.add.at(demb, byte[inside], dcols[:, :, j * DIM : (j + 1) * DIM].reshape(-1, DIM)[inside])
        return {"emb": demb, "conv": dconv.astype(np.float32), "conv_b": dtop.sum(axis=0), "out": h.T @ dz, "out_b": dz.sum(axis=0)}


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text of each, and its number of bytes."""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    flat = b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist(), strict=True))
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(WINDOW, np.array([len(t) for t in texts])[owner] - nth * WINDOW)
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), owner, size


def fit(docs: DataFrame, for_training: Column, label: str = "lang", text: str = "text", most: int = TRAIN_WINDOWS) -> ByteConv | None:
    """Train on labelled rows of docs that are for training; None if there are none."""
    labelled = docs.where(for_training & F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    labelled = labelled.select(F.col(f"`{label}`").cast("string").alias("label"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("bytes"))
    n = F.ceil(F.octet_length("bytes") / WINDOW).cast("int")
    counts = labelled.groupBy("label").agg(F.sum(n).alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "label").limit(MOST_LABELS).collect()
    if not counts:
        return None
    labels = sorted(r["label"] for r in counts)
    # by hash, so that the windows chosen don't depend on how the table is dealt
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, most / len(labels) / max(1, r["n"])))])[F.col("label")]
    drawn = lambda k: F.pmod(F.xxhash64("h", k), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.where(n > 0).select("label", "bytes", F.xxhash64("bytes").alias("h"), share.alias("share"), n.alias("n"))
    rows = rows.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: drawn(k) < F.col("share"))))
    sample = rows.select("label", F.substring("bytes", F.col("k") * WINDOW + 1, F.lit(WINDOW)).alias("window")).orderBy(F.xxhash64("window"), "label").limit(2 * most).collect()
    rng = np.random.default_rng(11)
    x, y = [], []
    for r in sample:
        part = bytes(r["window"])
        if not lettered(part.decode("utf-8", "ignore")):
            continue
        if rng.random() < 0.4:  # short texts, too
            part = part[: int(rng.integers(12, WINDOW))]
        x.append(part.ljust(WINDOW, b"\0"))
        y.append(labels.index(r["label"]))
    net = ByteConv(labels)
    if len(labels) > 1 and x:
        net.train(np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW), np.array(y))
    return net


def predict(net: ByteConv | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    label, score = ["und"] * len(texts), np.zeros(len(texts))
    there = [i for i, t in enumerate(texts) if lettered(t)] if net else []
    at = 0
    while at < len(there):
        end, size = at, 0
        while end < len(there) and size < 4_000_000:
            size += len(texts[there[end]])
            end += 1
        part = there[at:end]
        w, owner, n = windows([texts[i].encode("utf-8", "replace") for i in part])
        p = net.probabilities(w) * n[:, None]
        starts = np.searchsorted(owner, np.arange(len(part)))
        mean = np.add.reduceat(p, starts, axis=0)
        mean /= mean.sum(axis=1, keepdims=True)
        for i, row in zip(part, mean, strict=True):
            label[i] = net.labels[int(row.argmax())]
            score[i] = min(1.0, float(row.max()))
        at = end
    return label, score


def identify(docs: DataFrame, net: ByteConv | None, text: str = "text", keep: list[str] | None = None, least: float | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns to keep (by default all) with lang_pred and score, or as out calls them; with least, only rows that have a language at that score."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    names = [c for c in (docs.columns if keep is None else keep) if c not in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                label, score = predict(held.value, batch.column(len(names)).to_pylist())
                told = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(label, pa.string()), pa.array(score)], [*names, *out])
                yield told if least is None else told.filter(pa.array([x != "und" and s >= least for x, s in zip(label, score, strict=True)]))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{out[0]}` string", f"`{out[1]}` double"])
    (whole_text,) = fresh(names, "text")
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(whole_text)).mapInArrow(tidied(run), schema)


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import crc_remainder

    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    net = fit(docs, ~F.col("held_out"))
    return identify(docs, net, keep=["doc_id", "held_out"])
