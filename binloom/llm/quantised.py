"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length 1. A coarse quantiser deals them into inverted lists, as many as the rows ask for: each of at
most COARSE centres, and of many rows each sum of one of them and one of at most FINE centres of what is left to them. What
is left to the list's centre is coded by a centre of each of M subspaces. Every vector probes the lists with the nearest centres: table-lookup distances
between the vector and the codes select candidates, none of them lost to coding, as each code's error is kept and added
to the limit; candidates are reranked by their cosine in double precision. A pair that both ends probe counts once.

Equal vectors are one before anything is compared. Lists are cut into parts of about PART vectors and their probes into
parts of about PROBES, so that no list, however full, is one task. Blocks report how many each vector links with and
edges to the smallest vector that it reaches within the block, not pairs.

Quantisers are fitted on at most SAMPLE distinct vectors (those of lowest hash); all vectors are indexed and probe.

Vectors of the LENGTHS most frequent lengths have quantisers of their own; others are compared with all of their length, part
by part, in one plan.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths don't either. Components count in double precision if the column has it. Repeated rows are vectors of their own; a null id has no component and links with nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, settle

SAMPLE = 16384
PER_LIST, COARSE, FINE, NPROBE = 128, 1024, 256, 24
LENGTHS = 4
SUBSPACES, CODES = 16, 64
PART, PROBES = 1024, 8192


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(k))
        n = np.diff(np.append(starts, len(x)))
        full = n > 0
        centres[full] = np.add.reduceat(x[order], starts[full], axis=0) / n[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, fine: int = 1, seed: int = 5):
        rng = np.random.default_rng(seed)
        x = unit(sample).astype(np.float32)
        self.d = x.shape[1]
        self.width = -(-self.d // SUBSPACES)
        self.m = -(-self.d // self.width)
        self.coarse = k_means(x, lists, 10, rng)
        left = x - self.coarse[nearest(x, self.coarse)]
        self.fine = k_means(left, fine, 10, rng) if fine > 1 else np.zeros((1, self.d), np.float32)
        rest = self.padded(x - self.centre(self.probes(x, 1)[:, 0]))
        self.books = [k_means(np.ascontiguousarray(rest[:, j]), CODES, 10, rng) for j in range(self.m)]

    @property
    def centres(self) -> np.ndarray:
        return self.centre(np.arange(len(self.coarse) * len(self.fine)))

    def centre(self, cell: np.ndarray | int) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Rows split into subspaces, zeros after the last dimension."""
        out = np.zeros((len(x), self.m * self.width), np.float32)
        out[:, : self.d] = x
        return out.reshape(len(x), self.m, self.width)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance from each vector to what its code stands for."""
        rest = self.padded(x - self.centre(home))
        codes = np.stack([nearest(rest[:, j], self.books[j]) for j in range(self.m)], axis=1)
        back = np.stack([self.books[j][codes[:, j]] for j in range(self.m)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(axis=(1, 2)))

    def tables(self, x: np.ndarray, cell: int) -> list[np.ndarray]:
        """Of each subspace, squared distances from the rows' residuals to all codes."""
        rest = self.padded(x - self.centre(cell))
        return [((rest[:, j, None, :] - self.books[j][None]) ** 2).sum(axis=2) for j in range(self.m)]

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The lists with the nearest centres, those of the nearest coarse centres being looked at, in order of their numbers; of n = 1 the nearest."""
        return np.concatenate([self._probes(x[i : i + 1024], n) for i in range(0, len(x), 1024)] or [np.empty((0, 1), np.int64)])

    def _probes(self, x: np.ndarray, n: int) -> np.ndarray:
        score = x @ self.coarse.T - 0.5 * (self.coarse**2).sum(axis=1)
        many = len(self.fine)
        wide = min(max(n, NPROBE), score.shape[1])
        if many == 1:
            at = np.argpartition(-score, min(n, wide) - 1, axis=1)[:, : min(n, wide)]
            return np.sort(at, axis=1)
        near = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
        cells = (near[:, :, None] * many + np.arange(many)).reshape(len(x), -1)
        # |x - a - b|^2 without |x|^2: what the coarse centre has, then the fine one's, then their product
        fine = x @ self.fine.T - 0.5 * (self.fine**2).sum(axis=1)
        score = np.take_along_axis(score, near, axis=1)[:, :, None] + fine[:, None, :] - (self.coarse @ self.fine.T)[near]
        score = score.reshape(len(x), -1)
        n = min(n, score.shape[1])
        at = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.sort(np.take_along_axis(cells, at, axis=1), axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # twice, so that very small and very large vectors don't leave the range of doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(held, nprobe: int):
    def run(batches):
        import pandas as pd

        q = held.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(np.stack(pdf["vec"].to_numpy())).astype(np.float32)
            home = q.probes(x, 1)[:, 0]
            codes, error = q.encode(x, home)
            probes = [sorted({*p, h}) for p, h in zip(q.probes(x, nprobe).tolist(), home.tolist(), strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "m": pdf["m"], "vec": pdf["vec"], "home": home.astype(np.int32), "code": [c.tobytes() for c in codes], "error": error.astype(float), "probes": probes})

    return run


def _linked(q: Quantiser | None, cell: int, xq: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, least: float) -> np.ndarray:
    """Matrix of the pairs (query, listed) with cosine >= least; xq and x in double precision. Without a quantiser all pairs are ranked."""
    if q is None:
        return np.concatenate([xq[i : i + 512] @ x.T >= least for i in range(0, len(xq), 512)] or [np.zeros((0, len(x)), bool)])
    limit = (np.sqrt(2 - 2 * least) + error + 1e-4) ** 2
    out = np.zeros((len(xq), len(x)), bool)
    for i in range(0, len(xq), 512):
        part = xq[i : i + 512]
        distance = np.zeros((len(part), len(x)), np.float32)
        for j, table in enumerate(q.tables(part.astype(np.float32), cell)):
            distance += table[:, codes[:, j]]
        a, b = np.nonzero(distance <= limit)
        if len(a) > distance.size // 16:
            near = part @ x.T >= least
            out[i : i + 512] = near & (distance <= limit)
        elif len(a):
            out[i + a, b] = np.einsum("ij,ij->i", part[a], x[b]) >= least
    return out


def _smallest(links: np.ndarray, q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each query and each listed vector reaches by these links."""
    big = np.iinfo(np.int64).max
    left, right = q_ids.copy(), ids.copy()
    while True:
        new_right = np.minimum(right, np.where(links, left[:, None], big).min(axis=0, initial=big))
        new_left = np.minimum(left, np.where(links, new_right[None], big).min(axis=1, initial=big))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _block(held, least: float):
    """One part of a list with one part of its probes: (id, links, edge)."""

    def run(key, pdf):
        import pandas as pd

        q, (cell, _, chunk) = held.value, key
        own = pdf["own"].to_numpy(bool)
        mine, theirs = pdf[own], pdf[~own]
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "edge": pd.Series(dtype="int64")})
        if not len(mine):
            return none
        x, ids, m = unit(np.stack(mine["vec"].to_numpy())), mine["id"].to_numpy(), mine["m"].to_numpy()
        codes = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), -1) if q else None
        probes = [frozenset(p) for p in mine["probes"]]
        out = []
        rounds = [mine] if chunk == 0 else []
        for i in range(0, len(theirs), 2048):
            rounds.append(theirs.iloc[i : i + 2048])
        for part in rounds:
            xq, qid, qm = unit(np.stack(part["vec"].to_numpy())), part["id"].to_numpy(), part["m"].to_numpy()
            links = _linked(q, cell, xq, x, codes, mine["error"].to_numpy(), least)
            if part is mine:
                links |= links.T
                np.fill_diagonal(links, False)
                counted = np.triu(links)
            else:
                # a pair that is met in both lists counts in the one with the higher number
                home = part["home"].to_numpy()
                other = {h: np.array([h not in p for p in probes]) for h in set(home[home > cell].tolist())}
                counted = links.copy()
                for h, only_here in other.items():
                    counted[home == h] &= only_here
            if not links.any():
                continue
            low, low_mine = _smallest(links, qid, ids)
            out.append(pd.DataFrame({"id": qid, "links": (counted * m).sum(axis=1), "edge": low}))
            out.append(pd.DataFrame({"id": ids, "links": (counted * qm[:, None]).sum(axis=0), "edge": low_mine}))
        out = [o[(o["links"] > 0) | (o["edge"] != o["id"])] for o in out]
        return pd.concat(out) if out else none

    return run


def _of_one_length(vectors: DataFrame, kind: str, least: float, nprobe: int, lists: int | None, fine: int | None) -> DataFrame:
    """Distinct vectors (id, m, vec) of one length to (id, links, edge) rows."""
    spark = vectors.sparkSession
    n = vectors.count()
    sample = np.array([r["vec"] for r in vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    coarse = lists or max(1, min(COARSE, n // PER_LIST))
    q = spark.sparkContext.broadcast(Quantiser(sample, coarse, fine or max(1, min(FINE, n // (PER_LIST * coarse)))))
    schema = f"id bigint, m bigint, vec array<{kind}>, home int, code binary, error double, probes array<int>"
    listed = settle(vectors.select("id", "m", "vec").mapInPandas(_assign(q, nprobe), schema), "lists")
    return _compared(listed, q, least)


def _of_other_lengths(vectors: DataFrame, least: float) -> DataFrame:
    """The same for vectors of rare lengths: a length is a list."""
    none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error")]
    listed = vectors.select("id", "m", "vec", F.size("vec").alias("home"), *none, F.array(F.size("vec")).alias("probes"))
    return _compared(listed, vectors.sparkSession.sparkContext.broadcast(None), least)


def _compared(listed: DataFrame, q, least: float) -> DataFrame:
    """Vectors in their lists with those that probe these."""
    # one row for each list
    sizes = listed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asked = listed.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("chunks"))
    shape = settle(sizes.join(asked, "cell"), "shape")
    to = shape.select(F.col("cell").alias("at"), "parts", "chunks")
    part, chunk = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int")
    none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("array<int>").alias("probes")]
    placed = listed.join(to, F.col("home") == F.col("at"))
    owners = placed.select(
        F.col("home").alias("cell"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(True).alias("own"), "id", "m", "vec", "home", "code", "error", "probes",
    )
    # within a list a vector asks the parts after its own
    inner = placed.where(part < F.col("parts") - 1).select(
        F.col("home").alias("cell"), F.explode(F.sequence(part + 1, F.col("parts") - 1)).alias("part"), chunk.alias("chunk"),
        F.lit(False).alias("own"), "id", "m", "vec", "home", *none,
    )
    outer = listed.select("id", "m", "vec", "home", F.explode("probes").alias("cell")).where("cell != home").join(to, F.col("cell") == F.col("at"))
    outer = outer.select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), chunk.alias("chunk"),
        F.lit(False).alias("own"), "id", "m", "vec", "home", *none,
    )
    rows = owners.union(inner).union(outer)
    return rows.groupBy("cell", "part", "chunk").applyInPandas(_block(q, least), "id bigint, links bigint, edge bigint")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, nprobe: int = NPROBE, lists: int | None = None, fine: int | None = None) -> DataFrame:
    """One row for each row of vectors: key, n_links, component_id, kept. lists and fine: numbers of centres, by default what the rows ask for."""
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("vec"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", sound) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(good, F.col("vec")))
    named = settle(rows.withColumn("hash", F.when(F.col("vec").isNotNull(), F.sha2(F.array_join(F.transform("vec", lambda x: F.hex(x.cast("double").cast("string"))), ","), 256))).select("id", "vec", "hash"), "vectors")
    same = named.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("vec").alias("vec"))
    same = settle(same, "distinct")
    found = None
    lengths = [r["d"] for r in same.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS + 1).collect()]
    for d in lengths[:LENGTHS]:
        part = _of_one_length(same.where(F.size("vec") == d).select("id", "m", "vec"), kind, least, nprobe, lists, fine)
        found = part if found is None else found.union(part)
    if len(lengths) > LENGTHS:
        found = found.union(_of_other_lengths(same.where(~F.size("vec").isin(lengths[:LENGTHS])).select("id", "m", "vec"), least))
    if found is None:
        found = rows.sparkSession.createDataFrame([], "id bigint, links bigint, edge bigint")
    found = settle(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.where("id != edge").select("id", "edge"), "id", "edge")
    of = same.select("hash", "id", "m").join(links, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    of = of.select("hash", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = named.select("id", "hash").join(of, "hash", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op6_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
