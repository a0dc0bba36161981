"""Exact n-gram Jaccard self-join by grouped prefixes.

A document is its set of word shingles, 62-bit hashes. Shingles stand in one order for all documents: those that a bounded
count found frequent last, the most frequent at the very end, the others by hash. Two sets with Jaccard similarity t or
more share a shingle among the first n - ceil(t n) + 1 of each (the prefix).

1. Documents with equal sets are one class; classes with equal size and prefix are one group.
2. A first look lists the few shingles of lowest hash. In each turn every component so far asks for one pair: with the
   centre of the list that it shares most with. It need not be complete; what it verifies becomes components, so that
   thousands of near copies are one component before any list is paired.
3. The prefixes of all groups are listed by shingle. Lists within one component are done with. In the others two groups of
   different components meet where what follows the shingle in both, itself included, is enough for the overlap that their
   two sizes need (near ones do at their first common shingle), and not where one of the two listed shingles before it is
   common too, as they have met there. Of each pair that has met, all common prefix shingles are counted; the bound on the
   overlap that this number and the rest of the sets allow drops most. Who may be near to a member of a large component is
   not paired with each of its members.
4. Group pairs are expanded to class pairs and verified on the whole sets; members of large components and those that may
   be near to one are compared part by part, by a sparse product. Links of 2 and 4 give the components.

Links inside a component are skipped up to here, none between components is. A link needs no cap: list, group and
component sizes only decide what step 3 has left to do.

5. Where links are counted, every pair of classes inside a component is compared on the whole sets. Members of a large
   component are dealt into parts, and each two parts are one block of a sparse product, which gives a number of links
   for each class, weighted by the documents of the other; the pairs themselves are never rows.

Sets are made of the texts once for those classes that a pair may ask for, and move to their pairs as bytes: each set once to
each part of a centre's pairs, not once for each pair. Lists of frequent shingles, a bounded number, are judged by an
aggregate that each task begins, all others in one window; no list of a frequent shingle is gathered.

Defined results: a null text counts as empty; a set without shingles links with nothing. Rows with the same doc_id are one
document, which links when any of its texts does, and counts once; rows with a null doc_id link with nothing and have
no component. A document's n_links leaves out itself and counts its exact copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, drop_settled, fresh, give_back, no_more_than, partitions, read, settle, swept, tidied

#: Frequent shingles that are placed by frequency; the order of the others is as good for exactness.
FREQUENT = 200_000
#: Shingles that the first look lists: the lowest hashes, be they frequent or not, so that near copies meet there.
SHORT = 8
#: Of these, as many that two must have in common to be tried in the first look, and its turns.
ALIKE, TURNS = 4, 3
#: Groups from which on a component is large, members in an array, parts of those that meet it.
LARGE, MEMBERS, SALTS = 24, 2048, 8
#: Pairs, and shingles of both ends, that are verified at once, and pairs of one centre among them.
PAIRS, PAIR_SHINGLES, STAR = 4096, 1_000_000, 512
#: Classes and shingles of a part of a component, when links are counted; shingles of more sets than RARE are multiplied as dense columns.
PART, PART_SHINGLES, RARE, COLUMNS = 1024, 1_000_000, 16, 4096
#: Rows, ids of 64 bits, up to which a table is sent to all executors; a larger one is joined by a shuffle.
SENT = 1_000_000
HASH = np.uint64(2**62 - 1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        g = np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    else:
        g = h[: len(h) - width + 1].copy()
        for j in range(1, width):
            g *= np.uint64(0x9E3779B97F4A7C15)
            g += h[j : len(h) - width + 1 + j]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    return np.unique(g & HASH)


def _frequent(width: int):
    """Per batch, the shingles that many of its documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.column(0).slice(i, 2000).to_pylist()
                keys, n = np.unique(np.concatenate([shingles(t, known, width) for t in part]), return_counts=True)
                often = n >= max(3, len(part) // 500)
                yield pa.RecordBatch.from_arrays([pa.array(keys[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["key", "n"])

    return run


def _lists(parts: list[np.ndarray], there: list[bool] | None = None) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=None if there is None else pa.array(~np.array(there, bool)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _sketches(width: int, percent: int, frequent: np.ndarray):
    """frequent: hashes from the most frequent on. short and prefix stand once for each set of a task (as far as it remembers), else null."""
    order = np.argsort(frequent)
    at = frequent[order]
    rank = (2**62 + len(frequent) - 1 - order).astype(np.uint64)
    none = np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for batch in batches:
            ids, named = batch.column(0), batch.column(0).is_valid().to_pylist()
            for i in range(0, batch.num_rows, 1000):
                n, sig, gid, prefix, short, new = [], [], [], [], [], []
                for k, t in enumerate(batch.column(1).slice(i, 1000).to_pylist(), i):
                    s = shingles(t, known, width)
                    n.append(len(s))
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    low = s[:SHORT]
                    if len(at) and len(s):
                        j = np.searchsorted(at, s)
                        j[j == len(at)] = 0
                        s = np.sort(np.where(at[j] == s, rank[j], s))
                    s = s[: prefix_length(n[-1], percent)]
                    gid.append(int.from_bytes(hashlib.blake2b(s.tobytes() + n[-1].to_bytes(8), digest_size=8).digest(), signed=True))
                    new.append(bool(len(s)) and named[k] and sig[-1] not in seen)
                    short.append(low.copy() if new[-1] else none)
                    prefix.append(s.copy() if new[-1] else none)
                    if new[-1]:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(sig[-1])
                cols = [ids[i : i + 1000], pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(gid, pa.int64()), _lists(short, new), _lists(prefix, new)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "sig", "gid", "short", "prefix"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                ids, sigs, sets = [], [], []
                for k, t in zip(*(batch.column(c).slice(i, 500).to_pylist() for c in (0, 1)), strict=True):
                    s = shingles(t, known, width).astype("<u8").tobytes()
                    sig = hashlib.blake2b(s, digest_size=16).digest()
                    if (k, sig) not in seen:  # repeated rows
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add((k, sig))
                        ids.append(k)
                        sigs.append(sig)
                        sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["id", "sig", "set"])

    return run


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, set) of the wanted classes (c, id, sig), settled; a set may stand there more than once. docs: (id, text)."""
    wanted = settle(wanted, "wanted")
    found = docs.join(no_more_than(settle(wanted.select("id").distinct(), "ids"), SENT), "id", "left_semi").select("id", "text")
    sets = found.mapInArrow(tidied(_sets(width)), "id bigint, sig binary, set binary")
    out = settle(sets.join(no_more_than(wanted, SENT // 4), ["id", "sig"]).select("c", "set"), "sets")
    drop_settled(wanted)
    return out


def tidied_groups(run):
    """A function of groups of sets, as pandas frames, after which their memory is given back."""

    def one(key, rows):
        out = run(key, rows)
        give_back()
        return out

    def two(key, rows, others):
        out = run(key, rows, others)
        give_back()
        return out

    return two if run.__code__.co_argcount == 3 else one


def near(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared)


def _verified(percent: int):
    def run(key, sets, pairs):
        import pandas as pd

        held = {c: np.frombuffer(s, "<u8") for c, s in zip(sets["c"], sets["set"], strict=True)}
        hit = [near(held[a], held[b], percent) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
        return pd.DataFrame({"a": pairs["a"], "b": pairs["b"]})[np.array(hit, bool)] if len(pairs) else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, m: shingles of both) of classes, settled, whose whole sets are similar enough, settled.

    Pairs are dealt by b, the centre, in parts of at most about STAR, and several parts to a task; sets go where a pair asks for them.
    """
    size = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    if not size["n"]:
        return pairs.sparkSession.createDataFrame([], "a bigint, b bigint")
    bins = max(partitions(pairs.sparkSession), -(-size["n"] // PAIRS), -(-size["m"] // PAIR_SHINGLES))
    stars = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("parts")).where("parts > 1")
    dealt = pairs.join(stars, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))))
    dealt = settle(dealt.select("a", "b", F.pmod(F.xxhash64("b", "part"), F.lit(bins)).alias("bin")), "dealt")
    asked = settle(dealt.select("bin", F.col("a").alias("c")).union(dealt.select("bin", F.col("b").alias("c"))).distinct(), "asked")
    there = sets.join(no_more_than(asked, SENT // 2), "c").select("bin", "c", "set")
    out = there.groupBy("bin").cogroup(dealt.withColumnRenamed("bin", "of").groupBy("of")).applyInPandas(tidied_groups(_verified(percent)), "a bigint, b bigint")
    out = settle(out, "links")
    drop_settled(dealt, asked)
    return out


def _asked(lists: DataFrame, tried: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each component one pair (a, b, m) that hasn't been tried: with the centre of one of its lists (key, c, n, short, held, comp).

    A list's centre is a member whose keys most others have (held: how many in all), which edits of one text are nearest
    to; from turn to turn another one of about the most.
    """
    row = F.struct("c", "n", "short", "comp")
    drawn = F.xxhash64(F.lit(turn), "c")
    weight = F.col("held") * (1 - 0.1 * turn * F.pmod(drawn, F.lit(1024)) / 1024)
    centre = lists.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by(row, F.struct(weight, drawn)).alias("y"))
    centre = settle(centre.where("low != high").select("key", "y"), "centres")
    met = lists.join(no_more_than(centre, SENT // 8), "key").where(f"comp != y.comp and 100 * n >= {percent} * y.n and 100 * y.n >= {percent} * n")
    met = met.withColumn("shared", F.size(F.array_intersect("short", "y.short"))).where(F.col("shared") >= F.least("n", "y.n", F.lit(ALIKE)))
    met = met.select("comp", "shared", F.col("c").alias("a"), F.col("y.c").alias("b"), (F.col("n") + F.col("y.n")).alias("m"))
    met = met.join(tried, ["a", "b"], "left_anti")
    best = F.max_by(F.struct("a", "b", "m"), F.struct("shared", F.xxhash64("a", "b")))
    out = settle(met.groupBy("comp").agg(best.alias("p")).select("p.*").distinct(), "pairs")
    drop_settled(centre)
    return out


def _between(rows: DataFrame, low: str, high: str) -> DataFrame:
    """The rows of the lists (key, ...) that have more than one value from low to high.

    Lists of frequent shingles, at most FREQUENT, may have any length: they are judged by an aggregate, which is sent to
    the rows. The others are judged in a window.
    """
    often = F.col("key") >= F.lit(2**62)
    by_key = Window.partitionBy("key")
    rare = rows.where(~often).withColumn("_l", F.min(low).over(by_key)).withColumn("_h", F.max(high).over(by_key)).where("_l != _h").drop("_l", "_h")
    judged = rows.where(often).groupBy("key").agg(F.min(low).alias("_l"), F.max(high).alias("_h")).where("_l != _h").select("key")
    return rare.unionByName(rows.where(often).join(F.broadcast(judged), "key"))


def _enough(c, m, k, percent: int):
    """Whether c common shingles in the prefixes leave sets of m and k a chance, whichever prefix ends first."""
    larger = F.greatest(m, k) if not isinstance(m, np.ndarray) else np.maximum(m, k)
    beyond = F.ceil(F.lit(percent) * larger / 100) - 1 if not isinstance(m, np.ndarray) else -(-percent * larger // 100) - 1
    return (100 + percent) * (c + beyond) >= percent * (m + k)


def _against_large(percent: int):
    """Which others have so many prefix shingles in common with a member of a large component that they may be near: (large, id)."""

    def run(key, members, others):
        import pandas as pd

        if not len(members) or not len(others):
            return pd.DataFrame({"large": [], "id": []}, dtype="int64")
        both = np.stack([np.concatenate(members[c].to_list()) for c in ("ids", "ns")], 1)
        unique, at = np.unique(both, axis=0, return_inverse=True)
        size = unique[:, 1]
        lists = dict(zip(members["key"], np.split(at.reshape(-1), np.cumsum([len(i) for i in members["ids"]])[:-1]), strict=True))
        out = []
        for (z, n), rows in others.groupby(["id", "n"], sort=False):
            c = np.zeros(len(size), np.int64)
            for k in rows["key"]:
                c[lists[k]] += 1
            least, most = np.minimum(size, n), np.maximum(size, n)
            if ((c > 0) & (100 * least >= percent * most) & _enough(c, size, np.full(len(size), n), percent)).any():
                out.append(z)
        return pd.DataFrame({"large": key[0], "id": out}, dtype="int64")

    return run


def _first_meetings(held: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the groups (id, n, alone, comp, ats, keys ascending), for each place where they may have their first common key.

    The shingles of a near pair that follow its first common key, itself included, hold all that it has in common. A key is
    not the first if one of the two before it is common: then the pair stands at that key, or at an earlier one.
    """
    place = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.get("ats", i).alias("at"), F.get("keys", i - 1).alias("p"), F.get("keys", i - 2).alias("q")))
    rows = held.select("id", "n", "alone", "comp", F.inline(place))
    sized = f"100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n"
    left = " and ".join(f"{100 + percent} * ({z}.n - {z}.at) >= {percent} * (x.n + y.n)" for z in "xy")
    met = "coalesce(x.p in (y.p, y.q) or x.q in (y.p, y.q), false)"
    apart = "x.alone or y.alone or x.comp != y.comp"
    found = rows.alias("x").join(rows.alias("y"), F.expr(f"x.key = y.key and x.id < y.id and {sized} and ({apart}) and {left} and not {met}"))
    return found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _met_small(rows: DataFrame, percent: int) -> DataFrame:
    """_met of components that aren't large: (a, b, c), settled."""
    held = rows.groupBy("id", "n", "alone", "comp").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("l"))
    held = settle(held.select("id", "n", "alone", "comp", F.col("l.at").alias("ats"), F.col("l.key").alias("keys")), "held")
    pairs = settle(_first_meetings(held, percent).distinct(), "meetings")
    of = lambda end, n, keys: held.select(F.col("id").alias(end), F.col("n").alias(n), F.col("keys").alias(keys))
    both = pairs.join(of("a", "m", "ka"), "a").join(of("b", "k", "kb"), "b")
    both = both.select("a", "b", "m", "k", F.size(F.array_intersect("ka", "kb")).cast("bigint").alias("c"))
    out = settle(both.where(_enough(F.col("c"), F.col("m"), F.col("k"), percent)).select("a", "b", "c"), "met")
    drop_settled(held, pairs)
    return out


def _met(mixed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the lists (key, at: the key's place in the prefix, id, n, alone, comp), pairs (a, b) of different components with c, their
    common lists, where c is enough; and (large, id): who may be near to a member of a large component.

    What is alone is in no component; its comp isn't looked at.

    Small components are paired by a join, at about one key a pair; the common keys are counted for what has met. Of large ones the members stand as arrays, at most about MEMBERS of them, so
    that a document which shares many lists with a large component costs a row a list, not one for each member.
    """
    sizes = mixed.where("not alone").groupBy("comp").agg(F.approx_count_distinct("id").alias("size")).where(F.col("size") >= LARGE)
    sizes = settle(sizes.select(F.col("comp").alias("large"), F.ceil(F.col("size") / MEMBERS).cast("int").alias("parts")), "large")
    rows = mixed.join(sizes, ~F.col("alone") & (F.col("comp") == F.col("large")), "left")
    small = _met_small(rows.where("large is null"), percent)

    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    lists = rows.where("large is not null").select("large", part.alias("part"), "key", "id", F.col("n").cast("bigint").alias("n"))
    lists = lists.groupBy("large", "part", "key").agg(F.collect_list("id").alias("ids"), F.collect_list("n").alias("ns"))
    lists = settle(lists, "members")
    places = lists.select("large", "part", F.col("key").alias("of"))
    others = rows.select("key", "id", F.col("n").cast("bigint").alias("n"), "alone", "comp", F.col("large").alias("own"))
    others = others.join(places, F.col("key") == F.col("of")).where("(alone or comp != large) and (own is null or own > large)")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    others = others.select(F.col("large").alias("l"), F.col("part").alias("p"), salt.alias("s"), "key", "id", "n")
    spread = lists.join(settle(others.select("l", "p", "s").distinct(), "asked"), (F.col("large") == F.col("l")) & (F.col("part") == F.col("p")))
    spread = spread.select("large", "part", F.col("s").alias("salt"), "key", "ids", "ns")
    near_large = spread.groupBy("large", "part", "salt").cogroup(others.groupBy("l", "p", "s")).applyInPandas(tidied_groups(_against_large(percent)), "large bigint, id bigint")
    near_large = settle(near_large.distinct(), "near_large")
    drop_settled(lists)
    return small, near_large


def _first_links(percent: int):
    """Of a part of a large component (own) and a part of those that may be near to it: a link (a, b) for each that is."""

    def run(key, rows):
        import pandas as pd

        rows = rows.drop_duplicates(["c", "own"]).sort_values("own", kind="stable")
        c, split = rows["c"].to_numpy(), int((~rows["own"]).sum())
        if split in (0, len(rows)):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        hit = near_matrix([np.frombuffer(x, "<u8") for x in rows["set"]], split, percent)
        found = np.flatnonzero(hit.any(axis=1))
        return pd.DataFrame({"a": c[found], "b": c[split + hit[found].argmax(axis=1)]})

    return run


def blocks_of(near_large: DataFrame, labelled: DataFrame) -> DataFrame:
    """(large, p, q, c, own): members of large components, and the classes (of the groups in near_large) to compare with them.

    Both are dealt into parts of about PART classes and PART_SHINGLES shingles, and each part of the members meets each of the others.
    """
    many = lambda: F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    asking = near_large.join(labelled, near_large["id"] == labelled["gid"]).where("comp != large").select("large", "c", "n")
    asking = settle(asking, "asking")
    asked = asking.select("large").distinct()
    members = labelled.join(asked, labelled["comp"] == asked["large"]).select("large", "c", "n")
    parts = members.groupBy("large").agg(many().alias("ps")).join(asking.groupBy("large").agg(many().alias("qs")), "large")
    parts = settle(parts, "parts")
    dealt = lambda rows, mine, theirs, own: rows.join(parts, "large").select(
        "large", F.pmod(F.xxhash64("c"), F.col(mine)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias("theirs"), "c", F.lit(own).alias("own")
    )
    inner = dealt(members, "ps", "qs", True).select("large", F.col("mine").alias("p"), F.col("theirs").alias("q"), "c", "own")
    outer = dealt(asking, "qs", "ps", False).select("large", F.col("theirs").alias("p"), F.col("mine").alias("q"), "c", "own")
    return settle(inner.union(outer), "blocks")


def near_matrix(sets: list[np.ndarray], split: int, percent: int) -> np.ndarray:
    """Which of the first split sets are near which of the others; of all sets to all, but for themselves, if split is 0."""
    size = np.array([len(s) for s in sets], np.int64)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    left = split or len(sets)
    shared = np.zeros((left, len(sets) - split), np.float32)
    few = (count > 1) & (count <= RARE)
    x, y = at[few[at]], row[few[at]]
    for d in range(1, RARE):
        # rows of a shingle ascend
        same = x[d:] == x[:-d]
        a, b = y[:-d][same], y[d:][same]
        if split:
            across = (a < split) & (b >= split)
            np.add.at(shared, (a[across], b[across] - split), 1)
        else:
            np.add.at(shared, (a, b), 1)
            np.add.at(shared, (b, a), 1)
    many = count > RARE
    x, y = (np.cumsum(many) - 1)[at[many[at]]], row[many[at]]
    for lo in range(0, int(many.sum()), COLUMNS):
        i, j = np.searchsorted(x, [lo, lo + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, int(many.sum()) - lo)), np.float32)
        dense[y[i:j], x[i:j] - lo] = 1
        shared += dense[:left] @ dense[split:].T
    shared = shared.astype(np.int64)
    near = (shared > 0) & (100 * shared >= percent * (size[:left, None] + size[None, split:] - shared))
    if not split:
        np.fill_diagonal(near, False)
    return near


def _counted(percent: int):
    """Links of each class in a block (c, null, documents), and those from or to documents of several texts (c, other, null)."""

    def run(key, members):
        import pandas as pd

        members = members.drop_duplicates("c").sort_values(["component", "part"], kind="stable")
        c, part, w, m = (members[x].to_numpy() for x in ("c", "part", "w", "m"))
        sets, comp = [np.frombuffer(x, "<u8") for x in members["set"]], members["component"].to_numpy()
        starts = [*np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]]), len(comp)]
        out = []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            split = int((part[lo:hi] == key[1]).sum()) if key[1] != key[2] else 0
            if hi - lo < 2 or (key[1] != key[2] and split in (0, hi - lo)):
                continue
            alike = near_matrix(sets[lo:hi], split, percent)
            left, right = slice(lo, lo + split if split else hi), slice(lo + split, hi)
            sides = [(left, right, alike), (right, left, alike.T)] if split else [(left, right, alike)]
            for x, y, hit in sides:
                out += [(s, None, int(n)) for s, n in zip(c[x], hit @ w[y], strict=True) if n]
                told = hit & ((m[x] > 0)[:, None] | (m[y] > 0)[None, :])
                out += [(c[x][i], c[y][j], None) for i, j in zip(*np.nonzero(told), strict=True)]
        return pd.DataFrame({name: pd.array([r[k] for r in out], "Int64") for k, name in enumerate(("c", "other", "w"))})

    return run


def link_counts(held: DataFrame, of: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(c, n_links) of the documents with one text, and (id, n_links) of those with several, if there are any.

    held: (id, c, texts), once for each text of a document; of: (c, n, component); sets: (c, set) of all classes that have links.
    """
    spark = held.sparkSession
    kinds = held.groupBy("c").agg(F.count_if(F.col("texts") == 1).alias("w"), F.count_if(F.col("texts") > 1).alias("m"))
    kinds = settle(kinds.join(of, "c"), "kinds")
    sizes = kinds.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("s")).where("k > 1")
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("k") / PART), F.ceil(F.col("s") / PART_SHINGLES)).cast("int").alias("parts"))
    members = settle(kinds.join(sizes, "component").select("c", "n", "component", "w", "m", "parts"), "members")
    small = members.where("parts = 1").agg(F.sum("n")).first()[0] or 0
    bins = max(partitions(spark), -(-small // PART_SHINGLES))
    # small components are dealt into bins; of large ones each two parts meet
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).otherwise(-1)
    meets = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(-1)))
    block = F.when(F.col("parts") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins)))
    dealt = sets.join(no_more_than(members.drop("n"), SENT // 4), "c")
    dealt = dealt.select("c", "set", "component", "w", "m", block.alias("block"), part.alias("part"), F.explode(meets).alias("q"))
    dealt = dealt.withColumn("i", F.least("part", "q")).withColumn("j", F.greatest("part", "q")).drop("q")
    found = settle(dealt.groupBy("block", "i", "j").applyInPandas(tidied_groups(_counted(percent)), "c bigint, other bigint, w bigint"), "counts")
    drop_settled(members)

    beside = found.where("other is null").groupBy("c").agg(F.sum("w").alias("near"))
    one = kinds.join(beside, "c", "left").select("c", (F.col("w") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    several = held.where("texts > 1").select("id", "c")
    if several.isEmpty():
        return one, None
    met = found.where("other is not null").select("c", "other").union(several.select("c", F.col("c").alias("other"))).distinct()
    theirs = several.select(F.col("id").alias("who"), F.col("c").alias("other"))
    extra = met.join(theirs, "other").groupBy("c").agg(F.countDistinct("who").alias("extra"))
    one = one.join(extra, "c", "left").select("c", (F.col("n_links") + F.coalesce("extra", F.lit(0))).alias("n_links"))
    reach = settle(several.join(met, "c").select("id", "other").distinct(), "reach")
    alone = reach.join(kinds.select(F.col("c").alias("other"), "w"), "other").groupBy("id").agg(F.sum("w").alias("alone"))
    mixed = reach.join(theirs, "other").groupBy("id").agg((F.countDistinct("who") - 1).alias("mixed"))
    return one, alone.join(mixed, "id").select("id", (F.col("alone") + F.col("mixed")).alias("n_links"))


def _labelled(links: DataFrame, classes: DataFrame) -> DataFrame:
    """classes with comp, the smallest class that links reach, settled."""
    comps = components(links)
    return settle(classes.join(comps, classes["c"] == comps["node"], "left").select(*[classes[x] for x in classes.columns], F.coalesce("component", "c").alias("comp")), "labelled")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, with_links: bool = False) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (the smallest key that links reach, itself included).

    With with_links also n_links, the number of other documents that the document is near to.
    """
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    counted = docs.select("text").mapInArrow(tidied(_frequent(width)), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    frequent = np.array([r.key for r in counted.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()], np.uint64)
    schema = "id bigint, n int, sig binary, gid bigint, short array<bigint>, prefix array<bigint>"
    sketches = settle(docs.mapInArrow(tidied(_sketches(width, percent, frequent)), schema), "sketches")

    rows = settle(sketches.select("id", "n", "sig"), "rows")
    named = rows.where("id is not null and n > 0")
    heavy = sketches.where("prefix is not null")
    classes = sketches.where("id is not null and n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("gid").alias("gid"))
    classes = settle(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    numbers = classes.select("sig", "c")
    # a document of several texts holds their classes together
    texts = named.select("id", "sig").distinct().groupBy("id").agg(F.min("sig").alias("low"), F.count("*").alias("texts")).where("texts > 1")
    texts = settle(named.join(texts, "id").select("id", "sig", "low", "texts").distinct(), "texts")
    own = texts.where("sig != low").join(numbers, "sig").select(F.col("c").alias("a"), "low")
    links = settle(own.join(classes.select(F.col("sig").alias("low"), F.col("c").alias("b")), "low").select("a", "b"), "links")

    # a first look, in turns: each links what it finds between the components so far
    heads = classes.groupBy("gid").agg(F.min("c").alias("head"), F.count("*").alias("k")).where("k > 1")
    inside = settle(classes.join(heads, "gid").where("c != head").select(F.col("c").alias("a"), F.col("head").alias("b"), (2 * F.col("n")).alias("m")), "pairs")
    held = heavy.select("sig", "n", "short").join(numbers, "sig").select("c", "n", "short").dropDuplicates(["c"])
    lists = held.select("c", "n", "short", F.explode("short").alias("key"))
    lists = settle(lists, "short")
    shared = lists.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    # who shares too few of its keys with anybody has no neighbour here
    shared = settle(lists.select("c", "n", "key").join(shared, "key"), "shared")
    able = shared.groupBy("c").agg(F.count("*").alias("many"), F.first("n").alias("n"), F.sum("k").alias("held"))
    able = able.where(F.col("many") >= F.least("n", F.lit(ALIKE))).select("c", "held")
    alike = settle(lists.join(shared.join(able, "c").select("c", "key", "held"), ["c", "key"]), "alike")
    drop_settled(lists, shared)
    fetched = alike.select("c").union(inside.select("a")).union(inside.select("b")).union(links.select("a")).union(links.select("b"))
    fetched = settle(fetched.distinct(), "fetched")
    sets = sets_of(docs, classes.join(fetched, "c", "left_semi").select("c", "id", "sig"), width)
    tried = inside.select("a", "b")
    links = links.union(verified(inside, sets, percent))
    classes_of = classes.select("c", "n", "gid")
    labelled = _labelled(links, classes_of)
    for turn in range(TURNS):
        now = alike.join(labelled.select("c", "comp"), "c")
        pairs = _asked(now, tried, turn, percent)
        found = verified(pairs, sets, percent)
        tried = tried.union(pairs.select("a", "b")).union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if found.isEmpty():
            break
        # components so far, and what is new
        links = labelled.where("c != comp").select(F.col("c").alias("a"), F.col("comp").alias("b")).union(found)
        before, labelled = labelled, _labelled(links, classes_of)
        drop_settled(before)
    drop_settled(alike)
    swept(docs.sparkSession)

    # what lies between the components so far
    listed = settle(_between(heavy.select("gid", F.posexplode("prefix").alias("at", "key")), "gid", "gid"), "listed")
    ends = settle(heavy.select("gid", "n", F.element_at("prefix", -1).alias("end"), F.size("prefix").alias("p")).distinct(), "ends")
    drop_settled(sketches)
    swept(docs.sparkSession)
    spread = labelled.groupBy("gid").agg(F.first("n").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    # a group stands in a list once for each task that met it
    listed_of = listed.distinct().join(spread, "gid").select("key", "at", "gid", "n", "lo", "hi")
    # a group with classes of several components stands alone
    mixed = _between(listed_of, "lo", "hi").select("key", "at", F.col("gid").alias("id"), "n", (F.col("lo") != F.col("hi")).alias("alone"), F.col("lo").alias("comp"))
    mixed = settle(mixed, "mixed")
    drop_settled(listed)
    met, near_large = _met(mixed, percent)
    of_a = ends.select(F.col("gid").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("end").alias("ea"))
    of_b = ends.select(F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("end").alias("eb"))
    most = F.col("c") + F.when(F.col("ea") <= F.col("eb"), F.col("na") - F.col("pa")).otherwise(F.col("nb") - F.col("pb"))
    close = met.join(of_a, "a").join(of_b, "b").where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")
    left = labelled.select(F.col("gid").alias("a"), F.col("c").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"))
    right = labelled.select(F.col("gid").alias("b"), F.col("c").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"))
    across = close.join(left, "a").join(right, "b").where("cx != cy").select("x", "y", "nx", "ny")
    several = spread.where("lo != hi").select(F.col("gid").alias("a"))
    within = left.join(several, "a", "left_semi").join(right, F.col("a") == F.col("b")).where("x < y and cx != cy").select("x", "y", "nx", "ny")
    pairs = across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("m"))
    pairs = settle(pairs.distinct(), "candidates")
    blocks = blocks_of(near_large, labelled)
    drop_settled(mixed, met, near_large, ends)
    rest = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(blocks.select("c")).distinct().join(fetched, "c", "left_anti")
    more = sets_of(docs, classes.join(rest, "c", "left_semi").select("c", "id", "sig"), width)
    sets = sets.union(more)
    found = sets.join(no_more_than(blocks, SENT // 4), "c").groupBy("large", "p", "q").applyInPandas(tidied_groups(_first_links(percent)), "a bigint, b bigint")
    found = verified(pairs, sets, percent).union(settle(found, "links"))
    links = labelled.where("c != comp").select(F.col("c").alias("a"), F.col("comp").alias("b")).union(found)
    drop_settled(pairs, blocks)
    last = _labelled(links, classes.select("c", "n", "id", "sig"))
    swept(docs.sparkSession)

    smallest = last.groupBy("comp").agg(F.min("id").alias("component"))
    of = settle(last.join(smallest, "comp").select("sig", "c", "n", "component", "comp"), "of")
    named_id = F.col("id").isNotNull()
    if not with_links:
        found = F.when(named_id, F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
        return rows.join(of.select("sig", "component"), "sig", "left").select(F.col("id").alias(key), F.col("n").cast("bigint").alias("n_shingles"), found.alias("component_id"))
    held = named.select("id", "sig").distinct().join(texts.select("id", "texts").distinct(), "id", "left")
    held = settle(held.join(of.select("sig", "c"), "sig").select("id", "c", F.coalesce("texts", F.lit(1)).alias("texts")), "held")
    one, many = link_counts(held, of.select("c", "n", F.col("comp").alias("component")), sets, percent)
    rows = rows.join(of.select("sig", "c", "component").join(one, "c"), "sig", "left")
    number = F.col("n_links")
    if many is not None:
        rows = rows.join(many.withColumnRenamed("n_links", "n_many"), "id", "left")
        number = F.coalesce("n_many", number)
    there = named_id & (F.col("n") > 0)
    return rows.select(
        F.col("id").alias(key), F.col("n").cast("bigint").alias("n_shingles"), F.when(there, F.col("component")).when(named_id, F.col("id")).alias("component_id"),
        F.when(there, number).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), with_links=True)


def _rows_of_each(docs: DataFrame) -> DataFrame:
    """Rows but for near copies, each row by itself: of each component the row with the smallest doc_id and text hash."""
    (row, gone) = fresh(docs.columns, "row", "gone")
    rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id())
    rows = settle(rows, "rows")
    found = settle(near_duplicates(rows, key=row).where(f"`{row}` != component_id").select(F.col(f"`{row}`").alias(gone)), "gone")
    return rows.join(no_more_than(found, SENT), rows[row] == F.col(gone), "left_anti").drop(row)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents but for near copies: of each component the one with the smallest doc_id, once.

    Where a doc_id has several rows, each text is judged by itself, and of rows with one id and text one stays. Rows without
    a doc_id are compared with each other only. Texts move only where ids repeat or more than SENT documents go.
    """
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    (gone,) = fresh(docs.columns, "gone")
    if known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = settle(near_duplicates(known).where("doc_id != component_id").select(F.col("doc_id").alias(gone)), "gone")
        kept = known.join(no_more_than(found, SENT), known["doc_id"] == F.col(gone), "left_anti")
    else:
        (nth,) = fresh(docs.columns, "nth")
        once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
        kept = _rows_of_each(known.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).drop(nth))
    return kept if unknown.isEmpty() else kept.union(_rows_of_each(unknown))
