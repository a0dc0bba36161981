"""Packing tokenized documents into sequences of a fixed length by a configuration linear program.

Documents become pieces of at most `limit` tokens; only longer ones are cut. The number of pieces of each length (a
histogram of at most `limit` entries, so small at any size) is covered by configurations, multisets of lengths that fit
one sequence. The linear program (fewest sequences that cover the histogram) is solved by multiplicative weights: a
knapsack over all capacities prices configurations by the current weights, good ones are used, and the weights of what
they cover fall. Its solution is scaled back to the histogram, rounded down, then topped up while configurations still
fit; pieces that remain are placed best-fit, longest first, length by length. The program's dual gives a bound that no
packing can beat. Each piece finds its place by its rank among the pieces of its length; ranks come from counts per part of
a length, as many parts as its pieces need, so no length needs to be in one task.

Defined results: a null text counts as empty, a document of the end token alone; repeated rows are packed each; an empty
table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, give_back, read, settle, tidied

LIMIT = 4096
END = 1
#: Pieces of one length that are ranked in one task.
RANKED = 1024
ROUNDS = 45
#: Bytes of text that are tokenized at once; a task keeps the ids of a word for each KEPT bytes of them (200,000 words, about 35 MB).
#: LITTLE: the same where ids go on with their pieces, in executors that have much else to hold. Bytes of ids that go out at once.
CHUNK, LITTLE, KEPT, OUT = 4_000_000, 1_000_000, 20, 8_000_000
#: Runs that are gathered at once.
RUNS = 100_000
#: Punctuation at the end of a word, after a letter or digit; it is a token of its own. (U+0130 ends in a mark in lower case.)
TAILED = r"(?s)^(?P<stem>.*[A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])(?P<tail>[!-/:-@\[-`{-~]+)\z"
#: From here on characters may compose with the letter before them, in another way if that is lower-cased first.
COMPOSING = r"[^\x{0}-\x{2ff}]"


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    out, at = np.empty(int(size.sum()), flat.dtype), 0
    for i in range(0, len(size), RUNS):
        n = size[i : i + RUNS]
        many = int(n.sum())
        out[at : at + many] = flat[np.repeat(start[i : i + RUNS] - (np.cumsum(n) - n), n) + np.arange(many)]
        at += many
    return out


def word_by_word(tokenizer) -> bool:
    """Whether a text's ids are its words' ids in turn, whatever case ASCII letters have.

    So it is if the text is composed and lower-cased, and split into runs without white space that end in </w>.
    """
    state = lambda x: json.loads(x.__getstate__()) if x is not None else {"type": ""}
    parts = lambda x: x.get("normalizers") or x.get("pretokenizers") or [x]
    changes = [x["type"] for x in parts(state(tokenizer.normalizer))]
    first = parts(state(tokenizer.pre_tokenizer))[0]
    runs = first["type"] == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in (first.get("pattern") or {}).get("Regex", "")
    return changes == ["NFC", "Replace", "Lowercase"] and bool(runs) and getattr(tokenizer.model, "end_of_word_suffix", None) == "</w>"


def ending(tokenizer) -> np.ndarray:
    """Which tokens end a word, one bit each."""
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return np.packbits(ends)


class Words:
    """Ids of texts from the ids of their words, for tokenizers that word_by_word holds for. Words are looked up once a chunk."""

    def __init__(self, path: str, ends: np.ndarray | None = None):
        from tokenizers import Tokenizer

        self.most = CHUNK // KEPT
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.apart = word_by_word(self.tokenizer)
        self.ends = np.unpackbits(ending(self.tokenizer) if ends is None else ends).astype(bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, words: list[str]) -> None:
        """Add words that aren't known."""
        # letters only: many words at once, told apart by the tokens that end one
        letters, other, kept, ids, sizes = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()], [], [], []
        for k in range(0, len(letters), 1000):
            part = letters[k : k + 1000]
            found = np.array(self.encode([" ".join(part)])[0], np.uint32)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(part):  # a letter that isn't one to the tokenizer
                other += part
                continue
            kept += part
            ids.append(found)
            sizes.append(np.diff(cuts, prepend=0))
        for k in range(0, len(other), 10_000):
            part = other[k : k + 10_000]
            found = self.encode(part)
            kept += part
            ids.append(np.fromiter((i for x in found for i in x), np.uint32))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        if kept:
            size = np.concatenate(sizes)
            self.known.update(zip(kept, range(len(self.size), len(self.size) + len(kept)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, *ids])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words; those that aren't known are learned."""
        words = words.to_pylist()
        at = [*map(self.known.get, words)]
        if None in at:
            self.learn([w for w, k in zip(words, at, strict=True) if k is None])
            at = map(self.known.__getitem__, words)
        return np.fromiter(at, np.int64, len(words))

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, end after each, and the number of each text's."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        last = np.array([end], np.uint32)
        if not self.apart:
            found = [[*x, end] for x in self.encode(texts.to_pylist())]
            return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        words = pc.ascii_split_whitespace(texts)
        many = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        plain = pc.if_else(pc.match_substring_regex(coded.dictionary, COMPOSING), coded.dictionary, pc.ascii_lower(coded.dictionary)).dictionary_encode()
        tailed = pc.match_substring_regex(plain.dictionary, TAILED)
        cut = pc.extract_regex(plain.dictionary.filter(tailed), TAILED)
        tailed = tailed.to_numpy(zero_copy_only=False)
        stems = pa.concat_arrays([plain.dictionary.filter(pa.array(~tailed)), cut.field("stem")]).dictionary_encode()
        tails = cut.field("tail").dictionary_encode()
        if len(self.known) > self.most:
            self.forget()
        stem, tail = self.numbers(stems.dictionary), self.numbers(tails.dictionary)
        both = np.zeros(2 * len(tailed), np.int64)
        stem = stem[stems.indices.to_numpy()]
        both[2 * np.flatnonzero(~tailed)], both[2 * np.flatnonzero(tailed)] = np.split(stem, [len(stem) - int(tailed.sum())])
        both[2 * np.flatnonzero(tailed) + 1] = tail[tails.indices.to_numpy()]
        # each distinct word's ids, and the end's, one after another
        flat = np.concatenate([gathered(self.flat, self.start[both], self.size[both]), last])
        size = np.append(self.size[both[::2]] + self.size[both[1::2]], 1)
        start = np.cumsum(size) - size
        at = plain.indices.to_numpy()[coded.indices.to_numpy()]
        ends = np.cumsum(many)
        at = np.insert(at, ends, len(size) - 1)
        each = size[at]
        total = np.concatenate([[0], np.cumsum(each)])
        return gathered(flat, start[at], each), np.diff(total[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])])


def _kept_tokenizer(path: str, ends: np.ndarray | None = None) -> Words:
    """A process's tokenizer, which doesn't change; what a task has learned goes with the task."""
    import sys
    import types

    at = sys.modules.setdefault("_binloom_tokenizers", types.ModuleType("_binloom_tokenizers"))
    if path not in at.__dict__:
        setattr(at, path, Words(path, ends))
        give_back()
    return at.__dict__[path]


def _cut(path: str, limit: int, end: int, chunk: int, ends: np.ndarray | None = None):
    """ends: what ending() says, so that executors needn't have the vocabulary as Python objects."""

    def cut(words: Words, keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        ids, n = words.ids(texts, end)
        parts = -(-n // limit)
        row = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * limit
        length = np.minimum(limit, n[row] - start)
        at = np.concatenate([[0], np.cumsum(length)])
        step = max(1, OUT // (4 * limit))
        for i in range(0, len(row), step):
            part = slice(i, i + step)
            held = ids[at[i] : at[min(i + step, len(row))]].astype("<u4")
            offsets = ((at[i : i + step + 1] - at[i]) * 4).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held)])
            ints = [pa.array(piece[part].astype(np.int32)), pa.array(start[part]), pa.array(length[part])]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[part])), *ints, data], ["key", "piece", "start", "length", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _kept_tokenizer(path, ends)
        words.most = chunk // KEPT
        try:
            for batch in batches:
                size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
                i = 0
                while i < batch.num_rows:
                    j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + chunk, "right")))
                    yield from cut(words, batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i))
                    i = j
                batch = None  # before the next one comes
        finally:
            words.forget()

    return run


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END, chunk: int = CHUNK) -> DataFrame:
    """(key, piece, start, length, ids): the token ids of every text and the end token, cut every `limit`. ids: little-endian 32-bit."""
    from tokenizers import Tokenizer

    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    out = docs.mapInArrow(tidied(_cut(tokenizer, limit, end, chunk, ending(Tokenizer.from_file(tokenizer)))), "key bigint, piece int, start bigint, length bigint, ids binary")
    return out.withColumnRenamed("key", key)


def _priced(value: np.ndarray, need: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounded knapsack over every capacity: lengths and numbers of the items, and which items each capacity takes."""
    items = []
    for x in map(int, np.flatnonzero(need)):
        rest, k = min(int(need[x]), limit // x), 1
        while rest > 0:
            k = min(k, rest)
            items.append((x, k))
            rest, k = rest - k, 2 * k
    best, takes = np.zeros(limit + 1), np.zeros((len(items), limit + 1), bool)
    for i, (x, k) in enumerate(items):
        with_it = best[: limit + 1 - x * k] + k * value[x]
        np.greater(with_it, best[x * k :], out=takes[i, x * k :])
        best[x * k :] = np.maximum(with_it, best[x * k :])
    return np.array(items, np.int64), takes, best


def _filling(items: np.ndarray, takes: np.ndarray, room: int) -> dict[int, int]:
    config, i = {}, len(items)
    while room > 0 and (found := np.flatnonzero(takes[:i, room])).size:
        i = int(found[-1])
        x, k = items[i].tolist()
        config[x] = config.get(x, 0) + k
        room -= x * k
    return config


class Plan(NamedTuple):
    """Configurations ({length: number}, times), how many of the pieces the linear program placed, and what any packing needs.

    The bound is the program's dual: weights of the lengths, over the best filling that they allow a sequence.
    """

    configurations: list[tuple[dict[int, int], int]]
    by_program: int
    bound: float


def configurations(counts: dict[int, int], limit: int = LIMIT, rounds: int = ROUNDS, phases: int = 3, rate: float = 0.03) -> Plan:
    """A plan that holds each length exactly as often as counts has it.

    A phase covers the whole histogram once, as far as its share of the knapsacks goes: each knapsack prices the best
    filling of every room that a longest piece (a head) can leave, and serves heads until their fillings run out. Weights
    fall with use, so that a later phase prefers what earlier ones combined less. The mean of the phases solves the
    linear program; it is rounded down, then topped up while its configurations still fit, fullest first.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[dict[int, int], int]] = []
    alone = int(left[limit])
    if alone:
        plan.append(({limit: 1}, alone))
        left[limit] = 0
    there = np.flatnonzero(left)
    # long pieces are dearer than their share: they have fewer places
    value = np.zeros(limit + 1)
    value[there] = there / limit * (1 + 0.05 * there / limit)
    demand, used, bound = left.copy(), {}, float(there @ left[there]) / limit
    for _ in range(phases if len(there) else 0):
        need = left.copy()
        for turn in range(rounds // phases):
            heads = np.flatnonzero(need)[::-1]
            if not len(heads):
                break
            items, takes, best = _priced(value, need, limit)
            if not turn:
                bound = max(bound, float(value @ left) / float(best[limit]))
            for head in map(int, heads):
                if not need[head]:
                    continue
                config = _filling(items, takes, limit - head)
                config[head] = config.get(head, 0) + 1
                amount = min(int(need[x]) // k for x, k in config.items())
                if amount > 0:
                    key = tuple(sorted(config.items()))
                    used[key] = used.get(key, 0) + amount
                    for x, k in config.items():
                        need[x] -= k * amount
                        value[x] *= np.exp(-rate * k * amount / demand[x])
    room = lambda config: limit - sum(x * k for x, k in config)
    order = sorted(used, key=lambda config: (room(config), -config[-1][0], config))
    for down in (True, False):
        for config in order:
            times = min(int(left[x]) // k for x, k in config)
            times = min(times, used[config] // phases) if down else times
            if times > 0:
                plan.append((dict(config), times))
                for x, k in config:
                    left[x] -= k * times
    by_program = int(demand.sum() - left.sum()) + alone
    while left.any():
        config, c = {}, limit
        while c > 0 and (fits := np.flatnonzero(left[: c + 1])).size:
            x = int(fits[-1])
            k = min(int(left[x]) - config.get(x, 0), c // x)
            if k <= 0:
                break
            config[x] = k
            c -= k * x
            left_x, left[x] = left[x], 0
            config[-x] = int(left_x)  # put back below
        for x in [x for x in config if x < 0]:
            left[-x] = config.pop(x)
        times = min(int(left[x]) // k for x, k in config.items())
        plan.append((config, times))
        for x, k in config.items():
            left[x] -= k * times
    return Plan(plan, by_program, alone + bound)


def _places(plan: list[tuple[dict[int, int], int]], limit: int) -> list[np.ndarray]:
    """Segments of each length's ranks, by length and first rank: key, slots a sequence, first sequence, first offset."""
    rank, sequence, out = {}, 0, []
    for config, times in plan:
        offset = 0
        for x, k in sorted(config.items(), reverse=True):
            first = rank.get(x, 0)
            out.append(((x << 44) + first, k, sequence, offset))
            rank[x] = first + k * times
            offset += k * x
        sequence += times
    return [np.array(c, np.int64) for c in zip(*sorted(out), strict=True)] if out else [np.empty(0, np.int64)] * 4


def pack(cut: DataFrame, limit: int = LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """Pieces (length and any other columns) with sequence_id and offset. cut is read twice, for its lengths and to be placed.

    The plan that goes to the executors has at most a few numbers for each configuration and length, whatever the input.
    """
    spark, names = cut.sparkSession, [c for c in cut.columns if c not in ("sequence_id", "offset")]
    hashed, salts, salt, nth, ahead = fresh(names, "hash", "salts", "salt", "nth", "before")
    columns = [F.col(f"`{c}`") for c in names]
    cut = cut.select(*columns, F.xxhash64(*columns).alias(hashed))
    small = settle(cut.select("length", hashed), "lengths")
    counts = {r["length"]: r["n"] for r in small.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = configurations(counts, limit, rounds)
    segments = _places(plan.configurations, limit)
    # a row for each length: as many parts as its pieces need
    parts = spark.createDataFrame([(x, -(-n // RANKED)) for x, n in counts.items()], f"length bigint, {salts} bigint")
    dealt = lambda df: df.join(F.broadcast(parts), "length").withColumn(salt, F.pmod(hashed, salts))
    sizes = dealt(small).groupBy("length", salt).agg(F.count("*").alias("n"))
    by_salt = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", salt, F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias(ahead))
    order = [F.col(hashed), *(F.col(f"`{c}`") for c in names if c != "length")]
    ranked = dealt(cut).withColumn(nth, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)))
    ranked = ranked.join(before, ["length", salt]).select(*columns, (F.col(ahead) + F.col(nth) - 1).alias(nth))
    held = spark.sparkContext.broadcast(segments)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, slots, sequence, offset = held.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column(nth).to_numpy()
            j = np.searchsorted(key, (length << 44) + rank, "right") - 1
            turn = rank - (key[j] & ((1 << 44) - 1))
            at = [pa.array(sequence[j] + turn // slots[j]), pa.array(offset[j] + turn % slots[j] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *at], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != hashed)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, derived: dict[str, Column] | None = None, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) to one row per piece, with its place; derived: columns made from the ids before these are dropped.

    None keeps the ids themselves; texts are then tokenized twice rather than their ids stored in between.
    """
    if derived is None:
        return pack(pieces(docs, tokenizer, limit=limit, chunk=LITTLE), limit)
    cut = pieces(docs, tokenizer, limit=limit)
    cut = cut.select("doc_id", "piece", "start", "length", *[c.alias(name) for name, c in derived.items()])
    return pack(settle(cut, "pieces"), limit)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), {"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
