"""Document likelihood under a subword lattice.

The pieces of an existing vocabulary and their scores span every segmentation of a text. A word is a mark and its bytes; no
piece reaches over a mark, so a text's segmentations are its words' in turn, and the end of a text is a piece of its own. A
piece's probability begins as its score (as a rank, read as Zipf's law) and takes up the expected number of its uses in the
training documents, by forward and backward recursions over all segmentations (EM, ROUNDS times). Probabilities sum to 1
over all pieces, so a text's score is the log10 of the sum over its segmentations of their pieces' product: the marginal
probability of the text, by a forward recursion in log space. Words outside the vocabulary are bytes, which are pieces too.
Beside it stands word_score, of a lattice that has each training word as one more edge over all of it, with an absolute
discount that goes to the pieces: closer to the corpus, but most of it isn't the vocabulary's.

Texts are read once: blocks of documents become lists of indices into the block's own dictionary. Dictionaries (one row
per block and word) meet the counts and scores of all words and go back to their block, so what moves is far less than
the tokens, no word is hot beyond one row a block, and no table of words is gathered anywhere. Every distinct word is
segmented once a round, many words of a length at a time.

Defined results: a null or empty text is the end alone; repeated rows are scored each (and counted each in training); a null
doc_id counts as the empty text, so it is held out. Without training tokens the vocabulary's scores alone remain. ASCII
letters count without case; what isn't valid UTF-8 counts as "?".
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_settled, read, settle, tidied

#: Characters of text in a block.
BLOCK = 16_000_000
MARK = "▁"
#: Pseudo-count of the vocabulary's own scores, the end's share of them, and rounds of re-estimation.
PRIOR, LONE_END, ROUNDS = 16_000.0, 1e-3, 3
#: Words that are segmented at once, and bytes of a word from which on it is segmented by itself.
AT_ONCE, LONG = 100_000, 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (key, held, text) as rows of two kinds: word rows (block, word, at, c: count in training texts), and document rows."""
    coded = [("key", pa.int64()), ("held", pa.bool_()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary())]
    schema = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("at", pa.int32()), ("c", pa.int64()), *coded])

    def rows(**columns) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def block_of(block: int, keys: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
        docs, every, train = [], Counter(), Counter()
        for h, text in zip(held, texts, strict=True):
            words = Counter((text or "").encode("utf-8", "replace").lower().split())
            words[b""] = 1
            docs.append(words)
            every.update(words.keys())
            if not h:
                train.update(words)
        # frequent words first: their indices are small and compress
        listed = [w for w, _ in every.most_common()]
        at = {w: k for k, w in enumerate(listed)}
        for k in range(0, len(listed), 50_000):
            ws = listed[k : k + 50_000]
            yield rows(block=[block] * len(ws), word=ws, at=range(k, k + len(ws)), c=[train[w] for w in ws])
        for k in range(0, len(docs), 1000):
            low, high, counts = [], [], []
            for words in docs[k : k + 1000]:
                index = np.fromiter(map(at.__getitem__, words), np.uint32, len(words))
                order = np.argsort(index)
                index = index[order]
                low.append((index & 0xFFFF).astype("<u2").tobytes())
                high.append((index >> 16).astype("<u2").tobytes())
                counts.append(np.fromiter(words.values(), np.uint32, len(words))[order].astype("<u4").tobytes())
            part = slice(k, k + len(low))
            yield rows(block=[block] * len(low), key=keys[part], held=held[part], low=low, high=high, n=counts)

    block = TaskContext.get().partitionId() << 24
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        start, size = 0, 0
        for i, text in enumerate(columns[2]):
            size += len(text or "")
            if size >= BLOCK or i + 1 == len(columns[2]):
                yield from block_of(block, *(c[start : i + 1] for c in columns))
                block, start, size = block + 1, i + 1, 0


def vocabulary(path: str) -> list[tuple[bytes | None, float]]:
    """(bytes, rank) of each id of a sentencepiece model; None for ids that no text has."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: list[tuple[bytes | None, float]] = []
    for i in range(sp.get_piece_size()):
        if sp.id_to_piece(i) == MARK:  # a word may begin with any piece after it
            out.append((MARK.encode(), float(sp.get_piece_size())))
        elif sp.is_byte(i):
            out.append((bytes([int(sp.id_to_piece(i)[1:-1], 16)]), float(sp.get_piece_size())))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.get_score(i) < -1e8:
            out.append((None, 0.0))
        else:
            out.append((sp.id_to_piece(i).encode(), -sp.get_score(i)))
    return out


def prior_counts(pieces: list[tuple[bytes | None, float]]) -> dict[bytes, float]:
    """PRIOR pseudo-counts dealt over the pieces by Zipf's law of their ranks. A byte and a piece of one byte are one edge."""
    weight: dict[bytes, float] = {}
    for piece, rank in pieces:
        if piece:
            weight[piece] = weight.get(piece, 0.0) + 1 / (rank + 10)
    total = sum(weight.values())
    return {piece: PRIOR * x / total for piece, x in weight.items()}


class Lattice:
    """Log probability of words (without their mark), all segmentations summed, and expected uses of the pieces."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        mark = MARK.encode()
        self.log_p = log_p
        self.pieces = {piece: i for i, piece in enumerate(pieces)}
        self.mark = self.pieces.get(mark)
        self.first = self._table({p[len(mark) :]: i for p, i in self.pieces.items() if p.startswith(mark) and p != mark})
        self.inner = self._table({p: i for p, i in self.pieces.items() if not p.startswith(mark)})

    @staticmethod
    def _table(pieces: dict[bytes, int]) -> tuple:
        """Sorted hashes, the piece of each, which leading bits occur, the longest piece, and the pieces themselves."""
        h = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        there = np.zeros(1 << 20, bool)
        there[h >> np.uint64(44)] = True
        return h[order], np.array([*pieces.values()], np.int64)[order], there, max(map(len, pieces), default=0), pieces

    def _edges(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Edges of the lattices of words of one length, by their beginning: from, to, words, pieces. From is -1 before the mark."""
        m, n = x.shape
        if self.mark is not None:
            yield -1, 0, np.arange(m), np.full(m, self.mark)
        for i in range(-1, n):
            hashes, pieces, there, longest, _ = self.first if i < 0 else self.inner
            begin = max(i, 0)
            h = np.zeros(m, np.uint64)
            for j in range(begin + 1, min(n, begin + longest) + 1):
                h = (h + x[:, j - 1] + np.uint64(1)) * MULTIPLIER
                rows = np.flatnonzero(there[h >> np.uint64(44)])
                at = np.minimum(np.searchsorted(hashes, h[rows]), len(hashes) - 1)
                same = hashes[at] == h[rows]
                if same.any():
                    yield i, j, rows[same], pieces[at[same]]

    def _long_edges(self, word: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The same for one word."""
        one = np.zeros(1, np.int64)
        if self.mark is not None:
            yield -1, 0, one, np.array([self.mark])
        for i in range(-1, len(word)):
            *_, longest, pieces = self.first if i < 0 else self.inner
            begin = max(i, 0)
            for j in range(begin + 1, min(len(word), begin + longest) + 1):
                if (piece := pieces.get(word[begin:j])) is not None:
                    yield i, j, one, np.array([piece])

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, int, Iterator]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            n = int(size[part[0]])
            if n > LONG:
                for k in part:
                    yield np.array([k]), n, self._long_edges(words[k])
            else:
                x = np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), n).astype(np.uint64)
                yield part, n, self._edges(x)

    def _forward(self, m: int, n: int, edges) -> np.ndarray:
        f = np.full((n + 1, m), -np.inf)
        for i, j, rows, pieces in edges:
            p = self.log_p[pieces]
            f[j, rows] = np.logaddexp(f[j, rows], p if i < 0 else f[i, rows] + p)
        return f

    def __call__(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for part, n, edges in self._groups(words):
            out[part] = self._forward(len(part), n, edges)[n]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in so many of each word."""
        out = np.zeros(len(self.log_p))
        for part, n, edges in self._groups(words):
            edges = [*edges]
            f = self._forward(len(part), n, edges)
            b = np.full((n + 1, len(part)), -np.inf)
            b[n] = 0
            whole, weight = f[n], times[part]
            for i, j, rows, pieces in reversed(edges):
                behind = self.log_p[pieces] + b[j, rows]
                if i >= 0:
                    b[i, rows] = np.logaddexp(b[i, rows], behind)
                before = behind + f[i, rows] if i >= 0 else behind
                there = np.isfinite(whole[rows])
                out += np.bincount(pieces[there], np.exp(before[there] - whole[rows[there]]) * weight[rows[there]], len(out))
        return out


def _hash(piece: bytes) -> int:
    h = 0
    for byte in piece:
        h = (h + byte + 1) * int(MULTIPLIER) & (1 << 64) - 1
    return h


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to about AT_ONCE rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _uses(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        out = np.zeros(len(lattice.log_p))
        for table in _together(batches):
            out += lattice.expected(table["word"].to_pylist(), table["c"].to_numpy().astype(float))
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], ["piece", "uses"])

    return run


def _word_scores(model):
    """Natural log of each word's probability, the empty word being the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, end = Lattice(*model.value[:2]), model.value[2]
        for table in _together(batches):
            words = table["word"].to_pylist()
            p = lattice(words)
            p[[i for i, w in enumerate(words) if not w]] = end
            for batch in table.append_column("p", pa.array(p)).to_batches():
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("p")], ["word", "c", "p"])

    return run


def _document_scores(tokens: int, kinds: int, discount: float):
    """One block: its dictionary with scores, its documents. Of the training: tokens, their kinds, and what seen words leave to unseen ones."""

    def run(words, docs):
        import pandas as pd

        at = np.argsort(words["at"].to_numpy())
        p, c = words["p"].to_numpy(float)[at], words["c"].to_numpy()[at]
        known, base = c > 0, np.log10(c + 0.1)
        whole = p
        if tokens:
            with np.errstate(divide="ignore"):
                whole = np.logaddexp(np.log(np.maximum(c - discount, 0) / tokens), math.log(discount * kinds / tokens) + p)
        p, whole, rows = p / math.log(10), whole / math.log(10), []
        for low, high, n in zip(docs["low"], docs["high"], docs["n"], strict=True):
            i = np.frombuffer(low, "<u2").astype(np.int64) + (np.frombuffer(high, "<u2").astype(np.int64) << 16)
            k = np.frombuffer(n, "<u4").astype(np.int64)
            rows.append((int(k.sum()), int(k[known[i]].sum()), float(k @ base[i]), float(k @ p[i]), float(k @ whole[i])))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "score", "word_score"])
        out.insert(0, "held_out", docs["held"].to_numpy())
        out.insert(0, "key", docs["key"].astype("Int64").to_numpy())
        return out

    return run


def score_documents(docs: DataFrame, held_out: Column, model: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score) of every row; training rows are those not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), held_out.alias("held"), F.col(f"`{text}`").alias("text"))
    schema = "block bigint, word binary, at int, c bigint, key bigint, held boolean, low binary, high binary, n binary"
    encoded = settle(rows.mapInArrow(tidied(_encoded), schema), "blocks")
    dictionary = encoded.where("word is not null").select("block", "word", "at", "c")
    words = settle(dictionary.groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))
    sums = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"), ends.alias("docs"),
    ).first()
    discount = min(0.9, max(0.1, sums["once"] / (sums["once"] + 2 * sums["twice"]))) if sums["once"] else 0.5

    prior = prior_counts(vocabulary(model))
    pieces, counts = [*prior], np.array([*prior.values()])
    training = words.where("c > 0 and octet_length(word) > 0")

    def probabilities(uses: np.ndarray) -> tuple[list[bytes], np.ndarray, float]:
        """Pieces, their log probabilities and the end's, which together sum to 1."""
        end = sums["docs"] + PRIOR * LONE_END
        total = counts.sum() + uses.sum() + end
        return pieces, np.log((counts + uses) / total), math.log(end / total)

    now = probabilities(np.zeros(len(pieces)))
    for _ in range(rounds if sums["n"] else 0):
        held = spark.sparkContext.broadcast(now[:2])
        found = training.mapInArrow(tidied(_uses(held)), "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros(len(pieces))
        # one row per piece of the vocabulary at most
        for r in found.collect():
            uses[r["piece"]] = r["uses"]
        now = probabilities(uses)
    scored = settle(words.mapInArrow(tidied(_word_scores(spark.sparkContext.broadcast(now))), "word binary, c bigint, p double"), "scores")
    drop_settled(words)

    answers = dictionary.select("block", "word", "at").join(scored, "word").select("block", "at", "c", "p")
    texts = encoded.where("word is null").select(F.col("block").alias("of"), "key", "held", "low", "high", "n")
    out = answers.groupBy("block").cogroup(texts.groupBy("of")).applyInPandas(
        _document_scores(sums["n"], sums["v"], discount), "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word_score double"
    )
    per_token = math.log10(sums["n"] + 0.1 * (sums["v"] + 1))
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(sums["n"]).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score", "word_score",
    )


def crc_remainder(key: str, divisor: int) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % divisor


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), crc_remainder("doc_id", 10) == 0, piece_model())
