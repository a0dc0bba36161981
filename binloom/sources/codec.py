"""Binary encoding of histograms, plain and compressed.

Plain, big-endian: cookie, payload length, normalizing offset 0 (32 bits each), significant digits (32), low, high (64
each), ratio 1.0 (64-bit float), then counts up to the largest bin. A count is a zig-zag number in 7-bit groups, low
groups first, the ninth byte whole; a negative one stands for that many empty bins, a single empty bin is 0. Compressed:
another cookie, length, a zlib stream of the plain form. The numbers of many histograms are written and read at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..geometry import U64, Geometry
from ..operators.hist import CAPS, Histograms, packed, renamed

#: Fixed: the cookies of the two forms.
PLAIN, COMPRESSED = 0x1C849313, 0x1C849314
HEADER = ">IIIIQQd"
HEADER_SIZE = struct.calcsize(HEADER)
BINS = "array<struct<bin:int,cnt:decimal(20,0)>>"
DECODED = f"low decimal(20,0), high decimal(20,0), sigfig int, total decimal(20,0), bins {BINS}"


def zigzag(n: int) -> int:
    return ((n << 1) ^ (n >> 63)) & U64


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def varint(n: int) -> bytes:
    """1 to 9 bytes; eight with a flag for more, the ninth without."""
    out = bytearray()
    for _ in range(8):
        if n < 0x80:
            out.append(n)
            return bytes(out)
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number, and where the next one starts."""
    n = 0
    for k in range(9):
        if at >= len(data):
            raise errors.Truncated("the counts end within a number")
        byte = data[at]
        at += 1
        if k == 8:
            return n | byte << 56, at
        n |= (byte & 0x7F) << 7 * k
        if byte < 0x80:
            return n, at
    raise AssertionError


def _groups(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers (64 bits, unsigned), one after another, and how many each has."""
    size = 1 + sum((n >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 9))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        byte = n[at] >> np.uint64(7 * k)
        if k < 8:
            byte = byte & np.uint64(0x7F) | np.where(size[at] > k + 1, np.uint64(0x80), np.uint64(0))
        out[start[at] + k] = byte
    return out, size


def payloads(bins: np.ndarray, counts: np.ndarray, many: np.ndarray) -> list[bytes]:
    """The counts of several histograms, with so many bins each, none of them empty: bins in order, counts below 2^63."""
    first = np.zeros(len(bins), bool)
    first[(np.cumsum(many) - many)[many > 0]] = True
    gap = bins - np.where(first, 0, np.concatenate([[0], bins[:-1] + 1])[: len(bins)])
    numbers = np.empty(2 * len(bins), np.uint64)
    numbers[::2] = np.where(gap == 1, 0, 2 * gap - 1)
    numbers[1::2] = counts.astype(np.uint64) << np.uint64(1)
    there = np.ones(len(numbers), bool)
    there[::2] = gap > 0
    data, size = _groups(numbers[there])
    of = np.repeat(np.repeat(np.arange(len(many)), many), 2)[there]
    ends = np.cumsum(np.bincount(of, size, len(many)).astype(np.int64)).tolist()
    whole = data.tobytes()
    return [whole[a:b] or b"\0" for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _framed(payload: bytes, g: Geometry, compress: bool, level: int = -1) -> bytes:
    plain = struct.pack(HEADER, PLAIN, len(payload), 0, g.sigfig, g.low, g.high, 1.0) + payload
    if not compress:
        return plain
    body = zlib.compress(plain, level)
    return struct.pack(">II", COMPRESSED, len(body)) + body


def encode(bins: Iterable[tuple[int, int]], geometry: Geometry, compress: bool = False, level: int = -1) -> bytes:
    """bins: (bin, count) in order, none of them empty."""
    pairs = [*bins]
    for _, count in pairs:
        if count > 2**63 - 1:
            raise errors.CountNotSerializable(f"count {count} exceeds 63 bits")
    at, counts = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return _framed(payloads(at, counts, np.array([len(pairs)]))[0], geometry, compress, level)


def numbers_of(data: bytes) -> np.ndarray:
    """All signed numbers of a payload."""
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x < 0x80)
    size = np.diff(ends, prepend=-1)
    if not len(x):
        return np.empty(0, np.int64)
    if size.max(initial=0) > 8 or not len(ends) or ends[-1] + 1 < len(x):
        # a ninth byte ends a number whatever it is
        out, at = [], 0
        while at < len(data):
            n, at = read_varint(data, at)
            out.append(n)
        n = np.array(out, np.uint64)
    else:
        start, n = ends - size + 1, np.zeros(len(ends), np.uint64)
        for k in range(int(size.max())):
            at = np.flatnonzero(size > k)
            n[at] |= (x[start[at] + k].astype(np.uint64) & np.uint64(0x7F)) << np.uint64(7 * k)
    return (n >> np.uint64(1)).view(np.int64) ^ -(n & np.uint64(1)).view(np.int64)


def decode_arrays(data: bytes, counter: str = "u64") -> tuple[Geometry, np.ndarray, np.ndarray]:
    """Geometry, and bins and counts of those that aren't empty, of either form."""
    if len(data) < 8:
        raise errors.Truncated("no header")
    cookie, length = struct.unpack_from(">II", data)
    if cookie == COMPRESSED:
        if len(data) < 8 + length:
            raise errors.Truncated("the compressed part is cut off")
        try:
            data = zlib.decompress(data[8 : 8 + length])
        except zlib.error as bad:
            raise errors.Truncated(str(bad)) from bad
        if len(data) < 8 or struct.unpack_from(">I", data)[0] != PLAIN:
            raise errors.InvalidCookie("no plain form inside the compressed one")
    elif cookie != PLAIN:
        raise errors.InvalidCookie(hex(cookie))
    if len(data) < HEADER_SIZE:
        raise errors.Truncated("no header")
    _, length, offset, sigfig, low, high, ratio = struct.unpack_from(HEADER, data)
    if offset != 0 or ratio != 1.0:
        raise errors.UnsupportedFeature("normalizing offset or conversion ratio")
    try:
        g = Geometry(low, high, sigfig)
    except errors.CreationError as bad:
        raise errors.InvalidParameters(str(bad)) from bad
    payload = data[HEADER_SIZE : HEADER_SIZE + length]
    if len(payload) < length:
        raise errors.Truncated("the counts are cut off")
    n = numbers_of(payload)
    # a negative number skips bins, any other is the next bin's count
    step = np.where(n < 0, np.where(n < -g.bins, g.bins + 1, -n), 1)
    after = np.cumsum(step)
    large, beyond = n > min(CAPS[counter], 2**63 - 1), after > g.bins
    wrong = np.flatnonzero(large | beyond)
    if len(wrong):
        if large[wrong[0]]:
            raise errors.UnsuitableCounterType(f"count {n[wrong[0]]} exceeds {counter}")
        raise errors.EncodedArrayTooLong(f"more than {g.bins} bins")
    there = n > 0
    return g, after[there] - 1, n[there]


def decode(data: bytes, counter: str = "u64") -> tuple[Geometry, list[tuple[int, int]]]:
    """Geometry and the bins that aren't empty, of either form."""
    g, bins, counts = decode_arrays(data, counter)
    return g, [*zip(bins.tolist(), counts.tolist(), strict=True)]


def encoded(h: Histograms, compress: bool = False, column: str = "payload") -> DataFrame:
    """One row per key with the histogram's bytes. An automatic geometry is written as it has grown."""
    g = h.geometry

    @F.arrow_udf("binary")
    def run(bins: pa.Array) -> pa.Array:
        many = np.diff(bins.offsets.to_numpy())
        flat = bins.flatten()
        at, counts = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
        last = at[np.cumsum(many) - 1].tolist()
        grown = [g.resized(g.highest(g.value_of(top))) if g.auto_resize and n else g for top, n in zip(last, many.tolist(), strict=True)]
        return pa.array([_framed(x, own, compress) for x, own in zip(payloads(at, counts, many), grown, strict=True)], pa.binary())

    p = h.plain()
    fits = F.when(F.col("b.cnt") < F.lit(Decimal(1 << 63)), F.col("b.cnt")).otherwise(F.raise_error(F.lit("CountNotSerializable: a count exceeds 63 bits")).cast("decimal(20,0)"))
    checked = p if h.counter != "u64" else p.with_bins(p.bins.select(F.struct(*p.bins.columns).alias("b")).select(*[F.col(f"b.{k}") for k in p.keys], "b.bin", fits.alias("cnt"), "b.n"))
    df = packed(checked)
    payload = run(F.transform("bins", lambda b: F.struct(b["bin"].alias("bin"), b["cnt"].cast("bigint").alias("cnt"))))
    return df.select(*[F.col(q).alias(k) for q, k in zip(p.keys, h.keys, strict=True)], payload.alias(column))


def decoded(payload: str | Column, counter: str = "u64") -> Column:
    """A payload (BINARY) to a struct of low, high, sigfig, total and bins. A bad payload fails the job with the error's name."""
    number = pa.decimal128(20, 0)

    @F.arrow_udf(DECODED)
    def run(data: pa.Array) -> pa.Array:
        heads, bins, counts, many = [], [], [], []
        for x in data.to_pylist():
            if x is None:
                heads.append((None, None, None, None))
                many.append(0)
                continue
            try:
                g, at, n = decode_arrays(x, counter)
            except errors.DeserializeError as bad:
                raise errors.DeserializeError(f"{type(bad).__name__}: {bad}") from bad
            heads.append((Decimal(g.low), Decimal(g.high), g.sigfig, Decimal(min(U64, sum(n.tolist())))))
            bins.append(at)
            counts.append(n)
            many.append(len(at))
        none = np.empty(0, np.int64)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *bins]), pa.int32()), pa.array(np.concatenate([none, *counts])).cast(number)], ["bin", "cnt"])
        missing = np.array([h[0] is None for h in heads], bool)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), flat, mask=pa.array(missing))
        columns = [pa.array([h[k] for h in heads], kind) for k, kind in enumerate((number, number, pa.int32(), number))]
        return pa.StructArray.from_arrays([*columns, lists], ["low", "high", "sigfig", "total", "bins"])

    return run(F.col(payload) if isinstance(payload, str) else payload)


def decoded_histograms(df: DataFrame, geometry: Geometry, payload: str = "payload", keys=()) -> Histograms:
    """Payloads that share a geometry, as one table of histograms; several of a key are added up."""
    keys = tuple(keys)
    plain = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*renamed(keys), decoded(payload).alias("d")).select(*plain, "d.low", "d.sigfig", F.explode("d.bins").alias("b"))
    fits = (F.col("low") == geometry.low) & (F.col("sigfig") == geometry.sigfig)
    at = F.when(fits, F.col("b.bin")).otherwise(F.raise_error(F.lit("UnsupportedFeature: payloads of another geometry")).cast("int"))
    bins = rows.select(*plain, at.alias("bin"), F.col("b.cnt").cast("bigint").alias("cnt")).groupBy(*plain, "bin").agg(F.sum("cnt").alias("cnt"))
    return Histograms(bins, geometry, tuple(plain)).named(keys)
