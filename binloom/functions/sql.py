"""The geometry's expressions as SQL functions of a session, and the codec as table functions.

register(spark, geometry, "lat") makes, for SQL text: lat_index(v), lat_low(bin), lat_high(bin), lat_median(bin), lat_width(bin),
and the table functions lat_decode(payload), a row for each bin of an encoded histogram, and lat_encode(bins), its inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..geometry import Geometry
from ..sources.codec import decode, encode


def _index(g: Geometry) -> str:
    bucket = f"(length(bin(v | {g.mask if g.mask < 1 << 63 else g.mask - (1 << 64)}L)) - {g.unit_bits + g.sub_bits})"
    return f"cast(({bucket} + 1) * {g.half} + shiftrightunsigned(v, {bucket} + {g.unit_bits}) - {g.half} as int)"


def _shift(g: Geometry) -> str:
    return f"(greatest(cast(i as bigint) div {g.half} - 1, 0) + {g.unit_bits})"


def _low(g: Geometry) -> str:
    return f"shiftleft(cast(i as bigint) % {g.half} + if(i < {g.half}, 0, {g.half}), cast({_shift(g)} as int))"


def expressions(g: Geometry) -> dict[str, tuple[str, str, str]]:
    """name: (parameter, type of the result, SQL)."""
    width = f"shiftleft(1L, cast({_shift(g)} as int))"
    return {
        "index": ("v bigint", "int", _index(g)),
        "low": ("i int", "bigint", _low(g)),
        "width": ("i int", "bigint", width),
        "high": ("i int", "bigint", f"{_low(g)} + ({width} - 1)"),
        "median": ("i int", "bigint", f"{_low(g)} + shiftrightunsigned({width}, 1)"),
    }


class Decode:
    """A payload to its bins."""

    def eval(self, payload: bytes) -> Iterator[tuple[int, int]]:
        if payload is not None:
            yield from decode(bytes(payload))[1]


def encoder(g: Geometry) -> type:
    class Encode:
        """An array of (bin, cnt), in any order, to a payload."""

        def eval(self, bins: list) -> Iterator[tuple[bytes]]:
            pairs = sorted((int(b[0]), int(b[1])) for b in bins or [] if b[1])
            grown = g.resized(g.highest(g.value_of(pairs[-1][0]))) if g.auto_resize and pairs else g
            yield (encode(pairs, grown),)

    return Encode


def register(spark: SparkSession, geometry: Geometry, prefix: str = "hist") -> list[str]:
    """Make the functions; their names. A prefix that is in use gets the new geometry."""
    names = []
    for name, (parameter, kind, sql) in expressions(geometry).items():
        spark.sql(f"create or replace temporary function {prefix}_{name}({parameter}) returns {kind} return {sql}")
        names.append(f"{prefix}_{name}")
    spark.udtf.register(f"{prefix}_decode", F.udtf(Decode, returnType="bin int, cnt bigint"))
    spark.udtf.register(f"{prefix}_encode", F.udtf(encoder(geometry), returnType="payload binary"))
    return [*names, f"{prefix}_decode", f"{prefix}_encode"]
