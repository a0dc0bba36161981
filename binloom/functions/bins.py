"""Column expressions of a geometry. All are built-in functions on BIGINT, so they stay in generated code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..geometry import U64, Geometry

UNSIGNED = "decimal(20,0)"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def signed(value: int) -> Column:
    """A literal of an unsigned value."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")


def unsigned(value) -> Column:
    """The number that a BIGINT stands for, as DECIMAL(20,0)."""
    v = _col(value)
    return F.when(v < 0, v.cast(UNSIGNED) + F.lit(Decimal(1 << 64))).otherwise(v.cast(UNSIGNED)).cast(UNSIGNED)


def _right(v: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", v, n)


def _left(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n)


def bucket(value, g: Geometry) -> Column:
    return F.length(F.bin(_col(value).bitwiseOR(signed(g.mask)))) - (g.unit_bits + g.sub_bits)


def bin_index(value, g: Geometry) -> Column:
    b = bucket(value, g)
    return ((b + 1) * g.half + _right(_col(value), b + g.unit_bits) - g.half).cast("int")


def bin_index_or_last(value, g: Geometry) -> Column:
    return F.least(bin_index(value, g), F.lit(g.last))


def in_range(value, g: Geometry) -> Column:
    """Whether a value has a bin: it may exceed `high` within the last bucket."""
    return bin_index(value, g) < g.bins


def checked_bin_index(value, g: Geometry) -> Column:
    """bin_index, or a failure of the job for a value beyond the last bin. Null values have no bin."""
    i = bin_index(value, g)
    if g.auto_resize or g.bins > g.index(U64):
        return i
    return F.when(i < g.bins, i).when(i.isNotNull(), F.raise_error(F.lit("ValueOutOfRange: a value has no bin")).cast("int"))


def clamped(value, g: Geometry) -> Column:
    """Values beyond the last bin become `high`."""
    return F.when(bin_index(value, g) >= g.bins, signed(g.high)).otherwise(_col(value))


def _parts(index, g: Geometry) -> tuple[Column, Column]:
    i = _col(index).cast("bigint")
    b = F.shiftright(i, g.half.bit_length() - 1) - 1
    sub = i.bitwiseAND(F.lit(g.half - 1).cast("bigint")) + F.when(b < 0, F.lit(0)).otherwise(F.lit(g.half))
    return F.greatest(b, F.lit(0)).cast("int") + g.unit_bits, sub


def bin_low(index, g: Geometry) -> Column:
    """Smallest value of a bin."""
    shift, sub = _parts(index, g)
    return _left(sub, shift)


def bin_width(index, g: Geometry) -> Column:
    shift, _ = _parts(index, g)
    return _left(F.lit(1).cast("bigint"), shift)


def _filled(low: Column, shift: Column) -> Column:
    """The last value of a class; of the very last class the one before, as the value after it has no representation."""
    ones = F.bitwise_not(_left(F.lit(-1).cast("bigint"), shift))
    high = low.bitwiseOR(ones)
    return F.when(high == -1, F.lit(-2).cast("bigint")).otherwise(high)


def bin_high(index, g: Geometry) -> Column:
    """Largest value of a bin; one less than the largest for the very last."""
    shift, sub = _parts(index, g)
    return _filled(_left(sub, shift), shift)


def bin_median(index, g: Geometry) -> Column:
    shift, sub = _parts(index, g)
    return _left(sub, shift).bitwiseOR(_right(_left(F.lit(1).cast("bigint"), shift), F.lit(1)))


def lowest_equivalent(value, g: Geometry) -> Column:
    shift = bucket(value, g) + g.unit_bits
    return _left(_right(_col(value), shift), shift)


def equivalent_range(value, g: Geometry) -> Column:
    return _left(F.lit(1).cast("bigint"), bucket(value, g) + g.unit_bits)


def next_non_equivalent(value, g: Geometry) -> Column:
    shift = bucket(value, g) + g.unit_bits
    after = _left(_right(_col(value), shift) + 1, shift)
    return F.when(after == 0, F.lit(-1).cast("bigint")).otherwise(after)


def highest_equivalent(value, g: Geometry) -> Column:
    shift = bucket(value, g) + g.unit_bits
    low = _left(_right(_col(value), shift), shift)
    return F.when(_col(value) == -1, F.lit(-1).cast("bigint")).otherwise(_filled(low, shift))


def median_equivalent(value, g: Geometry) -> Column:
    return lowest_equivalent(value, g).bitwiseOR(_right(equivalent_range(value, g), F.lit(1)))


def equivalent(a, b, g: Geometry) -> Column:
    return lowest_equivalent(a, g) == lowest_equivalent(b, g)


def to_quantile(percentile) -> Column:
    return _col(percentile) / 100.0


def to_percentile(quantile) -> Column:
    return _col(quantile) * 100.0


def valid_tag(tag) -> Column:
    """A label of a log line has no comma, line end or space."""
    return ~_col(tag).rlike("[, \\r\\n]")


def epoch_seconds(ts) -> Column:
    """Seconds since the epoch, negative before it."""
    return F.unix_micros(ts) / 1e6
