"""Bin geometry: which values share a bin.

Values up to 2 * 10^sigfig units keep their own bin; beyond that, bins double in width with each power of two, so that a
bin's width never exceeds one part in 10^sigfig of its values. A unit is the power of two at or below `low`. Values are
unsigned 64-bit integers; in DataFrames they are BIGINT, negative ones standing for 2^63 and above.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from . import errors

U64 = (1 << 64) - 1
MAX_SIGFIG = 5


@dataclass(frozen=True)
class Geometry:
    low: int = 1
    high: int = 2
    sigfig: int = 3
    auto_resize: bool = False

    def __post_init__(self):
        if self.low < 1:
            raise errors.LowIsZero("low must be at least 1")
        if self.low > U64 // 2:
            raise errors.LowExceedsMax("low must be at most half the largest value")
        if self.high < 2 * self.low:
            raise errors.HighLessThanTwiceLow("high must be at least twice low")
        if not 0 <= self.sigfig <= MAX_SIGFIG:
            raise errors.SigFigExceedsMax(f"sigfig must be from 0 to {MAX_SIGFIG}")
        if self.unit_bits + self.sub_bits > 63:
            raise errors.CannotRepresentSigFigBeyondLow("low and sigfig need more than 63 bits")

    @classmethod
    def auto(cls, sigfig: int) -> Geometry:
        """No upper limit."""
        return cls(1, 2, sigfig, True)

    @classmethod
    def up_to(cls, high: int, sigfig: int) -> Geometry:
        return cls(1, high, sigfig)

    @property
    def unit_bits(self) -> int:
        # by floating point on purpose: near 2^62 it rounds up, and encoded histograms rely on that
        return math.floor(math.log2(float(self.low)))

    @property
    def sub_bits(self) -> int:
        return (2 * 10**self.sigfig - 1).bit_length()

    @property
    def sub_count(self) -> int:
        return 1 << self.sub_bits

    @property
    def half(self) -> int:
        return self.sub_count >> 1

    @property
    def mask(self) -> int:
        return (self.sub_count - 1) << self.unit_bits

    def buckets_for(self, high: int) -> int:
        """Powers of two that it takes to cover high."""
        top, n = self.sub_count << self.unit_bits, 1
        while top <= high:
            if top > U64 // 2:
                return n + 1
            top, n = top << 1, n + 1
        return n

    @property
    def buckets(self) -> int:
        return self.buckets_for(U64 if self.auto_resize else self.high)

    @property
    def bins(self) -> int:
        """Number of bins, empty ones included."""
        return (self.buckets + 1) * self.half

    @property
    def last(self) -> int:
        return self.bins - 1

    def resized(self, value: int) -> Geometry:
        """What an automatic geometry has grown to when value is its largest."""
        bins = (self.buckets_for(value) + 1) * self.half
        return Geometry(self.low, max(self.high, self.highest(self.value_of(bins - 1))), self.sigfig, True)

    def bins_to(self, value: int) -> int:
        return (self.buckets_for(value) + 1) * self.half

    def bucket(self, value: int) -> int:
        return (value | self.mask).bit_length() - self.unit_bits - self.sub_bits

    def index(self, value: int) -> int:
        b = self.bucket(value)
        return (b + 1) * self.half + (value >> (b + self.unit_bits)) - self.half

    def index_or_last(self, value: int) -> int:
        return min(self.index(value), self.last)

    def value_of(self, index: int) -> int:
        """Smallest value of a bin."""
        b, sub = index // self.half - 1, index % self.half + self.half
        if b < 0:
            b, sub = 0, sub - self.half
        return (sub << (b + self.unit_bits)) & U64

    def width(self, value: int) -> int:
        return 1 << (self.unit_bits + self.bucket(value))

    def lowest(self, value: int) -> int:
        shift = self.bucket(value) + self.unit_bits
        return value >> shift << shift

    def next(self, value: int) -> int:
        return min(U64, self.lowest(value) + self.width(value))

    def highest(self, value: int) -> int:
        return U64 if value == U64 else self.next(value) - 1

    def median(self, value: int) -> int:
        return self.lowest(value) + (self.width(value) >> 1)

    def equivalent(self, a: int, b: int) -> bool:
        return self.lowest(a) == self.lowest(b)

    def same_bins(self, other: Geometry) -> bool:
        return (self.unit_bits, self.sub_bits) == (other.unit_bits, other.sub_bits)
