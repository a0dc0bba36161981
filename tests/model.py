"""A plain Python histogram to hold the operators against."""

import math


class Model:
    def __init__(self, geometry):
        self.g, self.counts = geometry, {}

    def record(self, value, n=1):
        i = self.g.index(value)
        self.counts[i] = self.counts.get(i, 0) + n
        return self

    def correct(self, value, interval, n=1):
        self.record(value, n)
        value -= interval
        while interval > 0 and value >= interval:
            self.record(value, n)
            value -= interval
        return self

    @property
    def total(self):
        return sum(self.counts.values())

    def high(self, i):
        return self.g.highest(self.g.value_of(i))

    def quantile(self, q):
        rank = max(1, math.ceil(min(q, 1.0) * self.total)) if q == q and q > 0 else 1
        seen = 0
        for i in sorted(self.counts):
            seen += self.counts[i]
            if seen >= rank:
                return self.g.value_of(i) if q == 0 else self.high(i)

    def walk(self, level):
        """Rows (value, since, count at) of levels level(k), each ending a step, until the last bin and its value are passed."""
        out, last, top, k = [], 0, max(self.counts), 0
        while True:
            value = level(k)
            i = self.g.index_or_last(value)
            cum = sum(c for j, c in self.counts.items() if j <= i)
            out.append((value, cum - last, self.counts.get(i, 0)))
            last, k = cum, k + 1
            if i >= top:
                return out
