"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
from collections import Counter

QS = (0.01, 0.05, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98, 0.99)


def exact(values, p):
    values = sorted(values)
    return values[max(1, math.ceil(p * len(values))) - 1]


def log_gamma(alpha):
    return math.log((1 + alpha) / (1 - alpha))


def buckets(values, alpha):
    out = Counter()
    for v in values:
        if v == 0:
            out[(0, 0)] += 1
        else:
            out[(1 if v > 0 else -1, math.ceil(math.log(abs(v)) / log_gamma(alpha)))] += 1
    return out


def fold(counts, limit):
    out = Counter()
    for (sgn, idx), n in counts.items():
        top = max(i for s, i in counts if s == sgn)
        out[(sgn, max(idx, top - limit + 1))] += n
    return out


def collapse(counts, limit):
    level = 0
    while sum(1 for s, _ in counts if s != 0) > limit:
        nxt = Counter()
        for (sgn, idx), n in counts.items():
            nxt[(sgn, math.ceil(idx / 2) if sgn else 0)] += n
        counts, level = nxt, level + 1
    return level, counts


def walk(counts, p, alpha, level=0):
    total, cum = sum(counts.values()), 0
    lg = log_gamma(alpha) * 2**level
    for sgn, idx in sorted(counts, key=lambda b: (b[0], b[0] * b[1])):
        cum += counts[(sgn, idx)]
        if cum > p * (total - 1):
            return sgn * 2 * math.exp(idx * lg) / (math.exp(lg) + 1) if sgn else 0.0
