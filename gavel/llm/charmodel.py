"""Character n-gram counts in tables of fixed size, and the smoothed model over them.

Counts of single characters are exact; pairs and triples are counted under hashes, so a table never grows with the
corpus. Each task adds up its own tables and emits what isn't zero; sums of them are what a single pass would count.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BITS, TRIPLE_BITS = 18, 20
POINTS = 0x110000
#: Characters handled at once.
STEP = 1_000_000


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash(*parts: np.ndarray, bits: int) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _among(asked: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How often each of `asked` is in `there`."""
    values, counts = np.unique(there, return_counts=True)
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return np.where(values[at] == asked, counts[at], 0)


class Counts:
    """Counts of characters as they are, and of pairs and triples in lower case."""

    def __init__(self) -> None:
        self.one = np.zeros(POINTS, np.int64)
        self.two = np.zeros(1 << PAIR_BITS, np.int64)
        self.three = np.zeros(1 << TRIPLE_BITS, np.int64)

    def add(self, texts: Iterable[str]) -> None:
        held, size = [], 0
        for t in texts:
            for at in range(0, len(t), STEP) if len(t) > STEP else (0,):
                part = t[at : at + STEP] if len(t) > STEP else t
                held.append(part)
                size += len(part)
                if size >= STEP:
                    self._add("\n\n".join(held))
                    held, size = [], 0
        if held:
            self._add("\n\n".join(held))

    def _add(self, text: str) -> None:
        some = np.bincount(points(text))
        self.one[: len(some)] += some
        p = points(text.lower())
        if len(p) > 2:
            self.two += np.bincount(_hash(p[:-1], p[1:], bits=PAIR_BITS), minlength=len(self.two))
            self.three += np.bincount(_hash(p[:-2], p[1:-1], p[2:], bits=TRIPLE_BITS), minlength=len(self.three))

    def __add__(self, other: Counts) -> Counts:
        out = Counts()
        out.one, out.two, out.three = self.one + other.one, self.two + other.two, self.three + other.three
        return out

    def rows(self) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
        for n, table in enumerate((self.one, self.two, self.three)):
            at = np.flatnonzero(table)
            yield n, at, table[at]


def gather(rows: DataFrame) -> Counts:
    """The sum of emitted rows (`n`, `key`, `count`). At most as many rows as the tables have places reach the driver."""
    got = rows.groupBy("n", "key").agg(F.sum("count").alias("count")).toArrow()
    n, key, count = (got[c].to_numpy() for c in ("n", "key", "count"))
    out = Counts()
    for k, table in enumerate((out.one, out.two, out.three)):
        table[key[n == k]] = count[n == k]
    return out


class Model:
    """P(character | two before it), in lower case: counts smoothed by those of the shorter context (Dirichlet, weights below)."""

    WEIGHTS = (4.0, 8.0)

    def __init__(self, counts: Counts):
        at = np.flatnonzero(counts.one)
        self.ones = dict(zip(at.tolist(), counts.one[at].tolist(), strict=True))
        self.folded: dict[int, int] = {}
        for x, n in self.ones.items():
            for low in map(ord, chr(x).lower()):
                self.folded[low] = self.folded.get(low, 0) + n
        self.total = float(counts.one.sum()) + 1.0
        self.table: np.ndarray | None = None
        self.two = counts.two.astype(np.float32)
        self.three = counts.three.astype(np.float32)

    def scores(self, texts: list[str], without: str | None = None) -> np.ndarray:
        """The log probability of each text from its third character on; every text has at least two.

        `without` is a text that the model was trained on and whose own pairs and triples are not to count.
        """
        if not texts:
            return np.zeros(0)
        if self.table is None:
            self.table = np.zeros(POINTS, np.float64)
            self.table[list(self.folded)] = list(self.folded.values())
        lower = [t.lower() for t in texts]
        p = points("".join(lower))
        ends = np.cumsum([len(t) for t in lower])
        one = self.table[p]
        p1 = (one + 0.02) / (self.total + 0.02 * 5000)
        k2, k3 = self.WEIGHTS
        pair = self.two[_hash(p[:-1], p[1:], bits=PAIR_BITS)].astype(np.float64)
        triple = self.three[_hash(p[:-2], p[1:-1], p[2:], bits=TRIPLE_BITS)].astype(np.float64)
        if without and len(without) > 2:
            own = points(without.lower())
            pair -= _among(_hash(p[:-1], p[1:], bits=PAIR_BITS), _hash(own[:-1], own[1:], bits=PAIR_BITS))
            triple -= _among(_hash(p[:-2], p[1:-1], p[2:], bits=TRIPLE_BITS), _hash(own[:-2], own[1:-1], own[2:], bits=TRIPLE_BITS))
            pair, triple = np.maximum(pair, 0), np.maximum(triple, 0)
        # A hashed count may hold other pairs too; it can't exceed the counts of its parts.
        pair = np.minimum(pair, np.minimum(one[:-1], one[1:]))
        triple = np.minimum(triple, np.minimum(pair[:-1], pair[1:]))
        p2 = (pair + k2 * p1[1:]) / (one[:-1] + k2)
        p3 = (triple + k3 * p2[1:]) / (pair[:-1] + k3)
        # By text, so that a score doesn't depend on the texts before; one of two characters has none.
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(np.concatenate([np.log(p3), [0.0]]), np.stack([starts, ends - 2], 1).ravel())[::2]
        return np.where(ends - starts > 2, sums, 0.0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}


COUNT_FIELDS = [("n", pa.int32()), ("key", pa.int64()), ("count", pa.int64())]
