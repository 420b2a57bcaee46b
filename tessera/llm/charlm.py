"""Interpolated Kneser-Ney character models of several languages in shared sorted hash arrays.

All languages share one sorted array of n-gram hashes per order; beside it stand, for every
language, the log probability of the n-gram and the log weight it passes on as a context. The
context of a position is the shorter n-gram found at the position before, so scoring takes one
search per order and position for all languages together.
"""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x100000001B3)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def keys(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram ending at each position from order - 1 on."""
    h = np.full(max(0, len(codes) - order + 1), np.uint64(order))
    for i in range(order):
        h = (h ^ (codes[i : i + len(h)].astype(np.uint64) + np.uint64(1))) * _PRIME
        h ^= h >> np.uint64(29)
    return h * _SPREAD


class CharModels:
    """One model per language; ``fit`` takes the code points of each, with 0 between texts."""

    def __init__(self, languages: list[str], order: int = 4):
        self.languages, self.order = languages, order
        self.keys: list[np.ndarray] = []
        self.prob: list[np.ndarray] = []
        self.pass_on: list[np.ndarray] = []

    def fit(self, texts: list[np.ndarray]) -> CharModels:
        per = [self._one(t) for t in texts]
        n = len(self.languages)
        for k in range(self.order):
            every = np.unique(np.concatenate([p[k][0] for p in per]))
            prob = np.full((len(every), n), np.nan, np.float32)
            gamma = np.zeros((len(every), n), np.float32)
            for j, p in enumerate(per):
                at = np.searchsorted(every, p[k][0])
                prob[at, j] = p[k][1]
                gamma[at, j] = p[k][2]
            self.keys.append(every)
            self.prob.append(prob)
            self.pass_on.append(gamma)
        self._index()
        self.floor = np.array([p[-1] for p in per], np.float32)
        return self

    def _index(self) -> None:
        """Where the hashes of every leading bit pattern begin: a look-up starts there, as hashes are spread evenly."""
        self.begin, self.shift, self.most = [], [], []
        for table in self.keys:
            bits = max(1, int(len(table)).bit_length())
            begin = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            self.begin.append(np.append(begin, len(table)).astype(np.int32))
            self.shift.append(np.uint64(64 - bits))
            self.most.append(int(np.diff(self.begin[-1]).max()))

    def _one(self, codes: np.ndarray) -> list:
        """Per order: n-gram hashes, log probability, log weight as a context; last the log probability of an unknown character."""
        top = self.order
        grams = []
        for k in range(1, top + 1):
            h = keys(codes, k)
            if k > 1:
                ends = np.arange(k - 1, len(codes))
                h = h[codes[ends] != 0]
                start = np.flatnonzero(codes[ends] != 0)
            else:
                start = np.flatnonzero(codes != 0)
                h = h[start]
            u, first, count = np.unique(h, return_index=True, return_counts=True)
            grams.append((u, start[first], count))
        shorter = [keys(codes, k) for k in range(top + 1)]
        out: list = []
        v = max(2, len(grams[0][0]) + 1)
        low_key, low_log, floor = None, None, 0.0
        contexts = []
        for k in range(1, top + 1):
            u, first, count = grams[k - 1]
            if k < top:  # lower orders count the different characters before, not occurrences
                lu, lfirst, _ = grams[k]
                tail = shorter[k][lfirst + 1]
                at = np.searchsorted(u, tail)
                count = np.bincount(at, minlength=len(u)).astype(float)
                count[count == 0] = 1.0
            count = count.astype(float)
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = min(0.95, max(0.1, n1 / (n1 + 2.0 * n2))) if n1 else 0.5
            if k == 1:
                total = count.sum()
                spread = d * len(u) / total
                p = np.maximum(count - d, 0) / total + spread / v
                floor = np.log(spread / v)
                contexts.append(None)
            else:
                ctx = shorter[k - 1][first]
                cu, inv = np.unique(ctx, return_inverse=True)
                total = np.bincount(inv, weights=count)
                kinds = np.bincount(inv)
                weight = d * kinds / total
                tail = shorter[k - 1][first + 1]
                low = np.exp(low_log[np.searchsorted(low_key, tail)])
                p = np.maximum(count - d, 0) / total[inv] + weight[inv] * low
                contexts.append((cu, np.log(weight)))
            low_key, low_log = u, np.log(p)
            out.append([u, low_log, np.zeros(len(u))])
        for k in range(2, top + 1):
            cu, w = contexts[k - 1]
            u = out[k - 2][0]
            at = np.minimum(np.searchsorted(u, cu), len(u) - 1)
            ok = u[at] == cu
            out[k - 2][2][at[ok]] = w[ok]
        return [*out, floor]

    def score(self, codes: np.ndarray) -> np.ndarray:
        """(positions, languages) log probabilities; positions of separators (0) have 0."""
        n = len(self.languages)
        if not len(codes):
            return np.zeros((0, n), np.float32)
        out = np.empty((len(codes), n), np.float32)
        at, hit = self._look(0, keys(codes, 1))
        out[:] = self.floor
        p = self.prob[0][at[hit]]
        out[hit] = np.where(np.isnan(p), self.floor, p)
        before, bhit = at, hit
        for k in range(1, self.order):
            if len(codes) <= k:
                break
            now, nhit = self._look(k, keys(codes, k + 1))
            part = out[k:]
            ctx = bhit[: len(now)]
            gamma = np.zeros((len(now), n), np.float32)
            gamma[ctx] = self.pass_on[k - 1][before[: len(now)][ctx]]
            backed = part + gamma
            p = np.full((len(now), n), np.nan, np.float32)
            p[nhit] = self.prob[k][now[nhit]]
            out[k:] = np.where(np.isnan(p), backed, p)
            before, bhit = now, nhit
        out[codes == 0] = 0
        return out

    def _look(self, k: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the sorted array, found) of every hash."""
        table = self.keys[k]
        at = np.minimum(self.begin[k][(h >> self.shift[k]).astype(np.int64)], len(table) - 1).astype(np.int64)
        hit = table[at] == h
        todo = np.flatnonzero(~hit & (table[at] < h))
        for _ in range(self.most[k]):
            if not len(todo):
                break
            at[todo] = np.minimum(at[todo] + 1, len(table) - 1)
            now = table[at[todo]]
            hit[todo] = now == h[todo]
            todo = todo[now < h[todo]]
        return at, hit
