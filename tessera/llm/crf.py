"""Linear-chain conditional random field in numpy: batched training and Viterbi decoding.

Emissions are sums of the weights of a token's features at the offsets -3 to 3. Since a
token's features depend on its type only, the sums are made once per distinct type and
gathered by position, so decoding does no per-token feature work. A sequence is a line; its
emissions see the tokens of the neighbouring lines.
"""

from __future__ import annotations

import numpy as np

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
REACH = 3


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by ``at``."""
    return np.stack([np.bincount(at, weights=values[:, i], minlength=size) for i in range(values.shape[1])], axis=1)


def _grid(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(sequences, longest) places of the tokens of every sequence, -1 beyond its end."""
    step = np.arange(int(length.max()) if len(length) else 0)
    return np.where(step < length[:, None], start[:, None] + step, -1)


class Crf:
    """Weights: ``w`` (offsets, features, labels), ``trans`` (labels, labels), ``first`` (labels)."""

    def __init__(self, n_labels: int, banned: np.ndarray, banned_first: np.ndarray):
        self.n = n_labels
        self.ban = np.where(banned, -1e4, 0.0)
        self.ban_first = np.where(banned_first, -1e4, 0.0)
        self.index: dict[str, int] = {}
        self.w = np.zeros((len(OFFSETS), 1, n_labels), np.float32)
        self.trans = np.zeros((n_labels, n_labels))
        self.first = np.zeros(n_labels)

    def learn_features(self, features: list[list[str]], times: np.ndarray, least: int = 3) -> None:
        """Keeps the features that occur ``least`` times."""
        count: dict[str, int] = {}
        for fs, n in zip(features, times.tolist()):
            for f in fs:
                count[f] = count.get(f, 0) + n
        for f, n in count.items():
            if n >= least:
                self.index[f] = len(self.index) + 1

    def rows(self, features: list[list[str]]) -> np.ndarray:
        """Feature rows of each type, padded with row 0, whose weights stay 0."""
        most = max(map(len, features), default=1)
        out = np.zeros((len(features), most), np.int64)
        for i, fs in enumerate(features):
            for j, f in enumerate(fs):
                out[i, j] = self.index.get(f, 0)
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """(offsets, types, labels): what each type adds at each offset."""
        out = np.empty((len(OFFSETS), len(rows), self.n), np.float32)
        for k in range(len(OFFSETS)):
            for lo in range(0, len(rows), 20_000):
                out[k, lo : lo + 20_000] = self.w[k][rows[lo : lo + 20_000]].sum(axis=1)
        return out

    @staticmethod
    def emissions(scores: np.ndarray, types: np.ndarray) -> np.ndarray:
        """(tokens, labels) for a flat array of types that begins and ends with ``REACH`` tokens of padding, which get none."""
        n = len(types) - 2 * REACH
        em = scores[0][types[:n]]
        for k in range(1, len(OFFSETS)):
            em += scores[k][types[k : k + n]]
        return em

    def _bound(self, em: np.ndarray) -> np.ndarray:
        """Most that a token can add to a line over leaving everything unlabelled (label 0)."""
        trans = self.trans + self.ban
        into = np.maximum(trans.max(axis=0), self.first + self.ban_first - self.first[0] + trans[0, 0])[1:]
        leave = max(0.0, float((trans[1:, 0] - trans[0, 0]).max()))
        return (em[:, 1:] + into.astype(np.float32)).max(axis=1) - em[:, 0] - np.float32(trans[0, 0] - leave)

    def viterbi(self, em: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best label of every token; lines where no token can gain anything are left out, which changes nothing."""
        out = np.zeros(len(em), np.int8)
        if not len(start):
            return out
        live = np.maximum.reduceat(self._bound(em), start) >= 0
        start, length = start[live], length[live]
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        lo = 0
        while lo < len(start):
            hi = lo + max(1, 3_000_000 // (int(length[lo]) * self.n))
            self._decode(em, start[lo:hi], length[lo:hi], out)
            lo = hi
        return out

    def _decode(self, em: np.ndarray, start: np.ndarray, length: np.ndarray, out: np.ndarray) -> None:
        """Lines sorted by falling length; step k handles the k-th token of all that have one."""
        n, t = self.n, int(length[0])
        trans = np.ascontiguousarray((self.trans + self.ban).astype(np.float32).T)
        back = np.zeros((t, len(start), n), np.int8)
        best = em[start] + (self.first + self.ban_first).astype(np.float32)
        for k in range(1, t):
            m = int(np.searchsorted(-length, -k, side="left"))
            total = best[:m, None, :] + trans
            came = total.argmax(axis=2)
            back[k, :m] = came
            best[:m] = np.take_along_axis(total, came[:, :, None], 2)[:, :, 0] + em[start[:m] + k]
        now = best.argmax(axis=1)
        for k in range(t - 1, -1, -1):
            m = int(np.searchsorted(-length, -k, side="left"))
            out[start[:m] + k] = now[:m]
            if k:
                now[:m] = back[k, np.arange(m), now[:m]]

    def fit(self, rows: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 48, rate: float = 0.2, decay: float = 2e-4, seed: int = 1) -> None:
        """Maximum likelihood by AdaGrad over mini-batches of documents (types, labels, line starts)."""
        k, n = len(OFFSETS), self.n
        self.w = np.zeros((k, len(self.index) + 1, n))
        gw, gt, gf = np.full_like(self.w, 1e-2), np.full((n, n), 1e-2), np.full(n, 1e-2)
        rng = np.random.default_rng(seed)
        pad = len(rows)
        full = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.int64)])
        longest = [int(np.diff(np.append(st, len(ty))).max()) for ty, _, st in docs]
        for _ in range(epochs):
            order = np.lexsort((rng.permutation(len(docs)), longest))  # lines of one length together, in another mixture every time
            for lo in rng.permutation(np.arange(0, len(order), batch)).tolist():
                pick = [docs[i] for i in order[lo : lo + batch]]
                gap = np.full(REACH, pad)
                types = np.concatenate([x for d in pick for x in (gap, d[0])] + [gap])
                at, places, starts, gold = REACH, [], [], []
                for ty, la, st in pick:
                    places.append(np.arange(at, at + len(ty)))
                    starts.append(st + at - REACH)
                    gold.append(la)
                    at += len(ty) + REACH
                own, gold_at = np.concatenate(places) - REACH, np.concatenate(gold)
                used, inverse = np.unique(types, return_inverse=True)
                em = self.emissions(self.scores(full[used]), inverse)
                first = np.concatenate(starts)
                end = np.append(first[1:], 0)
                last = np.zeros(len(em) + 1, bool)
                last[own + 1] = True
                last[own] = False
                stops = np.flatnonzero(last)
                end = np.minimum(np.where(end == 0, len(em), end), stops[np.searchsorted(stops, first + 1)])
                grid = _grid(first, end - first)
                live = grid >= 0
                p, dt, df = self._expected(em[np.maximum(grid, 0)], live)
                label = np.zeros(len(em), np.int64)
                label[own] = gold_at
                y = label[np.maximum(grid, 0)]
                d = np.zeros((len(em), n))
                d[grid[live]] = -p[live]
                d[own, gold_at] += 1
                both = live[:, 1:]
                np.add.at(dt, (y[:, :-1][both], y[:, 1:][both]), 1)
                np.add.at(df, y[:, 0], 1)
                scale = 1.0 / len(pick)
                d *= scale
                # only features of the batch move; the decay acts when a feature occurs
                width = full.shape[1]
                active, place = np.unique(full[used], return_inverse=True)
                place = place.ravel()
                for j in range(k):
                    per = _sums(inverse[own + j], d[own], len(used))
                    g = np.zeros((len(active), n))
                    for c in range(n):
                        g[:, c] = np.bincount(place, weights=np.repeat(per[:, c], width), minlength=len(active))
                    g -= decay * self.w[j][active]
                    total = gw[j][active] + g * g
                    gw[j][active] = total
                    self.w[j][active] += rate * g / np.sqrt(total)
                    self.w[j][0] = 0
                dt, df = dt * scale, df * scale
                gt += dt * dt
                self.trans += rate * dt / np.sqrt(gt)
                gf += df * df
                self.first += rate * df / np.sqrt(gf)

    def _expected(self, em: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the labels, and minus the expected numbers of transitions and of first labels."""
        b, t, n = em.shape
        e = np.exp(em - em.max(axis=2, keepdims=True)).astype(np.float64)
        move = np.exp(np.maximum(self.trans + self.ban, -700.0))
        alpha, beta = np.zeros((b, t, n)), np.ones((b, t, n))
        a = e[:, 0] * np.exp(np.maximum(self.first + self.ban_first, -700.0))
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ move) * e[:, i]
            alpha[:, i] = np.where(live[:, i, None], a / a.sum(axis=1, keepdims=True), alpha[:, i - 1])
        dt = np.zeros((n, n))
        for i in range(t - 1, 0, -1):
            x = e[:, i] * beta[:, i]
            q = x @ move.T
            z = (alpha[:, i - 1] * q).sum(axis=1)
            weight = np.where(live[:, i], 1.0 / z, 0.0)
            dt -= (alpha[:, i - 1] * weight[:, None]).T @ x * move
            beta[:, i - 1] = np.where(live[:, i, None], q / q.sum(axis=1, keepdims=True), 1.0)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        return p, dt, -p[:, 0].sum(axis=0)
