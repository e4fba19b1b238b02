"""A gated recurrent language model in numpy with a class-factored output softmax.

p(word | state) = p(class | state) p(word | class, state) for the most frequent words, in classes of equal size by
frequency; other words fall into a few further classes whose members are told apart by their own counts elsewhere.
"""

from __future__ import annotations

import numpy as np

BLOCK, FAR = 1 << 13, 60.0


def _exps(logits: np.ndarray, at: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """``logits`` become shares of a row's total but for its sum, which is returned after the log probabilities of ``at``.

    Rows are only moved to a maximum of 0 where ``bound``, which no logit exceeds, doesn't keep their sums from overflow.
    """
    if not bound < FAR:
        logits -= logits.max(1, keepdims=True)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return own - np.log(total), total


class Gru:
    """Token ids: 0 .. classes * size - 1 are words of a class each, then ``rare`` ids that are classes by themselves."""

    def __init__(self, classes: int, size: int, rare: int, hidden: int, seed: int = 0):
        self.classes, self.size, self.rare, self.hidden = classes, size, rare, hidden
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        n = classes * size + rare
        self.p = {
            "x": draw(n, 3 * hidden, s=0.1), "u": draw(hidden, 3 * hidden, s=hidden**-0.5), "b": np.zeros(3 * hidden, np.float32),
            "c": draw(hidden, classes + rare, s=0.05), "cb": np.zeros(classes + rare, np.float32),
            "w": draw(classes, hidden, size, s=0.05), "wb": np.zeros((classes, size), np.float32),
        }

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases from the tokens' counts, so that training starts at the unigram model."""
        words = counts[: self.classes * self.size].reshape(self.classes, self.size) + 0.5
        rest = counts[self.classes * self.size :] + 0.5
        mass = np.concatenate((words.sum(1), rest))
        self.p["cb"][:] = np.log(mass / mass.sum())
        self.p["wb"][:] = np.log(words / words.sum(1, keepdims=True))

    def flat(self) -> np.ndarray:
        """All parameters in one row."""
        return np.concatenate([w.ravel() for w in self.p.values()])

    def set_flat(self, row: np.ndarray) -> None:
        at = 0
        for w in self.p.values():
            w[...] = row[at : at + w.size].reshape(w.shape)
            at += w.size

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.classes * self.size, ids // self.size, ids - self.classes * (self.size - 1))

    def halves(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two gates' columns, halved for ``move``, and the candidate's."""
        k = 2 * self.hidden
        return table[:, :k] * table.dtype.type(0.5), np.ascontiguousarray(table[:, k:])

    def move(self, zr: np.ndarray, n: np.ndarray, h: np.ndarray, u: tuple[np.ndarray, np.ndarray], q: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The next state, in ``out``. The input's parts ``zr`` (half of it) and ``n`` become gates and candidate, ``q`` the state's part of this."""
        k = self.hidden
        zr += h @ u[0]
        np.tanh(zr, out=zr)  # the sigmoid by the tangent of half
        zr *= 0.5
        zr += 0.5
        np.matmul(h, u[1], out=q)
        n += zr[:, k:] * q
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[:, :k]
        out += n
        return out

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """gates: the input's part, with bias. Returns the new state, gates, candidate and the state's part of it."""
        k, (zr, n) = self.hidden, self.halves(gates)
        q = np.empty_like(n)
        return self.move(zr, n, h, self.halves(self.p["u"]), q, np.empty_like(n)), zr[:, :k], zr[:, k:], n, q

    def log_probs(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of ``ids`` given states; with ``grads``, also the loss's slope by the states."""
        p, cls, k = self.p, self.class_of(ids), self.hidden
        one = np.ones((len(h), k + 1), h.dtype)  # a last column for the biases
        one[:, :k] = h
        size = np.abs(one).max(0, initial=0)
        top = np.vstack((p["c"], p["cb"]))
        logits = one @ top
        out, total = _exps(logits, cls, float((size @ np.abs(top)).max()))
        dh = None
        if grads is not None:
            logits *= (1 / total)[:, None]
            logits[np.arange(len(ids)), cls] -= 1
            slope = one.T @ logits
            grads["c"] += slope[:k]
            grads["cb"] += slope[k]
            dh = logits @ p["c"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1))
        order = order[: cuts[-1]]  # of the words that share a class with others
        part, word = one.take(order, 0), ids[order] % self.size
        low = np.concatenate((p["w"], p["wb"][:, None, :]), 1)
        logits = np.empty((len(order), self.size), h.dtype)
        full = [(c, slice(cuts[c], cuts[c + 1])) for c in range(self.classes) if cuts[c] < cuts[c + 1]]
        for c, mine in full:
            np.matmul(part[mine], low[c], out=logits[mine])
        more, total = _exps(logits, word, float((size @ np.abs(low)).max()))
        out[order] += more
        if grads is not None:
            logits *= (1 / total)[:, None]
            logits[np.arange(len(order)), word] -= 1
            back, slope = np.empty((len(order), k), h.dtype), np.zeros_like(low)
            for c, mine in full:
                np.matmul(part[mine].T, logits[mine], out=slope[c])
                np.matmul(logits[mine], p["w"][c].T, out=back[mine])
            grads["w"] += slope[:, :k]
            grads["wb"] += slope[:, k]
            dh[order] += back
        return out, dh

    def train(self, docs: list[np.ndarray], end: int, epochs: int, lanes: int = 64, window: int = 32, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Truncated backpropagation through windows; documents follow each other in lanes, the state starts anew at each.

        Moments and rows of the input table move with the steps that meet their words. Returns the mean loss of each epoch.
        """
        rng, k, losses = np.random.default_rng(seed), self.hidden, []
        m, v, t = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        narrow = np.int16 if len(self.p["x"]) <= 1 << 15 else np.int64  # 16 bits are sorted in linear time
        total = sum(len(d) for d in docs)
        lanes = max(1, min(lanes, len(docs), total // window))
        steps = epochs * -(-total // (lanes * window)) or 1
        for _ in range(epochs):
            streams: list[list[np.ndarray]] = [[] for _ in range(lanes)]
            sizes = np.zeros(lanes, np.int64)
            for d in rng.permutation(len(docs)):
                lane = int(np.argmin(sizes))
                streams[lane].append(docs[d])
                sizes[lane] += len(docs[d])
            y = np.full((int(sizes.max()), lanes), -1, np.int64)
            for at, j in enumerate(np.argsort(-sizes, kind="stable")):
                if streams[j]:
                    y[: sizes[j], at] = np.concatenate(streams[j])
            sizes = np.sort(sizes)
            x = np.vstack((np.full((1, lanes), end), np.where(y[:-1] < 0, end, y[:-1])))
            h, loss, seen = np.zeros((lanes, k), np.float32), 0.0, 0
            for a in range(0, len(y), window):
                active = lanes - int(np.searchsorted(sizes, a, "right"))  # lanes that have ended are left out
                xs, ys, h = x[a : a + window, :active], y[a : a + window, :active], h[:active]
                steps_in = len(xs)
                order = np.argsort(xs.ravel().astype(narrow), kind="stable")
                sorted_x = xs.ravel()[order]
                new = np.diff(sorted_x, prepend=-1) != 0
                first = np.flatnonzero(new)
                names = sorted_x[first]  # only these words' rows of the input table change
                place = np.empty(xs.size, np.int64)
                place[order] = np.cumsum(new) - 1
                place = place.reshape(xs.shape)
                table = self.halves(self.p["x"].take(names, 0) + self.p["b"])
                u = self.halves(self.p["u"])
                g = {n: np.zeros_like(w) for n, w in self.p.items() if n != "x"}
                live_in = (xs != end).astype(np.float32)[:, :, None]
                states, before, q = (np.empty((steps_in, active, k), np.float32) for _ in range(3))
                zr, n = (part.take(place, 0) for part in table)
                for i in range(steps_in):
                    np.multiply(h, live_in[i], out=before[i])
                    h = self.move(zr[i], n[i], before[i], u, q[i], states[i])
                z, r = zr[:, :, :k], zr[:, :, k:]
                live = ys >= 0
                ids = ys[live]
                logp, dh_live = self.log_probs(states[live], ids, g)
                loss, seen = loss - float(logp.sum()), seen + len(ids)
                slope = np.zeros_like(states)
                slope[live] = dh_live
                # what of a step's slope reaches its gates, and the state's part of them, for all steps at once
                to_n = (1 - z) * (1 - n * n)
                reach, inner, ds = np.empty((steps_in, active, 3, k), np.float32), np.empty((steps_in, active, 3, k), np.float32), np.empty_like(slope)
                np.multiply(to_n, r, out=reach[:, :, 2])
                np.multiply(reach[:, :, 2] * q, 1 - r, out=reach[:, :, 1])
                np.multiply((before - n) * z, 1 - z, out=reach[:, :, 0])
                back, passed, turned, keep = np.zeros((active, k), np.float32), np.empty((active, k), np.float32), np.ascontiguousarray(self.p["u"].T), z * live_in
                for i in range(steps_in - 1, -1, -1):
                    d = np.add(slope[i], back, out=ds[i])
                    np.multiply(d[:, None, :], reach[i], out=inner[i])
                    np.matmul(inner[i].reshape(active, 3 * k), turned, out=back)
                    back *= live_in[i]
                    back += np.multiply(d, keep[i], out=passed)
                g["u"] = before.reshape(-1, k).T @ inner.reshape(-1, 3 * k)
                inner[:, :, 2] = ds * to_n  # the input's part isn't scaled by the reset gate
                flat = inner.reshape(-1, 3 * k)
                rows = np.add.reduceat(flat.take(order, 0), first)
                g["b"] = flat.sum(0)
                t += 1
                pace, scale = rate * max(0.1, 1 - t / (steps + 1)), active / max(1, len(ids))
                for name, w in self.p.items():
                    some = name == "x"
                    s, mean, square = (rows, m[name].take(names, 0), v[name].take(names, 0)) if some else (g[name], m[name], v[name])
                    s *= np.float32(scale)
                    np.clip(s, -5, 5, out=s)
                    d = s - mean
                    d *= np.float32(0.1)
                    mean += d
                    np.multiply(s, s, out=s)
                    s -= square
                    s *= np.float32(0.01)
                    square += s
                    np.multiply(square, np.float32(1 / (1 - 0.99**t)), out=s)
                    np.sqrt(s, out=s)
                    s += np.float32(1e-6)
                    np.divide(mean, s, out=s)
                    s *= np.float32(pace / (1 - 0.9**t))
                    if some:
                        m[name][names], v[name][names] = mean, square
                        w[names] -= s
                    else:
                        w -= s
            losses.append(loss / max(1, seen))
        return losses

    def score(self, docs: list[np.ndarray], end: int, window: int | None = None) -> np.ndarray:
        """Natural log probability of each whole document; the state is carried from window to window, of ``BLOCK`` tokens by default."""
        out = np.zeros(len(docs))
        order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[i]) for i in order], np.int64)
        if not len(docs) or not lengths[0]:
            return out
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        flat = np.concatenate([docs[i] for i in order])
        table, u = self.halves(self.p["x"] + self.p["b"]), self.halves(self.p["u"])
        h = np.zeros((int((lengths > 0).sum()), self.hidden), np.float32)
        sums = np.zeros(len(h))
        before = np.full(len(h), end, np.int64)
        longest, falling, b = int(lengths[0]), -lengths, 0
        while b < longest:
            states, ids, lanes = [], [], []
            a, b = b, min(longest, b + (window or -(-BLOCK // len(h))))
            for t in range(a, b):
                n = int(np.searchsorted(falling, -t, "left"))  # documents longer than t
                zr, cand = (part.take(before[:n], 0) for part in table)
                h = self.move(zr, cand, h[:n], u, np.empty_like(cand), np.empty_like(cand))
                before = flat[begin[:n] + t]
                states.append(h)
                ids.append(before)
                lanes.append(n)
            logp, _ = self.log_probs(np.concatenate(states), np.concatenate(ids))
            at = 0
            for n in lanes:
                sums[:n] += logp[at : at + n]
                at += n
        out[order[: len(sums)]] = sums
        return out
