"""A bidirectional gated recurrent network with attention pooling, in numpy: training by hand-written gradients and
scoring in batches of equal length."""

from __future__ import annotations

import numpy as np

HIDDEN, EMBED, CHAR_SLOTS = 16, 24, 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def sum_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices and the sums of their rows of ``values``."""
    if not len(index):
        return index, values
    order = np.argsort(index, kind="stable")
    turned = index[order]
    first = np.flatnonzero(np.concatenate([[True], turned[1:] != turned[:-1]]))
    return turned[first], np.add.reduceat(values[order], first, axis=0)


def char_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character features of the words end to end, and how many each has: trigrams and 4-grams of the bounded
    word, and its letters without vowels or masked signs."""
    slots, sizes = [], []
    for word in words:
        bounded = f"<{word}>"
        grams = {bounded[i : i + k] for k in (3, 4) for i in range(max(1, len(bounded) - k + 1))}
        grams.add("_" + "".join(c for c in word if c not in "aeiou*"))
        slots += [_slot(g) for g in sorted(grams)]
        sizes.append(len(grams))
    return np.array(slots, np.int64), np.array(sizes, np.int64)


def _slot(gram: str) -> int:
    h = 2166136261
    for b in gram.encode("utf-8"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % CHAR_SLOTS


class BiGru:
    """Parameters p: word vectors W (row 0: padding, 1: neutral word, 2: unknown word), character vectors C, the two
    directions' input and recurrent weights, attention and output."""

    def __init__(self, words: int, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"W": draw(words, EMBED), "C": draw(CHAR_SLOTS, EMBED), "va": draw(HIDDEN), "A": draw(2 * HIDDEN, HIDDEN), "vo": draw(2 * HIDDEN), "bo": np.zeros(1, np.float32)}
        self.p["W"][:3] = 0
        for d in "fb":
            self.p |= {f"X{d}": draw(EMBED, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.25), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def vectors(self, ids: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input vectors of words: own vector plus the mean of their characters' vectors."""
        out = self.p["W"][ids].copy()
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] += np.add.reduceat(self.p["C"][slots], starts, axis=0) / sizes[some, None]
        return out

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        """x: (time, batch, 3 * hidden) projected inputs, in the order of this direction."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        u = self.p[f"U{d}"]
        for t in range(len(x)):
            hu = h @ u
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = new
            out[t] = h
        return out

    def forward(self, table: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities of the windows ``rows`` (batch, time), indices into ``table``, the input vectors of words."""
        p, turned, m = self.p, rows.T, mask.T
        steps = {d: ([] if keep is not None else None) for d in "fb"}
        f = self._direction((table @ p["Xf"] + p["bf"])[turned], m, "f", steps["f"])
        b = self._direction((table @ p["Xb"] + p["bb"])[turned[::-1]], m[::-1], "b", steps["b"])[::-1]
        h = np.concatenate([f, b], axis=2)
        e = np.tanh(h @ p["A"])
        s = np.where(m, e @ p["va"], -1e9)
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        c = (a[:, :, None] * h).sum(axis=0)
        y = _sigmoid(c @ p["vo"] + p["bo"][0])
        if keep is not None:
            keep |= {"h": h, "e": e, "a": a, "c": c, "steps": steps}
        return y

    def _back_direction(self, dh_out: np.ndarray, mask: np.ndarray, d: str, steps: list, g: dict) -> np.ndarray:
        u = self.p[f"U{d}"]
        dx = np.zeros((len(steps), dh_out.shape[1], 3 * HIDDEN), np.float32)
        dh = np.zeros(dh_out.shape[1:], np.float32)
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, n, hn = steps[t]
            total = dh + dh_out[t]
            live = total * mask[t][:, None]
            dz = live * (h - n) * z * (1 - z)
            dn = live * (1 - z) * (1 - n * n)
            dr = dn * hn * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            dhu = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"U{d}"] += h.T @ dhu
            dh = total * ~mask[t][:, None] + live * z + dhu @ u.T
        return dx

    def gradients(self, words: tuple, rows: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for windows ``rows`` over ``words`` = (ids, slots, sizes) of the distinct words in them."""
        ids, slots, sizes = words
        table = self.vectors(ids, slots, sizes)
        keep: dict = {}
        y = self.forward(table, rows, mask, keep)
        p, m, h, a, c, e = self.p, mask.T, keep["h"], keep["a"], keep["c"], keep["e"]
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in "WC"}
        dy = ((y - target) * weight / weight.sum()).astype(np.float32)
        g["vo"], g["bo"] = c.T @ dy, dy.sum(keepdims=True)
        dc = dy[:, None] * p["vo"]
        da = (h * dc).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        g["va"] = np.einsum("tb,tbk->k", ds, e)
        de = ds[:, :, None] * p["va"] * (1 - e * e)
        g["A"] = np.einsum("tbh,tbk->hk", h, de)
        dh = a[:, :, None] * dc + de @ p["A"].T
        dxf = self._back_direction(dh[:, :, :HIDDEN], m, "f", keep["steps"]["f"], g)
        dxb = self._back_direction(dh[::-1, :, HIDDEN:], m[::-1], "b", keep["steps"]["b"], g)[::-1]
        dtable = np.zeros_like(table)
        flat = rows.T.ravel()
        for d, dx in (("f", dxf), ("b", dxb)):
            per_word = np.zeros((len(table), 3 * HIDDEN), np.float32)
            at, sums = sum_rows(flat, dx.reshape(-1, 3 * HIDDEN))
            per_word[at] = sums
            g[f"X{d}"], g[f"b{d}"] = table.T @ per_word, per_word.sum(axis=0)
            dtable += per_word @ p[f"X{d}"].T
        loss = -float((weight * np.where(target > 0.5, np.log(y + 1e-7), np.log(1 - y + 1e-7))).sum() / weight.sum())
        g["W"], g["C"] = (ids, dtable), (slots, np.repeat(dtable / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        return loss, g


class Adam:
    """Adam; for the two embedding tables only the rows in use are moved."""

    def __init__(self, model: BiGru, rate: float = 0.01):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, p in self.model.p.items():
            if k in "WC":
                rows, grads = g[k]
                at, grad = sum_rows(rows, grads)
                if k == "W":
                    grad[at < 1] = 0
            else:
                at, grad = slice(None), g[k]
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * grad
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * grad * grad
            p[at] -= self.rate * fix * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-7)
