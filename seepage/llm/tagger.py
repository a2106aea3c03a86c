"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_NEVER = -1e4

#: Characters that the network tells apart; other letters, digits, spaces and signs are one class each.
_OWN = " \n0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ@.-_+%()/:;,='\"#*!?"
CODES = {c: i + 1 for i, c in enumerate(_OWN)}
N_CODES = len(_OWN) + 4


def encode(text: str) -> np.ndarray:
    """Character classes; 0 is padding."""
    last = len(_OWN)
    return np.array([CODES.get(c) or (last + 1 if c.isalpha() else last + 2 if c.isspace() else last + 3) for c in text], np.int64)


def allowed() -> np.ndarray:
    """0 where one tag may follow another, else a large negative number."""
    out = np.zeros((len(TAGS), len(TAGS)))
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                if s[2:] != t[2:]:
                    out[i, j] = _NEVER
    return out


_ALLOWED = allowed()
_START = np.array([_NEVER if t[0] == "I" else 0.0 for t in TAGS])


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Tags of a window of n characters; spans may reach over its edges. Of overlapping spans the first holds."""
    out = np.zeros(n, np.int64)
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        lo, hi = max(0, a), min(n, b)
        if lo < hi and not out[lo:hi].any():
            out[lo:hi] = TAGS.index(f"I-{kind}")
            out[lo] = TAGS.index(f"B-{kind}")
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights in ``p``; batches are (characters, windows) arrays of codes with a mask."""

    def __init__(self, hidden: int = 20, width: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        k = len(TAGS)
        self.hidden = hidden
        self.p = {"e": r.normal(0, 0.3, (N_CODES, width)), "w": r.normal(0, 0.2, (2 * hidden, k)), "c": np.zeros(k), "t": np.zeros((k, k)), "s": np.zeros(k)}
        for d in "fb":
            self.p |= {f"x{d}": r.normal(0, 0.25, (width, 4 * hidden)), f"h{d}": r.normal(0, 0.2, (hidden, 4 * hidden)), f"a{d}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}

    # -------------------------------------------------------------- the network

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray):
        t, n, _ = x.shape
        h, c, keep = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), []
        out = np.zeros((t, n, self.hidden))
        pre = x @ self.p[f"x{d}"] + self.p[f"a{d}"]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[i] + h @ self.p[f"h{d}"]
            a, f, o, g = np.split(z, 4, axis=1)
            a, f, o, g = _sigmoid(a), _sigmoid(f), _sigmoid(o), np.tanh(g)
            m = mask[i][:, None]
            c2 = (f * c + a * g) * m
            y = np.tanh(c2)
            keep.append((i, h, c, a, f, o, g, y, m))
            h, c = o * y * m, c2
            out[i] = h
        return out, keep

    def _direction_back(self, d: str, x: np.ndarray, keep: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dz_all = np.zeros((*dout.shape[:2], 4 * self.hidden))
        for i, h, c, a, f, o, g, y, m in reversed(keep):
            dh = (dh + dout[i]) * m
            dc = (dc + dh * o * (1 - y * y)) * m
            dz = np.concatenate([dc * g * a * (1 - a), dc * c * f * (1 - f), dh * y * o * (1 - o), dc * a * (1 - g * g)], axis=1)
            dz_all[i] = dz
            grad[f"h{d}"] += h.T @ dz
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        grad[f"x{d}"] += np.einsum("tnw,tnk->wk", x, dz_all)
        grad[f"a{d}"] += dz_all.sum(axis=(0, 1))
        return dz_all @ self.p[f"x{d}"].T

    def emissions(self, codes: np.ndarray, mask: np.ndarray):
        x = self.p["e"][codes]
        f, kf = self._direction("f", x, mask)
        b, kb = self._direction("b", x, mask)
        h = np.concatenate([f, b], axis=2)
        return h @ self.p["w"] + self.p["c"], (x, h, kf, kb)

    # ------------------------------------------------------------------ the CRF

    def loss(self, codes: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the gold tags, and its gradient."""
        em, (x, h, kf, kb) = self.emissions(codes, mask)
        t, n, k = em.shape
        tr, st = self.p["t"] + _ALLOWED, self.p["s"] + _START
        alpha = np.zeros((t, n, k))
        alpha[0] = st + em[0]
        for i in range(1, t):
            step = _lse(alpha[i - 1][:, :, None] + tr, 1) + em[i]
            alpha[i] = np.where(mask[i][:, None], step, alpha[i - 1])
        beta = np.zeros((t, n, k))
        for i in range(t - 2, -1, -1):
            step = _lse(tr + (em[i + 1] + beta[i + 1])[:, None, :], 2)
            beta[i] = np.where(mask[i + 1][:, None], step, beta[i + 1])
        logz = _lse(alpha[-1], 1)
        grad = {key: np.zeros_like(v) for key, v in self.p.items()}
        dem = np.exp(np.minimum(alpha + beta - logz[:, None], 0)) * mask[:, :, None]
        score = st[gold[0]] + em[0][np.arange(n), gold[0]]
        grad["s"] += dem[0].sum(axis=0) - np.bincount(gold[0], minlength=k)
        for i in range(1, t):
            m = mask[i]
            pair = np.exp(np.minimum(alpha[i - 1][:, :, None] + tr + (em[i] + beta[i])[:, None, :] - logz[:, None, None], 0)) * m[:, None, None]
            grad["t"] += pair.sum(axis=0)
            np.subtract.at(grad["t"], (gold[i - 1][m], gold[i][m]), 1)
            score = score + np.where(m, tr[gold[i - 1], gold[i]] + em[i][np.arange(n), gold[i]], 0)
        at = np.nonzero(mask)
        dem[at[0], at[1], gold[at]] -= 1
        dem /= n
        for key in "st":
            grad[key] /= n
        grad["w"] = np.einsum("tnh,tnk->hk", h, dem)
        grad["c"] = dem.sum(axis=(0, 1))
        dh = dem @ self.p["w"].T
        dx = self._direction_back("f", x, kf, dh[:, :, :self.hidden], grad) + self._direction_back("b", x, kb, dh[:, :, self.hidden:], grad)
        np.add.at(grad["e"], codes, dx)
        return float((logz - score).mean()), grad

    def fit(self, windows: list[str], gold: list[np.ndarray], epochs: int = 8, batch: int = 16, rate: float = 0.02, seed: int = 11) -> "Tagger":
        """Adam over the windows in a seeded order."""
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for b in range(0, len(order), batch):
                part = order[b:b + batch]
                codes, mask = pack([windows[i] for i in part])
                tags = np.zeros(codes.shape, np.int64)
                for j, i in enumerate(part):
                    tags[:len(gold[i]), j] = gold[i]
                _, grad = self.loss(codes, mask, tags)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, windows: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Spans (kind, start, end, score) of each window's best tag sequence; the
        score is how far its emissions are above those of no span."""
        codes, mask = pack(windows)
        em, _ = self.emissions(codes, mask)
        t, n, k = em.shape
        tr = self.p["t"] + _ALLOWED
        best, back = self.p["s"] + _START + em[0], np.zeros((t, n, k), np.int64)
        for i in range(1, t):
            all_ = best[:, :, None] + tr
            back[i] = all_.argmax(axis=1)
            best = np.where(mask[i][:, None], all_.max(axis=1) + em[i], best)
        tag = best.argmax(axis=1)
        path = np.zeros((t, n), np.int64)
        for i in range(t - 1, -1, -1):
            path[i] = np.where(mask[i], tag, 0)
            if i:
                tag = np.where(mask[i], back[i][np.arange(n), tag], tag)
        out: list[list[tuple[str, int, int, float]]] = []
        for j, w in enumerate(windows):
            spans, p = [], path[:len(w), j]
            gain = em[np.arange(len(w)), j, p] - em[:len(w), j, 0]
            for a in np.flatnonzero(p % 2 == 1).tolist():  # B tags
                b = a + 1
                while b < len(w) and p[b] == p[a] + 1:
                    b += 1
                spans.append((TAGS[p[a]][2:], a, b, float(gain[a:b].sum())))
            out.append(spans)
        return out


def pack(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, mask), both (longest window, windows)."""
    t = max(1, max((len(w) for w in windows), default=1))
    codes, mask = np.zeros((t, len(windows)), np.int64), np.zeros((t, len(windows)), bool)
    for j, w in enumerate(windows):
        codes[:len(w), j] = encode(w)
        mask[:len(w), j] = True
    return codes, mask
