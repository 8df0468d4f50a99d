"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2k: begin of kind k; 2 + 2k: inside
SYMBOLS = 103

_BARRED = -1e4


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """Code points as symbols: printable ASCII as it is, the rest by class. 0 is padding."""
    out = np.full(len(codes), 101, np.int64)  # letters and signs beyond Latin
    ascii_ = (codes >= 32) & (codes < 127)
    out[ascii_] = codes[ascii_] - 31
    out[(codes == 10) | (codes == 13)] = 97
    out[(codes < 32) & (codes != 10) & (codes != 13)] = 98
    out[(codes >= 0xA0) & (codes < 0xC0)] = 99
    out[(codes >= 0xC0) & (codes < 0x250)] = 100
    return out


def barred() -> np.ndarray:
    """What is added to transitions: an inside tag follows its own kind only."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for before in range(TAGS):
            if before not in (inside - 1, inside):
                out[before, inside] = _BARRED
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_sum(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis, keepdims=True)
    return np.log(np.exp(v - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    """Weights: emb, (wx, wh, b) by direction, out, out_b, trans, start."""

    def __init__(self, hidden: int = 32, width: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": w(SYMBOLS, width) * np.sqrt(SYMBOLS).astype(np.float32) * np.float32(0.3)}
        for d in "fb":
            self.p |= {f"wx{d}": w(width, 4 * hidden), f"wh{d}": w(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # remember at first
        self.p |= {"out": w(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States over time (time, batch, hidden) of one direction, and what its gradient needs."""
        steps, batch, _ = x.shape
        n = self.hidden
        pre = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        h = np.zeros((batch, n), np.float32)
        c = np.zeros((batch, n), np.float32)
        out = np.empty((steps, batch, n), np.float32)
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"wh{d}"]
            g = _sigmoid(z[:, : 3 * n])
            u = np.tanh(z[:, 3 * n :])
            c2 = g[:, n : 2 * n] * c + g[:, :n] * u
            tc = np.tanh(c2)
            if keep:
                saved.append((t, h, c, g, u, tc))
            h, c = g[:, 2 * n :] * tc, c2
            out[t] = h
        return out, saved

    def emissions(self, symbols: np.ndarray, keep: bool = False):
        """symbols: (batch, time); scores: (time, batch, tags)."""
        x = self.p["emb"][symbols.T]
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, sf, sb)

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """Best tags (batch, time)."""
        return self.viterbi(self.emissions(symbols)[0])

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) of emissions (time, batch, tags)."""
        steps, batch, _ = e.shape
        trans = (self.p["trans"] + barred()).astype(np.float32)
        score = self.p["start"] + e[0]
        back = np.empty((steps, batch, TAGS), np.int8)
        for t in range(1, steps):
            every = score[:, :, None] + trans
            back[t] = every.argmax(1)
            score = every.max(1) + e[t]
        tags = np.empty((batch, steps), np.int64)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums (time, batch, tags) of emissions, and the log sum over all paths (batch)."""
        trans = (self.p["trans"] + barred()).astype(np.float64)
        e = e.astype(np.float64)
        alpha, beta = np.empty(e.shape), np.zeros(e.shape)
        alpha[0] = self.p["start"] + e[0]
        for t in range(1, len(e)):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _log_sum(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _log_sum(alpha[-1], 1)

    def certainty(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The CRF's probability of each place's tag (batch, time)."""
        alpha, beta, total = self._sums(e)
        at, rows = np.arange(len(e))[None, :], np.arange(e.shape[1])[:, None]
        return np.exp((alpha + beta)[at, rows, tags] - total[:, None])

    def gradient(self, symbols: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tag sequences (batch, time), and its gradient."""
        e, (x, both, sf, sb) = self.emissions(symbols, keep=True)
        steps, batch, _ = e.shape
        trans = (self.p["trans"] + barred()).astype(np.float64)
        e64 = e.astype(np.float64)
        alpha, beta, total = self._sums(e)
        marginal = np.exp(alpha + beta - total[None, :, None])
        rows = np.arange(batch)
        gold_t = gold.T
        path = e64[np.arange(steps)[:, None], rows, gold_t].sum(0) + self.p["start"][gold[:, 0]] + trans[gold_t[:-1], gold_t[1:]].sum(0)
        de = marginal
        de[np.arange(steps)[:, None], rows, gold_t] -= 1
        dtrans = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e64[t] + beta[t] - total[:, None])[:, None, :]).sum(0)
        np.add.at(dtrans, (gold_t[:-1], gold_t[1:]), -1)
        de = (de / batch).astype(np.float32)
        g = {"trans": (dtrans / batch).astype(np.float32), "start": de[0].sum(0), "out_b": de.sum((0, 1))}
        g["out"] = np.tensordot(both, de, ((0, 1), (0, 1)))
        dboth = de @ self.p["out"].T
        n = self.hidden
        dx = np.zeros_like(x)
        for d, saved, dh_all in (("f", sf, dboth[:, :, :n]), ("b", sb, dboth[:, :, n:])):
            wx, wh = self.p[f"wx{d}"], self.p[f"wh{d}"]
            gwx, gwh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * n, np.float32)
            dh = np.zeros((batch, n), np.float32)
            dc = np.zeros((batch, n), np.float32)
            for t, h0, c0, gate, u, tc in reversed(saved):
                i, f, o = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
                gwx += x[t].T @ dz
                gwh += h0.T @ dz
                gb += dz.sum(0)
                dx[t] += dz @ wx.T
                dh, dc = dz @ wh.T, dc * f
            g |= {f"wx{d}": gwx, f"wh{d}": gwh, f"b{d}": gb}
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], symbols.T, dx)
        return float((total - path).mean()), g

    def fit(self, symbols: np.ndarray, gold: np.ndarray, rounds: int = 3, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; the mean loss of each round."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        for turn in range(rounds):
            order, seen = r.permutation(len(symbols)), []
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                loss, g = self.gradient(symbols[some], gold[some])
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.99 * v2[k] + 0.01 * x * x
                    self.p[k] = (self.p[k] - rate / (1 + turn) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a tag sequence; an inside tag at the start begins a span."""
    out, kind, begin = [], -1, 0
    for k, tag in enumerate([*tags.tolist(), 0]):
        if kind >= 0 and tag != 2 + 2 * kind:
            out.append((kind, begin, k))
            kind = -1
        if tag and kind < 0:
            kind, begin = (tag - 1) // 2, k
    return out
