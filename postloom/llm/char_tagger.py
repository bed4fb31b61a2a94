"""A character-level bidirectional LSTM with CRF transitions, in numpy: windows of characters to labels."""

from __future__ import annotations

import numpy as np

WINDOW = 64
#: Characters have their own class in ASCII; beyond it there are letters and others.
CLASSES = 128
LETTER, OTHER, PAD = 1, 2, 0


def classes(text: str) -> np.ndarray:
    """A class for each character."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(cp < 128, cp, LETTER).astype(np.uint8)
    out[cp < 3] = OTHER  # their places are taken
    beyond = np.flatnonzero(cp >= 128)
    if len(beyond):
        kinds, back = np.unique(cp[beyond], return_inverse=True)
        letters = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in kinds.tolist()])
        out[beyond] = np.where(letters[back], LETTER, OTHER)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Parameters in a dict of arrays; the two directions are the first axis of the LSTM's."""

    def __init__(self, labels: int, embedding: int = 12, hidden: int = 20, seed: int = 5):
        r = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        draw = lambda *shape: r.normal(0, 1 / np.sqrt(shape[-2]), shape)
        self.p = {
            "embed": r.normal(0, 0.3, (CLASSES, embedding)),
            "wx": draw(2, embedding, 4 * hidden),
            "wh": draw(2, hidden, 4 * hidden),
            "b": np.zeros((2, 1, 4 * hidden)),
            "out": draw(2 * hidden, labels),
            "bias": np.zeros(labels),
            "move": np.zeros((labels, labels)),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1  # forget gates start open
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _emissions(self, x: np.ndarray, keep: bool = False):
        p, n, (rows, steps) = self.p, self.hidden, x.shape
        e = p["embed"][x]
        both = np.stack([e, e[:, ::-1]]).transpose(0, 2, 1, 3)  # direction, step, row, embedding
        pre = both @ p["wx"][:, None] + p["b"][:, None]
        h, c = np.zeros((2, rows, n), pre.dtype), np.zeros((2, rows, n), pre.dtype)
        states, held = np.empty((2, steps, rows, n), pre.dtype), []
        for t in range(steps):
            z = pre[:, t] + h @ p["wh"]
            gates, g = _sigmoid(z[..., : 3 * n]), np.tanh(z[..., 3 * n :])
            i, f, o = gates[..., :n], gates[..., n : 2 * n], gates[..., 2 * n :]
            before, last = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            states[:, t] = h
            if keep:
                held.append((before, last, i, f, o, g, tc))
        s = np.concatenate([states[0], states[1, ::-1]], -1)  # step, row, 2 * hidden
        return s @ p["out"] + p["bias"], (both, s, held)

    def _forward_backward(self, em: np.ndarray):
        """Marginals of labels (step, row, label), scaled alphas and betas, and the factors between steps."""
        a = np.exp(em - em.max(-1, keepdims=True))
        move = np.exp(self.p["move"])
        alpha, beta = np.empty_like(a), np.ones_like(a)
        alpha[0] = a[0] / a[0].sum(-1, keepdims=True)
        for t in range(1, len(a)):
            v = (alpha[t - 1] @ move) * a[t]
            alpha[t] = v / v.sum(-1, keepdims=True)
        for t in range(len(a) - 2, -1, -1):
            v = (a[t + 1] * beta[t + 1]) @ move.T
            beta[t] = v / v.sum(-1, keepdims=True)
        m = alpha * beta
        return m / m.sum(-1, keepdims=True), alpha, beta, a, move

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood of rows x with labels y, by step and row."""
        p, n, (rows, steps) = self.p, self.hidden, x.shape
        em, (both, s, held) = self._emissions(x, keep=True)
        marginal, alpha, beta, a, move = self._forward_backward(em)
        gold = y.T
        d = marginal.copy()
        d[np.arange(steps)[:, None], np.arange(rows), gold] -= 1
        d /= rows
        v = alpha[:-1, :, :, None] * move * (a * beta)[1:, :, None, :]
        moves = (v / v.sum((2, 3), keepdims=True)).sum((0, 1))
        np.subtract.at(moves, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        flat = lambda z: z.reshape(-1, z.shape[-1])
        g = {"move": moves / rows, "out": flat(s).T @ flat(d), "bias": d.sum((0, 1))}
        ds = d @ p["out"].T
        ds = np.stack([ds[..., :n], ds[::-1, :, n:]])
        dh, dc = np.zeros((2, rows, n), em.dtype), np.zeros((2, rows, n), em.dtype)
        dz = np.empty((2, steps, rows, 4 * n), em.dtype)
        wh, inputs = p["wh"].transpose(0, 2, 1), np.empty((2, steps, rows, n), em.dtype)
        for t in range(steps - 1, -1, -1):
            before, last, i, f, o, gg, tc = held[t]
            inputs[:, t] = before
            dh = dh + ds[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[:, t]
            z[..., :n], z[..., n : 2 * n] = dc * gg * i * (1 - i), dc * last * f * (1 - f)
            z[..., 2 * n : 3 * n], z[..., 3 * n :] = dh * tc * o * (1 - o), dc * i * (1 - gg * gg)
            dh, dc = z @ wh, dc * f
        g["wh"] = np.stack([flat(inputs[k]).T @ flat(dz[k]) for k in (0, 1)])
        g["wx"] = np.stack([flat(both[k]).T @ flat(dz[k]) for k in (0, 1)])
        g["b"] = dz.sum((1, 2))[:, None]
        de = dz @ p["wx"].transpose(0, 2, 1)[:, None]
        de, at = flat(de[0] + de[1, ::-1]), x.T.ravel()
        g["embed"] = np.stack([np.bincount(at, de[:, k], CLASSES) for k in range(de.shape[1])], 1).astype(em.dtype)
        return g

    def fit(self, draw, steps: int, rate: float = 0.01) -> None:
        """Adam over so many batches of draw(step) -> (x, y)."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            g = self.gradients(*draw(t))
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            now = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 5 / (norm + 1e-12))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best label path of each row (Viterbi) and its labels' marginal probabilities."""
        em, _ = self._emissions(x)
        marginal = self._forward_backward(em)[0]
        steps, rows, _ = em.shape
        score, back = em[0], np.empty((steps, rows, self.labels), np.int8)
        for t in range(1, steps):
            v = score[:, :, None] + self.p["move"]
            back[t] = v.argmax(1)
            score = v.max(1) + em[t]
        path = np.empty((steps, rows), np.int64)
        path[-1] = score.argmax(1)
        each = np.arange(rows)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][each, path[t]]
        return path.T, np.take_along_axis(marginal, path[..., None], -1)[..., 0].T
