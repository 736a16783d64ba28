"""A byte convolutional network in numpy: multi-width filters, max pooling, softmax."""

from __future__ import annotations

import numpy as np

WINDOW = 64
WIDTHS = (2, 3, 4, 5)
EMBED, FILTERS = 8, 40


def windows(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as fixed-length windows: (bytes, 0 beyond the end; number of the text; bytes in the window)."""
    counts = np.array([max(1, -(-len(t) // length)) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros((int(counts.sum()), length), np.uint8)
    used = np.zeros(len(out), np.int64)
    row = 0
    for t, n in zip(texts, counts, strict=True):
        flat = np.frombuffer(t, np.uint8)
        # Windows of one text are of even length, so none is a useless stub.
        cuts = np.linspace(0, len(flat), n + 1).astype(int)
        for k in range(n):
            piece = flat[cuts[k] : cuts[k + 1]]
            out[row, : len(piece)] = piece
            used[row] = len(piece)
            row += 1
    return out, owner, used


class ByteNet:
    """Bytes -> embedding -> filters of several widths -> ReLU -> max over positions -> softmax."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widest = max(WIDTHS)
        self.mask = np.zeros((self.widest, EMBED, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(self.widest * EMBED, -1)
        hidden = self.mask.shape[1]
        self.p = {
            "emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filt": (rng.normal(0, 0.3, self.mask.shape).astype(np.float32)) * self.mask,
            "fbias": np.zeros(hidden, np.float32),
            "out": rng.normal(0, 0.1, (hidden, classes)).astype(np.float32),
            "obias": np.zeros(classes, np.float32),
        }
        self.p["emb"][0] = 0

    @classmethod
    def of(cls, parameters: dict[str, np.ndarray]) -> ByteNet:
        net = cls(len(parameters["obias"]))
        net.p = dict(parameters)
        return net

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][x]
        n, length, _ = e.shape
        padded = np.zeros((n, length + self.widest - 1, EMBED), np.float32)
        padded[:, :length] = e
        flat = padded.reshape(n, -1)
        view = np.lib.stride_tricks.as_strided(flat, (n, length, self.widest * EMBED), (flat.strides[0], EMBED * 4, 4))
        return np.ascontiguousarray(view)

    def _forward(self, x: np.ndarray):
        col = self._columns(x)
        conv = col.reshape(-1, col.shape[2]) @ self.p["filt"]
        conv = conv.reshape(len(x), x.shape[1], -1)
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0] + self.p["fbias"]
        hidden = np.maximum(top, 0)
        logits = hidden @ self.p["out"] + self.p["obias"]
        return col, at, hidden, logits

    def log_probabilities(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        out = np.empty((len(x), self.p["obias"].size), np.float32)
        for s in range(0, len(x), batch):
            part = x[s : s + batch]
            conv = self._columns(part).reshape(-1, self.widest * EMBED) @ self.p["filt"]
            top = conv.reshape(len(part), part.shape[1], -1).max(axis=1) + self.p["fbias"]
            logits = np.maximum(top, 0) @ self.p["out"] + self.p["obias"]
            logits -= logits.max(axis=1, keepdims=True)
            out[s : s + batch] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, *, batch: int = 128, rate: float = 0.004, seed: int = 11, smooth: float = 0.05) -> None:
        """Adam on cross-entropy with label smoothing; deterministic for a seed."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        classes = self.p["obias"].size
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            xb, yb = x[pick], y[pick]
            col, at, hidden, logits = self._forward(xb)
            keep = (rng.random(hidden.shape) > 0.2).astype(np.float32) / 0.8
            logits = (hidden * keep) @ self.p["out"] + self.p["obias"]
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            goal = np.full((batch, classes), smooth / classes, np.float32)
            goal[np.arange(batch), yb] += 1 - smooth
            d_logits = (prob - goal) / batch
            grad = {"out": (hidden * keep).T @ d_logits, "obias": d_logits.sum(axis=0)}
            d_top = (d_logits @ self.p["out"].T) * keep * (hidden > 0)
            grad["fbias"] = d_top.sum(axis=0)
            best = col[np.arange(batch)[:, None], at]  # (batch, hidden, widest * embed)
            grad["filt"] = np.einsum("nf,nfc->cf", d_top, best) * self.mask
            d_col = d_top[:, :, None] * self.p["filt"].T[None]
            position = at[:, :, None] + np.arange(self.widest)[None, None]
            inside = position < xb.shape[1]
            byte = xb[np.arange(batch)[:, None, None], np.minimum(position, xb.shape[1] - 1)].astype(np.int64)
            byte[~inside] = 0
            flat = d_col.reshape(-1, EMBED)
            g = np.zeros_like(self.p["emb"])
            for c in range(EMBED):
                g[:, c] = np.bincount(byte.ravel(), weights=flat[:, c], minlength=256)
            g[0] = 0
            grad["emb"] = g
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in self.p.items():
                m[k] += 0.1 * (grad[k] - m[k])
                s[k] += 0.001 * (grad[k] ** 2 - s[k])
                v -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
            self.p["filt"] *= self.mask
