"""A convolutional network over bytes, in numpy: multi-width filters, max pooling, a linear layer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def windows_of(texts: list[bytes], length: int, stride: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte windows, the first window of each text, bytes of text in each window).

    Windows start every stride bytes until they cover the text, are length + margin bytes long and
    padded with zeros; an empty text has one window of zeros.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = 1 + np.maximum(0, -(-(sizes - length) // stride))
    first = np.cumsum(counts) - counts
    pad = b"\0" * (length + margin)
    flat = np.frombuffer(b"".join(t + pad for t in texts), np.uint8)
    begins = np.cumsum(sizes + len(pad)) - sizes - len(pad)
    order = np.arange(int(counts.sum())) - np.repeat(first, counts)
    at = np.repeat(begins, counts) + order * stride
    held = np.clip(np.repeat(sizes, counts) - order * stride, 0, length)
    return flat[at[:, None] + np.arange(length + margin)], first, held


@dataclass
class ByteCNN:
    """tables[j]: what byte j of a filter's span adds to it; filters are sorted from wide to narrow."""

    widths: tuple[int, ...]
    filters: int
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, widths: tuple[int, ...], filters: int, classes: int, seed: int) -> ByteCNN:
        rng, widths = np.random.default_rng(seed), tuple(sorted(widths, reverse=True))
        spans = [sum(filters for w in widths if w > j) for j in range(widths[0])]
        tables = [rng.normal(0, 0.3, (256, n)).astype(np.float32) for n in spans]
        dense = rng.normal(0, 0.1, (spans[0], classes)).astype(np.float32)
        return cls(widths, filters, tables, np.zeros(spans[0], np.float32), dense, np.zeros(classes, np.float32))

    @property
    def margin(self) -> int:
        return self.widths[0] - 1

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each window, and its place if asked for."""
        length, step = windows.shape[1] - self.margin, 32
        best = np.empty((len(windows), len(self.bias)), np.float32)
        place = np.empty(best.shape, np.int32) if where else None
        for lo in range(0, len(windows), step):
            part = windows[lo : lo + step]
            total = self.tables[0].take(part[:, :length], axis=0)
            for j in range(1, len(self.tables)):
                table = self.tables[j]
                total[:, :, : table.shape[1]] += table.take(part[:, j : j + length], axis=0)
            if where:
                place[lo : lo + step] = total.argmax(1)
            total.max(1, out=best[lo : lo + step])
        return best + self.bias, place

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(windows)[0], 0) @ self.dense + self.dense_bias

    def train(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int, seed: int, rate: float = 0.01, batch: int = 128) -> None:
        """Adam on the weighted cross-entropy, in at least so many steps; only the bytes at a filter's largest value get a gradient.

        Whole epochs: every window is used as often as any other, once at least.
        """
        epochs = max(1, round(steps * batch / len(windows)))
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.dense, self.dense_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        t, steps = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                x, y, w = windows[rows], labels[rows], weights[rows] / weights[rows].sum()
                value, place = self.pooled(x, True)
                hidden = np.maximum(value, 0)
                z = hidden @ self.dense + self.dense_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= w[:, None]
                back = (p @ self.dense.T) * (value > 0)
                grads = []
                for j, table in enumerate(self.tables):
                    n = table.shape[1]
                    index = x[np.arange(len(x))[:, None], place[:, :n] + j].astype(np.int64) * n + np.arange(n)
                    grads.append(np.bincount(index.ravel(), back[:, :n].ravel(), 256 * n).reshape(256, n))
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                t += 1
                now = rate * (1 - 0.9 * t / steps)
                for param, grad, (m, v) in zip(params, grads, moments):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    param -= (now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)
