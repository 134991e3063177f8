"""Quality classifier: a byte convolutional network over overlapping chunks of the whole document.

Each chunk's filters are max-pooled into a chunk's log-odds; a logistic combination of their mean,
smallest and largest gives the document's probability of quality 1.

The model learns from whole texts of a bounded sample of labelled ids, each chunk of them. The sample is
the first max_rows by a hash, as far as they fit into SAMPLE_BYTES; a text that doesn't fit is passed over.

Defined results: a null or empty text is one chunk of zeros and has a score as any other. With no
labelled row, or labels of one kind only, every score is that kind's share (0.5 without rows). An id
with several labels has the largest, one with several texts teaches one of them. Repeated rows give
repeated rows; an empty table gives none. Ids may be null, repeated and of any type: they pass through
untouched. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrow import kept_with, mapped, text_of
from cadenza.llm.bytecnn import ByteCNN, windows_of
from cadenza.llm.op7_langid import among_first, fold_of, sample_of, share_of, windows_with

CHUNK, STRIDE = 384, 320


@dataclass
class QualityModel:
    net: ByteCNN | None
    combine: np.ndarray
    constant: float = 0.5

    def features(self, odds: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(odds, first) / counts
        return np.stack([mean, np.minimum.reduceat(odds, first), np.maximum.reduceat(odds, first), np.ones(len(first))], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), self.constant)
        windows, first, _ = windows_of(texts, CHUNK, STRIDE, self.net.margin)
        z = self.net.logits(windows)
        counts = np.diff(np.append(first, len(windows)))
        return 1 / (1 + np.exp(-np.clip(self.features((z[:, 1] - z[:, 0]).astype(float), first, counts) @ self.combine, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def train_quality_model(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 5000, filters: int = 16, widths: tuple[int, ...] = (3, 5), steps: int = 900, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from at most max_rows labelled ids (chosen by a hash) whose crc32(id as text) mod folds is not held_out."""
    rank = F.xxhash64(F.lit("sample"), F.col(id_col))
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(id_col, folds) != held_out)).groupBy(id_col).agg(F.max(label_col).cast("long").alias("label"))
    few = marked.where(among_first(rank, share_of(marked.count(), max_rows))).orderBy(rank, id_col).limit(max_rows)
    rows = docs.select(F.col(id_col), text_of(docs, text_col).alias("text")).join(F.broadcast(few), id_col)  # max_rows ids at most
    sample = sample_of(rows.select(rank.alias("rank"), "label", "text"), 1.0, max_rows)
    if sample["label"].nunique() < 2:
        return QualityModel(None, np.zeros(4), float(sample["label"].mean()) if len(sample) else 0.5)
    y = sample["label"].to_numpy(np.int64)
    net = ByteCNN.fresh(widths, filters, 2, 3)
    windows, first, marks, weights = windows_with([t.encode() for t in sample["text"]], y, CHUNK, STRIDE, net.margin)
    net.train(windows, marks, weights, steps, 3)
    model = QualityModel(net, np.zeros(4))
    z = net.logits(windows)
    counts = np.diff(np.append(first, len(windows)))
    model.combine = _logistic(model.features((z[:, 1] - z[:, 0]).astype(float), first, counts), y.astype(float))
    return model


def with_quality(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """kept (a struct of the columns in keep, of any names) and score for each row."""
    rows = kept_with(docs, keep, text=text_of(docs, text_col))
    return mapped(rows, ["text"], {"score": "double"}, lambda texts: {"score": model.score([t.encode() for t in texts])}, 200)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score for each row, and the columns named in keep (but for one named score)."""
    names = [c for c in dict.fromkeys([id_col, *keep]) if c != "score"]
    return with_quality(docs, model, names, text_col).select("kept.*", "score")
