"""Language ID: a byte convolutional network over fixed-length windows that cover the whole text.

The model learns from whole texts of a bounded sample of labelled rows, each window of them. The sample is
the first max_rows by a hash, as far as they fit into SAMPLE_BYTES; a text that doesn't fit is passed over.

Defined results: a text that is null or has no letter is ``und`` with score 0. Languages are those
of the training rows; with no training row every text is ``und``. Repeated rows give repeated rows, but
teach once. An empty table gives no rows. Ids may be null, repeated and of any type: they pass through
untouched. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrow import kept_with, mapped, text_of
from cadenza.llm.bytecnn import ByteCNN, softmax, windows_of

WINDOW = 256
LETTER = r"\p{L}"
#: Bytes of whole texts in a training sample, at most: what the driver holds.
SAMPLE_BYTES = 48_000_000


@dataclass
class LanguageModel:
    languages: list[str]
    net: ByteCNN | None

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability: log-probabilities of windows, averaged by their bytes."""
        if self.net is None or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(self.languages) == 1:
            return self.languages * len(texts), np.ones(len(texts))
        windows, first, held = windows_of(texts, WINDOW, WINDOW, self.net.margin)
        logs = np.log(softmax(self.net.logits(windows)) + 1e-9) * np.maximum(held, 1)[:, None]
        mean = np.add.reduceat(logs, first) / np.add.reduceat(np.maximum(held, 1), first)[:, None]
        p = softmax(mean.astype(float))
        best = p.argmax(1)
        return [self.languages[i] for i in best], p[np.arange(len(best)), best]


def fold_of(column: str, folds: int) -> F.Column:
    """crc32 of the value as text, modulo folds; null counts as text that is empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def among_first(rank: Column, share: float) -> Column:
    """Whether a rank (a hash, spread over all signed 64-bit integers) is in the lowest share of them."""
    limit = int(min(1.0, share) * 2**64) - 2**63 - 1
    return F.lit(share >= 1.0) | (rank <= F.lit(max(-(2**63), min(2**63 - 1, limit))))


def sample_of(rows: DataFrame, share: float, max_rows: int, max_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """label and text of at most max_rows rows, the first by column rank (a hash), and of these as many as have max_bytes together.

    Texts are whole: a row that would go beyond max_bytes is left out, those after it that fit are not; if
    none fits, the smallest is taken. Rows of one rank are one. share of the rows are expected to be enough;
    only their texts leave a task.
    """
    few = rows.where(among_first(F.col("rank"), share)).groupBy("rank").agg(F.min(F.struct("label", "text")).alias("m")).select("rank", "m.label", "m.text")

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, smallest = max_bytes, None
        for batch in batches:
            keep = []
            for row, size in enumerate(batch.column("bytes").to_pylist()):
                if size <= left:
                    left -= size
                    keep.append(row)
                elif left == max_bytes and (smallest is None or size < smallest.column("bytes")[0].as_py()):
                    smallest = batch.take(pa.array([row]))
            yield batch.take(pa.array(keep, pa.int64()))
        if left == max_bytes and smallest is not None:
            yield smallest

    # the first rows by rank are one partition, in order; texts stay Arrow's
    ranked = few.orderBy("rank").limit(max_rows).select("label", "text", F.octet_length("text").cast("long").alias("bytes"))
    return ranked.mapInArrow(fitting, ranked.schema).select("label", "text").toPandas()


def share_of(rows: int, max_rows: int) -> float:
    return (1.2 * max_rows + 50) / max(1, rows)


def windows_with(texts: list[bytes], labels: np.ndarray, length: int, stride: int, margin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, first window of each text, each window's label, its weight): kinds count by the root of their rows, a text by the root of its windows."""
    windows, first, _ = windows_of(texts, length, stride, margin)
    counts = np.diff(np.append(first, len(windows)))
    weight = (1.0 / np.sqrt(np.bincount(labels).clip(1)))[labels] / np.sqrt(counts)
    return windows, first, np.repeat(labels, counts), np.repeat(weight, counts)


def train_language_model(docs: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 4000, filters: int = 16, widths: tuple[int, ...] = (2, 3, 4), steps: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from at most max_rows labelled rows (chosen by a hash of id and text) whose crc32(id as text) mod folds is not held_out."""
    taught = docs.where(F.col(lang_col).isNotNull() & (fold_of(id_col, folds) != held_out))
    rows = taught.where(F.col(text_col).rlike(LETTER)).select(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)).alias("rank"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    sample = sample_of(rows, share_of(taught.count(), max_rows), max_rows)
    languages = sorted(sample["label"].unique())
    if not languages:
        return LanguageModel([], None)
    net = ByteCNN.fresh(widths, filters, len(languages), 7)
    windows, _, labels, weights = windows_with([t.encode() for t in sample["text"]], sample["label"].map(languages.index).to_numpy(), WINDOW, WINDOW, net.margin)
    net.train(windows, labels, weights, steps, 7)
    return LanguageModel(languages, net)


def with_language(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """kept (a struct of the columns in keep, of any names), lang_pred and score for each row."""

    def made(texts: list, lettered: list) -> dict:
        ok = np.array(lettered, bool)
        found, score = model.predict([t.encode() if x else b"" for t, x in zip(texts, ok)])
        langs = [x if o else "und" for x, o in zip(found, ok)]
        return {"lang_pred": langs, "score": np.where(np.array(langs) != "und", score, 0.0).astype(float)}

    rows = kept_with(docs, keep, text=text_of(docs, text_col), lettered=F.coalesce(docs[f"`{text_col}`"].rlike(LETTER), F.lit(False)))
    return mapped(rows, ["text", "lettered"], {"lang_pred": "string", "score": "double"}, made, 200)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score for each row, and the columns named in keep (but for those named as the results are)."""
    names = [c for c in dict.fromkeys([id_col, *keep]) if c not in ("lang_pred", "score")]
    return with_language(docs, model, names, text_col).select("kept.*", "lang_pred", "score")
