"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of 1/(V+1), c(w)/N and, for each longer context,
c(context, w)/c(context). The mixture's weights depend on the bucket (power of two) of the context's
count, and come from expectation-maximisation on deleted counts: every training token is held out of
its own counts (each count less one).

Counting is one shuffle. A task packs its documents into blocks, hashes tokens and n-grams to 64 bits
and sends each distinct one once per block, with its count, as sorted key ranges ("shards"). A shard
adds up the counts of all blocks and answers each block with the totals of the keys it sent. The
blocks then hold all counts that they need; the weights come from a bounded histogram of counts.

Defined results: a null or empty text has one token, its end. Repeated rows count as often as they
occur. An empty table gives no rows. Tokens that no training document has get the mixture's uniform
part. Two different n-grams share a count only if their 64-bit hashes agree. Ids may be null (a null id
teaches), repeated and of any type: they pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.llm.arrow import kept_with, text_of
from cadenza.llm.op7_langid import fold_of
from cadenza.llm.store import materialized

RESULT = {"held_out": "boolean", "n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 6_000_000
#: Bytes of text for each shard.
SHARD_BYTES = 8_000_000
#: Steps of the histogram of counts for expectation-maximisation, per doubling of a count.
STEPS = 4

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BEGIN_KEY = _mixed(np.array([_BEGIN + np.uint64(1)], np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a lower-cased text, by differences of one running polynomial."""
    found = []
    step = 1 << 20
    start = 0
    while start < len(text):
        stop = min(len(text), start + step)
        while stop < len(text) and not _SPACE[text[stop]]:
            stop += 1
        b = np.frombuffer(text, np.uint8, stop - start, start)
        word = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
        first, last = edge[::2], edge[1::2]
        powers, inverse = _powers(len(b), _BASE), _powers(len(b), _INVERSE)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * powers[:-1])])
        value = (running[last] - running[first]) * inverse[first]
        found.append(_mixed(value + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        start = stop
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Block:
    """Documents with the keys of all their n-grams: order[k] has a key for each token (k + 1 tokens long)."""

    def __init__(self, texts: list[bytes], order: int):
        low = [t.lower() for t in texts]
        hashes = word_hashes(b"\n".join(low))
        lengths = np.array([len(t.split()) for t in low], np.int64)
        self.ends = np.cumsum(lengths + 1)
        total = int(self.ends[-1]) if len(texts) else 0
        tokens = np.full(total, _END, np.uint64)
        keep = np.ones(total, bool)
        keep[self.ends - 1] = False
        tokens[keep] = hashes
        self.tokens_of = lengths + 1
        self.row = np.repeat(np.arange(len(texts)), self.tokens_of)
        starts = self.ends - self.tokens_of
        place = np.arange(total) - starts[self.row]
        self.order = [_mixed(tokens + np.uint64(1))]
        before = tokens
        context = np.zeros(total, np.uint64)
        for k in range(1, order):
            before = np.concatenate([[_BEGIN], before[:-1]]) if total else before
            before = np.where(place < k, _BEGIN, before)
            context = _mixed(context * _BASE + before + np.uint64(k))
            self.order.append(_mixed(_mixed(context + np.uint64(k)) + tokens))

    def asked(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys; how often training documents have each; which are single tokens.

        A context has no key of its own: as often as its tokens are followed by one, they occur (contexts_of).
        """
        everything = np.concatenate([*self.order, _BEGIN_KEY])
        weight = np.concatenate([np.tile(train[self.row], len(self.order)), [0]]).astype(np.int64)
        unique, inverse = np.unique(everything, return_inverse=True)
        counts = np.bincount(inverse, weight, len(unique)).astype(np.int64)
        counts[np.searchsorted(unique, _BEGIN_KEY)] += int(train.sum())
        single = np.zeros(len(unique), bool)
        single[inverse[: len(self.order[0])]] = True
        single[np.searchsorted(unique, _BEGIN_KEY)] = False
        return unique, counts, single


def contexts_of(counts: list[np.ndarray], lengths: np.ndarray, begin: int) -> list[np.ndarray]:
    """For each token and each k of 1 to the order less 1: the total of the k tokens before it.

    No context ends with an end, so that its total is the n-gram's that ends one token before; begin
    (of documents) is the total of the contexts before a document's first token.
    """
    starts, out = np.cumsum(lengths) - lengths, []
    for total in counts[:-1]:
        before = np.concatenate([[begin], total[:-1]])
        before[starts] = begin
        out.append(before)
    return out


def _squeezed(a: np.ndarray) -> bytes:
    """Integers by planes of bytes: compresses well when most are small."""
    return zlib.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def _restored(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1) if len(planes) else np.zeros(0, kind)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, list[bytes]]]:
    """(block, kept, which rows teach, texts): the same for every scan of the same partitions in the same order."""
    part, count = TaskContext.get().partitionId(), 0
    kept, teach, texts, held = [], [], [], 0
    for batch in batches:
        lo = 0
        for at, (taught, text) in enumerate(zip(batch.column("teach").to_pylist(), batch.column("text").to_pylist())):
            teach.append(taught)
            texts.append(text.encode())
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield part << 24 | count, pa.concat_arrays([*kept, batch.column("kept").slice(lo, at + 1 - lo)]), np.array(teach, bool), texts
                count, lo, kept, teach, texts, held = count + 1, at + 1, [], [], [], 0
        if lo < batch.num_rows:
            kept.append(batch.column("kept").slice(lo))
    if texts:
        yield part << 24 | count, pa.concat_arrays(kept), np.array(teach, bool), texts


def _frozen(kept: pa.Array) -> bytes:
    """Rows of any type as bytes, so that no column of them is looked at on the way."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([kept], names=["kept"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _thawed(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column("kept").combine_chunks()


def _mark(keys: np.ndarray) -> int:
    """Of a block's sorted keys: says whether the totals that come back are of the keys that were sent."""
    return int(np.bitwise_xor.reduce(_mixed(keys))) >> 1 if len(keys) else 0


def histogram_of(block: Block, counts: list[np.ndarray], contexts: list[np.ndarray], train: np.ndarray) -> pd.DataFrame:
    """How many training tokens have counts in each cell; a cell is a step of the logarithm of each count."""
    rows = train[block.row]
    cell = lambda x: np.floor(np.log2(np.maximum(x, 1)) * STEPS).astype(np.int64) + (x > 0)
    code = np.zeros(int(rows.sum()), np.int64)
    for a in [*contexts, *counts]:
        code = code * 256 + cell(a[rows] - 1)
    codes, n = np.unique(code, return_counts=True)
    return pd.DataFrame({"code": codes, "n": n})


def _middle(cell: np.ndarray) -> np.ndarray:
    """The count that a cell stands for."""
    low = 2.0 ** ((cell - 1) / STEPS)
    return np.where(cell == 0, 0.0, np.where(cell <= 3 * STEPS, np.ceil(low - 1e-9), low * 2.0 ** (0.5 / STEPS)))


def bucket(context: np.ndarray) -> np.ndarray:
    """Of a context's count, by powers of two; bucket 0 is a context never seen."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0).clip(0, 63)


def learn_weights(hist: pd.DataFrame, order: int, n_all: int, vocabulary: int, rounds: int = 40) -> list[np.ndarray]:
    """For each context length k of 0 to order - 1: the share of the longer part by bucket, learnt by expectation-maximisation.

    A probability is share * c(context, w)/c(context) + (1 - share) * the probability with the next shorter context.
    """
    code, n = hist["code"].to_numpy(), hist["n"].to_numpy(float)
    cells = []
    for _ in range(2 * order - 1):
        cells.append(_middle(code % 256))
        code = code // 256
    counts, contexts = cells[:order][::-1], cells[order:][::-1]
    weights, lower = [], np.full(len(n), 1.0 / (vocabulary + 1))
    for k in range(order):
        whole = np.full(len(n), float(max(n_all - 1, 1))) if k == 0 else contexts[k - 1]
        ratio = np.where(whole > 0, np.minimum(1.0, counts[k] / np.maximum(whole, 1)), 0.0)
        where = np.zeros(len(n), np.int64) if k == 0 else bucket(whole)
        share = np.full(64, 0.5)
        for _ in range(rounds):
            long, short = share[where] * ratio, (1 - share[where]) * lower
            part = np.bincount(where, n * long / (long + short), 64)
            seen = np.bincount(where, n, 64)
            share = (part + 0.5) / (seen + 1.0)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        if k:
            share[0] = 0.0
        weights.append(share)
        lower = share[where] * ratio + (1 - share[where]) * lower
    return weights


def probabilities(counts: list[np.ndarray], contexts: list[np.ndarray], weights: list[np.ndarray], n_all: int, vocabulary: int) -> np.ndarray:
    """Of each token, given the totals of its n-grams and contexts."""
    p = np.full(len(counts[0]), 1.0 / (vocabulary + 1))
    for k, share in enumerate(weights):
        whole = np.full(len(p), float(max(n_all, 1))) if k == 0 else contexts[k - 1].astype(float)
        s = share[0 if k == 0 else bucket(whole)]
        p = s * np.where(whole > 0, counts[k] / np.maximum(whole, 1), 0.0) + (1 - s) * p
    return p


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows whose crc32(id as text) mod folds is not held_out.

    docs is read twice and must give the same rows in the same order, as files do; where it doesn't (a
    block's keys differ), the job fails and no wrong score is returned. Write docs to a table first then.
    """
    if id_col in RESULT:
        raise ValueError(f"the id column has the name of a result's: {id_col}")
    rows = kept_with(docs, [id_col], teach=fold_of(id_col, folds) != held_out, text=text_of(docs, text_col))
    kept_type = rows.schema["kept"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(1, size // SHARD_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, teach, texts in _in_blocks(batches):
            keys, counts, single = Block(texts, order).asked(teach)
            border = np.searchsorted(keys, [np.uint64((s << 64) // shards) for s in range(1, shards)])
            for shard, (k, c, s) in enumerate(zip(np.split(keys, border), np.split(counts, border), np.split(single, border))):
                if len(k):
                    sent = [shard], [number], [_squeezed(np.diff(k, prepend=np.uint64(0)))], [_squeezed((c.astype(np.uint32) << np.uint32(1)) | s.astype(np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(sent, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "keys", "counts"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_restored(k, "<u8")) for k in group["keys"]]
        packed = np.concatenate([_restored(c, "<u4") for c in group["counts"]])
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, packed >> np.uint32(1), len(unique)).astype(np.int64)
        single = np.zeros(len(unique), bool)
        single[inverse[(packed & np.uint32(1)) > 0]] = True
        shares = np.split(totals[inverse], np.cumsum([len(k) for k in keys])[:-1])
        shard = int(group["shard"].iloc[0])
        found = [(int(b), shard, _squeezed(s.astype("<u4") if s.max(initial=0) < 1 << 32 else s), s.max(initial=0) >= 1 << 32, _mark(k), 0, 0) for b, k, s in zip(group["block"], keys, shares)]
        found.append((-1 - shard, shard, b"", False, 0, int(totals[single].sum()), int((totals[single] > 0).sum())))
        return pd.DataFrame(found, columns=["block", "shard", "totals", "wide", "mark", "tokens", "types"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, kept, teach, texts in _in_blocks(batches):
            lengths = np.array([len(t) for t in texts], "<u4").tobytes()
            made = [number], [_frozen(kept)], [teach.tobytes()], [lengths], [zlib.compress(b"".join(texts), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int64(), *[pa.binary()] * 4))], names=["block", "kept", "teach", "lengths", "texts"])

    def resolve(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["kept", "teach", "n_tokens", "counts", "begin", "hist", "tokens", "types"]
        if key[0] < 0:
            return pd.DataFrame([(b"", b"", b"", [], 0, [], int(answers["tokens"].sum()), int(answers["types"].sum()))], columns=columns)
        if len(blocks) != 1:
            raise ValueError("the rows were read in two orders: write them to a table first")
        lengths, raw, train = np.frombuffer(blocks["lengths"].iloc[0], "<u4"), zlib.decompress(blocks["texts"].iloc[0]), np.frombuffer(blocks["teach"].iloc[0], bool)
        at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        block = Block([raw[a:b] for a, b in zip(at[:-1], at[1:])], order)
        keys = block.asked(train)[0]
        answers = answers.sort_values("shard")
        parts = [_restored(t, "<i8" if w else "<u4").astype(np.int64) for t, w in zip(answers["totals"], answers["wide"])]
        marks = [_mark(k) for k in np.split(keys, np.cumsum([len(x) for x in parts])[:-1])] if sum(map(len, parts)) == len(keys) else None
        if marks != answers["mark"].tolist():
            raise ValueError("the rows were read in two orders: write them to a table first")
        totals = np.concatenate(parts)
        look = lambda k: totals[np.searchsorted(keys, k)]
        counts = [look(k) for k in block.order]
        begin = int(look(_BEGIN_KEY)[0])
        contexts = contexts_of(counts, block.tokens_of, begin)
        hist = histogram_of(block, counts, contexts, train)
        pairs = [{"code": int(c), "n": int(n)} for c, n in zip(hist["code"], hist["n"])]
        return pd.DataFrame([(blocks["kept"].iloc[0], blocks["teach"].iloc[0], block.tokens_of.astype("<u4").tobytes(), [_squeezed(c.astype("<u8")) for c in counts], begin, pairs, 0, 0)], columns=columns)

    asked = rows.select("teach", "text", "kept").mapInArrow(ask, "shard int, block long, keys binary, counts binary")
    answers = asked.groupBy("shard").applyInPandas(answer, "block long, shard int, totals binary, wide boolean, mark long, tokens long, types long")
    blocks = rows.mapInArrow(packed, "block long, kept binary, teach binary, lengths binary, texts binary")
    resolved = materialized(
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(resolve, "kept binary, teach binary, n_tokens binary, counts array<binary>, begin long, hist array<struct<code: long, n: long>>, tokens long, types long")
    )
    n_all, vocabulary = (int(x or 0) for x in resolved.agg(F.sum("tokens"), F.sum("types")).first())
    hist = resolved.select(F.explode("hist").alias("h")).groupBy("h.code").agg(F.sum("h.n").alias("n")).toPandas()  # cells of logarithms: bounded
    weights = learn_weights(hist, order, n_all, vocabulary)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, teach, lengths, counts, begin in zip(*(batch.column(c).to_pylist() for c in ("kept", "teach", "n_tokens", "counts", "begin"))):
                lengths, train = np.frombuffer(lengths, "<u4").astype(np.int64), np.frombuffer(teach, bool)
                counts = [_restored(c, "<u8").astype(np.int64) for c in counts]
                start = np.cumsum(lengths) - lengths
                single = counts[0].astype(float)
                base = np.log10((single + 1) / (n_all + vocabulary + 1))
                model = np.log10(probabilities(counts, contexts_of(counts, lengths, begin), weights, n_all, vocabulary))
                sums = lambda x: np.add.reduceat(x, start)
                made = [~train, lengths, sums((single > 0).astype(np.int64)), np.full(len(train), n_all), sums(base), sums(model)]
                yield pa.RecordBatch.from_arrays([_thawed(kept), *[pa.array(x) for x in made]], names=["kept", *RESULT])

    fields = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in RESULT.items())).fields
    whole = resolved.where(F.length("kept") > 0).select("kept", "teach", "n_tokens", "counts", "begin")
    return whole.mapInArrow(scored, StructType([kept_type, *fields])).select("kept.*", *RESULT)
