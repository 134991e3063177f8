"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens. A window of ``window_sequences`` sequences takes from each queue
the whole tokens that its share entitles it to so far; the fraction it could not take (its deficit)
is carried into the next window. As the deficit after any number of windows follows from the shares
alone, each partition computes it for the windows that its documents fall into: nothing is handed
from task to task, and no queue passes through one task. Queues of less than a token a window take turns:
together they are one queue, over which each one's tokens are spread in golden-ratio steps; the places of
any of its tokens are found by arithmetic, so that no queue is listed anywhere.

Steps: tokenize once and write the ids to a shared table; sum tokens by (partition, source), prefix
sums give every document its place in its queue, and every queue its place among the queues (there is
one for each source, however many); a second scan of the table cuts documents at window and sequence
borders. Ids are not shuffled unless there are more than MAX_BROADCAST_ROWS of those sums.

Defined results: a null text is an empty text (its only token is the end id); a null source is a
queue of its own; repeated rows are packed as often as they occur; an empty table gives no rows. Ids may
be null, repeated and of any type: they pass through untouched. A text that holds a special token's
string has that token, as in the tokenizer's plain call. An id column named as a result's is refused.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.llm.arrow import kept_with, text_of
from cadenza.llm.store import materialized

#: Distinct words of a generation: a task remembers the words of this one and, until it fills up, of the one before.
CACHE_ENTRIES = 300_000
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids")
#: Tokens of a window for each queue on average, at least: pieces get shorter with more queues in a window.
RUN = 512
#: Slices of the table of queues, whose sums the driver adds up.
SLICES = 64
#: More rows of (partition, source) than this are joined by shuffle, not broadcast.
MAX_BROADCAST_ROWS = 100_000


#: The split of pieces that the tokenizer's file states, and the same over Latin-1 characters in lower case.
NORMAL_WAY = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x09-\x0d \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"


#: Single marks that often end a word.
MARKS = ".,;:!?"


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable in Latin-1, else the next free one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    free = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(free)) for b in range(256))


BYTE_CHARACTERS = _byte_characters()


class WordTokenizer:
    """A tokenizer that never looks across ASCII white space, applied word by word with a memory.

    The ids are those of the library's plain call: a special token's string in a text is that token. Such
    texts are rare and take the library's whole way; everywhere else there is only ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = [t["content"] for t in json.loads(self.plain.to_str())["added_tokens"]]
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.raw = [i.to_bytes(self.type.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.cut = re.compile(LATIN_PIECES) if NORMAL_WAY in json.loads(self.tokenizer.to_str())["pre_tokenizer"].get("pretokenizers", []) else None

    def forget(self) -> None:
        """Drops the words that it remembers, and Arrow's free memory: a worker lives on after its task, and the next one is as fast without them."""
        self.known, self.older, self.pieces = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian integers of self.type."""
        marked = [i for i, t in enumerate(texts) if self.special and self.special.search(t)]
        if marked:
            out = self.encode_ordinary([b"" if self.special.search(t) else t for t in texts])
            for i, made in zip(marked, self.plain.encode_batch_fast([texts[i].decode() for i in marked], add_special_tokens=False)):
                out[i] = np.array(made.ids, self.type).tobytes()
            return out
        return self.encode_ordinary(texts)

    def encode_ordinary(self, texts: list[bytes]) -> list[bytes]:
        """As encode, where no text has a special token's string. A batch's different words are looked up once, and what is new is made."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {}, self.known
        # the tokenizer lower-cases: doing so for A-Z first changes no id, and more words are known
        known, older, split = self.known, self.older, [t.lower().split() for t in texts]
        new = []
        for word in set().union(*split).difference(known):
            ids = older.get(word)
            if ids is None:
                new.append(word)
            else:
                known[word] = ids
        known.update(zip(new, self._fresh(new)))
        ids_of = known.__getitem__
        return [b"".join(map(ids_of, words)) for words in split]

    def _fresh(self, words: list[bytes]) -> list[bytes]:
        """The ids of lower-cased words.

        Words of Latin-1 characters are in normal form C, so their pieces go to the tokenizer's model
        one by one (each different one once, a word of letters alone is its own piece); any other word
        takes the tokenizer's whole way.
        """
        out, rest, pieces, raw, known, older = [b""] * len(words), [], self.pieces, self.raw, self.known, self.older
        if len(pieces) > CACHE_ENTRIES:
            pieces.clear()
        tokenize = self.tokenizer.model.tokenize

        def ids_of(piece: str) -> bytes:
            shown = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_CHARACTERS)
            return b"".join([raw[t.id] for t in tokenize(shown)])

        def remembered(piece: str) -> bytes:
            ids = pieces.get(piece)
            if ids is None:
                ids = pieces[piece] = ids_of(piece)
            return ids

        for at, word in enumerate(words):
            if self.cut is None:
                rest.append(at)
                continue
            if word.isalpha():
                out[at] = b"".join([raw[t.id] for t in tokenize(word.decode())])
                continue
            text = word.decode()
            if not text.isascii():
                if max(text) > "\xff":
                    rest.append(at)
                    continue
                text = text.lower()
            if text.isalpha():
                out[at] = ids_of(text)
            elif text[-1] in MARKS and text[:-1].isalpha():
                head = word[:-1]
                out[at] = (known.get(head) or older.get(head) or remembered(text[:-1])) + remembered(text[-1])
            elif "<|" in text:
                rest.append(at)
            else:
                out[at] = b"".join(map(remembered, self.cut.findall(text)))
        for at, made in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
            out[at] = np.array(made.ids, self.type).tobytes()
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """kept (a struct of the id), queue, part and part_start (its tokens' place among those of its queue in its partition), n_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, served = word_tokenizer(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], tokenizer.type).tobytes()
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    rows = batch.slice(lo, 256)
                    ids = [x + end for x in tokenizer.encode([t.encode() for t in rows.column("text").to_pylist()])]
                    counts, starts = [len(x) // tokenizer.type.itemsize for x in ids], []
                    for queue, n in zip(rows.column("queue").to_pylist(), counts):
                        starts.append(served.get(queue, 0))
                        served[queue] = starts[-1] + n
                    yield pa.RecordBatch.from_arrays([rows.column("kept"), rows.column("queue"), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["kept", "queue", "part", "part_start", "n_tokens", "ids"])
        finally:
            tokenizer.forget()

    rows = kept_with(docs, [id_col], queue=F.coalesce(F.concat(F.lit("s:"), docs[f"`{source_col}`"].cast("string")), F.lit("none")), text=text_of(docs, text_col))
    made = StructType.fromDDL("queue string, part long, part_start long, n_tokens long, ids binary")
    return rows.mapInArrow(run, StructType([rows.schema["kept"], *made.fields]))


def turns(total: int, window: int, below: int, amount: int, at: int, length: int) -> list[tuple[int, int, int]]:
    """(tokens before, length, position) of each piece of a queue's tokens [at, at + length), where every window of total tokens takes of a queue what its share entitles it to so far.

    A queue of a token or more a window, or the first one (below is 0), is never owed a negative number.
    """
    low, high, pieces, done = below, below + amount, [], 0
    taken = lambda w: min(w * window, total) * high // total - min(w * window, total) * low // total
    w = at * total // (amount * window)
    while w and taken(w) > at:
        w -= 1
    while taken(w + 1) <= at:
        w += 1
    while done < length:
        begun, x, y = taken(w), min(w * window, total), min((w + 1) * window, total)
        n = min(length - done, taken(w + 1) - at)
        if n > 0:
            pieces.append((done, n, x + (y * low // total - x * low // total) + at - begun))
            done, at = done + n, at + n
        w += 1
    return pieces


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of (a * i + b) // m for i from 0 to n - 1, by Euclid's steps; a and b are not negative."""
    total = 0
    while n > 0:
        total += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        if top < m:
            break
        n, b, m, a = top // m, top % m, a, m
    return total


@dataclass(frozen=True)
class Steps:
    """The places (below + j) * step modulo whole of a small queue's tokens j < amount, in order: golden-ratio steps, so that they are far apart, and those of different queues differ."""

    below: int
    amount: int
    whole: int

    @property
    def step(self) -> int:
        return _step(self.whole)

    def before(self, x: int) -> int:
        """How many places are under x."""
        shift = self.below * self.step % self.whole
        return floor_sum(self.amount, self.whole, self.step, shift) - floor_sum(self.amount, self.whole, self.step, shift - x + self.whole) + self.amount

    def nth(self, k: int) -> int:
        """The j whose place is the k-th, from 0."""
        low, high = 0, self.whole  # before(low) <= k < before(high)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if self.before(middle) > k else (middle, high)
        return (low * pow(self.step, -1, self.whole) - self.below) % self.whole if self.whole > 1 else 0

    def places(self, start: int, length: int) -> Iterator[int]:
        """The start-th place and those after it: there are three ways from one to the next, by j."""
        if not length:
            return
        j, ends = self.nth(start), _ends(self.amount, self.whole)
        for _ in range(length):
            yield (self.below + j) * self.step % self.whole
            if ends:
                first, last = ends
                j += first if j < self.amount - first else -last if j >= last else first - last


@lru_cache(maxsize=256)
def _step(whole: int) -> int:
    return next(x for x in range(max(1, int(whole * 0.6180339887498949)), 2 * whole + 2) if math.gcd(x, whole) == 1)


@lru_cache(maxsize=4096)
def _ends(amount: int, whole: int) -> tuple[int, int] | None:
    """The j from 1 on whose j * step modulo whole are the smallest and the largest."""
    places = Steps(0, amount, whole)
    return (places.nth(1), places.nth(amount - 1)) if amount > 1 else None


@dataclass(frozen=True)
class Phase:
    """A stretch of the packed tokens during which the same queues are served.

    queues: (whether it has less than a token a window, tokens of the queues before it, its own) of each in
    it; small ones come first and have small tokens together.
    """

    start: int
    length: int
    served: dict[str, int]  # before this phase
    small: int
    queues: dict[str, tuple[bool, int, int]]


def plan_phases(totals: dict[str, int], weights: dict[str, float] | None, window: int) -> list[Phase]:
    """Phases in order. Without weights the queues' own sizes are the target, and one phase serves all.

    The driver plans queues with a weight only (pack): as many as the caller lists, in space quadratic in that.

    With weights, a phase ends when a queue runs dry; the others go on in their proportions. Queues
    without a weight are served after all others.
    """
    left = {q: n for q, n in sorted(totals.items()) if n}
    phases, start, served = [], 0, dict.fromkeys(left, 0)
    while left:
        share = {q: float(left[q] if weights is None else weights.get(q, 0.0)) for q in left}
        share = {q: s for q, s in share.items() if s > 0} or {q: float(left[q]) for q in left}
        turns = min(left[q] / s for q, s in share.items())
        amounts = {q: left[q] if weights is None or left[q] / s <= turns else min(left[q], int(s * turns)) for q, s in share.items()}
        amounts = {q: n for q, n in amounts.items() if n}
        total, queues, below = sum(amounts.values()), {}, 0
        for q, n in sorted(amounts.items(), key=lambda x: x[1] * window >= total):
            queues[q], below = (n * window < total, below, n), below + n
        phases.append(Phase(start, total, dict(served), sum(n for few, _, n in queues.values() if few), queues))
        start += phases[-1].length
        for q, n in amounts.items():
            served[q] += n
            left[q] -= n
        left = {q: n for q, n in left.items() if n}
    return phases


def place(phases: list[Phase], queue: str, start: int, length: int, window: int, sequence: int) -> list[tuple[int, int, int]]:
    """(tokens before, length, position among all packed tokens) of each piece of the tokens [start, start + length) of a queue, cut at the ends of sequences."""
    pieces, done = [], 0
    for phase in phases:
        at = start + done - phase.served.get(queue, 0)
        if done == length or queue not in phase.queues or at < 0 or at >= phase.queues[queue][2]:
            continue
        few, below, amount = phase.queues[queue]
        part = min(length - done, amount - at)
        if few:
            found = [(i, 1, turns(phase.length, window, 0, phase.small, p, 1)[0][2]) for i, p in enumerate(Steps(below, amount, phase.small).places(at, part))]
        else:
            found = turns(phase.length, window, below, amount, at, part)
        for before, n, slot in found:
            before, slot = done + before, phase.start + slot
            while n > 0:
                cut = min(n, sequence - slot % sequence)
                pieces.append((before, cut, slot))
                before, n, slot = before + cut, n - cut, slot + cut
        done += part
    return pieces


def in_one_phase(totals: DataFrame, window: int) -> tuple[DataFrame, int, int]:
    """(queue, amount, below of each queue, where all are served in proportion to their sizes; tokens of all; tokens of small queues).

    Small queues, of less than a token a window, come first. Sums run within slices of the ordered
    queues; the driver holds one number a slice.
    """
    tokens = totals.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("n")).first()["n"]
    ranked = totals.withColumn("large", F.col("amount").cast("decimal(38)") * window >= tokens)
    sliced = materialized(ranked.repartitionByRange(SLICES, "large", "queue").withColumn("slice", F.spark_partition_id()))
    slices = sliced.groupBy("slice").agg(F.sum("amount").alias("n"), F.coalesce(F.sum(F.expr("if(large, 0, amount)")), F.lit(0)).alias("small")).orderBy("slice").collect()
    base, below = [], 0
    for r in slices:
        base.append((r["slice"], below))
        below += r["n"]
    before = Window.partitionBy("slice").orderBy("large", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = sliced.sparkSession.createDataFrame(base, "slice int, slice_base long")
    summed = sliced.withColumn("below", F.coalesce(F.sum("amount").over(before), F.lit(0))).join(F.broadcast(bases), "slice")
    return summed.select("queue", "amount", (F.col("slice_base") + F.col("below")).alias("below")), tokens, sum(r["small"] for r in slices)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, sequence: int = 2048, window_sequences: int | None = None, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (and ids).

    weights: target share of tokens by source value; None: the corpus's own shares, held in every window.
    window_sequences: sequences of a window; None: 16, or as many as give a queue RUN tokens of it on average.
    """
    if id_col in PIECE:
        raise ValueError(f"the id column has the name of a result's: {id_col}")
    table = materialized(tokenized(docs, tokenizer_path, end_id, id_col, text_col, source_col))
    sums = table.groupBy("queue", "part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialized(sums.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("queue", "part", "base", "tokens"))
    totals, listed = bases.groupBy("queue").agg(F.sum("tokens").alias("amount")), {f"s:{k}": float(v) for k, v in (weights or {}).items() if v > 0}
    window = sequence * (window_sequences or max(16, -(-RUN * totals.count() // sequence)))
    # queues with a weight, as many as the caller lists, are planned here; the others are served after them, in one phase
    names = F.broadcast(docs.sparkSession.createDataFrame([(q,) for q in listed], "queue string"))
    phases = plan_phases({r["queue"]: r["amount"] for r in totals.join(names, "queue", "left_semi").collect()}, listed, window) if listed else []
    start = sum(p.length for p in phases)
    others, length, in_small = in_one_phase(totals.join(names, "queue", "left_anti"), window)
    small = materialized(bases.join(others, "queue", "left").select("queue", "part", "base", "amount", "below"))
    small = F.broadcast(small) if small.count() <= MAX_BROADCAST_ROWS else small
    placed = table.join(small, ["queue", "part"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at_row = [], []
            base, part_start = batch.column("base").to_pylist(), batch.column("part_start").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("queue", "n_tokens", "ids", "amount", "below")]
            for row, (queue, n, raw, amount, below) in enumerate(zip(*columns)):
                ids, at = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4"), base[row] + part_start[row]
                served = phases if amount < 0 else [Phase(start, length, {}, in_small, {queue: (below < in_small, below, amount)})]
                for done, size, slot in place(served, queue, at, n, window, sequence):
                    piece = ids[done : done + size].tobytes()
                    at_row.append(row)
                    out.append((done, size, zlib.crc32(piece), n, slot // sequence, slot % sequence, queue, piece))
            found = list(zip(*out)) or [()] * 8
            arrays = [pa.array(x, k) for x, k in zip(found, [pa.int64()] * 6 + [pa.string(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column("kept").take(pa.array(at_row, pa.int64())), *arrays[: 7 + with_ids]], names=["kept", *PIECE][: 8 + with_ids])

    made = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(PIECE[: 7 + with_ids], ["long"] * 6 + ["string", "binary"])))
    rows = placed.select("kept", "queue", "base", "part_start", "n_tokens", "ids", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("amount", "below")])
    return rows.mapInArrow(cut, StructType([rows.schema["kept"], *made.fields])).select("kept.*", *PIECE[: 7 + with_ids])
