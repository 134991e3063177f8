"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding; that token is stored.
Reading the stored tokens backwards gives the encoding of any prefix, so text can be appended
exactly, and an edit only recomputes from its start to where old and new tokens agree again.

Defined results: a null text is an empty text; an empty text has no tokens (the digest is that of
the empty string); an empty table gives no rows. Repeated rows give repeated rows. Ids may be null,
repeated and of any type: they pass through untouched. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrow import kept_with, mapped, text_of

#: Entries of a generation of each cache; a worker keeps two generations of words and pieces, which bounds its memory.
CACHE_ENTRIES = 300_000


class Vocabulary:
    """Ranks of byte strings, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length_of = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._spines: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            if len(b) == 1 or self.halves(b):
                self._automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self._automaton.make_automaton()

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None where merges never reach it."""
        if token not in self._halves:
            parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
                if rank >= own:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """From the outermost byte inwards: each part at that edge of the token, and the rank that ends it."""
        key = (token, side)
        if key not in self._spines:
            found, part, end = [], self.bytes_of[token], float("inf")
            while True:
                found.append((part, end))
                if len(part) == 1:
                    break
                end = self.ranks[part]
                part = self.halves(part)[side]
            self._spines[key] = found[::-1]
        return self._spines[key]

    def adjoin(self, left: int, right: int) -> bool:
        """Whether the encoding of both byte strings together is [left, right].

        Follows the merges in time: at the border stands a part of each token; the pair is wrong if
        those two would merge before either is taken into its own token. At equal ranks the merge
        further left comes first.
        """
        key = (left, right)
        if key not in self._pairs:
            a, b, i, j, fine = self.spine(left, 1), self.spine(right, 0), 0, 0, True
            while True:
                (x, x_end), (y, y_end) = a[i], b[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_end and rank <= y_end:
                    fine = False
                    break
                if x_end == y_end == float("inf"):
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) > 4 * CACHE_ENTRIES:
                self._pairs.clear()
            self._pairs[key] = fine
        return self._pairs[key]

    def extend(self, piece: bytes, last: list[int | None], done: int) -> None:
        """Store the last token of each prefix of piece longer than done; exactly one is valid."""
        begin, pairs, adjoin = max(0, done - self.longest + 1), self._pairs, self.adjoin
        i = begin
        for end, (token, length) in self._automaton.iter(piece[begin:].decode("latin-1")):
            i = begin + end + 1
            if last[i] is None and i > done:
                if length == i:
                    last[i] = token
                else:
                    left = last[i - length]
                    fine = pairs.get((left, token))
                    if adjoin(left, token) if fine is None else fine:
                        last[i] = token

    def whole(self, piece: bytes) -> list[int]:
        """The encoding of one piece."""
        known = self.ranks.get(piece)
        return [known] if known is not None else PrefixEncoder(self, piece).tokens()


class PrefixEncoder:
    """One piece of bytes with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece = vocabulary, b""
        self.last: list[int | None] = [None]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; stored tokens stay as they are."""
        done = len(self.piece)
        self.piece += more
        self.last += [None] * len(more)
        self.vocabulary.extend(self.piece, self.last, done)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put new in the place of piece[start:end]; returns how many prefixes were computed."""
        old_last, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last = self.last[: start + 1] + [None] * (len(self.piece) - start)
        return self._settle(start, start + len(new), old_last, shift)

    def _settle(self, done: int, new_end: int, old: list[int | None], shift: int) -> int:
        """Compute stored tokens after an edit. Once as many of them agree with the old ones as the longest token has bytes, so do all that follow."""
        voc, last, step = self.vocabulary, self.last, self.vocabulary.longest
        while done < len(self.piece):
            upto = min(len(self.piece), max(done, new_end) + step)
            voc.extend(self.piece[:upto], last, done)
            if upto - step >= new_end and last[upto - step + 1 : upto + 1] == old[upto - step + 1 - shift : upto + 1 - shift]:
                last[upto + 1 :] = old[upto + 1 - shift :]
                return upto
            done = upto
        return done

    def tokens(self, upto: int | None = None) -> list[int]:
        """The encoding of the first upto bytes (all of them by default)."""
        at, found, last, length = len(self.piece) if upto is None else upto, [], self.last, self.vocabulary.length_of
        while at:
            token = last[at]
            found.append(token)
            at -= length[token]
        return found[::-1]


class TextEncoder:
    """Whole texts: splits them by the pattern, encodes each match, remembers what it has seen."""

    #: A space after a character that is no white space always starts a match, so a text may be cut before it.
    SPACES = re.compile(r"\s |\s\Z")
    CUT = re.compile(r"(?<=\S)(?= )")

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.pieces: dict[str, str] = {}
        self.spaced: dict[str, str] = {}
        self.older_pieces: dict[str, str] = {}
        self.older_spaced: dict[str, str] = {}
        self.decimal = {str(i): b for i, b in vocabulary.bytes_of.items()}

    def part(self, text: str) -> str:
        """Decimal ids, joined by commas, of a part of a text."""
        found = []
        for piece in self.pattern.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.older_pieces.get(piece)
                if ids is None:
                    ids = ",".join(map(str, self.vocabulary.whole(piece.encode())))
                if len(self.pieces) > CACHE_ENTRIES:
                    self.older_pieces, self.pieces = self.pieces, {}
                if len(piece) < 64:
                    self.pieces[piece] = ids
            found.append(ids)
        return ",".join(found)

    def encode(self, text: str) -> str:
        """Decimal ids, joined by commas."""
        if not text:
            return ""
        if self.SPACES.search(text):
            return ",".join(map(self.part, self.CUT.split(text)))
        first, *words = text.split(" ")
        if len(self.spaced) > CACHE_ENTRIES:
            self.older_spaced, self.spaced = self.spaced, {}
        known, older, part = self.spaced, self.older_spaced, self.part
        found = [part(first)] if first else []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    ids = part(" " + word)
                if len(word) < 64:
                    known[word] = ids
            found.append(ids)
        return ",".join(found)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.decimal.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def text_encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """One for each worker process; ranks_path is a tiktoken file at the same place on every machine."""
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(b): int(i) for b, i in (line.split() for line in file if line.strip())}
    return TextEncoder(Vocabulary(ranks), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int) for each row."""

    def made(texts: list) -> dict:
        encoder = text_encoder(ranks_path, pattern)
        return {"ids": [[int(x) for x in s.split(",")] if (s := encoder.encode(t)) else [] for t in texts]}

    return mapped(kept_with(docs, [id_col], text=text_of(docs, text_col)), ["text"], {"ids": "array<int>"}, made).select("kept.*", "ids")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 for each row; the ids themselves stay in the worker."""

    def made(texts: list) -> dict:
        encoder = text_encoder(ranks_path, pattern)
        counts, digests, decoded = [], [], []
        for text in texts:
            ids = encoder.encode(text)
            counts.append(ids.count(",") + 1 if ids else 0)
            digests.append(sha256(ids.encode()).hexdigest())
            decoded.append(sha256(encoder.decode(ids)).hexdigest())
        return {"n_tokens": counts, "ids_sha256": digests, "decoded_sha256": decoded}

    rows = kept_with(docs, [id_col], text=text_of(docs, text_col))
    return mapped(rows, ["text"], {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, made).select("kept.*", "n_tokens", "ids_sha256", "decoded_sha256")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, decoded (binary) from the ids column of encode_documents; null ids are none."""

    def made(rows: list) -> dict:
        bytes_of = text_encoder(ranks_path, pattern).vocabulary.bytes_of
        return {"decoded": [b"".join(bytes_of[i] for i in ids or []) for ids in rows]}

    return mapped(kept_with(encoded, [id_col], ids=F.col(ids_col)), ["ids"], {"decoded": "binary"}, made).select("kept.*", "decoded")
