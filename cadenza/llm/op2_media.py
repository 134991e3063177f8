"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs: text pieces, and references to media (an image or
audio element whose source is ``sha256:<digest>``) with their captions. References are resolved by a
join on the digest with a table of media, each stored once; positions and captions stay as they were.

Media are stored losslessly as 8-bit grey PNG images of a fixed width and read back by ``decode_png``.

Defined results: null HTML is an empty sequence; a reference that no medium has stays, with null
bytes; repeated rows, and rows of one id, are sequences of their own; equal media are stored once.
A head or caption that is never closed ends where a block of the body starts, or with its figure or the
page; an unclosed script or style hides the rest, as HTML has it. Ids may be null, repeated and of any
type. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cadenza.llm.arrow import kept_with, mapped, text_of

#: Payloads are padded to a positive multiple of this many bytes, one image row.
ROW_BYTES = 576
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
SEQUENCE = ArrayType(StructType([StructField("position", IntegerType()), *[StructField(n, StringType()) for n in ("kind", "text", "digest", "caption")]]))
DESCRIBED = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
#: Digests that a task remembers at once.
SEEN = 200_000


def pad_payload(text: bytes, row: int = ROW_BYTES) -> bytes:
    """text and bytes 255 up to a positive multiple of row."""
    return text + b"\xff" * (max(row, -(-len(text) // row) * row) - len(text))


def encode_png(payload: bytes, width: int = ROW_BYTES) -> bytes:
    """8-bit grey samples, no filter."""
    height = len(payload) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(stored: bytes) -> np.ndarray:
    """(height, width) samples of an image that encode_png could have made; checks every chunk."""
    if not stored.startswith(PNG_HEAD):
        raise ValueError("not a PNG")
    at, size, data = len(PNG_HEAD), None, []
    while at < len(stored):
        length, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", stored, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            *size, depth, color, _, _, _ = struct.unpack(">IIBBBBB", body)
            if (depth, color) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    width, height = size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that is not used here")
    return rows[:, 1:]


def image_feature(samples: np.ndarray) -> str:
    """Height, mean, deviation and entropy of the samples, as text."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    p = counts[counts > 0] / samples.size
    mean = float((counts * np.arange(256)).sum()) / samples.size
    spread = float((counts * np.arange(256.0) ** 2).sum()) / samples.size - mean * mean
    return f"h={samples.shape[0]};mean={mean:.4f};std={max(spread, 0.0) ** 0.5:.4f};bits={-(p * np.log2(p)).sum() + 0.0:.4f}"


class SequenceParser(HTMLParser):
    """Text pieces and media references of a page in order; a caption is the figcaption of the figure, or else the alt text."""

    HIDDEN = {"script", "style", "template", "head"}
    BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "figure", "figcaption", "article", "section", "ul", "ol", "table", "blockquote", "pre", "nav", "body"}
    MEDIA = {"img": "image", "audio": "audio", "video": "video"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.figure: list[int] | None = None
        self.captioning: list[str] | None = None

    def flush(self) -> None:
        text, self.text = " ".join("".join(self.text).split()), []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        """The caption belongs to all media of its figure; outside of a figure, or in one without media, it is text."""
        if self.captioning is None:
            return
        caption, self.captioning = " ".join("".join(self.captioning).split()), None
        for at in self.figure or []:
            self.items[at]["caption"] = caption
        if not self.figure:
            self.text.append(caption)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden == ["head"] and tag in self.BLOCKS:
            self.hidden.pop()
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in self.BLOCKS:
            self.flush()
        given = dict(attrs)
        if tag in self.MEDIA and (given.get("src") or "").startswith("sha256:"):
            self.flush()
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"position": len(self.items), "kind": self.MEDIA[tag], "text": None, "digest": given["src"][7:].lower(), "caption": given.get("alt")})
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.captioning = []

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag == "figure":
            self.figure = None
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.captioning is None else self.captioning).append(data)


def parse_html(html: str | None) -> list[dict]:
    parser = SequenceParser()
    parser.feed(html or "")
    parser.close()
    parser.end_caption()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and sequence (an ordered array of structs) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([parse_html(h) for h in batch.column("html").to_pylist()], ITEMS)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), items], names=["kept", "sequence"])

    rows = kept_with(pages, [id_col], html=text_of(pages, html_col))
    return rows.mapInArrow(run, StructType([rows.schema["kept"], StructField("sequence", SEQUENCE)])).select("kept.*", "sequence")


def store_media(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """digest (of the text's bytes) and stored (a PNG of the padded payload): one row for each different text.

    A task makes one image of the copies that it sees (it remembers SEEN digests); those of other tasks go in the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            digests, images = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                if digest not in seen:
                    seen = seen if len(seen) < SEEN else set()
                    seen.add(digest)
                    digests.append(digest)
                    images.append(encode_png(pad_payload(text.encode())))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "stored"])

    text = text_of(texts, text_col)
    return texts.select(F.sha2(text, 256).alias("digest"), text.alias("text")).mapInArrow(run, "digest string, stored binary").dropDuplicates(["digest"])


def describe_media(media: DataFrame) -> DataFrame:
    """digest and what the stored bytes hold when they are read back: payload and tail digests, sizes, feature."""

    def made(images: list) -> dict:
        out: dict[str, list] = {n: [] for n in DESCRIBED}
        for stored in images:
            samples = decode_png(stored)
            payload = samples.tobytes()
            for n, x in zip(DESCRIBED, (len(payload.rstrip(b"\xff")), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha256(stored).hexdigest(), image_feature(samples))):
                out[n].append(x)
        return out

    return mapped(media.select("digest", "stored"), ["stored"], DESCRIBED, made)


def resolve(parsed: DataFrame, media: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, position, kind, text, digest, caption and the columns of media: each item of the sequences, its medium beside it.

    The join is on the digest; what a page can repeat (a hot digest) is only the small reference, so
    pass described media, or bytes where they are needed.
    """
    items = parsed.select(id_col, F.explode("sequence").alias("i")).select(id_col, "i.*")
    return items.join(media, "digest", "left")


def interleaved(parsed: DataFrame, media: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id and sequence again, each item with its medium's columns, in order of position; an empty sequence stays."""
    extra = [c for c in media.columns if c != "digest"]
    rows = parsed.select(F.struct(id_col).alias("kept"), F.monotonically_increasing_id().alias("_sequence"), "sequence")
    items = rows.select("kept", "_sequence", F.explode_outer("sequence").alias("i")).select("kept", "_sequence", "i.*").join(media, "digest", "left")
    whole = F.when(F.col("position").isNotNull(), F.struct("position", "kind", "text", "digest", "caption", *extra))
    return items.groupBy("_sequence", "kept").agg(F.array_sort(F.collect_list(whole)).alias("sequence")).select("kept.*", "sequence")
