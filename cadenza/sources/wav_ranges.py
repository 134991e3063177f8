"""WAV files of any length as a data source of frames, and a writer of files that commits.

``WavFrames`` plans ranges of frames of each file as partitions. A header is read once a file, on the
driver; a task reads the bytes of its range only, a block at a time, so that a recording of many gigabytes is
many tasks' work in bounded memory. Where a file has another rate, a range is resampled with the samples
around it that the filter reaches: frames are those of the whole recording decoded at once.

``FileWriter`` writes one file a row. A task attempt writes to a folder of its own; when the job commits, files of
the attempts that count are renamed into place. What failed or was repeated leaves nothing.

Files are reached by pyarrow's file systems: local and shared paths, and the stores that it knows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cadenza.sources.wav import FRAME, RATE, resample

#: Samples that a task decodes at once; bytes of a partition.
BLOCK, PARTITION_BYTES = 1 << 18, 64 << 20
#: An unknown size in a header.
UNKNOWN = 0xFFFFFFFF


@dataclass(frozen=True)
class Layout:
    """Where a file's samples are. frames: samples of a channel."""

    channels: int
    rate: int
    width: int
    start: int
    frames: int


def layout_of(file: pa.NativeFile, size: int) -> Layout:
    """From the header of a RIFF or RF64 file of PCM samples; a file that ends early has the samples that are there."""
    kind, _, wave = struct.unpack("<4sI4s", file.read(12))
    if kind not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, wide = 12, None, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if tag not in (1, 0xFFFE) or bits not in (8, 16, 24, 32):
                raise ValueError(f"not PCM of 8 to 32 bits: format {tag}, {bits} bits")
            form = channels, rate, bits // 8
        elif name == b"ds64":
            wide = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            length = (wide if wide is not None else size) if length == UNKNOWN else length
            channels, rate, width = form
            return Layout(channels, rate, width, at + 8, min(length, size - at - 8) // (channels * width))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def decoded(raw: bytes, layout: Layout) -> np.ndarray:
    """The mean of all channels, in [-1, 1]."""
    if layout.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
    else:
        kind, zero, full = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}[layout.width]
        x = (np.frombuffer(raw, kind) - zero) / full
    return x.reshape(-1, layout.channels).mean(1)


def samples_between(file: pa.NativeFile, layout: Layout, rate: int, start: int, stop: int) -> np.ndarray:
    """The samples [start, stop) of the whole recording at the given rate."""
    step = layout.channels * layout.width

    def read(a: int, b: int) -> np.ndarray:
        file.seek(layout.start + a * step)
        return decoded(file.read((b - a) * step), layout)

    if layout.rate == rate:
        return read(start, stop)
    shared = np.gcd(layout.rate, rate)
    up, down = int(rate // shared), int(layout.rate // shared)
    reach = 10 * max(up, down)
    # from a place that both rates share, so that the filter falls on the samples as it does in the whole
    base = max(0, (start * down - reach) // up) // down
    last = min(layout.frames, -(-((stop - 1) * down + reach) // up) + 1)
    return resample(read(base * down, last), layout.rate, rate)[start - base * up : stop - base * up]


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    first: int
    last: int  # exclusive
    total: int  # samples at the wanted rate

    def __init__(self, path: str, layout: Layout, first: int, last: int, total: int):
        self.path, self.layout, self.first, self.last, self.total = path, layout, first, last, total


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rate, self.size = int(options.get("rate", RATE)), int(options.get("size", FRAME))
        self.hop = int(options.get("hop", self.size))
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(root) if store.get_file_info(root).type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        files = sorted(((f.path, f.size) for f in ([found] if not isinstance(found, list) else found) if f.type == fs.FileType.File and f.path.lower().endswith(".wav")))
        if not files:
            raise FileNotFoundError(f"no WAV files in {self.path}")
        planned = []
        for path, size in files:
            with store.open_input_file(path) as file:
                layout = layout_of(file, size)
            shared = int(np.gcd(layout.rate, self.rate))
            total = -(-layout.frames * (self.rate // shared) // (layout.rate // shared))
            frames = -(-total // self.hop)  # the last ones may be shorter
            each = max(1, int(self.bytes / (layout.channels * layout.width) * self.rate / layout.rate) // self.hop)
            planned += [Range(path, layout, a, min(frames, a + each), total) for a in range(0, frames, each)]
        return planned

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        name = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        each = max(1, BLOCK // self.hop)
        with store.open_input_file(part.path) as file:
            for a in range(part.first, part.last, each):
                b = min(part.last, a + each)
                start, stop = a * self.hop, min(part.total, (b - 1) * self.hop + self.size)
                x = samples_between(file, part.layout, self.rate, start, stop).astype(np.float32)
                at = np.arange(a, b)
                lows, highs = at * self.hop - start, np.minimum(at * self.hop + self.size, part.total) - start
                if self.hop == self.size:
                    values, ends = x, np.append(lows, highs[-1])
                else:
                    values, ends = np.concatenate([x[i:j] for i, j in zip(lows, highs)]), np.append(0, np.cumsum(highs - lows))
                n = b - a
                samples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([part.path] * n), pa.array(at, pa.int64()), pa.array(at * self.hop / self.rate), samples, pa.array([part.layout.rate != self.rate] * n)], names=["recording_id", "path", "frame_idx", "ts", "samples", "resampled"])


class WavFrames(DataSource):
    """Format ``wav_frames``. Options: path (a folder or a file), rate, size and hop (samples), partitionBytes. Frames of a recording's end may be shorter."""

    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return "recording_id string, path string, frame_idx long, ts double, samples array<float>, resampled boolean"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_frames(spark: SparkSession, path: str, size: int = FRAME, hop: int | None = None, rate: int = RATE, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """recording_id, path, frame_idx, ts, samples: whole frames, as wav.frames_of(wav.read_recordings()) gives them, but by ranges of the files.

    A resampled recording whose peak is over 1 is divided by it; only those are read twice.
    """
    spark.dataSource.register(WavFrames)
    frames = spark.read.format("wav_frames").option("size", size).option("hop", hop or size).option("rate", rate).option("partitionBytes", partition_bytes).load(path)
    peak = F.greatest(F.array_max("samples"), -F.array_min("samples"))
    loud = frames.where("resampled").groupBy("path").agg(F.max(peak).alias("_peak")).where("_peak > 1")
    scaled = F.when(F.col("_peak").isNotNull(), F.transform("samples", lambda x: (x / F.col("_peak")).cast("float"))).otherwise(F.col("samples"))
    return frames.where(F.size("samples") == size).join(loud, "path", "left").select("recording_id", "path", "frame_idx", "ts", scaled.alias("samples"))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class CommitWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        folder, names = f"{root}/{self.job}/{uuid.uuid4().hex}", set()
        store.create_dir(folder)
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name in names or name.startswith("."):
                raise ValueError(f"not the name of a file of its own: {name!r}")
            names.add(name)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(row["content"] or b"")
        return Written(folder, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        found = [(f.path, f.base_name) for m in messages if m is not None for f in store.get_file_info(fs.FileSelector(m.folder))]
        if len({name for _, name in found}) < len(found):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for path, name in found:
            store.move(path, f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class FileWriter(DataSource):
    """Format ``files``: writes each row's content (binary) to a file of its name. Mode overwrite removes the folder's files first, at commit."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> CommitWriter:
        return CommitWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file in the folder path for each row's name and content; names are different, or the job fails and leaves nothing."""
    rows.sparkSession.dataSource.register(FileWriter)
    rows.select("name", "content").write.format("files").mode("overwrite" if overwrite else "append").save(path)
