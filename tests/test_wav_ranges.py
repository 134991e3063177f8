"""Frames by ranges of files against whole decoding; a writer whose failed attempts leave nothing."""

import io
import struct
import wave

import numpy as np
import pytest
from pyarrow import fs

from cadenza.sources import wav, wav_ranges


def wav_bytes(x, rate, width, channels):
    raw = {1: lambda: (x * 127 + 128).astype(np.uint8).tobytes(), 2: lambda: (x * 32767).astype("<i2").tobytes(), 3: lambda: b"".join(int(v).to_bytes(3, "little", signed=True) for v in (x.ravel() * 8388607).astype(int)), 4: lambda: (x * 2147483647).astype("<i4").tobytes()}[width]()
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes(raw)
    return out.getvalue()


@pytest.mark.parametrize("size, hop", [(512, 512), (400, 160)])
def test_ranges_are_the_whole_decoded(spark, tmp_path, size, hop):
    rng = np.random.default_rng(1)
    for n, (rate, width, channels) in enumerate([(16000, 2, 1), (44100, 2, 2), (8000, 1, 1), (48000, 3, 2), (22050, 4, 1)]):
        x = np.clip(rng.normal(0, 0.6, (rate * 2 + n * 37, channels)), -1, 1)
        (tmp_path / f"r{n}.wav").write_bytes(wav_bytes(x, rate, width, channels))
    square = np.sign(np.sin(np.arange(30_000) / 9))[:, None]  # resampled beyond its range
    (tmp_path / "loud.WAV").write_bytes(wav_bytes(square, 11025, 2, 1))
    (tmp_path / "empty.wav").write_bytes(wav_bytes(np.zeros((0, 1)), 16000, 2, 1))
    whole = wav.frames_of(wav.read_recordings(spark, str(tmp_path)), size, hop)
    want = {(r.recording_id, r.frame_idx): (r.ts, r.samples) for r in whole.collect()}
    parts = wav_ranges.read_frames(spark, str(tmp_path), size, hop, partition_bytes=20_000)
    got = {(r.recording_id, r.frame_idx): (r.ts, r.samples) for r in parts.collect()}
    assert set(got) == set(want) and parts.rdd.getNumPartitions() >= 1
    assert max(abs(np.array(got[k][1]) - np.array(want[k][1])).max() for k in want) < 1e-6
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)
    spark.dataSource.register(wav_ranges.WavFrames)
    assert spark.read.format("wav_frames").option("partitionBytes", 20_000).load(str(tmp_path)).rdd.getNumPartitions() > 30
    one = wav_ranges.read_frames(spark, str(tmp_path / "r1.wav"), size, hop)
    assert one.select("recording_id").distinct().count() == 1


def test_headers_of_large_odd_and_broken_files(tmp_path):
    data = struct.pack("<400h", *range(400))
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
    made = {
        "rf64": b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, 800, 400, 0) + form + b"data" + struct.pack("<I", 0xFFFFFFFF) + data + b"LIST\x04\x00\x00\x00abcd",
        "listed": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + form + b"data" + struct.pack("<I", 800) + data,
        "short": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + form + b"data" + struct.pack("<I", 5000) + data,
    }
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as file:
            layout = wav_ranges.layout_of(file, len(raw))
            assert (layout.frames, layout.rate, layout.channels, layout.width) == (400, 16000, 1, 2)
            assert (wav_ranges.samples_between(file, layout, 16000, 7, 9) * 32768).tolist() == [7, 8]
    for raw in (b"RIFX" + bytes(40), b"RIFF" + struct.pack("<I", 0) + b"WAVE" + form, b"RIFF" + struct.pack("<I", 0) + b"WAVE" + form.replace(struct.pack("<H", 16), struct.pack("<H", 12)) + bytes(8)):
        (tmp_path / "bad").write_bytes(raw)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / "bad")) as file, pytest.raises(ValueError):
            wav_ranges.layout_of(file, len(raw))


def test_a_long_sparse_file_is_read_where_it_is_asked(tmp_path):
    """Four gigabytes with a few samples at their end: one range reads one range's bytes."""
    path, frames = tmp_path / "long.wav", (4 << 30) // 2
    with path.open("wb") as file:
        file.write(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, frames * 2, frames, 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF))
        start = file.tell()
        file.seek(start + frames * 2 - 1024)
        file.write(struct.pack("<512h", *range(512)))
    reader = wav_ranges.WavReader({"path": str(path)})
    parts = reader.partitions()
    assert len(parts) == 64 and sum(p.last - p.first for p in parts) == frames // 512
    last = list(reader.read(parts[-1]))
    assert max(b.nbytes for b in last) < 2_000_000
    assert [round(v * 32768) for v in last[-1].column("samples")[-1].as_py()] == list(range(512))
    assert last[-1].column("frame_idx")[-1].as_py() == frames // 512 - 1


def test_writer_commits_once(spark, tmp_path):
    out = tmp_path / "clips"
    rows = spark.createDataFrame([(f"{i:03}.wav", bytes([i])) for i in range(20)], "name string, content binary").repartition(4)
    wav_ranges.write_files(rows, str(out))
    assert sorted(p.name for p in out.iterdir()) == [f"{i:03}.wav" for i in range(20)] and (out / "007.wav").read_bytes() == b"\x07"
    wav_ranges.write_files(rows.where("name = '003.wav'"), str(out), overwrite=True)
    assert [p.name for p in out.iterdir()] == ["003.wav"]
    with pytest.raises(Exception, match="file name|name of a file"):
        wav_ranges.write_files(rows.union(rows), str(out))
    assert [p.name for p in out.iterdir()] == ["003.wav"]  # nothing of the failed job


def test_a_failed_attempt_leaves_no_doubles(tmp_path):
    writer = wav_ranges.CommitWriter(str(tmp_path), False)

    def fails():
        yield {"name": "a.wav", "content": b"1"}
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(fails())
    again = writer.write(iter([{"name": "a.wav", "content": b"1"}, {"name": "b.wav", "content": None}]))
    speculative = writer.write(iter([{"name": "a.wav", "content": b"1"}]))
    assert speculative.files == 1
    writer.commit([again, None])
    assert sorted((p.name, p.read_bytes()) for p in tmp_path.iterdir()) == [("a.wav", b"1"), ("b.wav", b"")]
    other = wav_ranges.CommitWriter(str(tmp_path), False)
    other.write(iter([{"name": "c.wav", "content": b"1"}]))
    other.abort([])
    assert len(list(tmp_path.iterdir())) == 2
