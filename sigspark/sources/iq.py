"""Raw IQ and WAV files as guard-padded sample blocks, from a folder as it is or as a stream of new files.

A Python data source: the driver only lists files and reads WAV headers, each task reads the byte ranges of its
own blocks. Any file length gives bounded rows and an even spread, and no whole file is ever one row.
"""

from __future__ import annotations

import hashlib
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.spectra import BLOCK_SAMPLES, guard_length

# fixed values: datatype -> (numpy type, channels)
DATATYPES = {"cf32_le": ("<f4", 2), "cf32_be": (">f4", 2), "ci16_le": ("<i2", 2), "ci16_be": (">i2", 2),
             "rf32_le": ("<f4", 1), "ri16_le": ("<i2", 1), "cu8": ("u1", 2), "ci8": ("i1", 2)}
MAX_MAGNITUDE = 1e12
#: three-byte signed samples, which numpy has no type for
PCM24 = "<i3"

SCHEMA = ("path string, capture_id long, block_id long, lft long, rgt long, core_start long, core_end long, "
          "sample_rate double, i array<double>, q array<double>")


def capture_number(path: str) -> int:
    """63-bit number of a file, the same whether a local path comes with or without its scheme."""
    plain = "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "big") >> 1


def scale_codes(values: np.ndarray, kind: np.dtype, wav: bool = False) -> np.ndarray:
    """Integer codes to full scale +-1. Unsigned raw codes have midpoint 127.5, unsigned WAV codes 128."""
    v = values.astype(np.float64)
    if kind.kind == "u":
        return (v - 128) / 255 if wav else (v - 127.5) / 127.5
    return v / float(1 << (8 * kind.itemsize - 1)) if kind.kind == "i" else v


def normalize_codes(df: DataFrame, value: str, datatype: str) -> DataFrame:
    """Column form of the same scaling, per-row datatype."""
    t, v = F.col(datatype), F.col(value)
    return df.withColumn("sample", F.when(t.isin("ci16_le", "ci16_be", "ri16_le"), v / 32768.0).when(t == "ci8", v / 128.0)
                         .when(t == "cu8", (v - 127.5) / 127.5).otherwise(v.cast("double")))


@dataclass
class Layout:
    path: str
    dtype: str
    channels: int
    offset: int
    total: int
    rate: float
    wav: bool = False
    choice: str = "iq"
    name: str = ""

    def samples(self, raw: bytes) -> np.ndarray:
        """[samples, channels] at full scale +-1."""
        if self.dtype == PCM24:
            b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
            v = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
        else:
            v = scale_codes(np.frombuffer(raw, self.dtype), np.dtype(self.dtype), self.wav)
        return v.reshape(-1, self.channels)

    @property
    def stride(self) -> int:
        return (3 if self.dtype == PCM24 else np.dtype(self.dtype).itemsize) * self.channels


@dataclass
class BlockRange(InputPartition):
    layout: Layout
    first: int
    last: int
    block: int
    guard: int


def wav_header(read, size: int) -> tuple[str, int, int, int, float]:
    """(numpy type, channels, data offset, data bytes, rate) from the chunk list of a WAV file."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    pos, fmt = 12, None
    while pos + 8 <= size:
        name, length = struct.unpack("<4sI", read(pos, 8))
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(pos + 8, 16))
            if code == 0xFFFE:
                code = struct.unpack("<H", read(pos + 32, 2))[0]
            fmt = ({(1, 8): "u1", (1, 16): "<i2", (1, 24): PCM24, (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((code, bits)), channels, float(rate))
        elif name == b"data":
            if fmt is None or fmt[0] is None:
                raise ValueError("unsupported WAV encoding")
            return fmt[0], fmt[1], pos + 8, min(length, size - pos - 8), fmt[2]
        pos += 8 + length + length % 2
    raise ValueError("WAV file without data")


def open_path(path: str):
    """(filesystem, inner path): local paths and any URI the Arrow filesystems know."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def local_path(path: str) -> str:
    """A path of the local file system without its scheme; others as they are."""
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.opt = dict(options)

    def layout(self, filesystem, info) -> Layout:
        o, size = self.opt, info.size
        given = float(o["rate"]) if "rate" in o else None
        if info.path.lower().endswith(".wav"):
            with filesystem.open_input_file(info.path) as f:
                dtype, ch, off, nbytes, rate = wav_header(lambda a, n: f.read_at(n, a), size)
            if given is not None and given != rate:
                raise ValueError(f"{info.path}: given sample rate conflicts with the WAV header")
            mode = o.get("mode", "audio_left")
            if mode == "iq" and ch != 2:
                raise ValueError(f"{info.path}: IQ mode needs two channels")
            if mode == "auto" and ch == 1:
                mode = "audio_left"
            lay = Layout(info.path, dtype, ch, off, 0, rate, True, mode)
            lay.total = nbytes // lay.stride
            return lay
        if o.get("datatype") not in DATATYPES:
            raise ValueError(f"{info.path}: unknown datatype {o.get('datatype')}")
        dtype, ch = DATATYPES[o["datatype"]]
        stride = np.dtype(dtype).itemsize * ch
        if size % stride:
            raise ValueError(f"{info.path}: {size} bytes are not whole samples of {stride} bytes")
        if given is None or given <= 0:
            raise ValueError("a positive sample rate is required")
        return Layout(info.path, dtype, ch, 0, size // stride, given, False, "iq" if ch == 2 else "real")

    def files(self) -> tuple[fs.FileSystem, list]:
        """The file, or the capture files of the folder."""
        filesystem, inner = open_path(self.opt["path"])
        info = filesystem.get_file_info(inner)
        return filesystem, [info] if info.type == fs.FileType.File else [
            f for f in filesystem.get_file_info(fs.FileSelector(inner, recursive=False)) if f.type == fs.FileType.File
            and f.path.lower().endswith(tuple(self.opt.get("suffixes", ".wav,.iq,.cu8,.cs8,.cs16,.sigmf-data").split(",")))]

    def ranges(self, filesystem, files: list) -> list[BlockRange]:
        """Block ranges of the files, `blocks_per_task` blocks each."""
        block = int(self.opt.get("block", BLOCK_SAMPLES))
        hop = int(self.opt.get("hop", 256))
        if block % hop or block < 16 * hop:
            raise ValueError("Block size must be a multiple of the frame hop and at least 16 hops.")
        per = int(self.opt.get("blocks_per_task", 16))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            lay = self.layout(filesystem, f)
            guard = int(self.opt["guard"]) if "guard" in self.opt else guard_length(block, lay.rate, hop)
            n = -(-lay.total // block)
            out += [BlockRange(lay, k, min(n, k + per), block, guard) for k in range(0, n, per)]
        return out

    def partitions(self):
        return self.ranges(*self.files())

    def read(self, part: BlockRange) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_path(self.opt["path"])
        with filesystem.open_input_file(part.layout.path) as f:
            for b in range(part.first, part.last):
                yield self.block_batch(f, part.layout, b, part.block, part.guard)

    @staticmethod
    def block_batch(f, lay: Layout, b: int, block: int, guard: int) -> pa.RecordBatch:
        """Block `b` of an open file with its guards, one row."""
        c0, c1 = b * block, min(lay.total, (b + 1) * block)
        a, z = max(0, c0 - guard), min(lay.total, c1 + guard)
        raw = f.read_at((z - a) * lay.stride, lay.offset + a * lay.stride)
        if len(raw) != (z - a) * lay.stride:
            raise ValueError(f"{lay.path}: capture ended unexpectedly")
        v = lay.samples(raw)
        if lay.choice == "iq":
            i, q = v[:, 0], v[:, 1]
        else:
            i = v[:, 1 if lay.choice == "audio_right" and lay.channels == 2 else 0]
            q = np.zeros(len(i))
        peak = np.max(np.hypot(i, q)) if len(i) else 0.0
        if not np.isfinite(peak):
            raise ValueError(f"{lay.path}: NaN or infinite samples in [{a}, {z})")
        if peak > MAX_MAGNITUDE:
            raise ValueError(f"{lay.path}: sample magnitude is too large; verify the datatype")
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.ascontiguousarray(x)))
        return pa.RecordBatch.from_arrays(
            [pa.array([lay.name or lay.path]), *[pa.array([int(x)], pa.int64()) for x in (capture_number(lay.path), b, a, z, c0, c1)],
             pa.array([lay.rate]), one(i), one(q)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class BlockStreamReader(DataSourceStreamReader):
    """New files of a folder as sample blocks.

    An offset is the place in the order of (modification time, path); a batch is the files between two offsets, cut into
    the same block ranges as a batch read. A file counts once its modification time lies `settle` seconds (10) back, so
    that one still being written is not taken and files that show up later come later in the order. What was read is in
    the stream's checkpoint; a restarted batch reads the same files again.
    """

    def __init__(self, options):
        self.blocks = BlockReader(options)
        self.settle = float(options.get("settle", 10))

    @staticmethod
    def _place(f) -> tuple[int, str]:
        return f.mtime_ns, f.path

    def initialOffset(self) -> dict:
        return {"mtime_ns": 0, "path": ""}

    def latestOffset(self) -> dict:
        limit = time.time_ns() - int(self.settle * 1e9)
        mtime_ns, path = max((self._place(f) for f in self.blocks.files()[1] if f.mtime_ns <= limit), default=(0, ""))
        return {"mtime_ns": mtime_ns, "path": path}

    def partitions(self, start: dict, end: dict):
        filesystem, files = self.blocks.files()
        a, z = ((o["mtime_ns"], o["path"]) for o in (start, end))
        return self.blocks.ranges(filesystem, [f for f in files if a < self._place(f) <= z])

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        return self.blocks.read(partition)

    def commit(self, end: dict) -> None:
        pass


class BlockSource(DataSource):
    """format("sample_blocks"): path, datatype, rate, block, guard, hop, mode, blocks_per_task; as a stream also settle."""

    @classmethod
    def name(cls):
        return "sample_blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BlockReader(self.options)

    def streamReader(self, schema):
        return BlockStreamReader(self.options)


def _read(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(BlockSource)
    return spark.read.format("sample_blocks").options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def read_iq(spark: SparkSession, path: str, datatype: str, rate: float, block: int = BLOCK_SAMPLES, guard: int | None = None,
            **options) -> DataFrame:
    return _read(spark, path=path, datatype=datatype, rate=rate, block=block, guard=guard, **options)


def read_wav(spark: SparkSession, path: str, mode: str = "audio_left", rate: float | None = None, block: int = BLOCK_SAMPLES,
             guard: int | None = None, **options) -> DataFrame:
    return _read(spark, path=path, mode=mode, rate=rate, block=block, guard=guard, **options)


def stream_blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    """Sample blocks of the files that arrive in a folder; options as for `read_iq` and `read_wav`, and `settle`."""
    spark.dataSource.register(BlockSource)
    return spark.readStream.format("sample_blocks").options(path=path, **{k: str(v) for k, v in options.items() if v is not None}).load()


def list_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Files with capture suffixes, sorted by name; the column-pruned listing never reads contents."""
    f = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{sigmf-data,wav,iq,cu8,cs8,cs16}").load(folder).drop("content"))
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")).orderBy("name")
