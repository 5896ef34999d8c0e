"""Token-id files of independent zstandard frames.

A file holds one zstandard frame per document (its ids as little-endian unsigned 32-bit integers, closed by the end id),
then a skippable frame with the document ids and token counts, then the seek table of the zstandard seekable format:
compressed size, decompressed size and checksum (low 32 bits of xxHash64 of the content) of every frame before it. A
reader fetches the last 9 bytes, the seek table and the frames of the documents it wants, nothing else.

Documents are range-partitioned by id, so file i holds smaller ids than file i + 1. A task writes under a name of its own
and renames when the file is complete; a task that runs again puts an equal file there.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import text as T
from .common import scratch, text_bytes

SKIPPABLE_INDEX = 0x184D2A50
#: fixed values of the zstandard seekable format
SKIPPABLE_SEEK, SEEK_MAGIC, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID = 1
#: text bytes per file
FILE_BYTES = 32 << 20
#: words of each of the two generations that a worker remembers with their ids, some 70 MB each
REMEMBER = 400_000
LEVEL = 3

_STRIP = ".,!#$%&*|;:?"
#: words whose letters no normalisation changes once they are in lower case
_PLAIN = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")


class _Known(dict):
    """Words with their ids; a word that is not there yet is encoded when it is asked for."""

    def __init__(self, encode, older: dict | None = None):
        super().__init__({"": b""})
        self.encode, self.older = encode, older or {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts. Neither normalisation nor splitting of these tokenizers reaches across a space, so a text is
    encoded word by word and frequent words are looked up. What is remembered is bounded: two generations of `REMEMBER`
    words."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self._word)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # white space is dropped, case does not matter, and words become bytes before they are merged
        self.by_word = (steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut] == ["Split", "ByteLevel"]
                        and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and not cut[1]["use_regex"] and not cut[1]["add_prefix_space"])
        self.byte_form: dict[str, str] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes_of(self, char: str) -> str:
        form = self.byte_form[char] = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(char))
        return form

    def _word(self, word: str) -> bytes:
        """A word of letters in lower case is one piece of the merge model; one with punctuation behind it is two words,
        and case does not matter; anything else takes the whole way."""
        if _PLAIN.fullmatch(word):
            form = "".join([self.byte_form.get(c) or self._bytes_of(c) for c in word])
            return array("I", [t.id for t in self.tokenizer.model.tokenize(form)]).tobytes()
        head = word.rstrip(_STRIP)
        low = head.lower()
        if low and _PLAIN.fullmatch(low) and (low != word):
            return self.known[low] + self.known[word[len(head):]]
        return self._ids([word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._ids(texts)
        if len(self.known) > REMEMBER:
            self.known = _Known(self._word, dict(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class Writer:
    """One file of frames."""

    def __init__(self, out):
        import zstandard
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.sizes: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.null: list[bool] = []
        self.at = 0

    def _put(self, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.sizes.append((len(frame), size, check))
        self.at += len(frame)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash
        self._put(self.zstd.compress(ids), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids.append(-1 if doc_id is None else doc_id)
        self.null.append(doc_id is None)

    def close(self) -> None:
        import xxhash
        index = self.zstd.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes())
        frame = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        self._put(frame, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF)
        table = np.array(self.sizes, "<u4").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), HAS_CHECKSUM, SEEK_MAGIC))


class Reader:
    """Random access to one file: `index` (doc_id or None by frame) and `ids(i)`."""

    def __init__(self, source):
        import xxhash
        import zstandard
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUM:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.table, self.at = table[:-1], np.concatenate(([0], np.cumsum(table[:, 0])))
        source.seek(int(self.at[n - 1]) + 8)
        raw = source.read(int(table[-1, 0]) - 8)
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != table[-1, 2]:
            raise ValueError("checksum of the document index")
        raw = self.zstd.decompress(raw, max_output_size=9 * (n - 1)) if n > 1 else b""
        ids, null = np.frombuffer(raw[:8 * (n - 1)], "<i8"), np.frombuffer(raw[8 * (n - 1):], "u1")
        self.index = [None if z else int(i) for i, z in zip(ids, null)]

    def ids(self, i: int) -> bytes:
        import xxhash
        _, size, check = self.table[i]
        self.source.seek(int(self.at[i]))
        out = self.zstd.decompress(self.source.read(int(self.table[i, 0])), max_output_size=int(size))
        if len(out) != size or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"checksum of frame {i}")
        return out

    def __len__(self) -> int:
        return len(self.index)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text and write the files; returns their manifest (part, file, documents, tokens), which is
    written beside them. Ascending doc_id, null ids first; equal ids by a hash of the text."""
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, fs, documents, tokens = Encoder.of(tokenizer), None, None, 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for s in T.slices(batch):
                if out is None:
                    fs, path = _filesystem(folder)
                    fs.create_dir(path)
                    temp, final = f"{path}/.{uuid.uuid4().hex}", f"{path}/part-{part:06d}.zst"
                    raw = fs.open_output_stream(temp)
                    out = Writer(raw)
                texts = s.column("text").to_pylist()
                for doc, ids in zip(s.column("doc_id").to_pylist(), encoder.encode([t or "" for t in texts])):
                    out.add(doc, ids + end)
                    documents += 1
                    tokens += len(ids) // 4 + 1
        if out is not None:
            out.close()
            raw.close()
            fs.move(temp, final)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/part-{part:06d}.zst"], "documents": [documents], "tokens": [tokens]})

    parts = max(1, -(-text_bytes(docs) // FILE_BYTES))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.xxhash64("text")
    x = x.repartitionByRange(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col("doc_id").asc(), h.asc())
    x = x.sortWithinPartitions(F.col("doc_id").asc(), h.asc(), F.col("text").asc())
    m = x.mapInArrow(run, "part long, file string, documents long, tokens long")
    m.write.parquet(f"{folder}/manifest")
    return spark.read.schema(m.schema).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents in the files, `ids` as binary. With `wanted`, only the
    frames of those documents are fetched. The only window runs over one row per file."""
    import zlib

    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    n = manifest.count()
    pick = set(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, path = _filesystem(file)
                with fs.open_input_file(path) as source:
                    x = Reader(source)
                    sizes = x.table[:, 1] // 4
                    starts = start + np.cumsum(sizes) - sizes
                    rows, held = [], 0
                    for i, doc in enumerate(x.index):
                        if pick is None or doc in pick:
                            ids = x.ids(i)
                            rows.append((doc, int(starts[i]), len(ids) // 4, zlib.crc32(ids), ids))
                            held += len(ids)
                        if rows and (held > T.SLICE_BYTES or i == len(x) - 1):
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return files.repartition(max(1, n), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the files, read every document back.

    Null text is empty and gives the end id alone; null ids come first; repeated rows are documents of their own, next
    to each other; other columns are ignored; an empty table writes no file and returns no row.
    """
    spark = docs.sparkSession
    return read(write(docs, folder or scratch(spark, "tokens"), tokenizer))
