"""Words, shingles and byte statistics of many texts at once, on the UTF-8 buffers of an Arrow string column.

Everything here runs inside tasks on one slice of a record batch: a slice holds at most `SLICE_BYTES` of text (or one
longer document) and at most `SLICE_DOCS` documents, which bounds the memory of the temporaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_DOCS = 4096
TOKEN_BITS = 52

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
BASE = _U(0x9E3779B97F4A7C15)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of a word: all but space and 09-0D
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: bytes of a word: digits, ASCII letters and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text"):
    """Parts of a batch of bounded text size."""
    if not batch.num_rows:
        return
    _, offs = flat(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), i + SLICE_DOCS, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of the bytes in `table`; no run crosses two documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word (lower-cased bytes are expected)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    power = np.full(int(lens.max()), BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    v = BYTE_VALUE[data[at + np.repeat(starts, lens)]] * power[at]
    return mix(np.add.reduceat(v, np.cumsum(lens) - lens) + lens.astype(np.uint64) * BASE)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k successive words; the caller drops those that cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j:j + n] * PLACE[j]
    return mix(out + _U(k))


def shingle_sets(column, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every text as sorted 52-bit tokens: (tokens, offsets by document).

    Words are runs of other characters than space and 09-0D, ASCII letters in lower case. A text of fewer words than
    k has its whole word sequence as one shingle; a text without words has none.
    """
    data, offs = flat(column)
    docs = len(offs) - 1
    data = LOWER[data]
    s, e, doc = word_spans(data, offs, NOT_SPACE)
    h = word_hashes(data, s, e)
    count = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
    first = np.cumsum(count) - count
    sh = rolling(h, k)
    inside = doc[:len(sh)] == doc[len(doc) - len(sh):] if len(sh) else np.zeros(0, bool)
    tok, own = [sh[inside]], [doc[:len(sh)][inside]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            v = np.zeros(len(short), np.uint64)
            for j in range(n):
                v += h[first[short] + j] * PLACE[j]
            tok.append(mix(v + _U(n)))
            own.append(short)
    key = (np.concatenate(own).astype(np.uint64) << _U(TOKEN_BITS)) | (np.concatenate(tok) >> _U(64 - TOKEN_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    own = (key >> _U(TOKEN_BITS)).astype(np.int64)
    return key & _U((1 << TOKEN_BITS) - 1), np.searchsorted(own, np.arange(docs + 1))


def set_keys(tokens: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """128-bit identity of every token set, as two columns; zero for an empty set."""
    out = np.zeros((len(offs) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        for c, salt in enumerate((_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))):
            out[full, c] = mix(np.add.reduceat(mix(tokens ^ salt), offs[full]) + np.diff(offs)[full].astype(np.uint64))
    return out


def fixed_binary(a: np.ndarray, width: int) -> pa.Array:
    """A binary column of `width` bytes a row from the rows of a contiguous array."""
    a = np.ascontiguousarray(a)
    n = a.nbytes // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(a)])


def pieces(a: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column whose row i holds a[offs[i]:offs[i + 1]]."""
    a = np.ascontiguousarray(a)
    o = (np.asarray(offs, np.int64) * a.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(o) - 1, [None, pa.py_buffer(o), pa.py_buffer(a)]).cast(pa.binary())
