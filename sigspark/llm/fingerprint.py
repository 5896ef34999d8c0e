"""Document fingerprints from a randomised edit embedding.

A text is walked character by character: at step j the current character is put down, and a random bit that all texts
share for (j, character) says whether the walk moves on. Two texts that differ by few edits fall into step again soon after
each, so edit distance becomes Hamming distance between the walks. A text is walked in blocks of `BLOCK` code points with
`STEPS` steps per code point, all blocks of a batch at once; what lies behind the end of a block is blank.

The fingerprint keeps a consistent sample of the slots (block, step): those whose shared hash falls below 2^-level, with
the level so that about `SAMPLES` characters remain. A sample at a higher level is part of that at a lower one, so
fingerprints of texts of any lengths are compared on the slots of the higher level. Written as
`code points:level:hex characters of the slots in order`.

Near duplicates: bands of sampled slots are joined, each band's members with its smallest id, then members of different
components, and verified by likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import text as T
from .common import text_bytes, written
from .ngram_join import components

BLOCK = 512
STEPS = 3
SAMPLES = 96
#: slots per band, and bands that a fingerprint gives at each level
BAND_SLOTS = 4
#: members of a band that one task compares with each other
TILE = 4096
LANES = 8192

_U = np.uint64
_WALK = np.random.Generator(np.random.PCG64(77)).integers(0, 2, (BLOCK * STEPS, 256), dtype=np.uint8)


def _codes(text: str) -> np.ndarray:
    """Code points as bytes 1 to 255; 0 stays free for blanks."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = (c % np.uint32(255)).astype(np.uint8) + np.uint8(1)
    return small


def level_of(n: int) -> int:
    """About two steps per code point carry a character."""
    return max(0, int(np.floor(np.log2(max(1, 2 * n) / SAMPLES)))) if n else 0


@lru_cache(maxsize=4096)
def slots(n: int, level: int) -> np.ndarray:
    """Sampled slots (block * BLOCK * STEPS + step) of a text of n code points at a level, in order."""
    full, rest = divmod(n, BLOCK)
    last = full * BLOCK * STEPS + rest * STEPS
    out = []
    for lo in range(0, last, 1 << 20):
        s = np.arange(lo, min(last, lo + (1 << 20)), dtype=np.uint64)
        h = T.mix(s * T.BASE + _U(0x5851F42D4C957F2D))
        out.append(s[h < _U(1 << (64 - level))] if level else s)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def embed(texts: list[str]) -> list[np.ndarray]:
    """The walk of every text as characters of all its slots, block after block."""
    codes = [_codes(t) for t in texts]
    out: list[np.ndarray] = [np.zeros((len(c) // BLOCK) * BLOCK * STEPS + (len(c) % BLOCK) * STEPS, np.uint8) for c in codes]
    lanes = [(len(c[b:b + BLOCK]), i, b) for i, c in enumerate(codes) for b in range(0, len(c), BLOCK)]
    lanes.sort(reverse=True)
    for at in range(0, len(lanes), LANES):
        part = lanes[at:at + LANES]
        size = np.array([x[0] for x in part])
        grid = np.zeros((len(part), size[0] + 1), np.uint8)  # a blank column behind the longest block
        for r, (n, i, b) in enumerate(part):
            grid[r, :n] = codes[i][b:b + n]
        flat, row = grid.ravel(), np.arange(len(part)) * (size[0] + 1)
        pos, end = row.copy(), row + size
        seen = np.zeros((size[0] * STEPS, len(part)), np.uint8)
        live = len(part)
        for j in range(size[0] * STEPS):
            # blocks are sorted by size: those that have no steps left are at the end
            while live and size[live - 1] * STEPS <= j:
                live -= 1
            c = flat[pos[:live]]
            seen[j, :live] = c
            pos[:live] += _WALK[j][c] & (pos[:live] < end[:live])
            if not j & 63 and not c.any():
                break
        seen = np.ascontiguousarray(seen.T)
        for r, (n, i, b) in enumerate(part):
            out[i][b * STEPS:b * STEPS + n * STEPS] = seen[r, :n * STEPS]
    return out


def fingerprints(texts: list[str]) -> list[str]:
    out = []
    for t, e in zip(texts, embed(texts)):
        n = len(t)
        level = level_of(n)
        out.append(f"{n}:{level}:{e[slots(n, level)].tobytes().hex()}")
    return out


def _read(fp: str) -> tuple[int, int, np.ndarray]:
    n, level, body = fp.split(":")
    return int(n), int(level), np.frombuffer(bytes.fromhex(body), np.uint8)


def likeness(a: str, b: str) -> float:
    """Share of equal characters among the common sample's slots that hold a character of either text; two empty texts
    are alike."""
    if a == b:
        return 1.0
    (na, la, va), (nb, lb, vb) = _read(a), _read(b)
    level = max(la, lb)

    def at(n, own, v):
        if own == level:
            return v
        s = slots(n, own)
        return v[T.mix(s.astype(np.uint64) * T.BASE + _U(0x5851F42D4C957F2D)) < _U(1 << (64 - level))]

    sa, sb = slots(na, level), slots(nb, level)
    va, vb = at(na, la, va), at(nb, lb, vb)
    if len(sa) > len(sb):
        sa, sb, va, vb = sb, sa, vb, va
    # a text's slots are those below its length, so the shorter text's come first (but for its last, partial block)
    x = np.zeros(len(sb), np.uint8)
    where = np.minimum(np.searchsorted(sb, sa), max(0, len(sb) - 1))
    both = sb[where] == sa if len(sb) else np.zeros(len(sa), bool)
    x[where[both]] = va[both]
    alone = int((va[~both] > 0).sum())
    some = int(((x > 0) | (vb > 0)).sum()) + alone
    return float(((x == vb) & (x > 0)).sum() / some) if some else 0.0


# ---------------------------------------------------------------- operators

def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text.

    Null text is empty; an empty text has the fingerprint '0:0:'. Equal texts have equal fingerprints, repeated rows
    repeated results; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints(texts), pa.string())],
                                                 ["doc_id", "n_chars", "fingerprint"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def band_keys(fp: str) -> list[str]:
    """The bands of a fingerprint at its own level and the next, so texts of similar length meet."""
    n, own, v = _read(fp)
    s, out = slots(n, own), []
    for level in (own, own + 1):
        on = T.mix(s.astype(np.uint64) * T.BASE + _U(0x5851F42D4C957F2D)) < _U(1 << (64 - level)) if level else np.ones(len(s), bool)
        x, w = s[on], v[on]
        group = T.mix(x.astype(np.uint64) + _U(99)) % _U(max(1, SAMPLES // BAND_SLOTS))
        for g in np.unique(group[w > 0]):
            m = group == g
            out.append(f"{level}:{g}:" + hashlib.blake2b(x[m].tobytes() + w[m].tobytes(), digest_size=12).hexdigest())
    return out


def near_pairs(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, likeness) with a < b: verified links between documents that share a band. Two documents are joined by a chain
    of links exactly if a chain of alike documents, each sharing a band with the next, joins them. Members of a band meet
    its smallest id first; then all members of different components inside a band meet. Equal fingerprints are one
    member, known by its smallest id."""
    fp = written(fingerprint(docs).where("n_chars > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "fingerprints")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(f) for f in b.column("fingerprint").to_pylist()]
            ids = [i for i, k in zip(b.column("id").to_pylist(), keys) for _ in k]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for k in keys for x in k], pa.string())], ["id", "band"])

    x = written(fp.select("id", "fingerprint").mapInArrow(bands, "id long, band string"), "bands")
    first = x.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    pairs = x.join(first, "band").where("id > a").select("a", F.col("id").alias("b")).distinct()
    y = pairs.join(fp.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa")), "a").join(fp.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb")), "b")

    @F.pandas_udf("double")
    def alike(fa: pd.Series, fb: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(fa, fb)])

    links = written(y.select("a", "b", alike("fa", "fb").alias("likeness")).where(F.col("likeness") >= least), "links")
    return links.union(_other_links(fp, x, components(links.select("a", "b")), least))


def _other_links(fp: DataFrame, bands: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links between members of a band in different components. Bands of more than `TILE` members are dealt out as pairs of
    tiles; pairs are verified where they meet, so only links leave a task."""
    named = fp.join(labels.withColumnRenamed("key", "id"), "id", "left").select("id", "fingerprint", F.coalesce("comp", "id").alias("comp"))
    m = bands.join(named.select("id", "comp"), "id")
    mixed = m.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    mixed = mixed.select("band", F.ceil(F.col("n") / TILE).alias("split"))
    t = bands.join(mixed, "band").join(named, "id").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("split")))
    t = t.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("split") - 1)))
    t = t.select("band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "comp", "fingerprint")

    def meet(g: pa.Table) -> pa.Table:
        g = g.sort_by("id")
        i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
        ids, comps, tiles, fps = (g.column(c).to_pylist() for c in ("id", "comp", "tile", "fingerprint"))
        root = {c: c for c in comps}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for q in range(len(ids)):
            for p in range(q):
                # members of one tile meet in the group (tile, tile)
                if (i != j and tiles[p] == tiles[q]) or top(comps[p]) == top(comps[q]):
                    continue
                s = likeness(fps[p], fps[q])
                if s >= least:
                    out.append((ids[p], ids[q], s))
                    root[top(comps[q])] = top(comps[p])
        a, b, s = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "likeness"])

    return t.groupBy("band", "i", "j").applyInArrow(meet, "a long, b long, likeness double").distinct()


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(rows: list[tuple], fps: list[str], next_fp: list[str]) -> pa.RecordBatch:
    """rows: (doc_id, text, following text); fps: of the texts; next_fp: of the following texts."""
    edited = [_edited(t, f) for _, t, f in rows]
    efp = fingerprints(edited)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
         pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(fps, pa.string()), pa.array(efp, pa.string()),
         pa.array([likeness(a, b) for a, b in zip(fps, efp)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(fps, next_fp)], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_test(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the second half replaced by the start of the next document in
    descending doc_id, after the last the first), with likenesses.

    One range shuffle of the texts; a partition's last document meets the first of the next partition in a second step
    over two texts per partition. A null doc_id comes last; equal ids are ordered by a hash of the text and the text; a
    single document is its own next. Null text is empty; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    h = F.xxhash64("text")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // (32 << 20)))
    x = x.repartitionByRange(n, F.col("doc_id").desc_nulls_last(), h.asc()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), h.asc(), F.col("text").asc())
    extra = _OUT + ", part long, role string, text string"

    def edge(part: int, role: str, doc_id, text: str) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        names = [c.split()[0] for c in extra.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *[pa.nulls(1, k) for k in kinds[1:]], pa.array([part], pa.int64()), pa.array([role]), pa.array([text])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            for s in T.slices(batch):
                ids, texts = s.column("doc_id").to_pylist(), s.column("text").to_pylist()
                fps = fingerprints(texts)
                if last is None:
                    yield edge(part, "first", ids[0], texts[0])
                else:
                    ids, texts, fps = [last[0], *ids], [last[1], *texts], [last[2], *fps]
                last = (ids[-1], texts[-1], fps[-1])
                if len(ids) > 1:
                    out = _results(list(zip(ids, texts, texts[1:])), fps[:-1], fps[1:])
                    m = out.num_rows
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string())], [c.split()[0] for c in extra.split(", ")])
        if last is not None:
            yield edge(part, "last", last[0], last[1])

    w = written(x.mapInArrow(run, extra), "edges")
    inner = w.where("role is null").select(*[c.split()[0] for c in _OUT.split(", ")])
    # one row per partition and role: the first text of the next partition that has any, around the end
    parts = w.where("role = 'first'").select("part")
    step = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy(F.lit(0)))).alias("next"))
    ends = w.where("role = 'last'").select("doc_id", F.col("text").alias("a"), "part").join(step, "part")
    ends = ends.join(w.where("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("b")), "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in T.slices(b, "a"):
                rows = list(zip(s.column("doc_id").to_pylist(), s.column("a").to_pylist(), s.column("b").to_pylist()))
                yield _results(rows, fingerprints([r[1] for r in rows]), fingerprints([r[2] for r in rows]))

    return inner.union(ends.select("doc_id", "a", "b").mapInArrow(close, _OUT))
