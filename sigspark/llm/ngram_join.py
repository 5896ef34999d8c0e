"""Exact Jaccard join of word n-gram sets with count-vector R-trees.

Tokens (5-word shingles) are hashed into groups; the counts per group are a point, and the sum of the smaller
coordinates of two points bounds the overlap of their sets from above. The same bound is used at three levels:

1. Whole corpus. Two sets with Jaccard similarity >= t differ in at most (1 - t) n of the tokens of either. A part of the
   token space (`PROBE` of it) is exchanged; a set with more than (1 - t) n tokens there that nobody else has can be
   linked with nothing. The check is repeated over all tokens among the sets that are left.
2. R-tree nodes. Linked sets share one of their first n - ceil(t n) + 1 tokens in any order that all sets have in common:
   here common tokens come last (`token_levels`), so the lists of the sets that meet in such a token stay short. The sets of a
   list are packed into leaves, large components apart, sorted by size and counts; a leaf keeps the largest count of each group
   and its sizes, and pairs of leaves that cannot reach the bound are skipped.
3. Points. Pairs that pass the bound are verified on the token sets themselves.

Sets that are equal are one node from the start. Posting lists of up to `SMALL` sets are paired at once. Inside longer ones
pairs are proposed in three rounds, each followed by verification and connected components: with the member of most lists, then
with the nearest member of another component, and finally every pair of different components that the bound lets pass. So
links between different components are all checked, while a family of thousands of near copies never becomes all its pairs. Only
lists that still span several components are searched in the later rounds; lists with the same smallest member share a task, and
a set's point goes there once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T
from .common import SALTS, Bloom, row_hash, settled, spread_join, text_bytes, written

GROUPS = 64
#: groups of the points, where near misses have to be told from links
FINE_GROUPS = 512
LEAF = 32
#: share of the token space that decides about most sets
PROBE = 0.4
#: text bytes behind one exchange bucket of the whole corpus
BUCKET_BYTES = 16 << 20
#: tokens behind one exchange bucket of the survivors
BUCKET_TOKENS = 1 << 21
#: posting lists up to this length are joined at once; longer ones go through the rounds
SMALL = 8
#: sets in one R-tree task; fuller groups of lists are split into pairs of tiles
TILE = 1 << 12
FLUSH = 1 << 22
#: tokens of at least so many sets come last in the prefixes
COMMON = 16
#: slots of the broadcast table of such tokens: 4 MB whatever the input
LEVEL_SLOTS = 1 << 22
#: power of two of the sets from which on a token's list is made in `SALTS` parts
HOT_LEVEL = 16

_U = np.uint64


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> _U(T.TOKEN_BITS - 32)) * _U(buckets) >> _U(32)).astype(np.int64)


# ---------------------------------------------------------------- sets

def sets(docs: DataFrame, k: int, probe: float) -> DataFrame:
    """One narrow row per document: doc_id, row (hash of all its columns), key (identity of its set), h (64 bits of it), n, n_probe."""
    limit = _U(int(probe * (1 << T.TOKEN_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                tokens, offs = T.shingle_sets(part.column("text"), k)
                keys = T.set_keys(tokens, offs)
                low = np.concatenate(([0], np.cumsum(tokens < limit)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), T.fixed_binary(keys, 16), pa.array(keys[:, 0].view(np.int64)),
                     pa.array(np.diff(offs).astype(np.int64)), pa.array((low[offs[1:]] - low[offs[:-1]]).astype(np.int64))],
                    ["doc_id", "row", "key", "h", "n", "n_probe"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash(docs).alias("row"))
    return x.mapInArrow(run, "doc_id long, row long, key binary, h long, n long, n_probe long")


class _Requests:
    """Collects the tokens of many sets and packs them as (token, ref) entries by bucket. A flush sends a set once, however
    many copies of it were added."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, tokens: np.ndarray, keys: np.ndarray, lens: np.ndarray):
        """Sets of `lens` tokens each and their identities, two columns as from `set_keys`."""
        self.held.append((tokens, keys, lens))
        self.size += len(tokens)

    def flush(self) -> pa.RecordBatch:
        tokens, keys, lens = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        by = np.lexsort((keys[:, 1], keys[:, 0]))
        once = np.ones(len(keys), bool)
        once[by[1:]] = (keys[by[1:]] != keys[by[:-1]]).any(1)
        tokens, refs = tokens[np.repeat(once, lens)], np.repeat(np.maximum(keys[once, 0].astype(np.uint32), 1), lens[once])
        order = np.argsort(tokens, kind="stable")
        tokens, refs = tokens[order], refs[order]
        # what occurs twice here is known to be shared: one entry is enough for the others, and its sets are told by ref
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(tokens)))
        twice = np.repeat(size > 1, size)
        known, times = np.unique(refs[twice], return_counts=True)
        home = _home(known, self.buckets)
        keep = new | ~twice
        second = size > 1  # sent as two entries of which no set is told
        tokens = np.concatenate((tokens[keep], tokens[start][second]))
        refs = np.concatenate((np.where(twice, np.uint32(0), refs)[keep], np.zeros(int(second.sum()), np.uint32)))
        told = np.concatenate((~twice[keep], np.zeros(int(second.sum()), bool)))
        b = _bucket(tokens, self.buckets)
        order = np.argsort(b, kind="stable")
        tokens, refs, b = tokens[order], np.where(told, refs, np.uint32(0))[order], b[order]
        ids = np.unique(np.concatenate((b, home)))
        o = np.append(np.searchsorted(b, ids), len(b))
        p = np.append(np.searchsorted(home, ids), len(home))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), T.pieces((tokens & _U(0xFFFFFFFF)).astype(np.uint32), o), T.pieces(refs, o), T.pieces(known, p), T.pieces(times.astype(np.uint32), p)],
            ["bucket", "tokens", "refs", "known", "times"])


REQUEST = "bucket long, tokens binary, refs binary, known binary, times binary"


def _home(refs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket that adds up a ref; it rises with the ref."""
    return (refs.astype(np.uint64) * _U(buckets) >> _U(32)).astype(np.int64)


def _join(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32)


def _summed(refs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every ref once, ascending, with the sum of its times."""
    out, at = np.unique(refs, return_inverse=True)
    return out, np.bincount(at, times, len(out)).astype(np.int64)


def shared_counts(requests: DataFrame, buckets: int) -> DataFrame:
    """(ref, shared): how many of the tokens sent for a ref occur more than once. Refs are 32 bits of a set's identity:
    equal refs of different sets add up, which can only keep a set, never drop it. Ref 0 stands for no set. Refs travel
    with their counts, one entry per flush and per bucket, so copies of one set do not pile up at its ref."""

    def count(t: pa.Table) -> pa.Table:
        tokens, refs = _join(t.column("tokens")), _join(t.column("refs"))
        order = np.argsort(tokens, kind="stable")
        tokens, refs = tokens[order], refs[order]
        same = np.zeros(len(tokens) + 1, bool)
        same[1:-1] = tokens[1:] == tokens[:-1]
        hit = refs[(same[1:] | same[:-1]) & (refs > 0)]
        hit, times = _summed(np.concatenate((hit, _join(t.column("known")))), np.concatenate((np.ones(len(hit), np.uint32), _join(t.column("times")))))
        home = _home(hit, buckets)
        ids = np.unique(home)
        at = np.append(np.searchsorted(home, ids), len(home))
        return pa.table([pa.array(ids), T.pieces(hit, at), T.pieces(np.minimum(times, 0xFFFFFFFF).astype(np.uint32), at)], ["home", "refs", "times"])

    def total(t: pa.Table) -> pa.Table:
        refs, n = _summed(_join(t.column("refs")), _join(t.column("times")))
        return pa.table([pa.array(refs.astype(np.int64)), pa.array(n)], ["ref", "shared"])

    told = requests.groupBy("bucket").applyInArrow(count, "home long, refs binary, times binary")
    return told.groupBy("home").applyInArrow(total, "ref long, shared long")


def _ref(h: str):
    return F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("ref")


# ---------------------------------------------------------------- candidates

def count_vectors(tokens: np.ndarray, offs: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Tokens of every set counted in hash groups. A count is at most the set's size, which is far below the type's limit
    with `GROUPS`; finer points are kept in bytes and saturate, which `bounds` makes up for."""
    m = len(offs) - 1
    own = np.repeat(np.arange(m), np.diff(offs))
    v = np.bincount(own * groups + (tokens % _U(groups)).astype(np.int64), minlength=m * groups).reshape(m, groups)
    kind = np.uint16 if groups == GROUPS else np.uint8
    return np.minimum(v, np.iinfo(kind).max).astype(kind)


def within(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray, share: int) -> np.ndarray:
    """Can an overlap of at most `overlap` reach the similarity? 100 inter >= share union, union = na + nb - inter."""
    return (100 + share) * overlap >= share * (na + nb)


def bounds(va: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """Largest possible overlap of row i of va with row j of vb: summed coordinate minima. A minimum at the type's limit
    stands for any number."""
    full = np.iinfo(va.dtype).max
    low = np.minimum(va[:, None, :], vb[None, :, :])
    out = low.sum(2, dtype=np.uint32).astype(np.int64)
    if va.size and vb.size and va.max() == full and vb.max() == full:
        out += np.where((low == full).any(2), 1 << 40, 0)
    return out


def packed_order(v: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sort-tile order: sides and components that fill a leaf apart, size bands of one eighth, then the counts of the first groups."""
    _, at, count = np.unique(comp, return_inverse=True, return_counts=True)
    band = np.floor(np.log(np.maximum(n, 1)) * 8)
    return np.lexsort((v[:, 3], v[:, 2], v[:, 1], v[:, 0], band, np.where(count[at] >= LEAF, at + 1, 0), side))


def search_tree(v: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, share: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, bound) of different components that may be linked, by leaves of the packed tree. With two sides only
    pairs across them."""
    order = packed_order(v, n, comp, side)
    leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
    at = np.arange(0, len(order), LEAF)
    top = np.maximum.reduceat(v[order], at)
    least, most = np.minimum.reduceat(n[order], at), np.maximum.reduceat(n[order], at)
    ends = [(np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at)) for x in (comp, side)]
    across = len(side) > 0 and ends[1][0].min() != ends[1][1].max()
    for a, x in enumerate(leaves):
        ok = (100 * most[a:] >= share * least[a]) & (100 * most[a] >= share * least[a:])
        for lo, hi in ends[:1 + across]:
            ok &= ~((lo[a] == hi[a]) & (lo[a:] == lo[a]) & (hi[a:] == hi[a]))
        near = np.flatnonzero(ok) + a
        if not len(near):
            continue
        for b in near[within(bounds(top[a:a + 1], top[near])[0], least[a], least[near], share)]:
            y = leaves[b]
            bd = bounds(v[x], v[y])
            good = within(bd, n[x][:, None], n[y][None, :], share) & (comp[x][:, None] != comp[y][None, :])
            if across:
                good &= side[x][:, None] != side[y][None, :]
            if a == b:
                good &= np.tri(len(x), k=-1, dtype=bool)
            i, j = np.nonzero(good)
            if len(i):
                yield x[i], y[j], bd[i, j]


# ---------------------------------------------------------------- posting lists

def token_levels(family: DataFrame, total: int) -> np.ndarray:
    """The power of two of a token's number of sets, by slot: the largest of the slot's tokens, 0 below `COMMON`, which rises
    with the tokens so that the slots suffice. The order of the prefixes follows it. Any order that all sets have in common
    gives the same links, so tokens that share a slot cost time only."""
    slots, buckets = LEVEL_SLOTS, max(1, -(-total // BUCKET_TOKENS))
    least = max(COMMON, total // slots)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        b = _bucket(tokens, buckets)
        ids = np.unique(b)
        o = np.append(np.searchsorted(b, ids), len(b))
        return pa.RecordBatch.from_arrays([pa.array(ids), T.pieces((tokens & _U(0xFFFFFFFF)).astype(np.uint32), o), T.pieces(times.astype(np.uint32), o)],
                                          ["bucket", "tokens", "times"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in batches:
            held.append(np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.uint64))
            size += len(held[-1])
            if size >= FLUSH:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)

    def common(t: pa.Table) -> pa.Table:
        tokens, n = _summed(_join(t.column("tokens")), _join(t.column("times")))
        tokens, n = tokens[n >= least], n[n >= least]
        return pa.table([pa.array((tokens & np.uint32(slots - 1)).astype(np.int64)), pa.array(np.floor(np.log2(n)).astype(np.int64))], ["slot", "level"])

    told = family.select("tokens").mapInArrow(tell, "bucket long, tokens binary, times binary").groupBy("bucket").applyInArrow(common, "slot long, level long")
    told = told.groupBy("slot").agg(F.max("level").alias("level")).select(F.col("slot").cast("int"), F.col("level").cast("tinyint")).toArrow()
    levels = np.zeros(slots, np.uint8)
    levels[told.column("slot").to_numpy()] = told.column("level").to_numpy()
    return levels


def _slots(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return (tokens & _U(len(levels) - 1)).astype(np.int64)


def _prefixes(part: pa.RecordBatch, share: int, buckets: int, levels: np.ndarray):
    """Prefix tokens of every set of a batch: (sizes, token, level, owner, bucket), sorted by bucket."""
    raw = part.column("tokens")
    n = (np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]) // 8).astype(np.int64)
    tokens = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
    own = np.repeat(np.arange(len(n)), n)
    level = levels[_slots(tokens, levels)]
    at = np.argsort(own * 64 + level, kind="stable")  # the tokens of a set are sorted, so a level is in their order
    take = n + (-share * n // 100) + 1
    first = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(take, n)
    at, own = at[first], own[first]
    t, level = tokens[at], level[at]
    b = _bucket(T.mix(t) >> _U(64 - T.TOKEN_BITS), buckets)
    order = np.argsort(b, kind="stable")
    return n, t[order], level[order], own[order], b[order]


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order of a task's sets whatever the order of its rows, and the place of every set in it."""
    by = np.lexsort((keys.view(np.uint64).reshape(-1, 2)[:, 1], keys.view(np.uint64).reshape(-1, 2)[:, 0]))
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return by, back


def _first_pairs(start: np.ndarray, size: np.ndarray, own: np.ndarray, long_: np.ndarray, m: int) -> np.ndarray:
    """Codes i * m + j (i < j) of all pairs of the short lists, and of the members of a long list with its leader."""
    code = lambda p, q: np.minimum(p, q) * m + np.maximum(p, q)
    out: list[np.ndarray] = [np.zeros(0, np.int64)]
    for w in np.unique(size[~long_ & (size > 1)]):
        rows = own[start[~long_ & (size == w)][:, None] + np.arange(w)]
        i, j = np.triu_indices(w, 1)
        out.append(np.unique(code(rows[:, i].ravel(), rows[:, j].ravel())))
    # the member of most long lists leads each of its lists, so that lists of one family agree on it
    inside = np.repeat(long_, size)
    lists, x = np.repeat(np.arange(len(size)), size)[inside], own[inside]
    often = np.bincount(x, minlength=m)
    by = np.lexsort((x, -often[x], lists))
    head = by[np.concatenate((np.ones(min(1, len(by)), bool), lists[by][1:] != lists[by][:-1]))]
    lead = np.zeros(len(size), np.int64)
    lead[lists[head]] = x[head]
    y = lead[lists]
    out.append(np.unique(code(x[x != y], y[x != y])))
    return np.unique(np.concatenate(out))


def postings(family: DataFrame, share: int, buckets: int, levels) -> DataFrame:
    """One exchange of the prefix tokens: a row per proposed pair of set keys (a, b) whose sizes can reach the similarity, and
    a row per long list (list, members). Equal lists have one number; so have the parts of the list of a hot token."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, t, level, own, b = _prefixes(batch, share, buckets, levels.value)
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), "V16")
            salt = np.where(level >= HOT_LEVEL, (keys.view(np.uint64).reshape(-1, 2)[own, 1] % _U(SALTS)).astype(np.int64), 0)
            order = np.lexsort((salt, b))
            t, own, group = t[order], own[order], (b * SALTS + salt)[order]
            ids = np.unique(group)
            cut = np.append(np.searchsorted(group, ids), len(group))
            who = [np.unique(own[lo:hi], return_inverse=True) for lo, hi in zip(cut, cut[1:])]
            sets_ = np.append(0, np.cumsum([len(w) for w, _ in who]))
            every = np.concatenate([w for w, _ in who])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids // SALTS), pa.array(ids % SALTS), T.pieces(t, cut), T.pieces(np.concatenate([i for _, i in who]).astype(np.uint32), cut),
                 T.pieces(keys[every], sets_), T.pieces(n[every], sets_)], ["bucket", "part", "tokens", "owners", "keys", "sizes"])

    def meet(t: pa.Table) -> pa.Table:
        get = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        owners, keys = get("owners", np.uint32), get("keys", "V16")
        base = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
        own = np.concatenate([o.astype(np.int64) + x for o, x in zip(owners, base)])
        tokens, keys, n = np.concatenate(get("tokens", np.uint64)), np.concatenate(keys), np.concatenate(get("sizes", np.int64))
        by, back = _by_key(keys)
        keys, n, own = keys[by], n[by], back[own]
        m = len(n)
        order = np.lexsort((own, tokens))
        tokens, own = tokens[order], own[order]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        size = np.diff(np.append(start, len(tokens)))
        hot = levels.value[_slots(tokens[start], levels.value)] >= HOT_LEVEL
        long_ = (size > SMALL) | hot
        code = _first_pairs(start, size, own, long_, m)
        i, j = code // m, code % m
        ok = 100 * np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
        name = np.add.reduceat(T.mix(keys.view(np.uint64).reshape(-1, 2)[own, 1]), start) + size.astype(np.uint64)
        name = np.where(hot, T.mix(tokens[start]), name)
        one = np.flatnonzero(long_)[np.unique(name[long_], return_index=True)[1]]
        at = np.repeat(start[one], size[one]) + np.arange(int(size[one].sum())) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
        members = T.pieces(keys[own[at]], np.append(0, np.cumsum(size[one])))
        none = lambda k: pa.nulls(k, pa.binary())
        pairs = [T.fixed_binary(keys[i[ok]], 16), T.fixed_binary(keys[j[ok]], 16), pa.nulls(int(ok.sum()), pa.int64()), none(int(ok.sum()))]
        lists = [none(len(one)), none(len(one)), pa.array(name[one].view(np.int64)), members]
        return pa.table([pa.chunked_array([p, q]) for p, q in zip(pairs, lists)], ["a", "b", "list", "members"])

    packs = family.select("key", "tokens").mapInArrow(pack, "bucket long, part long, tokens binary, owners binary, keys binary, sizes binary")
    return packs.groupBy("bucket", "part").applyInArrow(meet, "a binary, b binary, list long, members binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _members(lists: DataFrame) -> DataFrame:
    """(list, key) of every member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                members = part.column("members").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("list").to_numpy(), [len(x) // 16 for x in members])),
                                                  T.fixed_binary(np.frombuffer(b"".join(members), "V16"), 16)], ["list", "key"])

    return lists.select("list", "members").mapInArrow(run, "list long, key binary").distinct()


# ---------------------------------------------------------------- points

def set_points(family: DataFrame) -> DataFrame:
    """key, n and the fine count vector of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                raw = part.column("tokens").to_pylist()
                n = np.array([len(x) // 8 for x in raw], np.int64)
                tokens, offs = np.frombuffer(b"".join(raw), np.uint64), np.append(0, np.cumsum(n))
                for lo in range(0, len(n), 1024):
                    o = offs[lo:lo + 1025]
                    v = count_vectors(tokens[o[0]:o[-1]], o - o[0], FINE_GROUPS)
                    yield pa.RecordBatch.from_arrays([part.column("key").slice(lo, len(v)), pa.array(n[lo:lo + len(v)]), T.fixed_binary(v, FINE_GROUPS)],
                                                     ["key", "n", "vector"])

    return family.select("key", "tokens").mapInArrow(run, "key binary, n long, vector binary")


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FINE_GROUPS)


def bounded(pairs: DataFrame, points: DataFrame, share: int) -> DataFrame:
    """The pairs whose points can reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                low = np.minimum(_vectors(t.column("va")), _vectors(t.column("vb")))
                most = low.sum(1, dtype=np.int64) + np.where((low == 255).any(1), 1 << 40, 0)
                ok = pa.array(within(most, t.column("na").to_numpy(), t.column("nb").to_numpy(), share))
                yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok)], ["a", "b"])

    x = pairs.join(points.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va")), "a")
    x = x.join(points.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb")), "b")
    return x.select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a binary, b binary")


def mixed_lists(lists: DataFrame, family: DataFrame, labels: DataFrame) -> DataFrame:
    """list, key, comp (a 64-bit component number) and g (the list's smallest key) of the lists of several components."""
    comp = F.conv(F.substring(F.hex(F.coalesce("comp", "key")), 1, 15), 16, 10).cast("long").alias("comp")
    x = lists.select("list", "key").join(family.select("key").join(labels, "key", "left").select("key", comp), "key")
    ends = x.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("key").alias("g"), F.count(F.lit(1)).alias("rows"))
    return spread_join(x, ends.where("lo != hi").select("list", "g", "rows"), ["list"], "rows", lists.count()).select("list", "key", "comp", "g")


def _searched(lists: np.ndarray, own: np.ndarray, v: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, share: int):
    """(i, j, bound) of the pairs that the trees of a task's lists let pass: one tree per list, or one over all their members
    where that compares less."""
    order = np.lexsort((own, lists))
    lists, own = lists[order], own[order]
    start = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
    several = np.minimum.reduceat(comp[own], start) != np.maximum.reduceat(comp[own], start)
    parts = [own[lo:hi] for lo, hi, s in zip(start, np.append(start[1:], len(own)), several) if s]
    if not parts:
        return
    every = np.unique(np.concatenate(parts))
    if sum(len(x) ** 2 for x in parts) > len(every) ** 2:
        parts = [every]
    for x in parts:
        for i, j, bd in search_tree(v[x], n[x], comp[x], side[x], share):
            yield x[i], x[j], bd


def propose(lists: DataFrame, points: DataFrame, mode: str, share: int) -> DataFrame:
    """Pairs (a, b) of set keys of different components that share a list of `mixed_lists` and pass the bound: those with the
    nearest member of another component, or all."""

    def meet(t: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(t.column("key").to_pylist()), "V16")
        by, _ = _by_key(keys)
        t, keys = t.take(pa.array(by)), keys[by]
        n, comp, v = t.column("n").to_numpy(), t.column("comp").to_numpy(), _vectors(t.column("vector"))
        i_, j_, tile = (t.column(c).to_numpy() for c in ("i", "j", "tile"))
        side = np.where(i_ != j_, tile, 0)
        names = t.column("lists").combine_chunks()
        own = np.repeat(np.arange(len(n)), names.value_lengths().to_numpy())
        m = len(n)
        found = _searched(names.flatten().to_numpy(), own, v, n, comp, side, share)
        code = lambda p, q: np.minimum(p, q) * m + np.maximum(p, q)
        if mode == "all":
            out = np.unique(np.concatenate([np.zeros(0, np.int64), *(code(i, j) for i, j, _ in found)]))
        else:
            _, inverse, count = np.unique(comp, return_inverse=True, return_counts=True)
            asks = inverse != np.argmax(count)
            best, partner = np.full(m, -1.0), np.zeros(m, np.int64)
            for i, j, bd in found:
                score = bd / (n[i] + n[j])
                for a, b in ((i, j), (j, i)):
                    at = np.lexsort((b, -score, a))
                    one = at[np.concatenate(([True], a[at][1:] != a[at][:-1]))]
                    up = one[score[one] > best[a[one]]]
                    best[a[up]], partner[a[up]] = score[up], b[up]
            got = np.flatnonzero((best >= 0) & asks)
            out = np.unique(code(got, partner[got]))
        return pa.table([T.fixed_binary(keys[out // m], 16), T.fixed_binary(keys[out % m], 16)], ["a", "b"])

    x = lists.groupBy("g", "key").agg(F.first("comp").alias("comp"), F.collect_list("list").alias("lists"))
    full = x.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("split")).where("split > 1")  # at most members / TILE rows
    x = x.join(F.broadcast(full), "g", "left").withColumn("split", F.coalesce("split", F.lit(1)))
    x = x.withColumn("tile", F.pmod(F.xxhash64("key"), F.col("split")).cast("int")).join(points, "key")
    x = x.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    x = x.select("g", F.least("tile", "z").alias("i"), F.greatest("tile", "z").alias("j"), "tile", "key", "n", "comp", "lists", "vector")
    return _ordered(x.groupBy("g", "i", "j").applyInArrow(meet, "a binary, b binary"))


# ---------------------------------------------------------------- verification and components

def verify(pairs: DataFrame, family: DataFrame, share: int) -> DataFrame:
    """The pairs whose token sets reach the similarity: (a, b, inter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep, inter = [], []
            for i, (x, y) in enumerate(zip(t.column("ta").to_pylist(), t.column("tb").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                n = int((y[at] == x).sum())
                if 100 * n >= share * (len(x) + len(y) - n):
                    keep.append(i)
                    inter.append(n)
            if keep:
                yield pa.RecordBatch.from_arrays([t.column("a").take(pa.array(keep)), t.column("b").take(pa.array(keep)), pa.array(inter, pa.int64())], ["a", "b", "inter"])

    s = family.select("key", "tokens")
    x = pairs.join(s.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a")
    x = x.join(s.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
    return x.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, inter long")


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) of every node of `edges` (a, b): comp is the smallest key reachable. Alternating large and small
    stars; each round is a shuffle of at most the edges and ends in a written table. The edges are settled when a round
    leaves their number and a 128-bit sum of their hashes as they were."""
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(s), "u", "v").cast("decimal(20,0)")) for s in (1, 2)]).first()

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now = state(e)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        x = large.join(m, "u")
        small = x.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        was, e, now = now, new, state(new)
        if now == was:
            break
    top = e.select("u", F.col("v").alias("comp"))
    return top.select(F.col("u").alias("key"), "comp").union(top.select(F.col("comp").alias("key"), "comp")).distinct()


# ---------------------------------------------------------------- the operator

def _token_rows(docs: DataFrame, k: int, words) -> DataFrame:
    """key, h, n, tokens of the documents whose id is in the Bloom filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(Bloom.hits(words.value, batch.column("_id").to_numpy())))
            for part in T.slices(batch):
                tokens, offs = T.shingle_sets(part.column("text"), k)
                keys = T.set_keys(tokens, offs)
                n = np.diff(offs).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [T.fixed_binary(keys, 16), pa.array(keys[:, 0].copy().view(np.int64)), pa.array(n), T.pieces(tokens, offs)], ["key", "h", "n", "tokens"])

    x = docs.select(F.col("text").cast("string").alias("text"), row_hash(docs).alias("_id"))
    return x.mapInArrow(run, "key binary, h long, n long, tokens binary")


def _probe_requests(docs: DataFrame, k: int, probe: float, buckets: int) -> DataFrame:
    limit = _U(int(probe * (1 << T.TOKEN_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Requests(buckets)
        for batch in batches:
            for part in T.slices(batch):
                tokens, offs = T.shingle_sets(part.column("text"), k)
                low = tokens < limit
                lens = np.diff(np.concatenate(([0], np.cumsum(low)))[offs])
                out.add(tokens[low], T.set_keys(tokens, offs), lens)
                if out.size >= FLUSH:
                    yield out.flush()
        if out.size:
            yield out.flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, REQUEST)


def _set_requests(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Requests(buckets)
        for t in batches:
            for key, x in zip(t.column("key").to_pylist(), t.column("tokens").to_pylist()):
                x = np.frombuffer(x, np.uint64)
                out.add(x, np.frombuffer(key, np.uint64).reshape(1, 2), np.array([len(x)]))
                if out.size >= FLUSH:
                    yield out.flush()
        if out.size:
            yield out.flush()

    return rows.select("key", "tokens").mapInArrow(run, REQUEST)


def _kept(rows: DataFrame, counts: DataFrame, sent: str, share: int) -> DataFrame:
    """Sets that have at most (100 - share) % of their tokens for themselves, as far as tokens were sent."""
    ref = F.greatest(_ref("h"), F.lit(1)).alias("ref")
    x = rows.withColumn("ref", ref).join(counts, "ref", "left")
    return x.where(100 * (F.col(sent) - F.coalesce("shared", F.lit(0))) <= (100 - share) * F.col("n")).drop("ref", "shared")


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 75) -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard similarity of share/100 or more.

    Input: doc_id, text; other columns are ignored. Output per input row: doc_id, n_shingles (long), component_id
    (smallest doc_id reachable by links, itself included), links are exact. Null or empty text and text of white space
    has the empty set: n_shingles 0, component_id its own doc_id. Rows of equal sets are linked, repeated rows and
    repeated ids included; a null doc_id never is the smallest unless its component has no other. An empty table gives
    an empty result.
    """
    x = _labelled(docs, k, share)
    return x.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"))


def _labelled(docs: DataFrame, k: int, share: int) -> DataFrame:
    """doc_id, row, n and best of every row: absent, doc_id and row of the first row of its component, ids before nulls;
    null for the empty set."""
    spark = docs.sparkSession
    all_sets = written(sets(docs, k, PROBE), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("least")
    classes = written(all_sets.where("n > 0").groupBy("key").agg(least, F.count(F.lit(1)).alias("rows"), F.first("h").alias("h"), F.first("n").alias("n"),
                                                                F.first("n_probe").alias("n_probe")), "classes")
    # 1: sets that share enough of the probed part of the token space
    buckets = max(1, -(-text_bytes(docs) // BUCKET_BYTES))
    first = written(_kept(classes, shared_counts(_probe_requests(docs, k, PROBE, buckets), buckets), "n_probe", share), "left")
    words = Bloom(first.select(F.col("least.row").alias("h")), "h").shared(spark)
    rows = _token_rows(docs, k, words).join(first.select("key"), "key", "left_semi")
    rows = written(rows.groupBy("key").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "tokens")
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    buckets = max(1, -(-total // BUCKET_TOKENS))
    family = written(_kept(rows, shared_counts(_set_requests(rows, buckets), buckets), "n", share), "family")
    # 2 and 3: R-trees over posting lists, verification, components
    levels = spark.sparkContext.broadcast(token_levels(family, total))
    points = written(set_points(family), "points")
    met = written(postings(family, share, buckets, levels), "postings")
    pairs = bounded(_ordered(met.where("list is null").select("a", "b")), points, share)
    edges = written(verify(pairs, family, share), "links").select("a", "b")
    labels, lists = components(edges), _members(met.where("list is not null"))
    for mode in ("nearest", "all"):
        lists = written(mixed_lists(lists, family, labels), "lists")
        found = written(verify(propose(lists, points, mode, share), family, share), "links").select("a", "b")
        if not found.limit(1).count():
            continue
        edges = edges.union(found)
        labels = components(edges)
    best = labels.join(classes.select("key", "least"), "key").groupBy("comp").agg(F.min("least").alias("best"))
    of_set = labels.join(best, "comp").select("key", "best")
    own = classes.select("key", "least", "rows").join(of_set, "key", "left").select("key", "rows", F.coalesce("best", "least").alias("best"))
    return spread_join(all_sets, own, ["key"], "rows", all_sets.count(), "left").select("doc_id", "row", "n", "best")


def one_of_each(docs: DataFrame, k: int = 5, share: int = 75) -> DataFrame:
    """Documents without near duplicates: of every component one row stays, the one with the smallest doc_id, rows without
    an id last, rows of one id by a hash of all their columns. Rows with an empty set all stay. Columns as given. Rows are
    told apart by id and hash, so unlinked texts under one id, or without one, stay; rows that are equal in every column
    are copies. Only rows that a bounded Bloom filter suspects to go are shuffled."""
    spark = docs.sparkSession
    found = settled(spark, lambda: _labelled(docs, k, share), "components").where("best is not null")
    first = F.col("best.row") == F.col("row")
    rows = found.groupBy("row").agg(F.max(first).alias("stays"), F.count(F.lit(1)).alias("_n"))
    suspects = rows.where(~F.col("stays") | (F.col("_n") > 1))
    words, total = Bloom(suspects.withColumnRenamed("row", "h"), "h").shared(spark), found.count()

    @F.pandas_udf("boolean")
    def suspected(h: pd.Series) -> pd.Series:
        return pd.Series(Bloom.hits(words.value, h.to_numpy()))

    mark, row = "_near_duplicate_suspect", "_near_duplicate_row"
    x = docs.withColumn(row, row_hash(docs)).withColumn(mark, suspected(row))
    sure = x.where(~F.col(mark)).select(*docs.columns)
    # equal rows are one before anything is shuffled by their hash; rows of the empty set are no suspects
    one = spread_join(x.where(mark).drop(mark), suspects.withColumnRenamed("row", row), [row], "_n", total, "left").where(F.coalesce("stays", F.lit(True)))
    again = one.where("stays").dropDuplicates([row]).select(*docs.columns)
    return sure.union(one.where("stays is null").select(*docs.columns)).union(again)
