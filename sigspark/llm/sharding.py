"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard has `VNODES` points on a ring of `CELLS` cells; a document hashes to a cell and belongs to the next point
clockwise. A shard takes at most its quota (row counts at most one apart over all shards). Documents of an arc whose shard
is full continue clockwise to the next shard with room, so balance is exact and only the overflow leaves its home.

The walk is over arcs, not documents: the rows of each arc are counted, and in round r every arc offers what it has left
to the r-th distinct shard clockwise, in ring order. That gives a table of (arc, rank range) -> shard of at most
shards x (shards x VNODES) rows, the only thing broadcast. Documents find their place by their rank in the arc.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, functions as F

from .common import ranked

CELLS = 1 << 16
VNODES = 128


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int]]:
    """Arcs (first cell, last cell, shard) that cover all cells; the point of an arc is its last cell."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            p = zlib.crc32(f"shard {s} point {v}".encode()) % cells
            while p in at:
                p = (p + 1) % cells
            at[p] = s
    points = sorted(at)
    arcs = [(a + 1, b, at[b]) for a, b in zip(points, points[1:])]
    # the arc of the first point starts behind the last one and wraps around
    arcs.append((points[-1] + 1, cells - 1, at[points[0]]))
    arcs.append((0, points[0], at[points[0]]))
    return [a for a in arcs if a[0] <= a[1]]


def _clockwise(arcs: list[tuple[int, int, int]]) -> list[list[int]]:
    """Distinct shards in the order that each arc meets them."""
    order = sorted(range(len(arcs)), key=lambda i: arcs[i][0])
    out: list[list[int]] = [[] for _ in arcs]
    for n, i in enumerate(order):
        seen: dict[int, None] = {arcs[i][2]: None}
        for k in range(1, len(order)):
            seen.setdefault(arcs[order[(n + k) % len(order)]][2])
        out[i] = list(seen)
    return out


def place(counts: dict[int, int], arcs: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, slot of the first) for the rows counted per arc."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, taken, out = [0] * shards, dict.fromkeys(counts, 0), []
    ways = _clockwise(arcs)
    for r in range(shards):
        for a in sorted(counts):
            if taken[a] < counts[a] and r < len(ways[a]):
                s = ways[a][r]
                n = min(counts[a] - taken[a], room[s] - used[s])
                if n > 0:
                    out.append((a, taken[a], taken[a] + n, s, used[s]))
                    taken[a] += n
                    used[s] += n
    return out


def _literal(spark, rows: list[tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ",".join(c.replace(" ", ":") for c in schema.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def shard(docs: DataFrame, shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """Shard and slot of every row.

    Input: doc_id, text; other columns are ignored. Output per input row: doc_id, size (UTF-8 bytes plus 1), text_crc32,
    home (shard of its ring position), shard, slot (gapless from 0 in each shard). Equal texts share a ring position, so
    copies lie together as far as a shard has room; a group larger than that continues clockwise. Null text has no bytes:
    size 1, checksum 0, the position of empty text. Rows of equal text are ordered by a hash of doc_id; equal rows are
    interchangeable, a null doc_id is an id like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"),
                    F.xxhash64(t).alias("_t"))
    arcs = ring(shards, vnodes)
    cells = _literal(spark, [(i, *a) for i, a in enumerate(arcs)], "arc int, lo int, hi int, home int")
    cells = cells.select("arc", "home", F.explode(F.sequence("lo", "hi")).alias("_cell"))
    x = x.withColumn("_cell", F.pmod(F.col("_t"), F.lit(CELLS)).cast("int"))
    x = x.join(F.broadcast(cells), "_cell").drop("_cell")  # CELLS rows whatever the input
    x = x.withColumn("_o", F.xxhash64(F.lit("slot"), "doc_id"))
    # copies of one text are split by id, other texts by their own hash
    part = (F.shiftrightunsigned("_t", 58) * 16 + F.shiftrightunsigned("_o", 60)).cast("int")
    counts = {r["arc"]: r["n"] for r in x.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per arc
    y = ranked(x, ["arc"], part, ["_t", "_o", "doc_id"])
    went = _literal(spark, place(counts, arcs, shards), "arc int, a long, b long, shard int, slot long").withColumnRenamed("arc", "_arc")
    y = y.join(F.broadcast(went), (F.col("arc") == F.col("_arc")) & (F.col("_rank") >= F.col("a")) & (F.col("_rank") < F.col("b")))
    return y.select("doc_id", "size", "text_crc32", "home", "shard", (F.col("slot") + F.col("_rank") - F.col("a")).cast("long").alias("slot"))
