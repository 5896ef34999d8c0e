"""Detections of consecutive blocks become tracks; long tracks are read through a few spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written
from .partitioning import WHOLE, by_size, interval_groups, prefix_sums

MIXED_METHOD = "mixed across blocks (union of per-block bounds)"
SAMPLED_SPANS = 8


def candidate_links(det: DataFrame, bin_hz: float) -> DataFrame:
    """Detections of adjacent blocks whose overlap reaches half of the narrower band.

    Equi-join on (capture, block, frequency bin); a pair is kept only in the first bin it shares. Bands of one
    block do not overlap each other, so pairs grow linearly with detections.
    """
    def bins(lo, hi):
        return F.sequence(F.floor(F.col(lo) / bin_hz), F.floor(F.col(hi) / bin_hz))
    cur = det.withColumn("_bin", F.explode(bins("lo", "hi")))
    prev = det.select("capture_id", (F.col("block") + 1).alias("block"), F.col("det").alias("prev_det"),
                      F.col("excess").alias("prev_excess"), F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    prev = prev.withColumn("_bin", F.explode(bins("plo", "phi")))
    j = cur.join(prev, ["capture_id", "block", "_bin"])
    first = F.floor(F.greatest("lo", "plo") / bin_hz)
    overlap = F.least("hi", "phi") - F.greatest("lo", "plo")
    narrow = F.least(F.col("hi") - F.col("lo"), F.col("phi") - F.col("plo"))
    return j.where((F.col("_bin") == first) & (overlap >= 0.5 * narrow)).withColumn("overlap_hz", overlap).drop("_bin")


ORDER = ["lo", "hi", "det", "excess"]


class Walk:
    """Track state of one capture while its detections arrive in block order.

    The first open track, by number, last seen in the previous block and overlapping half the narrower band
    takes the detection, once per block; its band then grows. `tracks` maps number -> [lo, hi, last block].
    """

    def __init__(self, tracks=None, block=None, next_id=0, used=()):
        self.tracks, self.block, self.next_id, self.used = dict(tracks or {}), block, next_id, set(used)

    def take(self, block: int, lo: float, hi: float) -> int:
        if block != self.block:
            self.tracks = {t: b for t, b in self.tracks.items() if b[2] >= block - 1}
            self.block, self.used = block, set()
        for t, (tl, th, seen) in self.tracks.items():
            if seen == block - 1 and t not in self.used and min(th, hi) - max(tl, lo) >= 0.5 * min(th - tl, hi - lo):
                self.tracks[t] = [min(tl, lo), max(th, hi), block]
                break
        else:
            t, self.next_id = self.next_id, self.next_id + 1
            self.tracks[t] = [lo, hi, block]
        self.used.add(t)
        return t


#: blocks whose detections are numbered in one task, width of the frequency buckets of the groups
NUMBER_BLOCKS, GROUP_HZ = 1024, 65_536.0


def track_pieces(det: DataFrame, group_hz: float = GROUP_HZ) -> DataFrame:
    """det with `_segment` and `_group`: what cannot share a track is in different pieces.

    A segment ends where a block of the capture has no detection: no track outlives that. In a segment, detections whose
    bands meet, directly or through others, are one group: a track's band never leaves the union of its group.
    """
    keys = ["capture_id"]
    blocks = det.select("capture_id", "block").distinct()
    before = blocks.select("capture_id", (F.col("block") + 1).alias("block"), F.lit(0).cast("long").alias("_follows"))
    starts = blocks.join(before, ["capture_id", "block"], "left").withColumn("_bucket", F.floor(F.col("block") / NUMBER_BLOCKS))
    segments = prefix_sums(starts, keys, "_bucket", ["block"], _segment=F.coalesce("_follows", F.lit(1).cast("long")))
    x = det.join(segments.select("capture_id", "block", "_segment"), ["capture_id", "block"])
    groups = interval_groups(x, [*keys, "_segment"], "lo", "hi", block=group_hz)
    groups = groups.select("capture_id", "_segment", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_g").alias("_group"))
    return x.join(groups, ["capture_id", "_segment", "lo", "hi"])


def _walked(det: DataFrame, piece: list[str]) -> DataFrame:
    """det with `_local`, the number of its track in its piece, and whether it is the track's first detection; a piece is
    walked in one task with its few open tracks as state."""
    placed = det.repartition(*piece).sortWithinPartitions(*piece, "block", *ORDER)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, walk = None, Walk()
        for pdf in batches:
            number, first = [], []
            for key, block, lo, hi in zip(zip(*(pdf[c] for c in piece)), pdf.block, pdf.lo, pdf.hi):
                if key != at:
                    at, walk = key, Walk()
                known = walk.next_id
                number.append(walk.take(block, lo, hi))
                first.append(walk.next_id > known)
            yield pdf.assign(_local=number, _first=first)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    return placed.mapInPandas(fold, f"{schema}, _local long, _first boolean")


def associate_tracks(det: DataFrame, group_hz: float = GROUP_HZ, whole: int = WHOLE) -> DataFrame:
    """Number tracks across blocks, in block order.

    A capture of at most `whole` detections is walked by one task. A larger one is walked in pieces (`track_pieces`), and a
    track gets its number from the place of its first detection among all first detections of the capture, by prefix sums
    over blocks; so a capture of any size is spread over all tasks, and only detections that keep meeting each other in
    frequency and time share one. Samples never come here. A detection without a capture, block or band is left out.
    """
    det = det.where("capture_id IS NOT NULL AND block IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL")
    small, large = by_size(det, ["capture_id"], whole)
    out = _walked(small, ["capture_id"]).select(*det.columns, F.col("_local").alias("track"))
    if large is None:
        return out
    piece = ["capture_id", "_segment", "_group"]
    walked = written(_walked(track_pieces(large, group_hz), piece))
    first = walked.where("_first").withColumn("_bucket", F.floor(F.col("block") / NUMBER_BLOCKS))
    first = prefix_sums(first, ["capture_id"], "_bucket", ["block", *ORDER, *piece[1:]], track=F.lit(1).cast("long"))
    first = first.select(*piece, "_local", (F.col("track") - 1).alias("track"))
    return out.unionByName(walked.join(first, [*piece, "_local"]).select(*det.columns, "track"))


def fold_tracks(det: DataFrame) -> DataFrame:
    """One row per track: widest band and span, least confidence, any review or pulse flag; where the detections have
    them, also the widest threshold extent and the least evidence-based confidence."""
    more = {"extent_lo": F.min, "extent_hi": F.max, "conf_evidence": F.min}
    return det.groupBy("capture_id", "track").agg(
        F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("conf").alias("confidence"),
        F.bool_or("needs_review").alias("needs_review"), F.bool_or("is_pulsed").alias("is_pulsed"),
        F.min("block").alias("block_first"), F.max("block").alias("block_last"),
        F.when(F.min("method") != F.max("method"), F.lit(MIXED_METHOD)).otherwise(F.min("method")).alias("bounds_method"),
        *[f(c).alias(c) for c, f in more.items() if c in det.columns])


def track_envelope_pool(env: DataFrame, keys: list[str], row: Column, value: str) -> DataFrame:
    return env.withColumn("row", row).groupBy(*keys, "row").agg(F.max(value).alias("value"),
                                                               F.max("threshold").alias("threshold"))


def sampled_spans(tracks: DataFrame, keys: list[str], budget: int, count: int = SAMPLED_SPANS) -> DataFrame:
    """`count` spans of budget/count samples, evenly spaced over the track."""
    span = F.col("end_sample") - F.col("start_sample")
    length = F.least(span, F.lit(budget // count))
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")
    x = tracks.select(*keys, "start_sample", span.alias("span"), length.alias("len"), k)
    a = F.col("start_sample") + F.rint(F.col("k") * (F.col("span") - F.col("len")) / max(count - 1, 1)).cast("long")
    return x.select(*keys, a.alias("start_sample"), (a + F.col("len")).alias("end_sample")).distinct()


def sampled_pulse_spans(tracks: DataFrame, windows: DataFrame, keys: list[str], budget: int,
                        count: int = SAMPLED_SPANS) -> DataFrame:
    """One span at each of `count` pulse windows picked evenly by index (at most 200,000 windows per track)."""
    w = W.partitionBy(*keys).orderBy("start_sample", "end_sample")
    x = windows.select(*keys, F.col("start_sample").alias("_ws"), (F.row_number().over(w) - 1).alias("_i"),
                       F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("_n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)),
                        lambda k: F.rint(k * (F.col("_n") - 1) / max(count - 1, 1)).cast("long"))
    x = x.where(F.array_contains(picks, F.col("_i").cast("long"))).join(tracks, keys)
    length = F.least(F.col("end_sample") - F.col("start_sample"), F.lit(budget // count))
    a = F.least(F.greatest(F.col("start_sample"), F.col("_ws")), F.col("end_sample") - length)
    return x.select(*keys, a.alias("start_sample"), (a + length).alias("end_sample")).distinct()


def translate_windows(windows: Column, a: Column, b: Column) -> Column:
    """Windows in span-local coordinates, cut to the span; those outside vanish."""
    cut = lambda v: F.greatest(F.lit(0).cast("long"), F.least(b - a, v - a))
    moved = F.transform(windows, lambda w: F.struct(cut(w["start_sample"]).alias("start_sample"),
                                                    cut(w["end_sample"]).alias("end_sample")))
    return F.filter(moved, lambda w: w["end_sample"] > w["start_sample"])


# fixed text of a track without an agreed label
DISAGREE = "not reliably estimated (sampled spans disagree: %s)"
TOO_FEW = "not reliably estimated (a label on %s of %s sampled spans, fewer than half)"


def _middle(values: Column) -> Column:
    """Median of an array, its NULLs left out; of an even number the mean of the two in the middle."""
    v = F.sort_array(F.array_compact(values))
    at = lambda k: F.get(v, F.floor(k).cast("int"))
    return 0.5 * at((F.size(v) - 1) / 2) + 0.5 * at(F.size(v) / 2)


def combine_spans(spans: DataFrame) -> DataFrame:
    """Medians over the spans of a track of a capture; a label only when unanimous on at least half of them.

    Spans that could not be analysed (`ok` false) count for the half, but for nothing else; a track without any other has
    NULLs. `status` says why there is no label. `rep_idx` is the agreeing span nearest to the middle of the analysed ones.
    A track has a few spans (`SAMPLED_SPANS`): they are brought together once, as one row, and looked at there.
    """
    keys = ["capture_id", "track"]
    ok = F.coalesce("ok", F.lit(False))
    span = F.struct("idx", "label", "cf", "bw3", "bw99", "snr", F.when(F.col("label").isNotNull(), F.col("rate")).alias("rate"))
    a = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(ok).alias("n_ok"),
                                 F.array_sort(F.collect_list(F.when(ok, span))).alias("_s"))
    a = a.select("*", *[_middle(F.col(f"_s.{c}")).alias(f"_{c}") for c in ("cf", "bw3", "bw99", "snr", "rate")],
                 F.array_compact("_s.label").alias("_l"), F.array_compact("_s.rate").alias("_r"))
    a = a.withColumns({"_labels": F.array_sort(F.array_distinct("_l")), "_nl": F.size("_l")})
    one = (F.size("_labels") == 1) & (2 * F.col("_nl") >= F.col("n_spans"))
    a = a.withColumn("modulation_label", F.when(one, F.col("_labels")[0]))
    why = F.when(F.size("_labels") > 1, F.format_string(DISAGREE, F.array_join("_labels", ", "))).otherwise(F.format_string(TOO_FEW, "_nl", "n_spans"))
    worst = F.greatest(F.col("_rate") - F.array_min("_r"), F.array_max("_r") - F.col("_rate"))
    same = F.col("modulation_label").isNotNull() & (F.size("_r") == F.col("_nl")) & (worst <= 0.05 * F.col("_rate"))
    rep = F.array_min(F.transform("_s", lambda s, at: F.when(
        F.col("modulation_label").isNull() | (s["label"] == F.col("modulation_label")),
        F.struct(F.abs(at - (F.col("n_ok") - 1) / 2).alias("o"), s["idx"].alias("i")))))
    return a.select(
        *keys, "n_spans", (F.col("n_spans") - F.col("n_ok")).alias("n_failed"), F.col("_cf").alias("center_frequency_hz"),
        F.col("_bw3").alias("bandwidth_3db_hz"), F.col("_bw99").alias("bandwidth_99pct_hz"), F.col("_snr").alias("snr_db"), "modulation_label",
        F.when(same, F.col("_rate")).alias("symbol_rate_hz"), rep["i"].alias("rep_idx"),
        F.when(F.col("modulation_label").isNull() & (F.col("n_ok") > 0), why).alias("status"))
