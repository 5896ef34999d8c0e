"""Bands of a block, found in the task that holds its spectra.

One Arrow pass per block goes from samples to rows of bands: runs of active bins, the levels that decide which neighbours
are one signal, and the sums that the published bounds and scores are made of. Rows of a few numbers leave the task; no
spectrum does, and nothing is shuffled after the blocks are made. What is published is computed from these rows by the
column expressions of `regions`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.expr import EPS
from ..session import bound_batches
from . import regions as R, spectra as S

BAND_SCHEMA = ("capture_id long, block_id long, lft long, rgt long, n_samples long, floor double, fa int, fb int, n_parts int, "
               "part_bins int, f0 long, f1 long, p90 double, occupancy double, n_bins long, excess double, core_first int, core_last int, "
               "used_cells long, sum_normal double, square_normal double")
SWEEP_SCHEMA = "margin_db double, capture_id long, block_id long, fa int, fb int, active_frames long, hit_cells long"

Band = tuple[int, int]


def _db(x: float) -> float:
    return 10 * np.log10(max(x, EPS))


def active_bands(hit: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(fa, fb, active frames, hit cells) of the qualified bands of an opened mask [frames, bins]."""
    on = np.flatnonzero(hit.any(axis=0))
    out = []
    for run in np.split(on, np.flatnonzero(np.diff(on) > R.MAX_GAP_BINS + 1) + 1) if len(on) else []:
        fa, fb = int(run[0]), int(run[-1]) + 1
        cut = hit[:, fa:fb]
        frames, cells = int(cut.any(axis=1).sum()), int(cut.sum())
        if fb - fa >= R.MIN_BINS and frames >= R.MIN_FRAMES and cells >= R.MIN_CELLS:
            out.append((fa, fb, frames, cells))
    return out


def _filled(left: Band, right: Band, power: np.ndarray, owned: np.ndarray) -> bool:
    """Whether the gap between two bands is well above the noise around them and not far below them."""
    span, nb = right[1] - left[0], power.shape[1]
    mean = power.mean(axis=0)
    b = np.arange(max(0, left[0] - 3 * span), min(nb, right[1] + 3 * span))
    near = b[((b < max(0, left[0] - span)) | (b >= min(nb, right[1] + span))) & ~owned[b]]
    if len(near) < 4 or right[0] <= left[1]:
        return False
    gap, noise = mean[left[1]:right[0]].mean(), np.median(mean[near])
    low = min(mean[left[0]:left[1]].mean(), mean[right[0]:right[1]].mean())
    return _db(gap) - _db(noise) >= R.GAP_EXCESS_DB and _db(low) - _db(gap) <= R.VALLEY_DB


def joined(bands: list[Band], power: np.ndarray, smooth: np.ndarray, hit: np.ndarray) -> list[bool]:
    """For every band but the last, whether it and its right neighbour are one signal: the rule of `regions.joinable`."""
    on = [hit[:, fa:fb].any(axis=1) for fa, fb in bands]
    peak = [_db(float(smooth[o, fa:fb].max())) for o, (fa, fb) in zip(on, bands)]
    owned = np.zeros(power.shape[1], bool)
    for fa, fb in bands:
        owned[fa:fb] = True
    out = []
    for i, (left, right) in enumerate(zip(bands, bands[1:])):
        j, gap = i + 1, right[0] - left[1]
        if (on[i] & on[j]).sum() < R.CO_TIMED * min(on[i].sum(), on[j].sum()):
            out.append(False)
            continue
        weak, behind, strong = (j, j + 1, left) if peak[i] >= peak[j] else (i, i - 1, right)
        join = gap <= R.FRAGMENT_GAP_OF_WIDTH * max(left[1] - left[0], right[1] - right[0])
        if not join and abs(peak[i] - peak[j]) >= R.SIDELOBE_DB and gap <= R.SIDELOBE_GAP_OF_WIDTH * (strong[1] - strong[0]):
            other = bands[behind] if 0 <= behind < len(bands) else None
            join = other is None or not (peak[behind] - peak[weak] >= R.SIDELOBE_DB and min(
                abs(other[0] - bands[weak][1]), abs(bands[weak][0] - other[1])) <= other[1] - other[0])
        out.append(bool(join or _filled(left, right, power[on[i] | on[j]], owned)))
    return out


def evidence(parts: list[Band], b: S.BlockSpectra, hit: np.ndarray) -> dict:
    """What the bounds and scores of one band of `parts` are made of."""
    fa, fb = parts[0][0], parts[-1][1]
    used = np.concatenate([np.arange(x, y) for x, y in parts])
    rows = np.flatnonzero(hit[:, used].any(axis=1))
    power = b.power[rows, fa:fb]
    e = np.maximum(power.mean(axis=0) - b.floor, 0.0)
    share = np.cumsum(e) / e.sum() if e.sum() > 0 else np.zeros(len(e))
    tail = (1 - R.OCCUPIED_FRACTION) / 2
    first, last = np.flatnonzero(share > tail), np.flatnonzero(share >= 1 - tail)
    own = b.power[np.ix_(rows, used)]
    m = np.maximum(own.mean(axis=0), EPS)
    return {"fa": fa, "fb": fb, "n_parts": len(parts), "part_bins": len(used), "f0": b.first_frame + int(rows[0]), "f1": b.first_frame + int(rows[-1]),
            "p90": float(np.percentile(b.smooth[np.ix_(rows, used)], 90)), "occupancy": float(hit[np.ix_(rows, used)].mean()), "n_bins": fb - fa,
            "excess": float(e.sum()), "core_first": fa + int(first[0]) if len(first) else None, "core_last": fa + int(last[0]) if len(last) else None,
            "used_cells": own.size, "sum_normal": float((own.sum(axis=0) / m).sum()), "square_normal": float(((own * own).sum(axis=0) / (m * m)).sum())}


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(df_schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in df_schema.split(", "))])


def band_rows(blocks: DataFrame, rate: float, nperseg: int, hop: int, margin_db: float = 8.0, fixed_db: float | None = None,
              real: bool = False, merge: bool = True) -> DataFrame:
    """One row per band of every block, `BAND_SCHEMA`. A block under one frame has one row without a band; one without a
    band has none."""
    S.check_margin(margin_db, fixed_db)
    bound_batches(blocks.sparkSession)
    schema = _arrow(BAND_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.block_spectra(batches, rate, nperseg, hop, real):
            own = {"capture_id": b.capture_id, "block_id": b.block_id, "lft": b.lft, "rgt": b.lft + b.n_samples, "n_samples": b.n_samples, "floor": b.floor}
            if b.power is None:
                yield _rows([own], schema)
                continue
            hit = S._open2x2(b.above(margin_db, fixed_db))
            bands = [x[:2] for x in active_bands(hit)]
            if not bands:
                continue
            joins = joined(bands, b.power, b.smooth, hit) if merge else [False] * (len(bands) - 1)
            groups = [[bands[0]]]
            for band, join in zip(bands[1:], joins):
                groups[-1].append(band) if join else groups.append([band])
            yield _rows([own | evidence(parts, b, hit) for parts in groups], schema)

    return blocks.select(*S.BLOCK_COLUMNS).mapInArrow(run, BAND_SCHEMA)


def detect(blocks: DataFrame, rate: float, nperseg: int, hop: int, margin_db: float = 8.0, fixed_db: float | None = None, real: bool = False,
           merge: bool = True) -> DataFrame:
    """Detections per (capture, block) straight from sample blocks: bounds, time extent, evidence and a status. A block
    under one frame comes out with the reason instead of a band."""
    x = band_rows(blocks, rate, nperseg, hop, margin_db, fixed_db, real, merge)
    x = x.select("*", F.col("core_last").alias("_b1"), F.col("core_first").alias("_b0"), (F.col("fb") - 1).alias("_last"), F.col("p90").alias("_p90"),
                 F.col("occupancy").alias("_occ"), F.col("f0").alias("_f0"), F.col("f1").alias("_f1"), F.col("used_cells").alias("_n"),
                 F.col("sum_normal").alias("_sn"), F.col("square_normal").alias("_qn")).drop("occupancy")
    status = F.when(F.col("fa").isNull(), F.format_string(f"fewer than {nperseg} samples (%s)", "n_samples")).otherwise(F.lit("ok"))
    return R.published(x, rate, nperseg, hop, margin_db, fixed_db, real, {"status": status})


def margin_sweep(blocks: DataFrame, rate: float, nperseg: int, hop: int, margins: list[float], real: bool = False) -> DataFrame:
    """Bands of every margin from the one smoothed spectrum of a block."""
    bound_batches(blocks.sparkSession)
    schema = _arrow(SWEEP_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.block_spectra(batches, rate, nperseg, hop, real):
            if b.power is not None:
                rows = [dict(zip(schema.names, (float(m), b.capture_id, b.block_id, *band)))
                        for m in margins for band in active_bands(S._open2x2(b.above(m)))]
                yield _rows(rows, schema)

    return blocks.select(*S.BLOCK_COLUMNS).mapInArrow(run, SWEEP_SCHEMA)
