"""From threshold hits to frequency bands, published bounds, time extents and evidence scores.

Everything is keyed by (capture, block); a block bounds the group size, and a few percent of its cells are hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import EPS, clip, db
from ..session import written
from .partitioning import runs

KEYS = ["capture_id", "block_id"]
BAND = [*KEYS, "fa", "fb"]

# fixed values
MAX_GAP_BINS = 2
MIN_BINS, MIN_FRAMES, MIN_CELLS = 2, 3, 12
REVIEW_BELOW = 0.70
FRAGMENT_GAP_OF_WIDTH = 0.25
SIDELOBE_GAP_OF_WIDTH = 1.0
SIDELOBE_DB = 6.0
CO_TIMED = 0.8
GAP_EXCESS_DB = 1.5
VALLEY_DB = 10.0
OCCUPIED_FRACTION = 0.95
OCCUPIED_GUARD = 1.6
MIN_REFINE_BINS = 4
EXTENT_METHOD = "threshold extent"
OCCUPIED_METHOD = "occupied 95% of power above the noise floor"


def threshold_mask(cell: DataFrame, floor: Column, margin_db: Column | float = 8.0,
                   fixed_db: float | None = None) -> DataFrame:
    line = F.lit(fixed_db) if fixed_db is not None else db(floor) + margin_db
    return cell.withColumn("threshold_db", line).withColumn("above", db(F.col("smooth")) > F.col("threshold_db"))


def hit_frames(frames: DataFrame) -> DataFrame:
    """Frames with at least one hit, written once.

    Band search, band statistics, gap levels and final evidence each read only the bin arrays they need from
    this table, so samples are read and transformed once and no whole spectrum is shuffled.
    """
    return written(frames.where(F.exists("hit", lambda h: h)).drop("above"))


def hit_cells(frames: DataFrame, array: str = "hit") -> DataFrame:
    """Sparse long form of the mask: only set cells leave the frame rows."""
    return (frames.where(F.exists(array, lambda h: h))
                  .select(*KEYS, "frame", F.posexplode(array).alias("bin", "h")).where("h").drop("h"))


def active_bins(hits: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per active bin the hit count and the frames; a block bounds the frame list."""
    return hits.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n_hit"), F.collect_list("frame").alias("frames"))


def bridge_gaps(active: DataFrame, keys: list[str] = KEYS, max_gap: int = MAX_GAP_BINS) -> DataFrame:
    """Runs of active bins with interior gaps of at most `max_gap` bins filled; bins per key are bounded."""
    return runs(active, keys, "bin", block=None, gap=max_gap) \
        .select(*keys, F.col("start").alias("fa"), F.col("end").alias("fb"))


def qualify_bands(active: DataFrame, keys: list[str] = KEYS, max_gap: int = MAX_GAP_BINS) -> DataFrame:
    """Bridged bands of at least 2 bins, 3 active frames and 12 hit cells.

    Active bins carry all that is needed, so bands come from one pass over them and the spectra are read once.
    """
    w = W.partitionBy(*keys).orderBy("bin")
    x = active.withColumn("_new", F.coalesce(F.col("bin") - F.lag("bin").over(w) > max_gap + 1, F.lit(True)).cast("int"))
    x = x.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    a = x.groupBy(*keys, "_g").agg(
        F.min("bin").alias("fa"), (F.max("bin") + 1).alias("fb"),
        F.size(F.array_distinct(F.flatten(F.collect_list("frames")))).cast("long").alias("active_frames"),
        F.sum("n_hit").alias("hit_cells")).drop("_g")
    return a.where((F.col("fb") - F.col("fa") >= MIN_BINS) & (F.col("active_frames") >= MIN_FRAMES)
                   & (F.col("hit_cells") >= MIN_CELLS))


def find_bands(frames: DataFrame) -> DataFrame:
    return qualify_bands(active_bins(hit_cells(frames)))


def as_parts(bands: DataFrame) -> DataFrame:
    """A band that was not merged is its own single part."""
    return bands.select(*BAND, F.array(F.struct("fa", "fb")).alias("parts"))


def band_frames(bands: DataFrame, frames: DataFrame) -> DataFrame:
    """Active frames of each band (capture, block, fa, fb, parts), with the band's slice of every bin array.

    `used` marks the bins that belong to a part; bridged bins between parts carry no evidence.
    """
    keep = [c for c in ("lft", "rgt", "core_start", "core_end", "floor") if c in frames.columns]
    use = F.transform(F.sequence(F.col("fa"), F.col("fb") - 1), lambda b: F.exists(
        "parts", lambda p: (b >= p["fa"]) & (b < p["fb"])))
    j = bands.select(*BAND, "parts", use.alias("used")).join(
        frames.select(*KEYS, "frame", *keep, "power", "smooth", "hit"), KEYS)

    def cut(c):
        return F.slice(c, F.col("fa") + 1, F.col("fb") - F.col("fa"))
    j = j.select(*BAND, "parts", "used", "frame", *keep, *[cut(c).alias(c) for c in ("power", "smooth", "hit")])
    return j.where(F.exists(F.zip_with("hit", "used", lambda h, u: h & u), lambda x: x))


def band_cells(on: DataFrame) -> DataFrame:
    keep = [c for c in ("lft", "rgt", "core_start", "core_end", "floor") if c in on.columns]
    z = on.select(*BAND, "parts", "frame", *keep,
                  F.posexplode(F.arrays_zip("power", "smooth", "hit", "used")).alias("p", "c"))
    return z.select(*BAND, "parts", "frame", *keep, (F.col("fa") + F.col("p")).alias("bin"),
                    *[F.col(f"c.{a}").alias(a) for a in ("power", "smooth", "hit", "used")])


def band_stats(on: DataFrame) -> DataFrame:
    """Active frame set and peak level of each band."""
    return on.groupBy(*BAND).agg(F.array_sort(F.collect_set("frame")).alias("frames"),
                                 db(F.max(F.array_max("smooth"))).alias("peak_db"))


def band_pairs(stats: DataFrame) -> DataFrame:
    """Each band with its right neighbour and the bands behind both: gap, shared frames, levels."""
    w = W.partitionBy(*KEYS).orderBy("fa")
    x = stats.select(*BAND, "frames", "peak_db",
                     *[F.lead(c).over(w).alias(f"{c}2") for c in ("fa", "fb", "frames", "peak_db")],
                     *[F.lag(c).over(w).alias(f"{c}0") for c in ("fa", "fb", "peak_db")],
                     *[F.lead(c, 2).over(w).alias(f"{c}3") for c in ("fa", "fb", "peak_db")])
    shared = F.size(F.array_intersect("frames", "frames2"))
    shorter = F.least(F.size("frames"), F.size("frames2"))
    x = x.where(F.col("fa2").isNotNull()).withColumn("gap", F.col("fa2") - F.col("fb"))
    return (x.withColumn("shared_frames", shared).withColumn("co_timed", shared >= CO_TIMED * shorter)
             .withColumn("either", F.array_union("frames", "frames2")))


def pair_levels(pairs: DataFrame, stats: DataFrame, frames: DataFrame, nbins: int) -> DataFrame:
    """Mean power of both bands, of their gap and of the local noise, while either band is active.

    Local noise is the median over non-band bins one to three pair-widths away of the bin's mean power.
    """
    span = F.col("fb2") - F.col("fa")
    lo, lo2 = F.greatest(F.lit(0), F.col("fa") - 3 * span), F.greatest(F.lit(0), F.col("fa") - span)
    hi1, hi = F.least(F.lit(nbins), F.col("fb2") + span), F.least(F.lit(nbins), F.col("fb2") + 3 * span)
    owned = stats.groupBy(*KEYS).agg(
        F.flatten(F.collect_list(F.sequence(F.col("fa"), F.col("fb") - 1))).alias("owned"))
    # only pairs that are active together and not plainly adjacent need their levels
    p = (pairs.where(F.col("co_timed") & (F.col("gap") > 0)).join(owned, KEYS)
              .select(*BAND, "fa2", "fb2", "owned", lo.alias("_lo"), lo2.alias("_lo2"), hi1.alias("_hi1"),
                      hi.alias("_hi"), F.explode("either").alias("frame")))
    x = p.join(frames.select(*KEYS, "frame", "power"), [*KEYS, "frame"]).select(
        *BAND, "fa2", "fb2", "owned", "_lo", "_lo2", "_hi1",
        F.posexplode(F.slice("power", F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))).alias("p", "power"))
    b = F.col("bin")
    x = (x.withColumn("bin", (F.col("_lo") + F.col("p")).cast("int"))
          .withColumn("near", ((b < F.col("_lo2")) | (b >= F.col("_hi1"))) & ~F.array_contains("owned", b)))
    per_bin = x.groupBy(*BAND, "fa2", "fb2", "bin", "near").agg(F.avg("power").alias("power"))
    return per_bin.groupBy(*BAND).agg(
        F.avg(F.when((b >= F.col("fa")) & (b < F.col("fb")), F.col("power"))).alias("left_power"),
        F.avg(F.when((b >= F.col("fa2")) & (b < F.col("fb2")), F.col("power"))).alias("right_power"),
        F.avg(F.when((b >= F.col("fb")) & (b < F.col("fa2")), F.col("power"))).alias("gap_power"),
        F.percentile(F.when(F.col("near"), F.col("power")), 0.5).alias("noise_power"),
        F.count_if("near").alias("noise_bins"))


def joinable(pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """Whether each neighbouring pair is one signal.

    The rules compare the two facing original bands, and the band behind the weaker one is always its direct
    neighbour; so no earlier join changes a later answer and all pairs are judged at once.
    """
    x = pairs.join(levels, BAND, "left")
    width, width2 = F.col("fb") - F.col("fa"), F.col("fb2") - F.col("fa2")
    left_strong = F.col("peak_db") >= F.col("peak_db2")
    pick = lambda a, b: F.when(left_strong, a).otherwise(b)
    near = F.col("gap") <= FRAGMENT_GAP_OF_WIDTH * F.greatest(width, width2)
    step = F.abs(F.col("peak_db") - F.col("peak_db2"))
    weak_fa, weak_fb = pick(F.col("fa2"), F.col("fa")), pick(F.col("fb2"), F.col("fb"))
    weak_peak = pick(F.col("peak_db2"), F.col("peak_db"))
    far_fa, far_fb = pick(F.col("fa3"), F.col("fa0")), pick(F.col("fb3"), F.col("fb0"))
    far_peak = pick(F.col("peak_db3"), F.col("peak_db0"))
    owned = F.coalesce((far_peak - weak_peak >= SIDELOBE_DB)
                       & (F.least(F.abs(far_fa - weak_fb), F.abs(weak_fa - far_fb)) <= far_fb - far_fa), F.lit(False))
    lobe = (step >= SIDELOBE_DB) & (F.col("gap") <= SIDELOBE_GAP_OF_WIDTH * pick(width, width2)) & ~owned
    filled = ((F.col("gap") > 0) & (F.coalesce("noise_bins", F.lit(0)) >= 4)
              & (db(F.col("gap_power")) - db(F.col("noise_power")) >= GAP_EXCESS_DB)
              & (db(F.least("left_power", "right_power")) - db(F.col("gap_power")) <= VALLEY_DB))
    rule = F.col("co_timed") & (near | lobe | F.coalesce(filled, F.lit(False)))
    return x.select(*BAND, "fa2", "fb2", "gap", "shared_frames", "co_timed", rule.alias("joins"))


def merge_fragments(stats: DataFrame, joins: DataFrame) -> DataFrame:
    """Chains of joinable neighbours become one band; `parts` keeps the original pieces."""
    w = W.partitionBy(*KEYS).orderBy("fa")
    x = stats.select(*BAND).join(joins.select(*BAND, "joins"), BAND, "left")
    x = x.withColumn("_new", (~F.coalesce(F.lag("joins").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*KEYS, "_g").agg(F.min("fa").alias("_fa"), F.max("fb").alias("_fb"),
                                      F.array_sort(F.collect_list(F.struct("fa", "fb"))).alias("parts")) \
        .select(*KEYS, F.col("_fa").alias("fa"), F.col("_fb").alias("fb"), "parts")


def merged_bands(frames: DataFrame, nbins: int) -> DataFrame:
    """Qualified bands with fragments joined, from frames placed by `hit_frames`."""
    stats = written(band_stats(band_frames(as_parts(find_bands(frames)), frames)))
    pairs = band_pairs(stats)
    return merge_fragments(stats, joinable(pairs, pair_levels(pairs, stats, frames, nbins)))


def refine_edges(mean_power: DataFrame, keys: list[str], floor: Column) -> DataFrame:
    """Bins between the 2.5% and 97.5% points of cumulative power above the floor; NULL under 4 bins or no excess."""
    x = mean_power.withColumn("_e", F.greatest(F.col("power") - floor, F.lit(0.0)))
    part = W.partitionBy(*keys)
    x = x.withColumn("_n", F.count(F.lit(1)).over(part)).withColumn("_t", F.sum("_e").over(part))
    cum = F.sum("_e").over(part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.nullif("_t", F.lit(0.0))
    tail = (1 - OCCUPIED_FRACTION) / 2
    x = x.withColumn("_c", cum)
    a = x.groupBy(*keys).agg(F.max("_n").alias("n_bins"), F.max("_t").alias("excess"),
                             F.min(F.when(F.col("_c") > tail, F.col("bin"))).alias("_b0"),
                             F.min(F.when(F.col("_c") >= 1 - tail, F.col("bin"))).alias("_b1"),
                             F.max("bin").alias("_last"))
    ok = (F.col("n_bins") >= MIN_REFINE_BINS) & (F.col("excess") > 0)
    b0 = F.least(F.coalesce("_b0", F.col("_last")), F.col("_last"))
    b1 = F.greatest(F.coalesce("_b1", F.col("_last")) + 1, b0 + 1)
    return a.select(*keys, "n_bins", "excess", F.when(ok, b0).alias("b0"), F.when(ok, b1).alias("b1"))


def publish_bounds(edges: DataFrame, freq, df_hz: float, rate: float, real: bool = False) -> DataFrame:
    """Widen the refined core by 1.6 about its centre, never past the threshold extent."""
    lo_lim = 0.0 if real else -rate / 2
    ext_lo = F.greatest(F.lit(lo_lim), freq(F.col("fa")) - df_hz / 2)
    ext_hi = F.least(F.lit(rate / 2), freq(F.col("fb") - 1) + df_hz / 2)
    c_lo, c_hi = freq(F.col("b0")) - df_hz / 2, freq(F.col("b1") - 1) + df_hz / 2
    mid, half = (c_lo + c_hi) / 2, OCCUPIED_GUARD * (c_hi - c_lo) / 2
    ok = F.col("b0").isNotNull()
    return edges.withColumns({
        "freq_extent_lower_hz": ext_lo, "freq_extent_upper_hz": ext_hi,
        "freq_lower_hz": F.when(ok, F.greatest(ext_lo, mid - half)).otherwise(ext_lo),
        "freq_upper_hz": F.when(ok, F.least(ext_hi, mid + half)).otherwise(ext_hi),
        "bounds_method": F.when(ok, F.lit(OCCUPIED_METHOD)).otherwise(F.lit(EXTENT_METHOD))})


def time_extent(on: DataFrame, keys: list[str], nperseg: int, hop: int) -> DataFrame:
    """Samples covered from the first to the last active frame, clipped to the samples read."""
    return on.groupBy(*keys).agg(
        F.greatest(F.min("lft"), F.min("frame") * hop).cast("long").alias("start_sample"),
        F.least(F.max("rgt"), F.max("frame") * hop + nperseg).cast("long").alias("end_sample"))


def confidence(excess_db: Column, occupancy: Column) -> Column:
    return clip(0.48 + 0.38 * (1 - F.exp(-F.greatest(F.lit(0.0), excess_db) / 10)) + 0.12 * occupancy, 0.0, 0.99)


def evidence_scores(cell: DataFrame, keys: list[str], threshold_db: Column) -> DataFrame:
    """90th percentile excess over the line, occupancy and the two heuristic scores; a block bounds the group."""
    a = cell.groupBy(*keys).agg(F.percentile("smooth", 0.9).alias("_p90"), F.max(threshold_db).alias("_line"),
                                F.avg(F.col("hit").cast("double")).alias("occupancy"))
    ex = db(F.col("_p90")) - F.col("_line")
    a = a.withColumn("threshold_excess_db", ex).withColumn("confidence", confidence(ex, F.col("occupancy")))
    return a.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW).drop("_p90", "_line")


def power_cv_deviation(cell: DataFrame, keys: list[str]) -> DataFrame:
    """abs(std/mean - 1) of power normalised by its bin mean, from per-bin partial sums."""
    b = cell.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("power").alias("_s"),
                                       F.sum(F.col("power") * F.col("power")).alias("_q"))
    m = F.greatest(F.col("_s") / F.col("_n"), F.lit(EPS))
    a = b.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum(F.col("_s") / m).alias("_s"),
                             F.sum(F.col("_q") / (m * m)).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    std = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    dev = F.when(mean > 0, F.abs(std / mean - 1)).otherwise(F.lit(0.0))
    return a.select(*keys, dev.alias("power_cv_deviation"),
                    clip(0.48 + 0.5 * (1 - F.exp(-dev / 0.2)), 0.0, 0.99).alias("confidence_evidence_based"))


def margin_sweep(frames: DataFrame, margins: list[float]) -> DataFrame:
    """Bands per margin from the same smoothed spectra: one explode over the short margin list, no new FFT."""
    keys = [*KEYS, "margin_db"]
    # the lowest margin of the list sees every cell a higher one sees: frames without any are dropped first
    low = db(F.col("floor")) + min(margins)
    fr = frames.withColumn("_low", low).where(F.exists("smooth", lambda s: db(s) > F.col("_low")))
    fr = fr.select(*KEYS, "frame", "smooth", "floor",
                   F.explode(F.array(*[F.lit(float(m)) for m in margins])).alias("margin_db"))
    fr = fr.withColumn("line", db(F.col("floor")) + F.col("margin_db")).select(
        *keys, "frame", F.transform("smooth", lambda s: db(s) > F.col("line")).alias("above"))
    hits = (opened(fr, keys).where(F.exists("hit", lambda h: h))
            .select(*keys, "frame", F.posexplode("hit").alias("bin", "h")).where("h"))
    return qualify_bands(active_bins(hits, keys), keys)


def opened(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Keep cells covered by a fully set 2x2 square, on frame rows with a boolean bin array `above`."""
    w = W.partitionBy(*keys).orderBy("frame")
    # sq[b]: this frame and the next one are set at bins b and b + 1
    f = frames.withColumn("_n", F.when(F.lead("frame").over(w) == F.col("frame") + 1, F.lead("above").over(w)))
    f = f.withColumn("_both", F.when(F.col("_n").isNotNull(), F.zip_with("above", "_n", lambda a, b: a & b)))
    pad = F.lit(False)
    f = f.withColumn("_sq", F.when(F.col("_both").isNotNull(), F.zip_with(
        F.slice("_both", F.lit(1), F.size("_both") - 1), F.slice("_both", F.lit(2), F.size("_both") - 1),
        lambda a, b: a & b)))
    f = f.withColumn("_psq", F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.lag("_sq").over(w)))
    zero = F.transform("above", lambda x: pad)
    a = F.coalesce("_sq", F.slice(zero, F.lit(2), F.size(zero) - 1))
    b = F.coalesce("_psq", F.slice(zero, F.lit(2), F.size(zero) - 1))
    f = f.withColumn("_any", F.zip_with(a, b, lambda x, y: x | y))
    one = F.array(pad)
    f = f.withColumn("hit", F.zip_with(F.concat("_any", one), F.concat(one, F.col("_any")), lambda x, y: x | y))
    return f.drop("_n", "_both", "_sq", "_psq", "_any")


def detect(frames: DataFrame, rate: float, nperseg: int, hop: int, margin_db: float = 8.0,
           fixed_db: float | None = None, real: bool = False, merge: bool = True) -> DataFrame:
    """Detections per (capture, block) from tables of frames: bounds, time extent and evidence of every qualified band.

    The relational form, for frames that are tables already; `blockbands.detect` goes from samples to bands in one pass.
    All grouping keys contain (capture, block): band slices are shuffled once and the chain then runs in place.
    """
    nb = nperseg // 2 + 1 if real else nperseg
    placed = hit_frames(frames)
    bands = merged_bands(placed, nb) if merge else as_parts(find_bands(placed))
    cell = band_cells(band_frames(bands, placed))
    band = W.partitionBy(*BAND)
    used = F.col("used")
    cell = cell.withColumns({
        "_p90": F.percentile(F.when(used, F.col("smooth")), 0.9).over(band),
        "_occ": F.avg(F.when(used, F.col("hit").cast("double"))).over(band),
        "_f0": F.min("frame").over(band), "_f1": F.max("frame").over(band)})
    p = F.col("power")
    per_bin = cell.groupBy(*BAND, "bin").agg(
        F.avg("power").alias("power"), F.count(F.when(used, p)).alias("_n"), F.sum(F.when(used, p)).alias("_s"),
        F.sum(F.when(used, p * p)).alias("_q"),
        *[F.first(c).alias(c) for c in ("_p90", "_occ", "_f0", "_f1", "floor", "lft", "rgt")])
    x = per_bin.withColumn("_e", F.greatest(p - F.col("floor"), F.lit(0.0)))
    total = F.sum("_e").over(band)
    cum = F.sum("_e").over(band.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("_c", cum / F.nullif(total, F.lit(0.0)))
    m = F.greatest(F.col("_s") / F.nullif(F.col("_n").cast("double"), F.lit(0.0)), F.lit(EPS))
    tail = (1 - OCCUPIED_FRACTION) / 2
    a = x.groupBy(*BAND).agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("_e").alias("excess"), F.max("bin").alias("_last"),
        F.min(F.when(F.col("_c") > tail, F.col("bin"))).alias("_b0"),
        F.min(F.when(F.col("_c") >= 1 - tail, F.col("bin"))).alias("_b1"),
        F.sum("_n").alias("_n"), F.sum(F.col("_s") / m).alias("_sn"), F.sum(F.col("_q") / (m * m)).alias("_qn"),
        *[F.first(c).alias(c) for c in ("_p90", "_occ", "_f0", "_f1", "floor", "lft", "rgt")])
    return published(a, rate, nperseg, hop, margin_db, fixed_db, real)


def published(facts: DataFrame, rate: float, nperseg: int, hop: int, margin_db: float, fixed_db: float | None, real: bool,
              more: dict[str, Column] | None = None) -> DataFrame:
    """Bounds, time extent and scores from the sums of a band, one row each."""
    nb = nperseg // 2 + 1 if real else nperseg
    step = rate / nperseg
    ok = (F.col("n_bins") >= MIN_REFINE_BINS) & (F.col("excess") > 0)
    b0 = F.least(F.coalesce("_b0", F.col("_last")), F.col("_last"))
    b1 = F.greatest(F.coalesce("_b1", F.col("_last")) + 1, b0 + 1)
    a = facts.withColumn("b0", F.when(ok, b0)).withColumn("b1", F.when(ok, b1))
    freq = (lambda b: b * F.lit(step)) if real else (lambda b: (b - nb // 2) * F.lit(step))
    some = F.col("fa").isNotNull()
    out = publish_bounds(a, freq, step, rate, real)
    out = out.withColumns({c: F.when(some, F.col(c)) for c in ("freq_lower_hz", "freq_upper_hz", "freq_extent_lower_hz", "freq_extent_upper_hz", "bounds_method")})
    line = F.lit(fixed_db) if fixed_db is not None else db(F.col("floor")) + margin_db
    ex = db(F.col("_p90")) - line
    mean = F.col("_sn") / F.col("_n")
    dev = F.abs(F.sqrt(F.greatest(F.col("_qn") / F.col("_n") - mean * mean, F.lit(0.0))) / mean - 1)
    out = out.select(
        *BAND, "freq_lower_hz", "freq_upper_hz", "freq_extent_lower_hz", "freq_extent_upper_hz", "bounds_method",
        F.when(some, F.greatest(F.col("lft"), F.col("_f0") * hop)).cast("long").alias("start_sample"),
        F.when(some, F.least(F.col("rgt"), F.col("_f1") * hop + nperseg)).cast("long").alias("end_sample"),
        F.when(some, ex).alias("threshold_excess_db"), F.col("_occ").alias("occupancy"),
        F.when(some, confidence(ex, F.col("_occ"))).alias("confidence"), F.when(some, dev).alias("power_cv_deviation"),
        F.when(some, clip(0.48 + 0.5 * (1 - F.exp(-dev / 0.2)), 0.0, 0.99)).alias("confidence_evidence_based"),
        *[c.alias(n) for n, c in (more or {}).items()])
    return (out.withColumn("needs_review", F.col("confidence") < REVIEW_BELOW)
               .withColumn("detection_method", F.when(some, F.lit("adaptive_threshold" if fixed_db is None else "fixed_threshold_debug"))))
