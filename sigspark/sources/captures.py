"""A folder of mixed captures as sample blocks and error rows, driven by its catalog.

The catalog is a DataFrame with one row per file: what it is, how it is laid out, or why it cannot be read. A file is cut into
slots by its size alone, so the driver opens nothing; the task of a slot reads the header and the byte ranges of its own
blocks. Conditions on the path or on blocks reach the catalog before anything is read. Whatever is wrong with a file becomes
a row with `error`; the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.features import hilbert_blocks, iq_or_audio
from ..operators.spectra import BLOCK_SAMPLES, guard_length
from . import catalog as C
from .iq import SCHEMA, BlockReader, list_captures, local_path, open_path

MODES = ("auto", "iq", "audio_left", "audio_right")
AMBIGUOUS_WAV = "WAV channels are ambiguous. Choose iq, audio_left or audio_right; no interpretation was assumed."
ROWS = SCHEMA + ", error string"
#: bytes of a sample that a slot is cut for; smaller samples give it more blocks
SLOT_STRIDE = 4


def capture_layouts(spark: SparkSession, folder: str, datatype: str | None = None, rate: float | None = None) -> DataFrame:
    """path, name, size, datatype, rate, center_frequency_hz, error of every capture file of a folder: from the sidecar, from
    what is given, from the name, in the order of `catalog.resolve_declared`. WAV files say what they are themselves."""
    f = list_captures(spark, folder).withColumn("stem", C.stem(F.col("name")))
    m = C.read_capture_catalog(spark, folder).select(C.stem(F.col("name")).alias("stem"), F.col("datatype").alias("meta_type"), F.col("sample_rate").alias("meta_rate"),
                                                      F.col("center_frequency_hz").alias("meta_center"), "reject", F.lit(True).alias("_meta"))
    sidecar = F.col("name").endswith(".sigmf-data")
    hints = C.filename_hints(F.col("name"))
    x = f.withColumn("_stem", F.when(sidecar, F.col("stem"))).join(m.withColumnRenamed("stem", "_stem"), "_stem", "left").withColumns({
        "given_type": F.lit(datatype).cast("string"), "given_rate": F.lit(rate).cast("double"), "hint_type": hints["datatype"], "hint_rate": hints["sample_rate"]})
    x = C.resolve_declared(x)
    wav = F.lower("name").endswith(".wav")
    error = (F.when(wav, F.lit(None).cast("string"))
             .when(sidecar & F.col("_meta").isNull(), F.concat(F.lit("missing "), F.col("stem"), F.lit(".sigmf-meta next to "), F.col("name")))
             .when(F.col("reject").isNotNull(), F.col("reject")).otherwise(F.col("error")))
    return x.select("path", "name", "size", F.when(~wav, F.col("datatype")).alias("datatype"), F.when(wav, F.lit(rate).cast("double")).otherwise(F.col("rate")).alias("rate"),
                    F.coalesce("meta_center", hints["center_frequency_hz"]).alias("center_frequency_hz"), error.alias("error"))


def layout_blocks(layouts: DataFrame, block: int = BLOCK_SAMPLES, guard: int | None = None, hop: int = 256, mode: str = "auto", per: int = 16) -> DataFrame:
    """Sample blocks of the files of a catalog (path, size, datatype, rate, error, and mode where it says more than `mode`),
    with an error row for each file, or part of one, that cannot be read. In mode "auto" two channels need a decision:
    `decided` makes it."""
    if block % hop or block < 16 * hop:
        raise ValueError("Block size must be a multiple of the frame hop and at least 16 hops.")
    if mode not in (*MODES, "pair"):
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    slots = F.greatest(F.ceil(F.col("size") / (block * per * SLOT_STRIDE)), F.lit(1)).cast("long")
    own = F.coalesce("mode", F.lit(mode)) if "mode" in layouts.columns else F.lit(mode)
    x = layouts.select("path", "size", "datatype", "rate", "error", own.alias("mode"), slots.alias("slots"))
    x = x.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ROWS.split(", "))])

    def failed(path: str, why: str, block_id: int | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "block_id": block_id, "error": why}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["error"] is not None:
                    if r["slot"] == 0:
                        yield failed(r["path"], r["error"])
                    continue
                options = {"path": r["path"], "mode": "iq" if r["mode"] == "pair" else r["mode"], "block": block, "hop": hop}
                options |= {k: v for k, v in (("datatype", r["datatype"]), ("rate", r["rate"])) if v is not None}
                reader = BlockReader(options)
                try:
                    filesystem, inner = open_path(local_path(r["path"]))
                    lay = reader.layout(filesystem, filesystem.get_file_info(inner))
                    if lay.choice == "auto":
                        raise ValueError(AMBIGUOUS_WAV)
                except (ValueError, OSError, KeyError) as e:
                    if r["slot"] == 0:
                        yield failed(r["path"], str(e))
                    continue
                n = -(-lay.total // block)
                g = guard if guard is not None else guard_length(block, lay.rate, hop)
                lay.name = r["path"]
                with filesystem.open_input_file(inner) as f:
                    for b in range(n * r["slot"] // r["slots"], n * (r["slot"] + 1) // r["slots"]):
                        try:
                            yield _with_error(reader.block_batch(f, lay, b, block, g), schema)
                        except (ValueError, OSError) as e:
                            yield failed(r["path"], str(e), b)

    # one slot is at most a few blocks: a task per slot, dealt by its place in the file
    return x.repartition("path", "slot").mapInArrow(run, ROWS)


def _with_error(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.string())], schema=schema)


def decided(layouts: DataFrame, block: int = 131_072, guard: int = 4_096) -> DataFrame:
    """Catalog with `mode` for WAV files: "iq" where the whole of both channels shows an IQ pair, the left channel of files
    with one, and an error for two channels that do not say. Only WAV files are read, once, in blocks whose sums combine."""
    wav = layouts.where(F.lower("name").endswith(".wav") & F.col("error").isNull())
    b = layout_blocks(wav, block, guard, mode="pair")
    ok = b.where("error is null")
    h = hilbert_blocks(ok.select("path", "lft", "core_start", "core_end", "i", "q"))
    z = h.select("path", "lft", "core_start", "core_end", F.posexplode(F.arrays_zip("i", "q", "h")).alias("p", "s"))
    z = z.where((F.col("lft") + F.col("p") >= F.col("core_start")) & (F.col("lft") + F.col("p") < F.col("core_end")))
    e = iq_or_audio(z.select("path", F.col("s.i").alias("a"), F.col("s.q").alias("b"), F.col("s.h").alias("h")), ["path"])
    # a file with one channel cannot be a pair: the reader said so
    mono = b.where(F.col("error").contains("needs two channels")).select("path", F.lit("audio_left").alias("_mono")).distinct()
    x = layouts.join(e.select("path", "result"), "path", "left").join(mono, "path", "left")
    two = F.col("result").isNotNull()
    return (x.withColumn("mode", F.when(F.col("result") == "iq_pair_evidence", "iq").otherwise(F.col("_mono")))
             .withColumn("error", F.when(F.col("error").isNull() & two & (F.col("result") != "iq_pair_evidence"), AMBIGUOUS_WAV).otherwise(F.col("error")))
             .drop("result", "_mono"))


def read_captures(spark: SparkSession, folder: str, mode: str = "auto", datatype: str | None = None, rate: float | None = None,
                  block: int = BLOCK_SAMPLES, guard: int | None = None, hop: int = 256, per: int = 16) -> DataFrame:
    """Every capture of a folder, raw, WAV or with a sidecar, as sample blocks; files that cannot be read as error rows."""
    x = capture_layouts(spark, folder, datatype, rate)
    return layout_blocks(decided(x) if mode == "auto" else x, block, guard, hop, mode, per)
