"""Capture catalogs: sidecar metadata, name hints, pairing, declared values, locks and manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .iq import local_path, open_path

META_SCHEMA = """struct<global:struct<`core:datatype`:string,`core:sample_rate`:double,`core:num_channels`:int,`core:offset`:long,`core:sha512`:string,`core:version`:string>,
  captures:array<struct<`core:sample_start`:long,`core:frequency`:double,`core:header_bytes`:long,`core:datetime`:string,`core::datetime`:string>>,
  annotations:array<struct<`core:sample_start`:long,`core:sample_count`:long,`core:freq_lower_edge`:double,`core:freq_upper_edge`:double,`core:label`:string,`core:comment`:string>>>"""
# fixed values: suffix -> datatype, and the name convention _<MHz>M_<kS/s>k
SUFFIX_TYPE = {"cu8": "cu8", "cs8": "ci8", "cs16": "ci16_le"}
NAME_PATTERN = r"(?i)_(\d+(?:\.\d+)?)M_(\d+(?:\.\d+)?)k\.c(?:u8|s8|s16)$"
AMBIGUOUS = "Supply the paired metadata, or for raw files enter sample rate and datatype explicitly."


def parse_catalog(df: DataFrame, text: str) -> DataFrame:
    """Sidecar JSON to catalog columns; `reject` names the first broken rule."""
    m = df.withColumn("_m", F.from_json(text, META_SCHEMA))
    g, caps = F.col("_m.global"), F.col("_m.captures")
    freqs = F.array_distinct(F.transform(caps, lambda c: F.coalesce(c["core:frequency"], F.lit(float("nan")))))
    rate = g["core:sample_rate"]
    nested = F.exists(caps, lambda c: F.coalesce(c["core:header_bytes"], F.lit(0)) != 0)
    reject = (F.when(F.col("_m").isNull() | g.isNull(), "invalid metadata")
              .when(rate.isNull() | F.isnan(rate) | (rate <= 0), "metadata must specify a positive sample rate")
              .when((F.size(freqs) > 1) | (F.coalesce(g["core:num_channels"], F.lit(1)) != 1), "retuned or multi-channel captures are not supported")
              .when((F.coalesce(g["core:offset"], F.lit(0)) != 0) | nested, "byte headers or sample offsets must be converted first"))
    f0 = F.get(freqs, F.lit(0))
    return m.select(*df.columns, g["core:datatype"].alias("datatype"), rate.alias("sample_rate"),
                    F.when(~F.isnan(f0), f0).alias("center_frequency_hz"), reject.alias("reject"))


def read_capture_catalog(spark: SparkSession, folder: str) -> DataFrame:
    t = spark.read.option("pathGlobFilter", "*.sigmf-meta").text(folder, wholetext=True)
    t = t.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value"))
    return parse_catalog(t, "value").drop("value")


def filename_hints(name: Column) -> dict[str, Column]:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    num = lambda g, k: F.when(F.regexp_extract(name, NAME_PATTERN, g) != "", F.regexp_extract(name, NAME_PATTERN, g).cast("double") * k)
    return {"datatype": F.coalesce(*[F.when(ext == s, F.lit(t)) for s, t in SUFFIX_TYPE.items()]),
            "sample_rate": num(2, 1e3), "center_frequency_hz": num(1, 1e6)}


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.sigmf-(data|meta)$", "")


def pair_sidecars(data: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, errors): each data file with its metadata by stem; unmatched data files become error rows."""
    d, m = data.withColumn("stem", stem(F.col("name"))), meta.withColumn("stem", stem(F.col("name"))).drop("name")
    return d.join(m, "stem"), d.join(m.select("stem"), "stem", "left_anti").withColumn(
        "error", F.concat(F.lit("missing "), F.col("stem"), F.lit(".sigmf-meta next to "), F.col("name")))


def resolve_declared(df: DataFrame) -> DataFrame:
    """given_* > meta_* > hint_*: a given value that contradicts metadata is an error, a missing one ambiguous."""
    rate, kind = F.coalesce("meta_rate", "given_rate", "hint_rate"), F.coalesce("meta_type", "given_type", "hint_type")
    status = (F.when(F.col("given_rate") != F.col("meta_rate"), "Provided sample rate conflicts with metadata.")
              .when(F.col("given_type") != F.col("meta_type"), "Provided datatype conflicts with metadata.")
              .when(rate.isNull() | kind.isNull(), AMBIGUOUS))
    src = (F.when(F.col("meta_rate").isNotNull(), "metadata")
           .when((rate == F.col("hint_rate")) | (kind == F.col("hint_type")), "file name").otherwise("declared"))
    return df.withColumns({"rate": rate, "datatype": kind, "error": status, "origin": F.when(status.isNull(), src)})


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth files {sample_rate, signals[]} -> one row per true signal."""
    sig = ("struct<kind:string,snr_db:double,freq_lower_hz:double,freq_upper_hz:double,start_sample:long,end_sample:long,"
           "symbol_rate_hz:double,pulse_width_samples:long,pri_samples:long>")
    t = spark.read.schema(f"sample_rate double, signals array<{sig}>").option("multiLine", True).json(path)
    t = t.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "sample_rate", F.explode_outer("signals").alias("s"))
    return t.select("file", "sample_rate", "s.*")


def read_manifest(spark: SparkSession, path: str, key: str = "recordings") -> DataFrame:
    """Expectation manifest {recordings: [...]} -> one row per file."""
    rec = ("struct<file:string,id:string,source:string,protocol:string,stratum:string,split:string,allowed_labels:array<string>,"
           "expected_rate_hz:double,min_detections:int,overlap_band_hz:array<double>,require_pulsed:boolean,"
           "bandwidth_99pct_range_hz:array<double>,min_wide_detections:struct<bandwidth_99pct_hz:double,count:int>>")
    return spark.read.schema(f"{key} array<{rec}>").option("multiLine", True).json(path).select(F.explode(key).alias("r")).select("r.*")


def lock_files(current: DataFrame, lock: DataFrame) -> DataFrame:
    """Compare digests with the lock: changed fails, new is added, the rest stays."""
    j = current.select("id", F.col("digest").alias("_new")).join(lock.select("id", F.col("digest").alias("_old")), "id", "full_outer")
    state = (F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "absent")
             .when(F.col("_new") != F.col("_old"), "changed").otherwise("same"))
    return j.select("id", F.coalesce("_old", "_new").alias("digest"), state.alias("state"))


def sanitize_annotations(df: DataFrame, text: str, n_samples: Column) -> DataFrame:
    """Annotations that end inside the stored samples, the misspelt time key renamed, the stale hash dropped."""
    m = df.withColumn("_m", F.from_json(text, META_SCHEMA))
    ann = F.filter(F.coalesce(F.col("_m.annotations"), F.array().cast("array<struct<`core:sample_start`:long,`core:sample_count`:long,`core:freq_lower_edge`:double,`core:freq_upper_edge`:double,`core:label`:string,`core:comment`:string>>")),
                   lambda a: a["core:sample_start"] + F.coalesce(a["core:sample_count"], F.lit(0)) <= n_samples)
    caps = F.transform("_m.captures", lambda c: c.withField("`core:datetime`", F.coalesce(c["core::datetime"], c["core:datetime"])).dropFields("`core::datetime`"))
    return m.withColumns({"global": F.col("_m.global").dropFields("`core:sha512`"), "captures": caps, "annotations": ann}).drop("_m")


#: bytes of a leaf of the hash tree, leaves read by one task row, children of a node
LEAF_BYTES, LEAVES_PER_RANGE, FAN = 4 << 20, 16, 1024


def file_digests(files: DataFrame, leaves: int = LEAVES_PER_RANGE) -> DataFrame:
    """path, size, digest of files of any size (path, size), a byte range per task row.

    The digest is the root of a hash tree: SHA-256 of every 4 MiB, then of up to 1,024 digests below each other, until one
    is left; an empty file has the digest of nothing. It does not depend on how the ranges are dealt (`leaves`). A file
    that cannot be read, or has another size by now, has NULL and the reason in `error`.
    """
    last = F.greatest(F.ceil(F.col("size") / LEAF_BYTES) - 1, F.lit(0)).cast("long")
    x = files.select("path", F.col("size").cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / leaves))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("digest", pa.string()), ("error", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                try:
                    filesystem, inner = open_path(local_path(r["path"]))
                    with filesystem.open_input_file(inner) as f:
                        if f.size() != r["size"]:
                            raise OSError(f"{f.size()} bytes in place of {r['size']}")
                        for leaf in range(r["part"] * leaves, (r["part"] + 1) * leaves):
                            if leaf == 0 or leaf * LEAF_BYTES < r["size"]:
                                rows.append(r | {"at": leaf, "digest": hashlib.sha256(f.read_at(LEAF_BYTES, leaf * LEAF_BYTES)).hexdigest()})
                except OSError as e:
                    rows = [r | {"at": r["part"], "error": str(e)}]
                yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in kinds.names} for x in rows], kinds)

    nodes = x.repartition("path", "part").mapInArrow(run, "path string, size long, at long, digest string, error string")
    nodes = nodes.withColumn("n", F.greatest(F.ceil(F.col("size") / LEAF_BYTES), F.lit(1)).cast("long"))
    most = max(1, -(-int(files.agg(F.max("size")).first()[0] or 0) // LEAF_BYTES))
    while most > 1:
        nodes, most = _parents(nodes), -(-most // FAN)
    return nodes.groupBy("path", "size").agg(F.max("error").alias("error"), F.max("digest").alias("digest")).select(
        "path", "size", F.when(F.col("error").isNull(), F.col("digest")).alias("digest"), "error")


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of every file's tree; a file of which one node is left keeps it. `n` is the nodes of the file."""
    below = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda d: d["digest"])
    g = nodes.groupBy("path", "size", "n", F.floor(F.col("at") / FAN).alias("at")).agg(below.alias("_d"), F.max("error").alias("error"))
    digest = F.when(F.col("n") == 1, F.get("_d", F.lit(0))).otherwise(F.sha2(F.array_join("_d", ""), 256))
    return g.select("path", "size", F.ceil(F.col("n") / FAN).cast("long").alias("n"), "at", digest.alias("digest"), "error")
