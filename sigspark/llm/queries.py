"""One registered query for every operator: its contract's digest columns over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as S

from . import centroids, chat, decontam, fingerprint, mixing, ngram_join, periodic, perplexity, pii, quality, sharding, sql_twins, tokens, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


#: words and windows as in the contract; n-grams are compared as joined text
OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = decontam.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return x.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


@query("op6_entropy_mix")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


@query("op1_hash_ring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


@query("op4_personal_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pii.find(table(spark, sf_dir, "documents"))
    count = [pii.of_kinds("spans", k) for k in pii.BASE]
    count = [F.size(c).cast("long").alias(f"n_{k}") for c, k in zip(count, pii.BASE)]
    base = pii.of_kinds("spans", *pii.BASE)
    return x.select("doc_id", *count, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op2_rule_ensemble")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("stats")


@query("op8_warc_index")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = warc.archive(table(spark, sf_dir, "pages"))
    return x.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "archive", "offset", "length")


@query("op9_edit_embedding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_test(table(spark, sf_dir, "documents"))


@query("op5_role_repair")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op11_perplexity_bands", sql_twins.perplexity())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents")).select("doc_id", *perplexity.MEASURES, "base_failed", "kept")


@F.arrow_udf(S.StringType())
def with_period(g: pa.Array, text: pa.Array) -> pa.Array:
    """Words from g % n on become periodic; null stays null."""
    out = []
    for g, text in zip(g.to_pylist(), text.to_pylist()):
        w = periodic.words(text)
        if w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + i % p] for i in range(len(w) - a)]
        out.append(None if text is None else b" ".join(w).decode())
    return pa.array(out, pa.string())


@query("op12_diagonal_runs", sql_twins.PERIODIC)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = with_period(F.floor(h / 10), F.when(h % 10 == 0, F.col("text")))
    x = periodic.find(table(spark, sf_dir, "documents").select("doc_id", F.coalesce(planted, "text").alias("text")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    x = x.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))))
    return x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_lookup_centroids", sql_twins.centroids())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return x.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("centroid_sha256"))
