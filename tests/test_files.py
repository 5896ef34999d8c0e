"""Readers and writers on small generated files."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.sources import catalog as C, iq as Q, sinks as K


def back(df, n):
    out = np.zeros(n, complex)
    for r in df.collect():
        x = np.array(r.i) + 1j * np.array(r.q)
        assert r.rgt - r.lft == len(x)
        out[r.core_start:r.core_end] = x[r.core_start - r.lft:r.core_end - r.lft]
    return out


@pytest.mark.parametrize("kind", ["cf32_le", "ci16_be", "cu8", "ci8"])
def test_read_iq_blocks(spark, tmp_path, kind):
    r = np.random.default_rng(0)
    n, (dt, _) = 10_000, Q.DATATYPES[kind]
    raw = r.normal(size=2 * n).astype(dt) if kind == "cf32_le" else r.integers(0 if kind == "cu8" else -100, 120, 2 * n).astype(dt)
    p = tmp_path / "a.iq"
    p.write_bytes(raw.tobytes())
    df = Q.read_iq(spark, str(p), kind, 1e6, block=4096, guard=256, hop=256, blocks_per_task=1)
    v = raw.astype(float)
    v = {"cf32_le": v, "ci16_be": v / 32768, "cu8": (v - 127.5) / 127.5, "ci8": v / 128}[kind]
    assert np.allclose(back(df, n), v[::2] + 1j * v[1::2])
    assert df.rdd.getNumPartitions() == 3


def test_bad_files_fail(spark, tmp_path):
    p = tmp_path / "a.iq"
    p.write_bytes(b"123")
    with pytest.raises(Exception, match="whole samples"):
        Q.read_iq(spark, str(p), "cf32_le", 1e6).count()
    x = np.zeros(600_000, "<f4")
    x[-1] = np.nan
    p.write_bytes(x.tobytes())
    with pytest.raises(Exception, match="NaN"):
        Q.read_iq(spark, str(p), "cf32_le", 1e6).count()


def wav(data, rate, ch, bits, code=1):
    d = data.tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(d)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, code, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits) \
        + b"data" + struct.pack("<I", len(d)) + d


def test_read_wav(spark, tmp_path):
    x = np.random.default_rng(1).integers(-3000, 3000, 2 * 9000).astype("<i2")
    p = tmp_path / "a.wav"
    p.write_bytes(wav(x, 8000, 2, 16))
    got = back(Q.read_wav(spark, str(p), "iq", block=4096, guard=256), 9000)
    assert np.allclose(got, x[::2] / 32768 + 1j * x[1::2] / 32768)
    assert np.allclose(back(Q.read_wav(spark, str(p), "audio_right", block=4096, guard=256), 9000), x[1::2] / 32768)
    with pytest.raises(Exception, match="conflicts"):
        Q.read_wav(spark, str(p), rate=9000).count()
    u = np.random.default_rng(2).integers(0, 255, 5000).astype("u1")
    p.write_bytes(wav(u, 8000, 1, 8))
    assert np.allclose(back(Q.read_wav(spark, str(p), block=4096, guard=256), 5000), (u.astype(float) - 128) / 255)


def test_new_files_to_detections_in_one_stream(spark, tmp_path):
    """Files that arrive between runs, and one that a failed batch has to read again after a restart."""
    import os

    from sigspark.operators import blockbands as B
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rate, n = 48_000.0, 9000

    def put(name, f, at):
        r = np.random.default_rng(len(name))
        x = 0.05 * r.normal(size=n) * np.exp(2j * np.pi * r.random(n)) + np.exp(2j * np.pi * f * np.arange(n) / rate)
        np.stack([x.real, x.imag], 1).astype("<f4").tofile(folder / name)
        os.utime(folder / name, (at, at))

    def run(fail=False, settle=0):
        s = Q.stream_blocks(spark, str(folder), datatype="cf32_le", rate=rate, block=4096, guard=256, blocks_per_task=1, settle=settle)
        d = B.detect(s, rate, 64, 16)

        def write(batch, epoch):
            if fail:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        q = d.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()

    def seen():
        x = spark.read.parquet(out)
        return {Q.capture_number(str(folder / f)): f for f in os.listdir(folder)}, x.select("capture_id", "block_id", "fa", "epoch").collect()

    put("b.iq", 9000, 1000)
    put("a.iq", -7000, 2000)
    (folder / "skip.txt").write_text("x")
    run()
    names, rows = seen()
    assert {names[r.capture_id] for r in rows} == {"a.iq", "b.iq"} and {r.block_id for r in rows} == {0, 1, 2}
    batch = B.detect(Q.read_iq(spark, str(folder), "cf32_le", rate, 4096, 256), rate, 64, 16).select("capture_id", "block_id", "fa").collect()
    assert sorted(r[:3] for r in rows) == sorted(map(tuple, batch))
    run()
    assert len(seen()[1]) == len(rows)
    put("0.iq", 3000, 3000)
    with pytest.raises(Exception, match="lost"):
        run(fail=True)
    assert len(seen()[1]) == len(rows)
    run()
    names, more = seen()
    assert {names[r.capture_id] for r in more if r.epoch == max(x.epoch for x in more)} == {"0.iq"} and len(more) > len(rows)
    put("late.iq", 3000, __import__("time").time())
    run(settle=3600)  # may still be written
    assert len(seen()[1]) == len(more)


def test_mixed_folder_gives_blocks_and_error_rows(spark, tmp_path):
    """Raw with hints, sidecars, one and two channels, 24-bit samples; and files without metadata, torn, or with bad samples."""
    from sigspark.sources import captures as P
    r, n = np.random.default_rng(5), 5000
    z = np.exp(2j * np.pi * 0.07 * np.arange(n)) + 0.05 * (r.normal(size=n) + 1j * r.normal(size=n))
    pair = np.stack([z.real, z.imag], 1)
    code = lambda x, k: np.round(x * k / 2).astype(int)
    raw24 = lambda x: np.ascontiguousarray(code(x, (1 << 23) - 1).astype("<i4").reshape(-1, 1)).view("u1").reshape(-1, 4)[:, :3]
    put = lambda name, data: (tmp_path / name).write_bytes(data)
    put("a_433.9M_250k.cu8", np.round(pair.ravel() * 60 + 127).astype("u1").tobytes())
    put("b.sigmf-data", pair.astype("<f4").tobytes())
    (tmp_path / "b.sigmf-meta").write_text(json.dumps({"global": {"core:datatype": "cf32_le", "core:sample_rate": 48000}, "captures": [{"core:frequency": 5}]}))
    put("mono.wav", wav(raw24(z.real), 8000, 1, 24))
    put("pair.wav", wav(code(pair, 32000).astype("<i2"), 96000, 2, 16))
    put("pair24.wav", wav(raw24(pair.ravel()), 96000, 2, 24))
    voice = np.stack([z.real, 0.7 * z.real], 1)
    put("stereo.wav", wav(code(voice, 32000).astype("<i2"), 44100, 2, 16))
    put("noname.cs16", np.zeros(4000, "<i2").tobytes())
    put("c.sigmf-data", b"12345678")
    put("torn.wav", b"RIFFxx")
    put("odd_433.9M_250k.cs16", b"12345")
    bad = pair.astype("<f4")
    bad[4500] = np.nan
    put("nan.sigmf-data", bad.tobytes())
    (tmp_path / "nan.sigmf-meta").write_text((tmp_path / "b.sigmf-meta").read_text())
    df = P.read_captures(spark, str(tmp_path), block=4096, guard=256, per=1)
    rows = df.collect()
    name = lambda x: x.path.split("/")[-1]
    good, wrong = {}, {}
    for x in rows:
        (good if x.error is None else wrong).setdefault(name(x), []).append(x)
    assert all(sorted(x.block_id for x in v) == [0, 1] for k, v in good.items() if k != "nan.sigmf-data")
    assert set(good) >= {"a_433.9M_250k.cu8", "b.sigmf-data", "mono.wav", "pair.wav", "pair24.wav"}
    assert {k: len(v) for k, v in wrong.items()} == {"stereo.wav": 1, "noname.cs16": 1, "c.sigmf-data": 1, "torn.wav": 1, "odd_433.9M_250k.cs16": 1, "nan.sigmf-data": len(wrong["nan.sigmf-data"])}
    assert "ambiguous" in wrong["stereo.wav"][0].error and "missing c.sigmf-meta" in wrong["c.sigmf-data"][0].error
    assert "not a WAV" in wrong["torn.wav"][0].error and "whole samples" in wrong["odd_433.9M_250k.cs16"][0].error
    assert any("NaN" in x.error for x in wrong["nan.sigmf-data"])

    def samples(k):
        out = np.zeros(n, complex)
        for x in good[k]:
            v = np.array(x.i) + 1j * np.array(x.q)
            out[x.core_start:x.core_end] = v[x.core_start - x.lft:x.core_end - x.lft]
        return out
    assert np.allclose(samples("b.sigmf-data"), z, atol=1e-6) and np.allclose(samples("pair24.wav"), z / 2, atol=1e-6)
    assert np.allclose(samples("mono.wav"), z.real / 2, atol=1e-6) and np.allclose(samples("pair.wav"), z * 32000 / 65536, atol=1e-4)
    assert {x.sample_rate for x in good["a_433.9M_250k.cu8"]} == {250e3} and {x.sample_rate for x in good["b.sigmf-data"]} == {48e3}
    # what is asked for is all that is read: the condition stands before the reading operator
    lay = P.capture_layouts(spark, str(tmp_path))
    one = P.layout_blocks(lay.where(F.col("name") == "b.sigmf-data"), 4096, 256)
    assert {name(x) for x in one.collect()} == {"b.sigmf-data"}
    left = P.read_captures(spark, str(tmp_path), "audio_left", block=4096, guard=256).where("error is null").collect()
    assert "stereo.wav" in {name(x) for x in left} and all(not any(x.q) for x in left if name(x) == "stereo.wav")


def test_catalog_listing_and_pairs(spark, tmp_path):
    for n in ("b.sigmf-data", "a.cu8", "c.sigmf-data", "x.txt"):
        (tmp_path / n).write_bytes(b"1234")
    (tmp_path / "b.sigmf-meta").write_text(json.dumps({"global": {"core:datatype": "cu8", "core:sample_rate": 1000}, "captures": [{"core:sample_start": 0, "core:frequency": 5}]}, indent=1))
    files = Q.list_captures(spark, str(tmp_path))
    assert [r.name for r in files.collect()] == ["a.cu8", "b.sigmf-data", "c.sigmf-data"]
    cat = C.read_capture_catalog(spark, str(tmp_path))
    r = cat.first()
    assert (r.datatype, r.sample_rate, r.center_frequency_hz, r.reject) == ("cu8", 1000.0, 5.0, None)
    ok, err = C.pair_sidecars(files.where("name like '%sigmf%'"), cat)
    assert [x.name for x in ok.collect()] == ["b.sigmf-data"] and [x.name for x in err.collect()] == ["c.sigmf-data"]


def test_digests_by_byte_ranges(spark, tmp_path, monkeypatch):
    """The same tree in a loop; a sparse file of 3 GiB, an empty one, one that is gone and one that has grown."""
    import hashlib
    rng = np.random.default_rng(8)
    leaf, fan = C.LEAF_BYTES, C.FAN
    data = {"empty": b"", "small": b"abc", "one": rng.bytes(leaf), "two": rng.bytes(leaf + 1), "odd": rng.bytes(5 * leaf + 77)}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)

    def tree(v):
        level = [hashlib.sha256(v[i:i + leaf]).hexdigest() for i in range(0, max(1, len(v)), leaf)]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        return level[0]
    rows = [(str(tmp_path / k), len(v)) for k, v in data.items()]
    mk = lambda r: spark.createDataFrame(r, "path string, size long")
    want = {p: tree(data[p.split("/")[-1]]) for p, _ in rows}
    got = {r.path: r.digest for r in C.file_digests(mk(rows + [(str(tmp_path / "gone"), 5), ("file:" + str(tmp_path / "small"), 9)])).collect()}
    assert {p: got[p] for p in want} == want and got[str(tmp_path / "gone")] is None and got["file:" + str(tmp_path / "small")] is None
    monkeypatch.setattr(C, "FAN", 2)  # several levels
    fan = 2
    want = {p: tree(data[p.split("/")[-1]]) for p, _ in rows}
    for leaves in (1, 3):
        assert {r.path: r.digest for r in C.file_digests(mk(rows), leaves).collect()} == want
    monkeypatch.undo()
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(3 << 30)
    zero = hashlib.sha256(bytes(leaf)).hexdigest()
    big = hashlib.sha256((zero * 768).encode()).hexdigest()
    assert C.file_digests(mk([(str(tmp_path / "sparse"), 3 << 30)])).first().digest == big


def test_truth_and_manifest(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"sample_rate": 48000, "signals": [{"kind": "bpsk", "snr_db": 10}, {"kind": "fm"}]}, indent=1))
    assert [(r.kind, r.snr_db) for r in C.read_truth(spark, str(tmp_path / "t.json")).collect()] == [("bpsk", 10.0), ("fm", None)]
    (tmp_path / "m.json").write_text(json.dumps({"recordings": [{"file": "f", "allowed_labels": ["FSK2"], "overlap_band_hz": [1, 2]}]}))
    assert C.read_manifest(spark, str(tmp_path / "m.json")).first().allowed_labels == ["FSK2"]


def test_outputs_round_trip(spark, tmp_path):
    det = spark.createDataFrame([("a", 2, 10, 20, float("nan"), 5.0), ("a", 1, 0, 9, 1.0, 6.0), ("b", 1, 3, 4, 2.0, float("inf"))],
                                "file string, id int, start_sample long, end_sample long, snr_db double, elapsed_ms double")
    caps = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    K.write_detections(det, caps, str(tmp_path / "json"))
    got = {r.file: r.detections for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert [d.id for d in got["a"]] == [1, 2] and got["c"] == [] and "elapsed_ms" not in got["a"][0]
    K.write_jsonl(det, str(tmp_path / "lines"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert [(x["file"], x["id"]) for x in lines] == [("a", 1), ("a", 2), ("b", 1)] and "snr_db" not in lines[1]


def annotated(n, file="big"):
    return F.lit(file).alias("file"), F.col("id"), (F.col("id") * 3).alias("start_sample"), (F.col("id") * 3 + 5).alias("end_sample"), \
        F.lit(1.0).alias("freq_lower_hz"), F.lit(2.0).alias("freq_upper_hz"), F.lit(0.5).alias("confidence"), F.lit("m").alias("detection_method"), \
        F.lit(False).alias("is_pulsed"), F.lit(True).alias("needs_review"), F.lit(None).cast("double").alias("tuning_hz")


def test_documents_of_any_size(spark, tmp_path):
    det = spark.range(10_000).select(*annotated(10_000)).union(spark.range(2).select(*annotated(2, "a/b c"))).repartition(7)
    caps = spark.createDataFrame([("big", 1e6), ("a/b c", 2e6), ("none", 3e6)], "file string, rate double")
    K.write_detections(det, caps, str(tmp_path / "d"))
    docs = {x["file"]: x for x in (json.loads((tmp_path / "d" / f).read_text()) for f in __import__("os").listdir(tmp_path / "d"))}
    assert [d["id"] for d in docs["big"]["detections"]] == list(range(10_000)) and docs["big"]["rate"] == 1e6
    assert len(docs["a/b c"]["detections"]) == 2 and docs["none"] == {"file": "none", "rate": 3e6, "detections": []}
    K.write_annotations(det, str(tmp_path / "n"))
    n = json.loads((tmp_path / "n" / "big.json").read_text())
    assert [a["core:sample_start"] for a in n["annotations"]] == [3 * i for i in range(10_000)] and n["file"] == "big"
    # the table form says why a list is not there
    t = {r.file: r for r in K.sigmf_annotations(det).collect()}
    assert t["big"].annotations is None and "4,096" in t["big"].error and len(t["a/b c"].annotations) == 2 and t["a/b c"].error is None
    assert {r.file: r.status for r in K.validate_annotations(K.sigmf_annotations(det)).collect()}["a/b c"] == "OK"


def test_a_failed_job_leaves_no_document(spark, tmp_path):
    caps = spark.createDataFrame([(f"f{i}",) for i in range(20)], "file string")
    det = spark.range(200).select(F.concat(F.lit("f"), (F.col("id") % 20).cast("string")).alias("file"), "id")
    K.write_detections(det, caps, str(tmp_path / "d"))
    before = {f.name: f.read_text() for f in (tmp_path / "d").iterdir()}
    bad = det.withColumn("id", F.when(F.col("id") == 137, F.raise_error(F.lit("lost"))).otherwise(F.col("id") + 1000))
    with pytest.raises(Exception, match="lost"):
        K.write_detections(bad, caps, str(tmp_path / "d"))
    assert {f.name: f.read_text() for f in (tmp_path / "d").iterdir()} == before and len(before) == 20
    K.write_detections(det.where("file = 'f1'"), caps.where("file = 'f1'"), str(tmp_path / "d"))
    assert [f.name for f in (tmp_path / "d").iterdir()] == ["f1.json"]


def test_six_digit_text(spark):
    vals = [0.0, 1.0, -2.5, 123456.7, 999999.7, 1234567.0, 1e-4, 0.00001234, 100.0, 1e22, -3.0e-7, 0.1]
    got = spark.createDataFrame([(v,) for v in vals], "v double").select(K.general(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{v:.6g}" for v in vals]
