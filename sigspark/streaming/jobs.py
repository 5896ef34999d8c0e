"""Streaming versions: windows over samples and spectra, folder watching, packet sessions, track state, sinks.

Event time comes from sample positions (start + n / rate) or block starts; the watermark is how late a block may be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators.tracks import ORDER, Walk
from ..sources import sinks as SK


def stream_block_psd(spectra: DataFrame, ts: str, block: str, late: str, keys: list[str]) -> DataFrame:
    """Mean power per bin and row count in each fixed block of time."""
    return (spectra.withWatermark(ts, late).groupBy(F.window(ts, block), *keys, "bin")
                   .agg(F.avg("power").alias("power"), F.count(F.lit(1)).alias("n_frames")))


def stream_frames(samples: DataFrame, ts: str, length: str, hop: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Overlapping frames as sliding windows: samples, mean power and peak of each."""
    return (samples.withWatermark(ts, late).groupBy(F.window(ts, length, hop), *keys)
                   .agg(F.count(F.lit(1)).alias("n_samples"), F.avg(value).alias("mean_power"), F.max(value).alias("peak")))


def stream_packets(active: DataFrame, ts: str, gap: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Packets: active samples split at pauses of at least `gap`."""
    return (active.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys)
                  .agg(F.count(F.lit(1)).alias("n_active"), F.sum(value).alias("energy")))


def watch_folder(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New capture files; the checkpoint remembers what was seen, also after a restart."""
    s = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{sigmf-data,wav,iq,cu8,cs8,cs16}")
         .option("maxFilesPerTrigger", per_trigger).load(folder).drop("content"))
    return s.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")


#: keyed state with timers needs this store; set where such a stream is defined
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STABLE_SCHEMA = "path string, size long, poll long"


def _timed(df: DataFrame, second: str, late: int) -> DataFrame:
    """Event time: one second per poll or block, so a watermark counts polls or blocks. A watermark starts at 0 and drops
    what is not after it, so number 0 is second 1."""
    df.sparkSession.conf.set(*_STORE)
    return df.withColumn("ts", F.timestamp_seconds(F.col(second) + 1)).withWatermark("ts", f"{late} seconds")


def _only_timer(handle: StatefulProcessorHandle, second: int) -> None:
    """The key's state is looked at again when the watermark reaches the poll or block `second`."""
    at = (second + 1) * 1000
    for t in list(handle.listTimers()):
        if t != at:
            handle.deleteTimer(t)
    handle.registerTimer(at)


#: captures next to each other, and shares of all paths, whose state is kept and looked through in one call
NEAR_CAPTURES, PATH_SHARES = 1024, 4096
#: captures of at most so many open tracks are kept in the list of their group, which one call writes
FEW_TRACKS = 2


class _Stable(StatefulProcessor):
    """Last size and poll of every path of a share, and whether it has been reported; gone when a poll passes without the path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "path string, size long, poll long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {r[0]: tuple(r[1:]) for r in self.last.get()}
        p = pd.concat(list(rows)).sort_values("poll")
        out, seen = [], {}
        for path, size, poll in zip(p.path, p["size"], p.poll):
            before, at, done = seen.get(path) or known.get(path) or (-1, -2, False)
            if poll <= at:
                continue
            same = poll == at + 1 and size == before
            done = done and poll == at + 1
            if same and not done:
                out.append((path, int(size), int(poll)))
                done = True
            seen[path] = (int(size), int(poll), done)
        known.update(seen)
        self.last.put([(path, *now) for path, now in known.items()])
        _only_timer(self.handle, min(v[1] for v in known.values()) + 1)
        yield pd.DataFrame(out, columns=["path", "size", "poll"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = {r[0]: tuple(r) for r in self.last.get()}
        left = _not_silent(self.handle, {path: r[2] for path, r in known.items()}, timerValues, expiredTimerInfo)
        _put(self.last, [known[path] for path in left])
        yield pd.DataFrame([], columns=["path", "size", "poll"])

    def close(self) -> None:
        pass


def _put(state, rows: list[tuple]) -> None:
    """All of a list in one call; an empty list leaves no state."""
    state.put(rows) if rows else state.clear()


def _not_silent(handle: StatefulProcessorHandle, last: dict, timerValues, expired) -> list:
    """The names of `last` (name -> newest poll or block) that the watermark has not passed; they have the next timer."""
    due = lambda n: (n + 2) * 1000
    left = [k for k, n in last.items() if due(n) > expired.getExpiryTimeInMs() and due(n) >= timerValues.getCurrentWatermarkInMs()]
    if left:
        _only_timer(handle, min(last[k] for k in left) + 1)
    return left


def stable_files(polls: DataFrame) -> DataFrame:
    """Listing rows (poll, path, size) -> each file once, when two polls in a row saw the same size.

    A file missing from a poll is forgotten: its state leaves when the watermark, the newest poll, has passed it. Paths
    are looked at share by share (of their hashes), so a call from Spark serves many files.
    """
    x = _timed(polls, "poll", 0).withColumn("_share", F.pmod(F.xxhash64("path"), F.lit(PATH_SHARES)))
    return x.groupBy("_share").transformWithStateInPandas(_Stable(), STABLE_SCHEMA, "Append", "EventTime")


def await_sidecar(data: DataFrame, meta: DataFrame, late: str, wait: str, outer: bool = False) -> DataFrame:
    """Data files joined with their metadata by stem within `wait`; the outer form also gives the ones that timed out."""
    d = data.withWatermark("ts", late).alias("d")
    m = meta.withWatermark("ts", late).alias("m")
    cond = F.expr(f"d.stem = m.stem AND m.ts >= d.ts - INTERVAL {wait} AND m.ts <= d.ts + INTERVAL {wait}")
    return d.join(m, cond, "left_outer" if outer else "inner").select(
        F.col("d.stem").alias("stem"), F.col("d.name").alias("name"), F.col("d.ts").alias("ts"), F.col("m.name").alias("meta_name"))


TRACK_SCHEMA = "capture_id long, block long, det int, lo double, hi double, track long"


class _Tracks(StatefulProcessor):
    """Open tracks by capture and number, newest block and next number of each of some captures.

    A call from Python for each row of state costs more than the walk. Captures of few open tracks are rows of one list, read
    and written as a whole; the newest block is that of the track seen last. The others have a row a capture and a row a
    track, so no list grows with the tracks of a capture and only what changed of them is written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.few = handle.getListState("few", "capture_id long, next_id long, track long, lo double, hi double, seen long")
        self.at = handle.getMapState("at", "capture_id long", "block long, next_id long")
        self.open = handle.getMapState("open", "capture_id long, track long", "lo double, hi double, seen long")

    def _listed(self) -> tuple[dict, dict]:
        """Newest block and next number, and open tracks, of the captures in the list."""
        at, tracks = {}, {}
        for c, next_id, t, lo, hi, seen in self.few.get():
            tracks.setdefault(c, {})[t] = [lo, hi, seen]
            at[c] = (max(seen, at[c][0]) if c in at else seen, next_id)
        return at, tracks

    def _list(self, at: dict, tracks: dict) -> None:
        _put(self.few, [(c, at[c][1], t, *v) for c, found in tracks.items() for t, v in found.items()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, before = self._listed()
        listed, rowed = dict(before), set()
        if self.at.exists():
            for k, v in self.at.iterator():
                at[k[0]] = tuple(v)
                rowed.add(k[0])
            for (c, t), v in self.open.iterator():
                before.setdefault(c, {})[t] = list(v)
        p = pd.concat(list(rows)).sort_values(["capture_id", "block", *ORDER])
        walks, track, seen = {}, [], None
        for c, b, lo, hi in zip((None if pd.isna(c) else int(c) for c in p.capture_id), p.block, p.lo, p.hi):
            if c not in walks:
                tracks = before.get(c, {})
                seen, next_id = at.get(c, (None, 0))
                walks[c] = Walk(dict(sorted(tracks.items())), seen, next_id, [t for t, v in tracks.items() if v[2] == seen])
            track.append(None if seen is not None and b < seen else walks[c].take(int(b), float(lo), float(hi)))
        for c, walk in walks.items():
            few, now = len(walk.tracks) <= FEW_TRACKS, (walk.block, walk.next_id)
            had = before.get(c, {}) if c in rowed else {}
            for t in had if few else had.keys() - walk.tracks.keys():
                self.open.removeKey((c, t))
            if few:
                listed[c] = walk.tracks
                if c in rowed:
                    self.at.removeKey((c,))
            else:
                listed.pop(c, None)
                for t, v in walk.tracks.items():
                    if had.get(t) != v:
                        self.open.updateValue((c, t), tuple(v))
                if c not in rowed or at[c] != now:
                    self.at.updateValue((c,), now)
            at[c] = now
        self._list(at, listed)
        _only_timer(self.handle, min(block for block, _ in at.values()) + 1)
        yield p.assign(track=pd.array(track, "Int64"))[[c.split()[0] for c in TRACK_SCHEMA.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, listed = self._listed()
        rowed = {k[0]: tuple(v) for k, v in self.at.iterator()}
        newest = {c: block for c, (block, _) in {**at, **rowed}.items()}
        left = set(_not_silent(self.handle, newest, timerValues, expiredTimerInfo))
        if at.keys() - left:
            self._list(at, {c: found for c, found in listed.items() if c in left})
        gone = rowed.keys() - left
        for c, t in [k for k in self.open.keys() if k[0] in gone]:
            self.open.removeKey((c, t))
        for c in gone:
            self.at.removeKey((c,))
        if gone and gone == rowed.keys():
            self.open.clear()
            self.at.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in TRACK_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def stream_tracks(det: DataFrame, keep: int = 4096) -> DataFrame:
    """Track numbers of arriving detections; state is the few open tracks of a capture.

    A track closes when a block passes without it. A block may arrive in parts over several batches; a row of an older
    block than the newest one of its capture is late and comes out without a track, and one more than `keep` blocks behind
    the newest block of all captures is dropped by the watermark. The state of a capture that is silent for `keep` blocks
    leaves; should it go on after that, its numbers start again. Captures with ids next to each other are looked at
    together, so a call from Spark serves many captures of few detections.
    """
    x = _timed(det, "block", keep).withColumn("_near", F.floor(F.col("capture_id") / NEAR_CAPTURES))
    return x.groupBy("_near").transformWithStateInPandas(_Tracks(), TRACK_SCHEMA, "Append", "EventTime")


def stream_sinks(det: DataFrame, out: str, checkpoint: str, bad: Callable[[], Column]):
    """Per-file outputs as detections arrive; rows that fail the rule go to an error table and the stream goes on."""
    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_bad", F.coalesce(bad(), F.lit(True)))
        good = rows.where("NOT _bad").drop("_bad")
        SK.jsonl_rows(good).write.mode("overwrite").text(f"{out}/detections/epoch={epoch}")
        rows.where("_bad").drop("_bad").write.mode("overwrite").json(f"{out}/errors/epoch={epoch}")
    return det.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write)


class Progress(StreamingQueryListener):
    """Rows done per query, as plain records for a table."""

    def __init__(self):
        self.rows: list[dict] = []

    def onQueryStarted(self, event):
        self.rows.append({"query": str(event.id), "batch": -1, "rows": 0, "message": "started"})

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.append({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "message": f"batch {p.batchId}: {p.numInputRows} rows"})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.rows.append({"query": str(event.id), "batch": -1, "rows": 0, "message": "failed" if event.exception else "done"})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, batch long, rows long, message string")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now into a parquet table and read it back."""
    q = (stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run an aggregation over what is there now, closed and open windows alike, and read the last result.

    Complete mode keeps every window in state; a stream without end uses append mode and leaves open windows for later.
    """
    path = f"{folder}/table"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    q = (stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
