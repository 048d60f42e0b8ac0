"""Ingest, first-seen, rate cap and expiry as Structured Streaming."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import rules as R
from ..schemas import RAW_POSTING
from .snapshots import Chain

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landing(spark: SparkSession, path: str, schema: str = RAW_POSTING, files_per_batch: int | None = None) -> DataFrame:
    """Rows as they land, in Parquet; at most so many files in a micro-batch, oldest first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_ingest(stream: DataFrame, chain: Chain, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """Every micro-batch is merged onto the snapshot before it.

    ``merge(state, batch)`` gives the next state. A batch that is replayed after a failure
    finds its commit or starts from the version before it, so it counts once. Late rows
    are not dropped: the merge's rules say what a late sighting may fill.
    """
    return stream.writeStream.foreachBatch(chain.step(merge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first_seen(stream: DataFrame) -> DataFrame:
    """Each id once for ever, however late it comes again.

    The state has every id and no watermark evicts it: it grows with the ids, as the
    store of first sightings does, in RocksDB on the executors' disks and in the checkpoint.
    """
    return stream.dropDuplicates(["id"])


def stream_first_seen_within(stream: DataFrame, delay: str = "48 hours") -> DataFrame:
    """X2 in bounded memory: each id once within the watermark; an id that was silent for longer counts as new."""
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["id"])


def stream_push_counts(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """X3, monitoring: pushes in sliding hours, a window once the watermark has passed its end."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour", "10 minutes")).agg(F.count("*").alias("n"))


SENT = "channel string, sent array<timestamp>"
DECIDED = "channel string, id string, ts timestamp, score int, decision string, sent array<timestamp>"


def rate_capped(batch: DataFrame, sent: DataFrame) -> DataFrame:
    """batch(channel, id, ts, score) with decisions, in order of (ts, score desc, id) in each channel.

    ``sent(channel, sent)`` has the last interrupts of a channel, at most the cap; the same
    comes back as one row a channel without an id. The cap is sequential, so a channel's
    rows pass one task in order, but as a stream of sorted Arrow batches: a task holds one
    batch and the times of one channel, however many rows a channel has.
    """
    rows = batch.select("channel", "id", "ts", "score", F.lit(None).cast("array<timestamp>").alias("sent"), F.lit(1).alias("turn"))
    before = sent.select("channel", F.lit(None).cast("string").alias("id"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("int").alias("score"), "sent", F.lit(0).alias("turn"))
    dealt = rows.unionByName(before).repartition("channel").sortWithinPartitions("channel", "turn", "ts", F.desc("score"), "id")
    hour, most = pd.Timedelta(hours=1), R.INTERRUPTS_PER_HOUR
    columns = ["channel", "id", "ts", "score", "decision", "sent"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, times, some = None, [], False
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if not some or row.channel != channel:
                    if some:
                        out.append((channel, None, None, None, None, times))
                    channel, times, some = row.channel, [], True
                if row.turn == 0:
                    times = [pd.Timestamp(t) for t in row.sent]
                    continue
                times = [t for t in times if row.ts - t < hour]
                free = len(times) < most
                times = [*times, row.ts] if free else times
                out.append((channel, row.id, row.ts, row.score, "interrupt" if free else "digest", None))
            yield _typed(out, columns)
        if some:
            yield _typed([(channel, None, None, None, None, times)], columns)

    return dealt.mapInPandas(run, DECIDED)


def _typed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"score": "Int32", "ts": "datetime64[us]"})


def stream_rate_cap(stream: DataFrame, chain: Chain, decisions: str, checkpoint: str):
    """Decisions of every micro-batch as files under ``decisions``; the chain has each channel's last interrupts (``SENT``).

    A replayed batch writes its own files again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, target = batch.sparkSession, f"{decisions}/batch={number}"
        if number in chain.commits(spark):
            return
        rate_capped(batch, chain.read(spark, number)).write.mode("overwrite").parquet(target)
        done = spark.read.schema(DECIDED).parquet(target)
        chain.commit(spark, number, chain.write(done.where("id is null").select("channel", "sent"), number))
        chain.clean(spark)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECIDED).parquet(f"{path}/batch=*").where("id is not null").drop("sent")


class Expiry(StatefulProcessor):
    """An id expires when healthy runs of its source have not shown it for ``HOURS``.

    The key is a source and a bucket of its ids. State: when each id was seen in healthy
    runs that are not settled yet (nothing once expired), and the times of healthy runs. An id is missed from
    the first healthy run after it was seen, and expires at the first healthy run HOURS
    or more after that. One event-time timer a bucket stands at the first run that can
    expire an id; nothing is decided before the watermark has passed it, so rows may come
    in any order within the watermark. The ids of a bucket are looked through when its
    timer fires, not for every run. Unhealthy runs tell nothing.
    """

    HOURS = 48

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "id string", "at array<long>")
        self.runs = handle.getListState("runs", "at long")
        #: No live id was last seen before this.
        self.oldest = handle.getValueState("oldest", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = [r[0] for r in self.runs.get()] if self.runs.exists() else []
        oldest = self.oldest.get()[0] if self.oldest.exists() else None
        runs = set(old)
        for frame in rows:  # a frame at a time
            healthy = frame[frame["healthy"]]
            runs.update(healthy["at"].tolist())
            shown, named = {}, healthy[healthy["id"].notna()]
            for name, at in zip(named["id"].tolist(), named["at"].tolist()):
                shown.setdefault(name, set()).add(at)
            for name, times in shown.items():  # every call on the state is a round trip, so an id takes one to read it and one to write
                value = self.seen.getValue((name,))
                held = None if value is None else list(value[0])
                if held is None or held:  # not expired
                    together = sorted({*(held or []), *times})
                    oldest = together[0] if oldest is None else min(oldest, together[0])
                    if together != held:
                        self.seen.updateValue((name,), (together,))
        self._wait(sorted(runs), oldest)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, runs = timerValues.getCurrentWatermarkInMs(), [r[0] for r in self.runs.get()]
        out, left, oldest = [], {}, None
        for (name,), (held,) in self.seen.iterator():
            times, due = list(held), None
            while times:
                due = self._due(runs, times[0])
                again = times[1] if len(times) > 1 else None
                if due is None or (again is not None and again <= due and again > passed):
                    break  # not settled
                if again is not None and again <= due:
                    times.pop(0)  # seen again in time
                    continue
                if due <= passed:
                    out.append((key[0], name, pd.Timestamp(due, unit="ms")))
                    times = []
                break
            if len(times) < len(held):
                left[name] = times
            if times:
                oldest = times[0] if oldest is None else min(oldest, times[0])
        for name, times in left.items():
            self.seen.updateValue((name,), (times,))
        self._wait(runs, oldest)
        if out:
            yield pd.DataFrame(out, columns=["source", "id", "expired_at"])

    def _due(self, runs: list[int], seen: int) -> int | None:
        """The run at which an id last seen then expires; None while there is no such run."""
        missed = bisect_right(runs, seen)
        if missed == len(runs):
            return None
        due = bisect_left(runs, runs[missed] + self.HOURS * 3_600_000)
        return runs[due] if due < len(runs) else None

    def _wait(self, runs: list[int], oldest: int | None) -> None:
        """Keep what is needed from the oldest sighting on, and one timer at the run that can expire it."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if oldest is None:
            self.oldest.clear()
            self.runs.put([(t,) for t in runs[-1:]])
            return
        self.oldest.update((oldest,))
        self.runs.put([(t,) for t in runs[max(0, bisect_right(runs, oldest) - 1) :]])
        due = self._due(runs, oldest)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


EXPIRED = "source string, id string, expired_at timestamp"


def stream_expiry(stream: DataFrame, buckets: int = 64, delay: str = "6 hours") -> DataFrame:
    """stream(source, run_at, healthy, id) -> (source, id, expired_at).

    A row without an id is a heartbeat: a run of the source, which goes to all of its
    buckets. A row with one is a sighting and goes to its own.
    """
    own = F.array(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    rows = stream.withWatermark("run_at", delay).withColumn("bucket", F.explode(F.when(F.col("id").isNull(), every).otherwise(own)))
    rows = rows.select("source", "bucket", "id", "healthy", F.unix_millis("run_at").alias("at"), "run_at")
    return rows.groupBy("source", "bucket").transformWithStateInPandas(Expiry(), EXPIRED, "append", "EventTime")
