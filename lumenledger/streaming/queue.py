"""The job queue as keyed state: jobs wait in a lane, at most so many of a lane are processed at a time, leases run out.

Events (lane, id, kind, at, ssim_score, error) of kinds ``submitted`` and ``finished`` come as a stream.  A lane's state is a first-in-first-out
queue of waiting ids and the ids being processed; transitions come out as rows: pending -> processing -> completed, quality_warning or
failed.  A job whose worker doesn't report within its lease of event time fails by a timer, and its place goes to the next in line.

State is kept by Spark's RocksDB store under the query's checkpoint: after a lost executor or a restart the stream goes on from the last
batch that was committed, and ``run`` writes a batch's transitions under the batch's number, so none is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumenledger.operators import commits, mutate
from lumenledger.operators.mutate import MESSAGE_CHARS
from lumenledger.streaming.jobs import SSIM_FLOOR, outcome

EVENTS = "lane string, id string, kind string, at timestamp, ssim_score double, error string"
TRANSITIONS = "lane string, id string, status string, at timestamp, waited_ms long, processing_time_ms long, error_message string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TIMED_OUT = "lease ran out"


class Lane(StatefulProcessor):
    """The state of one lane.

    Ids that wait are kept by a running number, so the next in line is found without reading the others.  An id that waits or
    is processed can't be submitted again; a report on an id that isn't processed changes nothing.
    """

    def __init__(self, at_most: int, lease_ms: int):
        self.at_most, self.lease_ms = at_most, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "head long, tail long, running int")
        self.line = handle.getMapState("line", "number long", "id string, at long")
        self.waiting = handle.getMapState("waiting", "id string", "number long")
        self.busy = handle.getMapState("busy", "id string", "since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail, running = self.ends.get() if self.ends.exists() else (0, 0, 0)
        for frame in rows:
            out: list[tuple] = []
            for job, kind, at, ssim, error in zip(frame["id"], frame["kind"], frame["at"], frame["ssim_score"], frame["error"]):
                if job is None or pd.isna(at):
                    continue
                at = _ms(at)
                since = self.busy.getValue((job,))[0] if self.busy.containsKey((job,)) else None
                if kind == "submitted" and since is None and not self.waiting.containsKey((job,)):
                    self.line.updateValue((tail,), (job, at))
                    self.waiting.updateValue((job,), (tail,))
                    tail += 1
                    out.append((key[0], job, "pending", at, None, None, None))
                elif kind == "finished" and since is not None:
                    self.busy.removeKey((job,))
                    running -= 1
                    out.append((key[0], job, *_ended(ssim, error, at, since)))
                head, tail, running = self._start(key[0], at, head, tail, running, out)
            yield _frame(out)
        self.ends.update((head, tail, running))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, tail, running = self.ends.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        out: list[tuple] = []
        # only what is processed is read, at most ``at_most`` ids; timers of jobs that have ended find nothing
        late = sorted((job, since) for (job,), (since,) in self.busy.iterator() if since + self.lease_ms <= now)
        for job, since in late:
            self.busy.removeKey((job,))
            running -= 1
            out.append((key[0], job, "failed", now, None, now - since, TIMED_OUT))
        head, tail, running = self._start(key[0], now, head, tail, running, out)
        self.ends.update((head, tail, running))
        yield _frame(out)

    def _start(self, lane: str, now: int, head: int, tail: int, running: int, out: list[tuple]) -> tuple[int, int, int]:
        """Give free places to the next in line."""
        while running < self.at_most and head < tail:
            job, since = self.line.getValue((head,))
            self.line.removeKey((head,))
            self.waiting.removeKey((job,))
            head, running = head + 1, running + 1
            begun = max(now, since)
            self.busy.updateValue((job,), (begun,))
            self.handle.registerTimer(begun + self.lease_ms)
            out.append((lane, job, "processing", begun, begun - since, None, None))
        return head, tail, running


def _ms(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


def _ended(ssim: float | None, error: str | None, at: int, since: int) -> tuple:
    broken = isinstance(error, str)
    low = ssim is not None and not pd.isna(ssim) and ssim < SSIM_FLOOR
    return "failed" if broken else "quality_warning" if low else "completed", at, None, at - since, error[:MESSAGE_CHARS] if broken else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["lane", "id", "status", "at", "waited_ms", "processing_time_ms", "error_message"])
    out["at"] = pd.to_datetime(out["at"], unit="ms")
    for c in ("waited_ms", "processing_time_ms"):
        out[c] = out[c].astype("Int64")
    return out


def transitions(events: DataFrame, at_most: int = 1, lease: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """The transitions of a stream of EVENTS, at most ``at_most`` jobs of a lane at a time; events of a lane count in the order they come."""
    lease_ms = int(pd.Timedelta(lease).total_seconds() * 1000)
    seen = events.withWatermark("at", lateness)
    return seen.groupBy("lane").transformWithStateInPandas(Lane(at_most, lease_ms), outputStructType=TRANSITIONS, outputMode="Append", timeMode="EventTime")


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, at_most: int = 1, lease: str = "1 hour", lateness: str = "10 minutes", files: int = 1000, once: bool = True) -> StreamingQuery:
    """Watch a folder of Parquet files of events; each batch's transitions go to a folder of its own of ``sink``.

    A batch that is tried again overwrites its folder.  ``files`` bounds a batch.
    """
    key, provider = STATE_STORE
    if spark.conf.get(key, None) != provider:
        raise ValueError(f"keyed state with timers needs {key}={provider}")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(source)
    writer = transitions(events, at_most, lease, lateness).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def statuses(log: DataFrame) -> DataFrame:
    """The last status of every job of a log of transitions: id, lane, status, at, error_message."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "processing", 1).otherwise(2)
    last = log.groupBy("id").agg(F.max(F.struct("at", rank.alias("rank"), "lane", "status", "error_message")).alias("s"))
    return last.select("id", "s.lane", "s.status", "s.at", "s.error_message")


def into_ledger(spark: SparkSession, root: str, log: DataFrame) -> int:
    """Commit the last statuses of a log of transitions to the images under ``root``; the version's number.

    Statuses and messages only: applied again they change nothing, so a run that was cut off is simply repeated.
    """
    last = statuses(log).select("id", "status", "error_message")
    return commits.transact(spark, root, lambda images: mutate.overlay(images, last, "id", "status", "error_message"), action="statuses")


def schedule(jobs: DataFrame) -> DataFrame:
    """When each job of a table begins and ends if a lane works one at a time, first come first served: the queue in one pass.

    Columns lane, id, submitted_ms, work_ms, ssim_score, error.  A job begins when it is there and the one before has ended, so the k-th ends
    at the largest, over j up to k, of submitted_j plus all work from j to k: a running sum and a running maximum.
    """
    line = Window.partitionBy("lane").orderBy("submitted_ms", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = jobs.withColumn("_sum", F.sum("work_ms").over(line))
    ended = F.col("_sum") + F.max(F.col("submitted_ms") - F.col("_sum") + F.col("work_ms")).over(line)
    done = summed.withColumn("ended_ms", ended).withColumn("begun_ms", F.col("ended_ms") - F.col("work_ms"))
    return done.select("lane", "id", "submitted_ms", "begun_ms", "ended_ms", (F.col("begun_ms") - F.col("submitted_ms")).alias("waited_ms"), outcome(F.col("ssim_score"), F.col("error")).alias("status"))
