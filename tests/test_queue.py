"""The queue as keyed state: order, limits, leases, and a restart between batches."""

import datetime as dt

import pytest

from lumenledger.operators import commits
from lumenledger.streaming import queue

START = dt.datetime(2024, 1, 1)


def event(lane, job, kind, minute, ssim=None, error=None):
    return lane, job, kind, START + dt.timedelta(minutes=minute), ssim, error


BATCHES = [
    [event("x", "a", "submitted", 0), event("x", "b", "submitted", 1), event("x", "c", "submitted", 1), event("y", "d", "submitted", 1), event("x", "a", "submitted", 2)],
    [event("x", "a", "finished", 5, 0.97), event("y", "d", "finished", 6, 0.5), event("x", "nobody", "finished", 6), event("x", None, "submitted", 6)],
    [event("x", "b", "finished", 9, None, "no face" * 100), event("y", "e", "submitted", 10)],
    [event("z", "f", "submitted", 500)],  # hours later: leases have run out
    [event("z", "g", "submitted", 501)],
]
WANT = {
    ("a", "pending", 0), ("a", "processing", 0), ("a", "completed", 5), ("b", "pending", 1), ("b", "processing", 5), ("b", "failed", 9), ("c", "pending", 1), ("c", "processing", 9),
    ("c", "failed", 69), ("d", "pending", 1), ("d", "processing", 1), ("d", "quality_warning", 6), ("e", "pending", 10), ("e", "processing", 10), ("e", "failed", 70),
    ("f", "pending", 500), ("f", "processing", 500), ("g", "pending", 501),
}


@pytest.fixture
def stateful(spark):
    key, provider = queue.STATE_STORE
    spark.conf.set(key, provider)
    yield spark
    spark.conf.unset(key)


def put(spark, root, n):
    spark.createDataFrame(BATCHES[n], queue.EVENTS).coalesce(1).write.parquet(f"{root}/events/batch={n}")


def work(spark, root, name, **options):
    queue.run(spark, f"{root}/events/*", f"{root}/{name}", f"{root}/checkpoint-{name}", files=1, **options).awaitTermination()


def log(spark, root, name):
    return spark.read.parquet(f"{root}/{name}")


def seen(df):
    return sorted((r["id"], r["status"], int((r["at"] - START).total_seconds() // 60)) for r in df.collect())


def test_queue(stateful, tmp_path):
    root = str(tmp_path)
    for n in range(len(BATCHES)):
        put(stateful, root, n)
    work(stateful, root, "whole")
    got = log(stateful, root, "whole")
    assert seen(got) == sorted(WANT)
    rows = {(r["id"], r["status"]): r for r in got.collect()}
    assert rows["b", "processing"]["waited_ms"] == 4 * 60_000 and rows["b", "failed"]["processing_time_ms"] == 4 * 60_000
    assert len(rows["b", "failed"]["error_message"]) == 500 and rows["e", "failed"]["error_message"] == queue.TIMED_OUT
    last = {r["id"]: r["status"] for r in queue.statuses(got).collect()}
    assert last == {"a": "completed", "b": "failed", "c": "failed", "d": "quality_warning", "e": "failed", "f": "processing", "g": "pending"}

    # the ledger shows what the log says last, also if it is told twice
    images = str(tmp_path / "images")
    rows = [(x, "pending", None) for x in "abcdefg"] + [("other", "completed", None)]
    commits.publish(stateful.createDataFrame(rows, "id string, status string, error_message string"), images)
    assert [queue.into_ledger(stateful, images, got) for _ in range(2)] == [2, 3]
    shown = {r["id"]: r["status"] for r in commits.read(stateful, images).collect()}
    assert shown == {**last, "other": "completed"}

    # the same events with a restart from the checkpoint after every batch, and one killed between batches
    other = str(tmp_path / "again")
    for n in range(len(BATCHES)):
        put(stateful, other, n)
        if n == 2:
            running = queue.run(stateful, f"{other}/events/*", f"{other}/parts", f"{other}/checkpoint-parts", files=1, once=False)
            running.processAllAvailable()
            running.stop()
        else:
            work(stateful, other, "parts")
    assert seen(log(stateful, other, "parts")) == sorted(WANT)


def test_two_at_a_time(stateful, tmp_path):
    root = str(tmp_path)
    for n in range(2):
        put(stateful, root, n)
    work(stateful, root, "two", at_most=2)
    got = seen(log(stateful, root, "two").where("status = 'processing'"))
    assert got == [("a", "processing", 0), ("b", "processing", 1), ("c", "processing", 5), ("d", "processing", 1)]


def test_queue_needs_its_state_store(spark, tmp_path):
    spark.conf.unset(queue.STATE_STORE[0])
    with pytest.raises(ValueError, match="stateStore"):
        queue.run(spark, str(tmp_path), str(tmp_path), str(tmp_path))


def test_schedule(spark):
    """Against a loop over jobs."""
    import random

    rng = random.Random(3)
    jobs = [(f"l{rng.randrange(3)}", i, rng.randrange(50), rng.randrange(1, 20), 0.9 + rng.random() / 10, None) for i in range(60)]
    free, want = {}, {}
    for lane, i, at, work_ms, _, _ in sorted(jobs, key=lambda j: (j[2], j[1])):
        begun = max(at, free.get(lane, 0))
        free[lane] = begun + work_ms
        want[i] = (begun, begun + work_ms)
    got = queue.schedule(spark.createDataFrame(jobs, "lane string, id long, submitted_ms long, work_ms long, ssim_score double, error string"))
    assert {r["id"]: (r["begun_ms"], r["ended_ms"]) for r in got.collect()} == want
