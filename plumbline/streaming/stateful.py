"""State per key with an expiry: the latest progress of every run, dropped when it is too old.

An entry expires when the newest entry of the whole stream is ``ttl_seconds`` or more ahead of it. The watermark follows the
newest entry at that distance, so an entry that comes too late to be taken is one that would have expired, and the result
does not depend on how the input is cut into files and batches. State is one entry per live run. Every call to the state
store costs a worker more than a row does, so the entries of a bucket of runs are one list with one timer: it is read and
written once per batch that has rows for it. The RocksDB state store keeps it on disk beyond what fits into memory.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
ENTRY = "version_ord long, at_us long, status string, error_message string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_progress(changes: DataFrame, ttl_seconds: int = 86400, buckets: int = BUCKETS) -> DataFrame:
    """Entries as they become the latest of their run, and once more with ``expired`` when they are dropped; update mode.

    ``changes`` has ``run_id``, ``version_ord``, ``changed_at``, ``status`` and ``error_message``. Among equal times the
    higher ``version_ord`` is the later. Expiry counts in whole milliseconds. A worker holds the live runs of one of the
    ``buckets``, and every batch writes those of the buckets it has rows for: more buckets suit more live runs, fewer suit
    large batches. The number is part of a stream's checkpoint.
    """
    # Defined here, so that workers get the class with the plan and need not import this package.
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    kind = dict(changes.dtypes)["run_id"]
    names = [part.split()[0] for part in ENTRY.split(", ")]

    def place(entry: tuple) -> tuple:
        return entry[1], entry[0]

    class LatestProgress(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.live = handle.getListState("live", f"run_id {kind}, {ENTRY}")

        def keep(self, live: dict) -> None:
            if live:
                self.live.put([(run, *entry) for run, entry in live.items()])
            else:
                self.live.clear()

        def wake(self, live: dict, reached: int) -> None:
            """A timer for when the watermark reaches the oldest entry; one that comes too early does no harm."""
            if live:
                oldest = min(entry[1] for entry in live.values()) // 1000
                if oldest < min((t for t in self.handle.listTimers() if t > reached), default=oldest + 1):
                    self.handle.registerTimer(oldest)

        def handleInputRows(self, key, rows, timerValues):
            live = {entry[0]: tuple(entry[1:]) for entry in self.live.get()}
            changed = set()
            for r in rows:
                run, entry = r[1], tuple(r[3:])
                if run not in live or place(entry) > place(live[run]):
                    live[run] = entry
                    changed.add(run)
            if changed:
                self.keep(live)
                self.wake(live, timerValues.getCurrentWatermarkInMs())
            for run in changed:
                yield Row(run_id=run, **dict(zip(names, live[run], strict=True)), expired=False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            reached = timerValues.getCurrentWatermarkInMs()
            live, old = {}, {}
            for run, *entry in self.live.get():
                (old if entry[1] // 1000 <= reached else live)[run] = tuple(entry)
            if old:
                self.keep(live)
            self.wake(live, reached)
            for run, entry in old.items():
                yield Row(run_id=run, **dict(zip(names, entry, strict=True)), expired=True)

        def close(self) -> None:
            pass

    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Workers read these by place.
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket")
    rows = changes.withColumn("at_us", F.unix_micros("changed_at")).select(bucket, "run_id", "changed_at", *names)
    rows = rows.withWatermark("changed_at", f"{int(ttl_seconds)} seconds")
    latest = rows.groupBy("bucket").transformWithState(LatestProgress(), f"run_id {kind}, {ENTRY}, expired boolean", "update", "eventTime")
    return latest.select("run_id", "version_ord", F.timestamp_micros("at_us").alias("changed_at"), "status", "error_message", "expired")
