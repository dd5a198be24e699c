"""The frontier and the event log on streams: keyed state with timers, watermarked dedup.

A host's queue is one key's state, a map from URL hashes to requests: adding, leasing and reporting touch single entries,
whatever waits beside them. One request is handed out whenever the host is not cooling; a timer wakes the host for the
next. A lease holds its request for a time; a report ends it if it is of the current attempt, and the third failure
gives it up. State grows with what waits, and by a hash for each URL that was ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as T
from ..operators.frontier import MAX_ATTEMPTS

LEASES = "host string, hash string, url string, depth int, score double, attempt int, leased_ms long"
#: What is first in line, by policy: of depth, score, time of discovery and hash.
_ORDERS = {"priority": lambda d, s, t, h: (-s, t, h), "breadth": lambda d, s, t, h: (d, t, h), "depth": lambda d, s, t, h: (-d, -t, [-ord(c) for c in h])}


class _Host(StatefulProcessor):
    def __init__(self, policy: str, rate_ms: int, hold_ms: int):
        self.policy, self.rate_ms, self.hold_ms = policy, rate_ms, hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "hash string", "seen boolean")
        self.waiting = handle.getMapState("waiting", "hash string", "url string, depth int, score double, found long, ready long, attempts int")
        self.free = handle.getValueState("free", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for r in batch.itertuples():
                if r.reported:
                    self._report(r.hash, int(r.attempt), bool(r.ok))
                elif not self.known.containsKey((r.hash,)):
                    self.known.updateValue((r.hash,), (True,))
                    self.waiting.updateValue((r.hash,), (r.url, int(r.depth), float(r.score), int(r.found), 0, 0))
        yield from self._hand_out(key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._hand_out(key, timerValues.getCurrentProcessingTimeInMs())

    def _report(self, hash_: str, attempt: int, ok: bool) -> None:
        if not self.waiting.containsKey((hash_,)):
            return
        *rest, _, attempts = self.waiting.getValue((hash_,))
        if attempt != attempts:
            return
        if ok or attempts >= MAX_ATTEMPTS:
            self.waiting.removeKey((hash_,))
        else:
            self.waiting.updateValue((hash_,), (*rest, 0, attempts))

    def _hand_out(self, key, now: int) -> Iterator[pd.DataFrame]:
        free_at = self.free.get()[0] if self.free.exists() else 0
        order, out, later = _ORDERS[self.policy], [], []
        ready, free_of = [], 0
        for (hash_,), (url, depth, score, found, at, attempts) in self.waiting.iterator():
            if at > now:
                later.append(at)
                continue
            free_of += 1
            if self.rate_ms <= 0 or not ready or order(depth, score, found, hash_) < ready[0][0]:  # with a pause only the first counts
                ready = [*(ready if self.rate_ms <= 0 else []), (order(depth, score, found, hash_), hash_, url, depth, score, found, attempts)]
        if free_at <= now:
            for _, hash_, url, depth, score, found, attempts in sorted(ready):
                out.append((key[0], hash_, url, depth, score, attempts + 1, now))
                self.waiting.updateValue((hash_,), (url, depth, score, found, now + self.hold_ms, attempts + 1))
                later.append(now + self.hold_ms)
                free_at = now + max(0, self.rate_ms)
            self.free.update((free_at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if free_of > len(out):
            later.append(now)
        if later:
            self.handle.registerTimer(max(now + 1, free_at, min(later)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in LEASES.split(", ")])


def leases(requests: DataFrame, policy: str = "priority", rate_ms: int = 1000, reports: DataFrame | None = None, hold_ms: int = 300_000) -> DataFrame:
    """A stream of requests (host, hash, url, depth, score, discovered) as a stream of leases, each host's at least rate_ms apart. reports: a stream of host, hash, attempt, ok."""
    if policy not in _ORDERS:
        raise ValueError(f"no policy {policy!r} on streams; there are {', '.join(sorted(_ORDERS))}")
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.select("host", "hash", "url", "depth", "score", F.unix_micros("discovered").alias("found"), F.lit(False).alias("reported"), F.lit(0).alias("attempt"), F.lit(False).alias("ok"))
    if reports is not None:
        nothing = {"url": "string", "depth": "int", "score": "double", "found": "long"}
        rows = rows.unionByName(reports.select("host", "hash", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit(True).alias("reported"), F.col("attempt").cast("int").alias("attempt"), "ok"))
    return rows.groupBy("host").transformWithStateInPandas(_Host(policy, rate_ms, hold_ms), LEASES, "append", "processingTime")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of events, each identity once while its watermark stands."""
    rows = events.withColumn("id", T.event_id(F.col("name"), F.col("tags"), F.col("at")))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


def upsert_batches(path: str):
    """For writeStream.foreachBatch: each batch is appended below `path`; readers merge with events.upsert, so that a batch written twice changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
