"""Alert delivery as a stateful stream: one state for each alert and subscription, retries by timers.

A delivery is asked for once; its key then has a number of attempts and whether it was sent.  An attempt goes through the
subscription's channel: in-app is the record itself and cannot fail, email is declared and refuses, a webhook needs a
destination and hands the message to a sink.  A failure sets a timer (twice the wait each time, up to a cap) that makes the next attempt;
after five the delivery is exhausted.  Every attempt is a row of the result, the log from which alerts take their status.

Timers follow event time: they fire when the watermark has passed them, so a replayed batch finds the same state and makes the same
attempts under the same numbers.  A sink gets (alert, subscription, attempt), by which a receiver tells a repetition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from clausewise.constants import BACKOFF_BASE, BACKOFF_CAP, DELIVERY_ATTEMPTS

#: The store that timers and typed state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ERROR_CHARS = 512
REQUEST = "alert_id long, subscription_id long, channel string, destination string, asked_at timestamp"
ATTEMPT = "alert_id long, subscription_id long, channel string, attempt int, status string, error string, attempted_at timestamp, next_retry_at timestamp"


class Refused(RuntimeError):
    """A delivery that failed in a way worth another attempt."""


class Sink(Protocol):
    """Takes a message to its receiver, or raises ``Refused``."""

    def __call__(self, destination: str, message: dict[str, Any]) -> None: ...


def in_app(destination: str | None, message: dict[str, Any]) -> None:
    """The record of the attempt is the delivery."""


def email(destination: str | None, message: dict[str, Any]) -> None:
    raise Refused("email delivery is not configured")


def webhook(sink: Sink) -> Callable[[str | None, dict[str, Any]], None]:
    def send(destination: str | None, message: dict[str, Any]) -> None:
        if not (destination or "").strip():
            raise Refused("webhook subscription has no destination")
        sink(destination, message)

    return send


def channels(sink: Sink) -> dict[str, Callable[[str | None, dict[str, Any]], None]]:
    return {"in_app": in_app, "email": email, "webhook": webhook(sink)}


def wait_seconds(attempt: int) -> int:
    """Seconds to wait behind a failed attempt."""
    return int(min(BACKOFF_BASE * 2 ** max(0, attempt - 1), BACKOFF_CAP))


class Deliveries(StatefulProcessor):
    """Attempts of one (alert_id, subscription_id), the first as soon as it is asked for."""

    def __init__(self, ways: dict[str, Callable[[str | None, dict[str, Any]], None]]):
        self.ways = ways

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "channel string, destination string, attempts int, sent boolean")

    def _attempt(self, key: tuple, channel: str, destination: str | None, attempt: int, at: datetime) -> Row:
        error = None
        try:
            if channel not in self.ways:
                raise Refused(f"no channel implementation for {channel}")
            self.ways[channel](destination, {"alert_id": key[0], "subscription_id": key[1], "attempt": attempt})
        except Refused as e:
            error = str(e)[:ERROR_CHARS]
        retry = None
        if error is not None and attempt < DELIVERY_ATTEMPTS:
            retry = at + timedelta(seconds=wait_seconds(attempt))
            self.handle.registerTimer(int(retry.replace(tzinfo=timezone.utc).timestamp() * 1000))
        self.progress.update((channel, destination, attempt, error is None))
        return Row(alert_id=key[0], subscription_id=key[1], channel=channel, attempt=attempt, status="sent" if error is None else "failed", error=error, attempted_at=at, next_retry_at=retry)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = min(rows, key=lambda r: r.asked_at)
        # asked for again: what was sent stays sent, and what is waiting waits for its timer
        if not self.progress.exists():
            yield self._attempt(tuple(key), first.channel, first.destination, 1, first.asked_at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        channel, destination, attempts, sent = self.progress.get()
        if not sent and attempts < DELIVERY_ATTEMPTS:
            due = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc).replace(tzinfo=None)
            yield self._attempt(tuple(key), channel, destination, attempts + 1, due)

    def close(self) -> None:
        pass


class Streaks(StatefulProcessor):
    """Errors in a row of one source: one more with each error, none after a success."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.failures.get()[0] if self.failures.exists() else 0
        for r in sorted(rows, key=lambda r: (r.fetched_at, r.observation_id)):
            n = n + 1 if r.outcome == "error" else 0
            yield Row(observation_id=r.observation_id, source_id=r.source_id, failures=n)
        self.failures.update((n,))

    def close(self) -> None:
        pass


class States(StatefulProcessor):
    """Where each delivery of an attempt log stands: done once sent, exhausted after the last attempt, else waiting for the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n int, sent boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, sent = self.seen.get() if self.seen.exists() else (0, False)
        for r in rows:
            n, sent = max(n, r.attempt), sent or r.status == "sent"
        self.seen.update((n, sent))
        state = "done" if sent else "exhausted" if n >= DELIVERY_ATTEMPTS else "retry"
        yield Row(alert_id=key[0], subscription_id=key[1], n=n, state=state, wait=wait_seconds(n) if state == "retry" else None)

    def close(self) -> None:
        pass


def needs_store(spark: SparkSession) -> None:
    """Stateful streams of this module keep their state in RocksDB; the setting holds for streams that start later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def attempts(requests: DataFrame, ways: dict[str, Callable[[str | None, dict[str, Any]], None]], late: str = "0 seconds") -> DataFrame:
    """The attempt log (``ATTEMPT``) of a stream of requests (``REQUEST``)."""
    needs_store(requests.sparkSession)
    keyed = requests.withWatermark("asked_at", late).groupBy("alert_id", "subscription_id")
    return keyed.transformWithState(Deliveries(ways), ATTEMPT, "Append", "EventTime")


def streaks(observations: DataFrame) -> DataFrame:
    """observation_id, source_id, failures of a stream of observations (observation_id, source_id, fetched_at, outcome)."""
    needs_store(observations.sparkSession)
    return observations.groupBy("source_id").transformWithState(Streaks(), "observation_id long, source_id long, failures int", "Append", "None")


def states(log: DataFrame) -> DataFrame:
    """alert_id, subscription_id, n, state, wait of a stream of attempts, once for each batch that touches a delivery."""
    needs_store(log.sparkSession)
    return log.groupBy("alert_id", "subscription_id").transformWithState(States(), "alert_id long, subscription_id long, n int, state string, wait long", "Update", "None")


def newest_states(batches: DataFrame) -> DataFrame:
    """The last word on each delivery among rows of ``states``: attempts only grow, and done is final."""
    order = F.struct((F.col("state") == "done").alias("done"), "n")
    return batches.groupBy("alert_id", "subscription_id").agg(F.max_by(F.struct("n", "state", "wait"), order).alias("x")).select("alert_id", "subscription_id", "x.*")


def drained(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop.  A batch replaces its own folder, so a batch that is run again is written once."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

