"""Micro-batch jobs drain what is there once, and only once."""

from pathlib import Path

from pyspark.sql import functions as F

from clausewise.operators import catalog, monitoring
from clausewise.streaming import delivery, jobs


def test_hourly_outcomes_are_written_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 300).alias("ts"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"))
    rows.write.parquet(source)
    for _ in range(2):
        jobs.run_once(jobs.hourly_outcomes(jobs.observations(spark, source)), target, mark).awaitTermination(120)
    done = spark.read.parquet(target)
    assert done.count() == done.select("hour", "source_id").distinct().count() > 0
    assert 0 < done.agg(F.sum("attempts")).first()[0] <= 200


def test_deliveries_to_retry_reach_the_channel(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, "failed"), (2, 1, 1, "sent"), (3, 1, 5, "failed")], "alert_id long, subscription_id long, attempt int, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("alert_id long, subscription_id long, attempt int, status string").parquet(str(tmp_path / "in"))
    sent = []
    jobs.deliver(stream, lambda df: sent.extend(r.alert_id for r in df.collect()), str(tmp_path / "mark")).awaitTermination(120)
    assert sent == [1]


REQUESTS = [(1, 1, "in_app", None), (1, 2, "webhook", "https://ok"), (1, 3, "webhook", "https://down"), (1, 4, "webhook", " "), (1, 5, "email", "a@b"), (1, 6, "fax", "1"), (1, 7, "webhook", "https://third")]


def sent_to(folder):
    def sink(destination, message):
        with open(f"{folder}/{message['alert_id']}-{message['subscription_id']}-{message['attempt']}", "a") as f:
            f.write("x")
        if destination.endswith("down") or (destination.endswith("third") and message["attempt"] < 3):
            raise delivery.Refused("receiver returned 503")

    return sink


def test_deliveries_retry_by_timers_until_sent_or_exhausted(spark, tmp_path):
    source, target, mark, calls = (str(tmp_path / n) for n in ("in", "out", "mark", "calls"))
    Path(calls).mkdir()
    start = 1_700_000_000
    rows = lambda found: spark.createDataFrame(found, "alert_id long, subscription_id long, channel string, destination string, s long").withColumn("asked_at", F.timestamp_seconds("s")).drop("s")
    rows([(*r, start) for r in REQUESTS]).coalesce(1).write.parquet(source)
    stream = lambda: delivery.attempts(spark.readStream.schema(delivery.REQUEST).parquet(source), delivery.channels(sent_to(calls)))
    # other alerts, asked for later, move the clock; each of them is a delivery of its own
    for k in range(9):
        delivery.drained(stream(), target, mark).awaitTermination(300)
        rows([(100 + k, 1, "in_app", None, start + 86_400 * (k + 1))]).coalesce(1).write.mode("append").parquet(source)
    log = sorted((r.subscription_id, r.attempt, r.status, r.error) for r in spark.read.parquet(target).where("alert_id = 1").collect())
    by = {s: [(a, st) for x, a, st, _ in log if x == s] for s in range(1, 8)}
    assert by[1] == by[2] == [(1, "sent")]
    assert by[3] == by[4] == by[5] == by[6] == [(k, "failed") for k in range(1, 6)]
    assert by[7] == [(1, "failed"), (2, "failed"), (3, "sent")]
    assert {e for s, _, _, e in log if s == 5} == {"email delivery is not configured"} and {e for s, _, _, e in log if s == 6} == {"no channel implementation for fax"}
    waits = sorted((r.attempt, (r.next_retry_at - r.attempted_at).total_seconds()) for r in spark.read.parquet(target).where("alert_id = 1 AND subscription_id = 3 AND next_retry_at IS NOT NULL").collect())
    assert waits == [(1, 60), (2, 120), (3, 240), (4, 480)]
    # the log is what the batch rule reads
    states = {r.subscription_id: r.state for r in monitoring.delivery_state(spark.read.parquet(target).where("alert_id = 1")).collect()}
    assert states == {1: "done", 2: "done", 3: "exhausted", 4: "exhausted", 5: "exhausted", 6: "exhausted", 7: "done"}
    assert {f.name for f in Path(calls).glob("1-3-*")} == {f"1-3-{k}" for k in range(1, 6)}


def test_streamed_states_equal_the_batch_rule(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(400).select((F.col("id") % 37).alias("alert_id"), (F.col("id") % 3).alias("subscription_id"), (F.col("id") % 7).cast("int").alias("attempt"), F.when(F.col("id") % 11 == 0, "sent").otherwise("failed").alias("status"))
    for k in range(3):
        rows.where(f"pmod(hash(alert_id, attempt), 3) = {k}").coalesce(1).write.mode("append").parquet(source)
        delivery.drained(delivery.states(spark.readStream.schema(rows.schema).parquet(source)), target, mark, "update").awaitTermination(300)
    names = ["alert_id", "subscription_id", "n", "state", "wait"]
    got, want = (sorted(map(tuple, df.select(*names).collect()), key=str) for df in (delivery.newest_states(spark.read.parquet(target)), monitoring.delivery_state(rows)))
    assert got == want


def test_streaks_run_on_over_batches(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.range(120).select(F.col("id").alias("observation_id"), (F.col("id") % 4).alias("source_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("fetched_at"), F.when(F.col("id") % 9 < 7, "error").otherwise("ok").alias("outcome"))
    for k in range(3):
        rows.where(F.floor(F.col("observation_id") / 40) == k).write.mode("append").parquet(source)
        delivery.drained(delivery.streaks(spark.readStream.schema(rows.schema).parquet(source)), target, mark).awaitTermination(300)
    got, want = ({r.observation_id: r.failures for r in df.collect()} for df in (spark.read.parquet(target), catalog.failure_streak(rows)))
    assert got == want
