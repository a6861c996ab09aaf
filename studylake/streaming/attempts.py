"""Attempt logs as streams (N1-N5). Each stream has a batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def exactly_once(answers: DataFrame, delay: str = "1 day") -> DataFrame:
    """One answer for each session and question; a repeated one is dropped while it can still come.

    On a stream state is kept for the delay only; in batch the first answer by time and id stays.
    """
    if answers.isStreaming:
        return answers.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["session_id", "question_id"])
    place = F.row_number().over(Window.partitionBy("session_id", "question_id").orderBy("created_at", "id"))
    return answers.withColumn("__k", place).where("__k = 1").drop("__k")


def in_time(answers: DataFrame) -> DataFrame:
    """Answers before their session's deadline, and a mark on those at or after it."""
    return answers.withColumn("late", F.col("created_at") >= F.col("deadline"))


SESSION = "session_id long, answered int, skipped int, discarded int, state string, last_at timestamp"
_STATE = "answered int, skipped int, discarded int, state string, last_us long, deadline_ms long"


class SessionFold(StatefulProcessor):
    """A session's counts in a value state, its answered questions in a map state, and a timer at its deadline: a
    session whose deadline passes is told as expired, whether answers come or not."""

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", _STATE)
        self.seen = handle.getMapState("seen", "question_id long", "at long")

    def _row(self, key: tuple) -> pd.DataFrame:
        answered, skipped, discarded, state, last_us, _ = self.fold.get()
        last = pd.Series([last_us], dtype="Int64")
        return pd.DataFrame({"session_id": [key[0]], "answered": [answered], "skipped": [skipped], "discarded": [discarded], "state": [state], "last_us": last})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = not self.fold.exists()
        answered, skipped, discarded, state, last_us, deadline_ms = (0, 0, 0, "answering", None, None) if fresh else self.fold.get()
        batch = pd.concat(list(rows)).sort_values(["created_us", "id"])
        for row in batch.itertuples():
            before, deadline_ms = deadline_ms, int(row.deadline_ms)
            if before != deadline_ms and state == "answering":
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(deadline_ms)
            late = row.created_us >= row.deadline_ms * 1000
            if state != "answering" or late or self.seen.containsKey((int(row.question_id),)):
                discarded += 1
                state = "time_expired" if late and state == "answering" else state
                continue
            self.seen.updateValue((int(row.question_id),), (int(row.created_us),))
            gone = row.status == "skipped"
            skipped, answered, last_us = skipped + int(gone), answered + int(not gone), int(row.created_us)
            if answered + skipped >= self.target:
                state = "completed"
        self.fold.update((answered, skipped, discarded, state, last_us, deadline_ms))
        yield self._row(key)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        answered, skipped, discarded, state, last_us, deadline_ms = self.fold.get()
        if state == "answering":
            self.fold.update((answered, skipped, discarded, "time_expired", last_us, deadline_ms))
            yield self._row(key)

    def close(self) -> None:
        pass


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_sessions(answers: DataFrame, target: int, delay: str = "1 hour", now: str | None = None) -> DataFrame:
    """The state of each session from its answers (session_id, id, question_id, status, created_at, deadline): answers to new
    questions before the deadline count, others are discarded; a session is completed at `target` answers and
    time_expired once its deadline has passed: by an answer at or after it, or by the clock.

    In batch one row for each session, the clock standing at `now` if it is given. On a stream a row whenever a session
    changes; the clock is the watermark, `delay` behind the latest answer of any session. Streams keep their state in
    RocksDB, so spark.sql.streaming.stateStore.providerClass has to name its provider.
    """
    if not answers.isStreaming:
        rows = exactly_once(answers.where("created_at < deadline"))
        place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id"))
        counted = rows.withColumn("k", place).where(F.col("k") <= target).groupBy("session_id").agg(
            F.count_if(F.col("status") != "skipped").alias("answered"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.max("created_at").alias("last_at")
        )
        passed = F.bool_or(F.col("created_at") >= F.col("deadline"))
        if now is not None:
            passed = passed | (F.max("deadline").cast("timestamp") <= F.lit(now).cast("timestamp"))
        every = answers.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), passed.alias("passed"))
        joined = every.join(counted, "session_id", "left").withColumn("answered", F.coalesce("answered", F.lit(0))).withColumn("skipped", F.coalesce("skipped", F.lit(0)))
        done = F.col("answered") + F.col("skipped")
        state = F.when(done >= target, "completed").when(F.col("passed"), "time_expired").otherwise("answering")
        return joined.select("session_id", F.col("answered").cast("int"), F.col("skipped").cast("int"), (F.col("n") - done).cast("int").alias("discarded"), state.alias("state"), "last_at")

    if answers.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS_DB:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass has to be {ROCKS_DB}")
    rows = answers.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    rows = rows.select("session_id", "id", "question_id", "status", "created_at", F.unix_micros("created_at").alias("created_us"), F.unix_millis(F.col("deadline").cast("timestamp")).alias("deadline_ms"))
    out = "session_id long, answered int, skipped int, discarded int, state string, last_us long"
    folded = rows.groupBy("session_id").transformWithStateInPandas(SessionFold(target), out, "Update", "EventTime")
    return folded.select("session_id", "answered", "skipped", "discarded", "state", F.timestamp_micros("last_us").alias("last_at"))


def daily_failures(answers: DataFrame, below: float = 3, delay: str = "2 days") -> DataFrame:
    """Assessed answers and failures of each day, subject and learner."""
    rows = answers.withWatermark("created_at", delay) if answers.isStreaming else answers
    assessed = rows.where("score IS NOT NULL")
    grouped = assessed.groupBy(F.window("created_at", "1 day"), "user_id", "subject_id").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("score") < below).alias("failed"))
    return grouped.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "user_id", "subject_id", "answers", "failed")


def metric_minutes(metrics: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Calls, mean latency and prompt tokens of each minute, of calls in the schema of A11."""
    rows = metrics.withWatermark("created_at", delay) if metrics.isStreaming else metrics
    grouped = rows.groupBy(F.window("created_at", "1 minute")).agg(F.count(F.lit(1)).alias("calls"), F.avg("latency_ms").alias("mean_latency_ms"), F.sum("prompt_tokens").alias("prompt_tokens"))
    return grouped.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("minute"), "calls", "mean_latency_ms", "prompt_tokens")
