"""Live job state and audio windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.intervals import KEYS
from ..operators.jobs import job_state, step_progress
from .sink import LiveTable, latest, upsert  # noqa: F401

job_state_stream = job_state
step_progress_stream = step_progress


def throttle_stream(events: DataFrame, every: str = "300 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """The last event of each job in each window; a job's feed ends with its ``done``, which comes out at once in a stream.

    A stream keeps of each job the event that waits and whether the feed has ended, the latter for a day."""
    if not events.isStreaming:
        order = F.struct("occurred_at", "id")
        end = F.min(F.when(F.col("step") == "done", order)).over(Window.partitionBy("job_id"))
        rows = events.withColumn("_end", end).filter(F.col("_end").isNull() | (order <= F.col("_end"))).groupBy("job_id", F.window("occurred_at", every))
        return rows.agg(F.max_by("step", order).alias("step"), F.max_by("percent", order).alias("percent"), F.bool_or(F.col("step") == "done").alias("ended")).select("job_id", F.col("window.start").alias("at"), "step", "percent", "ended")

    from pyspark.sql.streaming.state import GroupStateTimeout

    import pandas as pd

    size = int(pd.Timedelta(every).total_seconds() * 1000)

    def run(key, batches, state):
        ended, at, step, percent = state.get if state.exists else (False, -1, None, None)
        out = []
        put = lambda: out.append((key[0], pd.Timestamp(at * size, unit="ms"), step, percent, ended))
        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            put()
            at = -1
        else:
            rows = pd.concat(list(batches)).sort_values(["occurred_at", "id"])
            for t, name, p in zip(rows["occurred_at"].astype("datetime64[ms]").astype("int64"), rows["step"], rows["percent"], strict=True):
                if ended or t // size < at:
                    continue
                if at >= 0 and t // size > at:
                    put()
                at, step, percent = t // size, name, None if p is None or p != p else float(p)
                if name == "done":
                    ended = True
                    put()
        state.update((ended, at, step, percent))
        if ended:
            state.setTimeoutTimestamp(max((at + 1) * size, state.getCurrentWatermarkMs()) + 86_400_000)
        elif at >= 0:
            state.setTimeoutTimestamp(max((at + 1) * size, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "at", "step", "percent", "ended"])

    rows = events.withWatermark("occurred_at", delay).select("job_id", "id", "step", "percent", "occurred_at")
    kind = f"job_id {events.schema['job_id'].dataType.simpleString()}, at timestamp, step string, percent double, ended boolean"
    return rows.groupBy("job_id").applyInPandasWithState(run, kind, "ended boolean, at long, step string, percent double", "append", GroupStateTimeout.EventTimeTimeout)


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop for being later than the watermark, by query id. Add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _rms(full: float) -> Column:
    """Squares of whole-number samples add up exactly, so that no order of rows moves a window across a limit that it just meets."""
    a = F.col("amplitude").cast("double")
    return (F.sqrt(F.avg(a * a)) / F.lit(float(full))).alias("rms")


def rms_stream(samples: DataFrame, every: str = "400 milliseconds", silence: float = 0.005, delay: str = "10 seconds", keys=KEYS, full: float = 1.0) -> DataFrame:
    """RMS of tumbling windows, and whether there is voice. Samples: ts, amplitude, of which ``full`` is full scale (100 for whole hundredths)."""
    rows = samples.withWatermark("ts", delay).groupBy(*keys, F.window("ts", every)).agg(_rms(full))
    return rows.select(*keys, F.col("window.start").alias("at"), "rms", (F.col("rms") >= silence).alias("voiced"))


def voice_windows_stream(samples: DataFrame, size: str = "1500 milliseconds", hop: str = "750 milliseconds", least: float = 0.008, delay: str = "10 seconds", keys=KEYS, full: float = 1.0) -> DataFrame:
    """Sliding windows that are loud enough. Samples as for ``rms_stream``."""
    rows = samples.withWatermark("ts", delay).groupBy(*keys, F.window("ts", size, hop)).agg(_rms(full))
    return rows.filter(F.col("rms") >= least).select(*keys, F.col("window.start").alias("at"), "rms")


def speech_sessions(labelled: DataFrame, gap: str = "3750 milliseconds", delay: str = "10 seconds", keys=KEYS) -> DataFrame:
    """Runs of windows of one label without a gap. Labelled: ts, label."""
    rows = labelled.withWatermark("ts", delay).groupBy(*keys, "label", F.session_window("ts", gap)).agg(F.count("*").alias("windows"))
    return rows.select(*keys, "label", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "windows")


def dedup_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event once, by id, within the watermark; in a batch, once at all. ``LateRows`` counts what comes too late."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["id"]) if events.isStreaming else events.dropDuplicates(["id"])


def keep_states_on_disk(spark: SparkSession) -> None:
    """State of streams that start from now on lives in RocksDB, which stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stale_jobs_stream(events: DataFrame, limit_sec: float, delay: str = "1 minute") -> DataFrame:
    """Jobs from which nothing comes for limit_sec of event time, as failed, once for each silence; a job whose newest event is ``done`` is not waited for.

    The newest event of each job is a value state, its limit a timer of event time; both come back after a restart. Needs ``keep_states_on_disk``."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    limit = int(limit_sec * 1000)

    class Silence(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.newest = handle, handle.getValueState("newest", "at long, id long")

        def handleInputRows(self, key, rows, timerValues):
            at, number = self.newest.get() if self.newest.exists() else (-1, -1)
            step = None
            for part in rows:
                part = part.assign(at=part["occurred_at"].astype("datetime64[ms]").astype("int64")).sort_values(["at", "id"])
                t, n, name = (part[c].iloc[-1] for c in ("at", "id", "step"))
                if (t, n) > (at, number):
                    at, number, step = int(t), int(n), name
            if step is not None:  # not only late rows
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.newest.update((at, number))
                if step != "done":
                    self.handle.registerTimer(max(at + limit, timerValues.getCurrentWatermarkInMs() + 1))
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at, _ = self.newest.get()
            self.newest.clear()
            yield pd.DataFrame({"job_id": [key[0]], "last": [pd.Timestamp(at, unit="ms")], "status": ["failed"], "reason": ["no event within the limit"]})

        def close(self) -> None:
            pass

    rows = events.withWatermark("occurred_at", delay).select("job_id", "id", "occurred_at", "step")
    kind = f"job_id {events.schema['job_id'].dataType.simpleString()}, last timestamp, status string, reason string"
    return rows.groupBy("job_id").transformWithStateInPandas(Silence(), kind, "append", "eventTime")
