"""Processing jobs, episodes and what they have made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import ACTIVE, SERVER_ORDER, STEPS, UI_ORDER, canonical_step
from .intervals import KEYS
from .scans import numbered


def validate_job_requests(df: DataFrame) -> DataFrame:
    """Requests (project, episode, url, local_file, diarization_provider, min_duration, max_duration, steps) with the reasons against them."""

    def name(c: str) -> Column:
        good = F.col(c).rlike(r"^[a-zA-Z0-9_\-\.]+$") & ~F.col(c).contains("..") & ~F.col(c).rlike(r"[/\\]")
        return F.when(~F.coalesce(good, F.lit(False)), f"bad {c}")

    url, least, most = F.col("url"), F.col("min_duration"), F.col("max_duration")
    reasons = F.array(
        name("project"), name("episode"), F.when(url.isNotNull() & (url != "") & ~url.rlike(r"^https?://"), "bad url"),
        F.when(F.col("diarization_provider").isNotNull() & (F.col("diarization_provider") != "pyannote"), "bad provider"),
        F.when(~least.between(10, 600), "bad min_duration"), F.when(~most.between(10, 3600), "bad max_duration"), F.when(least > most, "min above max"),
        F.when(F.array_contains("steps", "download") & (F.coalesce(url, F.lit("")) == "") & (F.coalesce("local_file", F.lit("")) == ""), "nothing to download"),
    )
    return df.withColumn("reasons", F.array_compact(reasons)).withColumn("valid", F.size("reasons") == 0)


def order_jobs(jobs: DataFrame, policy: str = "ui") -> DataFrame:
    """By state, newest first, then names and id, with each job's position. policy: ui, or server, which puts states it doesn't know last. Runs a job that sorts them."""
    names = UI_ORDER if policy == "ui" else SERVER_ORDER
    place = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("status"))
    rows = jobs.withColumn("_place", F.when(place > 0, place).otherwise(99))
    return numbered(rows, [F.col("_place"), F.desc("updated_at"), F.lower("project"), F.lower("episode"), F.col("id")]).drop("_place")


def live_job(jobs: DataFrame, episodes: DataFrame, keys=KEYS) -> DataFrame:
    """Episodes with their newest job (job_id, job_status), if that is still active; names are compared in lower case."""
    low = lambda d: [F.lower(F.col(c).cast("string")).alias(f"_{c}") for c in keys]
    w = Window.partitionBy(*[f"_{c}" for c in keys]).orderBy(F.desc("updated_at"), F.desc("id"))
    last = jobs.select(*low(jobs), "id", "status", "updated_at").withColumn("_r", F.row_number().over(w)).filter("_r = 1").filter(F.col("status").isin(ACTIVE))
    names = [f"_{c}" for c in keys]
    return episodes.select("*", *low(episodes)).join(last.select(*names, F.col("id").alias("job_id"), F.col("status").alias("job_status")), names, "left").drop(*names)


def episode_state(episodes: DataFrame, jobs: DataFrame, statuses: DataFrame, artifacts: DataFrame, keys=KEYS) -> DataFrame:
    """State of each episode: of its live job, else as written (active without a job: failed), else from what it has."""
    keys = list(keys)
    rows = live_job(jobs, episodes, keys).join(statuses.select(*keys, F.col("status").alias("_w")), keys, "left").join(artifacts.select(*keys, "has_shorts", "has_transcript"), keys, "left")
    written = F.when(F.col("_w").isin("pending", "running", "paused"), "failed").otherwise(F.col("_w"))
    made = F.when(F.col("has_shorts"), "completed").when(F.col("has_transcript"), "transcribed").otherwise("ready")
    state = F.coalesce("job_status", written, made)
    steps = F.array(*[F.lit(s) for s in STEPS])
    done = F.when(state == "completed", steps).when(state == "transcribed", F.slice(steps, 1, 2)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("status", state).withColumn("steps_completed", done).drop("_w", "job_status")


def episode_counts(moments: DataFrame, artifacts: DataFrame, keys=KEYS) -> DataFrame:
    """Clips of each episode, whether it has a transcript, finals exported and their percentage. Artifacts: kind."""
    keys = list(keys)
    m = moments.groupBy(*keys).agg(F.count("*").alias("shorts"))
    a = artifacts.groupBy(*keys).agg(F.bool_or(F.col("kind") == "transcript").alias("has_transcript"), F.count_if(F.col("kind") == "final").alias("exported"))
    rows = m.join(a, keys, "full_outer").select(*keys, F.coalesce("shorts", F.lit(0)).alias("shorts"), F.coalesce("has_transcript", F.lit(False)).alias("has_transcript"), F.coalesce("exported", F.lit(0)).alias("exported"))
    return rows.withColumn("export_pct", F.when(F.col("shorts") > 0, F.round(F.least(F.col("exported"), F.col("shorts")) * 100.0 / F.col("shorts"), 1)).otherwise(0.0))


def restore_zones(snapshots: DataFrame, keys=KEYS) -> DataFrame:
    """Zones of each episode's newest snapshot that has any."""
    return snapshots.filter(F.size("speaker_zones") > 0).groupBy(*keys).agg(F.max_by("speaker_zones", F.struct("created_at", "id")).alias("speaker_zones"))


def snapshot_history(snapshots: DataFrame, keys=KEYS) -> DataFrame:
    """Snapshots of each episode, newest first, with their position."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id")))
    return snapshots.withColumn("position", place).orderBy(*keys, "position")


def clip_catalog(moments: DataFrame, artifacts: DataFrame, keys=KEYS) -> DataFrame:
    """Clips by rank with duration and file: public final, else local final, else draft. Artifacts: rank, kind, path."""
    keys = list(keys)
    files = artifacts.groupBy(*keys, "rank").pivot("kind", ["public", "final", "draft"]).agg(F.min("path"))
    rows = moments.join(files, [*keys, "rank"], "left").withColumn("file", F.coalesce("public", "final", "draft"))
    rows = rows.withColumn("has_video", F.col("file").isNotNull()).withColumn("is_draft", F.coalesce("public", "final").isNull() & F.col("draft").isNotNull())
    return rows.withColumn("duration", F.round(F.col("end") - F.col("start"), 2)).drop("public", "final", "draft").orderBy(*keys, "rank")


def step_durations(jobs: DataFrame) -> DataFrame:
    """The map of seconds by step as rows."""
    return jobs.select("id", F.explode("step_durations").alias("step", "seconds"))


def step_durations_map(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "seconds")))).alias("step_durations"))


def active_elapsed(log: DataFrame) -> DataFrame:
    """Seconds that each job ran, pauses left out. Log: job_id, id, status, occurred_at."""
    w = Window.partitionBy("job_id").orderBy("occurred_at", "id")
    rows = log.withColumn("_n", F.lead("occurred_at").over(w)).filter((F.col("status") == "running") & F.col("_n").isNotNull())
    ms = F.unix_millis(F.col("_n").cast("timestamp")) - F.unix_millis(F.col("occurred_at").cast("timestamp"))
    return rows.groupBy("job_id").agg(F.round(F.sum(ms) / F.lit(1000).cast("decimal(10,0)"), 1).cast("double").alias("elapsed_seconds"))


def job_state(events: DataFrame) -> DataFrame:
    """Latest step, percentage and time of each job. done and awaiting_export don't take the place of a step; a missing
    percentage leaves the one before. Works on a stream as on a table."""
    order = F.struct("occurred_at", "id")
    real = ~F.col("step").isin("done", "awaiting_export")
    return events.groupBy("job_id").agg(F.max_by(F.when(real, F.col("step")), F.when(real, order)).alias("current_step"), F.max_by("percent", F.when(F.col("percent").isNotNull(), order)).alias("progress"), F.max("occurred_at").alias("updated_at"))


def step_progress(events: DataFrame) -> DataFrame:
    """Highest percentage seen of each job's steps; it never falls, whatever order events come in."""
    rows = events.withColumn("step", canonical_step(F.col("step"))).filter("step is not null")
    return rows.groupBy("job_id", "step").agg(F.max(F.coalesce("percent", F.lit(0.0))).alias("percent"))


def finished_before(progress: DataFrame) -> DataFrame:
    """``step_progress`` rows with a state: a step before the latest one that a job has come to is done, at 100. For a stream,
    to be used on the whole result in foreachBatch."""
    at = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step"))
    rows = progress.withColumn("_at", at).withColumn("_last", F.max("_at").over(Window.partitionBy("job_id")))
    done = F.col("_at") < F.col("_last")
    return rows.select("job_id", "step", F.when(done, 100.0).otherwise(F.col("percent")).alias("percent"), F.when(done, "done").otherwise("active").alias("state"))


def stale_jobs(events: DataFrame, now: Column, limit_sec: float) -> DataFrame:
    """Jobs of which nothing was heard for limit_sec, as failed; the batch form of streaming.stale_jobs_stream."""
    last = events.groupBy("job_id").agg(F.max("occurred_at").alias("last"), F.max_by("step", F.struct("occurred_at", "id")).alias("step"))
    late = now.cast("timestamp").cast("double") - F.col("last").cast("timestamp").cast("double") > limit_sec
    return last.filter(late & (F.col("step") != "done")).select("job_id", "last", F.lit("failed").alias("status"), F.lit("no event within the limit").alias("reason"))
