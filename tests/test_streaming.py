"""A stream gives what the same rows give as a table; late and repeated rows."""

import datetime as dt
import time

from pyspark.sql import functions as F

from castclip.operators import jobs
from castclip.streaming import streams

EVENT = "id long, job_id long, step string, percent double, occurred_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def events():
    names = ["download", "transcribe", "face_track", "done"]
    return [(k, k % 3, names[min(3, k // 9)], None if k % 5 == 0 else float(k * 7 % 101), at(k * 20 % 400)) for k in range(40)]


def run(spark, tmp_path, batches, schema, make, mode):
    src, out = tmp_path / "in", f"q{abs(hash(str(tmp_path)))}{mode}"
    src.mkdir()
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(out).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
            for f in (tmp_path / f"b{k}").glob("part-*"):
                f.rename(src / f"{k}-{f.name}")
            q.processAllAvailable()
        q.processAllAvailable()
        return spark.table(out).collect()
    finally:
        q.stop()


def test_job_state_and_progress(spark, tmp_path):
    rows = events()
    df = spark.createDataFrame(rows, EVENT)
    want = {r["job_id"]: tuple(r) for r in jobs.job_state(df).collect()}
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    got = run(spark, tmp_path / "a", [rows[20:], rows[:20]], EVENT, streams.job_state_stream, "update")
    assert {r["job_id"]: tuple(r) for r in got} == want
    want = {(r["job_id"], r["step"]): r["percent"] for r in jobs.step_progress(df).collect()}
    got = run(spark, tmp_path / "b", [rows[20:], rows[:20]], EVENT, streams.step_progress_stream, "complete")
    assert {(r["job_id"], r["step"]): r["percent"] for r in got} == want


def test_repeats_go_within_the_watermark(spark, tmp_path):
    rows = [(1, 1, "a", 1.0, at(0)), (2, 1, "b", 2.0, at(30))]
    got = run(spark, tmp_path, [rows, [rows[0], (3, 1, "c", 3.0, at(40))], [(3, 1, "c", 3.0, at(40))]], EVENT, lambda e: streams.dedup_events(e, "10 minutes"), "append")
    assert sorted(r["id"] for r in got) == [1, 2, 3]


def test_throttle_and_late_rows(spark, tmp_path):
    rows = [[(1, 1, "a", 1.0, at(0.1)), (2, 1, "b", 2.0, at(0.2))], [(3, 1, "done", 100.0, at(60))], [(4, 1, "late", 5.0, at(0.15)), (5, 1, "x", 1.0, at(120))], [(6, 1, "y", 1.0, at(300))]]
    got = {r["at"]: (r["step"], r["percent"], r["ended"]) for r in run(spark, tmp_path, rows, EVENT, streams.throttle_stream, "append")}
    assert got == {at(0): ("b", 2.0, False), at(60): ("done", 100.0, True)}
    flat = spark.createDataFrame([x for b in rows for x in b], EVENT)
    batch = {r["at"]: (r["step"], r["percent"], r["ended"]) for r in streams.throttle_stream(flat).collect()}
    assert batch == {at(0): ("b", 2.0, False), at(60): ("done", 100.0, True)}


def test_a_window_comes_out_when_its_time_is_over(spark, tmp_path):
    rows = [[(1, 1, "a", 1.0, at(0.1)), (2, 2, "b", None, at(0.2))], [(3, 2, "c", 3.0, at(0.25)), (4, 2, "d", 4.0, at(0.7))], [(5, 3, "x", 1.0, at(300))], [(6, 3, "y", 1.0, at(301))]]
    got = sorted((r["job_id"], r["at"], r["step"], r["percent"], r["ended"]) for r in run(spark, tmp_path, rows, EVENT, streams.throttle_stream, "append"))
    assert [x for x in got if x[0] < 3] == [(1, at(0), "a", 1.0, False), (2, at(0), "c", 3.0, False), (2, at(0.6), "d", 4.0, False)]


def test_late_rows_are_counted(spark, tmp_path):
    late = streams.LateRows()
    spark.streams.addListener(late)
    try:
        rows = [[(1, 1, "a", 1.0, at(0))], [(2, 1, "b", 2.0, at(5000))], [(3, 1, "c", 3.0, at(10)), (4, 1, "d", 4.0, at(5001))], [(5, 1, "e", 4.0, at(5002))]]
        got = run(spark, tmp_path, rows, EVENT, lambda e: streams.dedup_events(e, "10 minutes"), "append")
        assert sorted(r["id"] for r in got) == [1, 2, 4, 5]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if sum(late.dropped.values()):
                break
            time.sleep(0.2)
        assert list(late.dropped.values()) == [1]
    finally:
        spark.streams.removeListener(late)


def test_steps_before_the_latest_are_done(spark):
    df = spark.createDataFrame([(1, 1, "download", 40.0, at(0)), (2, 1, "guion", 30.0, at(1)), (3, 1, "transcribe", None, at(2)), (4, 2, "edit", 5.0, at(0))], EVENT)
    got = sorted(map(tuple, jobs.finished_before(jobs.step_progress(df)).collect()))
    assert got == [(1, "analyze", 30.0, "active"), (1, "download", 100.0, "done"), (1, "transcribe", 100.0, "done"), (2, "edit", 5.0, "active")]


def test_audio_windows(spark):
    df = spark.createDataFrame([("p", "e", at(k / 10), 0.1 if k < 20 else 0.0) for k in range(40)], "project string, episode string, ts timestamp, amplitude double")
    got = sorted((r["at"], round(r["rms"], 6), r["voiced"]) for r in streams.rms_stream(df).collect())
    assert len(got) == 10 and got[0] == (T0, 0.1, True) and got[-1][2] is False
    assert all(r["rms"] >= 0.008 for r in streams.voice_windows_stream(df).collect())


def test_sessions(spark):
    df = spark.createDataFrame([("p", "e", at(t), 1) for t in (0, 2, 4, 20, 22)], "project string, episode string, ts timestamp, label int")
    assert sorted(r["windows"] for r in streams.speech_sessions(df).collect()) == [2, 3]


def test_stale_jobs(spark, tmp_path):
    rows = [[(1, 1, "download", 1.0, at(0)), (2, 2, "download", 1.0, at(0)), (3, 3, "download", 1.0, at(0))], [(4, 2, "done", 1.0, at(20)), (5, 3, "edit", 1.0, at(250))], [(6, 9, "x", 1.0, at(400))], [(7, 9, "x", 1.0, at(401))]]
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    streams.keep_states_on_disk(spark)
    try:
        got = run(spark, tmp_path, rows, EVENT, lambda e: streams.stale_jobs_stream(e, 120.0, "10 seconds"), "append")
    finally:
        spark.conf.set(key, old)
    assert sorted((r["job_id"], r["status"]) for r in got) == [(1, "failed"), (3, "failed")]
    flat = spark.createDataFrame([x for b in rows for x in b], EVENT)
    batch = jobs.stale_jobs(flat, F.lit(at(401)), 120.0)
    assert sorted(r["job_id"] for r in batch.collect()) == [1, 3]


def test_elapsed_without_pauses(spark):
    log = [(1, 1, "running", at(0)), (1, 2, "paused", at(10)), (1, 3, "running", at(100)), (1, 4, "completed", at(105.26))]
    df = spark.createDataFrame(log, "job_id long, id long, status string, occurred_at timestamp")
    assert jobs.active_elapsed(df).first()["elapsed_seconds"] == 15.3
