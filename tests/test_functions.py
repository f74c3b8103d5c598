"""Scalar rules and job state on hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from castclip.functions import clips, steps

JOB = "status string, steps array<string>, current_step string, progress double, steps_completed array<string>"


def test_times(spark):
    # 61.239 has no exact binary value; milliseconds are cut
    df = spark.createDataFrame([(0.0,), (61.239,), (3599.5,), (36000.25,)], "x double")
    assert [r[0] for r in df.select(clips.srt_time(F.col("x"))).collect()] == ["00:00:00,000", "00:01:01,238", "00:59:59,500", "10:00:00,250"]
    text = spark.createDataFrame([("00:00:01,5",), ("01:02:03.004",), ("bad",), (None,)], "x string")
    assert [r[0] for r in text.select(clips.srt_seconds(F.col("x"))).collect()] == [1.5, 3723.004, None, None]


def test_scores(spark):
    rows = [("¿Sabías que? La verdad sobre x", "debate", None, 5.0, 0.0, 100.0), ("nada", None, None, None, 0.0, 150.5), (None, None, "Un TRUCO fácil", 8.0, 0.0, 61.0)]
    df = spark.createDataFrame(rows, "hook string, topic string, reason string, score double, start double, end double")
    from castclip.operators.moments import score_moments

    got = score_moments(df).collect()
    assert [r["categories"] for r in got] == [["controversy"], [], ["actionable"]]
    assert [r["hook_score"] for r in got] == [7.0, 0.0, 0.0]
    assert [r["duration_score"] for r in got] == [2.0, 0.8, 1.4]
    assert [r["trend_score"] for r in got] == [4.08, 2.12, 3.79]


def test_rounding_as_python(spark):
    df = spark.createDataFrame([(2.675,), (0.125,), (1.005,), (None,)], "x double")
    assert [r[0] for r in df.select(clips.py_round(F.col("x"), 2)).collect()] == [round(2.675, 2), 0.12, round(1.005, 2), None]


def test_frame_rates(spark):
    # 60 lies within 0.1 of 59.94, which comes first
    df = spark.createDataFrame([(23.98,), (29.97,), (60.0,), (12.4,)], "x double")
    assert [tuple(r[0]) for r in df.select(clips.fps_rational(F.col("x"))).collect()] == [(24000, 1001), (30000, 1001), (60000, 1001), (12, 1)]


def test_script_speakers(spark):
    df = spark.createDataFrame([("ANA: hola\nJOSÉ 2: qué\nana: no\nANA: sí",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(clips.script_speakers(F.col("x"))).collect()] == [["ANA", "JOSÉ 2"], [], None]


@pytest.mark.parametrize(("name", "wanted"), [("detect", "face_positions"), ("guion", "analyze"), ("ranking", "rank"), ("xxxx", None), ("face_positions", "face_positions"), ("analyze", "analyze")])
def test_old_step_names(spark, name, wanted):
    assert spark.range(1).select(steps.canonical_step(F.lit(name))).first()[0] == wanted


def job(spark, status="running", planned=None, current=None, progress=0.0, done=()):
    df = spark.createDataFrame([(status, planned or steps.STEPS, current, progress, list(done))], JOB)
    states = steps.step_states(df).first()["states"]
    return {x["step"]: x["state"] for x in states}, {x["step"]: x["percent"] for x in states}, steps.overall_progress(df).first()["percent"]


def test_step_states(spark):
    state, percent, _ = job(spark, done=["download", "transcribe"], current="diarize", progress=42.0)
    assert (state["download"], state["diarize"], state["speaker_bind"]) == ("done", "active", "pending")
    assert (percent["transcribe"], percent["diarize"], percent["rank"]) == (100, 42, 0)
    state, _, _ = job(spark, planned=["face_positions", "speaker_bind", "analyze", "edit", "rank"], current="face_positions")
    assert [state[s] for s in steps.STEPS[:5]] == ["done", "done", "done", "active", "pending"]
    state, percent, _ = job(spark, current="speaker_bind", done=["download", "transcribe", "diarize"])
    assert state["face_positions"] == "pending" and percent["face_positions"] == 0
    _, percent, _ = job(spark, current="transcribe", progress=None)
    assert percent["transcribe"] == 0


def test_overall_progress(spark):
    assert job(spark, status="completed")[2] == 100
    assert job(spark, status="awaiting_export", done=steps.STEPS[:-1])[2] == 100
    assert job(spark, current="face_positions", progress=50.0, done=["download", "transcribe", "diarize"])[2] == 44


def test_eta(spark):
    df = spark.createDataFrame([("running", steps.STEPS, "transcribe", 50.0, ["download"], {"download": 300.0}, 1000.0)], JOB + ", d map<string,double>, e double")
    got = steps.pipeline_eta(df, F.col("d"), F.col("e"), F.lit(None).cast("timestamp"), F.current_timestamp()).first()
    # download took 300, the active step 700 at half way, the others up to export as usual
    assert (got["active_step"], got["elapsed"], got["estimated"]) == ("transcribe", 1000.0, 300 + 1400 + 120 + 40 + 60 + 210 + 600 + 30)
    assert got["remaining"] == got["estimated"] - 1000
