"""Boundaries, ties and defaults of the operators; binned joins against plain ones; helpers against plain restatements."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from castclip import helpers
from castclip.operators import binding, intervals, jobs, moments, quality, scoring, turns
from castclip.sources import io

K = ("ep",)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def segments(spark, data):
    return spark.createDataFrame([(1, k, *x) for k, x in enumerate(data)], "ep long, seg_idx long, speaker string, start double, end double")


def test_touching_intervals(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 20.0)], "ep long, start double, end double")
    assert intervals.interval_join(a, a, K).count() == 2
    assert intervals.interval_join(a, a, K, closed=True).count() == 4
    assert intervals.interval_join(a, a, K, closed=True, bin=10.0).count() == 4


def test_rows_that_occur_twice_and_meet_are_not_left_alone(spark):
    left = spark.createDataFrame([(1, None, 0.0, 5.0), (1, None, 0.0, 5.0), (1, 3, 90.0, 95.0), (1, 3, 90.0, 95.0)], "ep long, a long, start double, end double")
    right = spark.createDataFrame([(1, 1.0, 2.0)], "ep long, start double, end double")
    for size in (None, 7.0):
        got = intervals.interval_join(left, right, K, bin=size, how="left").select("a", "r_start").collect()
        assert sorted(map(tuple, got), key=str) == [(3, None), (3, None), (None, 1.0), (None, 1.0)]


def test_bins_change_nothing(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.randrange(3), k, float(s := rng.randrange(200)), float(s + rng.randrange(1, 60))) for k in range(n)]
    left = spark.createDataFrame(make(80), "ep long, a long, start double, end double")
    right = spark.createDataFrame(make(80), "ep long, b long, start double, end double")
    for closed, how in itertools.product((False, True), ("inner", "left")):
        cols = ["ep", "a", "r_b"]
        plain, binned = (intervals.interval_join(left, right, K, closed, size, how) for size in (None, 7.0))
        assert sorted(map(tuple, plain.select(*cols).collect()), key=str) == sorted(map(tuple, binned.select(*cols).collect()), key=str)


def test_speaker_at_takes_the_first_and_has_a_default(spark):
    seg = segments(spark, [("A", 0.0, 5.0), ("B", 5.0, 9.0)])
    lines = spark.createDataFrame([(1, 1, 5.0, "x"), (1, 2, 9.5, "y"), (1, 3, None, "z"), (1, 4, 9.0, "w")], "ep long, line_no long, t double, line string")
    assert rows(intervals.speaker_at(lines, seg, K), "line_no", "speaker") == [(1, "A"), (2, "SPEAKER_?"), (3, None), (4, "B")]
    assert [r[1] for r in rows(turns.annotate_transcript(lines, seg, K), "line_no", "line")] == ["[A] x", "[SPEAKER_?] y", "z", "[B] w"]


def test_dominant_speaker_ties_and_default(spark):
    seg = segments(spark, [("B", 0.0, 2.0), ("A", 2.0, 4.0), ("C", 30.0, 40.0)])
    m = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 1.0, 4.0), (1, 3, 10.0, 20.0)], "ep long, moment_idx long, start double, end double")
    assert rows(turns.dominant_speaker(m, seg, K), "moment_idx", "dominant_speaker") == [(1, "B"), (2, "A"), (3, "UNKNOWN")]


def test_snapping(spark):
    cues = spark.createDataFrame([(1, 0, 1.0, 2.0, "a"), (1, 1, 2.3, 3.0, "b"), (1, 2, 3.29, 4.0, "c")], "ep long, cue_idx long, start double, end double, text string")
    m = spark.createDataFrame([(1, 1, 1.5, 3.5), (1, 2, 9.0, 0.5), (2, 3, 1.0, 2.0)], "ep long, moment_idx long, start double, end double")
    assert rows(intervals.snap_to_words(m, cues, K), "moment_idx", "start", "end") == [(1, 2.3, 3.0), (2, 3.29, 63.29), (3, 1.0, 2.0)]
    assert [round(r[0], 3) for r in rows(intervals.silence_points(cues, K), "point")] == [2.15]
    assert [tuple(round(x, 3) for x in r) for r in rows(intervals.snap_to_silences(m, cues, K), "moment_idx", "start", "end")] == [(1, 2.15, 62.15), (2, 9.0, 69.0), (3, 1.0, 2.0)]


def naive_absorb(cuts, least):
    out = []
    for s, a, b in cuts:
        if out and b - a < least:
            out[-1] = (out[-1][0], out[-1][1], b)
        else:
            out.append((s, a, b))
    return out


def naive_limit(cuts, n):
    total, first = {}, {}
    for k, (s, a, b) in enumerate(cuts):
        total[s] = total.get(s, 0) + b - a
        first.setdefault(s, k)
    if len(total) <= n:
        return cuts
    top = sorted(total, key=lambda s: (-total[s], first[s]))
    out = []
    for s, a, b in cuts:
        name = s if s in top[:n] else (out[-1][0] if out else top[0])
        if out and out[-1][0] == name:
            out[-1] = (name, out[-1][1], b)
        else:
            out.append((name, a, b))
    return out


def test_camera_rules_on_random_clips(spark):
    rng = random.Random(7)
    data, clips = [], []
    for m in range(40):
        t, cuts = 0.0, []
        for _ in range(rng.randrange(1, 14)):
            end = t + rng.choice([0.25, 1.0, 1.5, 3.0, 6.0])
            cuts.append((f"S{rng.randrange(4)}", t, end))
            t = end
        clips.append(cuts)
        data += [(1, m, k, *c) for k, c in enumerate(cuts)]
    df = spark.createDataFrame(data, "ep long, moment_idx long, seg_idx long, speaker string, start double, end double")
    key = ["ep", "moment_idx"]
    for made, rule in ((turns.absorb_short(df, 1.5, key), lambda c: naive_absorb(c, 1.5)), (turns.limit_speakers(df, 2, key), lambda c: naive_limit(c, 2)), (turns.split_interruptions(df, key), lambda c: helpers.interrupted(c, 5.0, 3, 2.0, 0.0))):
        got = {}
        for r in sorted(made.collect(), key=lambda r: (r["moment_idx"], r["start"])):
            got.setdefault(r["moment_idx"], []).append((r["speaker"], r["start"], r["end"]))
        assert got == {m: rule(c) for m, c in enumerate(clips)}


def test_interruptions_are_dealt_by_seed():
    cuts = [("A", 0.0, 1.0), ("B", 1.0, 2.0), ("C", 2.0, 4.5), ("A", 4.5, 20.0)]
    draw, t, want = random.Random(0.0), 0.0, []
    while t < 4.5:
        to, who = min(t + 2, 4.5), draw.choice(["A", "B", "C"])
        if want and want[-1][0] == who:
            want[-1] = (who, want[-1][1], to)
        else:
            want.append((who, t, to))
        t = to
    assert helpers.interrupted(cuts, 5.0, 3, 2.0, 0.0) == [*want, ("A", 4.5, 20.0)]


def test_camera_plan_falls_back(spark):
    seg = segments(spark, [("A", 0.0, 5.0)])
    m = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 50.0, 60.0)], "ep long, moment_idx long, start double, end double")
    zones = spark.createDataFrame([(1, "A", 0.3, 0.6)], "ep long, speaker string, cx double, cy double")
    assert rows(turns.camera_segments(m, seg, zones, K), "moment_idx", "speaker", "center_x", "center_y") == [(1, "A", 0.3, 0.6), (2, None, 0.5, 0.4)]


def test_dedup_at_the_limit():
    start, end = np.array([0.0, 30.0, 29.0, 100.0]), np.array([100.0, 130.0, 129.0, 200.0])
    # second: 70 of 100 lie in the first, which is not more than 0.70; third: 71
    assert helpers.kept_by_overlap(start, end, 0.70).tolist() == [True, True, False, True]


def test_quota(spark):
    kind = "ep long, moment_idx long, start double, end double, score double, topic string, hook string, summary string, reason string"
    pool = [(1, k, 200.0 * k, 200.0 * k + 90, 5.0, "t", "h", "", "") for k in range(3)] + [(1, 9, 700.0, 740.0, 4.0, "a", "h", "", ""), (1, 10, 742.0, 790.0, 6.0, "b", "h", "", ""), (1, 11, 1900.0, 2000.0, 1.0, "low", "", "", "")]
    df = spark.createDataFrame(pool, kind)
    kept = df.filter("moment_idx = 0")
    out = moments.enforce_constraints(kept, df, 6, 8, keys=K).collect()
    assert len(out) == 6 and {r["reason"] for r in out} == {"", "Merge: a + b", "auto-fill"}
    assert all(61 <= r["end"] - r["start"] <= 180 for r in out)
    assert rows(moments.enforce_constraints(kept, df, 1, 8, keys=K), "start", "end") == [(0.0, 90.0)]
    assert rows(moments.recover_moments(kept, df, 3, 3, keys=K), "moment_idx") == [(0,), (1,), (2,)]


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(0)
    for r, c in ((1, 1), (2, 4), (4, 2), (4, 4), (5, 3)):
        for _ in range(10):
            g = rng.integers(0, 20, (r, c)).astype(float)
            got = helpers.assignment(g)
            best = max(sum(g[a, b] for a, b in zip(range(r), p, strict=False) if b < c) for p in itertools.permutations(range(max(r, c)), max(r, c)))
            assert len(got) == min(r, c) and sum(g[a, b] for a, b in got) == best
    assert helpers.greedy_assignment(np.array([[0.0, 5.0], [3.0, 4.0]])) == [(0, 1), (1, 0)]


def test_clusters_are_found(spark):
    pts = [(1, float(k), 0.2 + 0.3 * (k % 3), 0.4, 0.1, 0.2, 0.9) for k in range(30)] + [(2, 0.0, 0.5, 0.4, 0.1, 0.2, 0.9)]
    df = spark.createDataFrame(pts, "ep long, t double, cx double, cy double, w double, h double, confidence double")
    got = rows(binding.face_positions(binding.cluster_faces(df, 5, K), keys=K), "ep", "position_id", "cx", "n_samples")
    assert got == [(1, 0, 0.2, 10), (1, 1, 0.5, 10), (1, 2, 0.8, 10), (2, 0, 0.5, 1)]
    x = np.concatenate([np.random.default_rng(k).normal(5 * k, 0.1, (20, 3)) for k in range(3)])
    own = helpers.voice_clusters(x, None, 2, 5)
    assert len(set(own)) == 3 and all(len(set(own[20 * k : 20 * k + 20])) == 1 for k in range(3))
    assert helpers.voice_clusters(x[:3], None, 2, 5).tolist() == [0, 0, 0]


def test_chunks():
    lines = [f"[00:00:{k:02d},000 --> 00:00:{k + 1:02d},000] text {k}" for k in range(20)] + [f"[00:01:{k:02d},000 --> 00:01:{k + 1:02d},000] text" for k in range(5)]
    out = list(helpers.chunks(lines, 600))
    assert out[0].splitlines()[0] == lines[0] and all(x.startswith("[Contexto previo: ") for x in out[1:])
    assert all(any(x in c for c in out) for x in lines)
    assert list(helpers.simple_chunks(["abc", "de", "fgh"], 7)) == ["abc\nde", "fgh"] and list(helpers.simple_chunks(["ab"], 9)) == ["ab"]


def test_alignment_goes_forward(spark):
    said = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince".split()
    words = said + [f"x{k}" for k in range(30)] + said[::-1] + [f"y{k}" for k in range(30)]
    found = helpers.aligned([(b, len(b)) for b in (said[:12], ["zz", "yy"], said[::-1][:8])], zip(words, range(len(words)), strict=True), len(words))
    # the first window that holds the whole needle is good enough
    assert list(found) == [(0, 0), (2, 40)]
    b = spark.createDataFrame([(1, 0, "A", "Uno, dos; tres cuatro cinco")], "ep long, block_idx long, speaker string, text string")
    t = spark.createDataFrame([(1, 7, "nada por aquí"), (1, 8, "uno dos tres cuatro cinco y así sigue la cosa por un buen rato más que nada")], "ep long, seg_idx long, text string")
    # the first window that holds all of the needle begins in the line before
    assert rows(quality.align_script(b, t, K), "block_idx", "speaker", "seg_idx") == [(0, "A", 7)]


def test_closeness_of_a_needle_is_as_told():
    rng = random.Random(2)
    words = [rng.choice("abcdefghij") for _ in range(400)]
    first = [rng.choice("abcdefghijkl") for _ in range(7)]
    code = {w: k for k, w in enumerate("abcdefghijkl")}
    got = helpers._closeness(np.array([code[w] for w in first]), np.array([code[w] for w in words]), 390)
    for at in range(390):
        part = words[at : at + 12]
        two = lambda x: {*zip(x, x[1:], strict=False)}
        want = 0.35 * len([w for w in first if w in part]) / 7 + 0.5 * len(two(first) & two(part)) / len(two(first)) + 0.15 * (part[0] == first[0])
        assert abs(got[at] - want) < 1e-12


def test_gaps_and_fillers():
    clip = lambda s, e: {"start": s, "end": e}
    assert helpers._gaps([clip(61.0, 100.0), clip(161.0, 200.0)], 261.0, 61.0) == [(100.0, 161.0)]
    assert helpers._gaps([clip(62.0, 100.0), clip(160.0, 200.0)], 262.0, 61.0) == [(0.0, 62.0), (200.0, 262.0)]
    assert helpers._gaps([], 30.0, 61.0) == [(0.0, 30.0)]
    made = helpers._fillers([(0.0, 70.0), (100.0, 400.0)], 1000.0, 6, 61.0, 180.0)
    assert len(made) == 6 and all(61 <= m["end"] - m["start"] <= 180 for m in made)
    inner = [m for m in made if m["reason"] == "auto-fill"]
    assert inner[0]["start"] == 0.0 and inner[1]["start"] == 100.0 and all(b["start"] - a["end"] == 5 for a, b in zip(inner[1:], inner[2:], strict=False))
    rest = [m["start"] for m in made if m["reason"] != "auto-fill"]
    assert rest == [round(k * 1000.0 / (len(rest) + 1), 2) for k in range(len(rest))]


def test_short_episodes_are_reported(spark):
    pool = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "ep long, moment_idx long")
    assert rows(moments.short_episodes(pool.filter("ep = 1"), pool, 2, K), "ep", "clips", "wanted") == [(2, 0, 2)]


def test_long_segments_are_cut_at_the_widest_gaps(spark):
    lines = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate([(0.0, 50.0), (53.0, 100.0), (102.0, 130.0), (130.5, 240.0), (250.0, 300.0)])], "ep long, line_no long, start double, end double")
    segs = spark.createDataFrame([(1, 0, "A", 0.0, 240.0), (1, 1, "B", 240.0, 300.0)], "ep long, seg_idx long, speaker string, start double, end double")
    assert rows(turns.split_long_segments(segs, lines, 120.0, 1.5, K), "seg_idx", "start", "end") == [(0, 0.0, 51.5), (0, 51.5, 101.0), (0, 101.0, 240.0), (1, 240.0, 300.0)]


def test_jobs_and_snapshots_have_positions(spark):
    at = "timestamp '2024-01-0%d'"
    df = spark.sql(" union all ".join(f"select {i}L as id, 'P' as project, '{e}' as episode, '{st}' as status, {at % day} as updated_at" for i, e, st, day in ((1, "b", "failed", 1), (2, "A", "running", 1), (3, "a", "running", 1), (4, "z", "running", 2), (5, "q", "odd", 3))))
    assert [(r["id"], r["position"]) for r in jobs.order_jobs(df).collect()] == [(4, 1), (2, 2), (3, 3), (1, 4), (5, 5)]
    snaps = df.withColumnRenamed("updated_at", "created_at")
    assert rows(jobs.snapshot_history(snaps, ("project",)), "position", "id") == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]


def test_job_requests(spark):
    kind = "project string, episode string, url string, local_file string, diarization_provider string, min_duration long, max_duration long, steps array<string>"
    df = spark.createDataFrame([("p", "e", "https://x", None, None, 60, 180, ["download"]), ("../p", "e", "ftp://x", None, "z", 5, 4000, []), ("p", "e", None, "", None, 200, 100, ["download"])], kind)
    assert [r["reasons"] for r in jobs.validate_job_requests(df).collect()] == [[], ["bad project", "bad url", "bad provider", "bad min_duration", "bad max_duration"], ["min above max", "nothing to download"]]


def test_files(spark, tmp_path):
    folder = tmp_path / "P" / "E"
    folder.mkdir(parents=True)
    (folder / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nhola\nmundo\n\n2\n00:00:03,000 --> 00:00:03,000\nx\n\nbad\n", encoding="utf-8")
    (folder / "segments.json").write_text('[{"speaker": "A", "start": 0, "end": 1.5, "duration": 1.5}]', encoding="utf-8")
    (folder / "map.json").write_text('{"A": {"track_id": 2, "cx": 0.5}}', encoding="utf-8")
    assert rows(io.read_srt(spark, f"{folder}/a.srt"), "project", "episode", "start", "end", "text") == [("P", "E", 1.0, 2.5, "hola mundo"), ("P", "E", 3.0, 3.0, "x")]
    assert rows(io.read_srt(spark, f"{folder}/a.srt", "regex"), "start", "end") == [(1.0, 2.5)]
    assert rows(io.read_artifact(spark, f"{folder}/segments.json", "speaker_segments"), "idx", "speaker", "end") == [(0, "A", 1.5)]
    assert rows(io.read_artifact(spark, f"{folder}/map.json", "speaker_face_map"), "speaker", "track_id", "cx") == [("A", 2, 0.5)]
    assert io.read_artifacts(spark, str(tmp_path)).filter("project = 'P' and episode = 'E'").count() == 3
    df = spark.createDataFrame([("P", "E", 1), ("P", "F", 2)], "project string, episode string, x long")
    io.write_artifact(df, f"{tmp_path}/out")
    io.write_artifact(df.filter("episode = 'E'").withColumn("x", F.lit(9).cast("long")), f"{tmp_path}/out")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "episode", "x") == [("E", 9), ("F", 2)]


def test_fcpxml_is_well_formed(spark):
    import xml.etree.ElementTree as ET

    m = spark.createDataFrame([(1, 1, 10.0, 71.5, 'a & "b" <c>', 5.0, "h", None, None), (1, 2, 0.0, 61.0, None, None, None, "r", 1)], "ep long, moment_idx long, start double, end double, topic string, score double, hook string, reason string, rank int")
    video = spark.createDataFrame([(1, 29.97)], "ep long, fps double")
    text = io.render_fcpxml(io.build_timeline(m, video, K), K).first()["fcpxml"]
    clips = ET.fromstring(text.encode()).findall(".//asset-clip")
    assert [c.get("name") for c in clips] == ["Short 1", 'a & "b" <c>'] and clips[1].get("offset") == f"{int(61 * 29.97) * 1001}/30000s"


def test_model_answers_and_scorer(spark):
    df = spark.createDataFrame([(1, 0, 'Sure:\n[{"start": 1, "end": 2.5, "score": 7}]\nbye'), (1, 1, "none"), (1, 2, "[{bad")], "ep long, chunk_idx long, response string")
    good, bad = io.parse_model_responses(df, K)
    assert rows(good, "chunk_idx", "start", "end", "score") == [(0, 1.0, 2.5, 7.0)] and rows(bad, "chunk_idx") == [(1,), (2,)]

    def fails(prompt):
        raise ValueError(prompt)

    prompts = spark.createDataFrame([(1, 0, "[00:00:01,000 --> 00:00:03,000] un secreto fácil")], "ep long, chunk_idx long, prompt string")
    assert scoring.score_chunks(prompts, fails, keys=K).first()["error"].startswith("ValueError")
    made, _ = io.parse_model_responses(scoring.score_chunks(prompts, keys=K), K)
    assert rows(made, "start", "end", "score") == [(1.0, 3.0, 4.5)]


def test_overrides_and_edits(spark):
    m = spark.createDataFrame([(1, k, 100.0 * k, 100.0 * k + 90, None) for k in range(3)], "ep long, moment_idx long, start double, end double, rank int")
    p = spark.createDataFrame([(1, 2, 5.0, None), (1, 8, 1.0, 2.0)], "ep long, idx int, start double, end double")
    d = spark.createDataFrame([(1, 3)], "ep long, idx int")
    out, missed = moments.apply_edits(m, p, d, K)
    assert rows(out, "moment_idx", "start", "end") == [(0, 0.0, 90.0), (1, 5.0, 190.0)] and rows(missed, "idx", "edit") == [(8, "patch")]
