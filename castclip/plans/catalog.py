"""Registered queries of the clip operators, each over a whole view, with SQL for DuckDB where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clips, steps
from ..operators import binding, intervals, jobs, moments, quality, scoring, turns
from ..operators.scans import Scan
from ..sources import io
from ..streaming import streams
from .fixtures import oracle, view

K = ("episode_id",)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ORACLE: dict[str, str] = {}  # as written, over the views' names


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__], ORACLE_SQL[f.__name__] = sql, oracle(sql)
        return f

    return add


def ms(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * 1000).cast("bigint").alias(name or f"{c}_ms")


def _segs(s, d):
    return view(s, d, "fx_segments")


def _cues(s, d):
    return _segs(s, d).withColumnRenamed("seg_idx", "cue_idx")


def _moms(s, d):
    return view(s, d, "fx_moments")


def best_clips(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """The best clips of every episode, and who speaks most in them."""
    good = moments.valid_moments(moments.min_score(_moms(spark, sf_dir)))
    ranked = moments.rank_moments(moments.score_moments(good), K).filter(F.col("rank") <= top)
    named = turns.dominant_speaker(ranked, _segs(spark, sf_dir), K, bin=60.0)
    return named.select("episode_id", "rank", "moment_idx", ms("start"), ms("end"), "trend_score", "dominant_speaker")


# Texts of expressions that several queries share.
_HITS = {name: " OR ".join(f"contains(t, '{w}')" for w in words) for name, words in clips.CATEGORIES.items()}
_SCORED = f"""scored AS (
  SELECT *, list_filter([{', '.join(f"CASE WHEN {_HITS[n]} THEN '{n}' END" for n in sorted(_HITS))}], lambda x: x IS NOT NULL) AS cats,
    (CASE WHEN contains(h, '¿') OR starts_with(h, '?') THEN 30 ELSE 0 END) + (CASE WHEN contains(h, 'sabías que') OR contains(h, 'lo que nadie te dice') THEN 25 ELSE 0 END)
    + (CASE WHEN contains(h, 'error') OR contains(h, 'no hagas') OR contains(h, 'deja de') THEN 20 ELSE 0 END) + (CASE WHEN contains(h, 'la verdad sobre') OR contains(h, 'te explico') THEN 15 ELSE 0 END) AS hook10,
    CASE WHEN end_ms - start_ms BETWEEN 90000 AND 120000 THEN 20 WHEN end_ms - start_ms BETWEEN 60000 AND 150000 THEN 14 WHEN end_ms - start_ms > 150000 AND end_ms - start_ms <= 180000 THEN 8 ELSE 0 END AS dur10
  FROM (SELECT *, lower(concat_ws(' ', hook, topic, '')) AS t, lower(hook) AS h FROM fx_moments)),
trend AS (SELECT *, CAST(floor((score10 * 40 + len(cats) * 15 * 25 + hook10 * 20 + dur10 * 15 + 5) / 10) AS BIGINT) AS trend100 FROM scored)"""
_OVER = """met AS (
  SELECT m.episode_id, m.moment_idx, m.start_ms AS ms, m.end_ms AS me, s.seg_idx, s.speaker, s.start_ms AS ss, s.end_ms AS se, s.text,
         greatest(m.start_ms, s.start_ms) AS c_start_ms, least(m.end_ms, s.end_ms) AS c_end_ms
  FROM fx_moments m JOIN fx_segments s ON m.episode_id = s.episode_id AND m.end_ms > s.start_ms AND m.start_ms < s.end_ms)"""
_DOM = """tot AS (SELECT episode_id, moment_idx, speaker, sum(c_end_ms - c_start_ms) AS s, min(seg_idx) AS i FROM met GROUP BY ALL),
dom AS (SELECT episode_id, moment_idx, speaker AS dominant_speaker FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, moment_idx ORDER BY s DESC, i) AS r FROM tot) WHERE r = 1)"""


@query(f"""WITH {_SCORED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY trend100 DESC, start_ms, moment_idx) AS rank FROM trend WHERE score10 >= 35 AND end_ms - start_ms BETWEEN 61000 AND 180000),
{_OVER}, {_DOM}
SELECT r.episode_id, CAST(rank AS INTEGER) AS rank, r.moment_idx, start_ms, end_ms, trend100 / 100.0 AS trend_score, coalesce(dominant_speaker, 'UNKNOWN') AS dominant_speaker
FROM ranked r LEFT JOIN dom USING (episode_id, moment_idx) WHERE rank <= 3""")
def flagship_best_clips(spark, sf_dir):
    return best_clips(spark, sf_dir)


@query("SELECT episode_id, seg_idx FROM fx_segments WHERE end_ms - start_ms >= 3000")
def prj2_filter_short_segments(s, d):
    return moments.filter_short_segments(_segs(s, d), 3.0).select("episode_id", "seg_idx")


@query("SELECT episode_id, moment_idx FROM fx_moments WHERE end_ms - start_ms BETWEEN 61000 AND 180000")
def prj3_valid_moments(s, d):
    return moments.valid_moments(_moms(s, d)).select("episode_id", "moment_idx")


@query("SELECT episode_id, moment_idx FROM fx_moments WHERE score10 >= 35")
def prj4_min_score(s, d):
    return moments.min_score(_moms(s, d)).select("episode_id", "moment_idx")


def _stamp(ms: str) -> str:
    """SQL of a subtitle time, from seconds in doubles."""
    x = f"(CAST({ms} AS DOUBLE) / CAST(1000 AS DOUBLE))"
    part = lambda e, n: f"lpad(CAST({e} AS STRING), {n}, '0')"
    whole = lambda n: f"CAST(floor({x} / {n}) AS BIGINT)"
    thousandths = f"CAST(trunc(({x} % CAST(1 AS DOUBLE)) * CAST(1000 AS DOUBLE)) AS BIGINT)"
    return f"{part(whole(3600), 2)} || ':' || {part(whole(60) + ' % 60', 2)} || ':' || {part(whole(1) + ' % 60', 2)} || ',' || {part(thousandths, 3)}"


def _stamped_ms(ms: str) -> str:
    """The milliseconds that such a time tells."""
    x = f"(CAST({ms} AS DOUBLE) / CAST(1000 AS DOUBLE))"
    return f"(CAST(floor({x}) AS BIGINT) * 1000 + CAST(trunc(({x} % CAST(1 AS DOUBLE)) * CAST(1000 AS DOUBLE)) AS BIGINT))"


@query(f"SELECT episode_id, seg_idx, {_stamp('start_ms')} AS t FROM fx_segments")
def fn1_srt_time(s, d):
    return _segs(s, d).select("episode_id", "seg_idx", clips.srt_time(F.col("start")).alias("t"))


@query("SELECT episode_id, seg_idx, start_ms AS t_ms FROM fx_segments")
def fn2_srt_seconds(s, d):
    m = F.col("start_ms")
    text = F.format_string("%02d:%02d:%02d.%03d", F.floor(m / 3600000), F.floor(m / 60000) % 60, F.floor(m / 1000) % 60, m % 1000)
    return _segs(s, d).select("episode_id", "seg_idx", ms(clips.srt_seconds(text), "t_ms"))


@query(r"""SELECT episode_id, seg_idx, array_to_string(w, ' ') AS words, CAST(len(w) AS INTEGER) AS n FROM (
SELECT *, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9áéíóúüñ\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM fx_segments)""")
def fn3_normalize_text(s, d):
    w = clips.normalize_text(F.col("text"))
    return _segs(s, d).select("episode_id", "seg_idx", F.array_join(w, " ").alias("words"), F.size(w).alias("n"))


@query(f"""WITH {_SCORED} SELECT episode_id, moment_idx, array_to_string(cats, ',') AS categories, len(cats) * 1.5 AS keyword_score, hook10 / 10.0 AS hook_score, dur10 / 10.0 AS duration_score, trend100 / 100.0 AS trend_score FROM trend""")
def fn4_to_fn7_trend_score(s, d):
    return moments.score_moments(_moms(s, d)).select("episode_id", "moment_idx", F.array_join("categories", ",").alias("categories"), "keyword_score", "hook_score", "duration_score", "trend_score")


@query("""SELECT episode_id, moment_idx, CASE WHEN end_ms - start_ms BETWEEN 35000 AND 65000 THEN 2.0 WHEN end_ms - start_ms BETWEEN 25000 AND 75000 THEN 1.0 ELSE 0.0 END AS points,
  end_ms - start_ms BETWEEN 35000 AND 65000 AS optimal FROM fx_moments""")
def fn6_older_duration_score(s, d):
    a, b = F.col("start"), F.col("end")
    return _moms(s, d).select("episode_id", "moment_idx", clips.duration_score(a, b, "older").alias("points"), clips.optimal_duration(a, b).alias("optimal"))


@query("SELECT id, CASE step WHEN 'face_track' THEN 'face_positions' WHEN 'guion' THEN 'analyze' WHEN 'done' THEN NULL ELSE step END AS strict, CASE step WHEN 'face_track' THEN 'face_positions' WHEN 'guion' THEN 'analyze' ELSE step END AS loose FROM fx_job_events")
def fn8_canonical_step(s, d):
    return view(s, d, "fx_job_events").select("id", steps.canonical_step(F.col("step")).alias("strict"), steps.canonical_step(F.col("step"), False).alias("loose"))


@query("""SELECT id, CAST(CASE id % 6 WHEN 0 THEN 24000 WHEN 1 THEN 30000 WHEN 2 THEN 60 WHEN 3 THEN 12 WHEN 4 THEN 25 ELSE 60000 END AS BIGINT) AS num,
  CAST(CASE WHEN id % 6 IN (0, 1, 5) THEN 1001 ELSE 1 END AS BIGINT) AS den FROM fx_jobs""")
def fn9_fps_rational(s, d):
    fps = F.element_at(F.array(*[F.lit(x) for x in (23.98, 29.97, 60.05, 12.4, 25.0, 59.9)]), (F.col("id") % 6 + 1).cast("int"))
    return view(s, d, "fx_jobs").select("id", clips.fps_rational(fps).alias("r")).select("id", "r.num", "r.den")


def _job(s, d) -> DataFrame:
    """Jobs with the first n steps done and the next one running."""
    all_ = F.array(*[F.lit(x) for x in steps.STEPS])
    j = view(s, d, "fx_jobs")
    return j.withColumn("steps", all_).withColumn("steps_completed", F.slice(all_, F.lit(1), F.col("n_completed").cast("int"))).withColumn("current_step", F.element_at(all_, (F.col("n_completed") + 1).cast("int"))).withColumn("pct", F.col("progress").cast("double"))


_STEP_ROWS = ", ".join(f"({k + 1}, '{x}', {steps.SECONDS[x]})" for k, x in enumerate(steps.STEPS))


@query(f"""WITH st(i, step, secs) AS (VALUES {_STEP_ROWS})
SELECT id, step, CASE WHEN i <= n_completed THEN 'done' WHEN i = n_completed + 1 THEN 'active' ELSE 'pending' END AS state,
  CAST(CASE WHEN i <= n_completed THEN 100 WHEN i = n_completed + 1 THEN least(progress, 100) ELSE 0 END AS BIGINT) AS percent FROM fx_jobs, st""")
def fn10_step_state(s, d):
    return steps.step_states(_job(s, d), progress="pct").select("id", F.inline_outer("states"))


@query("""SELECT id, CAST(CASE WHEN status = 'completed' THEN 100 ELSE floor((n_completed + least(progress, 100) / 100.0) / (CASE WHEN n_completed = 8 THEN 9 ELSE 8 END) * 100 + 0.5) END AS BIGINT) AS percent FROM fx_jobs""")
def fn11_overall_progress(s, d):
    return steps.overall_progress(_job(s, d), progress="pct").select("id", "percent")


@query(f"""WITH st(i, step, secs) AS (VALUES {_STEP_ROWS}), a AS (
  SELECT j.id, any_value(status) AS status, CAST(any_value(progress) * 10 AS DOUBLE) AS spent, any_value(least(progress, 100)) / 100.0 AS ratio,
    sum(secs) FILTER (i <= n_completed) AS past, sum(secs) FILTER (i > n_completed + 1 AND (i < 9 OR n_completed = 8)) AS rest, sum(secs) FILTER (i < 9 OR n_completed = 8) AS base, max(secs) FILTER (i = n_completed + 1) AS own
  FROM fx_jobs j, st GROUP BY j.id),
b AS (SELECT *, greatest(0, spent - coalesce(past, 0)) AS took FROM a),
c AS (SELECT *, CASE WHEN ratio >= 0.2 THEN least(greatest(floor(took / ratio + 0.5), own), own * 3) ELSE greatest(own, took) END AS guess FROM b),
e AS (SELECT *, greatest(spent, floor(coalesce(past, 0) + guess + coalesce(rest, 0) + 0.5), base) AS total FROM c)
SELECT id, CAST(total AS DOUBLE) AS estimated, CAST(CASE WHEN status IN ('running', 'pending', 'paused', 'stopped') THEN greatest(0, total - spent) ELSE 0 END AS DOUBLE) AS remaining FROM e""")
def fn12_pipeline_eta(s, d):
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    eta = steps.pipeline_eta(_job(s, d), none, F.col("pct") * 10, F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"), progress="pct")
    return eta.select("id", "estimated", "remaining")


_SCRIPT = "script AS (SELECT episode_id, string_agg(CASE WHEN seg_idx % 3 = 0 THEN replace(speaker, '_', ' ') || ': ' || text ELSE text END, chr(10) ORDER BY seg_idx) AS t FROM fx_segments GROUP BY episode_id)"


@query(rf"""WITH {_SCRIPT} SELECT episode_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?m)^([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s\d]{{0,30}}):', 1), lambda x: trim(x)))), ',') AS names FROM script""")
def fn13_script_speakers(s, d):
    line = F.when(F.col("seg_idx") % 3 == 0, F.concat(F.replace("speaker", F.lit("_"), F.lit(" ")), F.lit(": "), "text")).otherwise(F.col("text"))
    rows = _segs(s, d).groupBy(*K).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return rows.select("episode_id", F.array_join(clips.script_speakers(F.col("t")), ",").alias("names"))


@query("SELECT id, CAST(CASE WHEN id % 7 = 0 THEN NULL ELSE floor(epoch(occurred_at)) END AS BIGINT) AS at_s FROM fx_job_events")
def fn14_iso_ts(s, d):
    text = F.when(F.col("id") % 7 == 0, "no time").otherwise(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return view(s, d, "fx_job_events").select("id", F.unix_seconds(clips.iso_ts(text)).alias("at_s"))


@query(f"WITH st(i, step, secs) AS (VALUES {_STEP_ROWS}) SELECT id, step, CAST(i * 10 AS DOUBLE) AS seconds FROM fx_jobs, st WHERE i <= n_completed")
def fn15_step_durations(s, d):
    secs = F.transform("steps_completed", lambda x, i: (i + 1) * 10.0)
    rows = _job(s, d).select("id", F.map_from_arrays("steps_completed", secs).alias("step_durations"))
    return jobs.step_durations(jobs.step_durations_map(jobs.step_durations(rows)))


# joins -------------------------------------------------------------------------------------------
_AT = """sp AS (
  SELECT * FROM (SELECT m.episode_id, m.moment_idx, s.speaker, row_number() OVER (PARTITION BY m.episode_id, m.moment_idx ORDER BY s.start_ms, s.seg_idx) AS r
    FROM fx_moments m JOIN fx_segments s ON m.episode_id = s.episode_id AND m.start_ms BETWEEN s.start_ms AND s.end_ms) WHERE r = 1)"""


def _lines(s, d):
    return _moms(s, d).select("episode_id", F.col("moment_idx").alias("line_no"), F.when(F.col("moment_idx") % 5 != 0, F.col("start")).alias("t"), F.col("hook").alias("line"))


@query(f"WITH {_AT} SELECT m.episode_id, m.moment_idx AS line_no, CASE WHEN m.moment_idx % 5 <> 0 THEN coalesce(speaker, 'SPEAKER_?') END AS speaker FROM fx_moments m LEFT JOIN sp USING (episode_id, moment_idx)")
def join1_speaker_at(s, d):
    return intervals.speaker_at(_lines(s, d), _segs(s, d), K, bin=30.0).select("episode_id", "line_no", "speaker")


@query(f"""WITH {_AT}, l AS (SELECT m.episode_id, m.moment_idx, m.hook, m.moment_idx % 5 <> 0 AS timed, coalesce(speaker, 'SPEAKER_?') AS speaker FROM fx_moments m LEFT JOIN sp USING (episode_id, moment_idx)),
p AS (SELECT *, lag(speaker) OVER (PARTITION BY episode_id, timed ORDER BY moment_idx) AS before FROM l)
SELECT episode_id, moment_idx AS line_no, CASE WHEN timed AND (before IS NULL OR before <> speaker) THEN '[' || speaker || '] ' || hook ELSE hook END AS line FROM p""")
def win1_annotate_transcript(s, d):
    return turns.annotate_transcript(_lines(s, d), _segs(s, d), K, bin=30.0, block=4096).select("episode_id", "line_no", "line")


@query(f"WITH {_OVER} SELECT episode_id, moment_idx, seg_idx, c_start_ms, c_end_ms FROM met")
def join2_overlap(s, d):
    return intervals.overlap_join(_moms(s, d), _segs(s, d), K, bin=60.0).select("episode_id", "moment_idx", F.col("r_seg_idx").alias("seg_idx"), ms("c_start"), ms("c_end"))


@query(f"WITH {_OVER}, t AS (SELECT episode_id, moment_idx, md5(string_agg(text, ' ' ORDER BY ss, seg_idx)) AS text_md5 FROM met GROUP BY ALL) SELECT m.episode_id, m.moment_idx, text_md5 FROM fx_moments m LEFT JOIN t USING (episode_id, moment_idx)")
def join3_cues_in_range(s, d):
    return intervals.cues_in_range(_moms(s, d), _cues(s, d), K, bin=60.0).select("episode_id", "moment_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {_OVER} SELECT episode_id, moment_idx, CAST(row_number() OVER (PARTITION BY episode_id, moment_idx ORDER BY ss, seg_idx) AS INTEGER) AS n,
  greatest(0, ss - ms) AS start_in_ms, least(me - ms, se - ms) AS end_in_ms FROM met""")
def join4_sub_srt(s, d):
    return intervals.sub_srt(_moms(s, d), _cues(s, d), K, bin=60.0).select("episode_id", "moment_idx", "n", ms("start_in"), ms("end_in"))


_WIN = "wins AS (SELECT episode_id, w, track_id, mad, CAST(floor(w / 100) * 400 AS BIGINT) AS ws, CAST(floor(w / 100) * 400 + 400 AS BIGINT) AS we FROM fx_track_windows)"
_VOTE = f"{_WIN}, votes AS (SELECT a.episode_id, s.speaker, a.track_id, CAST(sum(mad) AS BIGINT) AS total, count(*) AS n FROM wins a JOIN fx_segments s ON a.episode_id = s.episode_id AND we >= s.start_ms AND ws <= s.end_ms GROUP BY ALL)"


def _windows(s, d):
    at = F.floor(F.col("w") / 100) * 0.4
    return view(s, d, "fx_track_windows").select("episode_id", "w", "track_id", F.round(at, 3).alias("start"), F.round(at + 0.4, 3).alias("end"), F.col("mad").cast("double").alias("score"))


@query(f"WITH {_WIN} SELECT a.episode_id, w, track_id, seg_idx FROM wins a JOIN fx_segments s ON a.episode_id = s.episode_id AND we >= s.start_ms AND ws <= s.end_ms")
def join5_activity_votes(s, d):
    return intervals.activity_votes_join(_windows(s, d), _segs(s, d), K, bin=10.0).select("episode_id", "w", "track_id", F.col("r_seg_idx").alias("seg_idx"))


@query(f"""WITH {_VOTE} SELECT c.episode_id, c.speaker, c.track_id, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT episode_id, speaker FROM fx_segments) JOIN (SELECT DISTINCT episode_id, track_id FROM wins) USING (episode_id)) c LEFT JOIN votes USING (episode_id, speaker, track_id)""")
def agg6_vote_matrix(s, d):
    return binding.vote_matrix(_windows(s, d), _segs(s, d), K, bin=10.0).select("episode_id", "speaker", "track_id", F.col("total").cast("bigint").alias("total"), "n")


@query("""WITH e AS (SELECT episode_id, max(start_ms) AS last, min(end_ms) AS first FROM fx_segments GROUP BY 1),
x AS (SELECT m.episode_id, m.moment_idx, m.start_ms, m.end_ms, coalesce((SELECT min(s.start_ms) FROM fx_segments s WHERE s.episode_id = m.episode_id AND s.start_ms >= m.start_ms), last, m.start_ms) AS a,
  coalesce((SELECT max(s.end_ms) FROM fx_segments s WHERE s.episode_id = m.episode_id AND s.end_ms <= m.end_ms), first, m.end_ms) AS b FROM fx_moments m LEFT JOIN e USING (episode_id))
SELECT episode_id, moment_idx, a AS start_ms, CASE WHEN a >= b THEN a + 60000 ELSE b END AS end_ms FROM x""")
def join6_snap_to_words(s, d):
    return intervals.snap_to_words(_moms(s, d), _cues(s, d), K, bin=600.0).select("episode_id", "moment_idx", ms("start"), ms("end"))


_SIL = "sil AS (SELECT episode_id, (before + start_ms) / 2 AS p FROM (SELECT *, lag(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, seg_idx) AS before FROM fx_segments) WHERE start_ms - before >= 300)"


@query(f"WITH {_SIL} SELECT episode_id, CAST(p AS BIGINT) AS point_ms FROM sil")
def win9_silence_points(s, d):
    return intervals.silence_points(_cues(s, d), K, bin=600.0).select("episode_id", ms("point"))


@query(f"""WITH {_SIL}, x AS (SELECT m.episode_id, m.moment_idx,
  coalesce((SELECT arg_min(p, abs(p - m.start_ms) * 10000000 + p) FROM sil WHERE sil.episode_id = m.episode_id AND abs(p - m.start_ms) < 1500), m.start_ms) AS a,
  coalesce((SELECT arg_min(p, abs(p - m.end_ms) * 10000000 + p) FROM sil WHERE sil.episode_id = m.episode_id AND abs(p - m.end_ms) < 1500), m.end_ms) AS b FROM fx_moments m)
SELECT episode_id, moment_idx, CAST(a AS BIGINT) AS start_ms, CAST(CASE WHEN a >= b THEN a + 60000 ELSE b END AS BIGINT) AS end_ms FROM x""")
def join7_snap_to_silences(s, d):
    return intervals.snap_to_silences(_moms(s, d), _cues(s, d), K).select("episode_id", "moment_idx", ms("start"), ms("end"))


_BOX = """fr AS (SELECT DISTINCT episode_id, sample_idx % 3 AS track_id, CAST(sample_idx % 997 * 200 AS BIGINT) AS ft FROM fx_samples),
wn AS (SELECT episode_id, sample_idx AS w, sample_idx % 3 AS track_id, CAST(sample_idx * 13 % 1009 * 190 AS BIGINT) AS t FROM fx_samples)"""


@query(f"""WITH {_BOX} SELECT episode_id, w, track_id, (SELECT arg_min(ft, abs(ft - wn.t) * 1000000 + ft) FROM fr WHERE fr.episode_id = wn.episode_id AND fr.track_id = wn.track_id AND abs(ft - wn.t) <= 600) AS box_t_ms FROM wn""")
def join8_nearest_box(s, d):
    x = view(s, d, "fx_samples").withColumn("track_id", F.col("sample_idx") % 3)
    frames = x.select("episode_id", "track_id", (F.col("sample_idx") % 997 * 200 / 1000.0).alias("t"), F.lit(0.5).alias("cx"), F.lit(0.4).alias("cy")).distinct()
    wins = x.select("episode_id", "track_id", F.col("sample_idx").alias("w"), (F.col("sample_idx") * 13 % 1009 * 190 / 1000.0).alias("t"))
    return intervals.nearest_box(wins, frames, K).select("episode_id", "w", "track_id", ms("box_t"))


def _zones(s, d):
    n = F.substring("speaker", -1, 1).cast("int")
    return _segs(s, d).select("episode_id", "speaker").distinct().filter(n < 3).select("episode_id", "speaker", (n * 0.25 + 0.125).alias("cx"), F.lit(0.375).alias("cy"))


@query("SELECT episode_id, seg_idx, CASE WHEN k < 3 THEN k * 0.25 + 0.125 ELSE 0.5 END AS center_x, CASE WHEN k < 3 THEN 0.375 ELSE 0.4 END AS center_y FROM (SELECT *, CAST(right(speaker, 1) AS INTEGER) AS k FROM fx_segments)")
def join9_attach_zones(s, d):
    return intervals.attach_zones(_segs(s, d).select("episode_id", "seg_idx", "speaker", "start", "end"), _zones(s, d), K).select("episode_id", "seg_idx", "center_x", "center_y")


@query("""WITH sp AS (SELECT DISTINCT episode_id, speaker, CAST(right(speaker, 1) AS INTEGER) AS k FROM fx_segments)
SELECT episode_id, speaker, k AS position_id, 'auto' AS source FROM sp WHERE episode_id % 2 = 1 UNION ALL SELECT episode_id, speaker, 3 - k, 'manual' FROM sp WHERE episode_id % 2 = 0 AND k > 0""")
def join10_override_binding(s, d):
    k = F.substring("speaker", -1, 1).cast("int")
    sp = _segs(s, d).select("episode_id", "speaker").distinct()
    auto = sp.select("episode_id", "speaker", k.alias("position_id"), F.lit(0.5).alias("cx"), F.lit(0.4).alias("cy"), F.lit(0.8).alias("confidence"), F.lit("auto").alias("source"))
    hand = sp.filter("episode_id % 2 = 0").select("episode_id", "speaker", (3 - k).alias("position_id"))
    places = sp.select("episode_id").distinct().crossJoin(s.range(3).select(F.col("id").cast("int").alias("position_id"), F.lit(0.5).alias("cx"), F.lit(0.4).alias("cy")).hint("broadcast"))
    return binding.override_binding(auto, hand, places, K).select("episode_id", "speaker", "position_id", "source")


@query("""WITH m AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, moment_idx) AS INTEGER) AS i FROM fx_moments)
SELECT episode_id, moment_idx, CASE WHEN i % 10 = 3 THEN start_ms + 1000 ELSE start_ms END AS start_ms FROM m WHERE i % 10 <> 7""")
def join12_apply_edits(s, d):
    m, p, x = _edits(s, d)
    return moments.apply_edits(m, p, x, K)[0].select("episode_id", "moment_idx", ms("start"))


def _edits(s, d):
    m = _moms(s, d).withColumn("rank", F.lit(None).cast("int"))
    pos = moments._numbered(m, K)
    p = pos.filter("_i % 10 = 3").select("episode_id", F.col("_i").alias("idx"), (F.col("start") + 1).alias("start"), F.lit(None).cast("double").alias("end"))
    return m, p, pos.filter("_i % 10 = 7").select("episode_id", F.col("_i").alias("idx"))


@query("WITH m AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, moment_idx) AS i FROM fx_moments) SELECT episode_id, moment_idx FROM m WHERE i % 10 = 7")
def join13_select_shorts(s, d):
    m, _, x = _edits(s, d)
    return moments.select_shorts(m, x, K).select("episode_id", "moment_idx")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, moment_idx) AS i FROM fx_moments), o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, moment_idx) AS j FROM fx_moments WHERE moment_idx % 2 = 0)
SELECT episode_id, moment_idx, coalesce((SELECT arg_max(score10 + 100, j) FROM o WHERE o.episode_id = m.episode_id AND o.start_ms = m.start_ms), score10) AS score10 FROM m""")
def join11_merge_enrichment(s, d):
    m = _moms(s, d).withColumn("categories", F.array(F.lit("x")))
    e = m.filter("moment_idx % 2 = 0").withColumn("score", F.col("score") + 10)
    return moments.merge_enrichment(m, e, K).select("episode_id", "moment_idx", F.round(F.col("score") * 10).cast("bigint").alias("score10"))


def _project(df):
    return df.withColumn("project", F.lit("P")).withColumn("episode", F.concat(F.lit("Ep"), F.col("episode_id").cast("string")))


_LIVE = "lastj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY updated_at DESC, id DESC) AS r FROM fx_jobs) WHERE r = 1 AND status IN ('pending', 'running', 'paused', 'awaiting_export'))"


@query(f"WITH {_LIVE} SELECT e.episode_id, id AS job_id, status AS job_status FROM (SELECT DISTINCT episode_id FROM fx_jobs) e LEFT JOIN lastj USING (episode_id)")
def join14_live_job(s, d):
    j = _project(view(s, d, "fx_jobs"))
    return jobs.live_job(j, j.select("project", F.upper("episode").alias("episode"), "episode_id").distinct()).select("episode_id", "job_id", "job_status")


@query(f"""WITH {_LIVE} SELECT e.episode_id, coalesce(l.status, CASE e.episode_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'stopped' END, CASE WHEN e.episode_id % 5 = 2 THEN 'completed' WHEN e.episode_id % 5 = 3 THEN 'transcribed' ELSE 'ready' END) AS status,
CAST(CASE WHEN coalesce(l.status, CASE WHEN e.episode_id % 5 < 2 THEN 'x' END) IS NULL THEN CASE e.episode_id % 5 WHEN 2 THEN 9 WHEN 3 THEN 2 ELSE 0 END ELSE 0 END AS INTEGER) AS n_done
FROM (SELECT DISTINCT episode_id FROM fx_jobs) e LEFT JOIN lastj l USING (episode_id)""")
def join15_episode_state(s, d):
    j = _project(view(s, d, "fx_jobs"))
    e = j.select("project", "episode", "episode_id").distinct()
    k = F.col("episode_id") % 5
    written = e.filter(k < 2).select("project", "episode", F.when(k == 0, "running").otherwise("stopped").alias("status"))
    has = e.select("project", "episode", (k == 2).alias("has_shorts"), (k == 3).alias("has_transcript"))
    return jobs.episode_state(e, j, written, has).select("episode_id", "status", F.size("steps_completed").alias("n_done"))


@query("SELECT episode_id, sample_idx FROM fx_samples WHERE sample_idx % 300 % 4 <> 0 OR sample_idx % 300 >= 250")
def join16_gate_by_audio(s, d):
    x = view(s, d, "fx_samples").select("episode_id", "sample_idx", (F.col("sample_idx") % 300 * 0.2).alias("t"))
    w = x.select("episode_id").distinct().join(s.range(250).select(F.col("id").alias("w"), F.when(F.col("id") % 4 == 0, 0.001).otherwise(0.02).alias("rms")).hint("broadcast"))
    return intervals.gate_by_audio(x, w, K).select("episode_id", "sample_idx")


@query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY start_ms, seg_idx) AS r FROM fx_segments WHERE end_ms - start_ms >= 1000) WHERE r = 1), sp AS (SELECT DISTINCT episode_id, speaker FROM fx_segments)
SELECT episode_id, speaker, f.start_ms AS sample_start_ms, least(f.start_ms + 4000, f.end_ms) AS sample_end_ms, right(speaker, 1) = '3' AS needs_manual, bool_or(right(speaker, 1) = '3') OVER (PARTITION BY episode_id) AS needs_calibration FROM sp LEFT JOIN f USING (episode_id, speaker)""")
def join17_binding_status(s, d):
    z = _zones(s, d).select("episode_id", "speaker", F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_manual"))
    return binding.binding_status(_segs(s, d), z, K).select("episode_id", "speaker", ms("sample_start"), ms("sample_end"), "needs_manual", "needs_calibration")


# aggregations ------------------------------------------------------------------------------------
@query(f"WITH {_OVER}, {_DOM} SELECT m.episode_id, m.moment_idx, coalesce(dominant_speaker, 'UNKNOWN') AS dominant_speaker FROM fx_moments m LEFT JOIN dom USING (episode_id, moment_idx)")
def agg1_dominant_speaker(s, d):
    return turns.dominant_speaker(_moms(s, d), _segs(s, d), K, bin=60.0).select("episode_id", "moment_idx", "dominant_speaker")


@query("""WITH a AS (SELECT episode_id, speaker, count(*) AS segments, CAST(sum(end_ms - start_ms) AS BIGINT) AS t FROM fx_segments GROUP BY ALL), b AS (SELECT *, CAST(sum(t) OVER (PARTITION BY episode_id) AS BIGINT) AS al FROM a)
SELECT episode_id, speaker, segments, t / 1000.0 AS seconds, CAST((t * 2000 + al) // (2 * al) AS DOUBLE) / 10 AS share_pct, CAST(floor(floor(al / 1000.0) / 60) AS BIGINT) AS total_minutes, CAST(CAST(floor(al / 1000.0) AS BIGINT) % 60 AS BIGINT) AS total_seconds FROM b""")
def agg2_speaker_shares(s, d):
    return quality.speaker_shares(_segs(s, d), K).select("episode_id", "speaker", "segments", "seconds", "share_pct", "total_minutes", "total_seconds")


@query("""WITH g AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, end_ms) AS gap FROM fx_segments),
a AS (SELECT episode_id, sum(end_ms - start_ms) AS c, arg_max(end_ms, start_ms) - min(start_ms) AS sp, count(gap) FILTER (gap > 1000) AS gap_count, coalesce(sum(floor((gap + 50) / 100.0)) FILTER (gap > 1000), 0) AS tg FROM g GROUP BY 1)
SELECT episode_id, floor(c * 1000.0 / sp + 0.5) / 10 AS coverage_pct, gap_count, tg / 10.0 AS total_gap_sec, floor((sp + 50) / 100.0) / 10 AS total_duration_sec, CAST((CASE WHEN c * 100.0 / sp < 70 THEN 1 ELSE 0 END) + (CASE WHEN gap_count > 20 THEN 1 ELSE 0 END) AS INTEGER) AS n_issues FROM a""")
def agg3_transcript_coverage(s, d):
    return quality.transcript_coverage(_segs(s, d), K, pause=1.0).select("episode_id", "coverage_pct", "gap_count", "total_gap_sec", "total_duration_sec", F.size("issues").alias("n_issues"))


def _dets(s, d):
    x = view(s, d, "fx_detections")
    n = F.col("label")
    return x.select("episode_id", F.col("det").cast("double").alias("t"), (0.0625 + n * 0.0625).alias("cx"), (0.25 + n * 0.03125).alias("cy"), F.lit(0.125).alias("w"), F.lit(0.25).alias("h"), (0.5 + F.col("det") % 4 * 0.125).alias("confidence"), n.cast("int").alias("cluster"))


@query("""SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY label) - 1 AS INTEGER) AS position_id, round(0.0625 + label * 0.0625, 3) AS cx, n_samples FROM (SELECT episode_id, label, count(*) AS n_samples FROM fx_detections WHERE 0.25 + label * 0.03125 <= 0.55 GROUP BY ALL)""")
def agg4_face_positions(s, d):
    return binding.face_positions(_dets(s, d), keys=K).select("episode_id", "position_id", "cx", "n_samples")


@query("""SELECT episode_id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY label) - 1 AS INTEGER) AS track_id, n AS n_frames, CAST(a AS DOUBLE) AS first_seen, CAST(b AS DOUBLE) AS last_seen, CAST(b - a AS DOUBLE) AS duration, CAST(t AS DOUBLE) AS best_t
FROM (SELECT episode_id, label, count(*) AS n, min(det) AS a, max(det) AS b, arg_max(det, (det % 4) * 100000000 - det) AS t FROM fx_detections GROUP BY ALL)""")
def agg5_face_tracks(s, d):
    return binding.face_tracks(_dets(s, d), K).select("episode_id", "track_id", "n_frames", "first_seen", "last_seen", "duration", "best_t")


@query("SELECT episode_id, speaker, CAST(seg_idx % 3 AS BIGINT) AS position_id, avg(end_ms - start_ms) / 1000 AS score FROM fx_segments GROUP BY ALL")
def agg7_lip_matrix(s, d):
    x = _segs(s, d).select("episode_id", "speaker", (F.col("seg_idx") % 3).alias("position_id"), F.col("duration").alias("mad"))
    return binding.lip_matrix(x, keys=K)


@query("""WITH m AS (SELECT episode_id, speaker, seg_idx % 3 AS position_id, median(end_ms - start_ms) / 1000 AS m FROM fx_segments GROUP BY ALL)
SELECT episode_id, speaker, position_id, round((m - avg(m) OVER w) / CASE WHEN stddev_pop(m) OVER w < 0.01 THEN 1 ELSE stddev_pop(m) OVER w END, 6) AS score FROM m WINDOW w AS (PARTITION BY episode_id, position_id)""")
def agg7_lip_matrix_median(s, d):
    x = _segs(s, d).select("episode_id", "speaker", (F.col("seg_idx") % 3).alias("position_id"), F.col("duration").alias("mad"))
    return binding.lip_matrix(x, "median", K).withColumn("score", F.round("score", 6))


@query(f"""WITH {_VOTE}, r AS (SELECT episode_id, speaker, CAST(sum(total) AS BIGINT) AS al FROM votes GROUP BY ALL)
SELECT v.episode_id, v.speaker, track_id, CAST((total * 2000 + al) // (2 * al) AS DOUBLE) / 1000 AS confidence, (total * 2000 + al) // (2 * al) < 400 AS needs_manual FROM votes v JOIN r USING (episode_id, speaker) WHERE track_id = 1""")
def agg8_binding_confidence(s, d):
    m = binding.vote_matrix(_windows(s, d), _segs(s, d), K, bin=10.0)
    a = m.filter("track_id = 1 and n > 0").select("episode_id", "speaker", "track_id")
    return binding.binding_confidence(m, a, keys=K)


@query("SELECT episode_id, concat('SPEAKER_0', CAST(label AS STRING)) AS speaker, CAST(avg(0.0625 + label * 0.0625) AS DOUBLE) AS cx, CAST(0.125 AS DOUBLE) AS w FROM fx_detections WHERE label < 4 GROUP BY ALL")
def agg9_speaker_zones(s, d):
    tracks = binding.face_tracks(_dets(s, d).filter("cluster < 4"), K)
    face_map = _dets(s, d).filter("cluster < 4").select("episode_id", F.concat(F.lit("SPEAKER_0"), F.col("cluster").cast("string")).alias("speaker"), "cx").distinct()
    n = F.row_number().over(Window.partitionBy("episode_id").orderBy("cx")) - 1
    return binding.speaker_zones(face_map.withColumn("track_id", n), tracks, K).select("episode_id", "speaker", "cx", "w")


@query("""SELECT episode_id, CAST(floor(sample_idx / 400.0) AS BIGINT) AS w, round(sqrt(avg(amp100 * amp100)) / 100, 6) AS rms FROM fx_samples WHERE floor(sample_idx / 400.0) < (SELECT floor(max(sample_idx) / 400.0) FROM fx_samples) GROUP BY ALL""")
def agg10_audio_rms(s, d):
    x = view(s, d, "fx_samples")
    last = x.agg(F.max("sample_idx").alias("m"))
    rows = x.crossJoin(last.hint("broadcast")).select("episode_id", "sample_idx", (F.col("amp100") / 100.0).alias("amplitude"), (F.floor(F.col("m") / 400) * 0.4).alias("duration"))
    return binding.audio_rms(rows, 1000.0, 0.4, K).withColumn("rms", F.round("rms", 6))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY sample_idx) - 1 AS i, count(*) OVER (PARTITION BY episode_id) AS a FROM fx_samples)
SELECT episode_id, CAST(i // 400 AS BIGINT) AS w, round(sqrt(sum(amp100 * amp100) / 400.0) / 100, 6) AS rms FROM n WHERE i // 400 < a // 400 GROUP BY ALL""")
def agg10_audio_rms_blocks(s, d):
    x = Scan(view(s, d, "fx_samples"), K, ["sample_idx"], F.floor(F.col("sample_idx") / 65536)).number("n").done().withColumn("i", F.col("n") - 1)
    all_ = x.groupBy("episode_id").agg((F.count("*") / 1000.0).alias("duration"))
    # blocks of 1,000 samples, which windows of 400 straddle
    pcm = F.transform(F.array_sort(F.collect_list(F.struct("i", "amp100"))), lambda v: v["amp100"].cast("smallint"))
    blocks = x.groupBy("episode_id", F.floor(F.col("i") / 1000).alias("b")).agg(pcm.alias("pcm")).withColumn("first", F.col("b") * 1000).join(all_, "episode_id")
    return binding.audio_rms_blocks(blocks, 1000.0, 0.4, 100.0, K).withColumn("rms", F.round("rms", 6))


_AUDIO = "aud AS (SELECT DISTINCT episode_id, w, rms1000 FROM fx_track_windows)"


def _audio(s, d):
    return view(s, d, "fx_track_windows").select("episode_id", "w", (F.col("rms1000") / 1000.0).alias("rms")).distinct()


@query(f"WITH {_AUDIO} SELECT episode_id, CAST(count(*) FILTER (rms1000 >= 5) AS BIGINT) AS active, count(*) AS total, round(count(*) FILTER (rms1000 < 5) * 100.0 / count(*), 1) AS skipped_pct FROM aud GROUP BY 1")
def agg11_voice_activity(s, d):
    return binding.voice_activity(_audio(s, d), keys=K)


@query("""WITH m AS (SELECT *, max(mad) OVER (PARTITION BY episode_id, w) AS mx FROM fx_track_windows WHERE rms1000 >= 5)
SELECT episode_id, w, track_id, mad, CASE WHEN mx > 0 THEN round(CASE WHEN mad / (mx + CAST(0.000001 AS DOUBLE)) < 0.6 THEN mad / (mx + CAST(0.000001 AS DOUBLE)) * CAST(0.3 AS DOUBLE) ELSE mad / (mx + CAST(0.000001 AS DOUBLE)) END, 4) ELSE 0 END AS score FROM m""")
def win19_activity_scores(s, d):
    x = view(s, d, "fx_track_windows").select("episode_id", "w", "track_id", "mad")
    return binding.activity_scores(x, _audio(s, d), keys=K)


@query("""SELECT episode_id, 'Speakers (' || count(DISTINCT speaker) || '): ' || string_agg(DISTINCT speaker, ', ' ORDER BY speaker) || CASE WHEN bool_or(right(speaker, 1) = '3') THEN '; low confidence: SPEAKER_03' ELSE '' END AS context FROM fx_segments GROUP BY 1""")
def agg12_speaker_context(s, d):
    z = _segs(s, d).select("episode_id", "speaker").distinct().withColumn("confidence", F.when(F.col("speaker").endswith("3"), 0.2).otherwise(0.9))
    return moments.speaker_context(_segs(s, d), z, keys=K)


_SLOTS = "slots AS (SELECT DISTINCT episode_id, label FROM fx_detections WHERE label % 3 <> 2 AND (episode_id % 2 = 0 OR label < 2))"


def _slots(s, d):
    x = view(s, d, "fx_detections").filter("label % 3 <> 2 and (episode_id % 2 = 0 or label < 2)").select("episode_id", "label").distinct()
    return x.select("episode_id", (F.col("label") * 0.0625).alias("cx"), F.lit(0.03125).alias("w"))


@query(f"""WITH {_SLOTS}, g AS (SELECT *, lead(label) OVER (PARTITION BY episode_id ORDER BY label) - label AS dd FROM slots), a AS (SELECT episode_id, count(*) AS b, min(dd) * 0.0625 AS sep FROM g GROUP BY 1), n AS (SELECT episode_id, count(DISTINCT speaker) AS a FROM fx_segments GROUP BY 1),
j AS (SELECT episode_id, coalesce(n.a, 0) AS a, coalesce(b, 0) AS b, sep FROM n FULL JOIN a USING (episode_id))
SELECT episode_id, a AS n_speakers, b AS n_face_slots, a = b AND a > 0 AS match, CAST((CASE WHEN a = 0 OR b = 0 OR a <> b THEN 1 ELSE 0 END) + (CASE WHEN sep < 0.08 THEN 1 ELSE 0 END) AS INTEGER) AS n_issues,
  CASE WHEN a > 0 AND b > 0 AND a = b THEN 0.95 WHEN a > 0 AND b > 0 AND abs(a - b) = 1 THEN 0.7 WHEN a > 0 AND b > 0 THEN 0.4 WHEN a > 0 OR b > 0 THEN 0.5 ELSE 0.2 END AS confidence_score,
  CAST(sep AS DOUBLE) AS min_separation, CASE WHEN a > 0 AND b > 0 AND a = b THEN 'alta' WHEN a > 0 AND b > 0 AND abs(a - b) > 1 THEN 'baja' WHEN a > 0 OR b > 0 THEN 'media' ELSE 'baja' END AS confidence FROM j""")
def agg13_speaker_coherence(s, d):
    return quality.speaker_coherence(_segs(s, d), _slots(s, d), K).select("episode_id", "n_speakers", "n_face_slots", "match", F.size("issues").alias("n_issues"), "confidence_score", "min_separation", "confidence")


@query(f"""WITH {_SLOTS} SELECT episode_id, count(*) AS n_slots, CAST(0.0313 AS DOUBLE) AS avg_width, round((max(label) - min(label)) * 0.0625, 4) AS spread, CAST(1 + (CASE WHEN (max(label) - min(label)) * 0.0625 < 0.15 AND count(*) > 1 THEN 1 ELSE 0 END) AS INTEGER) AS n_issues FROM slots GROUP BY 1""")
def agg14_slot_quality(s, d):
    return quality.slot_quality(_slots(s, d), K).select("episode_id", "n_slots", "avg_width", "spread", F.size("issues").alias("n_issues"))


@query(f"""WITH {_SLOTS}, g AS (SELECT *, lead(label) OVER (PARTITION BY episode_id ORDER BY label) - label AS dd FROM slots), x AS (SELECT episode_id, count(*) AS b, min(dd) * 0.0625 AS sep, (max(label) - min(label)) * 0.0625 AS spread FROM g GROUP BY 1),
c AS (SELECT episode_id, count(DISTINCT speaker) AS a, sum(end_ms - start_ms) * 100.0 / (arg_max(end_ms, start_ms) - min(start_ms)) AS cov FROM fx_segments GROUP BY 1)
SELECT episode_id, CAST(len(i) AS INTEGER) AS n_issues, array_to_string(i, '; ') AS issues FROM (SELECT episode_id, list_filter([CASE WHEN cov < 70 THEN 'low coverage' END,
  CASE WHEN coalesce(a, 0) = 0 THEN 'no speakers in the script' WHEN coalesce(b, 0) = 0 THEN 'no face slots' WHEN a <> b THEN 'speaker mismatch' END, CASE WHEN sep < 0.08 THEN 'slots too close' END,
  CASE WHEN spread < 0.15 AND b > 1 THEN 'slots close together' END, CASE WHEN b IS NOT NULL THEN 'small faces' END], lambda v: v IS NOT NULL) AS i FROM c FULL JOIN x USING (episode_id))""")
def agg15_validation_report(s, d):
    segs, slots = _segs(s, d), _slots(s, d)
    return quality.validation_report(quality.transcript_coverage(segs, K), quality.speaker_coherence(segs, slots, K), quality.slot_quality(slots, K), K).select("episode_id", "n_issues", F.array_join("issues", "; ").alias("issues"))


@query("""WITH m AS (SELECT episode_id, count(*) AS shorts FROM fx_moments GROUP BY 1), a AS (SELECT episode_id, count(*) FILTER (n_completed = 8) AS exported, bool_or(n_completed = 2) AS has_transcript FROM fx_jobs GROUP BY 1)
SELECT episode_id, coalesce(shorts, 0) AS shorts, coalesce(has_transcript, false) AS has_transcript, CAST(coalesce(exported, 0) AS BIGINT) AS exported, CASE WHEN shorts > 0 THEN floor(least(coalesce(exported, 0), shorts) * 1000.0 / shorts + 0.5) / 10 ELSE 0 END AS export_pct FROM m FULL JOIN a USING (episode_id)""")
def agg16_episode_counts(s, d):
    a = view(s, d, "fx_jobs").select("episode_id", F.when(F.col("n_completed") == 8, "final").when(F.col("n_completed") == 2, "transcript").otherwise("other").alias("kind"))
    return jobs.episode_counts(_moms(s, d), a, K)


@query("SELECT episode_id, count(*) AS segments_count, max(end_ms) AS duration_ms, CASE WHEN episode_id % 2 = 0 THEN 'es' END AS language FROM fx_segments GROUP BY 1")
def agg18_transcription_meta(s, d):
    info = _segs(s, d).filter("episode_id % 2 = 0").select("episode_id", F.lit("es").alias("language")).distinct()
    return quality.transcription_meta(_segs(s, d), info, K).select("episode_id", "segments_count", ms("duration_seconds", "duration_ms"), "language")


def _snaps(s, d):
    z = F.when(F.col("n_completed") > 3, F.create_map(F.lit("SPEAKER_00"), F.col("id").cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    return view(s, d, "fx_jobs").select("episode_id", "id", F.col("updated_at").cast("timestamp").alias("created_at"), z.alias("speaker_zones"))


@query("SELECT episode_id, CAST(id AS DOUBLE) AS zone FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY updated_at DESC, id DESC) AS r FROM fx_jobs WHERE n_completed > 3) WHERE r = 1")
def agg19_restore_zones(s, d):
    return jobs.restore_zones(_snaps(s, d), K).select("episode_id", F.element_at("speaker_zones", F.lit("SPEAKER_00")).alias("zone"))


@query(f"WITH {_SCORED} SELECT c AS category, episode_id, count(*) AS clips, sum(trend100) / 100.0 AS total, CAST(grouping(c, episode_id) AS BIGINT) AS level FROM (SELECT unnest(cats) AS c, episode_id, trend100 FROM trend) GROUP BY ROLLUP (c, episode_id)")
def agg20_category_rollup(s, d):
    return moments.category_rollup(moments.score_moments(_moms(s, d)), K)


# windows and sequence rules ----------------------------------------------------------------------
_TURNS = f"""{_OVER}, nw AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY episode_id, moment_idx ORDER BY c_start_ms, seg_idx) THEN 0 ELSE 1 END AS n FROM met),
isl AS (SELECT *, sum(n) OVER (PARTITION BY episode_id, moment_idx ORDER BY c_start_ms, seg_idx ROWS UNBOUNDED PRECEDING) AS g FROM nw),
tu AS (SELECT episode_id, moment_idx, g, any_value(speaker) AS speaker, min(c_start_ms) AS start_ms, arg_max(c_end_ms, seg_idx) AS end_ms, min(seg_idx) AS seg_idx FROM isl GROUP BY ALL)"""


@query(f"WITH {_TURNS} SELECT episode_id, moment_idx, speaker, start_ms, end_ms FROM tu")
def win2_merge_turns(s, d):
    return turns.merge_turns(turns.clipped_turns(_moms(s, d), _segs(s, d), K, 60.0), ["episode_id", "moment_idx"]).select("episode_id", "moment_idx", "speaker", ms("start"), ms("end"))


@query(f"WITH {_TURNS}, n AS (SELECT episode_id, moment_idx, string_agg(speaker || '@' || start_ms || '-' || end_ms, ' ' ORDER BY start_ms, seg_idx) AS t FROM tu GROUP BY ALL) SELECT m.episode_id, m.moment_idx, coalesce(t, '') AS turns FROM fx_moments m LEFT JOIN n USING (episode_id, moment_idx)")
def win3_speaker_turns(s, d):
    out = turns.speaker_turns(_moms(s, d), _segs(s, d), K, 60.0)
    return out.select("episode_id", "moment_idx", F.array_join(F.transform("speaker_turns", lambda t: F.concat(t["speaker"], F.lit("@"), F.round(t["start"] * 1000).cast("bigint").cast("string"), F.lit("-"), F.round(t["end"] * 1000).cast("bigint").cast("string"))), " ").alias("turns"))


def _absorbed(limit: int) -> str:
    return f"""{_TURNS}, kp AS (SELECT *, CASE WHEN end_ms - start_ms >= {limit} OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS keep FROM tu WINDOW w AS (PARTITION BY episode_id, moment_idx ORDER BY start_ms, seg_idx)),
kg AS (SELECT *, sum(keep) OVER (PARTITION BY episode_id, moment_idx ORDER BY start_ms, seg_idx ROWS UNBOUNDED PRECEDING) AS kgrp FROM kp),
ab AS (SELECT episode_id, moment_idx, kgrp, arg_min(speaker, seg_idx) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms, min(seg_idx) AS seg_idx FROM kg GROUP BY ALL)"""


def _cuts(s, d):
    return turns.merge_turns(turns.clipped_turns(_moms(s, d), _segs(s, d), K, 60.0), ["episode_id", "moment_idx"])


@query(f"WITH {_absorbed(4000)} SELECT episode_id, moment_idx, speaker, start_ms, end_ms FROM ab")
def win4_absorb_short(s, d):
    return turns.absorb_short(_cuts(s, d), 4.0, ["episode_id", "moment_idx"]).select("episode_id", "moment_idx", "speaker", ms("start"), ms("end"))


@query(f"WITH {_absorbed(300)} SELECT episode_id, moment_idx, speaker, start_ms, end_ms FROM ab")
def win5_fuse_tiny(s, d):
    return turns.absorb_short(_cuts(s, d), 0.3, ["episode_id", "moment_idx"]).select("episode_id", "moment_idx", "speaker", ms("start"), ms("end"))


@query(f"""WITH {_TURNS}, ts AS (SELECT episode_id, moment_idx, speaker, sum(end_ms - start_ms) AS s, min(start_ms) AS i FROM tu GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY episode_id, moment_idx ORDER BY s DESC, i) AS r, count(*) OVER (PARTITION BY episode_id, moment_idx) AS n, first_value(speaker) OVER (PARTITION BY episode_id, moment_idx ORDER BY s DESC, i) AS top FROM ts),
lb AS (SELECT t.*, n, coalesce(last_value(CASE WHEN r <= 2 THEN t.speaker END IGNORE NULLS) OVER (PARTITION BY t.episode_id, t.moment_idx ORDER BY start_ms, seg_idx ROWS UNBOUNDED PRECEDING), top) AS lab FROM tu t JOIN rk USING (episode_id, moment_idx, speaker)),
ln AS (SELECT *, CASE WHEN lab = lag(lab) OVER (PARTITION BY episode_id, moment_idx ORDER BY start_ms, seg_idx) THEN 0 ELSE 1 END AS nn FROM lb WHERE n > 2), lg AS (SELECT *, sum(nn) OVER (PARTITION BY episode_id, moment_idx ORDER BY start_ms, seg_idx ROWS UNBOUNDED PRECEDING) AS gg FROM ln)
SELECT episode_id, moment_idx, speaker, start_ms, end_ms FROM lb WHERE n <= 2 UNION ALL SELECT episode_id, moment_idx, any_value(lab), min(start_ms), arg_max(end_ms, seg_idx) FROM lg GROUP BY episode_id, moment_idx, gg""")
def win6_limit_speakers(s, d):
    return turns.limit_speakers(_cuts(s, d), 2, ["episode_id", "moment_idx"]).select("episode_id", "moment_idx", "speaker", ms("start"), ms("end"))


@query()
def win7_split_interruptions(s, d):
    return turns.split_interruptions(_cuts(s, d), ["episode_id", "moment_idx"]).select("episode_id", "moment_idx", "speaker", ms("start"), ms("end"))


@query()
def win8_camera_segments(s, d):
    return turns.camera_segments(_moms(s, d), _segs(s, d), _zones(s, d), K, bin=60.0).select("episode_id", "moment_idx", "speaker", ms("start"), ms("end"), "center_x", "center_y")


_LAB = "lab AS (SELECT episode_id, seg_idx AS win_idx, CAST(right(speaker, 1) AS INTEGER) AS label FROM fx_segments)"


@query(f"""WITH {_LAB}, n AS (SELECT a.episode_id, a.win_idx, b.label, count(*) AS c FROM lab a JOIN lab b ON a.episode_id = b.episode_id AND abs(a.win_idx - b.win_idx) <= 2 GROUP BY ALL)
SELECT episode_id, win_idx, CAST(arg_max(label, c * 10 - label) AS INTEGER) AS label FROM n GROUP BY ALL""")
def win10_smooth_labels(s, d):
    x = _segs(s, d).select("episode_id", F.col("seg_idx").alias("win_idx"), F.substring("speaker", -1, 1).cast("int").alias("label"))
    return turns.smooth_labels(x, 5, K).select("episode_id", "win_idx", "label")


@query("""WITH x AS (SELECT episode_id, seg_idx, CAST(floor(seg_idx / 3.0) % 3 AS INTEGER) AS label, start_ms AS t, max(end_ms) OVER (PARTITION BY episode_id) AS dur FROM fx_segments),
n AS (SELECT *, CASE WHEN label = lag(label) OVER w AND t - (lag(t) OVER w + 1500) < 2250 THEN 0 ELSE 1 END AS nn FROM x WINDOW w AS (PARTITION BY episode_id ORDER BY seg_idx)), g AS (SELECT *, sum(nn) OVER (PARTITION BY episode_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS gg FROM n)
SELECT episode_id, 'SPEAKER_0' || any_value(label) AS speaker, CAST(floor((min(t) + 5) / 10.0) AS BIGINT) AS start_cs, CAST(floor((least(max(t) + 1500, any_value(dur)) + 5) / 10.0) AS BIGINT) AS end_cs FROM g GROUP BY episode_id, gg HAVING least(max(t) + 1500, any_value(dur)) - min(t) >= 500""")
def win11_windows_to_segments(s, d):
    x = _segs(s, d).select("episode_id", F.col("seg_idx").alias("win_idx"), F.col("start").alias("t"), (F.floor(F.col("seg_idx") / 3) % 3).cast("int").alias("label"), F.max("end").over(Window.partitionBy("episode_id")).alias("duration"))
    return turns.windows_to_segments(x, keys=K, block=4096).select("episode_id", "speaker", F.floor((ms("start") + 5) / 10).alias("start_cs"), F.floor((ms("end") + 5) / 10).alias("end_cs"))


@query(f"WITH {_SCORED} SELECT episode_id, moment_idx, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY trend100 DESC, start_ms, moment_idx) AS INTEGER) AS rank FROM trend")
def win12_rank_moments(s, d):
    return moments.rank_moments(moments.score_moments(_moms(s, d)), K, bin=600.0).select("episode_id", "moment_idx", "rank")


@query("SELECT episode_id, moment_idx FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score10 DESC, start_ms, moment_idx) AS r FROM fx_moments) WHERE r <= 35")
def win13_cap_moments(s, d):
    return moments.cap_moments(_moms(s, d), keys=K).select("episode_id", "moment_idx")


@query("""WITH kept AS (SELECT * FROM fx_moments WHERE score10 >= 99 AND end_ms - start_ms BETWEEN 61000 AND 180000 AND moment_idx % 3 = 0), c AS (SELECT episode_id, count(k.moment_idx) AS n FROM (SELECT DISTINCT episode_id FROM fx_moments) e LEFT JOIN kept k USING (episode_id) GROUP BY 1),
x AS (SELECT p.*, c.n, row_number() OVER (PARTITION BY p.episode_id, p.start_ms, p.end_ms ORDER BY p.moment_idx) AS f FROM fx_moments p JOIN c USING (episode_id) WHERE c.n < 40 AND score10 >= 30 AND p.end_ms - p.start_ms BETWEEN 61000 AND 180000
  AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.episode_id = p.episode_id AND k.start_ms = p.start_ms AND k.end_ms = p.end_ms)),
y AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score10 DESC, moment_idx) AS r FROM x WHERE f = 1)
SELECT episode_id, moment_idx FROM kept UNION ALL SELECT episode_id, moment_idx FROM y WHERE r <= 45 - n""")
def win14_recover_moments(s, d):
    m = _moms(s, d)
    kept = moments.valid_moments(m).filter("score10 >= 99 and moment_idx % 3 = 0")
    return moments.recover_moments(kept, m, 40, 45, keys=K).select("episode_id", "moment_idx")


@query("""WITH RECURSIVE m AS (SELECT episode_id, moment_idx, start_ms, end_ms, row_number() OVER (PARTITION BY episode_id ORDER BY score10 DESC, moment_idx) AS k FROM fx_moments WHERE score10 >= 35),
g AS (SELECT episode_id, moment_idx, k, true AS ok, [struct_pack(s := start_ms, e := end_ms)] AS kept FROM m WHERE k = 1
UNION ALL SELECT episode_id, moment_idx, k, ok, CASE WHEN ok THEN list_append(kept, struct_pack(s := start_ms, e := end_ms)) ELSE kept END
FROM (SELECT m.*, g.kept, len(list_filter(g.kept, lambda x: 10 * (least(x.e, m.end_ms) - greatest(x.s, m.start_ms)) > 7 * (m.end_ms - m.start_ms))) = 0 AS ok FROM g JOIN m ON m.episode_id = g.episode_id AND m.k = g.k + 1))
SELECT episode_id, moment_idx FROM g WHERE ok""")
def win15_dedup_moments(s, d):
    return moments.dedup_moments(moments.min_score(_moms(s, d)), keys=K).select("episode_id", "moment_idx")


@query()
def win16_to_win18_enforce_constraints(s, d):
    m = _moms(s, d)
    out = moments.enforce_constraints(moments.dedup_moments(moments.min_score(m), keys=K), m, 20, 35, keys=K)
    return out.select("episode_id", ms("start"), ms("end"), "score", "reason")


@query("""WITH g AS (SELECT *, start_ms < 300000 AND end_ms - start_ms >= 1000 AS ok FROM fx_segments), h AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY episode_id) AS n FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY start_ms, seg_idx) AS k FROM h WHERE ok)
SELECT episode_id, speaker, seg_idx, CAST(i AS INTEGER) AS k, CAST(floor(start_ms + (end_ms - start_ms) * (i * 2 + 1) / 6.0) AS BIGINT) AS t_floor FROM r, (VALUES (0), (1), (2)) v(i) WHERE r.k <= 20""")
def win20_calibration_samples(s, d):
    return binding.calibration_samples(_segs(s, d), keys=K).select("episode_id", "speaker", "seg_idx", "k", F.floor(F.round(F.col("t") * 1000, 3)).alias("t_floor"))


@query("""SELECT episode_id, count(*) FILTER (score10 >= 95 AND end_ms - start_ms BETWEEN 100000 AND 180000) AS clips, 60 AS wanted FROM fx_moments GROUP BY 1 HAVING clips < 60""")
def win18_short_episodes(s, d):
    m = _moms(s, d)
    kept = moments.valid_moments(moments.min_score(m, 9.5), 100.0)
    return moments.short_episodes(kept, m, 60, K)


@query("""WITH r AS (SELECT *, end_ms - start_ms AS dd, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY end_ms - start_ms DESC, start_ms, seg_idx) AS r FROM fx_segments),
t AS (SELECT *, unnest(CASE WHEN dd >= 60000 THEN [15.0, 15 + 70 / 3.0, 15 + 140 / 3.0, 85] WHEN dd >= 20000 THEN [15.0, 85] ELSE [50.0] END) AS f FROM r WHERE r <= 15), n AS (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY r, f) AS n FROM t)
SELECT episode_id, speaker, CAST(n AS INTEGER) AS n, CAST(floor(round(start_ms + dd * f / 100, 3) / 10) AS BIGINT) AS t_cs FROM n WHERE n <= 15""")
def win21_speaker_timestamps(s, d):
    return binding.speaker_timestamps(_segs(s, d), keys=K).select("episode_id", "speaker", "n", F.floor(F.round(F.col("t") * 1000, 3) / 10).alias("t_cs"))


@query("""WITH m AS (SELECT episode_id, seg_idx AS block_idx, speaker, CASE WHEN seg_idx % 5 = 4 THEN seg_idx - 3 ELSE seg_idx END AS pos FROM fx_segments WHERE seg_idx % 2 = 0),
k AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY episode_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM m) WHERE mx IS NULL OR pos > mx),
e AS (SELECT k.*, s.start_ms, coalesce(lead(s.start_ms) OVER (PARTITION BY k.episode_id ORDER BY block_idx), (SELECT max(end_ms) FROM fx_segments z WHERE z.episode_id = k.episode_id)) AS en FROM k JOIN fx_segments s ON s.episode_id = k.episode_id AND s.seg_idx = k.pos),
f AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY episode_id ORDER BY start_ms) THEN 0 ELSE 1 END AS nn FROM e WHERE en - start_ms >= 500), g AS (SELECT *, sum(nn) OVER (PARTITION BY episode_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS gg FROM f)
SELECT episode_id, any_value(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(en, start_ms) AS end_ms FROM g GROUP BY episode_id, gg""")
def win22_matches_to_segments(s, d):
    x = _segs(s, d)
    m = x.filter("seg_idx % 2 = 0").select("episode_id", F.col("seg_idx").alias("block_idx"), "speaker", F.when(F.col("seg_idx") % 5 == 4, F.col("seg_idx") - 3).otherwise(F.col("seg_idx")).alias("seg_idx"))
    return turns.matches_to_segments(m, x, keys=K, block=600.0).select("episode_id", "speaker", ms("start"), ms("end"))


@query()
def win23_align_script(s, d):
    x = _segs(s, d)
    b = x.filter("seg_idx % 3 = 0").select("episode_id", F.col("seg_idx").alias("block_idx"), "speaker", "text")
    return quality.align_script(b, x, K)


@query("""WITH RECURSIVE lo AS (SELECT episode_id, CAST(floor(seg_idx / 30) AS BIGINT) AS seg, min(speaker) AS speaker, min(start_ms) AS s, max(end_ms) AS e FROM fx_segments GROUP BY ALL),
ga AS (SELECT episode_id, (end_ms + n) / 2 AS p, n - end_ms AS wide FROM (SELECT *, lead(start_ms) OVER (PARTITION BY episode_id ORDER BY seg_idx) AS n FROM fx_segments) WHERE n - end_ms >= 900),
me AS (SELECT lo.*, p, row_number() OVER (PARTITION BY lo.episode_id, seg ORDER BY wide DESC, p) AS r FROM lo JOIN ga ON lo.episode_id = ga.episode_id AND p BETWEEN s AND e WHERE e - s > 60000),
cu AS (SELECT *, row_number() OVER (PARTITION BY episode_id, seg ORDER BY p) AS k FROM me WHERE r <= 2 * greatest(1, floor((e - s) / 60000))),
fo AS (SELECT episode_id, seg, k, p, p - s >= 24000 AS ok, CASE WHEN p - s >= 24000 THEN p ELSE s END AS last FROM cu WHERE k = 1
UNION ALL SELECT cu.episode_id, cu.seg, cu.k, cu.p, cu.p - last >= 24000, CASE WHEN cu.p - last >= 24000 THEN cu.p ELSE last END FROM fo JOIN cu ON cu.episode_id = fo.episode_id AND cu.seg = fo.seg AND cu.k = fo.k + 1),
pt AS (SELECT episode_id, seg, p FROM fo WHERE ok UNION ALL SELECT episode_id, seg, p FROM cu WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM fo WHERE fo.episode_id = cu.episode_id AND fo.seg = cu.seg AND ok) UNION ALL SELECT episode_id, seg, s FROM lo),
pc AS (SELECT lo.episode_id, seg, speaker, p AS a, coalesce(lead(p) OVER (PARTITION BY lo.episode_id, seg ORDER BY p), e) AS b FROM pt JOIN lo USING (episode_id, seg))
SELECT episode_id, seg AS seg_idx, speaker, CAST(a AS BIGINT) AS start_ms, CAST(b AS BIGINT) AS end_ms FROM pc WHERE b - a > 500""")
def win24_split_long_segments(s, d):
    long_ = _segs(s, d).groupBy("episode_id", F.floor(F.col("seg_idx") / 30).alias("seg_idx")).agg(F.min("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"))
    return turns.split_long_segments(long_, _segs(s, d).withColumnRenamed("seg_idx", "line_no"), 60.0, 0.9, K).select("episode_id", "seg_idx", "speaker", ms("start"), ms("end"))


@query("""WITH x AS (SELECT *, CASE WHEN seg_idx % 10 = 4 THEN 'HOST' END AS lab, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY episode_id ORDER BY start_ms, seg_idx) > 1000 THEN 1 ELSE 0 END AS p FROM fx_segments),
i AS (SELECT *, sum(CASE WHEN lab IS NOT NULL OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY start_ms, seg_idx ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, seg_idx) AS r FROM x)),
q AS (SELECT *, first_value(lab) OVER (PARTITION BY episode_id, g ORDER BY start_ms, seg_idx) AS nm, sum(CASE WHEN rr = 1 THEN 0 ELSE p END) OVER (PARTITION BY episode_id, g ORDER BY start_ms, seg_idx ROWS UNBOUNDED PRECEDING) AS st FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, g ORDER BY start_ms, seg_idx) AS rr FROM i))
SELECT episode_id, seg_idx, CASE WHEN nm IS NOT NULL AND st = 0 THEN nm ELSE 'SPEAKER_0' || CAST(st % 5 + 1 AS BIGINT) END AS speaker FROM q""")
def win25_rotate_speakers(s, d):
    x = _segs(s, d).withColumn("speaker", F.when(F.col("seg_idx") % 10 == 4, "HOST"))
    return turns.rotate_speakers(x, 5, 1.0, K, block=600.0).select("episode_id", "seg_idx", "speaker")


def _stamped(s, d):
    at = lambda c: clips.srt_time(F.col(c))
    return _segs(s, d).select("episode_id", F.col("seg_idx").alias("line_no"), "start", "end", F.concat(F.lit("["), at("start"), F.lit(" --> "), at("end"), F.lit("] "), "text").alias("line"))


@query()
def win26_chunk_transcript(s, d):
    return quality.chunk_transcript(_stamped(s, d), 500, K).select("episode_id", "chunk_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH RECURSIVE l AS (SELECT *, length(line) + 1 AS n, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) AS k FROM (SELECT episode_id, seg_idx, '[' || {_stamp("start_ms")} || ' --> ' || {_stamp("end_ms")} || '] ' || text AS line FROM fx_segments)),
c AS (SELECT episode_id, k, line, n AS size, 0 AS chunk_idx FROM l WHERE k = 1
UNION ALL SELECT l.episode_id, l.k, l.line, CASE WHEN size + n > 1500 THEN n ELSE size + n END, chunk_idx + CASE WHEN size + n > 1500 THEN 1 ELSE 0 END FROM c JOIN l ON l.episode_id = c.episode_id AND l.k = c.k + 1),
w AS (SELECT *, CASE WHEN sum(length(line) + 1) OVER (PARTITION BY episode_id) <= 1501 THEN 0 ELSE chunk_idx END AS own FROM c)
SELECT episode_id, CAST(own AS INTEGER) AS chunk_idx, md5(string_agg(line, chr(10) ORDER BY k)) AS text_md5 FROM w GROUP BY episode_id, own""")
def win27_chunk_simple(s, d):
    return quality.chunk_simple(_stamped(s, d), 1500, K).select("episode_id", "chunk_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""WITH l AS (SELECT episode_id, seg_idx, CASE WHEN seg_idx % 4 = 1 THEN 'HOST ' || right(speaker, 1) END AS h, seg_idx % 4 = 1 AS is_h FROM fx_segments), g AS (SELECT *, sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS b FROM l)
SELECT episode_id, CAST(b AS BIGINT) AS block_idx, max(h) AS speaker, string_agg('line ' || seg_idx, ' ' ORDER BY seg_idx) AS text FROM g WHERE b > 0 GROUP BY episode_id, b""")
def win28_script_blocks(s, d):
    head = F.when(F.col("seg_idx") % 4 == 1, F.concat(F.lit("HOST "), F.substring("speaker", -1, 1), F.lit(": "))).otherwise("")
    x = _segs(s, d).select("episode_id", F.col("seg_idx").alias("line_no"), F.concat(head, F.lit("line "), F.col("seg_idx").cast("string"), F.lit(" [aside]")).alias("line"))
    return turns.script_blocks(x, K, block=4096)


@query()
def win29_cluster_faces(s, d):
    x = _dets(s, d).drop("cluster").withColumn("det", F.col("t").cast("bigint"))
    return binding.cluster_faces(x, 8, K).select("episode_id", "det", "cluster")


@query()
def win30_cluster_voices(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 20).alias("episode_id"), F.col("vec_id").alias("win_idx"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").cast("array<double>").alias("features"))
    return binding.cluster_voices(e, keys=K).select("episode_id", "win_idx", "label")


@query()
def win31_assign_speakers(s, d):
    m = binding.vote_matrix(_windows(s, d), _segs(s, d), K, bin=10.0)
    return binding.assign_speakers(m, keys=K)


_CELLS = f"""{_VOTE}, cells AS (SELECT c.episode_id, c.speaker, c.track_id, coalesce(total / CAST(n AS DOUBLE), 0) AS average FROM (SELECT * FROM (SELECT DISTINCT episode_id, speaker FROM fx_segments) JOIN (SELECT DISTINCT episode_id, track_id FROM wins) USING (episode_id)) c LEFT JOIN votes USING (episode_id, speaker, track_id))"""


@query(f"""WITH RECURSIVE {_CELLS}, l AS (SELECT episode_id, list(struct_pack(s := speaker, t := track_id) ORDER BY average DESC, speaker, track_id) AS l FROM cells WHERE average > 0 GROUP BY 1),
g AS (SELECT episode_id, l, CAST(NULL AS VARCHAR) AS speaker, CAST(NULL AS BIGINT) AS track_id FROM l
UNION ALL SELECT episode_id, list_filter(l, lambda x: x.s <> l[1].s AND x.t <> l[1].t), l[1].s, l[1].t FROM g WHERE len(l) > 0)
SELECT episode_id, speaker, track_id FROM g WHERE speaker IS NOT NULL""")
def win31_assign_greedy(s, d):
    return binding.assign_speakers(binding.vote_matrix(_windows(s, d), _segs(s, d), K, bin=10.0), "greedy", K)


@query(f"""WITH RECURSIVE {_CELLS}, n AS (SELECT episode_id, speaker, row_number() OVER (PARTITION BY episode_id ORDER BY speaker) AS k FROM (SELECT DISTINCT episode_id, speaker FROM cells)),
q AS (SELECT episode_id, least(count(DISTINCT speaker), count(DISTINCT track_id)) AS least FROM cells GROUP BY 1),
g AS (SELECT DISTINCT episode_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(0 AS DOUBLE) AS total FROM cells
UNION ALL SELECT g.episode_id, g.k + 1, CASE WHEN c.track_id IS NULL THEN used ELSE list_append(used, c.track_id) END, total + c.average
FROM g JOIN n ON n.episode_id = g.episode_id AND n.k = g.k + 1 JOIN (SELECT episode_id, speaker, track_id, average FROM cells UNION ALL SELECT DISTINCT episode_id, speaker, NULL, 0 FROM cells) c ON c.episode_id = n.episode_id AND c.speaker = n.speaker WHERE c.track_id IS NULL OR NOT list_contains(used, c.track_id)),
e AS (SELECT episode_id, max(k) AS k FROM g GROUP BY 1)
SELECT g.episode_id, any_value(q.least) AS pairs, round(max(total), 6) AS total FROM g JOIN e ON e.episode_id = g.episode_id AND e.k = g.k JOIN q ON q.episode_id = g.episode_id WHERE len(used) = q.least GROUP BY 1""")
def win31_assigned_total(s, d):
    """The optimum may be reached by several assignments, its total by one number only."""
    m = binding.vote_matrix(_windows(s, d), _segs(s, d), K, bin=10.0)
    got = binding.assign_speakers(m, keys=K).join(m, ["episode_id", "speaker", "track_id"])
    return got.groupBy("episode_id").agg(F.count("*").alias("pairs"), F.round(F.sum("average"), 6).alias("total"))


# sorts, sets, projections, texts -----------------------------------------------------------------
@query("SELECT id, status, CAST(row_number() OVER (ORDER BY CASE status WHEN 'running' THEN 1 WHEN 'paused' THEN 2 WHEN 'pending' THEN 3 WHEN 'awaiting_export' THEN 4 WHEN 'stopped' THEN 5 WHEN 'failed' THEN 6 WHEN 'completed' THEN 7 ELSE 8 END, updated_at DESC, 'ep' || CAST(episode_id AS STRING), id) AS BIGINT) AS position FROM fx_jobs")
def srt1_order_jobs(s, d):
    return jobs.order_jobs(_project(view(s, d, "fx_jobs"))).select("id", "status", "position")


@query("SELECT episode_id, moment_idx, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, moment_idx) AS INTEGER) AS position FROM fx_moments")
def srt3_order_shorts(s, d):
    return moments.order_shorts(_moms(s, d).withColumn("rank", F.lit(None).cast("int")), K).select("episode_id", "moment_idx", "position")


@query(f"WITH {_SCORED} SELECT episode_id, moment_idx, trend100 / 100.0 AS trend_score FROM trend ORDER BY trend100 DESC, episode_id, start_ms, moment_idx LIMIT 50")
def srt4_top_shorts(s, d):
    return moments.top_shorts(moments.score_moments(_moms(s, d)), 50, K).select("episode_id", "moment_idx", "trend_score")


@query("SELECT episode_id, id, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY updated_at DESC, id DESC) AS INTEGER) AS position FROM fx_jobs")
def srt5_snapshot_history(s, d):
    return jobs.snapshot_history(_snaps(s, d), K).select("episode_id", "id", "position")


@query("SELECT episode_id, moment_idx % 7 AS chunk_idx, moment_idx FROM fx_moments WHERE (moment_idx % 3 = 0 AND moment_idx % 7 < 5) OR moment_idx % 3 = 1")
def set1_union_chunk_results(s, d):
    m = _moms(s, d).select("episode_id", (F.col("moment_idx") % 7).alias("chunk_idx"), "moment_idx")
    return moments.union_chunk_results(m.filter("moment_idx % 3 = 0"), m.filter("moment_idx % 3 = 1"), m.filter("chunk_idx < 5").select("episode_id", "chunk_idx").distinct(), K)


@query("SELECT episode_id, seg_idx AS chunk_idx FROM fx_segments WHERE seg_idx % 3 <> 0")
def set2_pending_chunks(s, d):
    c = _segs(s, d).select("episode_id", F.col("seg_idx").alias("chunk_idx"))
    return moments.pending_chunks(c, c.filter("chunk_idx % 3 = 0"), K)


@query("""WITH x AS (SELECT job_id, list(DISTINCT CASE step WHEN 'face_track' THEN 'face_positions' WHEN 'guion' THEN 'analyze' ELSE step END) AS l FROM fx_job_events GROUP BY 1)
SELECT job_id, array_to_string(list_filter(['download', 'transcribe', 'diarize', 'face_positions', 'speaker_bind', 'analyze', 'edit', 'rank', 'export'], lambda s: list_contains(l, s)), ',') AS steps FROM x""")
def set3_normalize_steps(s, d):
    x = view(s, d, "fx_job_events").groupBy("job_id").agg(F.collect_list("step").alias("l"))
    return x.select("job_id", F.array_join(steps.normalize_steps(F.col("l")), ",").alias("steps"))


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN progress < 10 THEN 1 ELSE 0 END + CASE WHEN progress > 60 THEN 1 ELSE 0 END AS n FROM fx_jobs""")
def prj5_validate_job_requests(s, d):
    j = view(s, d, "fx_jobs")
    rows = j.select("id", F.when(F.col("id") % 5 == 0, "a/b").otherwise("p").alias("project"), F.lit("e.1").alias("episode"), F.when(F.col("id") % 7 == 0, "ftp://x").otherwise("https://x").alias("url"), F.lit(None).cast("string").alias("local_file"), F.when(F.col("id") % 11 == 0, "other").alias("diarization_provider"), F.col("progress").alias("min_duration"), F.lit(60).cast("bigint").alias("max_duration"), F.array(F.lit("download")).alias("steps"))
    return jobs.validate_job_requests(rows).select("id", F.size("reasons").alias("n"))


@query("""SELECT episode_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY episode_id ORDER BY line_no) AS b FROM (SELECT episode_id, seg_idx AS line_no, CASE WHEN seg_idx % 4 < 2 THEN '' ELSE '00:00:' || lpad(CAST(seg_idx % 60 AS STRING), 2, '0') || '.500 x' END AS line FROM fx_segments)) WHERE NOT (line = '' AND coalesce(b, 'x') = '')""")
def prj1_clean_transcript(s, d):
    line = F.when(F.col("seg_idx") % 4 < 2, "  ").otherwise(F.format_string(" 00:00:%02d,500 x ", F.col("seg_idx") % 60))
    return quality.clean_transcript(_segs(s, d).select("episode_id", F.col("seg_idx").alias("line_no"), line.alias("line")), K, block=4096)


@query("SELECT episode_id, seg_idx AS chunk_idx, md5('Between 61 and 180' || chr(10) || chr(10) || CASE WHEN episode_id % 2 = 0 THEN 'Two speakers' || chr(10) || chr(10) ELSE '' END || text) AS prompt_md5 FROM fx_segments")
def prj6_build_prompts(s, d):
    x = _segs(s, d).select("episode_id", F.col("seg_idx").alias("chunk_idx"), "text")
    c = x.filter("episode_id % 2 = 0").select("episode_id", F.lit("Two speakers").alias("context")).distinct()
    return moments.build_prompts(x, c, "Between %s and %s", keys=K).select("episode_id", "chunk_idx", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("""SELECT episode_id, moment_idx AS rank, CASE WHEN moment_idx % 4 = 0 THEN 'p' WHEN moment_idx % 4 = 1 THEN 'f' WHEN moment_idx % 4 = 2 THEN 'd' END AS file, moment_idx % 4 <> 3 AS has_video, moment_idx % 4 = 2 AS is_draft, (end_ms - start_ms) / 1000.0 AS duration FROM fx_moments""")
def prj7_clip_catalog(s, d):
    m = _moms(s, d).drop("duration").withColumn("rank", F.col("moment_idx"))
    k = F.col("rank") % 4
    a = m.filter(k < 3).select("episode_id", "rank", F.when(k == 0, "public").when(k == 1, "final").otherwise("draft").alias("kind"), F.when(k == 0, "p").when(k == 1, "f").otherwise("d").alias("path"))
    a = a.unionByName(m.filter(k < 2).select("episode_id", "rank", F.lit("draft").alias("kind"), F.lit("d").alias("path")))
    return jobs.clip_catalog(m, a, K).select("episode_id", "rank", "file", "has_video", "is_draft", "duration")


def _video(s, d):
    return _moms(s, d).select("episode_id").distinct().select("episode_id", F.lit(1920).alias("src_w"), F.lit(1080).alias("src_h"), F.lit(25.0).alias("fps"))


@query(f"""WITH {_TURNS}, z AS (SELECT *, CAST(right(speaker, 1) AS INTEGER) AS k FROM tu)
SELECT z.episode_id, z.moment_idx, z.start_ms - m.start_ms AS rel_start_ms, z.end_ms - m.start_ms AS rel_end_ms, 607 AS crop_w, CAST(greatest(0, least(trunc((CASE WHEN k < 3 THEN k * 0.25 + 0.125 ELSE 0.5 END) * 1920 - 303.5), 1313)) AS INTEGER) AS crop_x FROM z JOIN fx_moments m USING (episode_id, moment_idx) WHERE z.end_ms > z.start_ms""")
def prj8_edit_decisions(s, d):
    cuts = intervals.attach_zones(_cuts(s, d), _zones(s, d), K)
    return turns.edit_decisions(cuts, _moms(s, d), _video(s, d), keys=K).select("episode_id", "moment_idx", ms("rel_start"), ms("rel_end"), "crop_w", "crop_x")


@query(f"""WITH {_TURNS}, {_DOM}, n AS (SELECT episode_id, moment_idx, count(*) AS t FROM tu GROUP BY ALL), zc AS (SELECT episode_id, count(DISTINCT speaker) AS z FROM fx_segments WHERE right(speaker, 1) <> '3' GROUP BY 1)
SELECT m.episode_id, m.moment_idx, coalesce(t, 0) > 1 AND coalesce(z, 0) > 1 AS multi, CASE right(dominant_speaker, 1) WHEN '0' THEN 0.125 WHEN '1' THEN 0.375 WHEN '2' THEN 0.625 ELSE 0.5 END AS crop_cx FROM fx_moments m LEFT JOIN n USING (episode_id, moment_idx) LEFT JOIN zc USING (episode_id) LEFT JOIN dom USING (episode_id, moment_idx)""")
def prj10_camera_mode(s, d):
    m = turns.dominant_speaker(turns.speaker_turns(_moms(s, d), _segs(s, d), K, 60.0), _segs(s, d), K, 60.0)
    return turns.camera_mode(m, _zones(s, d), K).select("episode_id", "moment_idx", "multi", "crop_cx")


@query("""WITH v AS (SELECT episode_id, CAST(max(end_ms) AS DOUBLE) / 1000 AS dd FROM fx_segments GROUP BY 1), b AS (SELECT episode_id, least(5, dd * 0.05) AS lo, greatest(dd - 5, dd * 0.95) AS hi FROM v)
SELECT episode_id, CAST(k AS INTEGER) AS k, CAST(floor(round((lo + (hi - lo) * k / 59) * 100, 4)) AS BIGINT) AS t_cs FROM b, range(60) r(k)""")
def prj11_frame_sample_plan(s, d):
    v = _segs(s, d).groupBy("episode_id").agg(F.max("end").alias("duration"))
    return binding.frame_sample_plan(v, keys=K).select("episode_id", "k", F.floor(F.round(F.col("t") * 100, 4)).alias("t_cs"))


@query("SELECT episode_id, CAST(seg_idx - 1 AS INTEGER) AS cue_idx, start_ms, end_ms, length(text) AS n FROM fx_segments WHERE trim(text) <> ''")
def src1_src8_srt_round_trip(s, d):
    c = _cues(s, d).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", "  "))).withColumn("start", (F.col("start_ms") + 0.25) / 1000).withColumn("end", (F.col("end_ms") + 0.25) / 1000)
    back = io.parse_srt(io.render_srt(c, K).withColumnRenamed("srt", "text"), keys=K)
    # each gap between words went in as two spaces
    return back.select("episode_id", "cue_idx", ms("start"), ms("end"), F.length(F.replace("text", F.lit("  "), F.lit(" "))).cast("bigint").alias("n"))


@query("SELECT episode_id, CAST(seg_idx - 1 AS INTEGER) AS line_no, start_ms, end_ms FROM fx_segments WHERE trim(text) <> ''")
def src2_src9_transcript_round_trip(s, d):
    c = _segs(s, d).withColumn("text", F.regexp_replace("text", r"\s+", " ")).withColumn("start", (F.col("start_ms") + 0.25) / 1000).withColumn("end", (F.col("end_ms") + 0.25) / 1000)
    return io.parse_transcript(io.render_transcript(c, K).withColumnRenamed("transcript", "text"), K).select("episode_id", "line_no", ms("start"), ms("end"))


@query("SELECT episode_id, seg_idx - 1 AS idx, speaker, start_ms FROM fx_segments")
def src3_artifact_round_trip(s, d):
    one = F.struct("seg_idx", F.struct("speaker", "start", "end", "duration").alias("e"))
    text = F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]))
    rows = _segs(s, d).groupBy("episode_id").agg(text.alias("text"))
    return io.parse_artifact(rows, "speaker_segments", K).select("episode_id", F.col("idx").cast("bigint").alias("idx"), "speaker", ms("start"))


def _kept(s) -> str:
    """A new folder that all tasks can write to."""
    import tempfile
    import uuid

    root = s.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/catalog-{uuid.uuid4().hex}"


@query("SELECT id, CAST(n_completed AS INTEGER) AS done, CAST(CASE WHEN n_completed > 0 THEN 'download' END AS STRING) AS first, 9 AS planned FROM fx_jobs")
def src4_read_jobs(s, d):
    path = _kept(s)
    _job(s, d).select("id", F.to_json("steps").alias("steps"), F.to_json("steps_completed").alias("steps_completed")).write.parquet(path)
    return io.read_jobs(s, path).select("id", F.size("steps_completed").alias("done"), F.get("steps_completed", F.lit(0)).alias("first"), F.size("steps").alias("planned"))


@query("SELECT id, status, CAST(n_completed AS INTEGER) AS done, CAST(CASE WHEN n_completed > 0 THEN 'download' END AS STRING) AS first FROM fx_jobs WHERE id % 3 = 0 OR status = 'running'")
def src4_read_jobs_jdbc(s, d):
    """Through a database in the driver's memory, which only tasks in that process can reach: for local masters."""
    import uuid

    base = {"url": f"jdbc:derby:memory:jobs{uuid.uuid4().hex};create=true", "dbtable": "jobs"}
    rows = _job(s, d).select("id", "status", "updated_at", "steps_completed")
    io.write_jdbc(rows, base | {"createTableColumnTypes": "status VARCHAR(20)"})
    jobs_ = io.read_jobs(s, base | {"partitionColumn": "id", "numPartitions": 4})
    return jobs_.filter("id % 3 = 0 or status = 'running'").select("id", "status", F.size("steps_completed").alias("done"), F.get("steps_completed", F.lit(0)).alias("first"))


@query("SELECT 'project=P' AS project, 'episode=Ep' || episode_id AS episode, CAST(1 AS BIGINT) AS files FROM fx_segments GROUP BY episode_id")
def src6_read_artifacts(s, d):
    path = _kept(s)
    io.write_artifact(_project(_segs(s, d)).repartition("project", "episode"), path)
    return io.read_artifacts(s, path).filter("length > 0 and episode like 'episode=%'").groupBy("project", "episode").agg(F.count("*").alias("files"))


@query("SELECT episode_id, seg_idx, CASE WHEN episode_id % 2 = 0 THEN 'new' ELSE speaker END AS speaker FROM fx_segments")
def src7_write_artifact(s, d):
    path, rows = _kept(s), _project(_segs(s, d))
    io.write_artifact(rows, path)
    io.write_artifact(rows.filter("episode_id % 2 = 0").withColumn("speaker", F.lit("new")), path)
    return s.read.parquet(path).select("episode_id", "seg_idx", "speaker")


@query("SELECT episode_id, moment_idx % 50 AS chunk_idx, count(*) FILTER (moment_idx % 50 % 7 <> 0) AS moments, CAST(coalesce(sum(start_ms) FILTER (moment_idx % 50 % 7 <> 0), 0) AS BIGINT) AS starts, CAST(coalesce(sum(score10) FILTER (moment_idx % 50 % 7 <> 0), 0) AS BIGINT) AS scores, CAST(max(CASE WHEN moment_idx % 50 % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM fx_moments GROUP BY ALL")
def src5_parse_model_responses(s, d):
    c = _moms(s, d).withColumn("chunk_idx", F.col("moment_idx") % 50)
    body = F.to_json(F.collect_list(F.struct("start", "end", "score", "topic", "hook", "summary", "reason")))
    r = c.groupBy("episode_id", "chunk_idx").agg(F.concat(F.lit("Here:\n"), F.when(F.col("chunk_idx") % 7 == 0, F.lit("[{broken")).otherwise(body), F.lit("\nEnd")).alias("response"))
    good, bad = io.parse_model_responses(r, K)
    n = good.groupBy("episode_id", "chunk_idx").agg(F.count("*").alias("moments"), F.sum(ms("start")).alias("starts"), F.sum(F.round(F.col("score") * 10).cast("bigint")).alias("scores"), F.lit(0).cast("bigint").alias("rejected"))
    return n.unionByName(bad.select("episode_id", "chunk_idx", *[F.lit(0).cast("bigint").alias(c) for c in ("moments", "starts", "scores")], F.lit(1).cast("bigint").alias("rejected")))


@query("""WITH o AS (SELECT *, row_number() OVER w AS clip, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY episode_id ORDER BY CASE WHEN moment_idx % 3 = 0 THEN moment_idx ELSE 10000 END, start_ms, moment_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM fx_moments WINDOW w AS (PARTITION BY episode_id ORDER BY CASE WHEN moment_idx % 3 = 0 THEN moment_idx ELSE 10000 END, start_ms, moment_idx))
SELECT episode_id, moment_idx, CAST(clip AS INTEGER) AS clip, CAST(start_ms / 40 AS BIGINT) AS start_frames, CAST((end_ms - start_ms) / 40 AS BIGINT) AS dur_frames, CAST(b / 40 AS BIGINT) AS offset_frames FROM o""")
def src11_build_timeline(s, d):
    m = _moms(s, d).withColumn("rank", F.when(F.col("moment_idx") % 3 == 0, F.col("moment_idx").cast("int")))
    return io.build_timeline(m, _video(s, d), K).select("episode_id", "moment_idx", "clip", "start_frames", "dur_frames", "offset_frames")


@query("""WITH o AS (SELECT *, start_ms // 40 AS s, (end_ms - start_ms) // 40 AS d, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY episode_id ORDER BY moment_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 40 AS b FROM fx_moments),
x AS (SELECT episode_id, CAST(sum(d) AS BIGINT) AS total, string_agg('<asset-clip name="' || topic || '" ref="r2" offset="' || b || '/25s" start="' || s || '/25s" duration="' || d || '/25s" format="r1" tcFormat="NDF"><marker start="' || s || '/25s" value="Score: ' || CAST(score10 / 10 AS DOUBLE) || ' | Hook: ' || hook || ' | "/></asset-clip>', '' ORDER BY moment_idx) AS clips FROM o GROUP BY episode_id),
t AS (SELECT episode_id, '<?xml version="1.0" encoding="utf-8"?><fcpxml version="1.10"><resources><format id="r1" frameDuration="1/25s" width="1920" height="1080"/></resources><library><event><project><sequence format="r1" tcStart="0/1s" tcFormat="NDF" duration="' || total || '/25s"><spine>' || clips || '</spine></sequence></project></event></library></fcpxml>' AS xml FROM x)
SELECT episode_id, md5(xml) AS fcpxml_md5, CAST(length(xml) AS INTEGER) AS n FROM t""")
def src11_render_fcpxml(s, d):
    m = _moms(s, d).withColumn("rank", F.col("moment_idx").cast("int"))
    return io.render_fcpxml(io.build_timeline(m, _video(s, d), K), K).select("episode_id", F.md5(F.col("fcpxml").cast("binary")).alias("fcpxml_md5"), F.length("fcpxml").alias("n"))


@query(f"""WITH {_TURNS} SELECT episode_id, moment_idx, CAST(row_number() OVER w - 1 AS INTEGER) AS turn, speaker, (end_ms - start_ms) / 1000.0 AS duration, coalesce(speaker <> lag(speaker) OVER w, false) AS camera_change FROM tu WINDOW w AS (PARTITION BY episode_id, moment_idx ORDER BY start_ms, seg_idx)""")
def src12_shooting_script(s, d):
    return io.shooting_script(turns.speaker_turns(_moms(s, d), _segs(s, d), K, 60.0), K)


@query("SELECT episode_id, moment_idx, CAST(CASE episode_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS source FROM fx_moments WHERE moment_idx % 2 = 0 OR episode_id % 3 = 2")
def src13_resolve_moments(s, d):
    m = _moms(s, d).select("episode_id", "moment_idx")
    half = m.filter("moment_idx % 2 = 0")
    return io.resolve_moments([half.filter("episode_id % 3 = 0"), half.filter("episode_id % 3 < 2"), m], K)


@query(f"""WITH {_TURNS}, n AS (SELECT episode_id, moment_idx, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS sp FROM tu GROUP BY ALL)
SELECT m.episode_id, CAST(row_number() OVER (PARTITION BY m.episode_id ORDER BY start_ms, moment_idx) AS INTEGER) AS short_index, topic AS title, start_ms, end_ms, score10, (end_ms - start_ms) / 1000.0 AS duration, coalesce(sp, '') AS speakers, 'rerun' AS snapshot_reason FROM fx_moments m LEFT JOIN n USING (episode_id, moment_idx)""")
def src14_snapshot_moments(s, d):
    m = turns.speaker_turns(_moms(s, d), _segs(s, d), K, 60.0).withColumn("rank", F.lit(None).cast("int"))
    out = io.snapshot_moments(m, _zones(s, d), "rerun", F.lit("2024-01-01").cast("timestamp"), K)
    return out.select("episode_id", "short_index", "title", ms("start"), ms("end"), F.round(F.col("score") * 10).cast("bigint").alias("score10"), "duration", F.array_join("speakers", ",").alias("speakers"), "snapshot_reason")


# streaming rules on tables, and the scorer -------------------------------------------------------
@query("""SELECT job_id, arg_max(step, (occurred_at, id)) FILTER (step NOT IN ('done', 'awaiting_export')) AS current_step, arg_max(percent, (occurred_at, id)) FILTER (percent IS NOT NULL) AS progress FROM fx_job_events GROUP BY 1""")
def str1_job_state(s, d):
    return jobs.job_state(view(s, d, "fx_job_events")).select("job_id", "current_step", "progress")


@query("""WITH p AS (SELECT job_id, CASE step WHEN 'face_track' THEN 'face_positions' WHEN 'guion' THEN 'analyze' ELSE step END AS step, max(coalesce(percent, 0)) AS percent,
  CASE any_value(step) WHEN 'download' THEN 1 WHEN 'transcribe' THEN 2 WHEN 'face_track' THEN 4 ELSE 6 END AS i FROM fx_job_events WHERE step <> 'done' GROUP BY ALL), l AS (SELECT *, i < max(i) OVER (PARTITION BY job_id) AS d FROM p)
SELECT job_id, step, CASE WHEN d THEN 100 ELSE percent END AS percent, CASE WHEN d THEN 'done' ELSE 'active' END AS state FROM l""")
def str2_step_progress(s, d):
    return jobs.finished_before(jobs.step_progress(view(s, d, "fx_job_events")))


@query("""WITH e AS (SELECT *, min(CASE WHEN step = 'done' THEN (occurred_at, id) END) OVER (PARTITION BY job_id) AS stop FROM fx_job_events), x AS (SELECT * FROM e WHERE stop IS NULL OR (occurred_at, id) <= stop)
SELECT job_id, nullif(arg_max(coalesce(percent, -1), (occurred_at, id)), -1) AS percent, bool_or(step = 'done') AS ended FROM x GROUP BY job_id, floor(epoch(occurred_at) / 3600)""")
def str3_throttle(s, d):
    return streams.throttle_stream(view(s, d, "fx_job_events"), "1 hour").select("job_id", "percent", "ended")


@query("SELECT episode_id, round(sqrt(avg(amp100 * amp100)) / 100, 6) AS rms, sqrt(avg(amp100 * amp100)) / 100 >= 0.5 AS voiced FROM fx_samples GROUP BY episode_id, floor(epoch(ts) / 3600)")
def str4_rms_windows(s, d):
    return streams.rms_stream(_samples(s, d), "1 hour", 0.5, keys=K, full=100.0).select("episode_id", F.round("rms", 6).alias("rms"), "voiced")


def _samples(s, d):
    return view(s, d, "fx_samples").select("episode_id", F.col("ts").cast("timestamp").alias("ts"), F.col("amp100").alias("amplitude"), (F.col("sample_idx") % 2).alias("label"))


@query("""WITH w AS (SELECT episode_id, amp100, unnest([floor(epoch(ts) / 1800), floor(epoch(ts) / 1800) - 1]) AS w FROM fx_samples) SELECT episode_id, CAST(w * 1800 AS BIGINT) AS at_s, round(sqrt(avg(amp100 * amp100)) / 100, 6) AS rms FROM w GROUP BY ALL HAVING sqrt(avg(amp100 * amp100)) / 100 >= 0.55""")
def str5_voice_windows(s, d):
    return streams.voice_windows_stream(_samples(s, d), "1 hour", "30 minutes", 0.55, keys=K, full=100.0).select("episode_id", F.unix_seconds("at").alias("at_s"), F.round("rms", 6).alias("rms"))


@query("""WITH x AS (SELECT episode_id, sample_idx % 2 AS label, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY episode_id, sample_idx % 2 ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM fx_samples), g AS (SELECT *, sum(n) OVER (PARTITION BY episode_id, label ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT episode_id, label, count(*) AS windows FROM g GROUP BY episode_id, label, g""")
def str6_speech_sessions(s, d):
    return streams.speech_sessions(_samples(s, d), "30 minutes", keys=K).select("episode_id", "label", "windows")


@query("SELECT job_id FROM (SELECT job_id, max(occurred_at) AS last, arg_max(step, (occurred_at, id)) AS step FROM fx_job_events GROUP BY 1) WHERE step <> 'done' AND epoch(last) < epoch((SELECT max(occurred_at) FROM fx_job_events)) - 3600")
def str7_stale_jobs(s, d):
    e = view(s, d, "fx_job_events")
    return jobs.stale_jobs(e, F.lit(e.agg(F.max("occurred_at")).first()[0]), 3600.0).select("job_id")


@query("""WITH l AS (SELECT job_id, CASE WHEN id % 3 = 0 THEN 'paused' ELSE 'running' END AS status, occurred_at, lead(occurred_at) OVER (PARTITION BY job_id ORDER BY occurred_at, id) AS n FROM fx_job_events)
SELECT job_id, CAST((CAST(sum(epoch_us(n) // 1000 - epoch_us(occurred_at) // 1000) AS BIGINT) + 50) // 100 AS DOUBLE) / 10 AS elapsed_seconds FROM l WHERE status = 'running' AND n IS NOT NULL GROUP BY 1""")
def str8_active_elapsed(s, d):
    log = view(s, d, "fx_job_events").select("job_id", "id", F.when(F.col("id") % 3 == 0, "paused").otherwise("running").alias("status"), "occurred_at")
    return jobs.active_elapsed(log).select("job_id", "elapsed_seconds")


@query("SELECT id, step FROM fx_job_events")
def str9_dedup_events(s, d):
    e = view(s, d, "fx_job_events")
    return streams.dedup_events(e.unionByName(e.filter("id % 3 = 0"))).select("id", "step")


def _replayed(s, rows, make, write, batches: int = 1) -> str:
    """A stream over ``rows``, which come in so many batches, run to its end. Returns the folder that ``write`` has been given."""
    src, to = _kept(s), _kept(s)
    rows.repartition(batches).write.parquet(src)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    write(make(stream).writeStream, to).option("checkpointLocation", _kept(s)).trigger(availableNow=True).start().awaitTermination()
    return to


def _upserted(key, mode: str = "update"):
    return lambda w, to: w.outputMode(mode).foreachBatch(streams.upsert(to, key, fan=3))


def _appended(w, to):
    return w.outputMode("append").format("parquet").option("path", to)


@query(ORACLE["str1_job_state"])
def str1_job_state_live(s, d):
    to = _replayed(s, view(s, d, "fx_job_events"), streams.job_state_stream, _upserted(["job_id"]), 4)
    return streams.latest(s, to, ["job_id"]).select("job_id", "current_step", "progress")


@query(ORACLE["str2_step_progress"])
def str2_step_progress_live(s, d):
    to = _replayed(s, view(s, d, "fx_job_events"), streams.step_progress_stream, _upserted(["job_id", "step"]), 4)
    return jobs.finished_before(streams.latest(s, to, ["job_id", "step"]))


@query(ORACLE["str4_rms_windows"])
def str4_rms_windows_live(s, d):
    to = _replayed(s, _samples(s, d), lambda e: streams.rms_stream(e, "1 hour", 0.5, keys=K, full=100.0), _upserted(["episode_id", "at"]))
    return streams.latest(s, to, ["episode_id", "at"]).select("episode_id", F.round("rms", 6).alias("rms"), "voiced")


@query(ORACLE["str7_stale_jobs"])
def str7_stale_jobs_live(s, d):
    e = view(s, d, "fx_job_events").repartition(1)
    key = "spark.sql.streaming.stateStore.providerClass"
    old = s.conf.get(key)
    streams.keep_states_on_disk(s)
    try:
        to = _replayed(s, e, lambda e: streams.stale_jobs_stream(e, 3600.0, "0 seconds"), _appended)
    finally:
        s.conf.set(key, old)
    return s.read.parquet(to).select("job_id")


@query(ORACLE["str9_dedup_events"])
def str9_dedup_events_live(s, d):
    e = view(s, d, "fx_job_events")
    return s.read.parquet(_replayed(s, e.unionByName(e.filter("id % 3 = 0")), streams.dedup_events, _appended)).select("id", "step")


@query()
def udf1_score_chunks(s, d):
    chunks = quality.chunk_transcript(_stamped(s, d), 500, K)
    got = scoring.score_chunks(chunks.withColumnRenamed("text", "prompt"), keys=K)
    return io.parse_model_responses(got, K)[0].select("episode_id", "chunk_idx", "moment_idx", ms("start"), ms("end"), "score")


@query(f"""WITH RECURSIVE l AS (SELECT *, length(line) + 1 AS n, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) AS k FROM (SELECT episode_id, seg_idx, start_ms, end_ms, text, '[' || {_stamp("start_ms")} || ' --> ' || {_stamp("end_ms")} || '] ' || text AS line FROM fx_segments)),
c AS (SELECT episode_id, k, n AS size, 0 AS chunk_idx FROM l WHERE k = 1
UNION ALL SELECT l.episode_id, l.k, CASE WHEN size + n > 1500 THEN n ELSE size + n END, chunk_idx + CASE WHEN size + n > 1500 THEN 1 ELSE 0 END FROM c JOIN l ON l.episode_id = c.episode_id AND l.k = c.k + 1),
w AS (SELECT l.*, CASE WHEN sum(n) OVER (PARTITION BY episode_id) <= 1501 THEN 0 ELSE chunk_idx END AS own FROM c JOIN l USING (episode_id, k)),
o AS (SELECT *, (row_number() OVER (PARTITION BY episode_id, own ORDER BY k) - 1) // 3 AS part FROM w),
p AS (SELECT episode_id, own, part, min({_stamped_ms("start_ms")}) AS start_ms, max({_stamped_ms("end_ms")}) AS end_ms, lower(string_agg(split_part(text, chr(10), 1), ' ' ORDER BY k)) AS t FROM o GROUP BY ALL)
SELECT episode_id, CAST(own AS INTEGER) AS chunk_idx, CAST(part AS INTEGER) AS moment_idx, start_ms, end_ms, least(10.0, 3 + 1.5 * ({" + ".join(f"CAST(({x}) AS INTEGER)" for x in _HITS.values())})) AS score FROM p""")
def udf1_score_simple_chunks(s, d):
    chunks = quality.chunk_simple(_stamped(s, d), 1500, K)
    got = scoring.score_chunks(chunks.withColumnRenamed("text", "prompt"), keys=K)
    return io.parse_model_responses(got, K)[0].select("episode_id", "chunk_idx", "moment_idx", ms("start"), ms("end"), "score")


@query("SELECT episode_id, moment_idx, round_even(CAST(moment_idx * 31 + score10 AS DOUBLE) / 64, 2) AS r2 FROM fx_moments")
def udf3_py_round(s, d):
    # 64ths are exact in binary and hold true ties
    return _moms(s, d).select("episode_id", "moment_idx", clips.py_round((F.col("moment_idx") * 31 + F.col("score10")) / F.lit(64.0), 2).alias("r2"))


# Columns that SQL makes decimals of.
_DOUBLES = {
    "fn4_to_fn7_trend_score": "CAST(keyword_score AS DOUBLE) AS keyword_score",
    "fn6_older_duration_score": "CAST(points AS DOUBLE) AS points",
    "join9_attach_zones": "CAST(center_x AS DOUBLE) AS center_x, CAST(center_y AS DOUBLE) AS center_y",
    "agg4_face_positions": "CAST(cx AS DOUBLE) AS cx",
    "agg13_speaker_coherence": "CAST(confidence_score AS DOUBLE) AS confidence_score",
    "agg14_slot_quality": "CAST(spread AS DOUBLE) AS spread",
    "prj10_camera_mode": "CAST(crop_cx AS DOUBLE) AS crop_cx",
}
for _name, _cols in _DOUBLES.items():
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({_cols}) FROM ({ORACLE_SQL[_name]})"
