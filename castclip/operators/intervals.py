"""Joins of intervals and points in time, on keys and a range.

Without ``bin`` a join is by keys and the range; with it, both sides are dealt to time bins of that many seconds, so that
one long recording is shared among tasks, and each pair comes out once, in the bin where the later of both begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Scan, bins

KEYS = ("project", "episode")


def _bins(start: Column, end: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(F.greatest(start, end) / size)))


def interval_join(left: DataFrame, right: DataFrame, keys=KEYS, closed: bool = False, bin: float | None = None, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals (``start``, ``end``); the right side's columns come as r_<name>.

    closed: touching counts. how: inner, or left, which keeps rows without a partner."""
    keys = list(keys)
    r = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    over = (F.col("end") >= F.col("r_start")) & (F.col("start") <= F.col("r_end")) if closed else (F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end"))

    def on(a: DataFrame, b: DataFrame, more: list[str]) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"_k_{c}") if c in keys + more else F.col(c) for c in b.columns])
        same = F.lit(True)
        for c in keys + more:
            same = same & (F.col(c) == F.col(f"_k_{c}"))
        return a.join(b, same & over, how if not more else "inner").drop(*[f"_k_{c}" for c in keys + more])

    if bin is None:
        return on(left, r, [])
    a = left.withColumn("_bin", _bins(F.col("start"), F.col("end"), bin))
    b = r.withColumn("_bin", _bins(F.col("r_start"), F.col("r_end"), bin))
    met = on(a, b, ["_bin"]).filter(F.col("_bin") == F.greatest(F.floor(F.col("start") / bin), F.floor(F.col("r_start") / bin))).drop("_bin")
    if how == "inner":
        return met
    seen = met.select(*[F.col(c).alias(f"_s_{c}") for c in left.columns]).distinct()
    same = F.lit(True)
    for c in left.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return met.unionByName(left.join(seen, same, "left_anti"), allowMissingColumns=True)


def speaker_at(lines: DataFrame, segments: DataFrame, keys=KEYS, default: str = "SPEAKER_?", bin: float | None = None) -> DataFrame:
    """``lines`` (line_no, t) with the speaker of the first segment that holds t, both ends included."""
    keys = list(keys)
    points = lines.withColumn("start", F.col("t")).withColumn("end", F.col("t")).select(*keys, "line_no", "t", "start", "end")
    met = interval_join(points.filter("t is not null"), segments.select(*keys, "seg_idx", "speaker", "start", "end"), keys, True, bin)
    first = met.groupBy(*keys, "line_no").agg(F.min_by("r_speaker", F.struct("r_start", "r_seg_idx")).alias("speaker"))
    return lines.join(first, [*keys, "line_no"], "left").withColumn("speaker", F.when(F.col("t").isNotNull(), F.coalesce("speaker", F.lit(default))))


def overlap_join(moments: DataFrame, segments: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """Moments and the segments they overlap, with the common part as c_start, c_end."""
    met = interval_join(moments, segments, keys, bin=bin)
    return met.withColumn("c_start", F.greatest("start", "r_start")).withColumn("c_end", F.least("end", "r_end"))


def cues_in_range(moments: DataFrame, cues: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """Each moment with the text of its cues in order (NULL if it has none). Rows that share a moment_idx have all their cues; rows without one have none.

    Pairs of a moment and a cue are never dealt out. Time is cut in blocks, for moments shorter than four bins (of 60 s, if not given) twice as long as that, for longer ones four times as long, and so on.
    A moment goes to the block of its start; to a block come, as one row, all cues that its moments may reach, once for each size of block that moments need."""
    keys, bin = list(keys), bin or 60.0
    reach = F.pow(F.lit(4.0), F.col("_size")) * bin
    own = Window.partitionBy(*keys, "moment_idx")
    rows = moments.withColumns({"_n": F.count("*").over(own), "_from": F.least(F.min("start").over(own), F.min("end").over(own)), "_to": F.greatest(F.max("start").over(own), F.max("end").over(own))})
    rows = rows.withColumn("_spans", F.collect_list(F.when((F.col("_n") > 1) & F.col("moment_idx").isNotNull(), F.struct("start", "end"))).over(own))
    rows = rows.withColumn("_size", F.floor(F.log(4.0, F.greatest((F.col("_to") - F.col("_from")) / bin, F.lit(1.0))) + 1e-9) + 1).withColumn("_block", F.floor(F.col("_from") / (reach * 2)))
    blocks = F.sequence(F.floor((F.least("start", "end") - reach) / (reach * 2)), F.floor(F.greatest("start", "end") / (reach * 2)))
    said = cues.select(*keys, "cue_idx", "start", "end", "text").crossJoin(F.broadcast(rows.select("_size").filter("_size is not null").distinct())).withColumn("_block", F.explode(blocks))
    said = said.groupBy(*keys, "_size", "_block").agg(F.array_sort(F.collect_list(F.struct("start", "cue_idx", "text", "end"))).alias("_cues"))

    meet = lambda m, c: (m["end"] > c["start"]) & (m["start"] < c["end"])
    one = F.transform(F.filter("_cues", lambda c: meet({"start": F.col("start"), "end": F.col("end")}, c)), lambda c: c["text"])
    each = F.flatten(F.transform("_cues", lambda c: F.transform(F.filter("_spans", lambda m: meet(m, c)), lambda m: c["text"])))
    met = rows.join(said, [*keys, "_size", "_block"], "left").withColumn("_texts", F.when(F.col("moment_idx").isNotNull(), F.when(F.col("_n") == 1, one).otherwise(each)))
    text = F.when(F.size("_texts") > 0, F.array_join("_texts", " ")).alias("text")
    return met.select(*keys, "moment_idx", *[c for c in moments.columns if c not in (*keys, "moment_idx")], text)


def sub_srt(moments: DataFrame, cues: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """Cues of each moment, in its own time and clamped to it, numbered from 1."""
    keys = list(keys)
    met = interval_join(moments.select(*keys, "moment_idx", "start", "end"), cues.select(*keys, "cue_idx", "start", "end", "text"), keys, bin=bin)
    w = Window.partitionBy(*keys, "moment_idx").orderBy("r_start", "r_cue_idx")
    return met.select(
        *keys, "moment_idx", F.row_number().over(w).alias("n"), F.greatest(F.lit(0.0), F.col("r_start") - F.col("start")).alias("start_in"),
        F.least(F.col("end") - F.col("start"), F.col("r_end") - F.col("start")).alias("end_in"), F.col("r_text").alias("text"),
    )


def activity_votes_join(windows: DataFrame, segments: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """Activity windows (start, end, track_id, score) with each segment they touch."""
    return interval_join(windows, segments, keys, True, bin)


def snap_to_words(moments: DataFrame, cues: DataFrame, keys=KEYS, least: float = 60.0, bin: float | None = None) -> DataFrame:
    """Start goes to the next word's start (else the last one), end to the previous word's end (else the first one)."""
    keys = list(keys)
    ends = cues.groupBy(*keys).agg(F.max("start").alias("_last"), F.min("end").alias("_first"))
    rows = moments.select(*keys, F.struct(*moments.columns).alias("_m"))

    def scanned(rows: DataFrame, at: str, first: int) -> Scan:
        """Rows and words in one order of time; a word at the very time of a row's edge comes first (0) or last (1)."""
        known = [c for c in rows.columns if c not in keys]
        own = rows.withColumns({"_x": F.col(f"_m.{at}").cast("double"), "_o": F.lit(1 - first), "_w": F.lit(None).cast("double")})
        words = cues.select(*keys, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in known], F.col(at).cast("double").alias("_x"), F.lit(first).alias("_o"), F.col(at).cast("double").alias("_w"))
        return Scan(own.unionByName(words), keys, ["_x", "_o"], bins(F.col("_x"), bin))

    rows = scanned(rows, "start", 1).coming("_w", "_s").rows.filter("_m IS NOT NULL").select(*keys, "_m", "_s")
    rows = scanned(rows, "end", 0).newest("_w", "_e").rows.filter("_m IS NOT NULL").select(*keys, "_m", "_s", "_e")
    out = rows.join(ends, keys, "left").select("_m.*", "_s", "_e", "_last", "_first")
    start = F.coalesce("_s", "_last", "start")
    end = F.coalesce("_e", "_first", "end")
    return out.withColumn("start", start).withColumn("end", F.when(F.col("start") >= end, F.col("start") + least).otherwise(end)).select(*moments.columns)


def silence_points(cues: DataFrame, keys=KEYS, min_gap: float = 0.3, bin: float | None = None) -> DataFrame:
    """Middle of every gap of min_gap or more between a cue and the one before."""
    rows = Scan(cues, keys, ["start", "cue_idx"], bins(F.col("start"), bin)).previous("end").rows.withColumn("before", F.col("_prev.end"))
    return rows.filter(F.round(F.col("start") - F.col("before"), 6) >= min_gap).select(*keys, ((F.col("before") + F.col("start")) / 2).alias("point"))


def snap_to_silences(moments: DataFrame, cues: DataFrame, keys=KEYS, window: float = 1.5, min_gap: float = 0.3, least: float = 60.0) -> DataFrame:
    """Both ends go to the nearest silence closer than ``window``; of two as near, to the earlier."""
    keys = list(keys)
    points = silence_points(cues, keys, min_gap).withColumn("b", F.floor(F.col("point") / window))

    def near(col: str) -> DataFrame:
        m = moments.select(*keys, "moment_idx", F.col(col).alias("x")).withColumn("b", F.explode(F.array(*[F.floor(F.col("x") / window) + k for k in (-1, 0, 1)])))
        met = m.join(points, [*keys, "b"]).withColumn("d", F.round(F.abs(F.col("point") - F.col("x")), 6)).filter(F.col("d") < window)
        return met.groupBy(*keys, "moment_idx").agg(F.min_by("point", F.struct("d", "point")).alias(f"_{col}"))

    out = moments.join(near("start"), [*keys, "moment_idx"], "left").join(near("end"), [*keys, "moment_idx"], "left")
    out = out.withColumn("start", F.coalesce("_start", "start")).withColumn("end", F.coalesce("_end", "end"))
    return out.withColumn("end", F.when(F.col("start") >= F.col("end"), F.col("start") + least).otherwise(F.col("end"))).select(*moments.columns)


def nearest_box(windows: DataFrame, frames: DataFrame, keys=KEYS, tol: float = 0.6) -> DataFrame:
    """For each window (w, track_id, t) the box of its track nearest in time, at most ``tol`` away; the earlier of two."""
    keys = [*keys, "track_id"]
    f = frames.select(*keys, F.col("t").alias("ft"), "cx", "cy").withColumn("b", F.floor(F.col("ft") / tol))
    m = windows.select(*keys, "w", "t").withColumn("b", F.explode(F.array(*[F.floor(F.col("t") / tol) + k for k in (-1, 0, 1)])))
    met = m.join(f, [*keys, "b"]).withColumn("d", F.round(F.abs(F.col("ft") - F.col("t")), 6)).filter(F.col("d") <= tol)
    best = met.groupBy(*keys, "w").agg(F.min_by(F.struct("ft", "cx", "cy"), F.struct("d", "ft")).alias("box"))
    return windows.join(best, [*keys, "w"], "left").select(*windows.columns, F.col("box.ft").alias("box_t"), F.col("box.cx").alias("box_cx"), F.col("box.cy").alias("box_cy"))


def attach_zones(camera_segments: DataFrame, zones: DataFrame, keys=KEYS) -> DataFrame:
    """Camera segments with their speaker's centre; 0.5, 0.4 where there is no zone. Zones may name it center_x or cx."""
    have = set(zones.columns)
    pick = lambda names, default: F.coalesce(*[F.col(f"z.{n}") for n in names if n in have], F.lit(default))
    k = [F.col(f"c.{c}") == F.col(f"z.{c}") for c in [*keys, "speaker"]]
    met = camera_segments.alias("c").join(zones.alias("z"), k, "left")
    return met.select(*[F.col(f"c.{c}") for c in camera_segments.columns], pick(["center_x", "cx"], 0.5).alias("center_x"), pick(["center_y", "cy"], 0.4).alias("center_y"))


def gate_by_audio(lip_samples: DataFrame, audio_windows: DataFrame, keys=KEYS, window: float = 0.2, silence: float = 0.005) -> DataFrame:
    """Lip samples outside silent audio windows; samples without a window stay."""
    keys = list(keys)
    a = audio_windows.select(*keys, F.col("w").alias("_w"), F.col("rms").alias("_rms"))
    rows = lip_samples.withColumn("_w", F.floor(F.col("t") / window + 1e-9).cast(a.schema["_w"].dataType))
    return rows.join(a, [*keys, "_w"], "left").filter(F.col("_rms").isNull() | (F.col("_rms") >= silence)).select(*lip_samples.columns)
