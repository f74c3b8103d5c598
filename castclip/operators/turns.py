"""Speaker turns, camera cuts and other runs of rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clips import SPEAKER_NAME
from .intervals import KEYS, attach_zones, interval_join, overlap_join, speaker_at
from .scans import Scan, bins


def _islands(rows: DataFrame, by: list[str], new, order: list[str]) -> DataFrame:
    """``rows`` with the number of their island; new: whether a row begins one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(new(w), F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def annotate_transcript(lines: DataFrame, segments: DataFrame, keys=KEYS, bin: float | None = None, block: int | None = None) -> DataFrame:
    """Lines (line_no, t, line) with [speaker] before those whose speaker differs from the previous timestamped line's.

    block: line numbers that are scanned together; without it an episode is one window."""
    keys = list(keys)
    rows = speaker_at(lines, segments, keys, bin=bin).withColumn("_timed", F.col("t").isNotNull())
    rows = Scan(rows, [*keys, "_timed"], ["line_no"], bins(F.col("line_no"), block)).previous("speaker").rows
    changed = F.col("_timed") & ~F.coalesce(F.col("speaker") == F.col("_prev.speaker"), F.lit(False))
    return rows.withColumn("line", F.when(changed, F.concat(F.lit("["), "speaker", F.lit("] "), "line")).otherwise(F.col("line"))).drop("_timed", "_prev", "_g")


def merge_turns(turns: DataFrame, keys=(*KEYS, "moment_idx"), block: float | None = None) -> DataFrame:
    """Neighbouring turns of one speaker as one, with the last one's end. Turns: speaker, start, end, seg_idx.

    block: seconds that are scanned together, where keys may have very many turns (those of a clip have not)."""
    keys = list(keys)
    rows = Scan(turns, keys, ["start", "seg_idx"], bins(F.col("start"), block)).islands(lambda p: F.col("speaker") != p["speaker"], "speaker").rows
    return rows.groupBy(*keys, "_island").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max_by("end", F.struct("start", "seg_idx")).alias("end"), F.min("seg_idx").alias("seg_idx")).drop("_island")


def clipped_turns(moments: DataFrame, segments: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    keys = list(keys)
    m = moments.select(*keys, "moment_idx", "start", "end")
    return overlap_join(m, segments.select(*keys, "seg_idx", "speaker", "start", "end"), keys, bin).select(*keys, "moment_idx", F.col("r_speaker").alias("speaker"), F.col("c_start").alias("start"), F.col("c_end").alias("end"), F.col("r_seg_idx").alias("seg_idx"))


def speaker_turns(moments: DataFrame, segments: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """Moments with the array of their merged turns."""
    keys = list(keys)
    turns = merge_turns(clipped_turns(moments, segments, keys, bin), [*keys, "moment_idx"])
    arrays = turns.groupBy(*keys, "moment_idx").agg(F.array_sort(F.collect_list(F.struct("start", "seg_idx", "speaker", "end"))).alias("_t"))
    arrays = arrays.select(*keys, "moment_idx", F.transform("_t", lambda x: F.struct(x["speaker"].alias("speaker"), x["start"].alias("start"), x["end"].alias("end"))).alias("speaker_turns"))
    empty = F.array().cast(arrays.schema["speaker_turns"].dataType)
    return moments.join(arrays, [*keys, "moment_idx"], "left").withColumn("speaker_turns", F.coalesce("speaker_turns", empty))


def dominant_speaker(moments: DataFrame, segments: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """Moments with the speaker who overlaps them longest; of equal ones the first in file order; else UNKNOWN."""
    keys = list(keys)
    met = clipped_turns(moments, segments, keys, bin)
    # thousandths of a second, so that sums don't depend on their order
    total = met.groupBy(*keys, "moment_idx", "speaker").agg(F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("bigint")).alias("s"), F.min("seg_idx").alias("i"))
    best = total.groupBy(*keys, "moment_idx").agg(F.max_by("speaker", F.struct("s", -F.col("i"))).alias("dominant_speaker"))
    return moments.join(best, [*keys, "moment_idx"], "left").withColumn("dominant_speaker", F.coalesce("dominant_speaker", F.lit("UNKNOWN")))


def absorb_short(segments: DataFrame, min_seg: float, keys=(*KEYS, "moment_idx")) -> DataFrame:
    """A cut shorter than min_seg extends the one kept before it; the first is always kept."""
    keys = list(keys)
    keep = lambda w: (F.round(F.col("end") - F.col("start"), 6) >= min_seg) | (F.row_number().over(w) == 1)
    rows = _islands(segments, keys, keep, ["start", "seg_idx"])
    order = F.struct("start", "seg_idx")
    return rows.groupBy(*keys, "_island").agg(F.min_by("speaker", order).alias("speaker"), F.min("start").alias("start"), F.max_by("end", order).alias("end"), F.min("seg_idx").alias("seg_idx")).drop("_island")


def limit_speakers(segments: DataFrame, n: int = 5, keys=(*KEYS, "moment_idx")) -> DataFrame:
    """In clips of more than n speakers, cuts of all but the n longest-speaking go to the speaker before them (the first ones
    to the longest-speaking), and equal neighbours become one."""
    keys = list(keys)
    cols = [*keys, "speaker", "start", "end", "seg_idx"]
    # all windows lie within one clip, so the rows are dealt once
    clip, own = Window.partitionBy(*keys), Window.partitionBy(*keys, "speaker")
    rows = segments.select(*cols).withColumn("_s", F.sum(F.round((F.col("end") - F.col("start")) * 1000).cast("bigint")).over(own)).withColumn("_i", F.min(F.struct("start", "seg_idx")).over(own))
    rows = rows.withColumn("_r", F.dense_rank().over(clip.orderBy(F.desc("_s"), "_i"))).withColumn("_top", F.first("speaker").over(clip.orderBy(F.desc("_s"), "_i")))
    rows = rows.withColumn("_many", F.max("_r").over(clip) > n)
    before = clip.orderBy("start", "seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    name = F.coalesce(F.last(F.when(F.col("_r") <= n, F.col("speaker")), True).over(before), F.col("_top"))
    rows = rows.withColumn("speaker", F.when(F.col("_many"), name).otherwise(F.col("speaker")))
    rows = _islands(rows, keys, lambda w: ~F.col("_many") | (F.col("speaker") != F.lag("speaker").over(w)), ["start", "seg_idx"])
    order = F.struct("start", "seg_idx")
    return rows.groupBy(*keys, "_island").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max_by("end", order).alias("end"), F.min("seg_idx").alias("seg_idx")).select(*cols)


def split_interruptions(segments: DataFrame, keys=(*KEYS, "moment_idx"), window: float = 5.0, speakers: int = 3, sub: float = 2.0, seed: float = 0.0) -> DataFrame:
    """Bursts of three or more speakers within ``window`` seconds become cuts of ``sub`` seconds with speakers drawn by a seed.

    Only clips in which that many cuts lie within a window reach the helper."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("start", "seg_idx")
    near = F.round(F.lead("end", speakers - 1).over(w) - F.col("start"), 6) <= window
    segments = segments.withColumn("_near", near).withColumn("_burst", F.coalesce(F.bool_or("_near").over(Window.partitionBy(*keys)), F.lit(False))).drop("_near")
    schema = segments.select(*keys, "speaker", "start", "end", "seg_idx").schema

    def run(pdf):
        import pandas as pd

        from ..helpers import interrupted

        pdf = pdf.sort_values(["start", "seg_idx"])
        rows = interrupted(list(zip(pdf["speaker"], pdf["start"], pdf["end"], strict=True)), window, speakers, sub, seed)
        out = pd.DataFrame(rows, columns=["speaker", "start", "end"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        out["seg_idx"] = range(len(out))
        return out[[f.name for f in schema]]

    calm = segments.filter("not _burst").select(*schema.names)
    return calm.unionByName(segments.filter("_burst").select(*schema.names).groupBy(*keys).applyInPandas(run, schema))


def camera_segments(moments: DataFrame, segments: DataFrame, zones: DataFrame, keys=KEYS, min_seg: float = 1.5, n: int = 5, seed: float = 0.0, bin: float | None = None) -> DataFrame:
    """Camera plan of each clip: turns, interruptions, short cuts, at most n speakers, centres; a clip without turns is one cut."""
    keys = list(keys)
    own = [*keys, "moment_idx"]
    cuts = merge_turns(clipped_turns(moments, segments, keys, bin), own)
    cuts = limit_speakers(absorb_short(split_interruptions(cuts, own, seed=seed), min_seg, own), n, own)
    placed = attach_zones(cuts, zones, keys).drop("seg_idx")
    alone = moments.select(*own, "start", "end").join(cuts.select(*own).distinct(), own, "left_anti")
    fallback = alone.select(*own, F.lit(None).cast("string").alias("speaker"), "start", "end", F.lit(0.5).alias("center_x"), F.lit(0.4).alias("center_y"))
    return placed.select(fallback.columns).unionByName(fallback)


def camera_mode(moments: DataFrame, zones: DataFrame, keys=KEYS, switching: bool = True) -> DataFrame:
    """Moments (dominant_speaker, speaker_turns) with ``multi`` and the centre of a static crop."""
    keys = list(keys)
    count = zones.groupBy(*keys).agg(F.count("*").alias("_z"))
    at = zones.select(*keys, F.col("speaker").alias("dominant_speaker"), F.col("cx").alias("_cx"))
    rows = moments.join(count, keys, "left").join(at, [*keys, "dominant_speaker"], "left")
    multi = F.lit(switching) & (F.size("speaker_turns") > 1) & (F.coalesce("_z", F.lit(0)) > 1)
    return rows.withColumn("multi", multi).withColumn("crop_cx", F.coalesce("_cx", F.lit(0.5))).drop("_z", "_cx")


def edit_decisions(cuts: DataFrame, moments: DataFrame, video: DataFrame, width: int = 1080, height: int = 1920, keys=KEYS) -> DataFrame:
    """Cuts in their clip's time with the crop of the source (src_w, src_h); empty ones go."""
    keys = list(keys)
    m = moments.select(*keys, "moment_idx", F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = cuts.join(m, [*keys, "moment_idx"]).join(video.select(*keys, "src_w", "src_h"), keys)
    rel = lambda c: F.least(F.greatest(F.col(c) - F.col("_s"), F.lit(0.0)), F.col("_e") - F.col("_s"))
    crop = F.floor(F.lit(width) * F.col("src_h") / F.lit(height)).cast("int")
    left = (F.col("center_x") * F.col("src_w") - crop / 2).cast("int")
    return rows.select(*keys, "moment_idx", "speaker", rel("start").alias("rel_start"), rel("end").alias("rel_end"), crop.alias("crop_w"), F.greatest(F.lit(0), F.least(left, F.col("src_w") - crop)).cast("int").alias("crop_x")).filter("rel_end > rel_start")


def smooth_labels(windows: DataFrame, size: int = 5, keys=KEYS) -> DataFrame:
    """Label = the most frequent within size // 2 rows to both sides; of equal ones the smallest. Windows: win_idx, label."""
    half = size // 2
    w = Window.partitionBy(*keys).orderBy("win_idx").rowsBetween(-half, half)
    near = F.collect_list("label").over(w)
    ranked = F.transform(F.array_distinct(near), lambda x: F.struct(F.size(F.filter(near, lambda y: y == x)).alias("n"), (-x).alias("m")))
    return windows.withColumn("label", (-F.array_max(ranked)["m"]).cast("int"))


def windows_to_segments(windows: DataFrame, win: float = 1.5, hop: float = 0.75, least: float = 0.5, keys=KEYS, block: int | None = None) -> DataFrame:
    """Runs of windows (win_idx, t, label, duration of the episode) of one label without gaps of 3 hops as segments. block: windows that are scanned together."""
    keys = list(keys)
    new = lambda p: (F.col("label") != p["label"]) | ~(F.round(F.col("t") - (p["t"] + win), 6) < 3 * hop)
    rows = Scan(windows, keys, ["win_idx"], bins(F.col("win_idx"), block)).islands(new, "label", "t").rows
    out = rows.groupBy(*keys, "_island").agg(F.first("label").alias("label"), F.min("t").alias("s"), F.max("t").alias("t"), F.max("duration").alias("d"))
    end = F.least(F.col("t") + win, F.col("d"))
    return out.select(*keys, F.format_string("SPEAKER_%02d", "label").alias("speaker"), F.round("s", 2).alias("start"), F.round(end, 2).alias("end"), F.round(end - F.col("s"), 2).alias("duration")).filter(F.col("duration") >= least)


def rotate_speakers(segments: DataFrame, max_speakers: int = 5, pause: float = 2.0, keys=KEYS, block: float | None = None) -> DataFrame:
    """Where a segment has no label, the speaker moves on to the next of 1..max at each longer pause; a label given wins and starts anew. block: seconds that are scanned together."""
    scan = Scan(segments, keys, ["start", "seg_idx"], bins(F.col("start"), block)).previous("end")
    anew = F.col("speaker").isNotNull() | F.col("_prev").isNull()
    scan.total(F.when(~anew & (F.round(F.col("start") - F.col("_prev.end"), 6) > pause), 1).otherwise(0), "_t")
    scan.rows = scan.rows.withColumn("_head", F.when(anew, F.struct("speaker", "_t")))
    rows = scan.newest("_head", "_from").rows
    named, step = F.col("_from.speaker"), F.col("_t") - F.col("_from._t")
    name = F.when(named.isNotNull() & (step == 0), named).otherwise(F.format_string("SPEAKER_%02d", F.pmod(step, F.lit(max_speakers)) + 1))
    return rows.withColumn("speaker", name).select(segments.columns)


def script_blocks(lines: DataFrame, keys=KEYS, block: int | None = None) -> DataFrame:
    """Blocks of a script: NAME: begins one, lines after it belong to it, [...] goes. Lines: line_no, line. block: line numbers that are scanned together."""
    keys = list(keys)
    name = F.regexp_extract("line", r"^\s*" + SPEAKER_NAME, 1)
    rows = lines.withColumn("_h", F.trim(name)).withColumn("text", F.trim(F.regexp_replace(F.when(name != "", F.regexp_replace("line", r"^\s*" + SPEAKER_NAME, "")).otherwise(F.col("line")), r"\[[^\]]*\]", "")))
    rows = Scan(rows, keys, ["line_no"], bins(F.col("line_no"), block)).total((F.col("_h") != "").cast("int"), "block_idx").done().filter("block_idx > 0")
    order = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text"))))
    return rows.groupBy(*keys, "block_idx").agg(F.max("_h").alias("speaker"), F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"))


def matches_to_segments(matches: DataFrame, lines: DataFrame, least: float = 0.5, keys=KEYS, block: float | None = None) -> DataFrame:
    """Matches (block_idx, speaker, seg_idx) that move forward as segments up to the next one's start; short ones go, equal neighbours merge.

    Lines: seg_idx, start, end of the transcript."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("block_idx")
    kept = matches.withColumn("_m", F.max("seg_idx").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("_m").isNull() | (F.col("seg_idx") > F.col("_m"))).drop("_m")
    last = lines.groupBy(*keys).agg(F.max("end").alias("_end"))
    rows = kept.join(lines.select(*keys, "seg_idx", "start"), [*keys, "seg_idx"]).join(last, keys)
    rows = rows.withColumn("end", F.coalesce(F.lead("start").over(w), "_end")).filter(F.round(F.col("end") - F.col("start"), 6) >= least)
    return merge_turns(rows.select(*keys, "speaker", "start", "end", "seg_idx"), keys, block)


def split_long_segments(segments: DataFrame, lines: DataFrame, longest: float = 120.0, gap: float = 1.5, keys=KEYS) -> DataFrame:
    """Segments longer than ``longest`` are cut at the widest gaps of the transcript (lines: line_no, start, end). Lengths are compared in microseconds, as differences of seconds miss a limit that they just meet."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("line_no")
    span, apart = F.round(F.col("end") - F.col("start"), 6), round(longest * 0.4, 6)
    gaps = lines.withColumn("_n", F.lead("start").over(w)).withColumn("g", F.round(F.col("_n") - F.col("end"), 6)).filter(F.col("g") >= gap).select(*keys, ((F.col("end") + F.col("_n")) / 2).alias("at"), "g")
    long_ = segments.filter(span > longest)
    own = Window.partitionBy(*keys, "seg_idx").orderBy(F.desc("g"), "at")
    points = gaps.select(*keys, F.col("at").alias("start"), F.col("at").alias("end"), "g")
    met = interval_join(long_, points, keys, bin=longest).withColumn("at", F.col("r_start")).withColumn("g", F.col("r_g")).withColumn("_r", F.row_number().over(own))
    met = met.filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.round(span / longest, 9))) * 2)
    cuts = met.groupBy(*keys, "seg_idx").agg(F.sort_array(F.collect_list("at")).alias("c"), F.max(F.when(F.col("_r") == 1, F.col("at"))).alias("widest"))
    rows = segments.join(cuts, [*keys, "seg_idx"], "left")
    start = F.struct(F.array().cast("array<double>").alias("k"), F.col("start").cast("double").alias("p"))
    fold = F.aggregate("c", start, lambda acc, x: F.when(F.round(x - acc["p"], 6) >= apart, F.struct(F.concat(acc["k"], F.array(x)).alias("k"), x.alias("p"))).otherwise(acc), lambda acc: acc["k"])
    kept = F.when(F.size(fold) > 0, fold).otherwise(F.array("widest"))
    edges = F.when(F.col("c").isNull(), F.array("start", "end")).otherwise(F.concat(F.array("start"), kept, F.array("end")))
    pieces = rows.withColumn("_e", edges).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_e") - 1)))
    s, e = F.element_at("_e", F.col("_k")), F.element_at("_e", F.col("_k") + 1)
    return pieces.select(*keys, "seg_idx", "speaker", s.alias("start"), e.alias("end")).filter(F.round(F.col("end") - F.col("start"), 3) > 0.5)
