"""Transcript and slot quality, metadata, alignment to scripts, chunking."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clips import normalize_text
from .intervals import KEYS
from .scans import Scan, bins, streamed


def transcript_coverage(cues: DataFrame, keys=KEYS, pause: float = 2.0) -> DataFrame:
    """Covered share of each transcript, its gaps over ``pause`` seconds and issues."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("start", "end")
    ms = lambda c: F.round(c * 1000).cast("bigint")
    rows = cues.filter(F.col("end") > F.col("start")).withColumn("_g", ms(F.col("start") - F.lag("end").over(w)))
    gap = F.when(F.col("_g") > pause * 1000, F.round(F.col("_g") / F.lit(1000).cast("decimal(10,0)"), 1).cast("double"))
    out = rows.withColumn("_g", gap).groupBy(*keys).agg(
        F.sum(ms(F.col("end") - F.col("start"))).alias("_c"), (F.max_by(ms(F.col("end")), F.struct("start", "end")) - F.min(ms(F.col("start")))).alias("_s"),
        F.count("_g").alias("gap_count"), F.round(F.coalesce(F.sum("_g"), F.lit(0.0)), 1).alias("total_gap_sec"), F.slice(F.sort_array(F.collect_list("_g"), False), 1, 5).alias("largest_gaps_sec"),
    )
    share = F.when(F.col("_s") > 0, F.col("_c") * F.lit(100).cast("decimal(10,0)") / F.col("_s")).otherwise(0)
    issues = F.array_compact(F.array(F.when(share < 70, "low coverage"), F.when(F.col("gap_count") > 20, "many gaps")))
    return out.select(*keys, F.round(share, 1).cast("double").alias("coverage_pct"), "gap_count", "total_gap_sec", F.round(F.col("_s") / F.lit(1000).cast("decimal(10,0)"), 1).cast("double").alias("total_duration_sec"), "largest_gaps_sec", issues.alias("issues"))


def speaker_coherence(script_speakers: DataFrame, slots: DataFrame, keys=KEYS) -> DataFrame:
    """Speakers of the script against face slots: counts, nearest slots, issues, confidence."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("cx")
    sep = slots.withColumn("_d", F.round(F.lead("cx").over(w) - F.col("cx"), 6)).groupBy(*keys).agg(F.count("*").alias("n_face_slots"), F.min("_d").alias("min_separation"))
    names = script_speakers.groupBy(*keys).agg(F.count_distinct("speaker").alias("n_speakers"))
    rows = names.join(sep, keys, "full_outer").select(*keys, F.coalesce("n_speakers", F.lit(0)).alias("n_speakers"), F.coalesce("n_face_slots", F.lit(0)).alias("n_face_slots"), "min_separation")
    a, b = F.col("n_speakers"), F.col("n_face_slots")
    issue = F.when(a == 0, "no speakers in the script").when(b == 0, "no face slots").when(a != b, "speaker mismatch")
    rows = rows.withColumn("match", (a == b) & (a > 0)).withColumn("issues", F.array_compact(F.array(issue, F.when(F.col("min_separation") < 0.08, "slots too close"))))
    both = (a > 0) & (b > 0)
    rows = rows.withColumn("confidence", F.when(both & (a == b), "alta").when(both & (F.abs(a - b) == 1), "media").when(both, "baja").when((a > 0) | (b > 0), "media").otherwise("baja"))
    return rows.withColumn("confidence_score", F.when(both & (a == b), 0.95).when(both & (F.abs(a - b) == 1), 0.7).when(both, 0.4).when((a > 0) | (b > 0), 0.5).otherwise(0.2))


def slot_quality(slots: DataFrame, keys=KEYS) -> DataFrame:
    keys = list(keys)
    rows = slots.groupBy(*keys).agg(F.count("*").alias("n_slots"), F.avg("w").alias("_w"), F.round(F.max("cx") - F.min("cx"), 6).alias("_s"), F.sort_array(F.collect_list(F.round("cx", 3))).alias("slot_positions"))
    issues = F.array_compact(F.array(F.when((F.col("_s") < 0.15) & (F.col("n_slots") > 1), "slots close together"), F.when(F.round("_w", 6) < 0.04, "small faces")))
    return rows.select(*keys, "n_slots", F.round("_w", 4).alias("avg_width"), F.round("_s", 4).alias("spread"), "slot_positions", issues.alias("issues"))


def validation_report(coverage: DataFrame, coherence: DataFrame, quality: DataFrame, keys=KEYS) -> DataFrame:
    """One row per episode with the issues of all three."""
    keys = list(keys)
    part = lambda d, n: d.select(*keys, F.col("issues").alias(n))
    rows = part(coverage, "_a").join(part(coherence, "_b"), keys, "full_outer").join(part(quality, "_c"), keys, "full_outer")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("issues", F.concat(*[F.coalesce(c, none) for c in ("_a", "_b", "_c")])).withColumn("n_issues", F.size("issues"))
    return rows.select(*keys, "issues", "n_issues")


def transcription_meta(segments: DataFrame, info: DataFrame, keys=KEYS) -> DataFrame:
    rows = segments.groupBy(*keys).agg(F.count("*").alias("segments_count"), F.max("end").alias("duration_seconds"))
    return rows.join(info.select(*keys, "language"), list(keys), "left")


def speaker_shares(segments: DataFrame, keys=KEYS) -> DataFrame:
    """Segments, seconds and percentage of each speaker, and the episode's minutes and seconds of speech."""
    keys = list(keys)
    ms = F.round((F.col("end") - F.col("start")) * 1000).cast("bigint")
    rows = segments.groupBy(*keys, "speaker").agg(F.count("*").alias("segments"), F.sum(ms).alias("_ms"))
    rows = rows.withColumn("_all", F.sum("_ms").over(Window.partitionBy(*keys)))
    total = F.floor(F.col("_all") / 1000)
    return rows.select(*keys, "speaker", "segments", (F.col("_ms") / 1000).alias("seconds"), F.round(F.col("_ms") * F.lit(100).cast("decimal(10,0)") / F.col("_all"), 1).cast("double").alias("share_pct"), F.floor(total / 60).alias("total_minutes"), (total % 60).alias("total_seconds"))


def clean_transcript(lines: DataFrame, keys=KEYS, block: int | None = None) -> DataFrame:
    """Lines (line_no, line) stripped, runs of blank ones as one, times with a point. block: line numbers that are scanned together."""
    rows = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", r"^\s+|\s+$", ""), r"(\d{2}:\d{2}:\d{2}),(\d{3})", "$1.$2"))
    rows = Scan(rows, keys, ["line_no"], bins(F.col("line_no"), block)).previous("line").rows
    return rows.filter(~((F.col("line") == "") & F.coalesce(F.col("_prev.line") == "", F.lit(False)))).select(lines.columns)


def _chunked(lines: DataFrame, keys, make) -> DataFrame:
    """Chunks that ``make`` gives of the lines (line_no, line), numbered."""
    texts = lambda rows: ((k, text) for k, text in enumerate(make(line or "" for _, line in rows)))
    return streamed(lines.select(*keys, "line_no", "line"), keys, ["line_no"], texts, "chunk_idx int, text string")


def chunk_transcript(lines: DataFrame, max_tokens: int, keys=KEYS) -> DataFrame:
    """Chunks of about max_tokens * 4 characters, cut at pauses, each with context of the one before. Lines are read as a stream."""

    def make(texts):
        from ..helpers import chunks

        return chunks(texts, max_tokens * 4)

    return _chunked(lines, keys, make)


def chunk_simple(lines: DataFrame, max_chars: int, keys=KEYS) -> DataFrame:
    """Chunks of up to max_chars. Lines are read as a stream."""

    def make(texts):
        from ..helpers import simple_chunks

        return simple_chunks(texts, max_chars)

    return _chunked(lines, keys, make)


def align_script(blocks: DataFrame, lines: DataFrame, keys=KEYS, needle: int = 10) -> DataFrame:
    """Script blocks (block_idx, speaker, text) found in a transcript (seg_idx, text): block_idx, speaker, seg_idx.

    A block is looked for after the one found before, so an episode is one task; it reads the number of words, the blocks' first words and then the
    transcript as a stream, of which it holds the words of one search."""
    keys = list(keys)
    words = normalize_text(F.col("text"))
    t = lines.select(*keys, "seg_idx", words.alias("words"))
    none = F.lit(None)
    told = t.groupBy(*keys).agg(F.sum(F.greatest(F.size("words"), F.lit(0))).cast("long").alias("n")).select(*keys, F.lit(0).alias("kind"), F.col("n").alias("at"), none.cast("string").alias("speaker"), none.cast("array<string>").alias("words"), F.lit(0).alias("n"))
    asked = blocks.select(*keys, "block_idx", "speaker", words.alias("words"))
    asked = asked.select(*keys, F.lit(1).alias("kind"), F.col("block_idx").cast("long").alias("at"), F.col("speaker").cast("string").alias("speaker"), F.slice("words", 1, needle).alias("words"), F.size("words").alias("n"))
    said = t.select(*keys, F.lit(2).alias("kind"), F.col("seg_idx").cast("long").alias("at"), none.cast("string").alias("speaker"), "words", F.size("words").alias("n"))

    def make(rows):
        from ..helpers import aligned

        total, own = 0, []
        for kind, at, speaker, first, n in rows:
            if kind == 2:
                break
            if kind == 0:
                total = at
            else:
                own.append((at, speaker, (first or [], n)))
        else:
            return
        spoken = chain(((w, at) for w in first or []), ((w, seg) for _, seg, _, some, _ in rows for w in some or []))
        for k, seg in aligned([b for _, _, b in own], spoken, total, needle):
            yield own[k][0], own[k][1], seg

    return streamed(told.unionByName(asked).unionByName(said), keys, ["kind", "at"], make, "block_idx bigint, speaker string, seg_idx bigint")
