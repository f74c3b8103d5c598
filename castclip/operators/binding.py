"""Voices and faces: clusters, activity, votes, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clusters
from .intervals import KEYS, activity_votes_join
from .scans import exact_median


def frame_sample_plan(videos: DataFrame, policy: str = "uniform", keys=KEYS) -> DataFrame:
    """Times to look at in each video (duration in seconds), by number: 60 evenly spread, or more in longer ones."""
    d, minutes = F.col("duration"), F.col("duration") / 60
    if policy == "uniform":
        n = F.lit(60)
    elif policy == "adaptive":
        n = F.greatest(F.lit(60), F.least(F.lit(240), F.floor(F.lit(120) + F.greatest(F.lit(0.0), minutes - 5)))).cast("int")
    else:
        n = F.least(F.lit(150), F.lit(50) + F.floor(2 * minutes)).cast("int")
    lo, hi = F.least(F.lit(5.0), d * 0.05), F.greatest(d - 5, d * 0.95)
    rows = videos.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(*keys, "k", (lo + (hi - lo) * F.col("k") / (F.col("_n") - 1)).alias("t"))


def cluster_faces(detections: DataFrame, max_k: int = 6, keys=KEYS, most: int = 100_000) -> DataFrame:
    """Detections with the number of their cluster. Episodes of more than ``most`` rows are shared among tasks."""
    from pyspark.sql import types as T

    schema = T.StructType([*detections.schema.fields, T.StructField("cluster", T.IntegerType())])

    def run(pdf):
        from ..helpers import face_clusters

        pdf = pdf.sort_values(["t", "cx", "cy"], kind="stable")
        return pdf.assign(cluster=face_clusters(pdf["cx"].to_numpy(float), pdf["cy"].to_numpy(float), max_k).astype("int32"))

    small, large = clusters.parted(detections, most, keys)
    out = small.groupBy(*keys).applyInPandas(run, schema)
    return out if large is None else out.unionByName(clusters.faces(large, max_k))


def cluster_voices(features: DataFrame, fixed: int | None = None, min_k: int = 2, max_k: int = 6, keys=KEYS, most: int = 100_000) -> DataFrame:
    """Voice windows (win_idx, t, features) with a label. Episodes of more than ``most`` rows are shared among tasks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields) + ", label int"

    def run(pdf):
        import numpy as np

        from ..helpers import voice_clusters

        pdf = pdf.sort_values("win_idx")
        return pdf.assign(label=voice_clusters(np.array(pdf["features"].tolist(), dtype=float), fixed, min_k, max_k).astype("int32"))

    small, large = clusters.parted(features, most, keys)
    out = small.groupBy(*keys).applyInPandas(run, schema)
    return out if large is None else out.unionByName(clusters.voices(large, fixed, min_k, max_k))


def face_positions(labelled: DataFrame, lowest: float = 0.55, keys=KEYS) -> DataFrame:
    """Mean box of each cluster, without those low in the picture, numbered from left to right."""
    keys = list(keys)
    rows = labelled.groupBy(*keys, "cluster").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("cx", "cy", "w", "h", "confidence")], F.avg("cy").alias("_cy"), F.count("*").alias("n_samples"))
    w = Window.partitionBy(*keys).orderBy("cx", "cluster")
    return rows.filter(F.round("_cy", 6) <= lowest).withColumn("position_id", F.row_number().over(w) - 1).drop("_cy", "cluster")


def face_tracks(labelled: DataFrame, keys=KEYS) -> DataFrame:
    """Track of each cluster: mean box, first and last time, frames in order, the time of the surest one; from left to right."""
    keys = list(keys)
    box = F.struct("t", F.array("cx", "cy", "w", "h").alias("bbox"), "confidence")
    rows = labelled.groupBy(*keys, "cluster").agg(F.array(*[F.avg(c) for c in ("cx", "cy", "w", "h")]).alias("bbox_mean"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("n_frames"), F.array_sort(F.collect_list(box)).alias("frames"), F.max_by("t", F.struct("confidence", -F.col("t"))).alias("best_t"))
    w = Window.partitionBy(*keys).orderBy(F.col("bbox_mean")[0], "cluster")
    rows = rows.withColumn("track_id", F.row_number().over(w) - 1).withColumn("duration", F.col("last_seen") - F.col("first_seen"))
    return rows.withColumn("centroid", F.slice("bbox_mean", 1, 2)).drop("cluster")


def audio_rms(samples: DataFrame, rate: float, window: float, keys=KEYS) -> DataFrame:
    """RMS of each whole window of ``window`` seconds. Samples: sample_idx, amplitude, duration of the episode."""
    per = int(rate * window)
    rows = samples.withColumn("w", F.floor(F.col("sample_idx") / per)).filter(F.col("w") < F.floor(F.col("duration") / window + 1e-9))
    return rows.groupBy(*keys, "w").agg(F.sqrt(F.avg(F.col("amplitude") * F.col("amplitude"))).alias("rms"))


def audio_rms_blocks(blocks: DataFrame, rate: float, window: float, full: float = 32768.0, keys=KEYS) -> DataFrame:
    """The same of sound kept as blocks: one row has ``pcm``, an array of whole numbers of which ``full`` is amplitude 1, and ``first``, the number of its first sample.

    Blocks may be of any length and begin anywhere in a window: each gives the sum of squares and the number of samples of every window it
    has a part of, as whole numbers, and a window's parts are added up. Null blocks count as empty."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    keys, per = list(keys), int(rate * window)
    src = blocks.select(*keys, F.col("first").cast("long").alias("_first"), F.col("duration").cast("double").alias("_d"), F.coalesce(F.col("pcm").cast("array<int>"), F.array().cast("array<int>")).alias("_pcm"))
    kinds = [to_arrow_type(f.dataType) for f in src.select(*keys).schema.fields]

    def run(batches):
        for b in batches:
            first, pcm = b.column(len(keys)).to_numpy(zero_copy_only=False), b.column(len(keys) + 2)
            size = pcm.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            squares = np.concatenate([[0], np.cumsum(pcm.flatten().to_numpy(zero_copy_only=False).astype(np.int64) ** 2)])
            low, high = first // per, (first + size - 1) // per  # first and last window of each block
            many = np.where(size > 0, high - low + 1, 0)
            row = np.repeat(np.arange(len(size)), many)
            w = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            a = np.maximum(w * per - first[row], 0) + start[row]
            e = np.minimum((w + 1) * per - first[row], size[row]) + start[row]
            taken = [c.take(pa.array(row)) for c in b.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(taken, kinds, strict=True)], pa.array(w), pa.array(squares[e] - squares[a]), pa.array(e - a), b.column(len(keys) + 1).take(pa.array(row))], names=[*keys, "w", "_s", "_n", "_d"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keys).schema.fields) + ", w long, _s long, _n long, _d double"
    parts = src.mapInArrow(run, kind).filter(F.col("w") < F.floor(F.col("_d") / window + 1e-9))
    return parts.groupBy(*keys, "w").agg((F.sqrt(F.sum("_s") / F.sum("_n")) / full).alias("rms"))


def voice_activity(audio_windows: DataFrame, silence: float = 0.005, keys=KEYS) -> DataFrame:
    """Active and all windows, and the percentage skipped."""
    rows = audio_windows.groupBy(*keys).agg(F.count_if(F.col("rms") >= silence).alias("active"), F.count("*").alias("total"))
    return rows.withColumn("skipped_pct", F.round((F.col("total") - F.col("active")) * 100.0 / F.col("total"), 1))


def activity_scores(track_windows: DataFrame, audio_windows: DataFrame, silence: float = 0.005, keys=KEYS) -> DataFrame:
    """Score of each track in voiced windows: its movement against the largest; under 0.6 it counts three tenths."""
    keys = list(keys)
    voiced = audio_windows.filter(F.col("rms") >= silence).select(*keys, "w")
    rows = track_windows.join(voiced, [*keys, "w"], "left_semi").withColumn("_m", F.max("mad").over(Window.partitionBy(*keys, "w")))
    share = F.col("mad") / (F.col("_m") + 1e-6)
    return rows.withColumn("score", F.when(F.col("_m") > 0, F.round(F.when(share < 0.6, share * 0.3).otherwise(share), 4)).otherwise(0.0)).drop("_m")


def vote_matrix(windows: DataFrame, segments: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """For each speaker and track of an episode: summed score, windows, mean; nothing in common counts 0."""
    keys = list(keys)
    met = activity_votes_join(windows.select(*keys, "track_id", "start", "end", "score"), segments.select(*keys, "speaker", "start", "end"), keys, bin)
    votes = met.groupBy(*keys, F.col("r_speaker").alias("speaker"), "track_id").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    cells = segments.select(*keys, "speaker").distinct().join(windows.select(*keys, "track_id").distinct(), keys)
    rows = cells.join(votes, [*keys, "speaker", "track_id"], "left")
    return rows.select(*keys, "speaker", "track_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)).alias("average"))


def lip_matrix(samples: DataFrame, stat: str = "mean", keys=KEYS) -> DataFrame:
    """Lip movement of each speaker at each position: the mean, or the median in standard deviations of the position."""
    keys = list(keys)
    if stat == "mean":
        return samples.groupBy(*keys, "speaker", "position_id").agg(F.avg("mad").alias("score"))
    rows = exact_median(samples, [*keys, "speaker", "position_id"], "mad", "m")
    w = Window.partitionBy(*keys, "position_id")
    sd = F.stddev_pop("m").over(w)
    return rows.withColumn("score", (F.col("m") - F.avg("m").over(w)) / F.when(sd < 0.01, 1.0).otherwise(sd)).drop("m")


def assign_speakers(matrix: DataFrame, method: str = "optimal", keys=KEYS) -> DataFrame:
    """One track for each speaker, of the largest total average. Matrix: speaker, track_id, average."""
    keys = list(keys)
    schema = matrix.select(*keys, "speaker", "track_id").schema

    def run(pdf):
        import pandas as pd

        from ..helpers import assignment, greedy_assignment

        table = pdf.pivot_table(index="speaker", columns="track_id", values="average", fill_value=0.0).sort_index().sort_index(axis=1)
        pairs = (assignment if method == "optimal" else greedy_assignment)(table.to_numpy(float))
        out = pd.DataFrame([(table.index[r], table.columns[c]) for r, c in pairs], columns=["speaker", "track_id"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[schema.names]

    return matrix.groupBy(*keys).applyInPandas(run, schema)


def assign_by_time(segments: DataFrame, assigned: DataFrame, tracks: DataFrame, keys=KEYS) -> DataFrame:
    """Speakers without a track, by first appearance, to free tracks from left to right. Tracks: track_id, cx."""
    keys = list(keys)
    first = segments.groupBy(*keys, "speaker").agg(F.min(F.struct("start", "seg_idx")).alias("_f")).join(assigned.select(*keys, "speaker"), [*keys, "speaker"], "left_anti")
    free = tracks.join(assigned.select(*keys, "track_id"), [*keys, "track_id"], "left_anti")
    n = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rest = first.withColumn("_n", n(["_f", "speaker"])).join(free.withColumn("_n", n(["cx", "track_id"])), [*keys, "_n"])
    return assigned.select(*keys, "speaker", "track_id").unionByName(rest.select(*keys, "speaker", "track_id"))


def binding_confidence(matrix: DataFrame, assigned: DataFrame, least: float = 0.4, keys=KEYS) -> DataFrame:
    """Share of a speaker's score that its track has, and whether a person should look."""
    keys = list(keys)
    row = matrix.groupBy(*keys, "speaker").agg(F.sum("total").alias("_all"))
    rows = assigned.join(matrix.select(*keys, "speaker", "track_id", "total"), [*keys, "speaker", "track_id"]).join(row, [*keys, "speaker"])
    return rows.select(*keys, "speaker", "track_id", F.round(F.when(F.col("_all") > 0, F.col("total") / F.col("_all")).otherwise(0.0), 3).alias("confidence")).withColumn("needs_manual", F.col("confidence") < least)


def speaker_zones(face_map: DataFrame, tracks: DataFrame, keys=KEYS) -> DataFrame:
    """Mean box of each speaker's track, from its frames, else from its centre with a usual size."""
    keys = list(keys)
    rows = face_map.select(*keys, "speaker", "track_id").join(tracks.select(*keys, "track_id", "centroid", "frames"), [*keys, "track_id"])
    mean = rows.withColumn("f", F.explode_outer("frames")).groupBy(*keys, "speaker").agg(*[F.avg(F.col("f.bbox")[k]).alias(c) for k, c in enumerate(("cx", "cy", "w", "h"))], F.first("centroid").alias("_c"))
    return mean.select(*keys, "speaker", F.coalesce("cx", F.col("_c")[0]).alias("cx"), F.coalesce("cy", F.col("_c")[1]).alias("cy"), F.coalesce("w", F.lit(0.15)).alias("w"), F.coalesce("h", F.lit(0.22)).alias("h"))


def override_binding(face_map: DataFrame, mapping: DataFrame, positions: DataFrame, keys=KEYS) -> DataFrame:
    """A mapping made by hand (speaker, position_id) replaces an episode's whole map; unknown positions are left out."""
    keys = list(keys)
    made = mapping.join(positions.select(*keys, "position_id", "cx", "cy"), [*keys, "position_id"]).select(*keys, "speaker", "position_id", "cx", "cy", F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"))
    return face_map.select(made.columns).join(mapping.select(*keys).distinct(), keys, "left_anti").unionByName(made)


def calibration_samples(segments: DataFrame, until: float = 300.0, least: float = 1.0, most: int = 20, keys=KEYS) -> DataFrame:
    """Three times in each of a speaker's first segments (one in very short ones); if none begins early enough, in the episode's first rows."""
    keys = list(keys)
    good = (F.col("start") < until) & (F.round(F.col("end") - F.col("start"), 6) >= least)
    w = Window.partitionBy(*keys)
    rows = segments.withColumn("_g", F.count_if(good).over(w)).withColumn("_r", F.row_number().over(w.orderBy("start", "seg_idx")))
    names = segments.groupBy(*keys).agg(F.count_distinct("speaker").alias("_s"))
    rows = rows.join(names, keys).filter(F.when(F.col("_g") > 0, good).otherwise(F.col("_r") <= 5 * F.col("_s")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "speaker").orderBy("start", "seg_idx"))).filter(F.col("_n") <= most)
    n = F.when(F.round(F.col("end") - F.col("start"), 6) < 0.4, 1).otherwise(3)
    rows = rows.withColumn("_k", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.select(*keys, "speaker", "seg_idx", "k", (F.col("start") + (F.col("end") - F.col("start")) * (F.col("k") + 0.5) / F.col("_k")).alias("t"))


def speaker_timestamps(segments: DataFrame, n: int = 15, keys=KEYS) -> DataFrame:
    """The first n times of each speaker, from the longest segments on: four within a long one, two, or its middle."""
    keys = list(keys)
    d = F.round(F.col("end") - F.col("start"), 6)
    at = lambda x: F.col("start") + d * x
    spread = lambda k: F.array(*[at(0.15 + 0.7 * i / (k - 1)) for i in range(k)])
    times = F.when(d >= 60, spread(4)).when(d >= 20, spread(2)).otherwise(F.array(at(0.5)))
    w = Window.partitionBy(*keys, "speaker")
    rows = segments.withColumn("_d", d).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_d"), "start", "seg_idx"))).filter(F.col("_r") <= n)
    rows = rows.select(*keys, "speaker", "_r", F.posexplode(times).alias("_p", "t")).withColumn("n", F.row_number().over(w.orderBy("_r", "_p")))
    return rows.filter(F.col("n") <= n).select(*keys, "speaker", "n", "t")


def binding_status(segments: DataFrame, face_map: DataFrame, keys=KEYS) -> DataFrame:
    """For each speaker a sample of up to 4 s from the first segment of 1 s or more, with the binding; and if the episode needs a person."""
    keys = list(keys)
    first = segments.filter(F.round(F.col("end") - F.col("start"), 6) >= 1.0).groupBy(*keys, "speaker").agg(F.min_by(F.struct("start", "end"), F.struct("start", "seg_idx")).alias("_s"))
    rows = segments.select(*keys, "speaker").distinct().join(first, [*keys, "speaker"], "left").join(face_map.select(*keys, "speaker", "confidence", "needs_manual"), [*keys, "speaker"], "left")
    rows = rows.select(*keys, "speaker", F.col("_s.start").alias("sample_start"), F.least(F.col("_s.start") + 4, F.col("_s.end")).alias("sample_end"), "confidence", F.coalesce("needs_manual", F.lit(True)).alias("needs_manual"))
    return rows.withColumn("needs_calibration", F.bool_or("needs_manual").over(Window.partitionBy(*keys)))
