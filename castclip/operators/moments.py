"""Candidate clips: scoring, de-duplication, quotas, ranking, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clips
from .intervals import KEYS
from .scans import Scan, cut

BEST = ["_low", "_i", "s", "e", "_row"]  # the order of de-duplication
MIN_DUR, MAX_DUR, MIN_COUNT, MAX_COUNT, MIN_SCORE = 61.0, 180.0, 15, 35, 3.5


def filter_short_segments(segments: DataFrame, min_dur: float = 0.5) -> DataFrame:
    return segments.filter(F.round(F.col("end") - F.col("start"), 3) >= min_dur)


def valid_moments(m: DataFrame, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR) -> DataFrame:
    return m.filter((F.col("start") < F.col("end")) & F.round(F.col("end") - F.col("start"), 6).between(min_dur, max_dur))


def min_score(m: DataFrame, score: float = MIN_SCORE) -> DataFrame:
    """A missing score counts 0."""
    return m.filter(F.coalesce("score", F.lit(0.0)) >= score)


def score_moments(m: DataFrame, calibration: str = "current") -> DataFrame:
    """Moments with categories, keyword_score, hook_score, duration_score, base_score and trend_score."""
    out = m.withColumn("_text", clips.viral_text(F.col("hook"), F.col("topic"), F.col("reason")))
    out = out.withColumn("categories", clips.viral_categories(F.col("_text"))).drop("_text").withColumn("keyword_score", clips.keyword_score(F.col("categories")))
    out = out.withColumn("hook_score", clips.hook_score(F.col("hook"))).withColumn("duration_score", clips.duration_score(F.col("start"), F.col("end"), calibration))
    out = out.withColumn("base_score", F.coalesce(F.col("score").cast("double"), F.lit(5.0)))
    return out.withColumn("trend_score", clips.trend_score(F.col("score"), F.col("keyword_score"), F.col("hook_score"), F.col("duration_score")))


def rank_moments(m: DataFrame, keys=KEYS, bin: float | None = None) -> DataFrame:
    """rank 1..n by trend_score; equal ones in order of time. bin: seconds of which moments of one score are ranked together; without it an episode is one window."""
    rows = m.withColumn("_low", F.struct(F.col("trend_score").isNull().alias("none"), (-F.col("trend_score")).alias("score")))
    block = None if bin is None else F.struct("_low", F.floor(F.col("start") / bin).alias("bin"))
    return Scan(rows, keys, ["_low", "start", "moment_idx"], block).number("rank").done("_low")


def cap_moments(m: DataFrame, n: int = MAX_COUNT, keys=KEYS) -> DataFrame:
    return m.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "start", "moment_idx"))).filter(F.col("_r") <= n).drop("_r")


def recover_moments(kept: DataFrame, pool: DataFrame, min_count: int = MIN_COUNT, max_count: int = MAX_COUNT, floor: float = MIN_SCORE, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR, keys=KEYS) -> DataFrame:
    """Kept moments, and in episodes with too few of them the best others of the pool, half a point below the score floor allowed."""
    keys = list(keys)
    key = [F.round("start", 1).alias("_s"), F.round("end", 1).alias("_e")]
    count = pool.select(*keys).distinct().join(kept.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("_n")).filter(F.col("_n") < min_count)
    good = min_score(valid_moments(pool, min_dur, max_dur), max(0.0, floor - 0.5)).select("*", *key)
    extra = good.join(kept.select(*keys, *key).distinct(), [*keys, "_s", "_e"], "left_anti").join(count, keys)
    extra = extra.withColumn("_f", F.row_number().over(Window.partitionBy(*keys, "_s", "_e").orderBy("moment_idx"))).filter("_f = 1")
    extra = extra.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "moment_idx"))).filter(F.col("_r") <= F.lit(max_count) - F.col("_n"))
    return kept.unionByName(extra.select(kept.columns))


def dedup_moments(m: DataFrame, share: float = 0.70, keys=KEYS, block: float = 3600.0, most: int = 4000) -> DataFrame:
    """Best first (score, then moment_idx, start and end), a moment goes when more than ``share`` of it lies in one kept. Those without start or end stay.

    Taken in rounds. In each the ``most`` best undecided of every block of ``block`` seconds meet what is kept there. Whatever is decided by what a block holds is
    settled; a moment that reaches into other blocks stays if it is free in all of them, and goes if it is covered in one. Then what is
    kept takes out the rest that it covers, in bins of time. Blocks shift by half from round to round, so that edges become middles. The best
    undecided moment is settled in any round, so they end; each runs a job. No task takes in a whole episode."""
    keys = list(keys)
    low = F.coalesce(-F.col("score").cast("double"), F.lit(float("inf")))  # no score comes last
    held = cut(m.withColumn("_row", F.monotonically_increasing_id()))
    left = held.select("_row", *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], low.alias("_low"), F.col("moment_idx").cast("double").alias("_i"), F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))
    left = left.filter("s IS NOT NULL AND e IS NOT NULL")
    kept, done, turn = None, [held.filter("start IS NULL OR end IS NULL").select("_row")], 0
    while True:
        votes = _votes(left, kept, share, block, turn % 2 * block / 2, most)
        told = cut(left.join(votes, "_row", "left"))
        fresh = told.filter("_vote = 1").drop("_vote")
        done.append(fresh.select("_row"))
        rest = told.filter("_vote IS NULL OR _vote = 2").drop("_vote")
        if rest.isEmpty():
            break
        left = cut(_uncovered(rest, fresh, share, block / 60))
        kept = fresh if kept is None else cut(kept.unionByName(fresh))
        turn += 1
    chosen = done[0]
    for more in done[1:]:
        chosen = chosen.unionByName(more)
    return held.join(chosen, "_row", "left_semi").drop("_row")


def _touched(rows: DataFrame, size: float, shift: float = 0.0) -> DataFrame:
    """Rows once for every block of time that they lie in, and in how many."""
    at = lambda c: F.floor((F.col(c) + shift) / size)
    return rows.withColumn("_in", F.sequence(at("s"), F.greatest(at("s"), at("e")))).withColumn("_n", F.size("_in")).withColumn("_block", F.explode("_in")).drop("_in")


def _votes(left: DataFrame, kept: DataFrame | None, share: float, block: float, shift: float, most: int) -> DataFrame:
    """_row and _vote of what was looked at: 0 covered, 1 kept, 2 not yet known."""
    parts = _touched(left, block, shift)
    by = [c for c in left.columns if c.startswith("_k")] + ["_block"]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the best of each block, from the best of its shares, so that a crowded block is not sorted in one task
    best = lambda rows, own: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*own).orderBy(*BEST))).filter(F.col("_r") <= most).drop("_r")
    parts = best(best(parts.withColumn("_s", F.pmod("_row", F.lit(64))), [*by, "_s"]).drop("_s").repartition(n, *by), by).withColumn("_open", F.lit(True))
    if kept is not None:
        name = F.struct(*by)
        around = parts.select(name.alias("_b")).distinct()
        parts = parts.unionByName(_touched(kept, block, shift).withColumn("_b", name).join(around, "_b", "left_semi").drop("_b").withColumn("_open", F.lit(False)))

    def run(pdf):
        from ..helpers import settled

        pdf = pdf.sort_values(BEST)
        vote = settled(pdf["s"].to_numpy(float), pdf["e"].to_numpy(float), pdf["_open"].to_numpy(bool), pdf["_n"].to_numpy() == 1, share)
        return pdf[["_row", "_n"]].assign(_vote=vote)[pdf["_open"].to_numpy(bool)]

    told = parts.groupBy(*by).applyInPandas(run, "_row bigint, _n int, _vote int")
    free = F.count_if(F.col("_vote") == 1) == F.max("_n")
    return told.groupBy("_row").agg(F.when(F.min("_vote") == 0, 0).when(free, 1).otherwise(2).alias("_vote"))


def _uncovered(rest: DataFrame, fresh: DataFrame, share: float, bin: float) -> DataFrame:
    """What better moments kept don't cover. Where more than half has to be covered the middle is, so a moment is met in its middle's bin; else in all of its bins."""
    own = [c for c in rest.columns if c.startswith("_k")]
    mine = rest.withColumn("_block", F.floor((F.col("s") + F.col("e")) / 2 / bin)) if share >= 0.5 else _touched(rest, bin).drop("_n")
    # a crowded bin is shared among tasks
    mine = mine.withColumn("_b", F.struct(*own, "_block", F.pmod("_row", F.lit(8)).alias("_s")))
    theirs = _touched(fresh, bin).withColumn("_s", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(8)])))
    theirs = theirs.select(F.struct(*own, "_block", "_s").alias("_b"), F.struct(*BEST).alias("_q"), F.col("s").alias("ks"), F.col("e").alias("ke"))
    over = F.least("e", "ke") - F.greatest("s", "ks")
    covered = (F.col("_q") < F.struct(*BEST)) & (F.col("e") > F.col("s")) & (over / (F.col("e") - F.col("s")) > share)
    hit = mine.join(theirs, "_b").filter(covered).select("_row").distinct()
    return rest.join(hit, "_row", "left_anti")


def enforce_constraints(kept: DataFrame, pool: DataFrame, min_count: int = MIN_COUNT, max_count: int = MAX_COUNT, floor: float = MIN_SCORE, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR, keys=KEYS) -> DataFrame:
    """Valid lengths, at most max_count; episodes short of min_count are topped up: from the pool, by merging short neighbours, by
    filling gaps. Only those reach the helper; ``short_episodes`` reports those still short. Columns: keys, start, end, score, topic, hook, summary, reason."""
    keys = list(keys)
    cols = [*keys, "start", "end", "score", "topic", "hook", "summary", "reason"]
    full = recover_moments(cap_moments(valid_moments(kept, min_dur, max_dur), max_count, keys), pool, min_count, max_count, floor, min_dur, max_dur, keys)
    counts = pool.select(*keys).distinct().join(full.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left").select(*keys, (F.coalesce("_n", F.lit(0)) < min_count).alias("_few"))
    enough = full.join(counts.filter("not _few").select(*keys), keys, "left_semi").select(*cols)
    few = counts.filter("_few").select(*keys)
    both = pool.select(*cols).withColumn("_own", F.lit(False)).join(few, keys, "left_semi").unionByName(full.select(*cols).withColumn("_own", F.lit(True)).join(few, keys, "left_semi"))

    def run(pdf):
        import pandas as pd

        from ..helpers import topped_up

        rows = pdf.sort_values(["_own", "start", "end"]).to_dict("records")
        made = topped_up([r for r in rows if r["_own"]], [r for r in rows if not r["_own"]], min_count, max_count, floor, min_dur, max_dur)
        out = pd.DataFrame(made, columns=cols[len(keys) :])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[cols]

    return cap_rows(enough.unionByName(both.groupBy(*keys).applyInPandas(run, enough.schema)), max_count, keys)


def short_episodes(chosen: DataFrame, pool: DataFrame, min_count: int = MIN_COUNT, keys=KEYS) -> DataFrame:
    """Episodes of the pool that have fewer than min_count clips even so: keys, clips, wanted."""
    keys = list(keys)
    count = pool.select(*keys).distinct().join(chosen.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left")
    return count.select(*keys, F.coalesce("_n", F.lit(0)).alias("clips"), F.lit(min_count).alias("wanted")).filter("clips < wanted")


def cap_rows(m: DataFrame, n: int, keys) -> DataFrame:
    return m.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "start", "end"))).filter(F.col("_r") <= n).drop("_r")


def merge_enrichment(m: DataFrame, enriched: DataFrame, keys=KEYS) -> DataFrame:
    """Score, categories and reason of an enriched list go back to moments: by position where both lists are as long, else by start
    rounded to a tenth (the last of equal ones); NULL and empty values change nothing."""
    keys = list(keys)
    pos = lambda d: d.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "moment_idx")))
    n = lambda d, c: d.groupBy(*keys).agg(F.count("*").alias(c))
    e = pos(enriched).select(*keys, "_p", F.round("start", 1).alias("_s"), F.struct("score", "categories", "reason").alias("_v"))
    by_pos = e.select(*keys, "_p", F.col("_v").alias("_a"))
    by_start = e.groupBy(*keys, "_s").agg(F.max_by("_v", "_p").alias("_b"))
    rows = pos(m).withColumn("_s", F.round("start", 1)).join(n(m, "_n"), keys).join(n(enriched, "_k"), keys, "left").join(by_pos, [*keys, "_p"], "left").join(by_start, [*keys, "_s"], "left")
    v = F.when(F.col("_n") == F.col("_k"), F.col("_a")).otherwise(F.col("_b"))
    rows = rows.withColumn("_v", v).withColumn("score", F.coalesce("_v.score", "score")).withColumn("reason", F.coalesce("_v.reason", "reason"))
    return rows.withColumn("categories", F.when(F.size("_v.categories") > 0, F.col("_v.categories")).otherwise(F.col("categories"))).select(m.columns)


def _numbered(m: DataFrame, keys) -> DataFrame:
    """With ``_i``, the rank or else the position."""
    return m.withColumn("_i", F.coalesce(F.col("rank"), F.row_number().over(Window.partitionBy(*keys).orderBy("start", "moment_idx"))))


def apply_edits(m: DataFrame, patches: DataFrame, deletes: DataFrame, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """(moments after patches of start and end and deletions, edits that met no moment); edits name rank or position as idx."""
    keys = list(keys)
    rows = _numbered(m, keys)
    p = patches.select(*keys, F.col("idx").alias("_i"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    out = rows.join(deletes.select(*keys, F.col("idx").alias("_i")), [*keys, "_i"], "left_anti").join(p, [*keys, "_i"], "left")
    out = out.withColumn("start", F.coalesce("_s", "start")).withColumn("end", F.coalesce("_e", "end")).select(m.columns)
    edits = patches.select(*keys, "idx", F.lit("patch").alias("edit")).unionByName(deletes.select(*keys, "idx", F.lit("delete").alias("edit")))
    return out, edits.join(rows.select(*keys, F.col("_i").alias("idx")), [*keys, "idx"], "left_anti")


def select_shorts(m: DataFrame, indices: DataFrame, keys=KEYS) -> DataFrame:
    keys = list(keys)
    return _numbered(m, keys).join(indices.select(*keys, F.col("idx").alias("_i")), [*keys, "_i"], "left_semi").select(m.columns)


def order_shorts(m: DataFrame, keys=KEYS) -> DataFrame:
    return _numbered(m, keys).orderBy(*keys, "_i", "start").withColumnRenamed("_i", "position")


def top_shorts(ranked: DataFrame, k: int, keys=KEYS) -> DataFrame:
    return ranked.orderBy(F.desc("trend_score"), *keys, "start", "moment_idx").limit(k)


def category_rollup(ranked: DataFrame, keys=KEYS, cube: bool = False) -> DataFrame:
    """Clips and summed scores by category and rollup (or cube) of the keys, with the grouping's id."""
    # summed by the finest groups first: only those are rolled up. An inner explode, or a filter before it, would have Spark work the
    # categories out once more in a filter at the scan
    rows = ranked.select(*keys, F.explode_outer("categories").alias("category"), F.col("trend_score").cast("decimal(12,2)").alias("_t")).filter("category is not null")
    fine = rows.groupBy("category", *keys).agg(F.count("*").alias("_n"), F.sum("_t").alias("_t"))
    sets = (fine.cube if cube else fine.rollup)("category", *keys)
    return sets.agg(F.sum("_n").alias("clips"), F.sum("_t").cast("double").alias("total"), F.grouping_id().cast("bigint").alias("level"))


def union_chunk_results(cached: DataFrame, fresh: DataFrame, chunks: DataFrame, keys=KEYS) -> DataFrame:
    """Cached results of chunks that still exist, and fresh ones."""
    return cached.join(chunks.select(*keys, "chunk_idx"), [*keys, "chunk_idx"], "left_semi").unionByName(fresh, allowMissingColumns=True)


def pending_chunks(chunks: DataFrame, cached: DataFrame, keys=KEYS) -> DataFrame:
    return chunks.join(cached.select(*keys, "chunk_idx").distinct(), [*keys, "chunk_idx"], "left_anti")


def build_prompts(chunks: DataFrame, context: DataFrame, system: str, min_dur: float = MIN_DUR, max_dur: float = MAX_DUR, keys=KEYS) -> DataFrame:
    """Prompt of each chunk: the system text (%s and %s for the limits), the speakers, the chunk."""
    head = F.format_string(system, F.lit(str(int(min_dur))), F.lit(str(int(max_dur))))
    rows = chunks.join(context.select(*keys, "context"), list(keys), "left")
    return rows.withColumn("prompt", F.concat(head, F.lit("\n\n"), F.when(F.coalesce("context", F.lit("")) != "", F.concat("context", F.lit("\n\n"))).otherwise(""), "text")).drop("context")


def speaker_context(segments: DataFrame, face_map: DataFrame, low: float = 0.5, keys=KEYS) -> DataFrame:
    """One line per episode: how many speakers, their names, and those bound with little confidence."""
    keys = list(keys)
    s = segments.groupBy(*keys).agg(F.sort_array(F.collect_set("speaker")).alias("_s"))
    f = face_map.filter(F.col("confidence") < low).groupBy(*keys).agg(F.sort_array(F.collect_set("speaker")).alias("_f"))
    line = F.concat(F.lit("Speakers ("), F.size("_s").cast("string"), F.lit("): "), F.array_join("_s", ", "), F.when(F.size("_f") > 0, F.concat(F.lit("; low confidence: "), F.array_join("_f", ", "))).otherwise(""))
    return s.join(f, keys, "left").select(*keys, line.alias("context"))
