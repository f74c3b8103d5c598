"""Scalar rules on clips, times and texts, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide the score.
CATEGORIES = {
    "controversy": ["polémico", "controversial", "debate", "discrepo", "no estoy de acuerdo", "mentira", "falso", "verdad que nadie", "te mintieron"],
    "emotional": ["increíble", "impactante", "lloré", "no lo puedo creer", "me cambió la vida", "epifanía", "revelación", "confesión", "nunca antes"],
    "actionable": ["consejo", "tip", "truco", "secreto", "cómo", "paso a paso", "en 5 minutos", "fácil", "rápido", "gratis"],
    "storytelling": ["historia", "anécdota", "cuando yo", "me pasó", "les cuento", "no van a creer", "primera vez"],
    "data": ["estudio", "estadística", "dato", "porcentaje", "investigación", "científico", "según", "demuestra"],
}
HOOKS = [(r"^\?|¿", 3.0), (r"sabías que|lo que nadie te dice", 2.5), (r"error|no hagas|deja de", 2.0), (r"la verdad sobre|te explico", 1.5)]
# Frame rates and their fractions.
FRAME_RATES = [(23.976, 24000, 1001), (24.0, 24, 1), (25.0, 25, 1), (29.97, 30000, 1001), (30.0, 30, 1), (50.0, 50, 1), (59.94, 60000, 1001), (60.0, 60, 1)]


# Fixed value: a name in capitals before a colon.
SPEAKER_NAME = r"([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s\d]{0,30}):"


def srt_time(col: Column) -> Column:
    """Seconds as HH:MM:SS,mmm; milliseconds are cut, not rounded."""
    s = F.floor(col)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, (col % F.lit(1.0) * F.lit(1000.0)).cast("int"))


def srt_seconds(col: Column) -> Column:
    """HH:MM:SS, then a comma or point and 1 to 3 digits, as seconds; NULL for anything else."""
    pattern = r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*$"
    part = lambda k: F.regexp_extract(col, pattern, k).cast("int")
    millis = F.rpad(F.regexp_extract(col, pattern, 4), 3, "0").cast("int")
    return F.when(col.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3) + millis / 1000.0)


def normalize_text(col: Column) -> Column:
    """Words in lower case, without punctuation."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9áéíóúüñ\s]", ""), r"\s+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: w != "")


def viral_text(hook: Column, topic: Column, reason: Column) -> Column:
    """What categories are looked for in."""
    return F.lower(F.concat_ws(" ", hook, topic, reason))


def viral_categories(text: Column) -> Column:
    """Sorted names of the categories of which any word occurs in ``viral_text``; give a column, as each word is looked for in it."""

    def hit(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | text.contains(w)
        return found

    return F.array_compact(F.array(*[F.when(hit(words), F.lit(name)) for name, words in sorted(CATEGORIES.items())]))


def keyword_score(categories: Column) -> Column:
    return F.size(categories) * 1.5


def hook_score(hook: Column) -> Column:
    text = F.lower(F.coalesce(hook, F.lit("")))
    score = F.lit(0.0)
    for pattern, points in HOOKS:
        score = score + F.when(text.rlike(pattern), points).otherwise(0.0)
    return score


def duration_score(start: Column, end: Column, calibration: str = "current") -> Column:
    """Points for a good length. ``older``: the calibration for clips of about a minute."""
    d = end - start
    if calibration == "older":
        return F.when(d.between(35, 65), 2.0).when(d.between(25, 75), 1.0).otherwise(0.0)
    return F.when(d.between(90, 120), 2.0).when(d.between(60, 90) | d.between(120, 150), 1.4).when((d > 150) & (d <= 180), 0.8).otherwise(0.0)


def optimal_duration(start: Column, end: Column) -> Column:
    return (end - start).between(35, 65)


def trend_score(base: Column, keyword: Column, hook: Column, duration: Column) -> Column:
    """Weighted sum in decimals, rounded half up to two places; a missing base counts 5."""
    d = lambda c, w: c.cast("decimal(12,4)") * F.lit(w).cast("decimal(4,2)")
    total = d(F.coalesce(base.cast("double"), F.lit(5.0)), "0.40") + d(keyword, "0.25") + d(hook, "0.20") + d(duration, "0.15")
    return F.round(total, 2).cast("double")


def fps_rational(fps: Column) -> Column:
    """Struct (num, den) of a known frame rate within 0.1, else of the nearest whole one."""
    make = lambda n, d: F.struct(F.lit(n).cast("bigint").alias("num"), F.lit(d).cast("bigint").alias("den"))
    out = None
    for rate, num, den in FRAME_RATES:
        near = F.abs(fps - rate) < 0.1
        out = F.when(near, make(num, den)) if out is None else out.when(near, make(num, den))
    return out.otherwise(F.struct(F.bround(fps).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den")))


def script_speakers(text: Column) -> Column:
    """Sorted distinct names that stand, in capitals, before a colon at the start of a line."""
    names = F.regexp_extract_all(text, F.lit("(?m)^" + SPEAKER_NAME), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(names, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))))


def iso_ts(col: Column, for_sorting: bool = False) -> Column:
    """ISO text as a timestamp; what can't be read is NULL, or 1970 for sorting."""
    ts = F.try_to_timestamp(col)
    return F.coalesce(ts, F.lit("1970-01-01 00:00:00").cast("timestamp")) if for_sorting else ts


def py_round(col: Column, n: int) -> Column:
    """Round as Python does: by the exact binary value, halves to even."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else round(float(v), n))

    return run(col.cast("double"))
