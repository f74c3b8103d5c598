"""Domain views over the driver's tables: one SQL text, run by Spark and by DuckDB. Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("conversations", "events", "orders", "lineitem", "embeddings")
VIEWS = {
    "fx_segments": """
SELECT episode_id, seg_idx, speaker, end_ms - dur_ms AS start_ms, end_ms, text FROM (
  SELECT episode_id, text, speaker, dur_ms,
         CAST(sum(dur_ms + gap_ms) OVER (PARTITION BY episode_id ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_ms,
         CAST(row_number() OVER (PARTITION BY episode_id ORDER BY conv_id, turn) AS BIGINT) AS seg_idx
  FROM (SELECT CAST(floor(conv_id / 10) AS BIGINT) AS episode_id, conv_id, turn, text,
               concat('SPEAKER_0', CAST((conv_id * 3 + turn + turn % 3) % 4 AS STRING)) AS speaker,
               CAST(length(text) * 40 + 400 AS BIGINT) AS dur_ms, CAST(((turn * 7919 + conv_id) % 7) * 300 AS BIGINT) AS gap_ms
        FROM {conversations}) b) c""",
    "fx_moments": """
SELECT CAST(floor(user_id / 15) AS BIGINT) AS episode_id, CAST(event_id AS BIGINT) AS moment_idx,
       CAST((event_id * 7919 % 1200) * 1000 AS BIGINT) AS start_ms,
       CAST((event_id * 7919 % 1200) * 1000 + 30000 + (event_id * 104729 % 200) * 1000 AS BIGINT) AS end_ms,
       CAST(event_id * 31 % 101 AS BIGINT) AS score10,
       CASE event_id % 6 WHEN 0 THEN '¿Sabías que esto es un secreto?' WHEN 1 THEN 'El error que todos cometen' WHEN 2 THEN 'La verdad sobre el dato'
         WHEN 3 THEN 'Me pasó una historia increíble' WHEN 4 THEN 'No hagas esto, deja de creer' ELSE 'Charla normal' END AS hook,
       CASE event_id % 4 WHEN 0 THEN 'debate y polémica' WHEN 1 THEN 'consejo fácil' WHEN 2 THEN 'estudio según expertos' ELSE 'charla' END AS topic
FROM {events}""",
    "fx_job_events": """
SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS job_id, ts AS occurred_at,
       CASE event_type WHEN 'signup' THEN 'download' WHEN 'view' THEN 'transcribe' WHEN 'click' THEN 'face_track' WHEN 'purchase' THEN 'guion' ELSE 'done' END AS step,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id * 37 % 101 AS DOUBLE) END AS percent
FROM {events}""",
    "fx_jobs": """
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 50 AS BIGINT) AS episode_id, o_orderdate AS updated_at,
       CASE o_orderkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'stopped' WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' WHEN 6 THEN 'cancelled' ELSE 'awaiting_export' END AS status,
       CAST(o_orderkey % 9 AS BIGINT) AS n_completed, CAST(o_orderkey * 13 % 101 AS BIGINT) AS progress
FROM {orders}""",
    "fx_detections": """
SELECT CAST(vec_id % 20 AS BIGINT) AS episode_id, CAST(vec_id AS BIGINT) AS det, CAST(label AS BIGINT) AS label FROM {embeddings}""",
    "fx_track_windows": """
SELECT CAST(l_orderkey % 100 AS BIGINT) AS episode_id, CAST(l_orderkey AS BIGINT) AS w, CAST(l_linenumber AS BIGINT) AS track_id, CAST(l_quantity AS BIGINT) AS mad,
       CAST(CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 20 END AS BIGINT) AS rms1000
FROM {lineitem}""",
    "fx_samples": """
SELECT CAST(user_id % 10 AS BIGINT) AS episode_id, CAST(event_id AS BIGINT) AS sample_idx, ts, CAST((event_id * 17 % 200) - 100 AS BIGINT) AS amp100 FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, with times also in seconds (start, end, duration)."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    df = spark.sql(sql, **used)
    if "start_ms" in df.columns:
        df = df.withColumn("start", F.col("start_ms") / F.lit(1000.0)).withColumn("end", F.col("end_ms") / F.lit(1000.0)).withColumn("duration", F.col("end") - F.col("start"))
    if "score10" in df.columns:
        df = df.withColumn("score", F.col("score10") / F.lit(10.0)).withColumn("summary", F.lit("")).withColumn("reason", F.lit(""))
    if "occurred_at" in df.columns:
        df = df.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    return df


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it names before it."""
    used = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in VIEWS if n in sql]
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ", ".join(used) + ", " + body[len(start) :]
    return "WITH " + ", ".join(used) + " " + body if used else body
