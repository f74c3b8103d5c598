"""The registered queries opN_<name>: each reads its whole table through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, exact_dedup, filter_audit, jaccard_join, language_id, lm_scoring, neighbours, packing, suffix_dedup, tokens, toxicity, vector_codes, warc
from .shared import documents, fold


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score(documents(spark, sf_dir), fold("doc_id", 5) != 1).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_classes(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold("doc_id", 4) == 2)
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    ids = tokens.encode(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), ranks)
    out = tokens.decode(ids, ranks, ["id", "n_tokens", "ids"], with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fold("doc_id", 3) == 1
    labels = documents(spark, sf_dir, "labels").filter(~held).select("doc_id", "toxic")
    out = toxicity.score(docs, toxicity.fit(docs.filter(~held), labels)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(documents(spark, sf_dir, "pages"))
    back = warc.read(manifest)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), with_kept=False).withColumnRenamed("id", "doc_id")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neighbours.search(documents(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return out.withColumnRenamed("id", "vec_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = packing.pack(documents(spark, sf_dir), P.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    out = automaton.decode(automaton.encode(documents(spark, sf_dir), path), path, ["id", "n_tokens", "ids"])
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compress(documents(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit("" if books is None else vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_exact_dedup, op3_language_id, op4_byte_bpe, op5_toxicity, op6_jaccard_join, op7_warc, op8_suffix_dedup, op9_neighbours, op10_best_fit_packing, op11_bpe_automaton, op12_filter_audit, op13_vector_codes)}

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """SQL of op13: each round is an assignment a, sums m and a codebook c."""
    assigned = """
a{k} AS MATERIALIZED (
  SELECT r, part, x, arg_min(entry, far * {entries} + entry) AS entry, min(far) AS far
  FROM (SELECT r, part, x, entry, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM p JOIN c{k} USING (part)) GROUP BY r, part, x)"""
    moved = """
m{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e
  FROM (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry),
c{next} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""
    steps = [assigned.format(k=k, entries=entries) + ("," + moved.format(k=k, next=k + 1) if k < rounds else "") for k in range(rounds + 1)]
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= {entries}),{",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS sha FROM c{rounds})
SELECT v.vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error,
       CAST(sum(sum(far)) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, any_value(h.sha) AS codebooks_sha256
FROM a{rounds} JOIN v USING (r), h GROUP BY v.r, v.vec_id, v.label
"""


ORACLE_SQL = {
    "op2_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
FROM d WINDOW w AS (PARTITION BY low)
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id FROM r JOIN documents ON doc_id = v LEFT JOIN n USING (doc_id) GROUP BY ALL
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT page_id, first, html, sha1(html) AS hex FROM p),
b AS (
  SELECT h.*, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (CAST(('0x' || substr(hex, 1 + 10 * CAST(floor(k / 8) AS INTEGER), 10)) AS BIGINT) >> (35 - 5 * CAST(k % 8 AS INTEGER))) & 31 AS INTEGER), 1)), '') AS digest
  FROM h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
""",
    "op12_filter_audit": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT t.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
p(o) AS (SELECT '' UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x) AND length(o) < 5),
s AS (SELECT o AS filter_order, k AS step, substr(o, k, 1) AS f, substr(o, 1, k - 1) AS done FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE length(o) = 5),
x AS (
  SELECT c.part, s.filter_order, s.step, c.n, c.good, c.toxic, c.fails, contains(c.fails, s.f) AS hit, length(translate(c.fails, s.done, '')) < length(c.fails) AS gone, s.f FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(length(fails), 1))) FILTER (hit), 0) AS BIGINT) AS shapley
FROM x GROUP BY ALL
""",
    "op13_vector_codes": _codes_sql(),
}
