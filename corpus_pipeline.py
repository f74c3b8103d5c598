"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and reads
again as the next stage's docs. All but the last return the columns of ``documents``.

Language ID rejects null and empty texts, texts without a letter and those whose score is too low. Documents without an id go with exact
dedup, whose decision is by id; of equal texts with one id, all rows stay. In the Jaccard join an id that occurs twice counts as
one document, and all its rows stay or go. The suffix arrays remove equal rows' bytes in all of them; packing packs empty texts
too. An empty table passes through every stage. Texts that are tied have the same fate in each stage but where their ids decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castclip.llm import exact_dedup, jaccard_join, language_id, packing, suffix_dedup
from castclip.llm.shared import documents, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose calibrated score is too low."""
    model = language_id.fit(docs)
    return language_id.predict(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    kept = exact_dedup.exact_classes(docs).filter("id = keep_id").select(F.col("id").alias("doc_id"), F.col("sha").alias("_sha"))
    own = docs.withColumn("_sha", exact_dedup.text_sha(F.col("text")))
    return own.join(kept.hint("merge"), ["doc_id", "_sha"], "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    kept = jaccard_join.jaccard_classes(docs).filter("id = component_id").select(F.col("id").alias("doc_id"))
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; bytes of a character that was cut in two go with them."""
    kept = suffix_dedup.remove_repeats(docs, with_row=True)
    own = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return kept.select(*[own.get(c, F.col(f"other.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack(docs, P.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, suffix arrays and tokenizers have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None
