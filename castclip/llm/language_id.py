"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its byte 2-, 3- and 4-grams (A-Z lower-cased, other ASCII than letters as a space) and its words,
each hashed to a row of an embedding table; the average row goes through a linear layer. Both are trained by
stochastic gradient descent in numpy on a bounded sample: about ``per_language`` labelled texts of each language,
of which a longer text gives one passage of ``passage`` characters that begins at a place given by a hash of its id. Averaging and the linear layer commute, so tasks
get the product of both tables. A temperature is fitted on a held-out part of the sample, and texts are rejected whose
calibrated score lies under a threshold that keeps 99.9 % of the right answers there.

Cases: a null text, and one without a letter, is ``und`` with score 0 and rejected; very short texts are predicted from
what they have; ties between languages go to the first in sorted order; without training rows every text is ``und`` with score 0,
and rejected only without a letter;
equal rows get equal results; an empty table gives no rows; of extra columns those named like a result are replaced, the others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import LOWER, SLICE, pieces, slices, span_hashes, words
from .shared import released

BITS = 16
PER_LANGUAGE = 1500
PASSAGE = 2000
DIM = 16
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of logits per bucket
    bias: np.ndarray
    temperature: float
    threshold: float


def buckets(data: np.ndarray, offs: np.ndarray, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every feature, a kind at a time and of at most about ``most`` bytes; texts ascend."""
    for k in (2, 3, 4):
        for at in range(0, len(data) - k + 1, most):
            part = LETTERS[data[at : at + most + k - 1]].astype(np.uint32)
            n = len(part) - k + 1
            gram = np.zeros(n, dtype=np.uint32)
            for j in range(k):
                gram = (gram << np.uint32(8)) | part[j : n + j]
            place = np.arange(at, at + n)
            text = np.searchsorted(offs, place, "right") - 1
            ok = place + k <= offs[text + 1]
            gram = (gram + np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
            yield (gram, text) if ok.all() else (gram[ok], text[ok])
    for at, part, cuts in pieces(data, offs, LETTERS != 32, most):
        low = LETTERS[part]
        s, e, _ = words(low, cuts)
        yield (span_hashes(low, s, e) >> np.uint64(64 - BITS)).astype(np.uint32), np.searchsorted(offs, s + at, "right") - 1


def logits(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    total, count = np.zeros((n, len(model.languages))), np.zeros(n)
    for bucket, text in buckets(data, offs):
        if not len(bucket):
            continue
        at = np.flatnonzero(np.diff(text, prepend=-1))
        who = text[at]
        for j in range(total.shape[1]):
            total[who, j] += np.add.reduceat(model.table[j][bucket], at, dtype=np.float64)
        count[who] += np.diff(np.append(at, len(text)))
    return total / np.maximum(count, 1)[:, None] + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def sample(df: DataFrame, lang: Column, id_col: str, text_col: str, per_language: int, passage: int) -> list[tuple[str, str]]:
    """About per_language (text, language) pairs of each language, and no more than a fifth above that, picked by a hash of id and text; equal rows count once."""
    rows = df.filter(F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang")).filter("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    rate = F.element_at(F.create_map(*[F.lit(x) for k, c in sorted(counts.items()) for x in (k, min(1.0, per_language / c))]), F.col("lang"))
    draw = F.xxhash64("id", "text")
    start = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("text") - passage, F.lit(1))).cast("int") + 1
    picked = rows.withColumn("draw", draw).filter(F.col("draw") / F.lit(2.0**64) + 0.5 < rate).select("id", F.substring("text", start, F.lit(passage)).alias("text"), "lang", "draw").distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    got = picked.withColumn("n", first).filter(F.col("n") <= per_language * 6 // 5 + 50).collect()
    return [(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["id"] or 0, r["text"], r["lang"]))]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    b, c = np.unique(np.concatenate([x for x, _ in buckets(data, np.array([0, len(data)]))]), return_counts=True)
    return b, (c / max(1, c.sum())).astype(np.float32)


def train(pairs: list[tuple[str, str]], epochs: int = 4, rate: float = 25.0, dim: int = DIM, seed: int = 7) -> Model:
    languages = sorted({lang for _, lang in pairs})
    if not languages:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    examples, tests = [], []
    for k, (text, lang) in enumerate(pairs):
        y = languages.index(lang)
        at = int(rng.integers(0, max(1, len(text) - 40)))
        short = text[at : at + int(rng.integers(15, 160))]
        for t in (text, short):
            if len(t.encode()) >= 2:
                (tests if k % 5 == 4 else examples).append((*features(t), y))
    tests = tests or examples
    emb = (rng.standard_normal((1 << BITS, dim)) / dim).astype(np.float32)
    w = (rng.standard_normal((dim, len(languages))) / dim**0.5).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps = max(1, epochs * len(examples))
    k = 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            b, share, y = examples[i]
            lr = np.float32(rate * (1 - k / steps))
            k += 1
            mean = share @ emb[b]
            p = mean @ w + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= np.float32(0.02) * lr * np.outer(mean, p)
            bias -= np.float32(0.002) * lr * p
            emb[b] -= lr * share[:, None] * back
    model = Model(languages, np.ascontiguousarray((emb @ w).T), bias.astype(np.float64), 1.0, 0.0)
    x = np.array([(model.table[:, b] @ share) + bias for b, share, _ in tests], dtype=np.float64)
    y = np.array([t[2] for t in tests])
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 41))
    loss = [-np.log(softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(x / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.threshold = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return model


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE, passage: int = PASSAGE) -> Model:
    return train(sample(df, F.col(lang_col), id_col, text_col, per_language, passage))


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (calibrated) and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages * 2**BITS numbers
    new = ["lang_pred", "score", "rejected"]
    kept = [c for c in df.columns if c not in new]
    names = [f"_c{k}" for k in range(len(kept))]
    kind = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(kept, names, strict=True)) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, offs in slices(b.column(b.num_columns - 1)):
                part = b.slice(lo, hi - lo)
                if m.languages:
                    p = softmax(logits(m, data, offs) / m.temperature)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                else:
                    best, score = np.full(hi - lo, -1), np.zeros(hi - lo)
                has = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
                lettered = has & (best >= 0)
                lang = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                score = np.where(lettered, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~has | ((best >= 0) & (score < m.threshold)))], names=[*names, *new])

    text = F.col(f"`{text_col}`").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    src = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], lettered.alias("_lettered"), text.alias("_text"))
    return src.mapInArrow(released(run), kind).toDF(*kept, *new)
