"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary texts, back off to the continuation counts of their class (in how many
contexts it has a word), then to those of its word beginnings (``STEM`` bytes, for inflected forms that were never seen), and from there
to one shared continuation distribution, counted over both classes: an expression rare in either class gets the
same smoothing in both. A text's evidence is the difference of the two log-likelihoods, normalised by
length, over the whole text and over its most toxic windows of 1, 3, 8 and 32 words; a logistic
layer, fitted on texts that the counts left out, turns it into a probability.

The models are fitted on a bounded sample: about ``toxic`` and ``ordinary`` labelled texts, and no more than a fifth above that, picked by a hash of the id, of
which a longer text gives one passage of ``passage`` characters that begins at a place given by a hash of its id. Bigrams seen
once are left to the backoff, a usual cut-off of such models: held out, more toxic texts are found with it and fewer others marked.

Cases: null and empty texts, and texts without a word, get the score of no evidence; words are runs of letters and
bytes above ASCII, A-Z lower-cased; equal texts get equal scores; repeated label rows of an id count once (1 wins over 0); without labels of both
classes every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import LOWER_VALUE, mix, per_text, pieces, slices, span_hashes, word_hashes

TOXIC, ORDINARY, PASSAGE = 1500, 2500, 40_000
WINDOWS = (1, 3, 8, 32)
DISCOUNT = 0.3  # chosen by parts of the training rows; near copies make higher ones unsure of what they have seen
STEM = 4
WORD = np.array([chr(b).isalpha() or b > 127 for b in range(128)] + [True] * 128)


@dataclass
class Model:
    word: np.ndarray  # sorted hashes
    unigram: np.ndarray  # log-probability per class and word
    stem: np.ndarray  # sorted hashes of beginnings
    unseen: np.ndarray  # log-probability per class of a beginning's unseen words, and of an unseen beginning at the end
    backoff: np.ndarray  # log of the weight that each class leaves after a word
    pair: np.ndarray  # sorted hashes of bigrams
    bigram: np.ndarray  # log-probability per class
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    trained: bool = True


def _pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words, and the place of each second word."""
    at = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    return mix(h[at - 1] * np.uint64(0xD6E8FEB86659FD93) + h[at]), at


def _hashed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, and the text of each."""
    h, s, e, doc = word_hashes(data, offs, WORD)
    stems, at = [np.zeros(0, np.uint64)], 0
    for begin, part, _ in pieces(data, offs, WORD):
        past = int(np.searchsorted(s, begin + len(part)))
        own = s[at:past] - begin
        stems.append(span_hashes(part, own, np.minimum(e[at:past] - begin, own + STEM), LOWER_VALUE))
        at = past
    return h, np.concatenate(stems), doc


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(*h, doc + lo) for lo, _, data, offs in slices(pa.array(texts, pa.string())) for *h, doc in [_hashed(data, offs)]]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def count_models(texts: list[str], labels: np.ndarray) -> Model:
    """Kneser-Ney models of both classes over one vocabulary.

    A bigram's count less the discount stands over that of its first word; what is left over goes to the class's continuation probability of the second
    word: in how many different contexts (words before it, or a text's beginning) the class has it. Its own remainder goes to words that begin alike,
    and theirs to the shared counts: contexts in either class. Every step's remainder is what its kept counts leave of 1."""
    h, g, doc = _tokens(texts)
    y = labels[doc]
    d = DISCOUNT
    word, at_word, inv = np.unique(h, return_index=True, return_inverse=True)
    stem, sinv = np.unique(g, return_inverse=True)
    of = sinv[at_word]
    key, at = _pairs(h, doc)
    pair, first, pinv = np.unique(key, return_index=True, return_inverse=True)
    two = np.stack([np.bincount(pinv[y[at] == k], minlength=len(pair)) for k in (0, 1)]).astype(float)
    left, right = inv[at[first] - 1], inv[at[first]]
    begins = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    starts = np.stack([np.bincount(inv[begins & (y == k)], minlength=len(word)) for k in (0, 1)]) > 0
    # different contexts of each word, in each class and in either
    kinds = np.stack([np.bincount(right, weights=two[k] > 0, minlength=len(word)) for k in (0, 1)]) + starts
    shared = np.bincount(right, minlength=len(word)) + starts.any(axis=0) + 0.0
    total = np.maximum(kinds.sum(axis=1), 1)[:, None]
    by_stem = lambda x: np.bincount(of, weights=x, minlength=len(stem))
    beg, family = np.stack([by_stem(kinds[k]) for k in (0, 1)]), by_stem(shared)
    base = shared.sum() + 1.0  # a word that was never seen counts one context
    lam = 1 - np.maximum(beg - d, 0).sum(axis=1)[:, None] / total
    begun = np.maximum(beg - d, 0) / total + lam * (family / base)
    lam_word = 1 - np.maximum(kinds - d, 0).sum(axis=1)[:, None] / total
    unigram = np.maximum(kinds - d, 0) / total + lam_word * begun[:, of] * (shared / family[of])
    unseen = lam_word * np.append(begun, lam / base, axis=1)
    after = np.stack([np.bincount(left, weights=two[k], minlength=len(word)) for k in (0, 1)])
    keep = two.sum(axis=0) > 1
    sure = np.maximum(two - d, 0) / np.maximum(after[:, left], 1)
    weight = 1 - np.stack([np.bincount(left[keep], weights=sure[k, keep], minlength=len(word)) for k in (0, 1)])
    bigram = sure[:, keep] + weight[:, left[keep]] * unigram[:, right[keep]]
    z = np.zeros(0)
    return Model(word, np.log(unigram), stem, np.log(unseen + 1e-300), np.log(np.append(weight, np.ones((2, 1)), axis=1)), pair[keep], np.log(bigram), z, z, z)


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x, or the length where it is missing."""
    i = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[i] == x, i, len(sorted_))


def evidence(m: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Features of each text: length-normalised differences of log-likelihood, of the whole and of the best windows."""
    n = len(offs) - 1
    out = np.zeros((n, len(WINDOWS) + 2))
    h, g, doc = _hashed(data, offs)
    if not len(h):
        return out
    i = _find(m.word, h)
    new = np.flatnonzero(i == len(m.word))
    llr = np.append(m.unigram[1] - m.unigram[0], 0.0)[i]
    llr[new] = (m.unseen[1] - m.unseen[0])[_find(m.stem, g[new])]
    key, at = _pairs(h, doc)
    llr[at] += (m.backoff[1] - m.backoff[0])[i[at - 1]]
    if len(m.pair):
        j = _find(m.pair, key)
        hit = j < len(m.pair)
        llr[at[hit]] = (m.bigram[1] - m.bigram[0])[j[hit]]
    cut = per_text(doc, n)
    some = np.flatnonzero(np.diff(cut))
    sums = np.concatenate([[0.0], np.cumsum(llr)])
    size = np.diff(cut)[some]
    out[some, 0] = (sums[cut[some + 1]] - sums[cut[some]]) / size
    out[some, 1] = np.log1p(size)
    end = cut[doc + 1]
    for k, w in enumerate(WINDOWS):
        # windows that would run past their text are shorter, yet divided by w: no window gains by being cut
        stop = np.minimum(np.arange(len(h)) + w, end)
        out[some, 2 + k] = np.maximum.reduceat((sums[stop] - sums[: len(h)]) / w, cut[some])
    return out


def fit_layer(m: Model, x: np.ndarray, labels: np.ndarray, rounds: int = 60) -> Model:
    """Logistic regression by Newton steps with a small ridge; the bias keeps the sample's share of both classes."""
    m.mean, m.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([(x - m.mean) / m.scale, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    m.weights = w
    return m


def scores(m: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if not m.trained:
        return np.zeros(len(offs) - 1)
    x = (evidence(m, data, offs) - m.mean) / m.scale
    return 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, ordinary: int = ORDINARY, passage: int = PASSAGE) -> Model:
    """labels: id and 0/1."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    z = np.zeros(0)
    if len(counts) < 2:
        return Model(z, z, z, z, z, z, z, z, z, z, False)
    rate = F.when(F.col("y") == 1, min(1.0, toxic / counts[1])).otherwise(min(1.0, ordinary / counts[0]))
    first = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    most = F.when(F.col("y") == 1, toxic * 6 // 5 + 50).otherwise(ordinary * 6 // 5 + 50)
    picked = marks.filter("id IS NOT NULL").withColumn("draw", F.xxhash64("id")).filter(F.col("draw") / F.lit(2.0**64) + 0.5 < rate)
    picked = picked.withColumn("n", first("y", "draw", "id")).filter(F.col("n") <= most).select("id", "y", "draw")
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    start = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("text") - passage + 1, F.lit(1))).cast("int") + 1
    texts = texts.select("id", F.substring("text", start, F.lit(passage)).alias("text"))
    # an id may stand for several texts
    rows = texts.join(F.broadcast(picked), "id").select("id", "y", "text", "draw").distinct().withColumn("n", first("y", "draw", "id", "text")).filter(F.col("n") <= most)
    rows = sorted((r["id"], r["y"], r["text"]) for r in rows.collect())
    y = np.array([r[1] for r in rows])
    text = [r[2] for r in rows]
    del rows
    if len(set(y.tolist())) < 2:
        return Model(z, z, z, z, z, z, z, z, z, z, False)
    return fit_texts(text, y)


def fit_texts(text: list[str], y: np.ndarray, folds: int = 4) -> Model:
    """Counts of all texts; the logistic layer sees each text's evidence under counts of the other folds."""
    turn = np.zeros(len(y), dtype=int)
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum()) % folds
    part = lambda ok: [t for t, k in zip(text, ok, strict=True) if k]
    rows, marks = [], []
    for k in range(folds):
        own = turn == k
        if len(set(y[~own].tolist())) == 2:
            held = count_models(part(~own), y[~own])
            rows += [evidence(held, data, offs) for _, _, data, offs in slices(pa.array(part(own), pa.string()))]
            marks.append(y[own])
            del held
    model = count_models(text, y)
    if not marks:
        rows, marks = [evidence(model, data, offs) for _, _, data, offs in slices(pa.array(text, pa.string()))], [y]
    return fit_layer(model, np.concatenate(rows), np.concatenate(marks))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(scores(m, data, offs), pa.float64())], names=["id", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")
