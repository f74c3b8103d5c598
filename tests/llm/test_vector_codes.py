"""Vector codes against a plain recomputation in whole numbers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from castclip.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id long, code string"


def plain(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector, label), whole vectors only. Rows of (vec_id, code, error, label_error), and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * float(np.float32(x))) for x in v] for _, v, _ in rows]
    size = len(whole[0]) // parts
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c, p: min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e))
    for _ in range(rounds):
        own = [[near(c, p) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                if some := [c[p] for c, o in zip(cut, own, strict=True) if o[p] == e]:
                    books[p][e] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    own = [[near(c, p) for p in range(parts)] for c in cut]
    error = [sum(far(c[p], books[p][o[p]]) for p in range(parts)) for c, o in zip(cut, own, strict=True)]
    of = Counter()
    for r, e in zip(rows, error, strict=True):
        of[r[2]] += e
    return sorted(((r[0], "".join(f"{x:02x}" for x in o), e, of[r[2]]) for r, o, e in zip(rows, own, error, strict=True)), key=str), books


def made(n, dim, seed, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(7)]
    rows = [(k, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([None, *range(labels)])) for k in range(n)]
    return [(k, [float(np.float32(x)) for x in v], c) for k, v, c in rows]


def frame(spark, rows):
    return spark.createDataFrame([(k, v, c, 1, "x") for k, v, c in rows], SCHEMA).repartition(4)


def found(df):
    return sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [vector_codes.BLOCK, 7])
def test_codes_errors_and_codebooks(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    good = made(300, 16, 1)
    good += [(5, good[5][1], 0), (5, good[9][1], 1), (None, good[3][1], None), (-4, good[0][1], 9), (10**15, [0.0] * 16, 2), (301, [1e-5, -1e-5] * 8, 2), (302, [2.0, -2.0] * 8, 2)]
    bad = [(7, None, 0), (8, [float("nan")] + [0.0] * 15, 0), (9, [float("inf")] * 16, 1), (-9, [-float("inf")] * 16, 1), (-10, [None] + [1.0] * 15, 1), (-11, [1.0] * 8, 1), (-12, [], None), (-13, [1e30] * 16, 0), (None, None, None)]
    out, books = vector_codes.compress(frame(spark, good + bad), parts=8, entries=16, rounds=6)
    want, own = plain(good, 8, 16, 6, 4096)
    assert books.tolist() == own
    assert found(out) == want


def test_ties_repeats_and_few_vectors(spark):
    same = [(k, [0.25] * 4, k % 2) for k in range(9)]
    for rows in (same, same[:1], made(5, 4, 3), [(k, [0.5 * (k % 3), 0.0, 0.0, 0.0], None) for k in range(30)], [(None, [0.5, 0.25, 0.0, -0.125], 1)] * 3):
        out, books = vector_codes.compress(frame(spark, rows), parts=2, entries=4, rounds=3, scale=8)
        want, own = plain(rows, 2, 4, 3, 8)
        assert (found(out), books.tolist()) == (want, own)


def test_labels_beyond_the_hot_ones_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT", 4)
    rows = [(k, v, None if k % 3 else k) for k, v, _ in made(120, 4, 5)]
    out, _ = vector_codes.compress(frame(spark, rows), parts=2, entries=4, rounds=1)
    assert found(out) == plain(rows, 2, 4, 1, 4096)[0]


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 8, 2)]):
        out, books = vector_codes.compress(frame(spark, rows))
        assert (out.count(), books) == (0, None)
        assert out.columns == ["id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, [(1, [1.0] * 7, 1)]))


def test_dictionaries_give_the_distances_of_the_vectors():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (200, 6))
    found = [np.unique(x[:, d], return_inverse=True) for d in range(6)]
    books = rng.integers(-50, 50, (2, 5, 3))
    own, error = vector_codes.nearest([u for u, _ in found], np.stack([c for _, c in found]), books)
    far = ((x.reshape(200, 2, 1, 3) - books[None]) ** 2).sum(axis=3)
    assert np.array_equal(own.T, far.argmin(axis=2)) and np.array_equal(error.T, far.min(axis=2))
