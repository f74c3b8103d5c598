"""Clustering of episodes shared among tasks against the same in one task."""

import numpy as np
import pytest

from castclip.operators import binding

K = ("ep",)


def _same(one, many, order, label):
    pick = lambda d: sorted(((r["ep"] is not None, r["ep"] or "", r[order], r[label]) for r in d.collect()))
    got = pick(many)
    assert got == pick(one)
    return got


def test_faces_of_large_episodes(spark):
    draw = np.random.default_rng(5)
    rows = []
    for ep, centres in (("a", [0.2, 0.5, 0.8]), (None, [0.3, 0.7]), ("small", [0.5])):
        for n in range(300 if ep != "small" else 6):
            x = centres[n % len(centres)] + draw.normal(0, 0.02)
            rows.append((ep, n, float(n) / 3, float(x), float(0.4 + draw.normal(0, 0.02)), 0.1, 0.1, 0.9))
    df = spark.createDataFrame(rows, "ep string, det int, t double, cx double, cy double, w double, h double, confidence double")
    got = _same(binding.cluster_faces(df, 5, K), binding.cluster_faces(df, 5, K, most=20), "det", "cluster")
    assert len(got) == len(rows) and {g[3] for g in got if g[1] == "a"} == {0, 1, 2}


@pytest.mark.parametrize("fixed", [None, 3])
def test_voices_of_large_episodes(spark, fixed):
    draw = np.random.default_rng(7)
    rows = []
    for ep, k in (("a", 3), (None, 2), ("small", 1)):
        middle = np.array([[4.0 * ((voice + j) % k) for j in range(6)] for voice in range(k)])
        rows += [(ep, n, float(n), (middle[n // 7 % k] + draw.normal(0, 0.3, 6)).tolist()) for n in range(120 if ep != "small" else 3)]
    df = spark.createDataFrame(rows, "ep string, win_idx int, t double, features array<double>")
    got = _same(binding.cluster_voices(df, fixed, 2, 4, K), binding.cluster_voices(df, fixed, 2, 4, K, most=20), "win_idx", "label")
    heard = [{g[3] for g in got if g[1] == "a" and g[2] // 7 % 3 == voice} for voice in range(3)]
    assert len(got) == len(rows) and sum(map(len, heard)) == len(set.union(*heard))  # no label is of two voices
