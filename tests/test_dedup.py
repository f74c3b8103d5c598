"""Greedy de-duplication in rounds against the helper that takes an episode whole."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from castclip import helpers
from castclip.operators import moments

SCHEMA = "ep string, moment_idx long, start double, end double, score double, hook string"


def drawn(seed, n, span, eps=("a", "b", None)):
    rng = random.Random(seed)
    rows = []
    for ep in eps:
        for k in range(n):
            s = round(rng.uniform(0, span), 1)
            rows.append((ep, k, s, round(s + rng.choice((0.0, 5.0, 30.0, 61.0, 200.0)) + rng.random(), 1), rng.choice((None, 5.0, 7.5, float(rng.randrange(100)))), f"h{k}"))
        rows += rows[-3:]  # repeated rows
        rows.append((ep, n, None, 3.0, 9.0, "no start"))
    return rows


def kept(rows, share):
    out = []
    df = pd.DataFrame(rows, columns=["ep", "i", "s", "e", "score", "hook"])
    for _, part in df.fillna({"ep": "-"}).groupby("ep"):
        whole = part.dropna(subset=["s", "e"])
        whole = whole.assign(low=-whole["score"].fillna(-np.inf)).sort_values(["low", "i", "s", "e"], kind="stable")
        mask = helpers.kept_by_overlap(whole["s"].to_numpy(float), whole["e"].to_numpy(float), share)
        out += [(ep, i, s, e) for ep, i, s, e in whole[mask][["ep", "i", "s", "e"]].itertuples(index=False)]
        out += [(ep, i, -1.0, -1.0) for ep, i in part[part["s"].isna() | part["e"].isna()][["ep", "i"]].itertuples(index=False)]
    return sorted(out)


def told(df):
    return sorted((r["ep"] or "-", r["moment_idx"], -1.0 if r["start"] is None else r["start"], r["end"] if r["start"] is not None else -1.0) for r in df.collect())


@pytest.mark.parametrize(("share", "block", "most"), [(0.7, 3600.0, 4000), (0.7, 90.0, 4000), (0.7, 400.0, 5), (0.3, 150.0, 40)])
def test_rounds_keep_what_one_pass_keeps(spark, share, block, most):
    rows = drawn(1, 160, 1500.0)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert told(moments.dedup_moments(df, share, ("ep",), block, most)) == kept(rows, share)


def test_nothing_to_take_out(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert moments.dedup_moments(df, keys=("ep",)).count() == 0
    alone = spark.createDataFrame([("a", 1, None, None, 1.0, "x"), ("a", 1, None, None, 1.0, "x")], SCHEMA)
    assert moments.dedup_moments(alone, keys=("ep",)).count() == 2


def test_a_dense_episode_is_shared_among_tasks(spark):
    """60,000 moments over 20 minutes: blocks look at 2,000 at once, the rest is taken out by joins."""
    rng = np.random.default_rng(2)
    n = 60_000
    s = np.round(rng.uniform(0, 1200, n), 1)
    pdf = pd.DataFrame({"ep": "a", "moment_idx": np.arange(n), "start": s, "end": np.round(s + rng.uniform(30, 200, n), 1), "score": rng.integers(0, 1000, n) / 10, "hook": "h"})
    got = told(moments.dedup_moments(spark.createDataFrame(pdf, SCHEMA).repartition(8), keys=("ep",), most=2000))
    assert got == kept(list(pdf.itertuples(index=False, name=None)), 0.7)


def test_parts_tell_only_what_they_know():
    start, end = np.array([0.0, 1, 50, 51, 52]), np.array([10.0, 11, 60, 61, 62])
    yes = np.ones(5, bool)
    assert helpers.settled(start, end, yes, yes, 0.7).tolist() == [1, 0, 1, 0, 0]
    inside = np.array([False, True, True, True, False])  # the first may be covered elsewhere
    assert helpers.settled(start, end, yes, inside, 0.7).tolist() == [1, 2, 1, 0, 0]
    assert helpers.settled(start, end, np.array([False, True, True, True, True]), inside, 0.7).tolist()[1:] == [0, 1, 0, 0]


def test_more_rows_of_a_key_than_a_block_takes(spark):
    """Moments of one time and score: one stays of each run, however many there are."""
    rows = spark.range(3000).select(F.lit("a").alias("ep"), F.col("id").alias("moment_idx"), F.lit(5.0).alias("start"), F.lit(50.0).alias("end"), F.lit(1.0).alias("score"), F.lit("h").alias("hook"))
    assert [r["moment_idx"] for r in moments.dedup_moments(rows, keys=("ep",), most=100).collect()] == [0]
