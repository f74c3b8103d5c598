"""Texts of moments: against every pair by hand, and what goes between tasks."""

import random

from pyspark.sql import functions as F

from castclip.operators import intervals

K = ("ep",)
MOMENT = "ep long, moment_idx long, start double, end double, topic string"
CUE = "ep long, cue_idx long, start double, end double, text string"


def by_hand(moments, cues):
    out = []
    for ep, idx, start, end, topic in moments:
        # rows of one moment_idx have all their cues; rows without one, or without an episode, none
        spans = [m[2:4] for m in moments if m[:2] == (ep, idx) and None not in m[:4]]
        said = [c for s, e in spans for c in cues if c[0] == ep and None not in c[2:4] and e > c[2] and s < c[3]]
        out.append((ep, idx, start, end, topic, " ".join(c[4] for c in sorted(said, key=lambda c: (c[2], c[1])) if c[4] is not None) if said else None))
    return sorted(out, key=str)


def test_every_length_of_moments_and_cues(spark):
    rng = random.Random(4)
    at = lambda most: rng.randrange(0, most * 10) / 10
    cues, moments = [], []
    for k in range(300):
        start = at(1500)
        cues.append((rng.choice((1, 2, None)), k, start, start + rng.choice((0.0, 0.5, 3.0, 20.0, 700.0, -5.0)), None if k % 29 == 0 else f"c{k}"))
    for k in range(240):
        start = rng.choice((at(1500), 60.0 * rng.randrange(20)))
        long_ = rng.choice((0.0, 0.1, 15.0, 60.0, 239.9, 240.0, 240.1, 960.0, 4000.0, -10.0))
        moments.append((rng.choice((1, 2, 3, None)), k % 200 if k % 23 else None, start, start + long_, "t"))
    moments += [(1, 901, None, 5.0, "t"), (1, 902, 5.0, None, "t"), (1, 1, 1200.0, 1300.0, "u"), (1, 1, 0.0, 30.0, "v"), (1, 1, 0.0, 30.0, "v")]
    cues += [(1, 500, None, 9.0, "none"), (1, 501, 0.0, None, "none")]
    m, c = spark.createDataFrame(moments, MOMENT), spark.createDataFrame(cues, CUE)
    want = by_hand(moments, cues)
    assert sum(r[5] is not None for r in want) > 100
    for bin in (None, 15.0, 60.0):
        got = intervals.cues_in_range(m, c, K, bin)
        assert got.columns == ["ep", "moment_idx", "start", "end", "topic", "text"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_texts_do_not_go_out_once_a_pair(spark):
    rng = random.Random(5)
    cues = [(1, k, k * 10.0, k * 10.0 + 9, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2000))) for k in range(40)]
    moments = [(1, k, k * 0.5, k * 0.5 + 200, "t") for k in range(400)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    got = intervals.cues_in_range(spark.createDataFrame(moments, MOMENT), spark.createDataFrame(cues, CUE), K, 60.0)
    size = got.agg(F.sum(F.length("text"))).first()[0]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert size > 15_000_000
    assert 0 < written() - before < 1_000_000
