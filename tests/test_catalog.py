"""Registered queries take in every row of their views: small tables against brute force."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from castclip import helpers
from castclip.operators import moments
from castclip.plans import catalog


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """Episodes 7 and 75 alike: two turns each, and windows of three tracks over them."""
    folder = tmp_path_factory.mktemp("talks")
    said = [(c, t, "user", "a" * (20 + 7 * t + c % 3)) for c in (70, 750) for t in range(4)]
    lines = [(o, n, (o * 7 + n * 5) % 50 + 1) for o in (7, 107, 507, 907, 75, 175, 575, 975, 1175) for n in (1, 2, 3)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity long").write.parquet(f"{folder}/lineitem.parquet")
    spans, at, seg = [], {}, {}
    for conv, turn, _, text in said:
        ep = conv // 10
        end = at.get(ep, 0) + len(text) * 40 + 400 + (turn * 7919 + conv) % 7 * 300
        at[ep], seg[ep] = end, seg.get(ep, 0) + 1
        spans.append((ep, seg[ep], f"SPEAKER_0{(conv * 3 + turn + turn % 3) % 4}", end - len(text) * 40 - 400, end))
    wins = [(o % 100, o, n, q, o // 100 * 400, o // 100 * 400 + 400) for o, n, q in lines]
    met = [(w, x) for w in wins for x in spans if w[0] == x[0] and w[5] >= x[3] and w[4] <= x[4]]
    return str(folder), spans, wins, met


def votes(spans, wins, met):
    out = {(ep, who, track): (0, 0) for ep, _, who, _, _ in spans for e, _, track, *_ in wins if e == ep}
    for w, x in met:
        total, n = out[w[0], x[2], w[2]]
        out[w[0], x[2], w[2]] = (total + w[3], n + 1)
    return out


def test_windows_of_every_episode_vote(spark, talks):
    folder, spans, wins, met = talks
    assert {w[0] for w, _ in met} == {7, 75}
    got = sorted(map(tuple, catalog.join5_activity_votes(spark, folder).select("episode_id", "w", "track_id", "seg_idx").collect()))
    assert got == sorted((w[0], w[1], w[2], x[1]) for w, x in met)
    want = votes(spans, wins, met)
    assert {(r[0], r[1], r[2]): (r[3], r[4]) for r in catalog.agg6_vote_matrix(spark, folder).collect()} == want
    shares = {}
    for (ep, who, track), (total, n) in want.items():
        if track == 1 and n:
            whole = sum(v[0] for k, v in want.items() if k[:2] == (ep, who))
            share = (total * 2000 + whole) // (2 * whole) / 1000
            shares[ep, who] = (share, share < 0.4)
    assert {(r[0], r[1]): (r[3], r[4]) for r in catalog.agg8_binding_confidence(spark, folder).collect()} == shares


def test_speakers_of_every_episode_are_assigned(spark, talks):
    folder, spans, wins, met = talks
    mean = {k: t / n if n else 0.0 for k, (t, n) in votes(spans, wins, met).items()}
    got = {}
    for ep, who, track in catalog.win31_assign_speakers(spark, folder).select("episode_id", "speaker", "track_id").collect():
        got.setdefault(ep, {})[who] = track
    assert set(got) == {7, 75}
    for ep, pairs in got.items():
        names = sorted({k[1] for k in mean if k[0] == ep})
        n = min(len(names), 3)
        best = max(sum(mean[ep, a, b] for a, b in zip(some, order)) for some in itertools.combinations(names, n) for order in itertools.permutations((1, 2, 3), n))
        assert len(pairs) == len(set(pairs.values())) == n
        assert abs(sum(mean[ep, a, b] for a, b in pairs.items()) - best) < 1e-9


@pytest.fixture(scope="module")
def candidates(spark, tmp_path_factory):
    """Two episodes of 150 and 250 candidates."""
    folder = tmp_path_factory.mktemp("candidates")
    made = [(k, 3 if k % 8 < 3 else 20) for k in range(1, 401)]
    spark.createDataFrame(made, "event_id long, user_id long").selectExpr("*", "timestamp '2024-01-01' AS ts", "'view' AS event_type").write.parquet(f"{folder}/events.parquet")
    pool = {0: [], 1: []}
    for k, user in made:
        start = k * 7919 % 1200
        pool[user // 15].append((k, float(start), float(start + 30 + k * 104729 % 200), k * 31 % 101 / 10))
    return str(folder), pool


def test_constraints_see_the_whole_pool(spark, candidates):
    folder, pool = candidates
    want = []
    for ep, own in pool.items():
        kept = []
        for m in sorted(own, key=lambda m: (-m[3], m[0])):
            if m[3] >= 3.5 and not any((min(m[2], x[2]) - max(m[1], x[1])) / (m[2] - m[1]) > 0.70 for x in kept):
                kept.append(m)
        good = lambda some: [m for m in some if 61 <= m[2] - m[1] <= 180]
        kept = sorted(good(kept), key=lambda m: (-m[3], m[1], m[0]))[:35]
        if len(kept) < 20:
            seen, room = {m[1:3] for m in kept}, 35 - len(kept)
            first = {}
            for m in good(own):
                if m[3] >= 3.0 and m[1:3] not in seen:
                    first.setdefault(m[1:3], m)
            kept += sorted(first.values(), key=lambda m: (-m[3], m[0]))[:room]
        assert 20 <= len(kept) <= 35
        want += [(ep, round(m[1] * 1000), round(m[2] * 1000), m[3], "") for m in kept]
    assert sorted(map(tuple, catalog.win16_to_win18_enforce_constraints(spark, folder).collect())) == sorted(want)


def test_counts_are_of_all_moments_and_jobs(spark, candidates):
    folder, pool = candidates
    orders = [(o, o % 3 + 50 * (o % 2)) for o in range(1, 91)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").selectExpr("*", "date '2024-01-01' AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    want = []
    for ep in range(3):
        done = [o % 9 for o, c in orders if c % 50 == ep]
        shorts, exported = len(pool.get(ep, ())), done.count(8)
        want.append((ep, shorts, 2 in done, exported, int(min(exported, shorts) * 1000 / shorts + 0.5) / 10 if shorts else 0.0))
    got = catalog.agg16_episode_counts(spark, folder).select("episode_id", "shorts", "has_transcript", "exported", "export_pct")
    assert sorted(map(tuple, got.collect())) == want


def test_moments_are_deduplicated_best_first(spark):
    rng = random.Random(3)
    rows = [(ep, k, float(s := 400 * rng.randrange(6) + rng.randrange(150)), float(s + rng.randrange(0, 120)), float(rng.randrange(5))) for ep in (1, 2) for k in range(60)]
    out = moments.dedup_moments(spark.createDataFrame(rows, "ep long, moment_idx long, start double, end double, score double"), keys=("ep",))
    want = []
    for ep in (1, 2):
        kept = []
        for m in sorted((r for r in rows if r[0] == ep), key=lambda r: (-r[4], r[1])):
            if not any(m[3] > m[2] and (min(m[3], x[3]) - max(m[2], x[2])) / (m[3] - m[2]) > 0.70 for x in kept):
                kept.append(m)
        want += kept
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_silhouettes_are_taken_in_blocks():
    x = np.random.default_rng(1).normal(size=(2200, 32)) + np.repeat(np.arange(4), 550)[:, None] * 4
    tracemalloc.start()
    own = helpers.voice_clusters(x, None, 2, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(own)) == 4 and all(len(set(own[550 * k : 550 * k + 550])) == 1 for k in range(4))
    assert peak < 200e6
    few, kinds = x[::20], own[::20]
    d = np.sqrt(((few[:, None] - few[None]) ** 2).sum(axis=2))
    a = np.array([d[i, kinds == kinds[i]].sum() / ((kinds == kinds[i]).sum() - 1) for i in range(len(few))])
    b = np.array([min(d[i, kinds == c].mean() for c in set(kinds) - {kinds[i]}) for i in range(len(few))])
    assert abs(helpers.silhouette(few, kinds, 50) - ((b - a) / np.maximum(a, b))[:50].mean()) < 1e-9


def test_round_trip_gives_the_length_of_the_parsed_text(spark, talks, monkeypatch):
    folder, spans, _, _ = talks
    whole = [(x[0], x[1] - 1, x[3], x[4], (x[4] - x[3] - 400) // 40) for x in spans]
    assert sorted(map(tuple, catalog.src1_src8_srt_round_trip(spark, folder).collect())) == sorted(whole)
    parse = catalog.io.parse_srt
    monkeypatch.setattr(catalog.io, "parse_srt", lambda *a, **k: parse(*a, **k).withColumn("text", F.left("text", F.lit(5))))
    assert {r["n"] for r in catalog.src1_src8_srt_round_trip(spark, folder).collect()} == {5}
