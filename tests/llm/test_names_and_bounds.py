"""Names that two values share, repeated ids, samples and buffers that stay bounded, Kneser-Ney against a plain count."""

import io
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from castclip.llm import jaccard_join, language_id, neighbours, packing, shared, toxicity, warc
from castclip.llm.bytesets import span_hashes


def test_rows_that_share_a_name_are_told_apart(spark):
    rows = [(k % 7, f"t{k % 40}", 5 if k % 40 < 6 else k % 40 + 100) for k in range(400)] + [(None, None, 5)]
    df = spark.createDataFrame(rows, "id long, text string, row long").repartition(4)
    got = shared.told_apart(df, "row", "id", "text").collect()
    by = defaultdict(set)
    for r in got:
        by[r["row"]].add((r["id"], r["text"]))
    assert len(got) == 401 and all(len(x) == 1 for k, x in by.items() if k is not None)
    assert len(by) == len({r[:2] for r in rows})
    same = shared.told_apart(df.filter("row > 100").withColumn("id", F.lit(1)), "row", "text")
    assert sorted(r["row"] for r in same.collect()) == sorted(r[2] for r in rows if r[2] > 100)


@pytest.mark.parametrize("bits", [64, 3])
def test_sets_that_share_a_name_are_told_apart(spark, bits):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(12)]
    rows = [(k, base[k % 12] + (" tail" if k >= 12 else "")) for k in range(24)] + [(k, base[k % 12]) for k in range(24, 36)] + [(40, None), (41, "two words"), (42, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df, name_bits=bits).collect()}
    want = {k: k % 12 for k in range(36)} | {40: 40, 41: 41, 42: 41}
    assert {k: c for k, (_, c) in got.items()} == want
    assert all(got[k + 12][0] == got[k][0] + 1 for k in range(12)) and (got[40][0], got[41][0]) == (0, 1)


def test_rows_with_one_id_are_asked_and_found_alone(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    ids = [0, 0, 0, *range(1, 58)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.search(df, F.col("id") % 50 == 0, recall=1.0).collect()
    assert Counter(r["query_id"] for r in got) == {0: 15, 50: 5} and all(1 <= r["rank"] <= 5 for r in got)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for k in (0, 1, 2, 52):
        near = sorted((-(u[k] @ u[j]), ids[j]) for j in range(60) if j != k)[:5]
        want += [(ids[k], i, round(-s, 9)) for s, i in near]
    assert sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in got) == sorted(want)


def test_samples_are_bounded_without_ids(spark):
    many = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id"))).alias("text"), F.lit("xx").alias("lang"))
    got = language_id.sample(many, F.col("lang"), "doc_id", "text", 100, 2000)
    assert 40 < len(got) <= 170 and len(set(got)) == len(got)
    # one labelled id that stands for very many texts
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("ordinary words "), "id").alias("text")).unionByName(spark.createDataFrame([(2, "vile nasty words"), (None, "x")], "doc_id long, text string"))
    marks = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    seen = []
    keep, toxicity.fit_texts = toxicity.fit_texts, lambda text, y: seen.append((len(text), Counter(y.tolist())))
    try:
        toxicity.fit(hot, marks, ordinary=50)
    finally:
        toxicity.fit_texts = keep
    assert seen == [(111, Counter({0: 110, 1: 1}))]


def test_ranks_of_one_length_take_no_room_for_the_others(spark):
    rows = [(k, 0, 0, 1024 if k % 5 else 300, k) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long").repartition(3)
    got = packing.place(df, 1024, bucket=3).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == 400 and len(by) == 320 + 27
    for parts in by.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 1024


class Endless(io.RawIOBase):
    """Some bytes, then so many zeros, never all in memory."""

    def __init__(self, head, zeros, tail):
        self.parts, self.zeros = [head, None, tail], zeros

    def read(self, n=-1):
        if self.parts and self.parts[0] is not None:
            out, self.parts[0] = self.parts[0][:n], self.parts[0][n:]
            if not self.parts[0]:
                self.parts.pop(0)
            return out or self.read(n)
        if not self.parts:
            return b""
        out = b"\0" * min(n, self.zeros)
        self.zeros -= len(out)
        if not self.zeros:
            self.parts.pop(0)
        return out or self.read(n)


def whole(i, text=b"page"):
    return warc.record(i, f"http://h/{i}", text, warc.digest(text), None)


@pytest.mark.parametrize("zeros", [1, 40 << 20])
def test_a_length_of_ten_gigabytes_is_not_believed(zeros):
    lie = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10000000000\r\n\r\nshort"
    tracemalloc.start()
    rows = list(warc.salvage(Endless(whole(1) + lie, zeros, b"\x1f\x8b\x08 no member " + whole(2)), "f"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[3] for r in rows] == [1, None, 2] and rows[1][5] == "quarantined" and "bytes" in rows[1][10] and peak < 16e6


def test_a_member_that_inflates_too_far_is_left_out():
    bomb = warc.member(whole(7, b"a" * (8 << 20)))
    tracemalloc.start()
    rows = list(warc.salvage(io.BytesIO(warc.member(whole(1)) + bomb + warc.member(whole(2))), "f", 2 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[3] for r in rows] == [1, None, 2] and peak < 12e6
    assert [r[3] for r in warc.salvage(io.BytesIO(warc.member(whole(1)) + bomb), "f")] == [1, 7]


def test_long_records_of_own_archives_are_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "LONGEST", 1000)
    df = spark.createDataFrame([(1, "u", "x" * 5000), (2, "v", "short")], "page_id long, url string, html string")
    assert sorted((r["id"], r["kind"]) for r in warc.read(warc.write(df)).collect()) == [(1, "response"), (2, "response")]


def plain_model(texts, labels):
    """Interpolated Kneser-Ney of each class by dictionaries; words of letters, beginnings of four bytes."""
    d = toxicity.DISCOUNT
    said = [t.lower().split() for t in texts]
    both = Counter(p for w in said for p in zip(w, w[1:], strict=False))
    def contexts(which):
        out = defaultdict(set)
        for w, y in zip(said, labels, strict=True):
            if y in which:
                for k, x in enumerate(w):
                    out[x].add(w[k - 1] if k else None)
        return {x: len(c) for x, c in out.items()}
    shared_, vocabulary = contexts((0, 1)), sorted({x for w in said for x in w})
    made = []
    for c in (0, 1):
        pairs = Counter(p for w, y in zip(said, labels, strict=True) if y == c for p in zip(w, w[1:], strict=False))
        kinds = contexts((c,))
        total = max(1, sum(kinds.values()))
        stems = defaultdict(float)
        for x, n in kinds.items():
            stems[x[:4]] += n
        base = sum(shared_.values()) + 1
        family = defaultdict(float)
        for x, n in shared_.items():
            family[x[:4]] += n
        left = 1 - sum(max(n - d, 0) for n in stems.values()) / total
        begun = {s: max(stems[s] - d, 0) / total + left * family[s] / base for s in family}
        rest = 1 - sum(max(n - d, 0) for n in kinds.values()) / total
        uni = {x: max(kinds.get(x, 0) - d, 0) / total + rest * begun[x[:4]] * shared_[x] / family[x[:4]] for x in vocabulary}
        after = Counter()
        for (a, _), n in pairs.items():
            after[a] += n
        kept = [p for p in both if both[p] > 1]
        weight = {a: 1 - sum(max(pairs[p] - d, 0) for p in kept if p[0] == a) / max(after[a], 1) for a in vocabulary}
        two = {p: max(pairs[p] - d, 0) / max(after[p[0]], 1) + weight[p[0]] * uni[p[1]] for p in kept}
        made.append((uni, two, weight, rest * left / base))
    return made


def test_counts_are_kneser_ney():
    rng = random.Random(6)
    words = ["vile", "vilest", "nasty", "calm", "calmer", "plain", "words", "ill", "kind", "kindly"]
    texts = [" ".join(rng.choices(words[: 6 + 4 * (k % 2)], k=rng.randrange(1, 12))) for k in range(40)]
    labels = np.array([k % 2 for k in range(40)])
    m = toxicity.count_models(texts, labels)
    name = lambda w: int(span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), toxicity.LOWER_VALUE)[0])
    at = {w: int(np.searchsorted(m.word, name(w))) for w in words}
    for c, (uni, two, weight, unseen) in enumerate(plain_model(texts, labels)):
        assert abs(sum(uni.values()) + unseen - 1) < 1e-9
        for w, p in uni.items():
            assert math.isclose(math.exp(m.unigram[c, at[w]]), p, rel_tol=1e-9) and math.isclose(math.exp(m.backoff[c, at[w]]), weight[w], rel_tol=1e-9)
        assert math.isclose(math.exp(m.unseen[c, -1]), unseen, rel_tol=1e-9)
        assert len(m.pair) == len(two)
        for (a, b), p in two.items():
            key = toxicity.mix(np.array([name(a)], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.array([name(b)], np.uint64))[0]
            assert math.isclose(math.exp(m.bigram[c, int(np.searchsorted(m.pair, key))]), p, rel_tol=1e-9)
        for a in uni:  # what follows a word sums to one
            whole_ = sum(two.get((a, b), weight[a] * uni[b]) for b in uni) + weight[a] * unseen
            assert abs(whole_ - 1) < 1e-9
