"""Every dealt operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from castclip.llm import bytesets, exact_dedup, jaccard_join, language_id, lm_scoring, neighbours, packing, suffix_dedup, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea near a quiet harbour at night and nobody asks why"
PASSAGE = " ".join(f"word{k}" for k in range(60))


def make_docs():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [None, "", "   \n", "one", "One", "two words", BASE, BASE.upper(), BASE + " indeed", "1 2 3 ...", "é" * 500, "aaaa " * 200, "Ünï çödé"]
    rows += [" ".join(rng.choice(vocabulary, rng.integers(5, 60))) for _ in range(40)]
    rows += [rows[-1], rows[-1].upper(), rows[-2] + " tail"]
    rows += [f"intro {k} {PASSAGE} outro {k * 7}" for k in range(4)]
    rows += [" ".join(rng.choice(vocabulary, 6000))]
    long_ = rows[-1].split()
    rows += [" ".join(long_[:5900]), " ".join(long_[300:])]
    return [(k, t, None if k % 9 == 0 else ("xx" if k % 2 else "yy"), None, None, -k) for k, t in enumerate(rows)]


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").encode().lower()


def test_exact_classes(docs, none):
    got = {r["id"]: r for r in exact_dedup.exact_classes(docs).collect()}
    groups = {}
    for k, t, *_ in ROWS:
        groups.setdefault(low(t), []).append(k)
    assert len(got) == len(ROWS)
    for k, t, *_ in ROWS:
        g = groups[low(t)]
        assert (got[k]["keep_id"], got[k]["group_size"], got[k]["sha"]) == (max(g), len(g), hashlib.sha256(low(t)).hexdigest())
    split = exact_dedup.exact_classes(docs, huge_bytes=1000, members=1)
    assert {r["id"]: r["keep_id"] for r in split.collect()} == {k: r["keep_id"] for k, r in got.items()}
    assert exact_dedup.exact_classes(none).count() == 0


def test_exact_classes_with_ids_that_repeat(spark, monkeypatch):
    rows = [(1, "same"), (5, "Same"), (5, "other"), (9, "same"), (None, "SAME"), (None, None), (7, ""), (7, ""), (8, "twin A"), (2, "twin B"), (3, "twin b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(1, 9, 4), (5, 9, 4), (5, 5, 1), (9, 9, 4), (-1, 9, 4), (-1, 7, 3), (7, 7, 3), (7, 7, 3), (8, 8, 1), (2, 3, 2), (3, 3, 2)])
    told = lambda x: sorted((-1 if r["id"] is None else r["id"], r["keep_id"], r["group_size"]) for r in x.collect())
    assert told(exact_dedup.exact_classes(df)) == want
    assert told(exact_dedup.exact_classes(df, huge_bytes=3, members=1)) == want
    # all texts of one length collide
    plain = exact_dedup.fingerprint
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda *a: plain(*a).withColumn("fp", F.lit(7).cast("long")))
    assert told(exact_dedup.exact_classes(df, members=2)) == want


def classes():
    sets = {}
    for k, t, *_ in ROWS:
        w = low(t).split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return sets, top


@pytest.mark.parametrize("most", [jaccard_join.MOST, 3000, 600])
def test_jaccard_classes(docs, none, most):
    sets, top = classes()
    got = {r["id"]: r for r in jaccard_join.jaccard_classes(docs, most=most).collect()}
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {k: (len(s), top[k]) for k, s in sets.items()}
    assert jaccard_join.jaccard_classes(none).count() == 0


def brute_classes(sets):
    top = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 100 * len(x & y) >= 80 * len(x | y) and top[a] != top[b]:
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = [new if t == old else t for t in top]
    return top


@pytest.mark.parametrize("leaf", [32, 6])
def test_regions_find_the_classes_with_one_link_a_member(leaf):
    rng = np.random.default_rng(leaf)
    sets = []
    for k in range(6):
        base = rng.choice(1 << 40, 100, replace=False)
        for _ in range(30):
            own = base.copy()
            at = rng.choice(100, rng.integers(0, 25), replace=False)
            own[at] = rng.integers(1 << 50, 1 << 51, len(at))
            sets.append(own[: rng.integers(80, 101)])
    keep, jaccard_join.LEAF = jaccard_join.LEAF, leaf
    try:
        got = jaccard_join.region_links(list(range(len(sets))), [np.sort(s).astype(np.uint64) for s in sets], 80)
    finally:
        jaccard_join.LEAF = keep
    want = brute_classes([set(s.tolist()) for s in sets])
    assert len(got) == len(sets) - len(set(want))
    top = list(range(len(sets)))
    for a, b in got:
        top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
    assert top == want


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, extra).astype(np.uint64)])) for n in (100, 126, 130, 500, 600, 1000, 1024, 1100, 2900) for extra in (0, 9, 30)]
    bits = [jaccard_join.parity(s).tobytes() for s in sets]
    ok = jaccard_join.possible(np.array([len(s) for s in sets]), bits, 80)
    link = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    for k, s in enumerate(sets):
        if any(link(s, y) for j, y in enumerate(sets) if j != k):
            assert ok[k]


def test_chains_of_links_become_one_class(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["c"] for r in jaccard_join.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("length", [40, 200])
def test_repeats_are_cut_out(docs, none, length):
    count = Counter()
    for _, t, *_ in ROWS:
        raw = (t or "").encode()
        count.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    got = {r["id"]: r for r in suffix_dedup.remove_repeats(docs, length=length).collect()}
    for k, t, *_ in ROWS:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], bytes(got[k]["kept"])) == (len(raw), int(gone.sum()), spans, left), k
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_strings_of_crowded_anchors_are_counted(spark):
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh"), 230))
    rows = [(k, "".join(rng.choice(list("abcdefgh"), 200)) + shared + "".join(rng.choice(list("abcdefgh"), 200))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keep, suffix_dedup.CONTEXTS = suffix_dedup.CONTEXTS, 4
    try:
        got = suffix_dedup.remove_repeats(df).collect()
    finally:
        suffix_dedup.CONTEXTS = keep
    assert {r["n_removed"] >= 230 for r in got} == {True} and max(r["n_removed"] for r in got) < 240


def test_repeats_with_ids_that_repeat_and_long_runs(spark):
    """Rows of one id with other texts, equal rows, no id, and a text of one byte over and over."""
    rows = [(1, BASE * 2), (1, "x" * 20 + BASE * 2), (1, "short"), (None, BASE * 2 + "y"), (3, "a" * 700), (4, PASSAGE), (4, PASSAGE), (5, "�" + PASSAGE[:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = Counter(t.encode()[k : k + 200] for _, t in rows for k in range(len(t.encode()) - 199))
    want = []
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 199):
            if count[raw[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i or 0, len(raw), int(gone.sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    got = suffix_dedup.remove_repeats(df, with_row=True).collect()
    assert sorted((r["id"] or 0, r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(want)
    assert all(r["other"]["doc_id"] == r["id"] for r in got)


def test_long_texts_are_taken_in_parts(monkeypatch):
    """What a long text gives in small parts is what it gives in one."""
    text = " ".join(np.random.default_rng(8).choice(["ab", "cde", "f", "ghij", "é"], 4000)).encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, 700, 700, len(text)])
    one, parts = bytesets.word_hashes(data, offs), []
    for at, part, cuts in bytesets.pieces(data, offs, most=64):
        s, e, _ = bytesets.words(part, cuts)
        parts.append((bytesets.span_hashes(part, s, e, bytesets.LOWER_VALUE), s + at, e + at))
    for k in range(3):
        assert np.array_equal(np.concatenate([p[k] for p in parts]), one[k])
    whole = [np.concatenate([np.stack([b, t]) for b, t in language_id.buckets(data, offs, most)], axis=1) for most in (1 << 20, 50)]
    assert np.array_equal(*[w[:, np.lexsort(w)] for w in whole])
    plain = data[:0].tobytes() + b"q" * 300 + text[:4000] * 2
    raw = np.frombuffer(plain, np.uint8)
    monkeypatch.setattr(suffix_dedup, "SLICE", 100)
    starts = set()
    for base, part, cuts in suffix_dedup._windows(raw, np.array([0, len(raw)]), 200):
        _, _, s, e, _ = suffix_dedup.anchors(part, cuts)
        starts |= {base + k for x, y in zip(s.tolist(), e.tolist(), strict=True) for k in range(x, y - 199)}
    assert starts == set(range(len(raw) - 199))


def test_packing(docs, none):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    tok = tokens.tokenizer(path)
    pieces = packing.pack(docs, path, 64).collect()
    by = {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
    for k, t, *_ in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own, at = sorted(by[k], key=lambda p: p["piece"]), 0
        for p in own:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids) and all(p["length"] == 64 for p in own[1:])
    seq = {}
    for p in pieces:
        seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in seq.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 64
    assert len(seq) <= -(-sum(p["length"] for p in pieces) // 64) * 1.02 + 1
    assert packing.pack(none, path).count() == 0


def test_tokens_round_trip(docs, none):
    import public_tokenizers as P

    path, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    back = tokens.decode(tokens.encode(docs, path, ranks, with_spans=True), ranks, ["id", "n_tokens", "byte_at", "char_at"])
    got = {r["id"]: r for r in back.collect()}
    for k, t, *_ in ROWS:
        assert got[k]["decoded"] == (t or "") and bytes(got[k]["raw"]) == (t or "").encode()
        assert got[k]["byte_at"][-1] == len((t or "").encode()) and got[k]["char_at"][-1] == len(t or "") and len(got[k]["byte_at"]) == got[k]["n_tokens"] + 1
    assert tokens.encode(none, path).count() == 0


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "x"), (1, None, None), (2, "http://b c", ""), (7, "http://d", "x"), (5, "http://e", "é" * 4000), (9, "http://f", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r["id"]: r for r in warc.read(warc.write(df, file_bytes=300)).collect()}
    assert {k: (r["kind"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {3: ("response", None, 1), 1: ("response", None, 0), 2: ("revisit", 1, 0), 7: ("revisit", 3, 1), 5: ("response", None, 8000), 9: ("revisit", 3, 1)}
    assert got[7]["digest"] == warc.digest(b"x") and bytes(got[5]["payload"]) == ("é" * 4000).encode()
    plain = {r["id"]: r["kind"] for r in warc.read(warc.write(df, revisit_from=1)).collect()}
    assert plain[2] == "response" and plain[7] == "revisit"
    assert warc.read(warc.write(df.filter("page_id < 0"))).count() == 0


def test_warc_salvages_an_archive_that_was_damaged(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k} é</p>" * 50 + ("x" * 3_000_000 if k == 4 else "")) for k in range(9)] + [(3, "http://again", "<p>3 é</p>" * 50), (None, "http://none", "<p>3 é</p>" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(df)
    assert sorted((-1 if r["id"] is None else r["id"], r["kind"], r["refers_to"]) for r in warc.read(manifest).filter("digest = '%s'" % warc.digest(("<p>3 é</p>" * 50).encode())).collect()) == [(-1, "revisit", 3), (3, "response", None), (3, "response", None)]
    path = manifest.first()["path"].removeprefix("file://")
    with open(path, "rb") as f:
        raw = bytearray(f.read())
    starts = [m.start() for m in __import__("re").finditer(rb"\x1f\x8b\x08\x00", raw)]
    raw[starts[2] + 60] ^= 0xFF
    with open(path, "wb") as f:
        f.write(raw)
    got = warc.read(manifest).collect()
    (gap,) = [r for r in got if r["kind"] == "quarantined"]
    assert gap["at"] == starts[2] and gap["size"] == starts[3] - starts[2] and gap["problem"]
    assert len(got) == len(rows)


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 12))
    x[100:140] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] + [1.0] * 11), (903, [None] + [1.0] * 11), (904, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("id") % 20 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r["score"] - s[r["id"]]) < 1e-12 for r in own)
        near = u @ u[q]
        near[q] = -9
        hit += len({r["id"] for r in own} & set(np.lexsort((np.arange(900), -np.round(near, 12)))[:5].tolist()))
    assert hit >= 0.9 * 5 * 45
    assert [r["id"] for r in sorted((r for r in got if r["query_id"] == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]
    # a leaf that holds most vectors is dealt to several tasks, to the same end
    same = spark.createDataFrame([(k, (x[100] if k % 3 else x[k]).tolist()) for k in range(900)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    crowd = neighbours.search(same, F.col("id") == 301).collect()
    assert [r["id"] for r in sorted(crowd, key=lambda r: r["rank"])] == [1, 2, 4, 5, 7]
    few = neighbours.search(df.filter("vec_id in (0, 1, 20)"), F.col("id") == 0).collect()
    assert {r["id"] for r in few} == {1, 20}
    assert neighbours.search(df.filter("vec_id < 0"), F.col("id") == 0).count() == 0


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(2)
    words = {"aa": ["the", "of", "and", "thing", "other", "ship"], "bb": ["der", "und", "nicht", "schiff", "zeit", "über"]}
    rows = [(k, " ".join(rng.choice(words[lang], 30)), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, "the other ship and the thing"), (2, "und nicht der zeit über"), (3, None), (4, ""), (5, "12 :-)"), (6, "der " * 9000)], "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("other", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.predict(tests, model).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 7)] == ["aa", "bb", "und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["rejected"] and not got[6]["rejected"]
    assert {r["other"] for r in got.values()} == {1}
    untrained = language_id.fit(none)
    assert {r["rejected"] for r in language_id.predict(tests.filter("doc_id in (1, 6)"), untrained).collect()} == {False}
    assert {r["lang_pred"] for r in language_id.predict(docs, untrained).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(3)
    plain = [f"w{k}" for k in range(200)]
    bad = ["vilea", "vileb", "vilec"]
    rows = []
    for k in range(200):
        t = list(rng.choice(plain, 40))
        if k % 4 == 0:
            t[5], t[20] = rng.choice(bad, 2)
        rows.append((k, " ".join(t), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    tests = spark.createDataFrame([(1, "w1 w2 vilea w3 " * 3), (2, " ".join(plain[:50])), (3, None), (4, ""), (5, "w5 viled w6 vilec")], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in toxicity.score(tests, model).collect()}
    assert got[1] > 0.7 and got[5] > 0.7 and got[2] < 0.3 and got[3] == got[4] and all(0 <= v <= 1 for v in got.values())
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(none, df.select("doc_id", "toxic"))).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_lm_scoring(docs, none):
    train = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) != 1
    got = {r["id"]: r for r in lm_scoring.score(docs, train(F.col("doc_id"))).collect()}
    count, words = Counter(), {}
    for k, t, *_ in ROWS:
        words[k] = [*low(t).split(), None]
        if zlib.crc32(str(k).encode()) % 5 != 1:
            count.update(words[k])
    n, v = sum(count.values()), len(count)
    for k, w in words.items():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert abs(got[k]["base_score"] - base) < 1e-6 * max(1, -base) and got[k]["score"] < 0
    assert lm_scoring.score(none, F.lit(True)).count() == 0


def test_lm_rows_without_ids_of_their_own_and_long_texts(spark):
    rng = np.random.default_rng(0)
    words = [f"v{k}" for k in range(300)]
    rows = [(1, "a rare zebra"), (1, "a rare zebra"), (1, "another text"), (None, "a rare zebra"), (None, "another text")] + [(k, " ".join(rng.choice(words, 30))) for k in range(10, 40)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    count = Counter(x for _, t in rows for x in [*t.split(), None])
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*t.split(), None])
    key = lambda r: (r[0] or 0, r[1], round(r[2], 5))
    assert sorted(key((r["id"], r["n_known"], r["base_score"])) for r in got) == sorted(key((i, len(t.split()) + 1, base(t))) for i, t in rows)
    w = lm_scoring.start()
    ids = [np.append(rng.integers(1, 900, n), 0).astype(np.int16) for n in (3000, 0, 1, 40, 700)] + [np.append(rng.integers(1, 900, 5), 0).astype(np.int16) for _ in range(700)]
    alone = np.array([lm_scoring.log_likelihoods(w, [x])[0] for x in ids[:20]])
    assert np.allclose(lm_scoring.log_likelihoods(w, ids)[:20], alone, rtol=1e-5)


def test_lm_probabilities_sum_to_one_and_gradients_are_right():
    w = lm_scoring.start().astype(np.float32)
    p = lm_scoring.views(w)
    h = np.random.default_rng(0).uniform(-1, 1, (1, lm_scoring.HIDDEN)).astype(np.float32)
    every = np.arange(lm_scoring.SYMBOLS)
    logp, _ = lm_scoring.outputs(p, np.repeat(h, len(every), axis=0), every)
    assert abs(np.exp(logp).sum() - 1) < 1e-4
    ids = [np.array([3, 900, 5, 0], np.int16), np.array([7, 0], np.int16)]
    before = lm_scoring.log_likelihoods(w, ids)
    together = lm_scoring.log_likelihoods(w, ids * 40)
    assert np.allclose(together, np.tile(before, 40), atol=1e-4)
    seen = np.full(len(w), 1e-4, np.float32)
    for _ in range(30):
        lm_scoring.train(w, seen, ids * 20, 0.1)
    assert (lm_scoring.log_likelihoods(w, ids) > before + 3).all()
