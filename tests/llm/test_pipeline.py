"""Each stage of the pipeline against brute force, on the table that the stage before it left."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    words = {"aa": [f"the{k}" for k in range(60)], "bb": [f"und{k}ü" for k in range(60)]}
    prose = lambda lang, n: " ".join(rng.choice(words[lang], n))
    passage = prose("aa", 70)
    rows = []
    for k in range(90):
        lang = ("aa", "bb")[k % 2]
        t = prose(lang, int(rng.integers(20, 120)))
        if k in (10, 20, 30):
            t = "� " + prose("aa", 30) + " " + passage + " ü" + prose("aa", 30)
        if k == 40:
            t = prose("bb", 9000)
        rows.append((k, t, lang))
    rows += [(100, rows[5][1].upper(), "bb"), (101, rows[5][1], None), (102, rows[6][1] + " end", "aa"), (103, rows[7][1] + " end", None), (103, rows[7][1] + " end", None)]
    rows += [(110, None, "aa"), (111, "", "aa"), (112, " 12 :-) ", None), (113, rows[8][1], "aa"), (113, prose("bb", 40), "bb"), (None, rows[9][1], "bb")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]


def key(r):
    return (r["doc_id"], r["text"])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    docs = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    docs.write.parquet(path + "/documents.parquet")
    out = [spark.read.parquet(path + "/documents.parquet")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], path).write.parquet(f"{path}/{k}")
        out.append(spark.read.parquet(f"{path}/{k}"))
    return path, [sorted(t.collect(), key=str) for t in out[:-1]], out[-1].collect()


def test_language_keeps_clean_documents(tables):
    before, after = tables[1][0], tables[1][1]
    gone = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
    assert len(after) >= 0.97 * len(gone) and {key(r) for r in after} <= {key(r) for r in gone}


def test_copies_go_but_the_largest_id(tables):
    before, after = tables[1][1], tables[1][2]
    best = {}
    for r in before:
        if r["doc_id"] is not None:
            best[r["text"].encode().lower()] = max(best.get(r["text"].encode().lower(), -1), r["doc_id"])
    assert Counter(map(key, after)) == Counter(key(r) for r in before if r["doc_id"] is not None and best[r["text"].encode().lower()] == r["doc_id"])


def test_one_of_each_group_of_near_copies_stays(tables):
    before, after = tables[1][2], tables[1][3]
    sets = {}
    for r in before:
        w = r["text"].encode().lower().split()
        sets.setdefault(r["doc_id"], set()).update([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or [tuple(w)])
    top = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and top[a] != top[b] and 100 * len(x & y) >= 80 * len(x | y):
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = {k: new if v == old else v for k, v in top.items()}
    twice = {i for i, n in Counter(r["doc_id"] for r in {key(r): r for r in before}.values()).items() if n > 1}
    assert Counter(key(r) for r in after if r["doc_id"] not in twice) == Counter(key(r) for r in before if top[r["doc_id"]] == r["doc_id"] and r["doc_id"] not in twice)


def test_repeats_are_cut(tables):
    before, after = tables[1][3], tables[1][4]
    count = Counter()
    for r in before:
        raw = r["text"].encode()
        count.update(raw[k : k + 200] for k in range(len(raw) - 199))
    want = []
    for r in before:
        raw = r["text"].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 199):
            if count[raw[k : k + 200]] > 1:
                gone[k : k + 200] = True
        text = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        want.append((r["doc_id"], text, r["lang"], "s", len(text)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in after)
    assert any("�" in r["text"] for r in after)


def test_every_token_is_packed_once(tables):
    import public_tokenizers as P

    from castclip.llm.tokens import tokenizer

    tok = tokenizer(P.path("byte_bpe_50k.json"))
    after, pieces = tables[1][4], tables[2]
    total = Counter()
    for r in after:
        total[r["doc_id"]] += len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
    got, held = Counter(), {}
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        held.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == total
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024


def test_run_is_the_stages_and_an_empty_table_passes(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables[0]).count() == len(tables[2])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
