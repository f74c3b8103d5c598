"""The filter audit against a plain recount of every order and step."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from castclip.llm import bytesets, filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "漢字", "W", "Über"]
    out = [None, "", " \n", "one", "One", "one", "#", "ABC", "AB" * 20, "é" * 300, "x" * 900, " y" * 250, "a" * 70 + " " + "a" * 70 + " " + "a" * 69 + "b", "\x0bword\x0cword\x85word"]
    out += [" ".join(rng.choices(vocabulary, k=rng.choice((20, 199, 200, 201, 500)))) + rng.choice(("", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3)) for _ in range(40)]
    return out + out[14:22] + [" ".join(rng.choices(vocabulary[:60], k=300))] * 3 + [None]


def fails(t):
    w = WORDS.findall(t)
    return ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")


def plain(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    first, sets = {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    for i, t, part in rows:
        sets.append((part or "", fails(t or "") + ("E" if i is not None and i > first[t or ""] else ""), i is not None and i in good, i is not None and i in toxic))
    out = {}
    shapley = {}
    for order in map("".join, permutations("ABCDE")):
        for k, f in enumerate(order):
            done = set(order[:k])
            for part in {p for p, *_ in sets}:
                row = [0] * 6
                for p, own, g, x in sets:
                    if p == part:
                        hit, gone = f in own, bool(done & set(own))
                        row[0] += not hit and not gone
                        row[1] += hit and not gone
                        row[2] += hit and gone
                        row[3] += own == f
                        row[4] += hit and not gone and g
                        row[5] += hit and not gone and x
                out[part, order, k + 1] = row
                shapley[part, f] = shapley.get((part, f), 0) + row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_every_order_and_step(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(("a", "b", "", None))) for k, t in enumerate(texts())]
    rows += [(3, "one", "b"), (3, "one", "a"), (5, "another", "c"), (None, "one", "a"), (None, "alone", "d"), (None, None, "a"), (9, rows[20][1], "c")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, part string, fails int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    want = plain(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got} == want
    assert len(got) == len(want) == 600 * 5
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


@pytest.mark.parametrize("size", [bytesets.SLICE, 37, 9, 3])
@pytest.mark.parametrize("collide", [False, True])
def test_the_pass_counts_what_patterns_count(monkeypatch, size, collide):
    """In parts of any size, and if all words have one hash."""
    monkeypatch.setattr(filter_audit, "SLICE", size)
    if collide:
        monkeypatch.setattr(filter_audit, "span_hashes", lambda d, s, e: np.zeros(len(s), dtype=np.uint64))
    some = texts()[:22] if collide or size < 100 else texts()
    data, offs = bytesets.flat(pa.array(some))
    got = filter_audit.transduce(data, offs)
    for k, t in enumerate(x or "" for x in some):
        w = WORDS.findall(t)
        assert [int(got[c][k]) for c in ("words", "distinct", "capitals", "points", "symbols")] == [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))]


def test_a_hot_text_and_a_missing_id_are_shared_among_tasks(spark):
    """Rows of one text, and rows without an id, are counted by more than that key before they meet."""
    n = 4000
    docs = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source"))
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    step = filter_audit.audit(docs, marks).filter("filter_order = 'EABCD' AND step = 1").collect()
    copies = len([k for k in range(n) if k % 3 > 0 and k % 2 == 0])
    assert [(r["removed"], r["kept"]) for r in step] == [(copies - 1, n - copies + 1)]
