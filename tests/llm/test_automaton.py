"""The tokenization automaton against plain merging, and against the library on small tables."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from castclip.llm import automaton, queries

PATH = P.path("byte_bpe_50k.json")


def merged(word, merges):
    """Tokens of a word by its merges, one rank after another, from left to right."""
    t = list(word)
    for u, v, w in merges:
        k, out = 0, []
        while k < len(t):
            if t[k : k + 2] == [u, v]:
                out.append(w)
                k += 2
            else:
                out.append(t[k])
                k += 1
        t = out
    return t


def small(seed, n=14):
    """Labels and merges over three letters, each pair of tokens that a text has side by side."""
    rng = random.Random(seed)
    labels, merges = [bytes([b]) for b in range(256)], []
    while len(merges) < n:
        word = [rng.choice((97, 98, 99)) for _ in range(30)]
        t = merged(word, merges)
        k = rng.randrange(len(t) - 1) if len(t) > 1 else None
        if k is not None and (new := labels[t[k]] + labels[t[k + 1]]) not in labels and len(new) < 9:
            merges.append((t[k], t[k + 1], len(labels)))
            labels.append(new)
    return labels, merges


@pytest.mark.parametrize("seed", range(12))
def test_the_automaton_gives_what_merging_gives(seed):
    labels, merges = small(seed)
    auto = automaton.Automaton(labels, merges)
    rng = random.Random(seed + 100)
    words = [bytes(rng.choices(b"aabc", k=rng.randrange(0, 24))) for _ in range(200)]
    words += [b"a" * 300, bytes(rng.choices(b"abc", k=automaton.LONG + 40)), b""]
    for w, got in zip(words, auto.words(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == merged(list(w), merges)


@pytest.mark.parametrize("seed", range(4))
def test_it_accepts_no_other_tokens(seed):
    labels, merges = small(seed)
    auto = automaton.Automaton(labels, merges)
    rng = random.Random(seed)
    some = [i for i in range(len(labels)) if i >= 256 or i in (97, 98, 99)]
    for _ in range(2000):
        path = rng.choices(some, k=rng.randrange(1, 4))
        q = np.array([auto.start])
        for t in path:
            q = auto.steps(q, np.array([t]))
            if q[0] < 0:
                break
        assert (q[0] >= 0) == (merged(list(b"".join(labels[t] for t in path)), merges) == path)


def test_what_cannot_be_compiled_is_refused():
    with pytest.raises(ValueError):
        automaton.Automaton([b"a", b"b", b"ab"], [(0, 1, 2)])
    with pytest.raises(ValueError):
        automaton.Tokenizer(P.path("word_bpe_49k.json"))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    signs = [chr(rng.randrange(32, 127)) for _ in range(50)] + list("     \n\té漢字ا😀thes") + ["<|endoftext|>", "'s", "՘", "࢏", "́", "\x85", "\x1c", "　", "\0"]
    out = [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  <|endoftext|>\n", "'ll it's", "x" * 2000, " " * 700, "é" * 600, "亜" * 400, "\n\n  \n end", "one two", "one two"]
    return out + ["".join(rng.choices(signs, k=rng.randrange(0, 300))) for _ in range(300)]


def test_encode_and_decode_are_the_library(spark):
    lib, rows = library(), list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, -k, "n") for k, t in rows], "doc_id long, text string, id long, n_tokens string").repartition(3)
    ids = automaton.encode(df, PATH)
    got = {r["id"]: r for r in automaton.decode(ids, PATH, ["id", "n_tokens", "ids"]).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[k]["ids"], got[k]["n_tokens"], got[k]["decoded"]) == (want, len(want), lib.decode(want, skip_special_tokens=False))
    assert automaton.encode(df.limit(0), PATH).count() == 0


def test_decode_shows_split_characters_and_skips_strange_ids(spark):
    lib = library()
    split = lib.encode("漢", add_special_tokens=False).ids
    rows = [(1, split[:1]), (2, split), (3, []), (4, None), (5, [*lib.encode("a b").ids, 10**8, -5]), (5, [50256])]
    got = sorted((r["k"], r["decoded"]) for r in automaton.decode(spark.createDataFrame(rows, "k int, ids array<int>"), PATH, ["k"]).collect())
    assert got == [(1, lib.decode(split[:1])), (2, "漢"), (3, ""), (4, ""), (5, "<|endoftext|>"), (5, "a b")]


def test_the_bound_of_remembered_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(automaton, "KEPT", 5)
    monkeypatch.setattr(automaton, "PIECES", 3)
    tok, lib = automaton.Tokenizer(PATH), library()
    own = [t or "" for t in texts()[:60]]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(own)] == [lib.encode(t, add_special_tokens=False).ids for t in own]


def test_the_query_takes_whole_texts(spark, tmp_path):
    lib, rows = library(), list(enumerate(texts()[:40]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_bpe_automaton(spark, str(tmp_path)).collect()}
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
