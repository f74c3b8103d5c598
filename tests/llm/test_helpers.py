"""Rules of the helpers against plain restatements; no Spark."""

import io
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from castclip.llm import bytesets, exact_dedup, packing, suffix_dedup, tokens, warc

texts = st.lists(st.text(alphabet="aAbB é\n\t.", max_size=40), max_size=8)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words_are_split_at_ascii_white_space(some):
    got = []
    for lo, _, data, offs in bytesets.slices(pa.array(some, pa.string()), 16):
        s, e, doc = bytesets.words(data, offs)
        got += [(int(d) + lo, data[a:b].tobytes()) for a, b, d in zip(s, e, doc, strict=True)]
    assert got == [(k, w) for k, t in enumerate(some) for w in t.encode().split()]


@given(texts)
@settings(max_examples=60, deadline=None)
def test_shingle_sets_have_the_right_sizes(some):
    sizes = []
    for t in some:
        w = t.encode().lower().split()
        sizes.append(len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w)))
    assert [len(s) for s in bytesets.shingle_sets(pa.array(some, pa.string()))] == sizes


@given(st.binary(max_size=300), st.integers(0, 300))
@settings(max_examples=60, deadline=None)
def test_fingerprints_of_parts_combine(raw, cut):
    whole, at = np.frombuffer(raw, np.uint8), min(cut, len(raw))
    one = lambda x: exact_dedup.fingerprints(x, np.array([0, len(x)]))[0]
    assert exact_dedup.combine(one(whole[:at]), one(whole[at:])) == one(whole)


def test_long_texts_hash_by_chunks():
    raw = np.frombuffer(bytes(range(256)) * 700, np.uint8)
    assert len(raw) > 2 * exact_dedup.CHUNK
    h = [0, 0]
    for b in raw.tolist():
        h = [(x * r + b + 1) % p for x, r, p in zip(h, exact_dedup.RADIX, exact_dedup.PRIMES, strict=True)]
    assert exact_dedup.fingerprints(raw, np.array([0, len(raw)]))[0] == (h[0], h[1], len(raw))


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
@settings(max_examples=80, deadline=None)
def test_two_stage_sorting_gives_the_suffix_array(values):
    t = np.array([*values, 0])
    x = t.tolist()
    assert suffix_dedup.suffix_order(t, len(x) + 8).tolist() == sorted(range(len(x)), key=lambda k: x[k:])


def test_packing_places_every_piece_once():
    rng = np.random.default_rng(0)
    for cap in (8, 31, 100):
        have = Counter(rng.integers(1, cap + 1, 500).tolist())
        groups = packing.plan(dict(have), cap)
        assert all(sum(n * m for n, m in held.items()) <= cap for held, _ in groups)
        assert sum((Counter({n: m * times for n, m in held.items()}) for held, times in groups), Counter()) == have
        total = sum(n * c for n, c in have.items())
        assert sum(times for _, times in groups) <= -(-total // cap) * 1.05 + 1


def test_packing_takes_exact_complements():
    assert sorted(tuple(sorted(h.elements() if isinstance(h, Counter) else Counter(h).elements())) for h, _ in packing.plan({7: 1, 3: 1, 6: 1, 2: 2}, 10)) == [(2, 2, 6), (3, 7)]


def _archive(zipped=True):
    raw = [warc.record(k, f"http://h/{k}", f"<p>é {k}</p>".encode() * 40, warc.digest(f"<p>é {k}</p>".encode() * 40), None) for k in range(6)]
    return [warc.member(r) if zipped else r for r in raw]


def test_salvage_reads_what_is_whole_and_logs_the_gap():
    for zipped in (True, False):
        parts = _archive(zipped)
        assert [r[3] for r in warc.salvage(io.BytesIO(b"".join(parts)))] == list(range(6))
        hurt = bytearray(parts[2])
        hurt[len(hurt) // 2] ^= 0xFF
        rows = list(warc.salvage(io.BytesIO(b"".join([*parts[:2], bytes(hurt), *parts[3:]]))))
        assert [r[3] for r in rows if r[5] == "response"] == [0, 1, 3, 4, 5]
        (gap,) = [r for r in rows if r[5] == "quarantined"]
        assert (gap[1], gap[2]) == (len(parts[0]) + len(parts[1]), len(parts[2]))
        cut = list(warc.salvage(io.BytesIO(b"".join(parts)[:-30])))
        assert [r[3] for r in cut if r[5] == "response"] == [0, 1, 2, 3, 4] and cut[-1][5] == "quarantined"


def test_revisit_keeps_digest_and_length():
    raw = warc.record(9, "u", b"abc", warc.digest(b"abc"), 4)
    row = warc.parse(raw)
    assert row[3] == 9 and row[5:9] == ("revisit", 4, warc.digest(b"abc"), 3)


def test_encoder_equals_the_rank_library():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = ["", " ", "a  b", "\n\n x\ty \n", "it's we'll I'D", "naïve café 日本語 🙂🙂", "x y z\x1cw\x85q", "<|endoftext|> end", "tail  ", " \n lead", "a" * 3000, "﻿bom 123abc!!"]
    enc = tokens.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    table = tokens.id_bytes(P.path("byte_bpe_50k.tiktoken"))
    for _ in range(2):
        for t, raw in zip(some, enc.ids(some), strict=True):
            ids = np.frombuffer(raw, "<u4")
            assert ids.tolist() == own.encode_ordinary(t)
            assert tokens.decode_bytes(ids, table) == t.encode()


def test_encoder_takes_each_word_to_the_tokenizer_once():
    import public_tokenizers as P

    class Counting:
        def __init__(self, tok):
            self.tok, self.characters = tok, 0

        def encode_batch_fast(self, texts, **options):
            self.characters += sum(map(len, texts))
            return self.tok.encode_batch_fast(texts, **options)

    words = [f"{a}{b}thonre" for a in "abcdefgé" for b in "stuvwxyzñ"]
    ends = ["", ".", ",", "...", "$$$,", ".\nThe", ".\nÉtat,"]
    enc = tokens.Encoder(P.path("byte_bpe_50k.json"))
    plain = enc.tok
    enc.tok = Counting(plain)
    for k in range(len(ends)):  # each word with each end, in different texts
        some = [" ".join(w + ends[(i + k) % len(ends)] for i, w in enumerate(words)) + " it's"]
        assert np.frombuffer(enc.ids(some)[0], "<u4").tolist() == plain.encode(some[0], add_special_tokens=False).ids
    assert enc.tok.characters < 2 * sum(len(w) + 1 for w in words)


@given(st.lists(st.lists(st.sampled_from(["the", "Éa", "ª", "×", "日本", "12", "'s", "’", ".", ",", "$$$", "_", "\n", "\r\n", "\t", "\x85", "\xa0", "\x1c", " ", " ", " ", "  ", ".\nThe", "a" * 60, "." * 60, "\0"]), max_size=12).map("".join), max_size=8), st.sampled_from([3, 30, 1000]))
@settings(max_examples=150, deadline=None)
def test_encoder_with_small_tables_equals_the_tokenizer(some, kept):
    import public_tokenizers as P

    enc = tokens.Encoder(P.path("byte_bpe_50k.json"), kept=kept)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(some)] == [e.ids for e in enc.tok.encode_batch(some, add_special_tokens=False)]


def test_spans_and_split_characters():
    import public_tokenizers as P

    enc = tokens.Encoder(P.path("byte_bpe_50k.json"))
    text = "été 🙂"
    ids, at, char = enc.spans(text)
    assert at[-1] == len(text.encode()) and char[-1] == len(text) and len(at) == len(ids) + 1
    table = tokens.id_bytes(P.path("byte_bpe_50k.json"))
    assert "".join(tokens.decode_stream(table[i] for i in ids.tolist())) == text
