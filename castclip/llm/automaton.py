"""Byte-level BPE by a tokenization automaton: merges compiled into a deterministic automaton over tokens.

The automaton begins with one state in which every byte is an arc. Each merge (u, v), in order of rank, is a gadget: arcs
labelled u lead to a copy of their state from which the arc v is taken out, and a new arc uv, beside u, leads where v led. What it accepts
in the end are exactly the token sequences that the merges give, one for each string. All arcs of one label lead to
one state, so transitions are three tables: the label's target, what a state's gadgets took out (with the rank at
which), and each label's left part, whose arc it was made from. An arc is there unless it, or the left part that stood
for it at that rank, was taken out.

A word is encoded by running the automaton over the lattice of tokens that a byte trie finds in it: every position is reached by one
token only, and the path back from the end emits the ids. Decoding emits the arcs' labels. Texts are split into
words first, special tokens apart, as the tokenizer's file says.

Cases: null texts count as empty; an empty text has no ids; ids that label no arc decode to nothing; bytes that
aren't UTF-8 decode to U+FFFD; ids and texts may repeat; other columns aren't read; an empty table gives no rows. Very
long texts are split and encoded in parts of PIECES words.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import flat
from .tokens import byte_characters, grouped

LONG = 256  # bytes of a word from which it is run alone
RUN = 1 << 18  # bytes of words that are run side by side
PIECES = 200_000  # words of a text that are looked up at once
KEPT, KEPT_SIZE = 120_000, 48  # words whose ids a worker remembers, and the bytes of the longest
IDS = 1 << 19  # ids that are decoded together, whole texts
NEVER = np.iinfo(np.int32).max


class Pairs:
    """Table from pairs of numbers, given as one 64-bit key, to numbers of 32 bits: open addressing, filled and read for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self.first(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            done = self.keys[slot] == keys[left]
            self.values[slot[done]] = values[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & self.mask

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slot = self.first(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[at]
            found = held == keys[left]
            out[left[found]] = self.values[at[found]]
            left = left[~found & (held >= 0)]
        return out

    def one(self, key: int) -> int:
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (held := self.keys.item(slot)) != key:
            if held < 0:
                return -1
            slot = (slot + 1) & self.mask
        return self.values.item(slot)


class Automaton:
    """labels: the bytes of each id; merges: pairs of ids and the id that they make, by rank."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        n = len(labels)
        self.labels, self.size = labels, np.array([len(x) for x in labels], dtype=np.int64)
        single = {x: i for i, x in enumerate(labels) if len(x) == 1}
        if len(single) < 256 or len({w for _, _, w in merges}) < len(merges):
            raise ValueError("an automaton needs a token for each byte, and one merge for each other token")
        left, made, state = [-1] * n, [-1] * n, [-1] * n
        for i in single.values():
            state[i] = 0
        parent, lost, since = [-1], [-1], [-1]
        for rank, (u, v, w) in enumerate(merges):
            if state[u] < 0 or state[v] < 0 or not self._arc(state[u], v, parent, lost, since, left, made):
                continue  # u and v never stand side by side
            left[w], made[w], state[w] = u, rank, state[v]
            parent.append(state[u]), lost.append(v), since.append(rank)
            state[u] = len(parent) - 1
        final = sorted({s for s in state if s >= 0})
        keys, ranks = [], []
        for new, s in enumerate(final):
            while s > 0:
                keys.append(new * n + lost[s]), ranks.append(since[s])
                s = parent[s]
        number = {s: k for k, s in enumerate(final)}
        self.start = len(final)  # a state like the first one, from which nothing was taken out
        self.states = len(final) + 1
        self.target = np.array([number.get(s, -1) for s in state], dtype=np.int64)
        self.gone = Pairs(np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32))
        self.left, self.made = np.array(left, dtype=np.int64), np.array(made, dtype=np.int64)
        self._spell([i for i in range(n) if state[i] >= 0])

    @staticmethod
    def _arc(q: int, t: int, parent: list, lost: list, since: list, left: list, made: list) -> bool:
        """Whether state q has an arc t, while the automaton is being made."""
        until, end = {}, NEVER
        while t >= 0:
            until[t] = end
            end, t = made[t], left[t]
        while q > 0:
            if since[q] <= until.get(lost[q], -1):
                return False
            q = parent[q]
        return True

    def _spell(self, ids: list[int]) -> None:
        """The byte trie of the labels, level by level."""
        edges: dict[int, int] = {}
        ends = [-1]
        for i in ids:
            node = 0
            for b in self.labels[i]:
                key = node << 8 | b
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, dtype=np.int64)
        self.edges = Pairs(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))

    def steps(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """States that arcs t lead to from states q, -1 where there is no such arc."""
        out = self.target[t]
        at, x, until = np.arange(len(q)), t, np.full(len(q), NEVER, dtype=np.int64)
        n = len(self.labels)
        while len(at):
            cut = self.gone.get(q[at] * n + x)
            there = (cut < 0) | (cut > until)
            out[at[~there]] = -1
            more = there & (self.left[x] >= 0)
            at, x, until = at[more], self.left[x[more]], self.made[x[more]]
        return out

    def tokens_in(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and id of every token that stands anywhere in the bytes; end: of the word that each byte belongs to."""
        at = np.arange(len(data))
        node = np.zeros(len(data), dtype=np.int64)
        places, ids, k = [], [], 0
        while len(at):
            node = self.edges.get(node << 8 | data[at + k]).astype(np.int64)
            live = node > 0
            at, node = at[live], node[live]
            token = self.ends[node]
            places.append(at[token >= 0]), ids.append(token[token >= 0])
            k += 1
            live = at + k < end[at]
            at, node = at[live], node[live]
        return (np.concatenate(places), np.concatenate(ids)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. data: bytes of all words, offs: where they begin, and the end."""
        size = np.diff(offs)
        word = np.repeat(np.arange(len(size)), size)
        at, token = self.tokens_in(data, offs[1:][word])
        by = np.argsort(at - offs[word[at]], kind="stable")  # all words side by side, from their first byte on
        at, token = at[by], token[by]
        begin = np.searchsorted(at - offs[word[at]], np.arange(int(size.max(initial=0)) + 1))
        first = offs[:-1] + np.arange(len(size))  # each word has a place more than bytes
        place = at + word[at]
        state, last = np.full(len(data) + len(size), -1, dtype=np.int64), np.full(len(data) + len(size), -1, dtype=np.int64)
        state[first] = self.start
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            to = self.steps(state[place[a:b]], token[a:b])
            ok = np.flatnonzero(to >= 0)
            reached = place[a:b][ok] + self.size[token[a:b][ok]]
            state[reached], last[reached] = to[ok], token[a:b][ok]
        used = np.zeros(len(state), dtype=bool)
        back, stop = (first + size)[size > 0], first[size > 0]
        while len(back):
            used[back] = True
            back = back - self.size[last[back]]
            back, stop = back[back > stop], stop[back > stop]
        many = np.concatenate([[0], np.cumsum(used)])
        return last[used], np.diff(np.append(many[first], many[-1]))

    def run_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long word, place by place."""
        at, token = self.tokens_in(data, np.full(len(data), len(data)))
        by = np.argsort(at, kind="stable")
        begin, token = np.searchsorted(at[by], np.arange(len(data) + 1)).tolist(), token[by].tolist()
        n, gone, left, made, target = len(self.labels), self.gone.one, self.left.item, self.made.item, self.target.item
        state, last = [-1] * (len(data) + 1), [-1] * (len(data) + 1)
        state[0] = self.start
        for k in range(len(data)):
            row = state[k] * n
            for t in token[begin[k] : begin[k + 1]]:
                x, until = t, NEVER
                while x >= 0 and not 0 <= gone(row + x) <= until:
                    x, until = left(x), made(x)
                if x < 0:
                    to = k + len(self.labels[t])
                    state[to], last[to] = target(t), t
        out, k = [], len(data)
        while k:
            out.append(last[k])
            k -= len(self.labels[last[k]])
        return np.array(out[::-1], dtype=np.int64)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        for k in (k for k, w in enumerate(words) if len(w) >= LONG):
            out[k] = self.run_long(np.frombuffer(words[k], dtype=np.uint8)).astype("<u4").tobytes()
        short = [k for k, w in enumerate(words) if len(w) < LONG]
        runs = np.cumsum([len(words[k]) for k in short]) // RUN
        for some in np.split(np.array(short, dtype=np.int64), np.flatnonzero(np.diff(runs)) + 1):
            own = some.tolist()
            data = np.frombuffer(b"".join(words[k] for k in own), dtype=np.uint8)
            ids, many = self.run(data, np.cumsum([0, *(len(words[k]) for k in own)]))
            raw, cut = ids.astype("<u4").tobytes(), (4 * np.cumsum([0, *many.tolist()])).tolist()
            for k, a, b in zip(own, cut[:-1], cut[1:], strict=True):
                out[k] = raw[a:b]
        return out


def told(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """The labels of the ids, merges (ids of both parts and of what they make) and special tokens that the file of a tokenizer names."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, model = said["pre_tokenizer"] or {}, said["model"]
    plain = not any(a[k] for a in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or said["normalizer"] or model.get("ignore_merges") or model.get("dropout") or not plain:
        raise ValueError(f"{path}: only byte-level BPE with plain special tokens and without a normalizer can be compiled")
    back = {c: b for b, c in byte_characters().items()}
    vocab: dict[str, int] = model["vocab"]
    special = {a["content"]: a["id"] for a in said["added_tokens"]}
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for word, i in vocab.items():
        labels[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], special


@lru_cache(maxsize=2)
def names(path: str) -> list[bytes]:
    """What each id decodes to."""
    labels, _, special = told(path)
    for c, i in special.items():
        labels[i] = c.encode()
    return labels


class Tokenizer:
    """What the file of a byte-level BPE tokenizer says, with the merges compiled. Its words are those of the library's own split: texts with
    characters that the pattern's Unicode tables and the library's class differently are split by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        labels, merges, special = told(path)
        self.automaton = Automaton([b"" if i in special.values() else x for i, x in enumerate(labels)], merges)
        self.special = {c: np.array([i], dtype="<u4").tobytes() for c, i in special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(special, key=len, reverse=True)) + ")") if special else None
        import public_tokenizers as P

        self.pattern = regex.compile(P.PATTERN)
        self.library = Library.from_file(path).pre_tokenizer
        self.kind = [regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
        self.known: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()
        self.ids: dict[str, bytes] = {}

    def _settled(self, text: str) -> bool:
        """Whether library and pattern class all characters of the text alike."""
        if text.isascii():
            return True
        own = set(text)
        for c in own - self.known:
            joins = [len(self.library.pre_tokenize_str(x + c)) == 1 for x in ("a", "1", "!")]
            if joins[:2] != [bool(k.match(c)) for k in self.kind[:2]] or joins[2] == (any(joins[:2]) or bool(self.kind[2].match(c))):
                self.odd.add(c)
            self.known.add(c)
        return own.isdisjoint(self.odd)

    def split(self, text: str) -> Iterator[list[str]]:
        """Words of a text, some at a time; special tokens stand alone."""
        parts = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [part]
            elif not self._settled(part):
                yield [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
            elif len(part) < 4 * PIECES:
                yield self.pattern.findall(part)
            else:
                found = (m.group() for m in self.pattern.finditer(part))
                while some := list(islice(found, PIECES)):
                    yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for some in self.split(text):
                held.append((k, some))
                size += len(some)
                if size >= PIECES:
                    self._look_up(held, out)
                    held, size = [], 0
        self._look_up(held, out)
        return [b"".join(x) for x in out]

    def _look_up(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        own: set[str] = set().union(*(words for _, words in held))
        new = list(own.difference(self.ids).difference(self.special))
        self.ids.update(zip(new, self.automaton.words([w.encode() for w in new]), strict=True))
        ids = self.ids.__getitem__
        for k, words in held:
            out[k].append(self.special[words[0]] if len(words) == 1 and words[0] in self.special else b"".join(map(ids, words)))
        for w in new:
            if len(w) > KEPT_SIZE:
                del self.ids[w]
        if len(self.ids) > KEPT:  # what came first stays, being most frequent
            self.ids = dict(islice(self.ids.items(), KEPT // 2))


@lru_cache(maxsize=2)
def compiled(path: str) -> Tokenizer:
    """One for all tasks of a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids of every row, in order of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = compiled(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in grouped(texts):
                raw = tok.encode(texts[lo:hi])
                size = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), ids], names=["id", "n_tokens", "ids"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids array<int>")


def decode(df: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and decoded, the text of the ids' labels."""
    src = df.select(*keep, F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*names(path), b""], pa.large_binary())
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column(len(keep))), 0).to_numpy()
            ends = np.flatnonzero(np.diff(np.cumsum(size) // IDS, append=-1)) + 1  # of runs of rows
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                part = b.slice(lo, hi - lo)
                ids = part.column(len(keep)).flatten().fill_null(-1).to_numpy()
                data, at = flat(table.take(pa.array(np.where((ids >= 0) & (ids < len(table) - 1), ids, len(table) - 1).astype(np.int32))))
                cut = at[np.concatenate([[0], np.cumsum(size[lo:hi])])]
                raw = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
                try:
                    text = raw.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:  # some text has split characters
                    text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], text], names=[*keep, "decoded"])

    return src.mapInArrow(run, kind)
