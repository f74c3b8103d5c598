"""Byte-level BPE over Arrow batches with the tokenizers library.

``encode`` returns ids, and on request each token's byte and character span; ``decode`` turns ids back
into bytes, and into text that shows U+FFFD for bytes of split characters (or keeps them for the next piece,
``decode_stream``). A text is cut where white space follows other characters, places no pre-token ever
crosses, and the ids of each such segment are kept in a bounded table: a segment is encoded once per task. New
segments of letters and punctuation are put together from the ids of their parts, which tables keep too, so a
word is encoded once, whatever follows it.

Cases: null texts count as empty; an empty text has no ids; ids outside the vocabulary decode to nothing;
text that looks like a special token is ordinary text; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import flat

#: Unicode White_Space, as the pattern's \s has it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = frozenset(re.findall(f"[{SPACES}]", "".join(map(chr, range(0x3001)))))
SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Letters that every version of Unicode has as such, and punctuation but the apostrophe: no pre-token crosses from the first to the second.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-&(-/:-@\\[-`{-~"
#: Pieces, with a space after each: word, punctuation, word of the next line and its punctuation, or another piece as a whole.
PARTS = re.compile(f"(?:([{LETTERS}]++)([{MARKS}]*+)(?:\n([{LETTERS}]++)([{MARKS}]*+))?+|([^ ]++)) ")
KEPT, KEPT_SIZE = 150_000, 48  # pieces that are kept, and the characters of the longest of them


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next free one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    table = {b: chr(b) for b in plain}
    free = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(free)
            free += 1
    return table


@lru_cache(maxsize=4)
def encoder(path: str, ranks: str | None = None, kept: int = KEPT) -> Encoder:
    """One for all tasks of a worker process; it keeps the ids of about ``kept`` pieces of text."""
    return Encoder(path, ranks, kept)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation(), t.no_padding()
    return t


@lru_cache(maxsize=4)
def id_bytes(path: str) -> list[bytes]:
    """Bytes of each id, from a vocabulary of byte characters (.json) or from ranks (.tiktoken)."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        return [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    back = {c: b for b, c in byte_characters().items()}
    vocab = tokenizer(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        out[i] = bytes(back[c] for c in word) if all(c in back for c in word) else word.encode()
    return out


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers in bytes, numbered as in ``ranks`` if that is given.

    A text without white space before a space, or at its end, is split at its spaces, and pieces are known by what follows the space;
    other texts are cut by SEGMENT."""

    def __init__(self, path: str, ranks: str | None = None, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.kept = kept
        self.tok = tokenizer(path)
        self.spaced: dict[str, bytes] = {}  # pieces, with the space before them
        self.words: dict[str, bytes] = {"": b""}  # words, with the space before them
        self.lines: dict[str, bytes] = {"": b""}  # words, with the line feed before them
        self.plain: dict[str, bytes] = {"": b""}
        self.size = np.array([len(b) for b in id_bytes(path)], dtype=np.int64)
        self.new = None
        if ranks:
            own, wanted = id_bytes(path), {b: i for i, b in enumerate(id_bytes(ranks))}
            new = np.array([wanted.get(b, -1) for b in own], dtype=np.int64)
            if not np.array_equal(new[new >= 0], np.arange(len(own))[new >= 0]):
                self.new = new

    def _own(self, ids: np.ndarray) -> np.ndarray:
        return ids if self.new is None else self.new[ids]

    def _joined(self, pieces: list[str], before: str) -> dict[str, bytes]:
        """Ids of many pieces, encoded as one text, which the tokenizer cuts before each piece's space or line feed."""
        out = {}
        runs = [pieces[k : k + 2000] for k in range(0, len(pieces), 2000)]
        for run, e in zip(runs, self.tok.encode_batch_fast([before + before.join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.int64)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, run)), np.int64, len(run)) + 1)
            cut = ((np.searchsorted(np.cumsum(self.size[ids]), ends) + 1) * 4).tolist()
            raw = self._own(ids).astype("<u4").tobytes()
            out.update(zip(run, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
        return out

    def _alone(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.plain))
        for s, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.plain[s] = self._own(np.array(e.ids, dtype=np.int64)).astype("<u4").tobytes()

    def _learned(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the table lacks, put together from those of their parts."""
        parts: tuple[list[str], ...] = ([], [], [], [], [])
        for k in range(0, len(pieces), 500):  # few rows at once, or Python's collector goes through them again and again
            for own, more in zip(parts, zip(*PARTS.findall(" ".join(pieces[k : k + 500]) + " "), strict=True), strict=True):
                own.extend(more)
        word, mark, line, last, other = parts
        marks = {*mark, *last}
        self._alone(marks)
        for table, own, before in ((self.words, set(word), " "), (self.lines, set(line), "\n")):
            table.update(self._joined(list(own.difference(table)), before))
        rest = self._joined(list(set(other) - {""}), " ") | {"": b""}
        words, lines, plain = self.words.__getitem__, self.lines.__getitem__, self.plain.__getitem__
        out = list(map(b"".join, zip(map(words, word), map(plain, mark), map(lines, line), map(plain, last), map(rest.__getitem__, other), strict=True)))
        for table in (self.words, self.lines, self.plain):
            for s in [s for s in (marks if table is self.plain else {*word, *line}) if len(s) > KEPT_SIZE]:
                table.pop(s, None)
        self.words, self.lines = (t if len(t) <= self.kept * 2 // 3 else dict(islice(t.items(), self.kept // 3)) for t in (self.words, self.lines))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        begin, at, pieces = cut.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = [pieces[k] for k in at[begin[:-1]].tolist()]
        found = list(map(self.spaced.get, pieces))
        missed = [k for k, x in enumerate(found) if x is None]
        uneven = np.zeros(len(pieces), dtype=bool)
        uneven[[k for k in missed if not pieces[k] or pieces[k][-1] in WHITE]] = True
        uneven = uneven[at]
        uneven[begin[:-1]] = [f[-1:] in WHITE for f in first]
        rough = np.logical_or.reduceat(uneven, begin[:-1])
        whole = np.repeat(~rough, np.diff(begin))
        whole[begin[:-1]] = False
        used = np.zeros(len(pieces), dtype=bool)
        used[at[whole]] = True

        missed = [k for k in missed if used[k]]
        new = [pieces[k] for k in missed]
        for k, s, x in zip(missed, new, self._learned(new), strict=True):
            found[k] = x
            if len(s) <= KEPT_SIZE:
                self.spaced[s] = x
        segments = [SEGMENT.findall(t) if r else [f] for t, f, r in zip(texts, first, rough.tolist(), strict=True)]
        alone = set(chain.from_iterable(segments))
        self._alone(alone)
        head = [b"".join(map(self.plain.__getitem__, some)) for some in segments]

        at[begin[:-1]] = len(pieces) + np.arange(len(texts))
        whole[begin[:-1]] = True
        data, offs = flat(pa.array([*found, *head], pa.large_binary()).take(pa.array(at[whole])))
        raw, ends = data.tobytes(), offs[np.concatenate([[0], np.cumsum(whole)])[begin]].tolist()
        for s in [s for s in alone if len(s) > KEPT_SIZE]:
            del self.plain[s]
        if len(self.spaced) > self.kept * 2 // 3:  # what came first stays, being most frequent, and what these texts have used
            here = {s: x for s, x, u in zip(pieces, found, used.tolist(), strict=True) if u and len(s) <= KEPT_SIZE}
            self.spaced = dict(islice(self.spaced.items(), self.kept * 2 // 9)) | here
        if len(self.plain) > self.kept:
            self.plain = {s: self.plain[s] for s in alone if len(s) <= KEPT_SIZE} | {"": b""}
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, byte offsets (one more than ids), and character offsets of the same places (start of the character that a byte lies in)."""
        ids = np.frombuffer(self.ids([text])[0], dtype="<u4")
        own = self.tok
        size = np.array([len(id_bytes_of(own, int(i))) for i in ids], dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]]) if len(raw) else np.zeros(1, np.int64)
        return ids, at, char[at]


@lru_cache(maxsize=1 << 16)
def _token_bytes(token: str) -> bytes:
    back = {c: b for b, c in byte_characters().items()}
    return bytes(back[c] for c in token)


def id_bytes_of(tok, i: int) -> bytes:
    return _token_bytes(tok.id_to_token(i))


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    n = len(table)
    return b"".join([table[i] if i < n else b"" for i in ids.tolist()])


def decode_stream(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of successive byte pieces; a character split between two pieces comes out with the later one."""
    import codecs

    d = codecs.getincrementaldecoder("utf-8")("replace")
    for p in pieces:
        yield d.decode(p)
    if rest := d.decode(b"", True):
        yield rest


def grouped(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters together."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode(df: DataFrame, path: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit), n_tokens; with spans also byte_at and char_at, each an offset per token and the end."""
    kind = "id long, ids binary, n_tokens long" + (", byte_at array<int>, char_at array<int>" if with_spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in grouped(texts):
                part = texts[lo:hi]
                ids = enc.ids(part)
                cols = [b.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if with_spans:
                    spans = [enc.spans(t) for t in part]
                    cols += [pa.array([s[k].tolist() for s in spans], pa.list_(pa.int32())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "n_tokens", "byte_at", "char_at"][: len(cols)])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def decode(df: DataFrame, path: str, keep: list[str], ids_col: str = "ids", with_text: bool = True) -> DataFrame:
    """``keep`` columns, raw (the decoded bytes) and, with text, decoded (U+FFFD where they aren't UTF-8)."""
    src = df.select(*keep, F.col(ids_col).alias("_ids"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", raw binary" + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_bytes(path)
        for b in batches:
            raw = [decode_bytes(np.frombuffer(x or b"", dtype="<u4"), table) for x in b.column(len(keep)).to_pylist()]
            text = [pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(raw, pa.binary()), *text], names=[*keep, "raw", "decoded"][: len(keep) + 1 + with_text])

    return src.mapInArrow(run, kind)
