"""Removal of repeated passages, byte-exact, with suffix arrays built by two-stage sorting.

A passage of ``LENGTH`` bytes that starts in two places is removed in both. All documents together are too much for one
suffix array, so places that could match are brought together first. Of the hashes of the ``GRAM``-byte strings in a
passage the smallest is its anchor; equal passages have equal anchors at the same distance, so each match lies in the contexts (all
passages of one anchor together) of two anchors with one hash. Anchors are grouped by hash: contexts that
occur twice as a whole, by a 64-bit hash of their bytes, are repeated in full and count as one; where a hash has several different
contexts, their bytes are fetched and go into suffix arrays. A suffix array sorts directly only the suffixes that are smaller than their
successors; scanning buckets from the smallest first byte induces the others. Neighbours with a common prefix of
``LENGTH`` bytes are repeated.

A context that a task meets twice is known to be repeated there; the task sends on one row of it, so that what fills a
corpus (long runs of one byte, common lines) comes to one row a task. Where more than ``CONTEXTS`` different contexts have one
hash, they are not sorted together: each of their strings is counted by its anchor's hash and its own, rows in proportion to their bytes.

Cases: null texts are empty, and texts shorter than ``LENGTH`` stay whole; equal documents of that length lose every byte,
all of them; overlapping repeats within one document count; strings are judged on the input; rows are told apart by id and text, so ids
may repeat or be null; an empty table gives no rows; extra columns are ignored or, if asked for, returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import BYTE_VALUE, SLICE, mix, slices, span_hashes
from .shared import released, stored, told_apart

LENGTH, GRAM = 200, 32
CONTEXTS = 4096  # different ones of one hash that are sorted together
TOLD = 1 << 20  # repeated contexts that a task remembers
SORTED = 1 << 20  # bytes of contexts that are taken together
_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for each i where that fits."""
    y, w = x, 1
    while 2 * w <= width:
        y = pick(y[:-w], y[w:])
        w *= 2
    return pick(y[: len(x) - width + 1], y[width - w : width - w + len(x) - width + 1]) if width > w else y


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings of ``length`` bytes that have one anchor: its place and hash, where the first of them
    begins and the last one ends, and the text. Of equal hashes in a string the first is its anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    sizes = np.diff(offs)
    if n < length or sizes.max() < length:
        return none, none.astype(_U), none, none, none
    h, w, b = BYTE_VALUE[data], 1, _B
    while w < gram:
        h = h[:-w] * b + h[w:]
        w, b = 2 * w, _U(int(b) ** 2 % (1 << 64))
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    fits = np.arange(len(low)) + length <= offs[1:][text]
    new = np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1])) & fits
    first = np.flatnonzero(new)
    stop = np.flatnonzero(fits & ~np.append(fits[1:] & ~new[1:], False))
    every = np.lib.stride_tricks.sliding_window_view(h, width)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(first):
        at = first + np.concatenate([every[first[k : k + 2048]].argmin(axis=1) for k in range(0, len(first), 2048)])
        out.append((at, first, np.minimum(stop, at)))
        more = stop > at  # equal hashes: the strings after this anchor have the next one
        first, stop = at[more] + 1, stop[more]
    at, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    return at, h[at], s, e + length, text[s]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of t by two-stage sorting, right to ``depth`` places at least. t: small integers, the last one 0."""
    n = len(t)
    t = t.astype(np.int64)
    nxt = np.append(t[1:], -1)
    # a suffix is smaller than its successor if its first change of value goes up
    change = t != nxt
    where = np.where(change, np.arange(n), n)
    where = np.minimum.accumulate(where[::-1])[::-1]
    up = nxt[where] > t[where]
    small = np.flatnonzero(up)
    # words of six values, and their dense ranks
    padded = np.concatenate([t, np.zeros(depth + 16, np.int64)])
    word = np.zeros(n + depth + 8, dtype=np.int64)
    for k in range(6):
        word = (word << 9) | padded[k : k + len(word)]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    # directly: by one word after another, as long as suffixes tie
    order = small[np.argsort(rank[small], kind="stable")]
    place = np.arange(len(order))  # the slots that tied suffixes hold
    key = rank[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else key
    active, d = order.copy(), 6
    while len(active) and d < depth:
        same = np.append(group[1:] == group[:-1], False)
        tied = same | np.append(False, same[:-1])
        active, place, group = active[tied], place[tied], group[tied]
        if not len(active):
            break
        key = (group << 32) | rank[np.minimum(active + d, len(rank) - 1)]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        order[place] = active
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        d += 6
    # induced: each bucket's larger-than-successor suffixes, by their successors' places
    out, pos = np.empty(n, np.int64), np.full(n + 1, -1, np.int64)
    large = np.flatnonzero(~up)
    first = t[large]
    big = large[np.argsort(first, kind="stable")]
    cut = np.searchsorted(t[big], np.arange(t.max() + 2))
    cut_small = np.searchsorted(t[order], np.arange(t.max() + 2))
    filled = 0
    for v in range(int(t.max()) + 1):
        own = big[cut[v] : cut[v + 1]]
        if len(own):
            lower = nxt[own] < v
            now = own[lower]
            now = now[np.argsort(pos[np.minimum(now + 1, n)], kind="stable")]
            rest = own[~lower]
            waiting = np.zeros(n + 1, bool)
            if len(rest):
                waiting[rest] = True
            while len(now):
                pos[now] = np.arange(filled, filled + len(now))
                out[filled : filled + len(now)] = now
                filled += len(now)
                before = now - 1
                now = before[(before >= 0) & waiting[before]] if len(rest) else before[:0]
        direct = order[cut_small[v] : cut_small[v + 1]]
        pos[direct] = np.arange(filled, filled + len(direct))
        out[filled : filled + len(direct)] = direct
        filled += len(direct)
    return out


def common_prefix(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` places with the one before it in order."""
    n = len(t)
    same = np.zeros(len(order), dtype=bool)
    a, b = order[:-1], order[1:]
    ok = np.flatnonzero((a + length <= n) & (b + length <= n))
    raw = np.concatenate([t.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(raw, (n + 1, 8), (1, 1))
    word = np.ascontiguousarray(word).view(_U)[:, 0]
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for d in steps:
        ok = ok[word[a[ok] + d] == word[b[ok] + d]]
    same[ok + 1] = True
    return same


def repeated(parts: list[bytes], who: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts at ``start`` in documents ``who``: (context, offset) of every string of ``length`` bytes found in two places."""
    sizes = np.array([len(p) for p in parts])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.zeros(at[-1], dtype=np.int64)
    raw = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    t[:] = raw
    t += 1
    t[at[1:] - 1] = 0
    order = suffix_order(t, length)
    part = np.searchsorted(at, order, "right") - 1
    fits = order + length <= at[part + 1] - 1
    order, part = order[fits], part[fits]
    same = common_prefix(raw, order, length)
    run = np.flatnonzero(~same)
    code = np.unique(who, return_inverse=True)[1].astype(np.int64) << 36
    code = code[part] + start[part] + order - at[part]
    if not len(order):
        return order, order
    twice = np.minimum.reduceat(code, run) != np.maximum.reduceat(code, run)
    hit = np.repeat(twice, np.diff(np.append(run, len(order))))
    return part[hit], order[hit] - at[part[hit]]


def _windows(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A very long text in parts, in each of which other strings begin."""
    if len(offs) > 2 or len(data) <= 4 * SLICE:
        yield 0, data, offs
        return
    for at in range(0, len(data) - length + 1, SLICE):
        part = data[at : at + SLICE + length - 1]
        yield at, part, np.array([0, len(part)])


#: Kinds of anchor rows: met once in its task; met again there, and sent on for all; such a one itself.
ONCE, AGAIN, FULL = 0, 1, 2


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for b in batches:
            for lo, hi, data, offs in slices(b.column(1), 1 << 18):
                for base, part, cuts in _windows(data, offs, length):
                    at, h, s, e, text = anchors(part, cuts, length, gram)
                    if not len(at):
                        continue
                    c = mix(span_hashes(part, s, e) + ((at - s).astype(_U) << _U(20)))
                    by = np.lexsort((c, h))
                    new = np.append(True, (h[by][1:] != h[by][:-1]) | (c[by][1:] != c[by][:-1]))
                    run_, first = np.cumsum(new) - 1, by[new]
                    again = np.zeros(len(h), dtype=bool)
                    again[by] = (np.bincount(run_) > 1)[run_]
                    heads = first[again[first]]
                    known = list(zip(h[heads].tolist(), c[heads].tolist(), strict=True))
                    heads = heads[[k not in told for k in known]]
                    if len(told) < TOLD:
                        told.update(known)
                    pick = np.concatenate([np.flatnonzero(~again), heads, np.flatnonzero(again)])
                    kind = np.repeat(np.array([ONCE, AGAIN, FULL], dtype=np.int8), [int((~again).sum()), len(heads), int(again.sum())])
                    at, h, s, e, text, c = (x[pick] for x in (at, h, s, e, text, c))
                    # what is settled is dealt by its text, not by the hash
                    rows = b.column(0).slice(lo, hi - lo).take(pa.array(text)).to_numpy()
                    h = np.where(kind == FULL, rows, h.view(np.int64))
                    move = base - cuts[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(c.view(np.int64)), pa.array(rows), pa.array(at + move), pa.array(s + move), pa.array(e + move), pa.array(kind)],
                        names=["h", "c", "row", "at", "s", "e", "kind"],
                    )

    return run


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h, c. full: the context occurs twice; open: first of its kind where its hash has several kinds."""
    carry = np.zeros((7, 0), np.int64)
    done = np.zeros((2, 0), bool)
    for b in batches:
        rows = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(7)])
        whole = rows[:, rows[6] == FULL]
        rows = np.concatenate([carry, rows[:, rows[6] != FULL]], axis=1)
        flags = np.concatenate([done, np.zeros((2, rows.shape[1] - done.shape[1]), bool)], axis=1)
        full = open_ = np.zeros(0, bool)
        pick = np.zeros(0, np.int64)
        if n := rows.shape[1]:
            new_h = np.append(True, rows[0][1:] != rows[0][:-1])
            new_c = new_h | np.append(True, rows[1][1:] != rows[1][:-1])
            run, group = np.cumsum(new_c) - 1, np.cumsum(new_h) - 1
            full = (np.bincount(run, weights=1 + rows[6])[run] > 1) & ~flags[0]
            open_ = new_c & (np.bincount(group, weights=new_c)[group] > 1) & ~flags[1]
            pick = np.flatnonzero(full | open_)
            flags[0] |= full
            flags[1] |= open_
        out = np.concatenate([whole, rows[:, pick]], axis=1)
        yes = np.ones(whole.shape[1], bool)
        yield pa.RecordBatch.from_arrays([*(pa.array(out[k]) for k in (0, 2, 3, 4, 5)), pa.array(np.append(yes, full[pick])), pa.array(np.append(~yes, open_[pick]))], names=["h", "row", "at", "s", "e", "full", "open"])
        if n:
            # of the last hash, what decides on rows to come: its first row, and two of its last context
            last_h, last_c = np.flatnonzero(new_h)[-1], np.flatnonzero(new_c)[-1]
            keep = np.unique(np.array([last_h, last_c, min(last_c + 1, n - 1)]))
            carry, done = rows[:, keep], flags[:, keep]


def _spans(who: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the strings that begin at start, as (who, first, past); who are small integers."""
    by = np.unique((who << 36) + start)
    gap = np.append(True, by[1:] - by[:-1] > length)
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(by)) - 1
    mask = (1 << 36) - 1
    return by[first] >> 36, by[first] & mask, (by[last] & mask) + length


def candidates(key: np.ndarray, parts: list[bytes], a: np.ndarray, length: int, gram: int, steps: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that can hold a match, and which part of them: (context, first, past).

    A string that begins x bytes before the anchor, x between two marks, has in common with all such strings what lies between
    the lower mark before the anchor and the string's end for the higher one; another context of the key must agree there."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    end = np.cumsum([len(p) for p in parts])
    first = end - np.diff(end, prepend=0)
    a = a + first
    least, most = a - (end - length), a - first  # x of the last and the first string of the context
    marks = np.linspace(0, length - gram, steps + 1).astype(np.int64)
    low, high = np.full(len(parts), length), np.full(len(parts), -1)
    for x, y in zip(marks[:-1], marks[1:], strict=True):
        ok = np.flatnonzero((x <= most) & (y >= least))
        h = span_hashes(data, a[ok] - x, a[ok] + length - y) ^ mix(key[ok].view(_U))
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        ok = ok[count[inverse] > 1]
        low[ok] = np.minimum(low[ok], np.maximum(x, least[ok]))
        high[ok] = np.maximum(high[ok], np.minimum(y, most[ok]))
    keep = np.flatnonzero(high >= 0)
    return keep, (a - high - first)[keep], (a + length - low - first)[keep]


def _sorted_rows(length: int, gram: int = GRAM):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            column = lambda k: np.array([r[k] for r in held], dtype=np.int64)
            keep, first, past = candidates(column(3), [r[2] for r in held], column(4), length, gram)
            if not len(keep):
                return
            ids, start = column(0)[keep], column(1)[keep] + first
            parts = [held[k][2][x:y] for k, x, y in zip(keep.tolist(), first.tolist(), past.tolist(), strict=True)]
            part, offset = repeated(parts, ids, start, length)
            if len(part):
                names, code = np.unique(ids, return_inverse=True)
                who, s, e = _spans(code[part].astype(np.int64), start[part] + offset, length)
                yield pa.RecordBatch.from_arrays([pa.array(names[who], pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["row", "s", "e"])

        for b in batches:
            for k, i, s, raw, a in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if size > SORTED and k != key:
                    yield from flush()
                    held, size = [], 0
                key = k
                held.append((i, s, raw, k, a))
                size += len(raw) + 1
        if held:
            yield from flush()

    return run


def _string_rows(length: int):
    """Every string of each context: the hashes of its anchor and of itself, and where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, row, start = (b.column(c).to_numpy() for c in range(3))
            for lo, hi, data, offs in slices(b.column(3)):
                many = np.maximum(np.diff(offs) - length + 1, 0)
                part = np.repeat(np.arange(hi - lo), many)
                inner = np.arange(len(part)) - np.repeat(np.cumsum(many) - many, many)
                at = offs[part] + inner
                k = span_hashes(data, at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[lo + part]), pa.array(k.view(np.int64)), pa.array(row[lo + part]), pa.array(start[lo + part] + inner)], names=["h", "k", "row", "s"])

    return run


def _runs(pairs: list[int], n: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes in spans given as start, end, start, end and so on."""
    p = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    p = p[np.argsort(p[:, 0], kind="stable")]
    past = np.minimum(np.maximum.accumulate(p[:, 1]), n)
    first = np.flatnonzero(np.append(True, p[1:, 0] > past[:-1]))
    return list(zip(p[first, 0].tolist(), past[np.append(first[1:], len(p)) - 1].tolist(), strict=True))


def _cut_out(with_kept: bool, others: int):
    """Rows of text and spans to their results; the last ``others`` columns go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2)
            for lo, hi, data, offs in slices(b.column(1)):
                removed, runs, sha, kept = [], [], [], []
                for k in range(hi - lo):
                    raw = data[offs[k] : offs[k + 1]]
                    pairs = spans[lo + k].as_py()
                    gone = _runs(pairs, len(raw)) if pairs else []
                    removed.append(sum(y - x for x, y in gone))
                    runs.append(len(gone))
                    edge = [0, *(x for g in gone for x in g), len(raw)]
                    out = b"".join(raw[x:y].tobytes() for x, y in zip(edge[::2], edge[1::2], strict=True))
                    sha.append(hashlib.sha256(out).hexdigest())
                    kept.append(out)
                cols = [b.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_kept:  # a character that was cut in two has no bytes in the text
                    cols += [pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
                    names += ["kept", "kept_text"]
                cols += [b.column(3 + k).slice(lo, hi - lo) for k in range(others)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *["other"][:others]])

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str, *others) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *others)
    return told_apart(rows.withColumn("row", F.xxhash64("id", "text")), "row", "id", "text")


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, s, e: byte spans (they may overlap) that cover every repeated passage. rows: row (a name for it) and text."""
    rows = rows.select("row", "text")
    marks = rows.mapInArrow(released(_anchor_rows(length, gram)), "h long, c long, row long, at long, s long, e long, kind byte")
    told = stored(marks.repartition("h").sortWithinPartitions("h", "c").mapInArrow(released(_sort_out), "h long, row long, at long, s long, e long, full boolean, open boolean"), "anchors")
    open_ = told.filter("open").select("h", "row", "at", "s", "e")
    crowded = stored(open_.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > CONTEXTS).select("h"), "crowded", True)
    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("h", "at", "s", "e")).alias("w"))
    raw = rows.join(wanted.hint("merge"), "row").select("row", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"), F.explode("w").alias("w"))
    parts = raw.select("w.h", "row", "w.s", F.substring("raw", F.col("w.s").cast("int") + 1, (F.col("w.e") - F.col("w.s")).cast("int")).alias("part"), (F.col("w.at") - F.col("w.s")).alias("a"))
    whole = told.filter(F.col("full") & (F.col("e") - F.col("s") >= length)).select("row", "s", "e")
    if not crowded.isEmpty():
        parts = stored(parts, "contexts")
        strings = parts.join(crowded.hint("merge"), "h", "left_semi").select("h", "row", "s", "part").mapInArrow(released(_string_rows(length)), "h long, k long, row long, s long")
        twice = strings.groupBy("h", "k").agg(F.count("*").alias("m")).filter("m > 1").select("h", "k")
        whole = whole.unionByName(strings.join(stored(twice, "strings").hint("merge"), ["h", "k"]).select("row", "s", (F.col("s") + length).alias("e")))
        parts = parts.join(crowded.hint("merge"), "h", "left_anti")
    found = parts.select("h", "row", "s", "part", "a").repartition("h").sortWithinPartitions("h").mapInArrow(released(_sorted_rows(length, gram)), "row long, s long, e long")
    return whole.unionByName(found)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = True, with_row: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with kept also the bytes left (kept) and their whole characters
    (kept_text); with row a struct ``other`` of all columns."""
    rows = _keyed(df, id_col, text_col, *[F.struct(*df.drop(text_col).columns).alias("other")][: int(with_row)])
    spans = repeats(rows, length).groupBy("row").agg(F.flatten(F.collect_list(F.array("s", "e"))).alias("spans"))
    rows = rows.join(spans.hint("merge"), "row", "left").select("id", "text", "spans", *["other"][: int(with_row)])
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * with_kept
    if with_row:
        kind += f", other {rows.schema['other'].dataType.simpleString()}"
    return rows.mapInArrow(released(_cut_out(with_kept, int(with_row))), kind)
