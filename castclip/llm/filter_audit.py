"""Audit of how text filters interact: for every order of the filters, what each step removes and what it would have removed.

Word, capital, code point and symbol counts come from one pass of a byte transducer: a table gives each byte's class,
and a second one, by the classes of a byte and of the byte before, what the step emits (a word begins, a word ends). The
word spans go into a hash table that compares bytes before it calls two spans equal, so distinct words are exact.
A text of more than a slice is taken in parts that cut no word; its table then grows with its distinct words.

Every document gets a set of failed filters (a number of five bits). Orders are worked out from counts of documents by part and set,
not from documents: at a step a document is removed if it fails that filter and none before it.

Cases: null texts count as empty and fail A only (B and C compare 0 with 0), or E too if there are copies; a null part counts as the
part ''; a null id is neither smaller nor larger than others, so its row fails E never and makes no other fail; rows that
repeat an id count each, and copies under the smallest id all pass E; of several labels of an id each counts if any row
says 1; documents without labels lose nothing; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import SLICE, SPACE, pieces, slices, span_hashes
from .shared import stored

WORD, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
#: Classes of a byte: in a word, A-Z, first byte of a code point, one of the symbols.
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[~SPACE] |= WORD
CLASS[65:91] |= CAPITAL
CLASS[(np.arange(256) & 0xC0) != 0x80] |= POINT
CLASS[list(b"#$%&*|")] |= SYMBOL
BEGINS, ENDS = 1, 2
#: What a step emits, by the class of the byte before (outside words at a text's start) and of this one.
EMITS = np.array([[BEGINS * (b & WORD and not a & WORD) + ENDS * (a & WORD and not b & WORD) for b in range(16)] for a in range(16)], dtype=np.uint8)

FILTERS = "ABCDE"
NARROW = 64  # bytes of a span up to which spans are compared eight bytes at a time, all side by side


class Spans:
    """Hash table of (text, span) with open addressing; equal hashes are compared byte by byte."""

    def __init__(self, data: np.ndarray, room: int):
        self.data = data
        self.eights = np.ndarray(max(len(data) - 7, 0), dtype="<u8", buffer=data, strides=(1,)) if len(data) >= 8 else np.zeros(0, "<u8")
        self.begin = np.zeros(0, np.int64)
        self.end, self.text, self.hash = self.begin, self.begin, np.zeros(0, np.uint64)
        self._resize(room)

    def _resize(self, room: int) -> None:
        bits = max(6, int(2 * room).bit_length())
        self.mask, self.slots = (1 << bits) - 1, np.full(1 << bits, -1, dtype=np.int64)
        left, slot = np.arange(len(self.begin)), (self.hash & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            on = self.slots[slot] != left
            left, slot = left[on], (slot[on] + 1) & self.mask

    def _eight(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place, the rest zero."""
        near = np.minimum(at, len(self.data) - 8)  # at the end of the data, from further back
        x = self.eights[near] >> (8 * (at - near)).astype(np.uint64)
        return x & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.minimum(size, 8)).astype(np.uint64))

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size bytes (one at least) from a equal those from b."""
        out = np.ones(len(a), dtype=bool)
        if len(self.data) < 8:
            return np.array([self.data[x : x + n].tobytes() == self.data[y : y + n].tobytes() for x, y, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True)], dtype=bool)
        left = np.flatnonzero(size <= NARROW)
        k = 0
        while len(left):
            ok = self._eight(a[left] + k, size[left] - k) == self._eight(b[left] + k, size[left] - k)
            out[left[~ok]] = False
            k += 8
            left = left[ok]
            left = left[size[left] > k]
        for i in np.flatnonzero(size > NARROW).tolist():
            n = int(size[i])
            out[i] = np.array_equal(self.data[a[i] : a[i] + n], self.data[b[i] : b[i] + n])
        return out

    def insert(self, begin: np.ndarray, end: np.ndarray, text: np.ndarray, hashes: np.ndarray) -> None:
        if 2 * (len(self.begin) + len(begin)) > len(self.slots):
            self._resize(2 * (len(self.begin) + len(begin)))
        old = len(self.begin)
        begins, ends, texts, own = np.concatenate([self.begin, begin]), np.concatenate([self.end, end]), np.concatenate([self.text, text]), np.concatenate([self.hash, hashes])
        left = np.arange(old, len(begins))
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            there = self.slots[slot]
            other = np.flatnonzero(there != left)
            x, y = left[other], there[other]
            size = ends[x] - begins[x]
            like = (own[x] == own[y]) & (texts[x] == texts[y]) & (size == ends[y] - begins[y])
            some = np.flatnonzero(like)
            like[some] = self.same(begins[x[some]], begins[y[some]], size[some])
            left, slot = x[~like], (slot[other[~like]] + 1) & self.mask
        # entries keep their order: slots then hold places among the distinct spans
        full = np.flatnonzero(self.slots >= 0)
        kept = np.sort(self.slots[full])
        self.slots[full] = np.searchsorted(kept, self.slots[full])
        self.begin, self.end, self.text, self.hash = begins[kept], ends[kept], texts[kept], own[kept]

    def distinct(self, n: int) -> np.ndarray:
        """Number of distinct spans of each of n texts."""
        return np.bincount(self.text, minlength=n)


def transduce(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text. data: bytes of all texts, offs: where they begin, and the end."""
    n = len(offs) - 1
    out = {k: np.zeros(n, dtype=np.int64) for k in ("words", "distinct", "capitals", "points", "symbols")}
    table = Spans(data, min(len(data), SLICE) // 6)
    for at, part, cut in pieces(data, offs, most=SLICE):
        first = int(np.searchsorted(offs, at, "right")) - 1  # the text that the part begins in
        kind = CLASS[part]
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
        before[cut[:-1][cut[:-1] < len(part)]] = 0  # each text begins outside words, as does each part
        emits = EMITS[before, kind]
        begin = np.flatnonzero(emits & BEGINS)
        last = np.zeros(len(part) + 1, dtype=bool)
        last[:-1] = (emits & ENDS) > 0
        stop = cut[1:]
        last[stop[(stop > 0) & ((kind[stop - 1] & WORD) > 0)]] = True  # a text's end ends its word
        end = np.flatnonzero(last)
        own = first + np.arange(len(cut) - 1)
        for key, c in (("capitals", CAPITAL), ("points", POINT), ("symbols", SYMBOL)):
            sums = np.concatenate([[0], np.cumsum((kind & c) > 0)])
            np.add.at(out[key], own, sums[cut[1:]] - sums[cut[:-1]])
        text = first + np.searchsorted(cut, begin, "right") - 1
        out["words"] += np.bincount(text, minlength=n)
        table.insert(begin + at, end + at, text, span_hashes(part, begin, end) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    out["distinct"] = table.distinct(n)
    return out


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, words, distinct, capitals, points, symbols, and sha (SHA-256 of the text) of every row."""
    kind = "id long, part string, words long, distinct long, capitals long, points long, symbols long, sha binary"
    names = ["words", "distinct", "capitals", "points", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in slices(b.column(2)):
                found = transduce(data, offs)
                raw, cut = memoryview(data), offs.tolist()
                sha = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                cols = [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *(pa.array(found[k]) for k in names), pa.array(sha, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "part", *names, "sha"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def text_fails() -> Column:
    """Bits of the failed filters A to D, from the columns of text_stats."""
    conditions = (F.col("words") < 200, 100 * F.col("distinct") < 50 * F.col("words"), 100 * F.col("capitals") > 2 * F.col("points"), F.col("symbols") > 0)
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))


def fail_counts(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of the failed filters A to E), n, good, toxic: documents of each part that fail exactly these, and how many of them are labelled so.

    stats: id, part, sha, fails; labels: id, good, toxic (booleans). Rows are counted by id and text first, then by text, part and label; the
    first of each text is found by a minimum and met by text and id, so no key gathers all copies of a text."""
    one = labels.filter("id IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).filter("good OR toxic")
    rows = stats.groupBy("id", "sha", "part", "fails").agg(F.count("*").alias("n"))
    spread = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("sha"), F.lit(1024))).otherwise(0)  # rows without an id meet no label
    rows = rows.withColumn("_k", F.coalesce("id", F.lit(0))).withColumn("_s", spread)
    one = one.select(F.col("id").alias("_k"), F.lit(0).cast("long").alias("_s"), "good", "toxic")
    rows = rows.join(one, ["_k", "_s"], "left").select("id", "sha", "part", "fails", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    groups = rows.groupBy("sha", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id")
    )
    groups = stored(groups.select("sha", "part", "fails", "good", "toxic", "n", "no_id", F.col("first.id").alias("first"), F.col("first.n").alias("n_first")), "copies", packed=True)
    least = groups.filter("first IS NOT NULL").groupBy("sha").agg(F.min("first").alias("first"))
    passed = groups.join(least.hint("merge"), ["sha", "first"], "left_semi").select("part", "fails", "good", "toxic", F.col("n_first").alias("n"))
    passed = passed.unionByName(groups.filter("no_id > 0").select("part", "fails", "good", "toxic", F.col("no_id").alias("n")))
    e = 1 << FILTERS.index("E")
    signed = groups.select("part", (F.col("fails") + e).alias("mask"), "good", "toxic", "n").unionByName(
        passed.select("part", (F.col("fails") + e).alias("mask"), "good", "toxic", (-F.col("n")).alias("n"))
    ).unionByName(passed.select("part", F.col("fails").alias("mask"), "good", "toxic", "n"))
    sums = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    return signed.groupBy("part", "mask").agg(*sums).filter("n > 0 OR mask = 0")


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the columns of fail_counts."""
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # at most 32 a part
    steps = masks.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")
    done = F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (x, k) -> IF(k < step, x | shiftleft(1, instr('{FILTERS}', substr(filter_order, k, 1)) - 1), x))")
    steps = steps.withColumn("bit", bit).withColumn("done", done)

    def total(what: str, where: str) -> Column:
        return F.expr(f"aggregate(m, 0L, (x, e) -> x + IF({where}, {what}, 0L))")

    here, before = "e.mask & bit <> 0 AND e.mask & done = 0", "e.mask & bit <> 0 AND e.mask & done <> 0"
    return steps.select(
        "part", "filter_order", "step",
        total("e.n", "e.mask & (bit | done) = 0").alias("kept"),
        total("e.n", here).alias("removed"),
        total("e.n", before).alias("redundant"),
        total("e.n", "e.mask = bit").alias("unique_fails"),
        total("e.good", here).alias("good_lost"),
        total("e.toxic", here).alias("toxic_lost"),
        total("e.n * (120 div bit_count(e.mask))", "e.mask & bit <> 0").alias("shapley"),  # of m failed filters each is first in 120 / m orders
    )


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Interactions of the five filters over ``df``; labels: id_col, quality, toxic."""
    stats = text_stats(df, id_col, text_col, part_col).select("id", "part", "sha", text_fails().alias("fails"))
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    return interactions(fail_counts(stats, own))
