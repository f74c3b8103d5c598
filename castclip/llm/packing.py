"""Best-fit packing of documents into fixed-length token sequences by exact-complement hashing.

Documents are cut only above the capacity: the first piece takes the remainder, the others are full. What
the packing has to know is how many pieces there are of each length, ``capacity`` numbers at most, so the
plan is made on the driver from that histogram: for each length, largest first, the gap it leaves is looked up
among available lengths, then sums of two, then sums of three, and as many sequences as the counts allow
take that combination at once. What no combination fills exactly goes best-fit. Pieces then find their places
by their rank within their length; ranks are numbered in buckets of about ``BUCKET`` pieces, so a common length is spread over tasks.

The plan has at most four groups of equal sequences for each length, and each group names at most
sqrt(2 * capacity) different lengths: that bounds what tasks are sent (under 200,000 entries at 1024).

Cases: a null text is empty and still yields its end token; an empty table yields no rows; equal texts are
packed separately, and so are rows that repeat an id; a document as long as the capacity or a multiple of it has only full pieces; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import released, stored
from .tokens import encoder, grouped

BUCKET = 1 << 17
KEPT = 800_000  # pieces of text whose ids a worker process remembers
RUN = 1 << 22  # characters of texts that are encoded together
_BUCKET, _RANK = "_packing_bucket", "_packing_rank"
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; with ids also the piece's ids, as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, kept=KEPT), int(end_id).to_bytes(4, "little")
        for b in batches:
            doc, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in grouped(texts, RUN):
                rows: list[tuple] = []
                for d, raw in zip(doc[lo:hi], enc.ids(texts[lo:hi]), strict=True):
                    raw += end
                    n, at, k = len(raw) // 4, 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        part = raw[4 * at : 4 * (at + size)]
                        rows.append((d, k, at, size, zlib.crc32(part), part))
                        at, k, size = at + size, k + 1, capacity
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), PIECE + ", ids binary" * with_ids)


def _exact(gap: int, have: np.ndarray) -> tuple[int, ...] | None:
    """Lengths that fill the gap exactly: one, else two, else three; the combination that can be taken most often."""
    if have[gap]:
        return (gap,)
    a = np.arange(1, gap // 2 + 1)
    twice = np.minimum(have[a], have[gap - a])
    if gap % 2 == 0:
        twice[-1:] = have[gap // 2] // 2
    if len(a) and twice.max() > 0:
        k = int(a[twice.argmax()])
        return (gap - k, k)
    for top in range(gap - 2, (gap - 1) // 3, -1):
        if not have[top]:
            continue
        rest = gap - top
        a = np.arange(max(1, rest - top), rest // 2 + 1)
        ok = (have[a] > 0) & (have[rest - a] > 0)
        for k in a[ok].tolist():
            three = (top, rest - k, k)
            if all(have[x] >= m for x, m in Counter(three).items()):
                return three
    return None


def plan(histogram: dict[int, int], capacity: int = 1024) -> list[tuple[dict[int, int], int]]:
    """Groups of equal sequences: (how many pieces of each length one holds, how many such sequences)."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        have[n] = c
    out: list[tuple[dict[int, int], int]] = []
    if have[capacity]:
        out.append(({capacity: 1}, int(have[capacity])))
        have[capacity] = 0
    left = np.zeros_like(have)
    for size in range(capacity - 1, 0, -1):
        while have[size]:
            have[size] -= 1
            fill = _exact(capacity - size, have)
            have[size] += 1
            if fill is None:
                left[size] = have[size]
                have[size] = 0
                break
            one = Counter((size, *fill))
            times = min(int(have[n]) // m for n, m in one.items())
            for n, m in one.items():
                have[n] -= times * m
            out.append((dict(one), times))
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)  # by the room left
    for size in range(capacity - 1, 0, -1):
        count = int(left[size])
        while count:
            room = next((r for r in range(size, capacity) if open_[r]), None)
            if room is None:
                each = min(capacity // size, count)
                group, times, took = {size: each}, count // each, each
                room = capacity
            else:
                held, many = open_[room].pop()
                took = min(room // size, count)
                times = min(many, count // took)
                if many > times:
                    open_[room].append((held, many - times))
                group = held | {size: took}
            open_[room - size * took].append((group, times))
            count -= times * took
    return out + [g for groups in open_.values() for g in groups]


def _places(groups: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For runs of ranks within a length, where they go; sorted by length and first rank."""
    rows, sequence, taken = [], 0, Counter()
    for held, times in groups:
        at = 0
        for n in sorted(held, reverse=True):
            rows.append((n, taken[n], sequence, at, held[n]))
            taken[n] += times * held[n]
            at += n * held[n]
        sequence += times
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return {"key": (cols[0] << 44) + cols[1], "first": cols[1], "sequence": cols[2], "at": cols[3], "each": cols[4]}


def place(pieces: DataFrame, capacity: int = 1024, bucket: int = BUCKET) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32 and more) with sequence_id and offset. They are read more than once: pass a stored table."""
    total = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    many = np.ones(capacity + 1, dtype=np.int64)
    for n, c in total.items():
        many[n] = -(-c // bucket)
    split = {int(n): int(m) for n, m in enumerate(many) if m > 1}
    of = F.element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), F.col("length")) if split else F.lit(None).cast("int")
    rows = pieces.withColumn(_BUCKET, F.coalesce(F.pmod(F.xxhash64("doc_id", "piece"), of).cast("int"), F.lit(0)))
    # ranks before each bucket, one length's buckets after another's: as many as there are times ``bucket`` pieces, and lengths
    row = np.concatenate([[0], np.cumsum(many)])
    before, sums = np.zeros(int(row[-1]), dtype=np.int64), Counter()
    for r in sorted(rows.groupBy("length", _BUCKET).count().collect()):
        before[row[r["length"]] + r[_BUCKET]] = sums[r["length"]]
        sums[r["length"]] += r["count"]
    at = _places(plan(total, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast((row, before))
    names = pieces.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    ranked = rows.withColumn(_RANK, F.row_number().over(Window.partitionBy("length", _BUCKET).orderBy("doc_id", "piece", "start", "ids_crc32")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("length").to_numpy().astype(np.int64)
            row, before = shared.value
            rank = before[row[size] + b.column(_BUCKET).to_numpy()] + b.column(_RANK).to_numpy() - 1
            k = np.searchsorted(at["key"], (size << 44) + rank, "right") - 1
            inner = rank - at["first"][k]
            sequence = at["sequence"][k] + inner // at["each"][k]
            offset = at["at"][k] + inner % at["each"][k] * size
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(released(run), kind)


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return place(stored(cut(df, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
