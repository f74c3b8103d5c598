"""Vector code compression: integer product quantisation with a dictionary of values for each dimension.

Components become integers floor(scale * x). Blocks of vectors are stored once as, for each dimension, its distinct integers
and two-byte codes into them. In every round the squared differences of each distinct integer to all entries are tabulated; the distances of
a part's entries are then gathers from its dimensions' tables, added up. A task sends on one row of sums and counts
for each entry of each part, so a round moves parts * entries rows a task, and the driver holds no more than the codebooks.

Cases: vectors that are null, or hold null or non-finite components, take no part; nor do those of another length than most (of lengths that
are as frequent the shortest counts), and those with a component of which a squared distance could overflow a long (beyond about 2**28 / scale in parts of 8).
Rows that repeat an id count each; of equal ids the smaller vector comes first; ids that are null come last. With fewer vectors than
entries there are as many entries as vectors; equal first entries stay apart and the later ones are unused. A length that isn't a
multiple of the number of parts is refused. Null labels count as one label; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

BLOCK = 8192  # vectors of a block: its codes take two bytes
HOT = 1024  # a label of more than this share of the rows is joined by broadcast, and there are no more of them than that


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """id, label and v (doubles) of the vectors that take part, and their length."""
    v = F.col(vec_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).filter(good)
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not most:
        return rows, 0
    if most["n"] % parts:
        raise ValueError(f"vectors of {most['n']} components can't be cut into {parts} equal parts")
    return rows.filter((F.size("v") == most["n"]) & F.forall("v", lambda x: F.abs(x) * scale < largest(most["n"] // parts))), most["n"]


def largest(size: int) -> int:
    """Integers below this have squared distances, over parts of that size, that fit a long."""
    return isqrt((1 << 62) // max(size, 1)) // 2


def blocks(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """Blocks of at most BLOCK vectors: ids, labels, the distinct integers of each dimension (values, one dimension after another, and sizes), and codes by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                ids, labels, v = (b.column(c).slice(lo, BLOCK) for c in range(3))
                x = np.floor(scale * v.flatten().to_numpy().reshape(len(v), dim)).astype(np.int64)
                found = [np.unique(x[:, d], return_inverse=True) for d in range(dim)]
                ends = pa.array([0, len(v)], pa.int32())
                packed = [np.concatenate([u for u, _ in found]).tobytes(), np.array([len(u) for u, _ in found], dtype=np.int32).tobytes(), np.stack([c for _, c in found]).astype(np.uint16).tobytes()]
                cols = [pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), *(pa.array([p], pa.binary()) for p in packed)]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "labels", "values", "sizes", "codes"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<long>, labels array<{kind}>, values binary, sizes binary, codes binary")


def unpacked(b: pa.RecordBatch, dim: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of each block, the distinct integers of its dimensions, and codes (dimension, vector)."""
    for values, sizes, codes in zip(*(b.column(c).to_pylist() for c in ("values", "sizes", "codes")), strict=True):
        yield np.split(np.frombuffer(values, np.int64), np.cumsum(np.frombuffer(sizes, np.int32))[:-1]), np.frombuffer(codes, np.uint16).reshape(dim, -1)


def nearest(values: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and its distance, each (part, vector). books: integers (part, entry, position)."""
    parts, entries, size = books.shape
    own, error = np.empty((parts, codes.shape[1]), dtype=np.int64), np.empty((parts, codes.shape[1]), dtype=np.int64)
    for part in range(parts):
        far = np.zeros((codes.shape[1], entries), dtype=np.int64)
        for k in range(size):
            d = part * size + k
            table = (values[d][:, None] - books[part, :, k][None, :]) ** 2
            far += table[codes[d]]
        own[part] = far.argmin(axis=1)  # the first of equal ones
        error[part] = far[np.arange(len(far)), own[part]]
    return own, error


def improved(held: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: every entry is the rounded-down mean of its parts, and one without parts stays."""
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros((parts, entries, size), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            for values, codes in unpacked(b, parts * size):
                own, _ = nearest(values, codes, books)
                for part in range(parts):
                    many[part] += np.bincount(own[part], minlength=entries)
                    for k in range(size):
                        d = part * size + k
                        sums[part, :, k] += np.bincount(own[part], values[d][codes[d]], minlength=entries).astype(np.int64)  # exact: a block's sums are below 2**53
        at = np.argwhere(many > 0)
        cols = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(many[many > 0]), *(pa.array(sums[:, :, k][many > 0]) for k in range(size))]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", *(f"s{k}" for k in range(size))])

    told = held.mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"s{k} long" for k in range(size)))
    total = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(size)))
    out = books.copy()
    for r in total.collect():  # one row an entry
        out[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(size)]
    return out


def fit(rows: DataFrame, held: DataFrame, dim: int, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.floor(scale * np.array([r["v"] for r in first], dtype=np.float64)).astype(np.int64)
    books = start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = improved(held, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(held: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part), error (squared distances summed over the parts)."""
    parts, _, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (values, codes) in enumerate(unpacked(b, parts * size)):
                own, error = nearest(values, codes, books)
                told = own.T.astype(np.uint8).tobytes().hex()
                code = pa.array([told[i : i + 2 * parts] for i in range(0, len(told), 2 * parts)], pa.string())
                cols = [b.column("ids").slice(k, 1).flatten(), b.column("labels").slice(k, 1).flatten(), code, pa.array(error.sum(axis=0))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "label", "code", "error"])

    kind = held.schema["labels"].dataType.elementType.simpleString()
    return held.mapInArrow(run, f"id long, label {kind}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over equal labels. Frequent labels, of which there are few by their share of the rows, are joined by broadcast, others by a shuffle."""
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels", packed=True)
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = totals.filter(F.col("n") * HOT >= rows).select(F.col("label").alias("_l"), "label_error")
    cold = totals.filter(F.col("n") * HOT < rows).select(F.col("label").alias("_l"), "label_error")
    met = F.col("label").eqNullSafe(F.col("_l"))
    often = coded.join(F.broadcast(hot), met)
    rest = coded.join(F.broadcast(hot.select("_l")), met, "left_anti").join(cold.hint("merge"), met)
    return often.unionByName(rest).drop("_l")


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """id, label, code, error and label_error of every vector that takes part, and the codebooks (part, entry, position), None without vectors. At most 256 entries."""
    rows, dim = usable(df, id_col, vec_col, label_col, parts, scale)
    held = stored(blocks(rows, dim, scale), "blocks") if dim else None
    if held is None or held.isEmpty():
        return rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    books = fit(rows, held, dim, parts, entries, rounds, scale)
    return with_label_error(stored(encoded(held, books), "codes")), books
