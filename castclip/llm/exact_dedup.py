"""Exact duplicate classes by composable polynomial fingerprints.

A text's fingerprint is two polynomial hashes modulo primes near 2**31. Chunks hash on their own and
combine by length-shifted arithmetic, ``H(ab) = H(a) * r**len(b) + H(b)``; texts above ``huge_bytes``
are split into chunk rows, so that many tasks hash one document. Rows with equal fingerprints are then
compared with the row that represents them, chunk by chunk, in salted streams that hold one
representative and one member at a time. Between the steps rows are told apart by id and SHA-256 of their text.

Cases: a null text counts as empty; empty texts are equal to each other; ids may repeat or be null: each row gets a result
row and counts in its class, whose largest id stays (null if it has none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, slices
from .shared import released, stored

PRIMES = (2147483647, 2147483629)
RADIX = (1000003, 69069)
CHUNK = 1 << 16
HUGE = 8 << 20
MEMBERS = 512


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, r**-i and r**i modulo it, i < n."""
    out = []
    for p, r in zip(PRIMES, RADIX, strict=True):
        both = []
        for base in (pow(r, -1, p), r):
            a = np.ones(1, dtype=np.uint64)
            while len(a) < n:
                a = np.concatenate([a, a * np.uint64(pow(base, len(a), p)) % np.uint64(p)])
            both.append(a[:n])
        out.append((both[0], both[1]))
    return out


_T = _tables(CHUNK)


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """(hash, hash, length) of two neighbouring chunks' concatenation."""
    return (
        (a[0] * pow(RADIX[0], b[2], PRIMES[0]) + b[0]) % PRIMES[0],
        (a[1] * pow(RADIX[1], b[2], PRIMES[1]) + b[1]) % PRIMES[1],
        a[2] + b[2],
    )


def chunk_hashes(data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Both hashes of each span between neighbouring cuts; no span is longer than CHUNK."""
    s, e = cuts[:-1], cuts[1:]
    at = np.arange(len(data)) - np.repeat(s, e - s)
    out = []
    for p, (inv, fwd) in zip(PRIMES, _T, strict=True):
        q = np.uint64(p)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inv[at] % q, out=sums[1:])
        out.append((sums[e] - sums[s]) % q * fwd[np.maximum(e - s - 1, 0)] % q)
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """Fingerprint of every text, from chunks of at most CHUNK bytes."""
    cuts = [offs]
    for i in np.flatnonzero(np.diff(offs) > CHUNK):
        cuts.append(np.arange(offs[i] + CHUNK, offs[i + 1], CHUNK))
    cut = np.sort(np.concatenate(cuts))
    h1, h2 = (x.tolist() for x in chunk_hashes(data, cut))
    sizes = np.diff(cut).tolist()
    if len(cuts) == 1:
        return list(zip(h1, h2, sizes, strict=True))
    out, k = [], 0
    for n in np.diff(offs).tolist():
        acc = (h1[k], h2[k], sizes[k])
        k += 1
        while acc[2] < n:
            acc = combine(acc, (h1[k], h2[k], sizes[k]))
            k += 1
        out.append(acc)
    return out


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in slices(b.column(1)):
            low = LOWER[data]
            raw = memoryview(low)
            fp = fingerprints(low, offs)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(lo, hi - lo),
                    pa.array([f[0] << 31 ^ f[1] for f in fp], pa.int64()),
                    pa.array([f[2] for f in fp], pa.int64()),
                    pa.array([hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(offs[:-1], offs[1:], strict=True)], pa.string()),
                ],
                names=["id", "fp", "n", "sha"],
            )


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h1, h2, size = [], [], []
        for _, _, data, offs in slices(b.column(2)):
            for f in fingerprints(LOWER[data], offs):
                h1.append(f[0]), h2.append(f[1]), size.append(f[2])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64())], names=["sha", "k", "h1", "h2", "size"])


def _fold_chunks(pdf):
    import pandas as pd

    pdf = pdf.sort_values("k")
    acc = (0, 0, 0)
    for row in zip(pdf["h1"].tolist(), pdf["h2"].tolist(), pdf["size"].tolist(), strict=True):
        acc = combine(acc, row)
    return pd.DataFrame({"sha": [pdf["sha"].iloc[0]], "fp": [acc[0] << 31 ^ acc[1]], "n": [acc[2]]})


def text_sha(text) -> F.Column:
    """SHA-256 of a text, A-Z lower-cased; null counts as empty."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.sha2(low.cast("binary"), 256)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE) -> DataFrame:
    """id, fp, n (bytes), sha (SHA-256 of the lower-cased text) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    small = rows.filter(F.octet_length("text") <= huge_bytes).mapInArrow(released(_hash_rows), "id long, fp long, n long, sha string")
    huge = rows.filter(F.octet_length("text") > huge_bytes).withColumn("sha", text_sha(F.col("text")))
    step = 1 << 20
    parts = (
        huge.dropDuplicates(["sha"])
        .withColumn("k", F.explode(F.expr(f"sequence(0L, cast((octet_length(text) - 1) div {step} as bigint))")))
        .select("sha", "k", F.substring(F.encode("text", "utf-8"), F.col("k").cast("int") * step + 1, F.lit(step)).alias("part"))
        .repartition("sha", "k")
        .mapInArrow(released(_chunk_rows), "sha string, k long, h1 long, h2 long, size long")
    )
    folded = parts.groupBy("sha").applyInPandas(_fold_chunks, "sha string, fp long, n long")
    return small.unionByName(huge.select("id", "sha").join(folded, "sha").select("id", "fp", "n", "sha"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by class and salt, the representative first; the members with twin, their digest if they differ from it."""
    key, rep = None, b""
    for b in batches:
        out = []
        for fp, n, salt, later, i, sha, text in zip(*(b.column(k).to_pylist() for k in range(6)), b.column(6), strict=True):
            low = LOWER[np.frombuffer(text.as_buffer(), dtype=np.uint8)] if n else np.zeros(0, np.uint8)
            if not later:
                key, rep = (fp, n, salt), low
                continue
            if key != (fp, n, salt):
                raise ValueError("a member came without its representative")
            differs = any(not np.array_equal(rep[k : k + CHUNK], low[k : k + CHUNK]) for k in range(0, n, CHUNK))
            out.append((i, fp, n, sha, sha if differs else ""))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "fp", "n", "sha", "twin"])


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE, members: int = MEMBERS) -> DataFrame:
    """id, keep_id (largest id of the class), group_size, sha. ``members``: of a class, about as many are compared in one stream."""
    prints = stored(fingerprint(df, id_col, text_col, huge_bytes), "prints")
    # of each fingerprint that several rows have, a row that represents it, and the digests it comes with
    groups = stored(prints.groupBy("fp", "n").agg(F.max(F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("i"), "sha")).alias("rep"), F.count("*").alias("size")).filter("size > 1"), "groups", True)
    found = stored(prints.join(groups.hint("merge"), ["fp", "n"]).select("fp", "n", "sha", "rep", "size").distinct(), "digests", True)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_sha(F.col(text_col)).alias("sha"))
    salts = F.ceil(F.col("size") / members).cast("int")
    member = F.array(F.struct(F.lit(True).alias("later"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt")))
    head = F.transform(F.sequence(F.lit(0), salts - 1), lambda k: F.struct(F.lit(False).alias("later"), k.alias("salt")))
    own = F.col("rep") == F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("i"), "sha")
    # members and representatives meet their texts; representatives go to each salt of their class besides
    rows = texts.join(found.hint("merge"), "sha").withColumn("x", F.explode(F.when(own, F.concat(member, head)).otherwise(member)))
    checked = (
        rows.select("fp", "n", F.col("x.salt").alias("salt"), F.col("x.later").alias("later"), "id", "sha", F.col("text").cast("binary").alias("text"))
        .repartition("fp", "n", "salt")
        .sortWithinPartitions("fp", "n", "salt", "later")
        .mapInArrow(released(_compare), "id long, fp long, n long, sha string, twin string")
    )
    checked = stored(checked, "checked")
    final = stored(checked.groupBy("fp", "n", "twin").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "classes", True)
    several = checked.join(final.hint("merge"), ["fp", "n", "twin"]).select("id", "keep_id", "group_size", "sha")
    alone = prints.join(groups.select("fp", "n").hint("merge"), ["fp", "n"], "left_anti")
    return several.unionByName(alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
