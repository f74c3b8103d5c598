"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors); every valid vector is then assigned to a leaf by going down to
the nearest child. A query visits leaves best-bin-first: a priority queue holds nodes by their centroid's similarity, and the
best one is opened next. How many leaves are visited is widened until ``probes`` vectors of the sample find ``recall`` of their
true neighbours, which a pass over the whole table determines. Leaves are searched as blocks of at most ``BLOCK``
vectors; each leaf is dealt to as many tasks as its share of the table fills, so one with very many vectors is shared among them. The
tree has a bounded number of leaves, so the work grows with queries times the share of the table that the recall asks for.

Similarity is the cosine in double precision. Cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components, or have no id, take no part; equal similarities go to the smaller id; a query is not its own neighbour,
yet equal vectors in other rows are, under its own id too: rows are told apart by number, and each row that is asked has a list of its own; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import mix
from .shared import stored

SAMPLE, LEAF, BRANCH, BLOCK, PROBES = 20_000, 200, 8, 1024, 96


def valid(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id and v (doubles) of the vectors that take part, and their length."""
    v = F.col(vec_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(good & F.col("id").isNotNull())
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.filter(F.size("v") == size["n"]), size["n"]) if size else (rows, 0)


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), dim)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


@dataclass
class Tree:
    centre: np.ndarray
    children: list[list[int]]
    leaf: dict[int, int] = field(default_factory=dict)  # node -> number of its leaf
    share: list[float] = field(default_factory=list)  # of the sample, by leaf
    visits: int = 1
    parts: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))  # tasks that each leaf's vectors are dealt to

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of unit vectors."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            best = (x[rows] @ self.centre[kids].T).argmax(axis=1)
            todo += [(kid, rows[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def order(self, near: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order; near: similarity of the query to each node's centre."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-near[kid], kid))
            else:
                out.append(self.leaf[node])
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else x[rng.integers(len(x))] for j in range(k)])
        c = unit(np.where(np.abs(sums).max(axis=1, keepdims=True) > 0, sums, c))
    return c


def build(x: np.ndarray, per_leaf: float, branch: int = BRANCH, seed: int = 5) -> Tree:
    """Tree over unit vectors; leaves hold about per_leaf of them."""
    rng = np.random.default_rng(seed)
    centres, children, tree = [unit(x.mean(axis=0, keepdims=True) + 1e-12)[0]], [[]], None
    held, todo = {0: np.arange(len(x))}, [0]
    while todo:
        node = todo.pop()
        rows = held[node]
        if len(rows) <= per_leaf or len(rows) < 2 * branch:
            continue
        c = kmeans(x[rows], min(branch, max(2, round(len(rows) / per_leaf))), rng)
        own = (x[rows] @ c.T).argmax(axis=1)
        parts = [(j, rows[own == j]) for j in range(len(c)) if (own == j).any()]
        if len(parts) < 2:
            continue
        del held[node]
        for j, part in parts:
            centres.append(c[j])
            children.append([])
            children[node].append(len(children) - 1)
            held[len(children) - 1] = part
            todo.append(len(children) - 1)
    tree = Tree(np.array(centres), children)
    for node in sorted(held):
        tree.leaf[node] = len(tree.leaf)
        tree.share.append(len(held[node]) / len(x))
    return tree


def best(ids: np.ndarray, x: np.ndarray, other: np.ndarray, q: np.ndarray, near: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k nearest of a block, scored on the original vectors. other: which are not the query itself; near: their similarities but for rounding."""
    ok = np.flatnonzero(other)
    if len(ok) > k:
        cut = np.partition(near[ok], len(ok) - k)[len(ok) - k]
        ok = ok[near[ok] >= cut - 1e-9]
    y = x[ok]
    score = (y * q).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((q * q).sum()))
    pick = np.lexsort((ids[ok], -score))[:k]
    return list(zip(ids[ok][pick].tolist(), score[pick].tolist(), strict=True))


def fit(rows: DataFrame, dim: int, k: int, recall: float, probes: int = PROBES, sample: int = SAMPLE) -> Tree | None:
    n = rows.count()
    most = max(1, min(sample, 8_000_000 // max(dim, 1)))
    got = sorted(rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, most / max(n, 1))))).collect())
    if not got:
        got = rows.limit(most).collect()
    if not got:
        return None
    ids, raw = np.array([r["id"] for r in got]), np.array([r["v"] for r in got], dtype=np.float64)
    x = unit(raw)
    tree = build(x, max(LEAF * len(x) / n, 12))
    tree.parts = np.maximum(1, np.ceil(np.array(tree.share) * n / (8 * BLOCK))).astype(np.int64)
    pick = np.random.default_rng(3).choice(len(x), min(probes, len(x)), replace=False)
    sc = rows.sparkSession.sparkContext
    shared, asked = sc.broadcast(tree), sc.broadcast((ids[pick], raw[pick]))  # both bounded by the sample

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = asked.value
        for b in batches:
            own, y = b.column(0).to_numpy(), matrix(b.column(1), dim)
            u = unit(y)
            near, leaf = unit(q) @ u.T, shared.value.assign(u)
            at = dict(zip(own.tolist(), leaf.tolist(), strict=True))
            out = [(j, i, s, at[i]) for j in range(len(qid)) for i, s in best(own, y, own != qid[j], q[j], near[j], k)]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["j", "id", "score", "leaf"])

    w = Window.partitionBy("j").orderBy(F.desc("score"), "id")
    found = rows.mapInArrow(truth, "j int, id long, score double, leaf int").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).collect()
    near = x[pick] @ tree.centre.T
    order = [{leaf: r for r, leaf in enumerate(tree.order(near[j], len(tree.leaf)))} for j in range(len(pick))]
    ranks = np.sort([order[r["j"]][r["leaf"]] + 1 for r in found]) if found else np.ones(1)
    tree.visits = int(min(len(tree.leaf), np.ceil(1.15 * ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))])))
    return tree


def _packed(rows: DataFrame, by: list[Column], most: int, dim: int, kind: str) -> DataFrame:
    """Blocks (leaf, row numbers and ids, vectors) of at most ``most`` rows of one leaf. rows: leaf, id, v, row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, ids, vecs = None, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([np.array(ids, dtype=np.int64).tobytes()]), pa.array([np.concatenate(vecs).tobytes()])], names=["leaf", f"{kind}_ids", kind])

        for b in batches:
            x = matrix(b.column(2), dim)
            for j, (own, *i) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 3, 1)), strict=True)):
                if ids and (own != leaf or len(ids) == most):
                    yield block()
                    ids, vecs = [], []
                leaf = own
                ids.append(i)
                vecs.append(x[j])
        if ids:
            yield block()

    return rows.repartition(*by).sortWithinPartitions("leaf").mapInArrow(run, f"leaf int, {kind}_ids binary, {kind} binary")


def search(df: DataFrame, queries: Column, k: int = 5, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score. queries: a condition on column ``id``."""
    rows, dim = valid(df, id_col, vec_col)
    tree = fit(rows, dim, k, recall) if dim else None
    if tree is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.assign(unit(matrix(b.column(1), dim)))
            part = mix(b.column(0).to_numpy().astype(np.uint64)) % shared.value.parts[leaf].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *b.columns, pa.array(part.astype(np.int32))], names=["leaf", "id", "v", "row", "part"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            near = unit(matrix(b.column(1), dim)) @ t.centre.T
            order = [t.order(x, t.visits) for x in near]
            take = np.repeat(np.arange(len(order)), [len(o) for o in order])
            yield pa.RecordBatch.from_arrays([pa.array([x for o in order for x in o], pa.int32()), *(c.take(pa.array(take)) for c in b.columns)], names=["leaf", "id", "v", "row"])

    def nearest(row: np.ndarray, q: np.ndarray, i: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best of each query."""
        by = np.lexsort((i, -score, row))
        row, q, i, score = row[by], q[by], i[by], score[by]
        first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
        keep = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) < k
        return row[keep], q[keep], i[keep], score[keep]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0))
        new: list[tuple] = []

        def rows_() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["row", "query_id", "id", "score"])

        for b in batches:
            for qi, qv, mi, mv in zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True):
                asked, ids = np.frombuffer(qi, np.int64).reshape(-1, 2), np.frombuffer(mi, np.int64).reshape(-1, 2)
                q, y = np.frombuffer(qv).reshape(-1, dim), np.frombuffer(mv).reshape(-1, dim)
                near = unit(q) @ unit(y).T
                new += [(row, qid, i, s) for j, (row, qid) in enumerate(asked.tolist()) for i, s in best(ids[:, 1], y, ids[:, 0] != row, q[j], near[j], k)]
                if len(new) > 1 << 16:
                    held = nearest(*(np.concatenate([a, np.array(c, dtype=a.dtype)]) for a, c in zip(held, zip(*new, strict=True), strict=True)))
                    new = []
                    if len(held[0]) > 1 << 20:  # too many queries to keep in one task
                        yield rows_()
                        held = tuple(a[:0] for a in held)
        if new:
            held = nearest(*(np.concatenate([a, np.array(c, dtype=a.dtype)]) for a, c in zip(held, zip(*new, strict=True), strict=True)))
        yield rows_()

    kind = "leaf int, id long, v array<double>, row long"
    # a row is known by its number, as ids may repeat; the same scan numbers rows alike each time
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    members = _packed(numbered.mapInArrow(assign, kind + ", part int"), [F.col("leaf"), F.col("part")], BLOCK, dim, "m")
    asked = _packed(numbered.filter(queries).mapInArrow(visit, kind), [F.col("leaf"), F.pmod(F.xxhash64("id"), F.lit(4))], BLOCK // 4, dim, "q")
    pairs = asked.join(stored(members, "leaves"), "leaf").select("leaf", "q_ids", "q", "m_ids", "m")
    found = pairs.mapInArrow(compare, "row long, query_id long, id long, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
