"""N-gram Jaccard join as a metric-space join: pivots, regions, triangle-inequality windows, recursion; exact.

A document's set of word shingles has the Jaccard distance to other sets; linked documents are within 0.2 of each other.
Most documents share nothing and are at distance 1 from any pivot, where no window could part them, so a pre-partition comes
first: a set lies in the cells of its ``prefix``, the n - ceil(0.8 n) + 1 first of its shingles in one global order (those in
many documents last, then by hash). Linked sets have their first common shingle in both prefixes, at places early enough
for what precedes them, so each linked pair meets in a cell where both places allow a link.

Each cell has its member of the smallest hash as its pivot, and a pivot's region is what lies in its cells: documents
between pivots are in the regions of all of them. In a region a parity bitmap of each set comes first (the number of bits that
differ bounds the symmetric difference from below); only documents with a possible partner go on with their sets. There
the join recurses: some members far apart become pivots, those within 0.2 of one join its class, every member goes to the
Voronoi region of its nearest pivot and, if it is at most 0.4 farther from another pivot, to that one's too, since a partner
may have that one as its nearest. Regions whose members are all of one class are closed. Where regions overlap too much
to shrink, the members outside the largest class meet the others one by one, and only those that are within 0.2
in their distances from all pivots. A region returns at most one link for each member, so a group of n near copies makes n rows.

Regions too large for one task (``MOST`` shingles) are dealt out in blocks after a round of pivots: blocks whose members are all
linked to the same pivot do not meet.

Documents with equal sets are one from the start. Each result row carries its class, the smallest id reachable by links.

Cases: null and empty texts, and texts of white space, have no set and are alone; fewer than five words make one shingle; an
id that occurs twice counts as one document; rows without an id link with nothing; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import mix, shingle_sets
from .shared import released, stored

SHINGLE, PERCENT = 5, 80
COUNTED, HEAVY_SEEN, HEAVY = 0.3, 8, 400_000  # share of hashes that are counted, the lowest; of those at most HEAVY come last
MOST = 4 << 20  # shingles of the members of a region that one task takes
ROW = 128  # what a member counts besides its shingles
LEAF, PIVOTS = 32, 8
SET = "r long, u long, id long, n long, set binary"


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def heavy_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """At most HEAVY shingles that occur in many documents, of the lower hashes, which prefixes are made of; they only make the order better."""
    below = np.uint64(int(COUNTED * 2**64))

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for s in shingle_sets(b.column(0), size):
                held.append(s[: np.searchsorted(s, below)])
                n += len(held[-1])
                if n > 1 << 20:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    often = stored(rows.select("text").mapInArrow(released(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= HEAVY_SEEN), "heavy")
    # from the highest counts down, as many levels as HEAVY allows
    level, least, total = F.floor(F.log2("c") * 16).cast("int"), None, 0
    for r in sorted(often.groupBy(level.alias("l")).count().collect(), reverse=True):
        total += r["count"]
        if total > HEAVY:
            break
        least = r["l"]
    top = often.filter(level >= least).select("h").toPandas()["h"] if least is not None else []
    return np.sort(np.array(top, dtype=np.int64).view(np.uint64))


def name_of(s: np.ndarray) -> int:
    """A hash of a whole set."""
    x = s.sum(dtype=np.uint64) + mix(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15), keepdims=True)) + np.uint64(len(s))
    return int(mix(x).view(np.int64)[0])


def second_of(s: np.ndarray) -> int:
    """Another hash of a whole set."""
    x = mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([x], dtype=np.uint64)).view(np.int64)[0])


def told_as(s: np.ndarray, shared: dict[int, int], bits: int = 64) -> int:
    """The name of a set: its hash, or where sets share that one (shared: the second hash of one of them), for the others a hash of their second one. bits: of the first hash, fewer than 64 in tests."""
    u = name_of(s) >> (64 - bits)
    if u in shared and (other := second_of(s)) != shared[u]:
        u = int(mix(np.array([u, other], dtype=np.int64).view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
    return u


def parity(s: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of the set's hashes fall on them; four bits a hash at least, in 64-bit words."""
    size = 512
    while size < 4 * len(s):
        size *= 2
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little")


def prefixes(rows: DataFrame, size: int, percent: int, heavy, shared: dict[int, int], bits_: int) -> DataFrame:
    """id, n, u (the name of the set), second (another hash of it), keys (the prefix in order), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = heavy.value
        for b in batches:
            n, name, second, keys, bits = [], [], [], [], []
            for s in shingle_sets(b.column(1), size):
                p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if p and len(often):
                    hit = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    first = np.concatenate([s[~hit][:p], s[hit][:p]])[:p]
                else:
                    first = s[:p]
                n.append(len(s))
                name.append(told_as(s, shared, bits_) if len(s) else 0)
                second.append(second_of(s) if len(s) else 0)
                keys.append(first.view(np.int64))
                bits.append(parity(s).tobytes() if len(s) else b"")
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64())), pa.array(bits, pa.binary())], names=["id", "n", "u", "second", "keys", "bits"])

    return rows.mapInArrow(released(run), "id long, n long, u long, second long, keys array<long>, bits binary")


def grouped(batches: Iterator[pa.RecordBatch], work: Callable[[list[tuple]], list[tuple]], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each group; rows come sorted by their first column, the group, then by the second."""
    held: list[tuple] = []
    out: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(kind), kind.types, strict=True)], schema=kind)
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                out += work(held)
                held = []
                if len(out) > 1 << 16:
                    yield made()
                    out = []
            if not held or held[-1][1] != row[1]:  # a repeated row counts once
                held.append(row)
    if held:
        out += work(held)
    yield made()


def possible(n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which sets have a possible partner: sizes and bitmaps allow a link with another one."""
    order = np.argsort(n, kind="stable")
    n = n[order]
    found = np.zeros(len(n), dtype=bool)
    words = [np.frombuffer(bits[k], dtype=np.uint64) for k in order]
    width = np.array([len(w) for w in words])
    least = lambda x, k: x if len(x) == k else least(x[: len(x) // 2] ^ x[len(x) // 2 :], k)
    at = 0
    while at < len(n):
        # rows of one width, against the same and the next one folded to it: sizes of partners are within a factor of two
        past = int(np.searchsorted(width, width[at], "right"))
        upto = int(np.searchsorted(n, n[past - 1] * 100 // percent, "right"))
        table = np.stack([least(w, int(width[at])) for w in words[at:upto]])
        step = max(1, (1 << 20) // table.size)
        for i in range(0, past - at, step):
            a = table[i : min(i + step, past - at)]
            own = n[at + i : at + i + len(a)]
            last = int(np.searchsorted(n, own[-1] * 100 // percent, "right"))
            b, m = table[i : last - at], n[at + i : last]
            differ = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2, dtype=np.int64)
            ok = differ * (100 + percent) <= (own[:, None] + m[None]) * (100 - percent)
            ok &= m[None] * percent <= own[:, None] * 100
            ok &= np.arange(len(b))[None] > np.arange(len(a))[:, None]
            found[at + i : at + i + len(a)] |= ok.any(axis=1)
            found[at + i : last] |= ok.any(axis=0)
        at = past
    out = np.zeros_like(found)
    out[order] = found
    return out


class Region:
    """Sets that may be linked; ``links`` after ``settle`` is a forest whose trees are their classes."""

    def __init__(self, sets: list[np.ndarray], percent: int, kind: list[int | None] | None = None):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.cut = np.concatenate([[0], np.cumsum(self.n)])
        self.mark = np.zeros(int(self.code.max()) + 1, dtype=bool)
        self.percent, self.reach = percent, 1 - percent / 100
        self.own = np.arange(len(sets))  # the class of each
        if kind:  # those of one kind are known to be linked
            first = {g: k for k, g in reversed(list(enumerate(kind)))}
            self.own = np.array([k if g is None else first[g] for k, g in enumerate(kind)])
        self.links: list[tuple[int, int]] = []

    def meet(self, q: int, who: np.ndarray) -> np.ndarray:
        """Distances of ``who`` from q; linked ones join its class."""
        mine = self.code[self.cut[q] : self.cut[q + 1]]
        self.mark[mine] = True
        parts = np.concatenate([self.code[self.cut[k] : self.cut[k + 1]] for k in who.tolist()])
        both = np.add.reduceat(self.mark[parts], np.concatenate([[0], np.cumsum(self.n[who])[:-1]]), dtype=np.int64)
        self.mark[mine] = False
        either = self.n[q] + self.n[who] - both
        for k in who[100 * both >= self.percent * either].tolist():
            if self.own[k] != self.own[q]:
                self.own[self.own == self.own[k]] = self.own[q]
                self.links.append((q, k))
        return 1 - both / either

    def settle(self, who: np.ndarray) -> None:
        far: list[np.ndarray] = []
        if len(who) > LEAF:
            q = 0
            for _ in range(PIVOTS):
                far.append(self.meet(int(who[q]), who))
                q = int(np.min(far, axis=0).argmax())
            d = np.stack(far, axis=1)
            into = d <= d.min(axis=1, keepdims=True) + 2 * self.reach + 1e-9
            if into.sum() <= 1.5 * len(who):
                for j in range(PIVOTS):
                    part = who[into[:, j]]
                    if len(part) > 1 and (self.own[part] != self.own[part[0]]).any():
                        self.settle(part)
                return
        # what pivots cannot part: those of small classes leave one by one, after meeting the others
        kinds, inverse, count = np.unique(self.own[who], return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return
        order = np.argsort(count[inverse], kind="stable")
        who = who[order]
        d = np.stack(far, axis=1)[order] if far else np.zeros((len(who), 1))
        for k in range(len(who) - 1):
            rest = np.arange(k + 1, len(who))
            q = int(who[k])
            if (self.own[who[rest]] == self.own[q]).all():
                return
            rest = rest[(self.own[who[rest]] != self.own[q]) & (np.abs(d[rest] - d[k]).max(axis=1) <= self.reach + 1e-9)]
            m = self.n[who[rest]]
            rest = rest[(np.minimum(m, self.n[q]) * 100 >= np.maximum(m, self.n[q]) * self.percent)]
            if len(rest):
                self.meet(q, who[rest])


def region_links(ids: list[int], sets: list[np.ndarray], percent: int, kind: list[int | None] | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that make the classes of a region's documents, one less than documents in each class."""
    r = Region(sets, percent, kind)
    r.settle(np.arange(len(sets)))
    return [(ids[a], ids[b]) for a, b in r.links]


def components(edges: DataFrame) -> DataFrame:
    """v, c: the smallest vertex that each vertex of the edges (a, b) is connected with. Edges are contracted in rounds."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    left = stored(both, "edges", True)
    label = stored(left.select(F.col("a").alias("v"), F.col("a").alias("c")).distinct(), "labels", True)
    while not left.isEmpty():
        up = stored(left.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "parents", True)
        top = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = up.join(top, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        label = stored(label.join(up.withColumnRenamed("a", "c"), "c", "left").select("v", F.coalesce("p", "c").alias("c")), "labels", True)
        ends = left.join(up, "a").select(F.col("p").alias("a"), F.col("b").alias("_b"))
        ends = ends.join(up.select(F.col("a").alias("_b"), F.col("p").alias("b")), "_b").select("a", "b")
        left = stored(ends.filter("a <> b").distinct(), "edges", True)
    return label


def _dealt(rows: DataFrame, most: int, kind: str | None = None) -> DataFrame:
    """``rows`` (r, n, u and more) with k, the task's part of their region; rows of a large region go to each pair of blocks.

    kind: a column that tells classes of linked rows; two blocks of one class do not meet. Regions of one row are left out."""
    rows = rows.withColumn("g", F.coalesce(F.col(kind), F.lit(-1)) if kind else F.lit(-1))
    size = rows.groupBy("r", "g").agg(F.sum(F.col("n") + ROW).alias("w"), F.count("*").alias("m"))
    blocks = F.collect_list(F.struct("g", F.ceil(F.col("w") * 2 / most).cast("int").alias("b")))  # PIVOTS + 1 at most
    size = size.groupBy("r").agg(F.sum("w").alias("w"), F.sum("m").alias("m"), blocks.alias("blocks")).filter("m > 1")
    rows = rows.join(size.hint("merge"), "r")
    many = F.filter("blocks", lambda x: x["g"] == F.col("g"))[0]["b"]
    every = F.flatten(F.transform("blocks", lambda x: F.transform(F.sequence(F.lit(0), x["b"] - 1), lambda i: F.struct(x["g"].alias("g"), i.alias("i")))))
    rows = rows.withColumn("many", many).withColumn("own", F.struct("g", F.pmod(F.xxhash64("u"), many).cast("int").alias("i")))
    # rows of no class meet those of their own block in each pair, or, if that is the only one, by themselves
    meets = lambda x: (x["g"] != F.col("g")) | ((F.col("g") == -1) & ((x["i"] != F.col("own.i")) | (F.col("many") == 1)))
    pair = F.transform(F.filter(every, meets), lambda x: F.xxhash64("r", F.least(x, F.col("own")), F.greatest(x, F.col("own"))))
    return rows.withColumn("k", F.explode(F.when(F.col("w") <= most, F.array("r")).otherwise(pair))).drop("w", "m", "blocks", "many", "own", "g")


def _sets(rows: DataFrame, wanted: DataFrame, size: int, shared: dict[int, int], bits: int) -> DataFrame:
    """wanted: id, u and the regions rs. A row (r, u, id, n, set) for each region of each document."""
    names, kinds = ["r", "u", "id", "n", "set"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for i, u, rs, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), shingle_sets(b.column(1), size), strict=True):
                if len(s) and told_as(s, shared, bits) == u:  # another text may have the same id
                    raw = s.tobytes()
                    for r in rs:
                        out.append((r, u, i, len(s), raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.join(wanted.hint("merge"), "id").select("id", "text", "u", "rs").mapInArrow(released(run), SET)


def _pivoted(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Rows of large regions with ``to``, those of up to PIVOTS members that they are linked with, and g, a class of such pivots."""
    picks = [F.min(F.when(F.pmod(F.xxhash64("u"), F.lit(PIVOTS)) == j, F.col("u"))) for j in range(PIVOTS)]
    large = sets.groupBy("r").agg(F.array_compact(F.array(*picks)).alias("pivots"), F.ceil(F.sum("n") * 2 / most).cast("int").alias("parts"))
    pivot = F.array_contains("pivots", F.col("u"))
    part = F.pmod(F.xxhash64("u", F.lit(1)), F.col("parts")).cast("int")
    rows = sets.join(large.hint("merge"), "r").withColumn("part", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    rows = rows.select(F.xxhash64("r", "part").alias("k"), (~pivot).alias("later"), "u", "r", "part", "id", "n", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, root = None, [], []
        for b in batches:
            out = []
            for k, later, u, r, part, i, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != k:
                    key, heads, root = k, [], []
                s = np.frombuffer(raw, np.uint64)
                linked = []
                for j, (_, h) in enumerate(heads):
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    if 100 * both >= percent * (len(h) + len(s) - both):
                        linked.append(j)
                if not later:
                    joined = {root[j] for j in linked}
                    heads.append((i, s))
                    root = [len(root) if x in joined else x for x in root] + [len(root)]
                    if part:
                        continue
                out.append((r, u, i, n, raw, [heads[j][0] for j in linked], root[linked[0]] if linked else None))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["r", "u", "id", "n", "set", "to", "g"])

    return rows.repartition("k").sortWithinPartitions("k", "later", "u").mapInArrow(released(run), SET + ", to array<long>, g int")


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, most: int = MOST, name_bits: int = 64) -> DataFrame:
    """id, n_shingles, component_id of every row. name_bits: of the hash that names a set; sets that share a name are told apart by a second hash."""
    spark = df.sparkSession
    rows = _texts(df, id_col, text_col)
    heavy = spark.sparkContext.broadcast(heavy_shingles(rows, size))  # HEAVY entries at most
    first = stored(prefixes(rows, size, percent, heavy, {}, name_bits), "prefixes")
    # of n sets about n * n / 2**65 pairs share a 64-bit name; then names are given once more
    names = first.filter("n > 0").groupBy("u").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b")
    shared = {r["u"]: r["a"] for r in names.collect()}
    if shared:
        first = stored(prefixes(rows, size, percent, heavy, shared, name_bits), "prefixes")
    same = stored(first.filter("n > 0 and id is not null").groupBy("u").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "sets")

    # cells of more than one document; two places allow a link if their t add up to 0 at most
    places = same.select("u", "n", F.posexplode("keys").alias("pos", "key")).select("key", "u", "n", (F.col("pos") * (100 + percent) - F.col("n") * (100 - percent)).alias("t"))
    multi = places.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    cells = stored(places.join(multi.hint("merge"), "key"), "cells")
    each = cells.groupBy("key").agg(F.min("u").alias("r"), F.min("t").alias("lo"), F.count("*").alias("m"), F.sum("t").alias("both"), F.min("n").alias("a"), F.max("n").alias("z"))
    each = each.filter((F.col("lo") <= 0) & ((F.col("m") > 2) | ((F.col("both") <= 0) & (F.col("z") * percent <= F.col("a") * 100))))
    members = stored(cells.join(each.hint("merge"), "key").filter(F.col("t") + F.col("lo") <= 0).select("r", "u", "n").distinct(), "members", True)

    # bitmaps: which members have a possible partner in their region
    def alive(held: list[tuple]) -> list[tuple]:
        ok = possible(np.array([x[3] for x in held]), [x[4] for x in held], percent)
        return [(x[2], x[1], x[3]) for x, keep in zip(held, ok.tolist(), strict=True) if keep]

    schema = pa.schema([("r", pa.int64()), ("u", pa.int64()), ("n", pa.int64())])
    near = _dealt(members, most).join(same.select("u", "bits").hint("merge"), "u").select("k", "u", "r", "n", "bits").repartition("k").sortWithinPartitions("k", "u")
    live = stored(near.mapInArrow(released(lambda batches: grouped(batches, alive, schema)), "r long, u long, n long").distinct(), "live", True)

    # sets, and links that make classes
    def links(held: list[tuple]) -> list[tuple]:
        return region_links([x[2] for x in held], [np.frombuffer(x[3], np.uint64) for x in held], percent, [x[4] for x in held] if len(held[0]) > 4 else None)

    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    linked = lambda x: x.sortWithinPartitions(x.columns[0], "u").mapInArrow(released(lambda batches: grouped(batches, links, pair)), "a long, b long")
    wanted = live.groupBy("u").agg(F.collect_list("r").alias("rs")).join(same.select("u", "id").hint("merge"), "u").select("id", "u", "rs")
    sets = _sets(rows, wanted, size, shared, name_bits)
    large = stored(live.groupBy("r").agg(F.sum(F.col("n") + ROW).alias("w")).filter(F.col("w") > most).select("r"), "large", True)
    if large.isEmpty():
        edges = linked(sets.select("r", "u", "id", "set").repartition("r"))
    else:
        sets = stored(sets, "wholes")
        some = stored(_pivoted(sets.join(large, "r", "left_semi"), most, percent), "pivoted")
        edges = linked(sets.join(large, "r", "left_anti").select("r", "u", "id", "set").repartition("r"))
        edges = edges.unionByName(some.select(F.col("id").alias("a"), F.explode("to").alias("b")))
        edges = edges.unionByName(linked(_dealt(some.drop("to").withColumnRenamed("g", "kind"), most, "kind").select("k", "u", "id", "set", "kind").repartition("k")))
    label = components(stored(edges, "links", True))

    # one join back to the rows, by a table of its own, so that a set that very many rows have can be split
    named = same.select("u", F.col("id").alias("v")).join(label.hint("merge"), "v", "left").select("u", F.coalesce("c", "v").alias("c"))
    out = first.filter("n > 0").select("id", "n", "u").join(stored(named, "classes").hint("merge"), "u", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("c")).alias("component_id"))
    return out.unionByName(first.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
