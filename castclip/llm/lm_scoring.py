"""Language-model scoring: a gated recurrent network in numpy with a class-factored softmax.

Counts of every training word are kept in a table. The network predicts the ``SYMBOLS``: the end of a text, the most
frequent words, and ``GROUPS`` groups of all other words (by their last two bytes); a word of a group then has its share
(c + 0.5) of the group's counts, where each group keeps 0.5 for words never seen. The output is factored: first a class of
``CLASS`` symbols, then the symbol within it.

Training is data-parallel over all training texts: in each of ``TURNS`` turns every task starts from the same weights, runs
truncated backpropagation over its texts of that turn (windows of ``WINDOW`` words, the state carried from window to window
within pieces of ``PIECE`` words and emptied where a longer text is cut), and the tasks' weights are averaged by their tokens, in two
levels and as streams, so that no task holds the weights of many. Scoring carries the state through whole texts, without cuts, in memory
in proportion to its words.

Counts of at most ``NEAR`` words are sent to all tasks; the other words of a text are joined with the count table.

Cases: null and empty texts have one token, the end; white space makes no token; a word never seen gets its group's share; without
training rows every token's base is log10(0.5 / 0.5 (V + 1)) with V = 0, and the network is untrained; rows are told apart by id
and text, so ids may repeat or be null, and equal rows get equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, per_text, slices, word_hashes
from .shared import stored, told_apart

CLASS, CLASSES, GROUPS, HIDDEN = 64, 32, 64, 16
SYMBOLS = CLASS * CLASSES
WORDS = SYMBOLS - GROUPS - 1
NEAR = 1 << 18
TURNS, WINDOW, LANES, PIECE = 3, 16, 256, 1024
BLOCKS, SUMS = 16, 256  # parts of the weights, and how many sums of each are made before the last one


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, group and text of every word."""
    h, s, e, doc = word_hashes(data, offs)
    last = LOWER[data[e - 1]].astype(np.int64)
    before = LOWER[data[np.maximum(e - 2, s)]].astype(np.int64)
    return h, ((last * 31 + before * 7) % GROUPS).astype(np.int16), doc


def word_counts(rows: DataFrame) -> DataFrame:
    """h, g, c: how often each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offs in slices(b.column(0), 8 << 20):
                h, g, _ = tokens(data, offs)
                word, first, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(g[first].astype(np.int32)), pa.array(c)], names=["h", "g", "c"])

    return rows.select("text").mapInArrow(run, "h long, g int, c long").groupBy("h").agg(F.first("g").alias("g"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    word: np.ndarray  # sorted hashes of the NEAR most frequent words
    count: np.ndarray
    symbol: np.ndarray  # of those words; -1 for a word that belongs to its group
    share: np.ndarray  # log10 of each group's counts
    total: int
    kinds: int


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most ``most`` of them reach; found from a histogram by sixteenths of a doubling."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = sorted(counts.groupBy(level.alias("l")).count().collect(), reverse=True)  # some hundred rows
    total, least = 0, None
    for r in levels:
        total += r["count"]
        if total > most:
            break
        least = r["l"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    near = frequent(counts, NEAR).toPandas().sort_values(["c", "h"], ascending=[False, True])  # bounded by NEAR
    word, group, count = near["h"].to_numpy(np.int64).view(np.uint64), near["g"].to_numpy(np.int64), near["c"].to_numpy(np.int64)
    sums = {r["g"]: (r["c"], r["n"]) for r in counts.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    share = np.array([sums.get(g, (0, 0))[0] + 0.5 * sums.get(g, (0, 0))[1] + 0.5 for g in range(GROUPS)])
    top = min(WORDS, len(word))
    np.subtract.at(share, group[:top], count[:top] + 0.5)
    symbol = np.full(len(word), -1, dtype=np.int16)
    symbol[:top] = np.arange(1, top + 1)
    by = np.argsort(word)
    return Vocabulary(word[by], count[by], symbol[by], np.log10(np.maximum(share, 0.5)), sum(c for c, _ in sums.values()) + ends, sum(n for _, n in sums.values()) + (1 if ends else 0))


def look_up(v: Vocabulary, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word among the near ones, or -1, and its symbol."""
    if not len(v.word):
        return np.full(len(h), -1), (WORDS + 1 + g).astype(np.int16)
    i = np.minimum(np.searchsorted(v.word, h), len(v.word) - 1)
    i = np.where(v.word[i] == h, i, -1)
    s = np.where(i >= 0, v.symbol[i], -1)
    return i, np.where(s >= 0, s, WORDS + 1 + g).astype(np.int16)


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


SHAPES = {"x": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (CLASSES, HIDDEN, CLASS), "bo": (CLASSES, CLASS)}


def start(seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [(rng.standard_normal(s) * (0.1 if k in "xu" else 0.05) * (k not in ("bc", "bo"))).ravel() for k, s in SHAPES.items()]
    return np.concatenate(parts).astype(np.float32)


def views(w: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = w[at : at + n].reshape(s)
        at += n
    return out


def states(p: dict, x: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states after each step of x (steps by lanes)."""
    n, kept = HIDDEN, []
    out = np.empty((len(x), len(h), n), dtype=np.float32)
    # gates take minus their argument, the new state minus twice its own
    gates, u = (p["x"] * SIGNS)[x], p["u"] * SIGNS
    with np.errstate(over="ignore"):
        for t in range(len(x)):
            if not x[t].all():  # the end symbol comes in where a text begins, from an empty state
                h = h * (x[t] != 0)[:, None]
            a = h @ u
            zr = _logistic(gates[t, :, : 2 * n] + a[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            m = a[:, 2 * n :] * r
            m += gates[t, :, 2 * n :]
            m = _logistic(m)
            m += m
            m -= 1
            if keep:
                kept.append((h, z, r, m, a[:, 2 * n :]))
            h = np.subtract(h, m, out=out[t])
            h *= z
            h += m
    return out, kept


SIGNS = np.repeat(np.array([-1, -1, -2], dtype=np.float32), HIDDEN)
#: Largest output weight; with states within -1 and 1 it bounds the logits, so that they need no shift.
MOST = np.float32(4)
ONES = np.ones(max(CLASS, CLASSES), dtype=np.float32)


def outputs(p: dict, h: np.ndarray, y: np.ndarray, d: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each symbol y after state h; with d, gradients of the negated sum go there and to the second result."""
    c = (y // CLASS).astype(np.uint8)
    by = np.argsort(c, kind="stable")
    h, c = h[by], c[by]
    k = y[by] % CLASS
    at = np.arange(len(y))

    def softmax(a: np.ndarray, own: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = a[own, pick]
        np.exp(a, out=a)
        s = a @ ONES[: a.shape[1]]
        if d is not None:
            a *= (1 / s)[:, None]
            a[own, pick] -= 1
        return chosen - np.log(s), a

    out, e = softmax(h @ p["wc"] + p["bc"], at, c)
    grad = None
    if d is not None:
        d["wc"] += h.T @ e
        d["bc"] += e.sum(axis=0)
        grad = e @ p["wc"].T
    cut = np.searchsorted(c, np.arange(CLASSES + 1))
    for j in range(CLASSES):
        i, o = cut[j], cut[j + 1]
        if i == o:
            continue
        part, e = softmax(h[i:o] @ p["wo"][j] + p["bo"][j], at[: o - i], k[i:o])
        out[i:o] += part
        if d is not None:
            d["wo"][j] += h[i:o].T @ e
            d["bo"][j] += e.sum(axis=0)
            grad[i:o] += e @ p["wo"][j].T
    result = np.empty_like(out)
    result[by] = out
    if d is None:
        return result, result
    back = np.empty_like(h)
    back[by] = grad
    return result, back


def streams(ids: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts laid one after another into ``width`` lanes of about one length.

    Symbols (steps + 1 by lanes; the row before a symbol has its input), which of them count, and of each text its lane, first and past-last step."""
    width = max(1, min(width, len(ids)))
    load = [(0, k) for k in range(width)]
    lane, first = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    held: list[list[np.ndarray]] = [[] for _ in range(width)]
    for j in sorted(range(len(ids)), key=lambda j: -len(ids[j])):
        n, k = heapq.heappop(load)
        lane[j], first[j] = k, n
        held[k].append(ids[j])
        heapq.heappush(load, (n + len(ids[j]), k))
    # the fullest lanes come first, so that those still running are always the first ones
    order = [k for _, k in sorted(load, key=lambda x: (-x[0], x[1]))]
    lane = np.argsort(order)[lane]
    held = [held[k] for k in order]
    steps = max(n for n, _ in load)
    table, real = np.zeros((width, steps + 1), dtype=np.int16), np.zeros((width, steps), dtype=bool)
    for k, parts in enumerate(held):
        row = np.concatenate(parts)
        table[k, 1 : len(row) + 1] = row
        real[k, : len(row)] = True
    return np.ascontiguousarray(table.T), np.ascontiguousarray(real.T), lane, first, first + np.array([len(x) for x in ids])


def train(w: np.ndarray, seen: np.ndarray, ids: list[np.ndarray], rate: float = 0.1) -> int:
    """Truncated backpropagation over the texts, in place, by Adagrad (seen: its sums of squares); tokens used."""
    p, s = views(w), views(seen)
    used, n = 0, HIDDEN
    if not ids:
        return 0
    # texts train in pieces, so that the lanes end together; a mark between pieces is no target, and as an input it empties the state
    cut = np.array([-1], dtype=np.int16)
    pieces = [np.append(x[k : k + PIECE], cut) if k + PIECE < len(x) else x[k : k + PIECE] for x in ids for k in range(0, len(x), PIECE)]
    table, valid, *_ = streams(pieces, LANES)
    valid &= table[1:] >= 0
    np.maximum(table, 0, out=table)
    h = np.zeros((table.shape[1], n), dtype=np.float32)
    for at0 in range(0, len(valid), WINDOW):
        real = valid[at0 : at0 + WINDOW]
        some = np.flatnonzero(real.any(axis=0))
        if not len(some):
            continue
        live = int(some[-1]) + 1
        real, h = real[:, :live], h[:live]
        x, y = table[at0 : at0 + len(real), :live], table[at0 + 1 : at0 + 1 + len(real), :live]
        hs, kept = states(p, x, h, True)
        grads = np.zeros(len(w) - p["x"].size, dtype=np.float32)
        d, at = {}, 0
        for k, shape in list(SHAPES.items())[1:]:
            size = int(np.prod(shape))
            d[k] = grads[at : at + size].reshape(shape)
            at += size
        flat = np.flatnonzero(real.ravel())
        _, back = outputs(p, hs.reshape(-1, n)[flat], y.ravel()[flat], d)
        dh_out = np.zeros((x.size, n), dtype=np.float32)
        dh_out[flat] = back
        dh_out = dh_out.reshape(len(x), live, n)
        dh = np.zeros((live, n), dtype=np.float32)
        dg, da, before = np.empty((len(x), live, 3 * n), np.float32), np.empty((len(x), live, 3 * n), np.float32), np.empty((len(x), live, n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            prev, z, r, m, hn = kept[t]
            dh = dh + dh_out[t]
            dm = dh * (1 - z) * (1 - m * m)
            dg[t, :, :n] = dh * (prev - m) * z * (1 - z)
            dg[t, :, n : 2 * n] = dm * hn * r * (1 - r) * np.float32(-0.5)
            dg[t, :, 2 * n :] = dm
            da[t, :, : 2 * n] = dg[t, :, : 2 * n]
            da[t, :, 2 * n :] = dm * r
            before[t] = prev
            dh = dh * z + da[t] @ p["u"].T
            if not x[t].all():
                dh *= (x[t] != 0)[:, None]
        d["u"] += before.reshape(-1, n).T @ da.reshape(-1, 3 * n)
        scale = np.float32(1 / max(1, len(flat)))
        # the input table: only the rows that occur
        sym = x.ravel()
        by = np.argsort(sym, kind="stable")
        first = np.flatnonzero(np.diff(sym[by], prepend=-1))
        row = sym[by][first]
        g = np.add.reduceat(dg.reshape(-1, 3 * n)[by], first) * scale
        s["x"][row] += g * g
        p["x"][row] -= rate * g / (np.sqrt(s["x"][row]) + 1e-5)
        grads *= scale
        lo = p["x"].size
        seen[lo:] += grads * grads
        w[lo:] -= rate * grads / (np.sqrt(seen[lo:]) + 1e-5)
        np.clip(w[lo:], -MOST, MOST, out=w[lo:])
        h = hs[-1]
        used += len(flat)
    return used


def log_likelihoods(w: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole text's symbols. Texts lie one after another in lanes; of a lane only its sum so far is kept."""
    if not ids:
        return np.zeros(0)
    p = views(w)
    width = min(512, len(ids))
    load = [(0, k) for k in range(width)]
    held: list[list[int]] = [[] for _ in range(width)]
    for j in sorted(range(len(ids)), key=lambda j: -len(ids[j])):
        n, k = heapq.heappop(load)
        held[k].append(j)
        heapq.heappush(load, (n + len(ids[j]), k))
    # the fullest lanes come first, so that those still running are always the first ones
    order = [k for _, k in sorted(load, key=lambda x: (-x[0], x[1]))]
    size = np.array([n for n, _ in sorted(load, key=lambda x: (-x[0], x[1]))])
    held = [held[k] for k in order]
    rows = [np.concatenate([np.zeros(1, np.int16), *(ids[j] for j in own)]) for own in held]
    text = np.array([j for own in held for j in own])
    past = np.concatenate([np.cumsum([len(ids[j]) for j in own]) for own in held])
    lane = np.repeat(np.arange(width), [len(own) for own in held])
    by = np.argsort(past, kind="stable")
    upto = np.zeros(len(text))  # of each text, the sum of its lane at its end
    sums, h, done = np.zeros(width), np.zeros((width, HIDDEN), dtype=np.float32), 0
    for at in range(0, int(size[0]), 32):
        n = min(32, int(size[0]) - at)
        live = int((size > at).sum())
        table = np.zeros((live, n + 1), dtype=np.int16)
        for k in range(live):
            part = rows[k][at : at + n + 1]
            table[k, : len(part)] = part
        table = np.ascontiguousarray(table.T)
        hs, _ = states(p, table[:n], h[:live])
        logp, _ = outputs(p, hs.reshape(-1, HIDDEN), table[1:].ravel())
        so_far = np.cumsum(logp.reshape(n, live), axis=0, dtype=np.float64) + sums[:live]
        end = int(np.searchsorted(past[by], at + n, "right"))
        now = by[done:end]
        upto[now] = so_far[past[now] - 1 - at, lane[now]]
        sums, h, done = so_far[-1], hs[-1], end
    before = np.where(np.append(True, lane[1:] != lane[:-1]), 0.0, np.append(0.0, upto[:-1]))
    out = np.zeros(len(text))
    out[text] = upto - before
    return out / np.log(10)


def _symbols(v: Vocabulary, col: pa.Array) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of texts with their end, and hash, near place, group and cuts of their words; some MB of text at a time."""
    for lo, hi, data, offs in slices(col, 8 << 20):
        h, g, doc = tokens(data, offs)
        i, s = look_up(v, h, g)
        cut = per_text(doc, hi - lo)
        yield [np.append(s[cut[k] : cut[k + 1]], np.int16(0)) for k in range(hi - lo)], h, i, g, cut


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of w and n over rows that come sorted by k and g."""
    key, w, n = None, np.zeros(0), 0.0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([w.tobytes()]), pa.array([n])], names=["k", "g", "w", "n"])

    for b in batches:
        for k, g, raw, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (k, g):
                if key:
                    yield row()
                key, w, n = (k, g), np.zeros(len(raw) // 8), 0.0
            w, n = w + np.frombuffer(raw), n + m
    if key:
        yield row()


def fit(rows: DataFrame, v: Vocabulary, turns: int = TURNS) -> np.ndarray:
    """Weights after all turns; rows: id and text of the training documents, each used in one turn."""
    sc = rows.sparkSession.sparkContext
    shared, w = sc.broadcast(v), start()
    for turn in range(turns):
        begin = sc.broadcast(w)
        rate = 0.12 / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch], begin=begin, rate=rate) -> Iterator[pa.RecordBatch]:
            own, used = begin.value.copy(), 0
            seen = np.full(len(own), 1e-4, dtype=np.float32)
            for b in batches:
                used += train(own, seen, [x for ids, *_ in _symbols(shared.value, b.column(0)) for x in ids], rate)
            if used:
                task = TaskContext.get()
                group = (task.partitionId() if task else 0) % SUMS
                parts = np.array_split(own.astype(np.float64) * used, BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([group] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in parts]), pa.array([float(used)] * BLOCKS)], names=["k", "g", "w", "n"])

        part = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(turns)) == turn).select("text")
        kind = "k int, g int, w binary, n double"
        sums = part.mapInArrow(run, kind).repartition("k", "g").sortWithinPartitions("k", "g").mapInArrow(_added, kind)
        got = sorted(sums.withColumn("g", F.lit(0)).repartition("k").sortWithinPartitions("k").mapInArrow(_added, kind).collect())  # BLOCKS rows
        if got:
            w = np.concatenate([np.frombuffer(r["w"]) / r["n"] for r in got]).astype(np.float32)
    return w


def score(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row; training: which rows are learned from."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), training.alias("t")).withColumn("row", F.xxhash64("id", "text"))
    rows = told_apart(rows, "row", "id", "text")
    learn = rows.filter("t").select("id", "text")
    counts = stored(word_counts(learn), "counts")
    texts = learn.count()
    v = vocabulary(counts, texts)
    weights = fit(learn, v)
    shared, net = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value, net.value
        log_count = np.log10(np.append(v.count, 0) + 0.5)
        for b in batches:
            whole: list[np.ndarray] = []
            cols: list[list] = [[], [], [], [], []]
            for ids, h, i, g, cut in _symbols(v, b.column(1)):
                whole += ids
                near, own = i >= 0, np.append(v.symbol, -1)[i] >= 0
                sums = lambda x, cut=cut: np.diff(np.concatenate([[0.0], np.cumsum(x)])[cut])
                known = np.where(near, log_count[i], 0.0)
                cols[0].append(sums(near))
                cols[1].append(sums(known))
                cols[2].append(sums(np.where(own, 0.0, known - v.share[g])))
                for k in range(len(ids)):
                    far = h[cut[k] : cut[k + 1]][~near[cut[k] : cut[k + 1]]]
                    word, c = np.unique(far, return_counts=True)
                    cols[3].append(word.view(np.int64)), cols[4].append(c.astype(np.int64))
            if not whole:
                continue
            known_n, base, extra = (np.concatenate(c) for c in cols[:3])
            score = log_likelihoods(w, whole) + extra
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in cols[3]])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(x) for x in whole], pa.int64()), pa.array(known_n.astype(np.int64)), pa.array(base), pa.array(score)]
                + [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), pa.int64())) for x in cols[3:]],
                names=["id", "row", "n_tokens", "near", "base", "score", "tail_h", "tail_n"],
            )

    parts = stored(rows.select("id", "text", "row").mapInArrow(run, "id long, row long, n_tokens long, near long, base double, score double, tail_h array<long>, tail_n array<long>"), "scores")
    tail = parts.select("row", F.posexplode(F.arrays_zip("tail_h", "tail_n")).alias("k", "x")).select("row", "k", F.col("x.tail_h").alias("h"), F.col("x.tail_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    # equal rows come together; each has the first of its rare words once
    equal = F.sum(F.when(F.col("k") == 0, 1).otherwise(0))
    rare = tail.join(counts.select("h", "c"), "h", "left").groupBy("row").agg((F.sum(F.col("n") * F.log10(c + 0.5)) / equal).alias("rare"), (F.sum(F.when(c > 0, F.col("n")).otherwise(0)) / equal).cast("long").alias("far"))
    end_base = float(np.log10(texts + 0.5))
    floor = float(np.log10(v.total + 0.5 * (v.kinds + 1)))
    r = F.coalesce("rare", F.lit(0.0))
    return parts.select("id", "row", "n_tokens", "near", "base", "score").join(rare, "row", "left").select(
        "id", "n_tokens", (F.col("near") + F.coalesce("far", F.lit(0)) + (1 if texts else 0)).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + r + end_base - F.col("n_tokens") * floor).alias("base_score"), (F.col("score") + r).alias("score"),
    )
