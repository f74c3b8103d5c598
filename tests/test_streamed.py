"""Rules that read an episode as a stream: against the same rules on whole lists, and what they hold."""

import random
import tracemalloc

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from castclip import helpers
from castclip.functions.clips import normalize_text
from castclip.operators import quality, scans

K = ("ep",)


def transcript(seed, n):
    rng, t, out = random.Random(seed), 0, []
    for k in range(n):
        t += rng.choice((1, 2, 3, 9))
        out.append((f"[{t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d},000] " if rng.random() < 0.8 else "") + "x" * rng.randrange(0, 90) + str(k))
    return out


def whole_chunks(lines, most):
    """The rule of chunks, one chunk after another over the whole list."""
    out, held, context, at = [], [], "", 0
    while at < len(lines):
        while at < len(lines):
            held.append(lines[at])
            at += 1
            if sum(map(len, held)) >= most:
                break
        else:
            break
        stamp = [helpers.stamp_seconds(x) for x in held]
        late = [k for k in range(int(0.6 * len(held)) + 1, min(int(0.95 * len(held)), len(held) - 1) + 1) if stamp[k] is not None]
        cut = len(held)
        for a, b in zip(late, late[1:], strict=False):
            if stamp[b] - stamp[a] > 2:
                cut = a + 1
        out.append(("[Contexto previo: " + context + "]\n\n" if context else "") + "\n".join(held[:cut]))
        timed = lambda some: [x for x in some if helpers.stamp_seconds(x) is not None]
        context = " ".join(timed(held[:cut][-10:])[-3:])[:200]
        held = timed(held[:cut][-30:]) + held[cut:]
    if held:
        out.append(("[Contexto previo: " + context + "]\n\n" if context else "") + "\n".join(held))
    return out


def whole_simple(lines, most):
    if len("\n".join(lines)) <= most:
        return ["\n".join(lines)]
    out = [[]]
    for x in lines:
        if out[-1] and sum(len(y) + 1 for y in out[-1]) + len(x) + 1 > most:
            out.append([])
        out[-1].append(x)
    return ["\n".join(x) for x in out]


@pytest.mark.parametrize("seed", range(8))
def test_streams_give_what_whole_lists_give(seed):
    rng = random.Random(seed)
    lines = transcript(seed, rng.randrange(1, 150))
    for most in (60, 300, 900):
        assert list(helpers.chunks(iter(lines), most)) == whole_chunks(lines, most)
    short = ["y" * rng.randrange(0, 9) for _ in range(rng.randrange(1, 9))]
    for most in range(1, 45):
        assert list(helpers.simple_chunks(iter(short), most)) == whole_simple(short, most)


def closeness(first, window):
    """How well a place's window (15 words from a needle of ten) holds the needle."""
    pairs = set(zip(first, first[1:], strict=False))
    found, both = sum(w in window for w in first), len(pairs & set(zip(window, window[1:], strict=False)))
    return 0.35 * found / len(first) + 0.5 * both / max(1, len(pairs)) + (0.15 if window[0] == first[0] else 0.0)


def whole_aligned(blocks, words):
    out, last = [], 0
    for k, own in enumerate(blocks):
        first, begin = own[:10], max(0, last - 50)
        places = min(len(words) - len(first) - begin, max(500, 3 * (len(words) - begin) // (len(blocks) - k)))
        if len(own) < 2 or places <= 0:
            continue
        score = [closeness(first, words[p : p + len(first) + 5]) for p in range(begin, begin + places)]
        at = next((p for p, x in enumerate(score) if x >= 0.75), max(range(places), key=lambda p: score[p]))
        if score[at] >= 0.25:
            out.append((k, begin + at))
            last = begin + at + max(len(own) // 2, 5)
    return out


def script(seed, n, kinds):
    rng = random.Random(seed)
    words = rng.choices([f"w{k}" for k in range(kinds)], k=n)
    blocks, at = [], 0
    while at < n:
        size = rng.randrange(1, 60)
        blocks += [[w if rng.random() < 0.9 else "zz" for w in words[at : at + size]]] * (rng.random() < 0.8)
        at += size + rng.choice((0, 0, 200))
    return blocks, words


@pytest.mark.parametrize(("seed", "kinds"), [(1, 15), (2, 200), (3, 60), (4, 4)])
def test_a_script_is_found_in_a_stream_of_words(seed, kinds):
    blocks, words = script(seed, 1500, kinds)
    got = helpers.aligned([(b[:10], len(b)) for b in blocks], zip(words, range(len(words)), strict=True), len(words))
    assert list(got) == whole_aligned(blocks, words)


def test_no_more_than_a_chunk_is_held():
    def lines():
        for k in range(200_000):
            yield f"[{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d},000] a line of the transcript that is some eighty characters long"

    for make in (helpers.chunks, helpers.simple_chunks):
        tracemalloc.start()
        n = sum(1 for _ in make(lines(), 4000))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 1000 and peak < 2e6


def test_operators_read_streams(spark):
    rows = [(ep, k, line) for ep, n in (("a", 120), (None, 60), ("b", 1)) for k, line in enumerate(transcript(n, n))]
    df = spark.createDataFrame(rows, "ep string, line_no long, line string").repartition(5)
    told = lambda d: {ep: [r["text"] for r in sorted(d.filter(d["ep"].eqNullSafe(ep)).collect(), key=lambda r: r["chunk_idx"])] for ep in ("a", None, "b")}
    own = lambda ep: [x for e, _, x in rows if e == ep]
    assert told(quality.chunk_transcript(df, 100, K)) == {ep: whole_chunks(own(ep), 400) for ep in ("a", None, "b")}
    assert told(quality.chunk_simple(df, 500, K)) == {ep: whole_simple(own(ep), 500) for ep in ("a", None, "b")}
    assert quality.chunk_simple(df.limit(0), 500, K).count() == 0


def test_scripts_of_episodes(spark):
    said, asked, want = [], [], []
    for ep, seed in (("a", 5), (None, 6)):
        blocks, words = script(seed, 900, 80)
        lines = [words[k : k + 7] for k in range(0, len(words), 7)]
        said += [(ep, k, " ".join(x)) for k, x in enumerate(lines)] + [(ep, len(lines), None)]
        asked += [(ep, k, "S", " ".join(b)) for k, b in enumerate(blocks)]
        want += [(ep or "", k, p // 7) for k, p in whole_aligned(blocks, words)]
    asked.append(("no transcript", 0, "S", "w1 w2 w3"))
    b = spark.createDataFrame(asked, "ep string, block_idx long, speaker string, text string").repartition(3)
    t = spark.createDataFrame(said, "ep string, seg_idx long, text string").repartition(4)
    assert t.select(normalize_text(t["text"]).alias("w")).first()["w"]
    assert sorted((r["ep"] or "", r["block_idx"], r["seg_idx"]) for r in quality.align_script(b, t, K).collect()) == sorted(want)


def test_parts_of_a_union_meet(spark):
    """The parts are dealt by the key already, and differ in size, so that adaptive execution would merge their partitions differently."""
    w = Window.partitionBy("k").orderBy("id")
    large = spark.range(60_000).withColumn("k", F.col("id") % 50).withColumn("at", F.row_number().over(w).cast("long")).select("k", F.lit(2).alias("kind"), "at", F.concat(*[F.sha2((F.col("id") + j).cast("string"), 512) for j in range(4)]).alias("pad"))
    small = spark.range(1000).withColumn("k", F.col("id") % 50).groupBy("k").agg(F.sum("id").alias("at")).select("k", F.lit(0).alias("kind"), "at", F.lit("").alias("pad"))

    def make(rows):
        kinds = [(kind, at) for kind, at, _ in rows]
        yield kinds[0][0], len(kinds), int(kinds == sorted(kinds))

    keep = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = scans.streamed(small.unionByName(large), ["k"], ["kind", "at"], make, "first int, n int, sorted int").collect()
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert sorted(map(tuple, got)) == [(k, 0, 1201, 1) for k in range(50)]
