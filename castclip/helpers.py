"""Sequential rules within one episode or clip, in numpy and plain Python; no Spark here."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import xxhash


def kept_by_overlap(start: np.ndarray, end: np.ndarray, share: float) -> np.ndarray:
    """Mask of the intervals, best first, of which no more than ``share`` lies within any one kept before."""
    keep = np.zeros(len(start), dtype=bool)
    s, e = np.empty(len(start)), np.empty(len(start))
    n = 0
    for i in range(len(start)):
        length = end[i] - start[i]
        common = np.minimum(e[:n], end[i]) - np.maximum(s[:n], start[i])
        if length > 0 and n and common.max() / length > share:
            continue
        keep[i] = True
        s[n], e[n] = start[i], end[i]
        n += 1
    return keep


def settled(start: np.ndarray, end: np.ndarray, open_: np.ndarray, inside: np.ndarray, share: float) -> np.ndarray:
    """The same for a part of the intervals, best first: 0 covered, 1 kept, 2 not known.

    open_: not yet kept; inside: such that no interval outside the part touches it. Others that nothing covers here are told 1, but as they may be covered elsewhere, what they cover isn't known."""
    vote = np.ones(len(start), dtype=np.int32)
    # edges of those kept, and of those that may be kept, as far as they have come
    edges = np.empty((2, 2, len(start)))
    n = [0, 0]
    for i in range(len(start)):
        length, sure = end[i] - start[i], 1
        if open_[i]:
            if length > 0:
                for kind, told in ((0, 0), (1, 2)):
                    common = np.minimum(edges[kind, 1, : n[kind]], end[i]) - np.maximum(edges[kind, 0, : n[kind]], start[i])
                    if n[kind] and common.max() / length > share:
                        vote[i] = told
                        break
            sure = vote[i] == 1 and inside[i]
            if vote[i] == 0:
                continue
        kind = 0 if sure else 1
        edges[kind, :, n[kind]] = start[i], end[i]
        n[kind] += 1
    return vote


def interrupted(cuts: list[tuple], window: float, speakers: int, sub: float, seed: float) -> list[tuple]:
    """Cuts (speaker, start, end) with each burst dealt anew in pieces of ``sub`` seconds.

    A burst is a cut and those after it that end within ``window`` seconds of its start, ``speakers`` cuts and names at least."""
    dealt: list[tuple] = []  # speaker, start, end, whether it was drawn
    free = 0
    for first, cut in enumerate(cuts):
        if first < free:
            continue
        later = [c[2] - cut[1] > window for c in cuts[first + 1 :]]
        burst = cuts[first : first + 1 + (later.index(True) if True in later else len(later))]
        names = sorted({c[0] for c in burst})
        if min(len(names), len(burst)) < speakers:
            dealt.append((*cut, False))
            continue
        free = first + len(burst)
        begin, stop = cut[1], burst[-1][2]
        draw = random.Random(seed + begin)
        edges = [*np.arange(begin, stop, sub).tolist(), stop]
        dealt += [(draw.choice(names), x, y, True) for x, y in zip(edges, edges[1:], strict=False)]
    # a drawn piece goes to the one before it if that has the same speaker
    new = [not d[3] or k == 0 or d[0] != dealt[k - 1][0] for k, d in enumerate(dealt)]
    heads = [k for k, n in enumerate(new) if n]
    return [(dealt[k][0], dealt[k][1], dealt[past - 1][2]) for k, past in zip(heads, [*heads[1:], len(dealt)], strict=True)]


# Texts of clips that fill gaps.
FILLER = {"topic": "Segmento complementario", "hook": "", "summary": ""}


def _filler(start: float, length: float, score: float, why: str) -> dict:
    return {"start": round(start, 2), "end": round(start + length, 2), "score": score, **FILLER, "reason": why}


def _length(k: int, room: float, min_dur: float, max_dur: float) -> int:
    """A length between the limits that fits the room, from a hash of a running number."""
    most = int(min(max_dur, room))
    return int(min_dur) + xxhash.xxh64_intdigest(str(k).encode()) % (most - int(min_dur) + 1)


def _value(m: dict) -> float:
    return m["score"] or 0.0


# Fixed value: the reason of a clip made of two.
MERGED = "Merge: {} + {}"


def _merged(short: list[dict], most: int, min_dur: float, max_dur: float, apart: float = 5.0) -> list[dict]:
    """At most ``most`` clips, each of two neighbours that are too short alone; none is in two of them."""
    out: list[dict] = []
    used = None
    for a, b in zip(short, short[1:], strict=False):
        if len(out) < most and a is not used and b["start"] - a["end"] <= apart and min_dur <= b["end"] - a["start"] <= max_dur:
            why = MERGED.format(a["topic"] or "", b["topic"] or "")
            out.append({**{c: a[c] for c in ("start", "topic", "hook")}, "end": b["end"], "score": max(_value(a), _value(b)), "summary": a["summary"] or b["summary"], "reason": why})
            used = b
    return out


def _gaps(clips: list[dict], total: float, least: float) -> list[tuple[float, float]]:
    """Free stretches before, between and after the clips; the outer ones must be longer than ``least``, inner ones as long."""
    edges = sorted(((m["start"], m["end"]) for m in clips), key=lambda e: e[0])
    lows, highs = [0.0, *(e for _, e in edges)], [*(s for s, _ in edges), total]
    size = [hi - lo for lo, hi in zip(lows, highs, strict=True)]
    outer = (0, len(edges))
    return [(lows[k], highs[k]) for k, n in enumerate(size) if not edges or n > least or (n == least and k not in outer)]


def _fillers(gaps: list[tuple[float, float]], total: float, need: int, min_dur: float, max_dur: float) -> list[dict]:
    """``need`` clips if there is room: in the gaps, 5 s from one to the next; then at equal steps over the whole."""
    out: list[dict] = []
    for at, past in gaps:
        while len(out) < need and past - at >= min_dur:
            size = _length(len(out), past - at, min_dur, max_dur)
            out.append(_filler(at, size, 3.0, "auto-fill"))
            at += size + 5
    missing = need - len(out)
    step = total / (missing + 1)
    for at in (k * step for k in range(missing)):
        if total - at >= min_dur:
            out.append(_filler(at, _length(len(out), total - at, min_dur, max_dur), 2.5, "auto-fill-overlap"))
    return out


def topped_up(own: list[dict], pool: list[dict], min_count: int, max_count: int, floor: float, min_dur: float, max_dur: float) -> list[dict]:
    """Clips of an episode that has too few: short neighbours merged, then gaps filled, then fillers over what is there."""
    best = lambda clips: sorted(clips, key=_value, reverse=True)[:max_count]
    low = max(0.0, floor - 0.5)
    short = sorted((m for m in pool if 0 < m["end"] - m["start"] < min_dur and _value(m) >= low), key=lambda m: m["start"])
    clips = best(own + _merged(short, min_count - len(own), min_dur, max_dur))
    total = max([0.0, *(m["end"] for m in pool)])
    if total > 0 and len(clips) < min_count:
        clips = best(clips + _fillers(_gaps(clips, total, min_dur), total, min_count - len(clips), min_dur, max_dur))
    return sorted(clips, key=lambda m: m["start"])


# Fixed value: a time at the start of a transcript's line.
STAMP = re.compile(r"\[(\d{2}):(\d{2}):(\d{2})[,.](\d+)")


def stamp_seconds(line: str) -> float | None:
    m = STAMP.search(line)
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3]) + int(m[4]) / 1000 if m else None


# Fixed value: what stands before the context of a chunk.
CONTEXT = "[Contexto previo: {}]\n\n"


def chunks(lines: Iterable[str], max_chars: int) -> Iterator[str]:
    """Chunks of a transcript of about max_chars: cut after a pause of over 2 s in the last part if there is one; each
    later chunk begins with the end of the one before as context, and with its last stamped lines. No more than a chunk is held."""
    held: list[tuple[str, float | None]] = []
    size, context = 0, ""
    text = lambda part: (CONTEXT.format(context) if context else "") + "\n".join(x for x, _ in part)
    stamped = lambda part: [x for x in part if x[1] is not None]
    for line in lines:
        held.append((line, stamp_seconds(line)))
        size += len(line)
        if size < max_chars:
            continue
        n = len(held)
        late = [(k, held[k][1]) for k in range(int(n * 0.6) + 1, min(int(n * 0.95), n - 1) + 1) if held[k][1] is not None]
        pauses = [k + 1 for (k, t), (_, then) in zip(late, late[1:], strict=False) if then - t > 2.0]
        cut = pauses[-1] if pauses else n
        yield text(held[:cut])
        context = " ".join(x for x, _ in stamped(held[:cut][-10:])[-3:])[:200]
        held = stamped(held[:cut][-30:]) + held[cut:]
        size = sum(len(x) for x, _ in held)
    if held:
        yield text(held)


def simple_chunks(lines: Iterable[str], max_chars: int) -> Iterator[str]:
    """Lines together up to max_chars, each with its line end; a text that fits without the last one's is one chunk. No more than a chunk is held."""
    held: list[str] = []
    size, cuts = 0, 0
    last: str | None = None  # would fill the first chunk but for its line end: it belongs there if it ends the text
    for line in lines:
        if last is not None:
            yield "\n".join(held)
            held, size, cuts, last = [last], len(last) + 1, 1, None
        more = size + len(line) + 1
        if more == max_chars + 1 and held and not cuts:
            last = line
            continue
        if held and more > max_chars:
            yield "\n".join(held)
            held, more, cuts = [], len(line) + 1, 1
        held.append(line)
        size = more
    if last is not None:
        held.append(last)
    if held:
        yield "\n".join(held)


def _closeness(first: np.ndarray, words: np.ndarray, places: int) -> np.ndarray:
    """How well each place's window (of the needle's length and five words) holds the needle: its words, its word pairs, its start."""
    size = len(first) + 5

    def held(hits: np.ndarray, width: int) -> np.ndarray:
        """Whether a window of ``width`` from each place on has a hit, from running counts."""
        count = np.concatenate([[0], np.cumsum(hits)])
        lo = np.arange(places)
        return count[np.minimum(lo + width, len(hits))] > count[np.minimum(lo, len(hits))]

    kinds, many = np.unique(first, return_counts=True)
    found = sum(n * held(words == w, size) for w, n in zip(kinds, many, strict=True))
    pairs = set(zip(first.tolist(), first[1:].tolist(), strict=False))
    both = sum((held((words[:-1] == a) & (words[1:] == b), size - 1).astype(int) for a, b in pairs), np.zeros(places, int))
    return 0.35 * found / len(first) + 0.5 * both / max(1, len(pairs)) + np.where(words[:places] == first[0], 0.15, 0.0)


def aligned(blocks: list[tuple[list[str], int]], said: Iterable[tuple[str, int]], total: int, needle: int = 10) -> Iterator[tuple[int, int]]:
    """(block, place) of script blocks found in a transcript's words, always forward.

    blocks: their first words and their length; said: ``total`` words and their places. Of these no more are held, as numbers, than one search looks at and later ones can go back to."""
    number = {w: k for k, w in enumerate(dict.fromkeys(w for own, _ in blocks for w in own[:needle]))}
    source = iter(said)
    codes, places = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    base = last = 0  # the number of the first word held, and of the word after what was found
    for k, (own, length) in enumerate(blocks):
        first = np.array([number[w] for w in own[:needle]], dtype=np.int64)
        begin = max(0, last - 50)
        ahead = max(500, 3 * (total - begin) // max(1, len(blocks) - k))
        upto = min(total - len(first) - begin, ahead)
        if length < 2 or upto <= 0:
            continue
        past = max(0, begin - 45 * (len(blocks) - k) - base)  # a later search may begin up to 45 words before the one before it
        codes, places, base = codes[past:], places[past:], base + min(past, len(codes))
        missing = begin + upto + needle + 5 - base - len(codes)
        if missing > 0:
            more = list(islice(source, missing))
            codes = np.concatenate([codes, np.array([number.get(w, -1) for w, _ in more], dtype=np.int32)])
            places = np.concatenate([places, np.array([at for _, at in more], dtype=np.int64)])
        score = _closeness(first, codes[begin - base : begin - base + upto + needle + 5], upto)
        good = np.flatnonzero(score >= 0.75)
        at = int(good[0] if len(good) else score.argmax())
        if score[at] >= 0.25:
            yield k, int(places[begin - base + at])
            last = begin + at + max(length // 2, 5)


def clustered(points: np.ndarray, centres: np.ndarray, rounds: int, atol: float) -> np.ndarray:
    """k-means from given centres on the matrix of squared distances; a centre without points stays where it is."""
    squares = (points**2).sum(axis=1)[:, None]
    own = lambda c: (squares - 2 * points @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
    for _ in range(rounds):
        member = own(centres)[:, None] == np.arange(len(centres))
        size = member.sum(axis=0)
        moved = np.where(size[:, None] > 0, member.T @ points / np.maximum(size, 1)[:, None], centres)
        still = np.allclose(centres, moved, atol=atol)
        if still:
            break
        centres = moved
    return own(centres)


def silhouette(points: np.ndarray, own: np.ndarray, most: int) -> float:
    """Mean silhouette of the first ``most`` points against all, which are taken in blocks."""
    n = min(len(points), most)
    kinds = np.unique(own)
    sums, size = np.zeros((n, len(kinds))), np.array([(own == c).sum() for c in kinds])
    step, squares = max(1, 2_000_000 // n), (points**2).sum(axis=1)
    few = points.shape[1] <= 8
    for at in range(0, len(points), step):
        part = points[at : at + step]
        if few:
            d = np.sqrt(sum((points[:n, None, j] - part[None, :, j]) ** 2 for j in range(points.shape[1])))
        else:
            d = np.sqrt(np.maximum(squares[:n, None] + squares[None, at : at + step] - 2 * points[:n] @ part.T, 0.0))
        for k, c in enumerate(kinds):
            sums[:, k] += d[:, own[at : at + step] == c].sum(axis=1)
    mine = np.searchsorted(kinds, own[:n])
    a = np.where(size[mine] > 1, sums[np.arange(n), mine] / np.maximum(size[mine] - 1, 1), 0.0)
    mean = sums / size
    mean[np.arange(n), mine] = np.inf
    b = mean.min(axis=1) if len(kinds) > 1 else np.zeros(n)
    top = np.maximum(a, b)
    return float(np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def face_clusters(cx: np.ndarray, cy: np.ndarray, max_k: int) -> np.ndarray:
    """Labels of detections; how many, by silhouette, x counting more than y. Starts are spread over the width, at the mean height."""
    points = np.column_stack([cx, 0.3 * cy])
    few = len(points) < 4
    counts = [max(1, min(len(points), max_k))] if few else range(2, min(max_k + 1, len(points)))
    best, label = -np.inf, None
    for k in counts or [2]:
        spread = points[:, 0].min() + np.ptp(points[:, 0]) * np.arange(k) / max(1, k - 1)
        own = clustered(points, np.column_stack([spread, np.full(k, points[:, 1].mean())]), 20, 1e-4)
        score = 0.0 if few else silhouette(points, own, 200)
        if score > best:
            best, label = score, own
    return label


def voice_clusters(x: np.ndarray, fixed: int | None, min_k: int, max_k: int) -> np.ndarray:
    """Labels of voice windows; of numbers of speakers that score alike, the larger. Starts are the points farthest apart."""
    if len(x) < 4:
        return np.zeros(len(x), dtype=int)
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)

    def labels(k: int) -> np.ndarray:
        at = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
        far = ((x - x[at[0]]) ** 2).sum(axis=1)
        while len(at) < k:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
        return clustered(x, x[at], 100, 1e-6)

    if fixed and min_k <= fixed <= max_k:
        return labels(min(fixed, len(x)))
    best, score = None, -1.0
    for k in range(max(2, min_k), min(max_k, len(x) - 1) + 1):
        own = labels(k)
        s = silhouette(x[:2000], own[:2000], 2000) if len(np.unique(own[:2000])) > 1 else -1.0
        if s > 0 and s > score * 0.85:
            best, score = own, max(score, s)
    return best if best is not None else np.zeros(len(x), dtype=int)


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), each once, of the largest total gain; by shortest augmenting paths on potentials."""
    rows, cols = gain.shape
    n = max(rows, cols)
    cost = np.zeros((n, n))
    cost[:rows, :cols] = -gain
    u, v, match = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for r in range(n):
        match[n] = r
        col, dist, back, used = n, np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while match[col] >= 0:
            used[col] = True
            i = match[col]
            cur = cost[i] - u[i] - v[:n]
            free = ~used[:n]
            better = free & (cur < dist)
            dist[better], back[better] = cur[better], col
            nxt = int(np.where(free, dist, np.inf).argmin())
            step = dist[nxt]
            for j in np.flatnonzero(used):
                u[match[j]] += step
                v[j] -= step
            dist[free] -= step
            col = nxt
        while col != n:
            match[col] = match[back[col]]
            col = back[col]
    return sorted((int(match[c]), c) for c in range(cols) if 0 <= match[c] < rows)


def greedy_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Best positive pair first."""
    left, out = gain.astype(float), []
    while left.size and left.max() > 0:
        r, c = np.unravel_index(left.argmax(), left.shape)
        out.append((int(r), int(c)))
        left[r, :] = left[:, c] = -np.inf
    return sorted(out)
