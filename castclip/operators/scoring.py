"""Scoring of transcript chunks by any callable, one call per chunk."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.clips import CATEGORIES
from .intervals import KEYS


def lexical_scorer(prompt: str) -> str:
    """A deterministic stand-in for a model: spans of three stamped lines, scored by the words of the categories in them."""
    rows = [(m, line) for line in prompt.splitlines() if (m := re.match(r"\[(\d+):(\d+):(\d+)[,.](\d+) --> (\d+):(\d+):(\d+)[,.](\d+)\]\s*(.*)", line))]
    seconds = lambda m, k: int(m[k]) * 3600 + int(m[k + 1]) * 60 + int(m[k + 2]) + int(m[k + 3]) / 1000
    out = []
    for k in range(0, len(rows), 3):
        part = rows[k : k + 3]
        text = " ".join(m[9] for m, _ in part).lower()
        hits = sum(any(w in text for w in words) for words in CATEGORIES.values())
        out.append({"start": seconds(part[0][0], 1), "end": seconds(part[-1][0], 5), "score": min(10.0, 3.0 + 1.5 * hits), "topic": text[:40], "hook": part[0][0][9], "summary": "", "reason": "lexical"})
    return json.dumps(out, ensure_ascii=False)


def score_chunks(prompts: DataFrame, scorer: Callable[[str], str] = lexical_scorer, calls: int = 8, retries: int = 2, keys=KEYS) -> DataFrame:
    """keys, chunk_idx, response, error: what the scorer says of each prompt; a chunk that fails says why and stops no other.

    calls: how many run at a time."""
    keys = list(keys)
    src = prompts.select(*keys, "chunk_idx", "prompt").repartition(calls)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", response string, error string"

    def ask(text: str) -> tuple[str | None, str | None]:
        for k in range(retries + 1):
            try:
                return scorer(text), None
            except Exception as e:  # any failure of the callable belongs to its row
                if k == retries:
                    return None, f"{type(e).__name__}: {e}"
        return None, None

    def run(batches):
        for pdf in batches:
            got = [ask(t) for t in pdf["prompt"]]
            yield pdf.drop(columns="prompt").assign(response=[g[0] for g in got], error=[g[1] for g in got])

    return src.mapInPandas(run, kind)
