"""k-means of episodes too large for one task: the points stay where they are, tasks send sums and counts, and the driver moves the centres."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import cut

MOST, EPISODES = 1_000_000, 200  # components of the centres, and episodes, that are worked on at once
FEW = 4_000_000  # values of a table that is broadcast, about 32 MB


def parted(rows: DataFrame, most: int, keys) -> tuple[DataFrame, DataFrame | None]:
    """Rows of episodes of up to ``most`` rows, and those of larger ones with their key as ``_e`` (None if there are none)."""
    large = cut(rows.groupBy(F.struct(*keys).alias("_e")).count().filter(F.col("count") > most).select("_e"))
    n = large.count()
    if not n:
        return rows, None
    named, large = rows.withColumn("_e", F.struct(*keys)), _small(large, n)
    return named.join(large, "_e", "left_anti").drop("_e"), named.join(large, "_e", "left_semi")


def _small(table: DataFrame, size: int) -> DataFrame:
    """The table for a join in which large episodes should stay where they are: broadcast, unless it has over FEW values."""
    return F.broadcast(table) if size <= FEW else table


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _nearest(p: Column, centres: Column) -> Column:
    """Number of the nearest centre, of equally near ones the first."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(_distance(p, c).alias("d"), i.alias("i"))))["i"]


def _dealt(points: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """Each point once for every set of centres of its episode, with the cluster it is in there. size: components of all centres."""
    sets = centres.groupBy("_e").agg(F.collect_list(F.struct("k", "centres")).alias("_s"))
    rows = points.join(_small(sets, size), "_e").withColumn("_s", F.explode("_s"))
    return rows.withColumn("k", F.col("_s.k")).withColumn("c", _nearest(F.col("p"), F.col("_s.centres"))).drop("_s")


Centres = dict[tuple[str, int], np.ndarray]  # of an episode's name and a number of clusters


def _gathered(points: DataFrame, keys: list[tuple[str, int]], each: Callable[[str, int, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """``each`` gives of an episode's points, for a number of clusters, a count and ``width`` sums for each cluster; these are added up over all tasks, of which each sends one row a cluster."""
    by: dict[str, list[int]] = {}
    for name, k in keys:
        by.setdefault(name, []).append(k)

    def run(batches):
        total: dict[tuple[str, int], list[np.ndarray]] = {}
        for b in batches:
            names = b.column(0).dictionary_encode()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            which = names.indices.to_numpy()
            for j, name in enumerate(names.dictionary.to_pylist()):
                own = x[which == j]
                for k in by.get(name, ()):
                    n, s = each(name, k, own)
                    held = total.setdefault((name, k), [np.zeros(k, np.int64), np.zeros((k, width))])
                    held[0] += n
                    held[1] += s
        rows = [(name, k, j, int(n[j]), s[j].tolist()) for (name, k), (n, s) in total.items() for j in range(k) if n[j]]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["name", "k", "c", "n", "s"])

    told = points.select("_n", "p").mapInArrow(run, "name string, k int, c int, n long, s array<double>")
    sums = told.select("name", "k", "c", "n", F.posexplode("s").alias("j", "v")).groupBy("name", "k", "c", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = {key: (np.zeros(key[1], np.int64), np.zeros((key[1], width))) for key in keys}
    for r in sums.toArrow().to_pylist():  # as many as there are sums
        n, s = out[r["name"], r["k"]]
        n[r["c"]], s[r["c"], r["j"]] = r["n"], r["v"]
    return out


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T * -2 + (c**2).sum(axis=1)).argmin(axis=1)


def _sums(points: DataFrame, centres: Centres) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """How many points each centre has, and their sum."""

    def each(name, k, x):
        member = _own(x, centres[name, k])[:, None] == np.arange(k)
        return member.sum(axis=0), member.T @ x

    return _gathered(points, list(centres), each, next(iter(centres.values())).shape[1])


def _silhouettes(points: DataFrame, centres: Centres, heads: dict[str, np.ndarray]) -> dict[tuple[str, int], float]:
    """Mean silhouette of each episode's head, some of its points, against all of its points."""
    most = max(map(len, heads.values()))

    def each(name, k, x):
        near, head = _own(x, centres[name, k]), heads[name]
        d = np.sqrt(sum((head[:, None, j] - x[None, :, j]) ** 2 for j in range(x.shape[1])))
        sums = np.zeros((k, most))
        for c in range(k):
            sums[c, : len(head)] = d[:, near == c].sum(axis=1)
        return np.bincount(near, minlength=k), sums

    out = {}
    for (name, k), (n, s) in _gathered(points, list(centres), each, most).items():
        mine = _own(heads[name], centres[name, k])
        s = s[:, : len(mine)].T
        at = np.arange(len(mine))
        a = np.where(n[mine] > 1, s[at, mine] / np.maximum(n[mine] - 1, 1), 0.0)
        mean = np.where(n > 0, s / np.maximum(n, 1), np.inf)
        mean[at, mine] = np.inf
        b = mean.min(axis=1) if (n > 0).sum() > 1 else np.zeros(len(mine))
        top = np.maximum(a, b)
        out[name, k] = float(np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0).mean())
    return out


def lloyd(points: DataFrame, starts: DataFrame, rounds: int, atol: float, heads: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Centres of each episode and number of clusters, and how many components they have. Points: _e, p; starts: _e, k, centres. A centre without points stays.
    With heads (_e, p), some points of each episode, the centres come with s, their mean silhouette.

    Episodes come here for their size, so they are few for the rows that there are; of their centres MOST components are worked on at once, in as
    many turns as it takes."""
    name = F.to_json("_e", {"ignoreNullFields": "false"}).alias("_n")
    named, begun = points.withColumn("_n", name), starts.withColumn("_n", name)
    made: list[DataFrame] = []
    held: dict[tuple[str, int], np.ndarray] = {}
    size = 0

    def settle() -> None:
        moving = dict(held)
        for _ in range(rounds):
            if not moving:
                break
            for key, (n, s) in _sums(named, moving).items():
                to = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], held[key])
                if np.allclose(held[key], to, atol=atol):
                    del moving[key]
                else:
                    moving[key] = held[key] = to
        score: dict[tuple[str, int], float] = {}
        if heads is not None:
            some: dict[str, list[list[float]]] = {}
            for r in heads.select(name, "p").filter(F.col("_n").isin(sorted({n for n, _ in held}))).collect():
                some.setdefault(r["_n"], []).append(r["p"])
            score = _silhouettes(named, held, {n: np.array(p) for n, p in some.items()})
        made.append(cut(points.sparkSession.createDataFrame([(*key, c.tolist(), score.get(key)) for key, c in held.items()], "_n string, k int, centres array<array<double>>, s double")))
        held.clear()

    for r in cut(begun.select("_n", "k", "centres").repartition("_n").sortWithinPartitions("_n", "k")).toLocalIterator():
        if len({n for n, _ in held} | {r["_n"]}) > EPISODES or sum(c.size for c in held.values()) >= MOST:
            settle()
        held[r["_n"], r["k"]] = np.array(r["centres"], dtype=float)
        size += held[r["_n"], r["k"]].size
    settle()
    told = made[0]
    for more in made[1:]:
        told = told.unionByName(more)
    return begun.drop("centres").join(_small(told, size), ["_n", "k"]).select("_e", "k", "centres", "s"), size


def _first(rows: DataFrame, order, n: int) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("_e").orderBy(*order))).filter(F.col("i") <= n)


def faces(detections: DataFrame, max_k: int) -> DataFrame:
    """Detections (with ``_e``) with the number of their cluster, as ``helpers.face_clusters`` gives it."""
    rows = detections.withColumn("p", F.array(F.col("cx").cast("double"), F.col("cy").cast("double") * 0.3))
    points = cut(rows.select("_e", "p"))
    wide = points.groupBy("_e").agg(F.min(F.col("p")[0]).alias("lo"), F.max(F.col("p")[0]).alias("hi"), F.avg(F.col("p")[1]).alias("y"))
    sets = wide.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(2, max_k + 1) or [2]])))
    spread = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.array(F.col("lo") + (F.col("hi") - F.col("lo")) * i / (F.col("k") - 1), F.col("y")))
    heads = _first(rows, ("t", "cx", "cy"), 200).select("_e", "p")
    centres, size = lloyd(points, sets.select("_e", "k", spread.alias("centres")), 20, 1e-4, heads)
    # numbers that leave a centre without points score alike, but for the order of sums
    best = centres.groupBy("_e").agg(F.max_by("k", F.struct(F.round("s", 9), -F.col("k"))).alias("k"))
    named = _dealt(rows, centres.join(best, ["_e", "k"]).drop("s"), size)
    return named.withColumn("cluster", F.col("c").cast("int")).drop("_e", "p", "k", "c")


def voices(features: DataFrame, fixed: int | None, min_k: int, max_k: int) -> DataFrame:
    """Voice windows (with ``_e``) with a label, as ``helpers.voice_clusters`` gives it."""
    each = features.select("_e", F.posexplode("features").alias("j", "v")).groupBy("_e", "j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = cut(each.groupBy("_e").agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("_z")))
    rows = features.join(scale, "_e").withColumn("p", F.zip_with("features", "_z", lambda x, z: (x - z["m"]) / (z["s"] + 1e-6))).drop("_z")
    points = cut(rows.select("_e", "win_idx", "p"))
    # from the point nearest to the mean, which is at 0 here, always the one farthest from those taken
    size = F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x)
    taken = points.groupBy("_e").agg(F.array(F.min_by("p", F.struct(size, F.col("win_idx")))).alias("centres"))
    picked = bool(fixed) and min_k <= fixed <= max_k
    counts = [fixed] if picked else list(range(max(2, min_k), max_k + 1))
    for _ in range(max([1, *counts]) - 1):
        taken = cut(taken)
        far = F.array_min(F.transform("centres", lambda c: _distance(F.col("p"), c)))
        more = points.join(taken, "_e").groupBy("_e").agg(F.max_by("p", F.struct(far, -F.col("win_idx"))).alias("_p"))
        taken = taken.join(more, "_e").select("_e", F.concat("centres", F.array("_p")).alias("centres"))
    if not counts:
        return features.withColumn("label", F.lit(0)).drop("_e")
    starts = taken.withColumn("k", F.explode(F.array(*[F.lit(k) for k in counts]))).select("_e", "k", F.slice("centres", F.lit(1), F.col("k")).alias("centres"))
    centres, size = lloyd(points, starts, 100, 1e-6)
    centres = centres.drop("s")
    if not picked:
        head = _dealt(_first(points, ("win_idx",), 2000), centres, size)

        def run(pdf):
            import numpy as np

            from ..helpers import silhouette

            pdf = pdf.sort_values("i")
            own = pdf["c"].to_numpy()
            s = silhouette(np.array(pdf["p"].tolist(), dtype=float), own, 2000) if len(np.unique(own)) > 1 else -1.0
            return pdf[["_n", "k"]].iloc[:1].assign(s=s)

        name = F.to_json("_e", {"ignoreNullFields": "false"}).alias("_n")
        score = head.select(name, "k", "i", "p", "c").groupBy("_n", "k").applyInPandas(run, "_n string, k int, s double")
        # of numbers in rising order one is taken if it comes near the best so far
        rule = lambda best, x: F.when((x["s"] > 0) & (x["s"] > best["s"] * 0.85), F.struct(x["k"].alias("k"), F.greatest(best["s"], x["s"]).alias("s"))).otherwise(best)
        best = score.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("_s")).join(taken.select("_e", name), "_n")
        best = best.select("_e", F.aggregate("_s", F.struct(F.lit(0).alias("k"), F.lit(-1.0).alias("s")), rule)["k"].alias("k"))
        none = taken.join(best.filter("k = 0"), "_e", "left_semi").select("_e", F.lit(0).alias("k"), F.slice("centres", 1, 1).alias("centres"))
        centres = centres.join(best, ["_e", "k"]).unionByName(none)
    return _dealt(rows, centres, size).withColumn("label", F.col("c").cast("int")).drop("_e", "p", "k", "c")
