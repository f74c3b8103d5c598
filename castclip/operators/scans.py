"""Rules over rows in order, for groups of any size.

A window takes a whole group in one task, and adaptive execution doesn't split it. Here the rows of a key are dealt to blocks of
their order (time bins, runs of line numbers), each block is a window of its own, and what passes from one block to the next (its
last row, its sum, its number of rows) is a table of one row a block, which is scanned by key and joined back. Blocks come from the rows' own values, so
any lost task is worked out again alike.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut, in the folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if place is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="castclip-"))
    return df.checkpoint()


class Scan:
    """``rows`` of each key in ascending ``order``. Without ``block`` a key is one window; with it (a column that rises with the order) it is as many as it has blocks.

    Methods add columns to ``rows``. Nulls in keys and blocks are values like others, and blocks that are null come first."""

    def __init__(self, rows: DataFrame, keys, order: list[str], block: Column | None = None):
        self.keys, self.order, self.block = list(keys), list(order), block
        self.by = ["_g"] if block is not None else self.keys
        self.rows = rows if block is None else rows.withColumn("_g", F.struct(*self.keys, block.alias("_block")))

    def window(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def _upto(self):
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def _carry(self, how: str, total: Column, after: bool = False) -> str | None:
        """Adds _c: what the blocks before (after: behind) give together; None without blocks. how: sum, max, or last, of the nearest block that has a value."""
        if self.block is None:
            return None
        at = F.col("_g._block")
        w = Window.partitionBy(*[F.col(f"_g.`{k}`") for k in self.keys]).orderBy(at.desc_nulls_last() if after else at.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, True)}[how]
        each = self.rows.groupBy("_g").agg(total.alias("_c"))
        self.rows = self.rows.join(each.select("_g", fold("_c").over(w).alias("_c")), "_g")
        return "_c"

    def _put(self, name: str, value: Column) -> Scan:
        self.rows = self.rows.withColumn(name, value).drop("_c")
        return self

    def previous(self, *cols: str, name: str = "_prev") -> Scan:
        """The row before, as a struct of cols; null for the first row."""
        row = F.struct(*cols)
        carry = self._carry("last", F.max_by(row, F.struct(*self.order)))
        own = F.lag(row).over(self.window())
        return self._put(name, own if carry is None else F.coalesce(own, carry))

    def total(self, col: Column, name: str) -> Scan:
        """The sum up to the row."""
        self.rows = self.rows.withColumn("_x", col)
        carry = self._carry("sum", F.sum("_x"))
        own = F.sum("_x").over(self._upto())
        self._put(name, own if carry is None else own + F.coalesce(F.col(carry), F.lit(0)))
        self.rows = self.rows.drop("_x")
        return self

    def number(self, name: str) -> Scan:
        """Numbers the rows from 1."""
        carry = self._carry("sum", F.count("*"))
        own = F.row_number().over(self.window())
        return self._put(name, own if carry is None else (own + F.coalesce(F.col(carry), F.lit(0))).cast("int"))

    def newest(self, col: str, name: str) -> Scan:
        """The last value that isn't null, up to the row."""
        carry = self._carry("last", F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*self.order))))
        own = F.last(col, True).over(self._upto())
        return self._put(name, own if carry is None else F.coalesce(own, carry))

    def coming(self, col: str, name: str) -> Scan:
        """The first value that isn't null, from the row on."""
        carry = self._carry("last", F.min_by(col, F.when(F.col(col).isNotNull(), F.struct(*self.order))), after=True)
        own = F.first(col, True).over(self.window().rowsBetween(0, Window.unboundedFollowing))
        return self._put(name, own if carry is None else F.coalesce(own, carry))

    def islands(self, new, *cols: str) -> Scan:
        """Adds _island, which counts the rows that begin one. new: from the row before (a struct of cols) whether a row does; null counts as yes."""
        self.previous(*cols)
        return self.total(F.coalesce(new(F.col("_prev")), F.lit(True)).cast("int"), "_island")

    def done(self, *drop: str) -> DataFrame:
        return self.rows.drop("_g", "_prev", *drop)


def bins(at: Column, size: float | None) -> Column | None:
    """Blocks of ``size`` seconds, or of so many lines; None without a size."""
    return None if size is None else F.floor(at / size)


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """All rows numbered from 1 in an order of the whole table, and in that order.

    Rows are sorted in ranges, which are kept (this runs a job), and the ranges' sizes, a row each, are added up: no task takes in more than its range."""
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of as many rows as there are ranges
    return held.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def exact_median(rows: DataFrame, by: list[str], col: str, name: str, buckets: int = 1024) -> DataFrame:
    """The median of each group, exact, without holding a group: its distinct values are counted, dealt to ``buckets`` of its range, and
    added up bucket by bucket until the middle is reached. Nulls don't count; a group of nulls alone has none."""
    each = rows.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_by", F.struct(*by))
    edges = each.groupBy("_by").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    place = F.nanvl((F.col("_v") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0), F.lit(1.0))
    upto = Scan(each.join(edges, "_by"), ["_by"], ["_v"], F.floor(F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0)) * buckets)).total(F.col("_n"), "_upto").done()
    holds = lambda k: (F.col("_upto") - F.col("_n") < k) & (F.col("_upto") >= k)
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    middle = upto.groupBy(*by).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name))
    groups = rows.select(F.struct(*by).alias("_by")).distinct()
    return groups.join(middle.select(F.struct(*by).alias("_by"), name), "_by", "left").select("_by.*", name)


def streamed(rows: DataFrame, keys, order: list[str], make: Callable[[Iterator[tuple]], Iterator[tuple]], columns: str) -> DataFrame:
    """For rules that depend on their own earlier output: ``make`` reads the rows of one key in order, as tuples of the other columns, and
    gives tuples of ``columns`` as it goes. What it doesn't hold isn't held: an episode is never in memory as a whole."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    # dealt by a struct: where rows are a union of parts that are dealt by the keys already, Spark (4.1) leaves out a repartition by the same keys, and adaptive
    # execution may then merge each part's partitions in its own way
    src = rows.withColumn("_key", F.struct(*keys)).repartition("_key").sortWithinPartitions(*keys, *order).select(*keys, *rest)
    kept = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)
    made_ = StructType.fromDDL(columns)
    names = [*keys, *made_.names]
    kinds = [to_arrow_type(f.dataType) for f in [*src.select(*keys).schema.fields, *made_.fields]]
    n, most = len(keys), 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, len(b), most):
                    yield from zip(*(c.slice(at, most).to_pylist() for c in b.columns), strict=True)

        def out(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        made: list[tuple] = []
        for key, own in groupby(each(), lambda r: r[:n]):
            for row in make(r[n:] for r in own):
                made.append((*key, *row))
                if len(made) == most:
                    yield out(made)
                    made = []
        if made:
            yield out(made)

    return src.mapInArrow(run, f"{kept}, {columns}")
