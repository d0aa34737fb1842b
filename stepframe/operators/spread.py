"""Split groups that are too large for one task into ordered pieces.

A window over ``PARTITION BY key ORDER BY ...`` sorts each group in a single task. When one key
holds a third of a 100 TB table (or there is no key at all) that task never ends. ``Spread`` gives
every row a *piece* number such that

* pieces of one group follow the group's order, so an ordered step works piece by piece and then
  needs only a small carry from the earlier pieces (a count, a sum, the edge rows);
* the piece is a pure function of the row's own values against literal cut points. Nothing depends
  on task ids or random numbers, so a lost executor recomputes exactly the same pieces;
* groups below ``stepframe.pieceRows`` rows stay whole and cost nothing extra.

Cut points come from a bounded sample of the key and order columns only. The sample steers the
balance, never the result: any set of cut points gives the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import Key, same_keys, sort_columns

PIECE = "__piece"
_CUTS = "__cuts"
_COPY = "__copy"

#: rows one task may sort; a larger group is split. Session setting ``stepframe.pieceRows``.
PIECE_ROWS = 2_000_000
#: bound for cut points kept on the driver and broadcast; piece size grows beyond it.
MAX_PIECES = 10_000
#: sampled rows per piece
_SAMPLE_PER_PIECE = 20
#: up to this many cut points are written into the plan as a decision tree of literals
_TREE_CUTS = 512


def piece_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("stepframe.pieceRows", str(PIECE_ROWS)))


def _sample(df: DataFrame, cols: Sequence[str], rows: int, wanted: int) -> tuple[DataFrame, float]:
    fraction = min(1.0, wanted / max(rows, 1))
    narrow = df.select(*cols)
    return (narrow if fraction >= 1.0 else narrow.sample(fraction, seed=17)), fraction


def fan_out(df: DataFrame) -> DataFrame:
    """Spread rows over all cores before row-wise work that is heavy on the processor.

    Only where the input comes from fewer files than there are cores. Other inputs have enough partitions of their own
    and pass unchanged, and so does one that is not read from files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def has_hot_group(df: DataFrame, by: Sequence[str]) -> bool:
    """True when some group of ``by`` is larger than one piece. Reads only the key columns.

    Judged from a sample: the answer chooses a plan, both plans give the same rows.
    """
    limit = piece_rows(df.sparkSession)
    rows = df.count()
    if rows <= limit:
        return False
    limit = max(limit, math.ceil(rows / MAX_PIECES))
    sample, fraction = _sample(df, by, rows, _SAMPLE_PER_PIECE * math.ceil(rows / limit))
    top = sample.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return top / fraction > limit


def number_copies(df: DataFrame, name: str, block: int = 100_000) -> DataFrame:
    """Number the copies of equal rows 0, 1, ... without bringing them together.

    Copies are counted by a partial aggregate and written out again in blocks that spread over
    all tasks, so a row with very many copies is neither sorted nor listed in one place.
    """
    last = F.col("__n") - 1
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor(last / F.lit(block)))))
    placed = blocks.repartition(F.xxhash64(*df.columns, "__block"))
    start = F.col("__block") * block
    numbers = F.sequence(start, F.least(start + (block - 1), last))
    return placed.select(*df.columns, F.explode(numbers).alias(name))


class Spread:
    """``frame`` is the input plus the piece number; ``parts`` are the window partition columns."""

    def __init__(self, df: DataFrame, by: Sequence[str], keys: Sequence[Key]):
        self.by, self.keys = list(by), list(keys)
        self._names = df.columns
        cuts = self._find_cuts(df)
        if self._copies and set(self.by) | {k.name for k in self.keys} == set(df.columns):
            # equal rows fill more than a piece: tell them apart, then cut again
            df = number_copies(df, _COPY)
            self.keys = [*self.keys, Key(_COPY)]
            cuts = self._find_cuts(df)
        self.split = bool(cuts)
        self.parts = self.by + [PIECE] if self.split else self.by
        self._pieces = self._with_piece(df, cuts) if self.split else df
        self.frame = self._pieces

    # -- planning ---------------------------------------------------------------------------

    def _find_cuts(self, df: DataFrame) -> list[tuple]:
        """[(by values, cut points)] for groups that need splitting; bounded by MAX_PIECES."""
        self._copies = False
        spark, rows = df.sparkSession, df.count()
        limit = max(piece_rows(spark), math.ceil(rows / MAX_PIECES), 1)
        if self.by:
            if rows <= limit:
                return []
            pieces = math.ceil(rows / limit)
        else:
            # no key: always several pieces, the whole table must not meet in one task
            pieces = min(MAX_PIECES, max(math.ceil(rows / limit), spark.sparkContext.defaultParallelism))
            limit = max(1, math.ceil(rows / pieces))
        wanted = max(1_000, _SAMPLE_PER_PIECE * pieces)
        names = self.by + [k.name for k in self.keys]
        sample, fraction = _sample(df, names, rows, wanted)
        # a bounded sample, so one task can sort it the way Spark sorts
        ordered = sample.repartition(1).sortWithinPartitions(
            *sort_columns([Key(b) for b in self.by]), *sort_columns(self.keys)
        )
        groups: dict[tuple, list[tuple]] = {}
        for r in ordered.collect():
            values = tuple(r)
            groups.setdefault(values[: len(self.by)], []).append(values[len(self.by):])
        hot = []
        for key, members in groups.items():
            n = math.ceil(len(members) / fraction / limit)
            if n < 2:
                continue
            picks = [members[len(members) * j // n] for j in range(1, n)]
            self._copies |= any(a == b for a, b in zip(picks, picks[1:]))
            hot.append((*key, [p for i, p in enumerate(picks) if i == 0 or p != picks[i - 1]]))
        return hot or ([([],)] if not self.by else [])

    def _with_piece(self, df: DataFrame, cuts: list[tuple]) -> DataFrame:
        """Add the piece number: 0, 1, ... within a split group, missing in groups that stay whole."""
        types = {f.name: f.dataType for f in df.schema.fields}
        names = self.by + [k.name for k in self.keys]
        simple = all(isinstance(types[n], T.AtomicType) for n in names)
        if simple and sum(len(c[-1]) + 1 for c in cuts) <= _TREE_CUTS:
            return df.withColumn(PIECE, self._tree(cuts, types))
        return self._by_table(df, cuts, types)

    def _before(self, cut: Sequence[Column]) -> Column:
        """True when the row sorts before the cut point."""
        result = F.lit(False)
        for k, c in reversed(list(zip(self.keys, cut))):
            v = F.col(k.name)
            if k.desc:
                less = F.coalesce(v > c, v.isNotNull() & c.isNull())
            else:
                less = F.coalesce(v < c, v.isNull() & c.isNotNull())
            result = less | (v.eqNullSafe(c) & result)
        return result

    def _tree(self, cuts: list[tuple], types: dict[str, T.DataType]) -> Column:
        """Nested comparisons with literals: log2(cuts) per row, inside generated code."""

        def search(points: list[tuple], lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            cut = [F.lit(v).cast(types[k.name]) for k, v in zip(self.keys, points[mid])]
            return F.when(self._before(cut), search(points, lo, mid)).otherwise(
                search(points, mid + 1, hi)
            )

        if not self.by:
            return search(cuts[0][-1], 0, len(cuts[0][-1]))
        piece = None
        for *key, points in cuts:
            same = same_keys((F.col(b), F.lit(v).cast(types[b])) for b, v in zip(self.by, key))
            found = search(points, 0, len(points))
            piece = F.when(same, found) if piece is None else piece.when(same, found)
        return piece

    def _by_table(self, df: DataFrame, cuts: list[tuple], types: dict[str, T.DataType]) -> DataFrame:
        """Many cut points: a broadcast table of sorted arrays, at most MAX_PIECES entries."""
        cut_type = T.StructType(
            [T.StructField(f"k{i}", types[k.name]) for i, k in enumerate(self.keys)]
        )
        schema = T.StructType(
            [T.StructField(f"__by{i}", types[b]) for i, b in enumerate(self.by)]
            + [T.StructField(_CUTS, T.ArrayType(cut_type))]
        )
        table = df.sparkSession.createDataFrame(cuts, schema)
        if self.by:
            on = same_keys((df[b], table[f"__by{i}"]) for i, b in enumerate(self.by))
            found = df.join(F.broadcast(table), on, "left").drop(*[f"__by{i}" for i in range(len(self.by))])
        else:
            found = df.withColumn(_CUTS, table.select(_CUTS).scalar())
        most = max(len(c[-1]) for c in cuts)
        return found.withColumn(PIECE, self._array_search(F.col(_CUTS), most)).drop(_CUTS)

    def _array_search(self, cuts: Column, most: int) -> Column:
        """Number of cut points at or before the row, by binary search in the sorted array."""

        def narrow(acc: Column, _step: Column) -> Column:
            lo, hi = acc.getField("lo"), acc.getField("hi")
            mid = F.shiftright(lo + hi, 1)
            point = F.get(cuts, mid)
            cut = [point.getField(f"k{i}") for i in range(len(self.keys))]
            return (
                F.when(lo >= hi, acc)
                .when(self._before(cut), F.struct(lo.alias("lo"), mid.alias("hi")))
                .otherwise(F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            )

        steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
        start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
        found = F.aggregate(steps, start, narrow, lambda acc: acc.getField("lo"))
        return F.when(cuts.isNotNull(), found)

    # -- ordered steps ----------------------------------------------------------------------

    def add(self, name: str, expr: Column) -> None:
        """A column for the steps to work on."""
        self._pieces = self._pieces.withColumn(name, expr)
        self.frame = self.frame.withColumn(name, expr)

    def window(self, reverse: bool = False):
        return Window.partitionBy(*self.parts).orderBy(*sort_columns(self.keys, reverse))

    def rows_so_far(self):
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def carry(self, **totals: Column) -> DataFrame:
        """One row per piece of a split group with the total over all *earlier* pieces."""
        per_piece = (
            self._pieces.where(F.col(PIECE).isNotNull()).groupBy(*self.parts).agg(*[c.alias(n) for n, c in totals.items()])
        )
        earlier = (
            Window.partitionBy(*self.by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
        )
        return per_piece.select(*self.parts, *[F.sum(n).over(earlier).alias(n) for n in totals])

    def edges(self, value: str, n: int, forward: bool) -> DataFrame:
        """Per piece of a split group: up to ``n`` nearest values outside it, nearest first.

        ``forward=False`` looks at earlier pieces, ``forward=True`` at later ones. Each piece
        contributes at most ``n`` rows, found by a pruned row-number filter.
        """
        nearest = (
            self._pieces.where(F.col(PIECE).isNotNull())
            .withColumn("__rn", F.row_number().over(self.window(reverse=not forward)))
            .where(F.col("__rn") <= n)
            .groupBy(*self.parts)
            .agg(F.sort_array(F.collect_list(F.struct("__rn", F.col(value).alias("v")))).alias("__own"))
        )
        order = F.col(PIECE) if forward else F.col(PIECE).desc()
        # every piece here has a row at least, so the nearest n pieces hold what is wanted
        after = Window.partitionBy(*self.by).orderBy(order).rowsBetween(1, n)
        others = F.slice(F.flatten(F.collect_list("__own").over(after)), 1, n)
        return nearest.select(*self.parts, F.transform(others, lambda x: x.getField("v")).alias("__edge"))

    def attach(self, small: DataFrame) -> DataFrame:
        """Join a per-piece table (at most 2 x MAX_PIECES rows) to the rows."""
        renamed = small.withColumnsRenamed({p: f"__p_{p}" for p in self.parts})
        on = same_keys((F.col(p), F.col(f"__p_{p}")) for p in self.parts)
        return self.frame.join(F.broadcast(renamed), on, "left").drop(*[f"__p_{p}" for p in self.parts])

    def finish(self, df: DataFrame, *new: str) -> DataFrame:
        """Input columns in their order, then the new ones."""
        return df.select(*[c for c in self._names if c not in new], *new)
