"""Ordered per-key columns (previous, next, running total, last known) that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts the whole history of a key in one task. Here a
key's history is cut into slices by a deterministic expression of the row (a time slice, a block of
offsets, a hash prefix). Rows meet only the rows of their own slice; what crosses a slice border
is one summary row per (key, slice), built with map-side aggregation, scanned per key and joined
back on the same (key, slice) partitioning, so the rows themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.clock import DAY, HOUR, MINUTE, SECOND, micros, time_slice
from runledger.session import settle

Columns = Mapping[str, Column | str]

# slices whose summaries meet in one task where rows have no key
SLICES_PER_BLOCK = 4_096

ROWS_PER_SLICE = 2_000_000
MOST_CUTS = 200_000  # slices cut further at one level, which is what a broadcast of them may hold
SMALL_BYTES = 64 << 20  # input that can hold no slice worth cutting
HASHES = 8_192  # into which keys are dealt for a first count, which bounds that of each key from above
_TIME_WIDTHS = [DAY, 6 * HOUR, HOUR, 10 * MINUTE, MINUTE, 10 * SECOND, SECOND, 100_000, 10_000, 1_000, 100, 10, 1]
_NUMBER_WIDTHS = [1 << k for k in (40, 32, 24, 20, 16, 12, 8, 4, 0)]


@dataclass(frozen=True)
class Cut:
    """Slices of a time or whole-number column whose widths follow the data, for ``scan``.

    A slice is ``width`` wide (microseconds of a time). One that holds more than ``rows`` rows of a key is cut into narrower ones,
    and so on down to 1; a single value that is still too large is cut by ``then``, a whole-number column that comes right
    after in the order. Data without hot slices costs one count, and input below ``least_bytes`` none. Only rows of slices found too
    large are counted again: by second, then by microsecond, then by ``then``, each time once for all widths between. What is
    sent to all tasks is one row for each slice cut further; ``rows`` is raised where they would be more than ``MOST_CUTS``.
    """

    column: str
    width: int
    then: str | None = None
    time: bool = True
    rows: int = ROWS_PER_SLICE
    least_bytes: int = SMALL_BYTES

    def plain(self) -> Column:
        """Number of the slice, all slices ``width`` wide."""
        return time_slice(self.column, self.width) if self.time else F.floor(F.col(self.column) / self.width)

    def _value(self) -> Column:
        return micros(self.column) if self.time else F.col(self.column).cast("long")

    def _widths(self, df: DataFrame) -> list[tuple[bool, list[int]]]:
        """Widths to cut by, in groups that are counted together: the whole slice, narrower ones, then those of ``then``."""
        narrower = [self.width]
        for w in _TIME_WIDTHS if self.time else _NUMBER_WIDTHS:
            if w < narrower[-1] and narrower[-1] % w == 0:
                narrower.append(w)
        coarse = [w for w in narrower[1:] if self.time and w >= SECOND]
        groups = [(False, g) for g in ([self.width], coarse, [w for w in narrower[1:] if w not in coarse]) if g]
        if self.then and df.schema[self.then].dataType.typeName() in ("byte", "short", "integer", "long"):
            groups.append((True, _NUMBER_WIDTHS))
        return groups

    def slices(self, df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
        """``df``, with the column ``_cut`` if slices had to be cut, and the slice of a row."""
        if input_bytes(df) < self.least_bytes:
            return df, self.plain()
        of_key = F.struct(*[F.col(k).alias(f"k{j}") for j, k in enumerate(keys)], F.lit(0).alias("k"))
        zero = F.lit(0).cast("long")

        def below(v: Column, w: int) -> Column:
            return v - F.pmod(v, F.lit(w))

        def cell(by_then: bool, w: int) -> Column:
            """The slice of width ``w`` that holds a row, of its key: (key, at, v)."""
            value = F.col(self.then).cast("long") if by_then else self._value()
            return F.struct(of_key.alias("key"), (self._value() if by_then else zero).alias("at"), below(value, w).alias("v"))

        most, rest = self.rows, df.select(*dict.fromkeys([*keys, self.column, *([self.then] if self.then else [])]))
        levels: list[tuple[bool, int, DataFrame]] = []  # of each width in turn, the slices that are cut further
        for by_then, widths in self._widths(df):
            fine = settle(rest.groupBy(cell(by_then, widths[-1]).alias("_c")).agg(F.count("*").alias("_n")).select("_c.*", "_n"))
            if not levels:
                most = max(most, (fine.agg(F.sum("_n")).first()[0] or 0) // MOST_CUTS)
            at = F.array(*[F.struct(F.lit(i).alias("i"), below(F.col("v"), w).alias("v")) for i, w in enumerate(widths)])
            summed = fine.select("key", "at", "_n", F.explode(at).alias("w")).groupBy("key", "at", "w.i", "w.v").agg(F.sum("_n").alias("_n"))
            large = settle(summed.where(F.col("_n") > most).select("i", F.struct("key", "at", "v").alias("_cell")))
            deep = large.agg(F.max("i")).first()[0]
            depth = -1 if deep is None else deep
            levels += [(by_then, w, large.where(F.col("i") == i).select("_cell")) for i, w in enumerate(widths[: depth + 1])]
            if depth < len(widths) - 1:
                levels.append((by_then, widths[depth + 1], None))
                break
            rest = settle(
                rest.withColumn("_cell", cell(by_then, widths[-1])).join(F.broadcast(levels[-1][2]), "_cell", "left_semi").drop("_cell")
            )
        if len(levels) == 1:
            return df, self.plain()

        def slice_at(by_then: bool, w: int) -> Column:
            own = cell(by_then, w)
            return F.struct(own["at"].alias("at"), own["v"].alias("part")) if by_then else F.struct(own["v"].alias("at"), zero.alias("part"))

        chosen = slice_at(*levels[-1][:2])
        for i, (by_then, w, _) in reversed(list(enumerate(levels[:-1]))):
            chosen = F.when(F.col(f"_on{i}").isNull(), slice_at(by_then, w)).otherwise(chosen)
        for i, (by_then, w, large) in enumerate(levels[:-1]):
            df = df.withColumn("_cell", cell(by_then, w)).join(F.broadcast(large.withColumn(f"_on{i}", F.lit(True))), "_cell", "left").drop("_cell")
        return df.withColumn("_cut", chosen).drop(*[f"_on{i}" for i in range(len(levels) - 1)]), F.col("_cut")


def by_time(ts: str, width_us: int, then: str | None = None) -> Cut:
    return Cut(ts, width_us, then)


def by_number(column: str, width: int, then: str | None = None) -> Cut:
    return Cut(column, width, then, time=False)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables and files that a frame reads, as its plan knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column | Cut | None,
    *,
    keep_slice: bool = False,
    prev: Columns | None = None,
    next: Columns | None = None,
    total: Columns | None = None,
    known: Columns | None = None,
    whole: Columns | None = None,
    first: Columns | None = None,
) -> DataFrame:
    """Add ordered columns to ``df``.

    ``order`` must be ascending, non-null, and unique per key where the result depends on it;
    ``slice_by`` must not decrease along ``order``; a ``Cut`` fits its slices to the data. A second scan over the same keys and slices finds
    the ``_slice`` and ``_key`` columns kept by the first (``keep_slice``) and needs no further shuffle of the
    rows. Null keys are keys like any other.

    prev / next   value on the neighbouring row (null at the ends)
    total         running sum up to and including the row
    known         last non-null value up to and including the row
    whole         sum over all rows of the key
    first         value on the key's first row

    Without ``slice_by`` a key meets whole, in one task.
    Without keys, ``slice_by`` must be a whole number: the summaries of neighbouring slices then meet in blocks.

    Give prev, next or first the name of the leading order column where that is what is wanted: its
    slice borders are plain minima and maxima, which hash-aggregate without sorting.
    """
    prev, next, total, known, whole, first = (
        dict(m or {}) for m in (prev, next, total, known, whole, first)
    )
    if slice_by is None:
        return _whole_keys(df, keys, order, prev, next, total, known, whole, first)
    names_in, width = df.columns, None
    if isinstance(slice_by, Cut):
        width = slice_by.width
        if "_slice" not in df.columns:
            df, slice_by = slice_by.slices(df, keys)
    # a struct's null fields are equal to each other, so rows of a null key meet their slices, too
    part = ["_key", "_slice"] if keys else ["_slice"]
    inputs = {
        f"_{side}_{n}": F.col(c) if isinstance(c, str) else c
        for side, columns in zip("pntkwf", (prev, next, total, known, whole, first))
        for n, c in columns.items()
    }
    again = "_slice" in df.columns
    key = {"_key": F.struct(*keys)} if keys and "_key" not in df.columns else {}
    rows = df.withColumns({**key, **inputs} if again else {"_slice": slice_by, **key, **inputs})
    position = F.struct(*order)

    def last_of(side: str, name: str, column: Column | str) -> Column:
        if isinstance(column, str) and column == order[0]:
            return F.struct(F.max(order[0]).alias(f"_{side}_{name}"))
        return F.max_by(F.struct(f"_{side}_{name}"), position)

    def first_of(side: str, name: str, column: Column | str) -> Column:
        if isinstance(column, str) and column == order[0]:
            return F.struct(F.min(order[0]).alias(f"_{side}_{name}"))
        return F.min_by(F.struct(f"_{side}_{name}"), position)

    edges = rows.groupBy(*part).agg(
        *[last_of("p", n, c).alias(f"_p_{n}") for n, c in prev.items()],
        *[first_of("n", n, c).alias(f"_n_{n}") for n, c in next.items()],
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in total],
        *[
            F.max_by(f"_k_{n}", F.when(F.col(f"_k_{n}").isNotNull(), position)).alias(f"_k_{n}")
            for n in known
        ],
        *[F.sum(f"_w_{n}").alias(f"_w_{n}") for n in whole],
        *[first_of("f", n, c).alias(f"_f_{n}") for n, c in first.items()],
    )
    names = tuple(list(m) for m in (prev, next, total, known, whole, first))
    if edges.schema["_slice"].dataType.typeName() == "struct":
        unit = F.col("_slice.at") / ((width or 1) * SLICES_PER_BLOCK)
    else:
        unit = F.col("_slice") / SLICES_PER_BLOCK
    carry = _carry(edges, part, names) if keys else _carry_in_blocks(edges, names, unit)

    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns(
        {
            **{f"_lp_{n}": F.lag(F.struct(f"_p_{n}")).over(inside) for n in prev},
            **{f"_ln_{n}": F.lead(F.struct(f"_n_{n}")).over(inside) for n in next},
            **{f"_lt_{n}": F.sum(f"_t_{n}").over(upto) for n in total},
            **{f"_lk_{n}": F.last(f"_k_{n}", ignorenulls=True).over(upto) for n in known},
        }
    )

    def near(side: str, name: str) -> Column:
        local_, carried = F.col(f"_l{side}_{name}"), F.col(f"_c{side}_{name}")
        return F.coalesce(local_, carried).getField(f"_{side}_{name}")

    keep = [c for c in names_in if c not in ("_slice", "_key") and c not in {*prev, *next, *total, *known, *whole, *first}]
    return local.join(carry, part, "left").select(
        *[F.col(c) for c in ([*part, *keep] if keep_slice else keep)],
        *[near("p", n).alias(n) for n in prev],
        *[near("n", n).alias(n) for n in next],
        *[
            F.coalesce(F.col(f"_lt_{n}") + F.col(f"_ct_{n}"), f"_lt_{n}", f"_ct_{n}").alias(n)
            for n in total
        ],
        *[F.coalesce(f"_lk_{n}", f"_ck_{n}").alias(n) for n in known],
        *[F.col(f"_cw_{n}").alias(n) for n in whole],
        *[F.col(f"_cf_{n}").getField(f"_f_{n}").alias(n) for n in first],
    )


def scan_short(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Cut, **columns: Columns) -> DataFrame:
    """``scan`` where most keys have few rows, so that a summary per slice would be as much as the rows themselves.

    Keys of up to ``slice_by.rows`` rows meet whole, in one shuffle that carries nothing but the rows; only the rows of longer
    ones are cut into slices. To find these, rows are counted by a hash of their key, then by key where a hash has too many.
    """
    short, long = short_and_long(df, keys, slice_by)
    found = scan(short, keys, order, None, **columns)
    return found if long is None else found.unionByName(scan(long, keys, order, slice_by, **columns))


def short_and_long(df: DataFrame, keys: Sequence[str], cut: Cut) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with up to ``cut.rows`` rows, and those of longer ones, None where there are none."""
    long = _long_keys(df, keys, cut)
    if long is None:
        return df, None
    marked = df.withColumn("_of", F.struct(*keys))
    return tuple(marked.join(F.broadcast(long), "_of", how).drop("_of") for how in ("left_anti", "left_semi"))


def _long_keys(df: DataFrame, keys: Sequence[str], cut: Cut) -> DataFrame | None:
    """Keys of more than ``cut.rows`` rows as the column ``_of``, None where there is no such key."""
    if input_bytes(df) < cut.least_bytes:
        return None
    of_hash = df.select(F.struct(*keys).alias("_of"), F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("_hash"))
    full = settle(of_hash.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > cut.rows).select("_hash"))
    if full.isEmpty():
        return None
    counted = of_hash.join(F.broadcast(full), "_hash", "left_semi").groupBy("_of").agg(F.count("*").alias("_n"))
    long = settle(counted.where(F.col("_n") > cut.rows).select("_of"))
    return None if long.isEmpty() else long


def _whole_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], *columns: Columns) -> DataFrame:
    """The columns of ``scan`` by plain windows, the same as from slices also where the leading order column is null."""
    prev, next, total, known, whole, first = ({n: F.col(c) if isinstance(c, str) else c for n, c in m.items()} for m in columns)
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = F.col(order[0]).isNotNull()  # rows without a place come first, but meet only their like
    joins_next = placed | F.lead(order[0]).over(inside).isNull()
    keep = [c for c in df.columns if c not in {*prev, *next, *total, *known, *whole, *first}]
    return df.select(
        *keep,
        *[F.lag(c).over(inside).alias(n) for n, c in prev.items()],
        *[F.when(joins_next, F.lead(c).over(inside)).alias(n) for n, c in next.items()],
        *[F.sum(c).over(upto).alias(n) for n, c in total.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in known.items()],
        *[F.when(placed, F.sum(c).over(Window.partitionBy(*keys))).alias(n) for n, c in whole.items()],
        *[F.when(placed, F.first(c).over(upto)).alias(n) for n, c in first.items()],
    )


def _carry(edges: DataFrame, part: Sequence[str], names: Sequence[Sequence[str]]) -> DataFrame:
    """What every slice takes over from the other slices of its key (``part`` is key and slice, in this order)."""
    prev, next, total, known, whole, first = names
    *key, at = part
    slices = Window.partitionBy(*key).orderBy(at) if key else Window.orderBy(at)
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    everything = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return edges.select(
        *part,
        *[F.lag(f"_p_{n}").over(slices).alias(f"_cp_{n}") for n in prev],
        *[F.lead(f"_n_{n}").over(slices).alias(f"_cn_{n}") for n in next],
        *[F.sum(f"_t_{n}").over(before).alias(f"_ct_{n}") for n in total],
        *[F.last(f"_k_{n}", ignorenulls=True).over(before).alias(f"_ck_{n}") for n in known],
        *[F.sum(f"_w_{n}").over(everything).alias(f"_cw_{n}") for n in whole],
        *[F.first(f"_f_{n}").over(everything).alias(f"_cf_{n}") for n in first],
    )


def _carry_in_blocks(edges: DataFrame, names: Sequence[Sequence[str]], unit: Column) -> DataFrame:
    """``_carry`` without a key: slices meet inside blocks of neighbours, and only one row per block in one task."""
    prev, next, total, known, whole, first = names
    placed = edges.withColumn("_block", F.floor(unit))
    blocks = placed.groupBy("_block").agg(
        *[F.max_by(f"_p_{n}", "_slice").alias(f"_p_{n}") for n in prev],
        *[F.min_by(f"_n_{n}", "_slice").alias(f"_n_{n}") for n in next],
        *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in total],
        *[F.max_by(f"_k_{n}", F.when(F.col(f"_k_{n}").isNotNull(), F.col("_slice"))).alias(f"_k_{n}") for n in known],
        *[F.sum(f"_w_{n}").alias(f"_w_{n}") for n in whole],
        *[F.min_by(f"_f_{n}", "_slice").alias(f"_f_{n}") for n in first],
    )
    outer = _carry(blocks, ["_block"], names).select(
        F.col("_block").alias("_b"),
        *[F.col(f"_c{side}_{n}").alias(f"_o{side}_{n}") for side, group in zip("pntkwf", names) for n in group],
    )
    near = _carry(placed, ["_block", "_slice"], (prev, next, total, known, [], []))
    return near.join(outer, F.col("_block").eqNullSafe(F.col("_b"))).select(
        "_slice",
        *[F.coalesce(f"_c{s}_{n}", f"_o{s}_{n}").alias(f"_c{s}_{n}") for s, g in zip("pnk", (prev, next, known)) for n in g],
        *[F.coalesce(F.col(f"_ct_{n}") + F.col(f"_ot_{n}"), f"_ct_{n}", f"_ot_{n}").alias(f"_ct_{n}") for n in total],
        *[F.col(f"_o{s}_{n}").alias(f"_c{s}_{n}") for s, g in zip("wf", (whole, first)) for n in g],
    )
