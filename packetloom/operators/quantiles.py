"""Exact quantiles of many columns by distributed selection.

Values are counted by ranges; the range that holds a wanted rank is counted again in finer ranges, until all of its
values are equal.  The first ranges are sign and binary exponent, so values of any magnitude spread; the later ones
are equal parts of a range's least and largest value.  Every pass serves all columns and ranks at once, a task hands on a count
for each range, and only the ranges that hold a rank come to the driver: nothing gathers a column's values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges into which a range is split: a pass divides what is left by as much, and holds as many counts in a task.
SPLIT = 1 << 12


def finite(c: Column) -> Column:
    """A number as double, null unless it is finite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _magnitude(x: Column) -> Column:
    """Sign and binary exponent, rising with x; subnormal numbers share one."""
    exponent = F.floor(F.log2(F.abs(x))) + 1100
    return F.when(x == 0, 0).when(x > 0, exponent).otherwise(-exponent).cast("long")


def _ranges(values: DataFrame, part: Column) -> DataFrame:
    """id, part, n, low, high of values(id, x), and before, total: values of the ranges before it, and of all of its entry's."""
    counted = values.groupBy("id", part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    of_entry = Window.partitionBy("id")  # a row for each range
    before = F.sum("n").over(of_entry.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("n").over(of_entry)})


def _values(df: DataFrame, xs: Sequence[Column]) -> DataFrame:
    """id, x: each column's values.  A value is computed once, and in compiled code: no function of a column stands in a lambda."""
    wide = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)])
    return wide.select(F.posexplode(F.array(*wide.columns)).alias("id", "x")).where(F.col("x").isNotNull())


def _holding(ranges: DataFrame, wanted: Mapping[int, Sequence[int]]) -> list:
    """The ranges that hold a wanted rank of their entry."""
    ranks = F.array(*[F.array(*[F.lit(k) for k in wanted.get(i, ())]).cast("array<long>") for i in range(max(wanted) + 1)])
    return ranges.where(F.exists(F.get(ranks, F.col("id")), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))).collect()


def _refined(df: DataFrame, xs: Sequence[Column], parts: Sequence[tuple[int, float, float]]) -> DataFrame:
    """The ranges of equal width from low to high of each of parts (column, low, high)."""
    used = sorted({column for column, _, _ in parts})
    wide = df.select(*[xs[i].alias(f"x{i}") for i in used])
    entries = [F.struct(F.lit(i).alias("id"), F.col(f"x{c}").alias("x"), F.lit(low).alias("from"), F.lit(high).alias("to")) for i, (c, low, high) in enumerate(parts)]
    values = wide.select(F.inline(F.array(*entries))).where("x >= from and x <= to")
    x, low, high = (F.col(c) for c in ("x", "from", "to"))
    return _ranges(values, F.least(F.floor((x - low) / (high - low) * SPLIT), F.lit(SPLIT - 1)).cast("long"))


def _select(df: DataFrame, xs: Sequence[Column], held: Sequence, wanted: Mapping[int, Sequence[int]]) -> dict[tuple[int, int], float]:
    """The values at the wanted ranks (from 0) of each column, from the first ranges that hold them on."""
    found: dict[tuple[int, int], float] = {}
    column_of, skipped = {i: i for i in wanted}, dict.fromkeys(wanted, 0)  # of each entry: its column, and the values below it
    while held:
        parts, of, below, left = [], {}, {}, {}
        for r in held:
            column, low, high = column_of[r["id"]], r["low"], r["high"]
            here = [k for k in wanted[r["id"]] if r["before"] <= k < r["before"] + r["n"]]
            if low == high:
                found |= {(column, skipped[r["id"]] + k): low for k in here}
                continue
            number = len(parts)
            parts.append((column, low, high))
            of[number], below[number], left[number] = column, skipped[r["id"]] + r["before"], [k - r["before"] for k in here]
        column_of, skipped, wanted = of, below, left
        held = _holding(_refined(df, xs, parts), wanted) if wanted else []
    return found


def quantiles(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each named column the exact quantiles (interpolated between neighbours) of its finite values, None where it has none.

    df is read once for each pass: two to four times for most data, seven at the very most."""
    names, xs = list(columns), [finite(c) for c in columns.values()]
    if not names:
        return {}
    ranges = _ranges(_values(df, xs), _magnitude(F.col("x")))
    places = [F.lit(float(q)) * (F.col("total") - 1) for q in shares]
    near = F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)])
    held = ranges.where(F.exists(near, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))).collect()
    at = {r["id"]: [q * (r["total"] - 1) for q in shares] for r in held}
    found = _select(df, xs, held, {i: sorted({r for p in ps for r in (math.floor(p), math.ceil(p))}) for i, ps in at.items()})

    def value(i: int, place: float) -> float:
        low, high = found[i, math.floor(place)], found[i, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    return {n: [value(i, p) for p in at[i]] if i in at else [None] * len(shares) for i, n in enumerate(names)}


def smallest(df: DataFrame, columns: Mapping[str, Column], ranks: Mapping[str, int]) -> dict[str, float]:
    """The finite value at a rank (from 0) of each named column; columns without as many values are left out."""
    names, xs = list(ranks), [finite(columns[n]) for n in ranks]
    if not names:
        return {}
    wanted = {i: [ranks[n]] for i, n in enumerate(names)}
    held = _holding(_ranges(_values(df, xs), _magnitude(F.col("x"))), wanted)
    return {names[i]: value for (i, _), value in _select(df, xs, held, wanted).items()}
