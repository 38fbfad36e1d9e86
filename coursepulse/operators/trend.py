"""Local quadratic trend (LOESS) through points, at every point or as a curve, for any number of points.

Cleveland (1979), Robust Locally Weighted Regression and Smoothing Scatterplots; Cleveland and Grosse
(1991), Computational Methods for Local Regression.

A fit at c weighs the nearest points by (1 - |u|^3)^3 with u = (x - c) / reach. On either side of c that is a
polynomial in x, so the sums of a fit follow from sums of powers over runs of neighbouring points. These are
kept for blocks of 1, 2, 4, ... points around each block's middle; a neighbourhood is put together from a few
blocks of each size by a join on the block's number, and moved from the block's middle to c. So
n fits take n log n rows, not n * n pairs, and no task or row ever holds all points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursepulse.sources.store import checkpointed

# Share of the points that shape each fit, share of a neighbourhood that a cell may hold, and part of the range
# by which the outer cells exceed the points (fixed values).
SPAN = 0.75
CELL = 0.2
MARGIN = 0.005
# Positions of a drawn curve (fixed value).
POSITIONS = 80
# Ranges of x that are sorted apart.
RANGES = 64
# The weight on the right of c as coefficients by power of u; odd powers change sign on the left.
TRICUBE = {0: 1, 3: -3, 6: 3, 9: -1}
X_MOMENTS, Y_MOMENTS = 5, 3
TOP = max(TRICUBE)


@dataclass(frozen=True)
class Ranked:
    """Points (x, y, r) by place r from 0, stored; their number; values that part x into ranges of like size."""

    points: DataFrame
    n: int
    splits: tuple[float, ...]


def _array(values: Sequence[float]) -> Column:
    """A literal array, parsed in one go."""
    return F.expr(f"array({', '.join(f'{v!r}D' for v in map(float, values))})")


def _in_ranges(df: DataFrame, value: Column, splits: Sequence[float]) -> DataFrame:
    """df with the number of the range that a value lies in."""
    return df.withColumn("range", F.size(F.filter(_array(splits or [0.0]), lambda s: s < value)))


def _before(ranges: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """For each column its sum over all lower ranges. The driver sees a row for each of the few ranges."""
    rows = {r.range: r for r in ranges.groupBy("range").agg(*(F.sum(c).alias(c) for c in columns)).collect()}
    out = {}
    for c in columns:
        sums = list(accumulate((rows[i][c] if i in rows else 0 for i in range(RANGES)), initial=0))
        out[c] = F.get(_array(sums), F.col("range")).cast("long")
    return out


def _ranked(numbers: DataFrame) -> Ranked:
    """Points (x, y) in order."""
    shares = [i / RANGES for i in range(1, RANGES)]
    seen = numbers.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", shares).alias("splits")).first()
    splits = tuple(seen.splits or ())
    placed = _in_ranges(numbers, F.col("x"), splits).withColumn("one", F.lit(1))
    place = F.row_number().over(W.partitionBy("range").orderBy("x", "y")) - 1
    before = _before(placed, ["one"])["one"]
    return Ranked(checkpointed(placed.select("x", "y", (place + before).alias("r"))), seen.n, splits)


def _neighbourhoods(ranked: Ranked, centres: DataFrame, q: int) -> DataFrame:
    """centres (c) with reach and the runs of places left (from a to b) and right (from b to e) of c that weigh in.

    The nearest q points of c stand side by side. They begin at the first place l at which
    x[l] + x[l + q] >= 2c; these sums rise with l, so counting the lesser ones gives l.
    """
    points = ranked.points
    upper = points.select((F.col("r") - q).alias("r"), F.col("x").alias("upper"))
    sums = points.join(upper, "r").select((F.col("x") + F.col("upper")).alias("v"), F.lit(1).alias("kind"))
    places = points.select((2 * F.col("x")).alias("v"), F.lit(2).alias("kind"))
    sought = centres.select((2 * F.col("c")).alias("v"), F.lit(0).alias("kind"), "c")
    every = sought.unionByName(sums, allowMissingColumns=True).unionByName(places, allowMissingColumns=True)
    every = _in_ranges(every, F.col("v") / 2, ranked.splits).select(
        "*", (F.col("kind") == 1).cast("long").alias("sums"), (F.col("kind") == 2).cast("long").alias("places")
    )
    before = _before(every, ["sums", "places"])
    # Centres come first among equals, so only what is less has been counted.
    upto = W.partitionBy("range").orderBy("v", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = every.select("range", "kind", "c", *(F.sum(c).over(upto).alias(c) for c in before)).where("kind = 0")
    found = counted.select(
        "c", (F.col("sums") + before["sums"]).alias("first"), (F.col("places") + before["places"]).alias("b")
    )
    found = found.withColumn("last", F.col("first") + q - 1)
    for name in ("first", "last"):
        found = found.join(points.select(F.col("r").alias(name), F.col("x").alias(f"x_{name}")), name)
    left, right = F.col("c") - F.col("x_first"), F.col("x_last") - F.col("c")
    reach = F.greatest(left, right)
    # A point as far away as the reach has no weight.
    return found.select(
        "c",
        reach.alias("reach"),
        (F.col("first") + (left == reach).cast("long")).alias("a"),
        "b",
        (F.col("last") + 1 - (right == reach).cast("long")).alias("e"),
    ).where("reach > 0 AND e - a >= 3")


def _levels(ranked: Ranked) -> list[int]:
    """Sizes of blocks as powers of two, up to one that holds all points."""
    return list(range(max(ranked.n - 1, 0).bit_length() + 1))


def _down(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def _size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _power(base: Column, k: int) -> Column:
    return F.lit(1.0) if k == 0 else F.pow(base, F.lit(k))


def _blocks(ranked: Ranked) -> DataFrame:
    """Middle, half width and sums of powers of each block (level, block), as (x - middle) / half width."""
    levels = F.lit(_levels(ranked))
    every = ranked.points.select(F.explode(levels).alias("level"), "r", "x", "y").withColumn(
        "block", _down(F.col("r"), F.col("level"))
    )
    within, size = F.col("r") - F.col("block") * _size(F.col("level")), _size(F.col("level"))
    # The points at a block's ends: two rows in all for each block.
    edges = every.where((within == 0) | (within == size - 1) | (F.col("r") == ranked.n - 1))
    low, high = F.min("x"), F.max("x")
    shape = edges.groupBy("level", "block").agg(((low + high) / 2).alias("middle"), ((high - low) / 2).alias("half"))
    shape = shape.withColumn("half", F.when(F.col("half") > 0, F.col("half")).otherwise(1.0))
    z = (F.col("x") - F.col("middle")) / F.col("half")
    powers = every.join(shape, ["level", "block"]).withColumn("z", z)
    sums = [F.sum(_power(F.col("z"), k)).alias(f"m{k}") for k in range(TOP + X_MOMENTS)]
    sums += [F.sum(F.col("y") * _power(F.col("z"), k)).alias(f"y{k}") for k in range(TOP + Y_MOMENTS)]
    summed = powers.groupBy("level", "block", "middle", "half").agg(*sums)
    return summed.select(
        "level",
        "block",
        "middle",
        "half",
        F.array(*(f"m{k}" for k in range(TOP + X_MOMENTS))).alias("m"),
        F.array(*(f"y{k}" for k in range(TOP + Y_MOMENTS))).alias("my"),
    )


def _covering(levels: Sequence[int], start: Column, end: Column, side: int) -> Column:
    """Blocks that make up the places from start up to end: at most two of each size."""

    def of(level: Column) -> Column:
        first, stop = _down(start + _size(level) - 1, level), _down(end, level)

        def block(number: Column, wanted: Column) -> Column:
            made = F.struct(F.lit(side).alias("side"), level.alias("level"), number.alias("block"))
            return F.when((first < stop) & wanted, made)

        return F.array(block(first, first % 2 == 1), block(stop - 1, stop % 2 == 1))

    return F.filter(F.flatten(F.transform(F.lit(list(levels)), of)), lambda x: x.isNotNull())


def _terms(k: int) -> Column:
    """The sum of weight * u^k over a block, as terms of its sums of powers.

    u = move + scale * z, so u^p is a sum over m of comb(p, m) * move^(p - m) * (scale * z)^m.
    """
    terms = [
        f"struct({m} AS m, {k + e - m} AS move, {factor * comb(k + e, m)}.0D AS factor, {e % 2} AS odd)"
        for e, factor in TRICUBE.items()
        for m in range(k + e + 1)
    ]
    return F.expr(f"array({', '.join(terms)})")


def _weighted(sums: str, k: int) -> Column:
    def add(total: Column, t: Column) -> Column:
        sign = F.when(t["odd"] == 1, F.col("side")).otherwise(1)
        return total + sign * t["factor"] * F.get(sums, t["m"]) * F.get("moves", t["move"])

    return F.aggregate(_terms(k), F.lit(0.0), add)


def _fits(ranked: Ranked, centres: DataFrame, span: float) -> DataFrame:
    """c, value and slope of the weighted quadratic at each centre that has one."""
    q = math.floor(ranked.n * span)
    if q < 3:
        return centres.limit(0).select("c", F.lit(0.0).alias("value"), F.lit(0.0).alias("slope"))
    levels = _levels(ranked)
    pieces = F.concat(*(_covering(levels, F.col(a), F.col(b), side) for a, b, side in (("a", "b", -1), ("b", "e", 1))))
    parts = _neighbourhoods(ranked, centres, q).select("c", "reach", F.inline(pieces))
    joined = parts.join(_blocks(ranked), ["level", "block"])
    move, scale = (F.col("middle") - F.col("c")) / F.col("reach"), F.col("half") / F.col("reach")
    top = TOP + X_MOMENTS

    def scaled(sums: str) -> Column:
        return F.transform(F.col(sums), lambda x, k: x * F.pow(F.col("scale"), k))

    moved = joined.withColumns({"move": move, "scale": scale}).select(
        "c",
        "reach",
        "side",
        scaled("m").alias("m"),
        scaled("my").alias("my"),
        F.array(*(_power(F.col("move"), k) for k in range(top))).alias("moves"),
    )
    names = [f"s{k}" for k in range(X_MOMENTS)] + [f"t{k}" for k in range(Y_MOMENTS)]
    parts = [("m", k) for k in range(X_MOMENTS)] + [("my", k) for k in range(Y_MOMENTS)]
    partial = moved.select("c", "reach", *(_weighted(s, k).alias(n) for n, (s, k) in zip(names, parts)))
    sums = partial.groupBy("c", "reach").agg(*(F.sum(n).alias(n) for n in names))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(n) for n in names)
    # Cramer's rule for the weighted normal equations.
    whole = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    value = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    slope = s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)
    return sums.select(
        "c",
        F.try_divide(value, whole).alias("value"),
        (F.try_divide(slope, whole) / F.col("reach")).alias("slope"),
    )


def _numbers(points: DataFrame, x: str, y: str) -> DataFrame:
    numbers = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return numbers.where("abs(x) < double('inf') AND abs(y) < double('inf')")


def local_trend(points: DataFrame, x: str, y: str, span: float = SPAN) -> DataFrame:
    """Add ``trend``: at each x, a quadratic fitted to the nearest ``span`` of all points.

    points: one row for each x. Tricube weights; NULL where fewer than three points weigh in, and at points
    without finite x and y, which take no part in any fit. The points are computed and put in order at once; the
    fits are lazy.
    """
    points = checkpointed(points)
    ranked = _ranked(_numbers(points, x, y))
    fits = _fits(ranked, ranked.points.select(F.col("x").alias("c")).distinct(), span)
    own = F.col(x).cast("double")
    takes_part = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    fits = fits.select(F.col("c").alias("trend_at"), F.col("value").alias("trend"))
    joined = points.join(fits, (own == F.col("trend_at")) & takes_part, "left")
    return joined.select(*(points[c] for c in points.columns), "trend")


def cell_ends(n: int, span: float = SPAN, cell: float = CELL) -> list[int]:
    """Places after which the cells end, where a cell of n points with more than its share is halved."""
    most, ends, cells = max(math.floor(n * span * cell), 1), [], [(0, n - 1)]
    while cells:
        low, high = cells.pop()
        if high - low + 1 > most:
            middle = (low + high) // 2
            ends.append(middle)
            cells += [(low, middle), (middle + 1, high)]
    return sorted(ends)


def _vertices(ranked: Ranked, span: float, cell: float) -> list[float]:
    """Ends of the cells over x; a cut between equal x is left out. There are a few, whatever the number of points."""
    last = cell_ends(ranked.n, span, cell)
    wanted = {0, ranked.n - 1, *last, *(place + 1 for place in last)}
    x = {r.r: r.x for r in ranked.points.where(F.col("r").isin(sorted(wanted))).collect()}
    low, high = x[0], x[ranked.n - 1]
    margin = MARGIN * max(high - low, max(abs(low), abs(high)) * 1e-3 + 1e-30)
    return [low - margin, *((x[i] + x[i + 1]) / 2 for i in last if x[i] < x[i + 1]), high + margin]


def drawn_trend(
    points: DataFrame, x: str, y: str, span: float = SPAN, cell: float = CELL, positions: int = POSITIONS
) -> DataFrame:
    """The trend as a curve: x at even distances over the points' range, and ``trend`` there.

    The range is cut in halves of equal numbers of points until a cell holds no more than ``cell`` of a
    neighbourhood. Quadratics are fitted at the cells' ends alone, of which there are a few whatever
    the number of points, and a cubic with the fits' values and slopes runs between them. NULL in a cell
    with an end that has no fit. No points, no rows.
    """
    ranked = _ranked(checkpointed(_numbers(points, x, y)))
    spark = points.sparkSession
    if not ranked.n:
        return spark.createDataFrame([], "x double, trend double")
    vertices = _vertices(ranked, span, cell)
    ends = spark.range(1).select(F.posexplode(_array(vertices)).alias("cell", "c"))
    ends = ends.join(_fits(ranked, ends.select("c"), span), "c", "left")
    left = ends.select("cell", *(F.col(c).alias(f"{c}_0") for c in ("c", "value", "slope")))
    right = ends.select(F.col("cell") - 1, *(F.col(c).alias(f"{c}_1") for c in ("c", "value", "slope")))
    right = right.toDF("cell", "c_1", "value_1", "slope_1")
    low, high = ranked.points.agg(F.min("x"), F.max("x")).first()
    step = (high - low) / max(positions - 1, 1)
    grid = spark.range(positions).select((F.lit(low) + F.col("id") * F.lit(step)).alias("x"))
    # The outer cells reach beyond the points, so every position has a cell.
    below = F.filter(_array(vertices[:-1]), lambda v: v <= F.col("x"))
    cells = grid.withColumn("cell", F.size(below) - 1).join(left, "cell").join(right, "cell")
    width = F.col("c_1") - F.col("c_0")
    t = (F.col("x") - F.col("c_0")) / width
    value = (
        F.pow(1 - t, F.lit(2)) * (1 + 2 * t) * F.col("value_0")
        + F.pow(t, F.lit(2)) * (3 - 2 * t) * F.col("value_1")
        + width * (t * F.pow(1 - t, F.lit(2)) * F.col("slope_0") - F.pow(t, F.lit(2)) * (1 - t) * F.col("slope_1"))
    )
    return cells.select("x", value.alias("trend"))
