"""The data behind the charts: histograms, density curves, trend lines, samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.errors import check
from censusloom.functions.scalars import number
from censusloom.functions.tails import student_two_sided
from censusloom.operators.ranks import hash_order

# Fine bins of a density curve: their width in bandwidths, their number, and how far a kernel reaches.
BIN_SHARE = 1e-3
MAX_BINS = 1 << 22
KERNEL_REACH = 9.0


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bin counts of each column: (column, bin, low, high, count).

    The last bin includes its upper edge. Empty bins are listed with a count of 0.
    """
    check(bins >= 1, "bins must be at least 1")
    columns = list(columns)
    values = df.select(*[number(df, name).alias(name) for name in columns])
    long = values.unpivot([], columns, "column", "x").where(F.col("x").isNotNull())
    # One row per column of the schema.
    ranges = long.groupBy("column").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    ranges = ranges.withColumn("_flat", F.col("_low") == F.col("_high"))
    ranges = ranges.select(
        "column",
        F.when(F.col("_flat"), F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(F.col("_flat"), F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"),
    ).withColumn("_width", (F.col("_high") - F.col("_low")) / F.lit(float(bins)))

    def edge(index):
        return F.col("_low") + index * F.col("_width")

    rough = F.least(F.floor((F.col("x") - F.col("_low")) / F.col("_width")), F.lit(bins - 1)).cast("int")
    # Rounding may put a value on the wrong side of an edge; compare with the edges.
    settled = (
        F.when(F.col("x") < edge(F.col("_rough")), F.col("_rough") - 1)
        .when((F.col("_rough") < bins - 1) & (F.col("x") >= edge(F.col("_rough") + 1)), F.col("_rough") + 1)
        .otherwise(F.col("_rough"))
    )
    counted = (
        long.join(F.broadcast(ranges), "column")
        .withColumn("_rough", rough)
        .groupBy("column", settled.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("_found"))
    )
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("_found", F.lit(0)).alias("count"),
    )


def density_curve(df: DataFrame, column: str, points: int = 200, binned: bool = False) -> DataFrame:
    """Gaussian kernel density of a column on an even grid from its minimum to its maximum.

    The bandwidth is Scott's rule, std (n-1) times n^(-1/5). Equal values are counted
    first; each counted value then adds to the fixed grid inside its own map task, so
    only ``points`` partial sums per task are shuffled.

    ``binned`` shares every value linearly between two of many fine bins first, a thousandth
    of the bandwidth apart, and adds up the bins within nine bandwidths of each point. The
    cost is rows + bins x points near them instead of values x points, and the curve differs
    by less than 1e-6 of its peak. A range of more than ``MAX_BINS`` bins is not binned.
    """
    check(points >= 2, "points must be at least 2")
    values = df.select(number(df, column).alias("x")).where(F.col("x").isNotNull())
    facts = values.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")
    ).first()
    check(facts["n"] >= 2 and facts["s"] > 0, f"{column} does not vary, so it has no density curve")
    n, low, high = facts["n"], facts["lo"], facts["hi"]
    width = facts["s"] * n ** (-1 / 5)
    step = (high - low) / (points - 1)
    place = F.lit(low) + F.col("point") * F.lit(step)
    z = (place - F.col("x")) / F.lit(width)
    bins = math.ceil((high - low) / width / BIN_SHARE)
    near = F.sequence(F.lit(0), F.lit(points - 1))
    if binned and bins <= MAX_BINS:
        counted = _linear_bins(values, low, (high - low) / bins, bins)
        first = F.ceil((F.col("x") - F.lit(low + KERNEL_REACH * width)) / F.lit(step))
        last = F.floor((F.col("x") - F.lit(low - KERNEL_REACH * width)) / F.lit(step))
        first = F.greatest(first, F.lit(0)).cast("int")
        last = F.least(last, F.lit(points - 1)).cast("int")
        near = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
    else:
        counted = values.groupBy("x").agg(F.count(F.lit(1)).alias("_count"))
    masses = (
        counted.withColumn("point", F.explode(near))
        .groupBy("point")
        .agg(F.sum(F.col("_count") * F.exp(-0.5 * z * z)).alias("_mass"))
    )
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    return grid.join(F.broadcast(masses), "point", "left").select(
        "point",
        place.alias("x"),
        (F.coalesce("_mass", F.lit(0.0)) / F.lit(n * width * math.sqrt(2 * math.pi))).alias("density"),
    )


def _linear_bins(values: DataFrame, low: float, width: float, bins: int) -> DataFrame:
    """(x, _count): each value's weight shared between the two bin edges around it."""
    place = (F.col("x") - F.lit(low)) / F.lit(width)
    left = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    share = F.col("_place") - F.col("_left")
    halves = F.array(
        F.struct(F.col("_left").alias("bin"), (1 - share).alias("part")),
        F.struct((F.col("_left") + 1).alias("bin"), share.alias("part")),
    )
    shared = values.select(place.alias("_place"), left.alias("_left")).select(F.explode(halves).alias("half"))
    sums = shared.groupBy("half.bin").agg(F.sum("half.part").alias("_count"))
    return sums.select((F.lit(low) + F.col("bin") * F.lit(width)).alias("x"), "_count")


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x``: one row, with what its error band needs.

    The band around a point is ``t * residual_sd * sqrt(1/n + (point - mean_x)^2 / sxx)``.
    """
    pairs = df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna()
    residual = F.regr_syy("y", "x") - F.try_divide(
        F.regr_sxy("y", "x") * F.regr_sxy("y", "x"), F.regr_sxx("y", "x")
    )
    n = F.count(F.lit(1))
    slope = F.try_divide(F.regr_sxy("y", "x"), F.regr_sxx("y", "x"))
    return pairs.agg(
        n.alias("n"),
        slope.alias("slope"),
        (F.avg("y") - slope * F.avg("x")).alias("intercept"),
        F.avg("x").alias("mean_x"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.sqrt(F.try_divide(F.greatest(residual, F.lit(0.0)), n - 2)).alias("residual_sd"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
    )


def t_quantile(share: float, freedom: int) -> float:
    """Quantile of Student's t: an expansion around the normal one, exact to 1e-9 from 200 degrees on."""
    z = NormalDist().inv_cdf(share)
    v = float(freedom)
    found = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)
    found += (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    if freedom >= 200:
        return found
    low, high = 0.0, 2.0
    tail = 1 - share if share > 0.5 else share
    while student_two_sided(high, freedom) > 2 * tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if student_two_sided(middle, freedom) > 2 * tail else (low, middle)
    return low if share > 0.5 else -low


def regression_band(
    df: DataFrame,
    x: str,
    y: str,
    key: str,
    points: int = 100,
    replicates: int = 1000,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """The regression line with two bands: (point, x, fitted, low, high, t_low, t_high).

    ``low`` and ``high`` are percentiles over bootstrap lines. In each replicate a row has a
    Poisson(1) weight that follows from a hash of its key and the replicate, so the band does
    not depend on partitions and survives lost executors, and a retried task repeats its
    weights. One pass adds up all replicates: a task hands on five sums for each. ``t_low``
    and ``t_high`` are the analytic band. Rows with a NULL in x, y or the key are left out.
    """
    check(points >= 2 and replicates >= 2, "a band needs at least two points and two replicates")
    line = regression_line(df.where(F.col(key).isNotNull()), x, y).first()
    check(line["n"] >= 3 and line["slope"] is not None, f"{x} does not vary, so {y} has no line on it")
    pairs = df.select(
        F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("key"), number(df, x).alias("x"), number(df, y).alias("y")
    ).where(F.col(key).isNotNull())
    centre_x, centre_y = line["mean_x"], line["intercept"] + line["slope"] * line["mean_x"]
    # Poisson(1): the share of draws below each count; a ninth event has a chance of 1e-6.
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    salts = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mix = _mixer()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(salts), 5))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                px = part.column("x").to_numpy(zero_copy_only=False) - centre_x
                py = part.column("y").to_numpy(zero_copy_only=False) - centre_y
                draws = (mix(keys[:, None] ^ salts[None, :]) >> np.uint64(11)).astype(float) * 2.0**-53
                weights = np.searchsorted(limits, draws.ravel(), side="right").reshape(draws.shape).astype(float)
                sums += weights.T @ np.column_stack([np.ones_like(px), px, py, px * px, px * py])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(salts), dtype=np.int32)), *[pa.array(sums[:, i]) for i in range(5)]],
            ["replicate", "n", "sx", "sy", "sxx", "sxy"],
        )

    known = pairs.dropna()
    partial = known.mapInArrow(add_up, "replicate int, n double, sx double, sy double, sxx double, sxy double")
    totals = partial.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    rows = np.array([tuple(r) for r in totals.orderBy("replicate").collect()])  # one per replicate
    n, sx, sy, sxx, sxy = rows[:, 1:].T
    spread = n * sxx - sx * sx
    usable = (n > 0) & (spread > 1e-12 * np.maximum(n * sxx, 1e-300))
    slope = (n * sxy - sx * sy)[usable] / spread[usable]
    level = sy[usable] / n[usable] - slope * sx[usable] / n[usable]
    grid = np.linspace(line["min_x"], line["max_x"], points)
    lines = level[:, None] + slope[:, None] * (grid - centre_x)[None, :] + centre_y
    low, high = np.quantile(lines, [(1 - confidence) / 2, (1 + confidence) / 2], axis=0)
    fitted = line["intercept"] + line["slope"] * grid
    t = t_quantile((1 + confidence) / 2, line["n"] - 2)
    reach = t * line["residual_sd"] * np.sqrt(1 / line["n"] + (grid - centre_x) ** 2 / line["sxx"])
    table = zip(range(points), *(c.tolist() for c in (grid, fitted, low, high, fitted - reach, fitted + reach)), strict=True)
    schema = "point int, x double, fitted double, low double, high double, t_low double, t_high double"
    return df.sparkSession.createDataFrame(list(table), schema)


def _mixer():
    """A mix of 64 bits in which every bit depends on all (nested, so that it travels by value)."""

    def mix(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    return mix


def _mixed(values: np.ndarray) -> np.ndarray:
    return _mixer()(values)


def fixed_sample(df: DataFrame, key: str, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows, the same ones in every run, chosen by a hash of the key.

    A top-k per task and one small merge; the table is not shuffled.
    """
    check(rows >= 1, "rows must be at least 1")
    order = hash_order(F.col(key), seed)
    return df.orderBy(order, key).limit(rows)
