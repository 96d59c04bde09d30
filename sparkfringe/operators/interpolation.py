"""Stored gains on another grid: fill gaps, interpolate, and as-of lookups.

Gaps are filled along time, then along frequency, linearly, with the nearest value beyond the ends; what has no value at all
becomes 0. Within the stored grid values are bilinear (or tensor cubic splines), outside it the nearest
ones. Complex gains are interpolated as amplitude, cosine and sine of their phase, parameters as they are. A group
is one term, antenna and direction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.temporary import folder


def fill(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y`` along axis 0 at ``x``, NaN filled where a line has any value."""
    out = y.copy()
    flat = out.reshape(len(x), -1)
    for k in range(flat.shape[1]):
        good = np.isfinite(flat[:, k])
        if good.any() and not good.all():
            flat[:, k] = np.interp(x, x[good], flat[good, k])
    return out


def fill_grid(times: np.ndarray, freqs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(t, f, k) without gaps."""
    out = fill(times, values)
    out = np.swapaxes(fill(freqs, np.swapaxes(out, 0, 1)), 0, 1)
    return np.where(np.isfinite(out), out, 0.0)


def phase_interp(to: np.ndarray, x: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Phases along the shorter arc, the nearest beyond the ends."""
    return np.arctan2(np.interp(to, x, np.sin(phase)), np.interp(to, x, np.cos(phase)))


def align_correlations(gains: DataFrame, have: list[str], want: list[str]) -> DataFrame:
    """Gains on the wanted correlations: elements by label, those that aren't stored as in the identity."""
    from ..functions.jones import Cx

    one = lambda c: Cx.lit(float(c[0] == c[1])).column()
    return gains.withColumn("g", F.array(*[F.col("g")[have.index(c)] if c in have else one(c) for c in want]))


def nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.abs(x[None, :] - to[:, None]).argmin(1)


def bilinear(times, freqs, values, to_times, to_freqs) -> np.ndarray:
    """Linear along the axes of more than one point; nearest where a point is outside."""
    out = values
    for axis, (x, to) in enumerate(((times, to_times), (freqs, to_freqs))):
        if len(x) == 1:
            out = np.take(out, np.zeros(len(to), int), axis)
            continue
        k = np.clip(np.searchsorted(x, to, side="right") - 1, 0, len(x) - 2)
        w = ((to - x[k]) / (x[k + 1] - x[k])).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out = np.take(out, k, axis) * (1 - w) + np.take(out, k + 1, axis) * w
    outside = [(to < x[0]) | (to > x[-1]) if len(x) > 1 else np.zeros(len(to), bool) for x, to in ((times, to_times), (freqs, to_freqs))]
    near = values[np.ix_(nearest(times, to_times), nearest(freqs, to_freqs))]
    return np.where((outside[0][:, None] | outside[1][None, :])[..., None], near, out)


def spline(x: np.ndarray, y: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A not-a-knot cubic spline along axis 0, constant beyond the ends."""
    n = len(x)
    if n < 4:
        raise ValueError("a spline needs at least four points")
    h = np.diff(x)
    a, rhs = np.zeros((n, n)), np.zeros((n, *y.shape[1:]))
    slope = np.diff(y, axis=0) / h.reshape(-1, *[1] * (y.ndim - 1))
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        rhs[k] = 6 * (slope[k] - slope[k - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs.reshape(n, -1)).reshape(rhs.shape)
    to = np.clip(to, x[0], x[-1])
    k = np.clip(np.searchsorted(x, to, side="right") - 1, 0, n - 2)
    wide = lambda v: v.reshape(-1, *[1] * (y.ndim - 1))
    left, right, step = wide(to - x[k]), wide(x[k + 1] - to), wide(h[k])
    return (m[k] * right**3 + m[k + 1] * left**3) / (6 * step) + (y[k] / step - m[k] * step / 6) * right + (y[k + 1] / step - m[k + 1] * step / 6) * left


def spline2d(times, freqs, values, to_times, to_freqs) -> np.ndarray:
    out = spline(times, values, to_times)
    return np.swapaxes(spline(freqs, np.swapaxes(out, 0, 1), to_freqs), 0, 1)


METHODS = {"2dlinear": bilinear, "2dspline": spline2d}


def check_overlap(gains: DataFrame) -> None:
    """Stored gains of one term must not say two things of one place."""
    twice = gains.groupBy("term", "ant", "dir", "gain_time", "gain_freq").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("stored gains overlap")


def to_real(gains: DataFrame, n_corr: int) -> DataFrame:
    """``v``: amplitude, cosine and sine of every element, null where the gain is flagged."""
    from ..functions.jones import Jones, to_interpolable

    cells = [x for p in Jones.of(F.col("g"), n_corr).parts for x in to_interpolable(p).values()]
    return gains.withColumn("v", F.when(F.col("gain_flag") != 1, F.array(*cells)))


def from_real(values: DataFrame, n_corr: int) -> DataFrame:
    from ..functions.jones import Jones, from_interpolable

    cells = [from_interpolable(*[F.col("v")[3 * k + j] for j in range(3)]) for k in range(n_corr)]
    return values.withColumn("g", Jones(tuple(cells)).column()).drop("v")


def interpolate(values: DataFrame, targets: DataFrame, method: str = "2dlinear") -> DataFrame:
    """From (term, ant, dir, gain_time, gain_freq, v) onto ``targets`` (term, gain_time, gain_freq, and any further
    columns), for every antenna and direction: the targets' columns with ant, dir and v.

    Targets meet each antenna and direction of their term.
    """
    made = METHODS[method]
    some = values.where("v IS NOT NULL").select(F.size("v").alias("n")).first()
    width = some["n"] if some else 0
    extra = [c for c in targets.columns if c not in ("term", "gain_time", "gain_freq")]
    who = values.select("term", "ant", "dir").distinct()
    asked = targets.join(who, "term")
    asked = asked.select(*[F.col(c).alias(f"to_{c}") for c in asked.columns])  # names of their own for the cogroup
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    schema = ", ".join(["term string, ant int, dir int, gain_time double, gain_freq double", *[f"{c} {kinds[c]}" for c in extra], "v array<double>"])

    def run(own: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        to = to.rename(columns=lambda c: c.removeprefix("to_"))
        out = to[["term", "ant", "dir", "gain_time", "gain_freq", *extra]].copy()
        if not len(own) or not len(to):
            return out.assign(v=[[]] * len(out))
        times, at_t = np.unique(own["gain_time"], return_inverse=True)
        freqs, at_f = np.unique(own["gain_freq"], return_inverse=True)
        grid = np.full((len(times), len(freqs), width), np.nan)
        for t, f, v in zip(at_t, at_f, own["v"], strict=True):
            if v is not None:
                grid[t, f] = v
        grid = fill_grid(times, freqs, grid)
        to_t, back_t = np.unique(to["gain_time"], return_inverse=True)
        to_f, back_f = np.unique(to["gain_freq"], return_inverse=True)
        found = made(times, freqs, grid, to_t, to_f)
        return out.assign(v=list(found[back_t, back_f]))

    return values.groupBy("term", "ant", "dir").cogroup(asked.groupBy("to_term", "to_ant", "to_dir")).applyInPandas(run, schema)


def linear_lookup(known: DataFrame, wanted: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """1-D interpolation without Python: both tables in one order, the known values before and after each
    wanted place by ignoring nulls. Nearest beyond the ends.

    The order of all rows is cut into ranges, so that a long series has many tasks; the ranges are written, as cuts made anew may fall
    elsewhere. What a range knows is carried to the other ranges of its series.
    """
    spark = known.sparkSession
    rows = known.select(*keys, x, F.col(y).cast("double").alias(y), F.lit(False).alias("_w")).unionByName(
        wanted.select(*keys, x, F.lit(None).cast("double").alias(y), F.lit(True).alias("_w"))
    )
    rows, to = rows.repartitionByRange(*keys, x).withColumn("_range", F.spark_partition_id()), f"{folder(spark)}/ranges"
    rows.write.parquet(to)
    rows = spark.read.schema(rows.schema).parquet(to)
    point = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))

    # Both frames grow row by row; one from the current row to the end would be gone through anew for every row.
    own, order = Window.partitionBy(*keys, "_range"), (x, "_w", y)
    up, down = own.orderBy(*order), own.orderBy(*[F.col(c).desc() for c in order])
    whole = (Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumns({name: F.last(point, ignorenulls=True).over(w.rowsBetween(*whole)) for name, w in (("_a", up), ("_b", down))}).where("_w")

    ends = rows.groupBy(*keys, "_range").agg(F.min(point).alias("_first"), F.max(point).alias("_last"))
    ranges, others = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_of_{k}") for k in (*keys, "_range")],
        F.max("_last").over(ranges.orderBy("_range").rowsBetween(*others)).alias("_before"),
        F.min("_first").over(ranges.orderBy(F.col("_range").desc()).rowsBetween(*others)).alias("_beyond"),
    ).where("_before IS NOT NULL OR _beyond IS NOT NULL")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_range")]
    near = near.join(F.broadcast(carried), same, "left")  # a range shares at most two series with others

    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_beyond")
    slope = (b["y"] - a["y"]) / (b["x"] - a["x"])
    value = F.when(a.isNull(), b["y"]).when(b.isNull() | (b["x"] == a["x"]), a["y"]).otherwise(a["y"] + slope * (F.col(x) - a["x"]))
    return near.select(*keys, x, value.alias(y))


def smooth(rows: DataFrame, keys: list[str], order: str, value: str, good: str, sigma: float = 1.0) -> DataFrame:
    """Masked Gaussian smoothing along ``order``: the smoothed data over the smoothed mask, mirrored at the ends,
    cut at 4 sigma. Without Python: every row spreads to its neighbours, mirrored where it lies beyond an end."""
    reach = int(4 * sigma + 0.5)
    n = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(n.orderBy(order)) - 1).withColumn("_n", F.count("*").over(n))
    spread = ranked.where(F.col(good)).select(*keys, "_i", "_n", F.col(value).alias("_x"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_k"))
    # A tap of place j at distance k reads place j + k of the mirrored series, so place i serves all j that mirror to it.
    period = 2 * F.col("_n")
    places = F.array(F.col("_i") - F.col("_k"), -F.col("_i") - 1 - F.col("_k"), period - 1 - F.col("_i") - F.col("_k"))
    weight = F.exp(-(F.col("_k") * F.col("_k")) / (2 * sigma * sigma))
    taps = spread.select(*keys, "_n", "_x", weight.alias("_w"), F.explode(places).alias("_i")).where("_i >= 0 AND _i < _n")
    sums = taps.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_sx"), F.sum("_w").alias("_sw"))
    out = ranked.join(sums, [*keys, "_i"], "left")
    return out.withColumn("smoothed", F.when(F.col("_sw") > 0, F.col("_sx") / F.col("_sw")).otherwise(0.0)).drop("_i", "_n", "_sx", "_sw")
