"""Outliers by median absolute deviation of whitened residuals, per baseline and per chunk.

Medians are exact: of baselines, whose rows meet anyway, from sorted lists in one shuffle; of whole chunks, which may be any
size, by narrowing down, without bringing their rows together. Soft flags (-1) count as good here, as do autocorrelations in the medians and in
the figures over baselines; only the test leaves autocorrelations out. The deviation in either test is the
modulus of the complex residual less a real median.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Jones
from ..plans.schemas import CHUNK

#: From a median absolute deviation to a standard deviation.
SCALE = 1.4826


def whitened(vis: DataFrame, n_corr: int, of: str = "residual", weights: str | None = "weight") -> DataFrame:
    """``wres``: residuals times the root of the weights, or as they are without weights."""
    r = Jones.of(F.col(of), n_corr)
    made = r.scale([F.sqrt(F.col(weights)[k]) for k in range(n_corr)]) if weights else r
    return vis.withColumn("wres", made.column())


def long_residuals(vis: DataFrame, keys: Sequence[str], corrs: Sequence[int]) -> DataFrame:
    """One row per correlation of what isn't hard flagged."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("corr"), F.col("wres")[c]["re"].alias("re"), F.col("wres")[c]["im"].alias("im")) for c in corrs])).alias("_p")
    return vis.where("flag <> 1").select(*keys, "ant1", "ant2", parts).select(*keys, "ant1", "ant2", "_p.*")


def _middle(values: Column, first: Column, second: Column) -> Column:
    return (F.get(values, first.cast("int")) + F.get(values, second.cast("int"))) / 2


def _away(values: Column, middle: Column) -> Column:
    return F.transform(values, lambda x: F.abs(x - middle))


def _by_lists(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, <name>_med, <name>_mad) of groups of moderate size: sorted lists, and sorted distances from their middle."""
    lists = rows.groupBy(*by).agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in names])
    ends = lambda c: (F.floor((F.size(c) - 1) / 2), F.floor(F.size(c) / 2))
    out = lists.select("*", *[_middle(F.col(c), *ends(c)).alias(f"{c}_med") for c in names])
    away = [F.sort_array(_away(F.col(c), F.col(f"{c}_med"))).alias(c) for c in names]
    out = out.select(*by, *[f"{c}_med" for c in names], *away)
    return out.select(*by, *[f"{c}_med" for c in names], *[_middle(F.col(c), *ends(c)).alias(f"{c}_mad") for c in names])


#: Ranks on either side of the middle, as a share of all, between which values are brought together, and the sketch's precision.
NEAR, PRECISION = 2e-4, 10_000


def _narrowed(rows: DataFrame, by: Sequence[str], names: Sequence[str], suffix: str) -> DataFrame:
    """(by, <name><suffix>): exact medians of groups of any size. A sketch gives two values close to the middle on either side, and
    of the rows only those between them are sorted, at the rank that the counted rest leaves."""
    ends = [F.percentile_approx(c, [0.5 - NEAR, 0.5 + NEAR], PRECISION).alias(f"_{c}") for c in names]
    at = rows.groupBy(*by).agg(*ends)
    both = rows.join(at, list(by))
    made = []
    for c in names:
        low, high = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        inside = F.sort_array(F.collect_list(F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c))))
        made += [F.count(c).alias(f"_n_{c}"), F.count_if(F.col(c) < low).alias(f"_below_{c}"), inside.alias(f"_in_{c}")]
    out = both.groupBy(*by).agg(*made)
    n, below = (lambda c: F.col(f"_n_{c}")), (lambda c: F.col(f"_below_{c}"))
    return out.select(*by, *[_middle(F.col(f"_in_{c}"), F.floor((n(c) - 1) / 2) - below(c), F.floor(n(c) / 2) - below(c)).alias(f"{c}{suffix}") for c in names])


def _by_narrowing(rows: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    med = _narrowed(rows, by, names, "_med")
    away = rows.join(med, list(by)).select(*by, *[F.abs(F.col(c) - F.col(f"{c}_med")).alias(c) for c in names])
    return med.join(_narrowed(away, by, names, "_mad"), list(by))


def mad_and_median(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, re_med, im_med, re_mad, im_mad) of baselines and other groups whose rows fit a task."""
    return _by_lists(rows, by, ("re", "im"))


def chunk_mad_and_median(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same of groups of any size."""
    return _by_narrowing(rows, by, ("re", "im"))


def baseline_spread(baselines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the positive scaled MADs of a chunk's baselines."""
    return _spread(baselines, [*keys, "corr"], ("re", "im"))


def mad_flags(
    vis: DataFrame,
    n_corr: int,
    threshold_bl: float = 10.0,
    threshold_global: float = 12.0,
    max_deviation: float = 0.0,
    off_diagonals: bool = False,
    keys: Sequence[str] = CHUNK,
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """``vis`` (with wres) with flag 1 added where a test fails; thresholds of 0 switch a test off.

    The residuals stay persisted, on disk where memory is short, for the passes over them; they are added to ``held``, whose
    owner unpersists them when the result has been used.
    """
    keys = list(keys)
    corrs = (0, 3) if n_corr == 4 and not off_diagonals else tuple(range(n_corr))
    names = [f"{p}{c}" for c in corrs for p in ("re", "im")]
    values = [F.col("wres")[c][p].alias(f"{p}{c}") for c in corrs for p in ("re", "im")]
    rows = vis.where("flag <> 1").select(*keys, "ant1", "ant2", *values).persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held.append(rows)
    renamed = lambda df, tag: df.select(*[F.col(x).alias(f"{tag}{x}") if x not in (*keys, "ant1", "ant2") else F.col(x) for x in df.columns])
    per_baseline = _by_lists(rows, [*keys, "ant1", "ant2"], names)
    found = renamed(per_baseline, "_b").join(renamed(_by_narrowing(rows, keys, names), "_g"), keys)
    if max_deviation:
        found = found.join(renamed(_spread(per_baseline, keys, names), "_s"), keys)
    # A baseline without figures has no row that isn't flagged.
    out = vis.join(found, [*keys, "ant1", "ant2"], "left")
    bad = F.lit(False)
    for c in corrs:
        bad = bad | _fails(c, threshold_bl, threshold_global, max_deviation)
    flag = F.when(F.coalesce(bad, F.lit(False)), F.lit(1).cast("byte")).otherwise(F.col("flag"))
    return out.withColumn("flag", flag).select(*vis.columns)


def _spread(baselines: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    made = []
    for name in names:
        x = F.when(F.col(f"{name}_mad") > 0, F.col(f"{name}_mad") * SCALE)
        made += [F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std")]
    return baselines.groupBy(*keys).agg(*made)


def _fails(c: int, threshold_bl: float, threshold_global: float, max_deviation: float) -> Column:
    get = lambda tag, name: F.coalesce(F.col(f"{tag}{name[:2]}{c}{name[2:]}"), F.lit(0.0))
    value = F.col("wres")[c]

    def away(tag: str) -> Column:
        parts = []
        for part in ("re", "im"):
            real = value["re"] - get(tag, f"{part}_med")
            size = real * real + value["im"] * value["im"]
            parts.append(size / (get(tag, f"{part}_mad") * SCALE) ** 2)
        return parts[0] + parts[1]

    empty = lambda tag: (get(tag, "re_mad") == 0) | (get(tag, "im_mad") == 0)
    tests = F.lit(False)
    if threshold_bl:
        tests = tests | (away("_b") > threshold_bl**2)
    if threshold_global:
        tests = tests | (away("_g") > threshold_global**2)
    odd = F.lit(False)
    if max_deviation:
        dev = [((get("_b", f"{p}_mad") * SCALE - F.col(f"_s{p}{c}_mean")) / F.nullif(F.col(f"_s{p}{c}_std"), F.lit(0.0))) ** 2 for p in ("re", "im")]
        odd = F.coalesce(dev[0] + dev[1] > max_deviation**2, F.lit(False))
    cross = F.col("ant1") != F.col("ant2")
    return F.when(empty("_g"), True).otherwise(cross & F.when(empty("_b") | odd, True).otherwise(tests))
