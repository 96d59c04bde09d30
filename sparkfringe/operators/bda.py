"""Baseline-dependent averaging: to the finest channels and times and back."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones


def common_interval(intervals: DataFrame, decimals: int = 3) -> float:
    """The greatest common divisor of all intervals, in seconds; there are few different ones."""
    found = intervals.select(F.round(F.col("interval") * 10**decimals).cast("long").alias("x")).distinct().collect()
    return gcd(*[r.x for r in found]) / 10**decimals


def upsample_channels(vis: DataFrame, factor: Column) -> DataFrame:
    """Each row of ``factor`` averaged channels becomes that many; weights share."""
    out = vis.withColumn("_f", factor).select("*", F.explode(F.sequence(F.lit(0), F.col("_f") - 1)).alias("_k"))
    weight = F.transform("weight", lambda w: w / F.col("_f"))
    return out.withColumns({"weight": weight, "chan": F.col("chan") * F.col("_f") + F.col("_k")}).drop("_f", "_k")


def upsample_times(vis: DataFrame, interval: float) -> DataFrame:
    """Each row becomes one per common interval that it spans, with row_map (its row_id), row_slot (its number) and row_weight."""
    n = F.greatest(F.round(F.col("interval") / interval).cast("int"), F.lit(1))
    out = vis.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    time = F.col("time") - F.col("interval") / 2 + (F.col("_k") + 0.5) * interval
    return out.withColumns({"time": time, "row_map": F.col("row_id"), "row_slot": F.col("_k"), "row_weight": 1.0 / F.col("_n"), "interval": F.lit(interval)}).drop("_n", "_k")


def downsample(vis: DataFrame, n_corr: int, factor: Column, keys: Sequence[str], columns: Sequence[str] = ("data",)) -> DataFrame:
    """Back: complex values are averaged, weights added, flags set if any is, bit fields joined by or."""
    rows = vis.withColumn("_chan", F.floor(F.col("chan") / factor).cast("int"))
    made = []
    for name in columns:
        for k in range(n_corr):
            made += [F.avg(F.col(name)[k]["re"]).alias(f"_{name}{k}re"), F.avg(F.col(name)[k]["im"]).alias(f"_{name}{k}im")]
    made += [F.sum(F.col("weight")[k]).alias(f"_w{k}") for k in range(n_corr)]
    made += [F.bool_or(F.col("flag")[k]).alias(f"_f{k}") for k in range(n_corr)]
    if "bitflag" in vis.columns:
        made.append(F.bit_or("bitflag").alias("bitflag"))
    out = rows.groupBy(*keys, F.col("_chan").alias("chan")).agg(*made)
    back = {name: Jones(tuple(Cx(F.col(f"_{name}{k}re"), F.col(f"_{name}{k}im")) for k in range(n_corr))).column() for name in columns}
    back |= {"weight": F.array(*[F.col(f"_w{k}") for k in range(n_corr)]), "flag": F.array(*[F.col(f"_f{k}") for k in range(n_corr)])}
    return out.withColumns(back).drop(*[c for c in out.columns if c.startswith("_")])


#: The most intervals that a row may span, as rows get numbers of their own.
SLOTS = 1 << 20


def regular(vis: DataFrame) -> DataFrame:
    """Averaged data on their common interval, every row with a row_id of its own and row_map, the one it had."""
    out = upsample_times(vis, common_interval(vis))
    return out.withColumn("row_id", F.col("row_map") * SLOTS + F.col("row_slot")).drop("row_slot")


def restored(vis: DataFrame, products: Sequence[str], n_corr: int) -> DataFrame:
    """Products of :func:`regular` rows on the rows they came from: values averaged, flags set where all are."""
    made = []
    for name in products:
        weight = name.endswith("weight")
        for k in range(n_corr):
            cells = [F.sum(F.col(name)[k])] if weight else [F.avg(F.col(name)[k][p]) for p in ("re", "im")]
            made += [c.alias(f"_{name}{k}{j}") for j, c in enumerate(cells)]
    first = [F.min(c).alias(c) for c in ("ant1", "ant2")]
    flags = [F.bool_and(F.col("flag")[k]).alias(f"_flag{k}") for k in range(n_corr)]
    out = vis.groupBy("scan", "field", "ddid", F.col("row_map").alias("row_id"), "chan").agg(*first, *made, *flags, F.bool_and("flag_row").alias("flag_row"))
    back = {"flag": F.array(*[F.col(f"_flag{k}") for k in range(n_corr)])}
    for name in products:
        back[name] = F.array(*[F.col(f"_{name}{k}0") if name.endswith("weight") else Cx(F.col(f"_{name}{k}0"), F.col(f"_{name}{k}1")).column() for k in range(n_corr)])
    return out.withColumns(back).drop(*[c for c in out.columns if c.startswith("_")])
