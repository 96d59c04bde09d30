"""Statistics of visibilities as they arrive: tumbling windows of time with a watermark.

Batch solution intervals restart with each chunk; on a stream the natural counterpart are windows of event
time, whose sums are kept as state until the watermark passes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Jones


def windowed_chi_squared(vis: DataFrame, n_corr: int, window: str, late: str, of: str = "residual", time: str = "ts") -> DataFrame:
    """Mean weighted |residual|^2 of unflagged values per window and data description; rows later than ``late`` are left out."""
    good = F.col("flag") == 0
    parts = Jones.of(F.col(of), n_corr).parts
    one = sum((p.abs2() * F.col("weight")[k] for k, p in enumerate(parts[1:], 1)), parts[0].abs2() * F.col("weight")[0])
    n = F.count(F.when(good, 1)) * n_corr
    return (
        vis.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), "ddid")
        .agg((F.sum(F.when(good, one)) / n).alias("chisq"), n.alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ddid", "chisq", "n")
    )


def windowed_flags(vis: DataFrame, window: str, late: str, time: str = "ts") -> DataFrame:
    """The share of flagged values per window."""
    return (
        vis.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"))
        .agg(F.avg((F.col("flag") == 1).cast("int")).alias("flagged"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "flagged", "n")
    )
