"""Chunks and solution intervals.

Whole numbers count slots or channels, 0 means all, floats are lengths. Chunks are the units of work; intervals never
cross them. Binning works on the distinct times (channels) of a partition, not on its rows, and
the bins are joined back by equality. Bins by length are greedy, each depends on where the last one ended, so
they fold over the ordered times of a chunk; the others are window functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schemas import KEYS


def distinct_times(vis: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, time, interval, n_rows) of every distinct time."""
    own = [k for k in dict.fromkeys(("scan",)) if k not in keys and k in vis.columns]
    return vis.groupBy(*keys, "time").agg(
        F.min("interval").alias("interval"), F.count("*").alias("n_rows"), *[F.min(k).alias(k) for k in own]
    )


def time_chunks(times: DataFrame, chunk: int | float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``times`` with t_chunk. A length gives a grid of elapsed time; its empty cells have no number."""
    order = Window.partitionBy(*keys).orderBy("time")
    if isinstance(chunk, float):
        passed = F.sum("interval").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.first("interval").over(order)
        cell = times.withColumn("_cell", F.floor(passed / chunk))
        numbered = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_cell")) - 1
        return cell.withColumn("t_chunk", numbered.cast("int")).drop("_cell")
    if not chunk:
        return times.withColumn("t_chunk", F.lit(0))
    return times.withColumn("t_chunk", F.floor((F.dense_rank().over(order) - 1) / chunk).cast("int"))


def fold_bins(lengths: Column, limit: float, strict: bool) -> Column:
    """Bin numbers of an array of lengths: a bin ends once it is as long as the limit (``strict``: longer)."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("bins"))

    def step(state: Column, length: Column) -> Column:
        total = state["sum"] + length
        full = total > limit if strict else total >= limit
        return F.struct(
            F.when(full, 0.0).otherwise(total).alias("sum"),
            (state["bin"] + full.cast("int")).alias("bin"),
            F.concat(state["bins"], F.array(state["bin"])).alias("bins"),
        )

    return F.aggregate(F.transform(lengths, lambda x: x.cast("double")), start, step, lambda s: s["bins"])


def _folded(rows: DataFrame, keys: list[str], order: str, length: str, limit: float, strict: bool, name: str) -> DataFrame:
    """``rows`` with a greedy bin number by ``order`` within ``keys``."""
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("_all"))
    zipped = F.arrays_zip(F.col("_all").alias("row"), fold_bins(F.col(f"_all.{length}"), limit, strict).alias("bin"))
    out = packed.select(*keys, F.explode(zipped).alias("_z"))
    return out.select(*keys, *[F.col("_z.row")[c].alias(c) for c in rest], F.col("_z.bin").alias(name))


def channels(spectral_windows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(ddid, chan, freq, width) of every data description."""
    own = descriptions.join(spectral_windows, "spw")
    zipped = F.posexplode(F.arrays_zip("chan_freq", "chan_width")).alias("chan", "_z")
    return own.select("ddid", zipped).select("ddid", "chan", F.col("_z.chan_freq").alias("freq"), F.col("_z.chan_width").alias("width"))


def freq_chunks(chans: DataFrame, chunk: int | float) -> DataFrame:
    """``chans`` with f_chunk; a bandwidth is passed before a chunk ends."""
    if isinstance(chunk, float):
        return _folded(chans, ["ddid"], "chan", "width", chunk, True, "f_chunk")
    return chans.withColumn("f_chunk", F.floor(F.col("chan") / chunk).cast("int") if chunk else F.lit(0))


def time_bins(times: DataFrame, interval: int | float, name: str = "t_bin", respect_scans: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``times`` (with t_chunk) with the solution interval of each time.

    With ``respect_scans``, where scan is no partition key, an interval also ends with its scan.
    """
    group = [*keys, "t_chunk"]
    split = [*group, "scan"] if respect_scans and "scan" not in keys and "scan" in times.columns else group
    if isinstance(interval, float):
        local = _folded(times, split, "time", "interval", interval, False, "_local")
    elif interval:
        order = Window.partitionBy(*split).orderBy("time")
        local = times.withColumn("_local", F.floor((F.dense_rank().over(order) - 1) / interval).cast("int"))
    else:
        local = times.withColumn("_local", F.lit(0))
    parts = [c for c in split if c not in group] + ["_local"]
    return local.withColumn(name, (F.dense_rank().over(Window.partitionBy(*group).orderBy(*parts)) - 1).cast("int")).drop("_local")


def freq_bins(chans: DataFrame, interval: int | float, name: str = "f_bin") -> DataFrame:
    """``chans`` (with f_chunk) with the solution interval of each channel, counted within the chunk."""
    if isinstance(interval, float):
        return _folded(chans, ["ddid", "f_chunk"], "chan", "width", interval, False, name)
    if not interval:
        return chans.withColumn(name, F.lit(0))
    order = Window.partitionBy("ddid", "f_chunk").orderBy("chan")
    return chans.withColumn(name, F.floor((F.row_number().over(order) - 1) / interval).cast("int"))


def direction_bin(direction: Column, dependent: bool) -> Column:
    return direction if dependent else F.lit(0)


def attach(vis: DataFrame, bins: DataFrame, on: list[str]) -> DataFrame:
    """Bins of times or channels on the rows they belong to."""
    extra = [c for c in bins.columns if c not in vis.columns]
    return vis.join(bins.select(*on, *extra), on)


def coordinates(bins: DataFrame, keys: list[str], name: str, of: str) -> DataFrame:
    """The mean of the distinct times (frequencies) of each bin, and its first and last."""
    return bins.select(*keys, name, of).distinct().groupBy(*keys, name).agg(
        F.avg(of).alias(f"gain_{of}"), F.min(of).alias("first"), F.max(of).alias("last"), F.count("*").alias("n")
    )


def grouped_sums(values: DataFrame, index: str, value: str) -> DataFrame:
    """Sums, counts and means of a column by an index column."""
    return values.groupBy(index).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def snapped_times(times: Column, within: float = 0.05) -> Column:
    """Times in order, each that is nearer than ``within`` to the time before it replaced by that time."""
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))))
    return F.zip_with(times, before, lambda t, b: F.when(F.abs(t - b) < within, b).otherwise(t))
