"""Chi-squared and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Jones
from ..plans.schemas import CHUNK, KEYS


def chi_squared(vis: DataFrame, n_corr: int, of: str = "residual", keys: Sequence[str] = CHUNK, name: str = "chisq") -> DataFrame:
    """Per chunk, the mean over unflagged values of weight |residual|^2; NaN without any."""
    good = F.col("flag") == 0
    parts = Jones.of(F.col(of), n_corr).parts
    one = sum((p.abs2() * F.col("weight")[k] for k, p in enumerate(parts[1:], 1)), parts[0].abs2() * F.col("weight")[0])
    n = F.count(F.when(good, 1)) * n_corr
    mean = F.when(n > 0, F.sum(F.when(good, one)) / n).otherwise(F.lit(float("nan")))
    return vis.groupBy(*keys).agg(mean.alias(name), n.alias("n"))


def presolve_chi_squared(vis: DataFrame, n_corr: int, n_dir: int, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Chi-squared of data less model, without gains."""
    from .apply import residual

    return chi_squared(residual(vis, (), n_corr, n_dir), n_corr, keys=keys, name="presolve_chisq")


def chi_squared_summary(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation over chunks, finite values only."""
    made = []
    for c in columns:
        x = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
        made += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
    return stats.agg(*made)


def dimension_summary(vis: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return vis.groupBy(*keys).agg(
        F.countDistinct("row_id").alias("rows"), F.countDistinct("time").alias("times"), F.countDistinct("chan").alias("chans"),
        F.max(F.size("data")).alias("corrs"),
    )


def flag_summary(vis: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Percentage of flagged values of each partition and of all of them (keys null)."""
    rows = vis.select(*keys, F.size(F.filter("flag", lambda x: x)).alias("_f"), F.size("flag").alias("_n"))
    every = [F.grouping_id().alias("_id"), (100 * F.sum("_f") / F.sum("_n")).alias("percent")]
    out = rows.groupingSets([list(keys), []], *keys).agg(*every)
    return out.select(*keys, (F.col("_id") != 0).alias("is_total"), "percent")


def sub_table_summaries(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a summary says of antennas, fields, spectral windows, correlations and feeds."""
    from ..plans.config import CORRELATIONS

    out = {}
    if "ANTENNA" in tables:
        out["ANTENNA"] = tables["ANTENNA"].select("ant", "name", "mount", "x", "y", "z").orderBy("ant")
    if "FIELD" in tables:
        degrees = lambda c: F.degrees(c)
        out["FIELD"] = tables["FIELD"].select("field", "name", "source_id", degrees("phase_ra").alias("ra_deg"), degrees("phase_dec").alias("dec_deg")).orderBy("field")
    if "SPECTRAL_WINDOW" in tables:
        spw = tables["SPECTRAL_WINDOW"]
        out["SPECTRAL_WINDOW"] = spw.select("spw", F.size("chan_freq").alias("n_chan"), F.array_min("chan_freq").alias("low"), F.array_max("chan_freq").alias("high"), "ref_frequency", "total_bandwidth").orderBy("spw")
    if "POLARIZATION" in tables:
        names = F.create_map(*[F.lit(x) for kv in CORRELATIONS.items() for x in kv])
        out["POLARIZATION"] = tables["POLARIZATION"].select("pol", F.transform("corr_type", lambda c: names[c]).alias("correlations")).orderBy("pol")
    if "FEED" in tables:
        out["FEED"] = tables["FEED"].select("ant", "spw", F.array_join("pol_type", ",").alias("pol_type"), F.transform("receptor_angle", lambda x: F.degrees(x)).alias("angles_deg")).orderBy("ant", "spw")
    if "DATA_DESCRIPTION" in tables:
        out["DATA_DESCRIPTION"] = tables["DATA_DESCRIPTION"].select("ddid", "spw", "pol").orderBy("ddid")
    return out


def chi_squared_lines(stats: DataFrame) -> list[str]:
    """One line per chunk for a log, of all chunks; they come to the driver partition by partition."""
    rows = stats.orderBy(*CHUNK).toLocalIterator()
    return [f"scan {r.scan} field {r.field} ddid {r.ddid} chunk ({r.t_chunk}, {r.f_chunk}): {r.presolve_chisq:.4g} -> {r.postsolve_chisq:.4g}" for r in rows]
