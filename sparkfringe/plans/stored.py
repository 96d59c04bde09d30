"""Queries that write and read again, interpolate stored gains, average and restore, and stream, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones
from ..operators import apply, bda, interpolation, preprocess
from ..sources import tables
from ..sources.temporary import folder
from ..streaming import windows
from .schemas import CHUNK, KEYS

SECONDS, MEGAHERTZ = 10.0, 2e6


def _small_vis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import visibilities

    # Rows of orders repeat; the line's place tells them apart.
    return visibilities(spark, sf_dir).withColumn("row_id", F.monotonically_increasing_id())


def stored_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product and the flags, written beside the columns of the table they came from, and read again."""
    from .queries import _r

    to = folder(spark)
    vis = _small_vis(spark, sf_dir)
    vis.write.parquet(f"{to}/first")
    vis = spark.read.parquet(f"{to}/first")
    made = apply.summed_model(preprocess.preprocess(vis, 2, "weight"), 2, 2)
    made = preprocess.final_flags(made, 2)
    tables.write_products(made, f"{to}/second", {"model_data": "MODEL_OUT"}, vis)
    back = spark.read.parquet(f"{to}/second/MAIN")
    bad = F.exists("flag", lambda x: x)
    return back.groupBy("scan", "chan").agg(
        _r(F.sum(F.col("MODEL_OUT")[0]["re"]), 4).alias("m0re"), _r(F.sum(F.col("MODEL_OUT")[1]["im"]), 4).alias("m1im"),
        _r(F.sum(F.col("data")[0]["re"]), 4).alias("d0re"), F.count_if(bad).alias("flagged"), F.count("*").alias("n"),
    )


def stored_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains written by term and read again, of one term."""
    from .queries import _all_gains, _r

    to = folder(spark)
    gains = _all_gains(spark, sf_dir)
    other = gains.withColumn("term", F.lit("H")).withColumn("g", Jones.identity(2).column())
    tables.write_gains(gains.unionByName(other), to)
    back = tables.read_gains(spark, to, "G")
    return back.groupBy("scan", "ant").agg(_r(F.sum(F.col("g")[0]["im"]), 4).alias("im0"), _r(F.sum(F.col("g")[1]["im"]), 4).alias("im1"), F.sum(F.col("gain_flag").cast("int")).alias("flagged"), F.count("*").alias("n"))


def backup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column copied, overwritten and taken back."""
    from .queries import _r

    to = folder(spark)
    _small_vis(spark, sf_dir).write.parquet(f"{to}/vis")
    vis = spark.read.parquet(f"{to}/vis")
    where = tables.backup(vis, "data", to)
    zero = vis.withColumn("data", F.array(*[Cx.lit(0).column()] * 2))
    back = tables.restore(zero, spark.read.parquet(where), "data")
    return back.groupBy("scan", "chan").agg(*[_r(F.sum(F.col("data")[k]["re"]), 4).alias(f"d{k}re") for k in range(2)], F.count("*").alias("n"))


def _grid(spark: SparkSession) -> DataFrame:
    """Values on a grid of times and frequencies, with holes within the times."""
    rows = spark.range(7).select(F.col("id").cast("int").alias("ant")).join(spark.range(10).select(F.col("id").alias("k")), how="cross").join(spark.range(5).select(F.col("id").alias("j")), how="cross")
    t, f = F.col("k") * SECONDS, F.col("j") * MEGAHERTZ / 1e6
    line = 0.5 * F.col("ant") + 0.02 * t + 0.3 * f
    curve = 1e-5 * t * t * t - 0.01 * f * f * t + F.col("ant")
    hole = (F.col("ant") >= 0) & (F.col("k") > 0) & (F.col("k") < 9) & ((F.col("k") + F.col("j") + F.col("ant")) % 5 == 0)
    return rows.select(F.lit("G").alias("term"), "ant", F.lit(0).alias("dir"), t.alias("gain_time"), (1e9 + f * 1e6).alias("gain_freq"), F.when(~hole, F.array(line)).alias("line"), F.array(curve).alias("curve"))


def _targets(spark: SparkSession) -> DataFrame:
    rows = spark.range(-3, 25).select((F.col("id") * 4.0).alias("gain_time")).join(spark.range(9).select((1e9 + F.col("id") * 1e6).alias("gain_freq")), how="cross")
    return rows.select(F.lit("G").alias("term"), "gain_time", "gain_freq")


def interpolated_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes filled along time, then values linear in both axes; the nearest where either is beyond the grid."""
    from .queries import _r

    found = interpolation.interpolate(_grid(spark).withColumn("v", F.col("line")), _targets(spark))
    return found.select("ant", "gain_time", ((F.col("gain_freq") - 1e9) / 1e6).cast("int").alias("mhz"), _r(F.col("v")[0], 6).alias("v"))


def interpolated_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splines, which give cubics again; the edge's value beyond it."""
    from .queries import _r

    found = interpolation.interpolate(_grid(spark).withColumn("v", F.col("curve")), _targets(spark), "2dspline")
    return found.select("ant", "gain_time", ((F.col("gain_freq") - 1e9) / 1e6).cast("int").alias("mhz"), _r(F.col("v")[0], 5).alias("v"))


def interpolated_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex gains taken apart, interpolated between two times and put together: the mean of amplitudes, cosines and sines."""
    from .queries import _r

    a = F.col("ant")
    rows = spark.range(7).select(F.col("id").cast("int").alias("ant"), F.explode(F.array(F.lit(0.0), F.lit(10.0))).alias("gain_time"))
    size, angle = 1 + 0.1 * a + 0.01 * F.col("gain_time"), 0.2 * a + 0.05 * F.col("gain_time")
    rows = rows.select(F.lit("G").alias("term"), "ant", F.lit(0).alias("dir"), "gain_time", F.lit(1e9).alias("gain_freq"), F.array(Cx(size * F.cos(angle), size * F.sin(angle)).column()).alias("g"), F.lit(0).alias("gain_flag"))
    targets = spark.createDataFrame([("G", 5.0, 1e9), ("G", 2.5, 1e9)], "term string, gain_time double, gain_freq double")
    found = interpolation.from_real(interpolation.interpolate(interpolation.to_real(rows, 1).drop("g"), targets), 1)
    return found.select("ant", "gain_time", _r(F.col("g")[0]["re"]).alias("re"), _r(F.col("g")[0]["im"]).alias("im"))


def bda_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged rows on finer channels and times, joined back on the rows they came from."""
    from .queries import _r

    vis = _small_vis(spark, sf_dir)
    fine = bda.upsample_times(bda.upsample_channels(vis, F.lit(2)), 2.0)
    back = bda.downsample(fine, 2, F.lit(2), (*KEYS, "row_map", "ant1", "ant2"))
    one = [_r(F.sum(F.col("data")[k]["re"]), 4).alias(f"d{k}re") for k in range(2)]
    return back.groupBy("scan", "chan").agg(*one, F.count_if(F.col("flag")[0]).alias("f0"), F.count("*").alias("n"))


def soft_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelations are soft flagged, and values that aren't finite become 0 and are hard flagged."""
    from .queries import visibilities

    vis = visibilities(spark, sf_dir).withColumn("ant2", F.col("ant2") - 7)
    d = F.col("data")
    broken = F.struct(F.when(F.col("w") == 3, float("nan")).when(F.col("w") == 4, float("inf")).otherwise(d[0]["re"]).alias("re"), d[0]["im"].alias("im"))
    vis = preprocess.preprocess(vis.withColumn("data", F.array(broken, d[1])), 2, "weight")
    zero = (F.col("data")[0]["re"] == 0) & (F.col("data")[0]["im"] == 0)
    return vis.groupBy("scan").agg(*[F.count_if(F.col("flag") == k).alias(n) for k, n in ((1, "hard"), (-1, "soft"), (0, "good"))], F.count_if(zero).alias("zeros"))


def streamed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of flagged values in windows of ten minutes, from a stream of all rows there are, as its sink holds it."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0).cast("int").alias("flag"))
    name = f"flags_{uuid.uuid4().hex}"
    to = folder(spark)
    run = (
        windows.windowed_flags(rows, "10 minutes", "1 hour").writeStream.format("memory").queryName(name)
        .option("checkpointLocation", f"{to}/state").outputMode("complete").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    from .queries import _r

    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), _r(F.col("flagged")).alias("flagged"), "n")


_BASE = "CAST(l_orderkey // 5000 AS INTEGER) AS scan, CAST(l_linenumber - 1 AS INTEGER) AS chan"


def _sql_gains() -> str:
    from .queries import _VIS

    return f"""{_VIS}, d AS (SELECT DISTINCT scan, field, ddid, t_chunk, t_bin FROM bins), c AS (SELECT DISTINCT f // 4 AS f_chunk, f % 4 // 2 AS f_bin FROM range(7) AS x(f)),
      a AS (SELECT *, unnest(range(14)) AS ant FROM d, c)
      SELECT scan, CAST(ant AS INTEGER) AS ant, round(sum(0.02 * t_bin), 4) AS im0, round(sum(0.01 * ant + 0.001 * f_bin), 4) AS im1, count(*) FILTER ((ant + t_bin) % 11 = 0) AS flagged, count(*) AS n FROM a GROUP BY scan, ant"""


_AT = "(SELECT a.ant, b.k * 4.0 AS t, c.f FROM range(7) AS a(ant), range(-3, 25) AS b(k), range(9) AS c(f)) AS x"
_OUT = "CAST(ant AS INTEGER) AS ant, CAST(t AS DOUBLE) AS gain_time, CAST(f AS INTEGER) AS mhz"


def sql() -> dict[str, str]:
    bad = "l_returnflag = 'R' OR l_quantity = 7 OR l_quantity = 50 OR (l_extendedprice = 0 AND l_discount = 0) OR (l_quantity = 0 AND l_tax = 0)"
    return {
        "stored_products": f"""SELECT {_BASE}, round(sum(l_quantity / 10 + l_discount), 4) AS m0re, round(sum(0.5), 4) AS m1im, round(sum(l_extendedprice / 10000), 4) AS d0re,
          count(*) FILTER ({bad}) AS flagged, count(*) AS n FROM lineitem GROUP BY ALL""",
        "stored_gains": _sql_gains(),
        "backup_round_trip": f"SELECT {_BASE}, round(sum(l_extendedprice / 10000), 4) AS d0re, round(sum(l_quantity / 10), 4) AS d1re, count(*) AS n FROM lineitem GROUP BY ALL",
        "interpolated_linear": f"SELECT {_OUT}, round(0.5 * ant + 0.02 * least(greatest(t, 0), 90) + 0.3 * CASE WHEN t < 0 OR t > 90 THEN f // 2 * 2 ELSE f END, 6) AS v FROM {_AT}",
        "interpolated_spline": f"SELECT {_OUT}, round(1e-5 * pow(least(greatest(t, 0), 90), 3) - 0.01 * f * f * least(greatest(t, 0), 90) + ant, 5) AS v FROM {_AT}",
        "interpolated_gains": """WITH p AS (SELECT ant, t, t / 10 AS x FROM range(7) AS a(ant), (VALUES (5.0), (2.5)) AS b(t)),
          q AS (SELECT *, (1 - x) * (1 + 0.1 * ant) + x * (1.1 + 0.1 * ant) AS size, (1 - x) * cos(0.2 * ant) + x * cos(0.2 * ant + 0.5) AS c, (1 - x) * sin(0.2 * ant) + x * sin(0.2 * ant + 0.5) AS s FROM p)
          SELECT CAST(ant AS INTEGER) AS ant, CAST(t AS DOUBLE) AS gain_time, round(size * cos(atan2(s, c)), 6) AS re, round(size * sin(atan2(s, c)), 6) AS im FROM q""",
        "bda_round_trip": f"SELECT {_BASE}, round(sum(l_extendedprice / 10000), 4) AS d0re, round(sum(l_quantity / 10), 4) AS d1re, count(*) FILTER (l_returnflag = 'R') AS f0, count(*) AS n FROM lineitem GROUP BY ALL",
        "soft_flags": f"""WITH v AS (SELECT l_orderkey // 5000 AS scan, ({bad}) OR l_quantity IN (3, 4) AND true AS hit, l_quantity IN (3, 4) AS broken, l_partkey % 7 = l_suppkey % 7 AS own FROM lineitem)
          SELECT CAST(scan AS INTEGER) AS scan, count(*) FILTER (hit) AS hard, count(*) FILTER (NOT hit AND own) AS soft, count(*) FILTER (NOT hit AND NOT own) AS good, count(*) FILTER (broken) AS zeros FROM v GROUP BY scan""",
        "streamed_flags": "SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M') AS start, round(avg(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS flagged, count(*) AS n FROM events GROUP BY ALL",
    }


QUERIES = {f.__name__: f for f in (stored_products, stored_gains, backup_round_trip, interpolated_linear, interpolated_spline, interpolated_gains, bda_round_trip, soft_flags, streamed_flags)}
