"""Parallactic angles and feed rotation.

The reference frame is the antenna's: hour angle from Greenwich mean sidereal time (IAU 1982) and the antenna's longitude, with
geodetic latitude from its earth-centred place. No nutation or polar motion is applied, a difference of some
arc seconds.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Jones, rotation

# The WGS 84 ellipsoid, and days of the modified Julian date.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
J2000_MJD, DAY = 51544.5, 86400.0


def sidereal_angle(time: Column) -> Column:
    """Greenwich mean sidereal time in radians of seconds of the modified Julian date."""
    days = time / DAY - J2000_MJD
    t = days / 36525.0
    turns = 0.7790572732640 + 1.00273781191135448 * days
    extra = (0.014506 + 4612.15739966 * t + 1.39667721 * t * t) / 3600 * pi / 180
    return 2 * pi * (turns - F.floor(turns)) + extra


def latitude(x: Column, y: Column, z: Column) -> Column:
    """Geodetic latitude by the closed form of one step, good to below a milli arc second on the ground."""
    e2 = FLATTENING * (2 - FLATTENING)
    minor = RADIUS * (1 - FLATTENING)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * RADIUS, p * minor)
    second = e2 / (1 - e2)
    return F.atan2(z + second * minor * F.pow(F.sin(theta), F.lit(3)), p - e2 * RADIUS * F.pow(F.cos(theta), F.lit(3)))


def parallactic_angles(times: DataFrame, antennas: DataFrame, fields: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """(scan, field, ddid, time, ant, angle0, angle1): one per distinct time of a partition and antenna, with the
    angles of either receptor added; the result is the grid of times and antennas."""
    ants = antennas.select("ant", F.atan2("y", "x").alias("_lon"), latitude(F.col("x"), F.col("y"), F.col("z")).alias("_lat"))
    out = times.join(fields.select("field", "phase_ra", "phase_dec"), "field").crossJoin(ants)
    hour = sidereal_angle(F.col("time")) + F.col("_lon") - F.col("phase_ra")
    angle = F.atan2(F.sin(hour), F.cos("phase_dec") * F.tan("_lat") - F.sin("phase_dec") * F.cos(hour))
    out = out.withColumn("_angle", angle)
    if feeds is not None:
        own = feeds.groupBy("ant").agg(F.first("receptor_angle").alias("_r"))
        out = out.join(own, "ant", "left")
        extra = [F.coalesce(F.get("_r", F.lit(k)), F.lit(0.0)) for k in (0, 1)]
    else:
        extra = [F.lit(0.0)] * 2
    return out.select("scan", "field", "ddid", "time", "ant", *[(F.col("_angle") + e).alias(f"angle{k}") for k, e in enumerate(extra)])


def check_receptors(feeds: DataFrame) -> None:
    odd = feeds.where((F.size("receptor_angle") > 1) & (F.abs(F.col("receptor_angle")[0] - F.col("receptor_angle")[1]) > 1e-9))
    if not odd.isEmpty():
        raise ValueError("receptors that aren't orthogonal are not supported")


def apply_rotation(vis: DataFrame, angles: DataFrame, columns: list[str], circular: bool, derotate: bool = False, n_corr: int = 4) -> DataFrame:
    """R_p x R_q^H of columns, with negative angles to take the rotation off."""
    if n_corr != 4:
        raise ValueError("rotation needs four correlations")
    keys = ["scan", "field", "ddid", "time"]
    out = vis
    for ant, side in (("ant1", "_p"), ("ant2", "_q")):
        own = angles.select(*keys, F.col("ant").alias(ant), F.col("angle0").alias(f"{side}0"), F.col("angle1").alias(f"{side}1"))
        out = out.join(own, [*keys, ant])
    sign = -1 if derotate else 1
    p, q = (rotation(sign * F.col(f"{s}0"), circular, 4, sign * F.col(f"{s}1")) for s in ("_p", "_q"))
    out = out.withColumns({c: (p @ Jones.of(F.col(c), 4) @ q.herm()).column() for c in columns})
    return out.drop("_p0", "_p1", "_q0", "_q1")
