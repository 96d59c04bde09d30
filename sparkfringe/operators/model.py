"""Models from recipes, and by direct Fourier transform of sky models."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones
from ..plans.config import Recipe

LIGHT = 299792458.0


def column_of(name: str) -> str:
    """A column name for a sky model's path."""
    return name if name.isidentifier() else "sky_" + "".join(c if c.isalnum() else "_" for c in name)


def add_model(vis: DataFrame, recipe: Recipe, n_corr: int, clusters: dict[str, list[str]] | None = None) -> DataFrame:
    """``model``: an array over directions. Columns are added and subtracted per direction; a sky model with
    tags is an array column whose further elements are directions of their own."""
    if recipe.is_identity:
        return vis.withColumn("model", F.array(Jones.identity(n_corr).column()))
    out: list[Jones] = []
    for terms in recipe.directions:
        total, more = Jones.zero(n_corr), []
        for k, (sign, name, tags) in enumerate(terms):
            names = (clusters or {}).get(name) if tags else None
            column = F.col(column_of(name))
            sky = name.endswith((".html", ".txt", ".lsm"))
            own = Jones.of(column[0] if sky else column, n_corr)
            if names:
                more = [Jones.of(column[d], n_corr).scale(F.lit(float(sign))) for d in range(1, len(names))]
            total = own if not k and sign > 0 else total + own if sign > 0 else total - own
        out += [total, *more]
    return vis.withColumn("model", F.array(*[j.column() for j in out]))


def n_directions(recipe: Recipe, clusters: dict[str, list[str]] | None = None) -> int:
    return sum(max([1, *(len((clusters or {}).get(n, [1])) for _, n, tags in d if tags)]) for d in recipe.directions)


def lmn(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column, Column]:
    """Direction cosines of a source, with n - 1."""
    l = F.cos(dec) * F.sin(ra - ra0)  # noqa: E741
    m = F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(ra - ra0)
    return l, m, F.sqrt(F.greatest(1 - l * l - m * m, F.lit(0.0))) - 1


def source_id() -> Column:
    return F.xxhash64("model", "cluster", "type", "ra", "dec", "i", "q", "u", "v")


#: Sources (per field) up to which tasks hold the sky model; products of rows and sources computed at once.
HELD_SOURCES, AT_ONCE = 100_000, 1 << 20


def cluster_order(names: Iterable[str]) -> list[str]:
    """Clusters as directions: what is in none comes first, the others by name."""
    return sorted(set(names), key=lambda c: (c != "DIE", c))


def with_sky(vis: DataFrame, sources: DataFrame, fields: DataFrame, n_corr: int, circular: bool = False, name: str = "sky", invert_uvw: bool = False) -> DataFrame:
    """``vis`` with the sum over sources of brightness times exp(2 pi i (u l + v m + w (n - 1)) / lambda), as an array over clusters.

    Nothing is shuffled: a sky model of up to ``HELD_SOURCES`` sources goes to the tasks, which take some rows by all sources at a
    time; a larger one is for :func:`predict`. Rows of fields without a centre get nothing from any source.
    """
    held = sources.limit(HELD_SOURCES + 1).toPandas()
    if len(held) > HELD_SOURCES:
        raise ValueError(f"a sky model of more than {HELD_SOURCES} sources must go through predict")
    centres = {r.field: (r.phase_ra, r.phase_dec) for r in fields.select("field", "phase_ra", "phase_dec").toLocalIterator()}
    names = cluster_order(held["cluster"])
    own = [np.flatnonzero(held["cluster"].to_numpy() == c) for c in names]
    h = {c: held[c].to_numpy(float) for c in ("ra", "dec", "i", "q", "u", "v", "spi", "ref_freq", "emaj", "emin", "pa")}
    extended = held["type"].to_numpy() == "gauss"
    spi = np.nan_to_num(h["spi"])
    if circular:
        four = [h["i"] + h["v"], h["q"] + 1j * h["u"], h["q"] - 1j * h["u"], h["i"] - h["v"]]
    else:
        four = [h["i"] + h["q"], h["u"] + 1j * h["v"], h["u"] - 1j * h["v"], h["i"] - h["q"]]
    brightness = np.stack([four[k] for k in {1: (0,), 2: (0, 3), 4: (0, 1, 2, 3)}[n_corr]], 1).astype(complex)
    sign, fwhm = (-1.0 if invert_uvw else 1.0), pi / (4 * 0.6931471805599453) ** 0.5

    def waves(ra0: float, dec0: float, u: np.ndarray, v: np.ndarray, w: np.ndarray, freq: np.ndarray) -> np.ndarray:
        l = np.cos(h["dec"]) * np.sin(h["ra"] - ra0)  # noqa: E741
        m = np.sin(h["dec"]) * np.cos(dec0) - np.cos(h["dec"]) * np.sin(dec0) * np.cos(h["ra"] - ra0)
        n = np.sqrt(np.maximum(1 - l * l - m * m, 0)) - 1
        per = freq[:, None] / LIGHT
        out = np.exp(2j * pi * per * (np.outer(u, l) + np.outer(v, m) + np.outer(w, n)))
        if spi.any():
            out *= np.where(spi == 0, 1.0, (freq[:, None] / h["ref_freq"]) ** spi)
        if extended.any():
            sin, cos, e = np.sin(h["pa"][extended]), np.cos(h["pa"][extended]), extended
            along = (np.outer(u, sin) + np.outer(v, cos)) * per * h["emaj"][e] * fwhm
            across = (np.outer(u, cos) - np.outer(v, sin)) * per * h["emin"][e] * fwhm
            out[:, e] *= np.exp(-(along * along + across * across))
        return out

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.column("field").to_numpy(zero_copy_only=False)
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "w", "freq")}
            total = np.zeros((batch.num_rows, len(names), n_corr), complex)
            for f in np.unique(field):
                rows = np.flatnonzero(field == f)
                step = max(1, AT_ONCE // max(1, len(held)))
                for at in range(0, len(rows) if f in centres else 0, step):
                    part = rows[at : at + step]
                    k = waves(*centres[f], *[sign * x[c][part] for c in "uvw"], x["freq"][part])
                    for d, of in enumerate(own):
                        total[part, d] = k[:, of] @ brightness[of]
            flat = total.reshape(-1)
            cells = pa.StructArray.from_arrays([pa.array(flat.real.copy()), pa.array(flat.imag.copy())], names=["re", "im"])
            n = batch.num_rows * len(names)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_corr, pa.int32()), cells)
            outer = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(names), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([*batch.columns, outer], [*batch.schema.names, name])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in vis.schema.fields]
    return vis.mapInArrow(look, ", ".join([*kinds, f"`{name}` array<array<struct<re:double,im:double>>>"]))


def predict(
    vis: DataFrame, sources: DataFrame, fields: DataFrame, n_corr: int, circular: bool = False, name: str = "sky",
    on: tuple[str, ...] = ("row_id", "chan"), invert_uvw: bool = False, beams: DataFrame | None = None,
) -> DataFrame:
    """The sum over sources of brightness times exp(2 pi i (u l + v m + w (n - 1)) / lambda), for each cluster.

    Without beams and up to ``HELD_SOURCES`` sources this is :func:`with_sky`. Otherwise every source meets every visibility of its
    field in a join, and the sum is combined before it is shuffled. ``beams`` (see
    :func:`beam_jones`) stand on either side of a source's brightness. Returns (scan, field, ddid, on, name array
    over clusters in the order of :func:`cluster_order`).
    """
    if beams is None and {"row_id", "chan"} <= set(on) and _few(sources, HELD_SOURCES):
        wanted = list(dict.fromkeys(["scan", "field", "ddid", *on, "freq", "u", "v", "w"]))
        return with_sky(vis.select(*wanted), sources, fields, n_corr, circular, name, invert_uvw).select("scan", "field", "ddid", *on, name)
    keys = ["scan", "field", "ddid", *on]
    centre = fields.select("field", F.col("phase_ra").alias("_ra0"), F.col("phase_dec").alias("_dec0"))
    each = sources.crossJoin(centre)  # a sky model for each of the few fields
    l, m, n = lmn(F.col("ra"), F.col("dec"), F.col("_ra0"), F.col("_dec0"))  # noqa: E741
    each = each.select("field", source_id().alias("source"), "cluster", "type", "i", "q", F.col("u").alias("su"), F.col("v").alias("sv"), "spi", "ref_freq", "emaj", "emin", "pa", l.alias("l"), m.alias("m"), n.alias("n"))
    more = ["time", "ant1", "ant2"] if beams is not None else []
    more = [c for c in dict.fromkeys([*more, "chan"]) if c not in keys] if beams is not None else []
    sign = -1.0 if invert_uvw else 1.0
    rows = vis.select(*keys, *more, *[(F.col(c) * sign).alias(c) for c in "uvw"], "freq").join(F.broadcast(each) if _few(sources) else each, "field")
    wave = F.col("freq") / LIGHT
    angle = 2 * pi * wave * (F.col("u") * F.col("l") + F.col("v") * F.col("m") + F.col("w") * F.col("n"))
    scale = F.when(F.col("spi").isNull() | (F.col("spi") == 0), 1.0).otherwise(F.pow(F.col("freq") / F.col("ref_freq"), F.col("spi")))
    shape = F.when(F.col("type") == "gauss", _gaussian(wave)).otherwise(1.0)
    k = Cx(F.cos(angle) * scale * shape, F.sin(angle) * scale * shape)
    brightness = _brightness(n_corr, circular)
    if beams is not None:
        if n_corr != 4:
            raise ValueError("beams need four correlations")
        at = ["scan", "field", "ddid", "time", "chan", "source"]
        for ant, side in (("ant1", "_ep"), ("ant2", "_eq")):
            rows = rows.join(beams.select(*at, F.col("ant").alias(ant), F.col("e").alias(side)), [*at, ant])
        rows = rows.withColumn("_b", Jones(tuple(brightness)).column())
        rows = rows.withColumn("_b", (Jones.of(F.col("_ep"), 4) @ Jones.of(F.col("_b"), 4)).column())
        rows = rows.withColumn("_b", (Jones.of(F.col("_b"), 4) @ Jones.of(F.col("_eq"), 4).herm()).column())
        brightness = list(Jones.of(F.col("_b"), 4).parts)
    cells = [b * k for b in brightness]
    sums = [s for c, x in enumerate(cells) for s in (F.sum(x.re).alias(f"re{c}"), F.sum(x.im).alias(f"im{c}"))]
    total = rows.groupBy(*keys, "cluster").agg(*sums)
    jones = Jones(tuple(Cx(F.col(f"re{c}"), F.col(f"im{c}")) for c in range(n_corr))).column()
    return total.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col("cluster") != "DIE").alias("later"), "cluster", jones.alias("j")))).alias("_c")).select(*keys, F.col("_c.j").alias(name))


def _few(sources: DataFrame, limit: int = 100_000) -> bool:
    return sources.limit(limit + 1).count() <= limit


def _gaussian(wave: Column) -> Column:
    """The transform of an elliptic Gaussian of major and minor FWHM and position angle."""
    fwhm = pi / (4 * 0.6931471805599453) ** 0.5
    sin, cos = F.sin("pa"), F.cos("pa")
    along = (F.col("u") * sin + F.col("v") * cos) * wave * F.col("emaj") * fwhm
    across = (F.col("u") * cos - F.col("v") * sin) * wave * F.col("emin") * fwhm
    return F.exp(-(along * along + across * across))


def _brightness(n_corr: int, circular: bool) -> list[Cx]:
    i, q, u, v = F.col("i"), F.col("q"), F.col("su"), F.col("sv")
    zero = F.lit(0.0)
    if circular:
        four = [Cx(i + v, zero), Cx(q, u), Cx(q, -u), Cx(i - v, zero)]
    else:
        four = [Cx(i + q, zero), Cx(u, v), Cx(u, -v), Cx(i - q, zero)]
    return {1: four[:1], 2: [four[0], four[3]], 4: four}[n_corr]


def beam_jones(sources: DataFrame, fields: DataFrame, angles: DataFrame, chans: DataFrame, grid: DataFrame, l_axis: list[float], m_axis: list[float]) -> DataFrame:
    """(scan, field, ddid, time, ant, chan, source, e): the beam towards each source, turned by the parallactic angle.

    ``grid`` (corr, m, l, chan, re, im) is linear between its points along l, m and channel; it is a table of
    set size, which the tasks get whole. Beyond the grid the beam is that of its edge.
    """
    import numpy as np
    import pandas as pd

    from ..plans.schemas import JONES

    table = grid.toPandas()
    size = [int(table[c].max()) + 1 for c in ("corr", "chan", "m", "l")]
    cube = np.zeros(size, complex)
    cube[tuple(table[c].to_numpy(int) for c in ("corr", "chan", "m", "l"))] = table["re"] + 1j * table["im"]
    centre = fields.select("field", F.col("phase_ra").alias("_ra0"), F.col("phase_dec").alias("_dec0"))
    l, m, _ = lmn(F.col("ra"), F.col("dec"), F.col("_ra0"), F.col("_dec0"))  # noqa: E741
    places = sources.crossJoin(centre).select("field", source_id().alias("source"), l.alias("l"), m.alias("m"))
    turn = F.col("angle0")
    asked = angles.join(places, "field").select(
        "scan", "field", "ddid", "time", "ant", "source",
        (F.col("l") * F.cos(turn) - F.col("m") * F.sin(turn)).alias("x"), (F.col("l") * F.sin(turn) + F.col("m") * F.cos(turn)).alias("y"),
    )
    bands = chans.groupBy("ddid").agg(F.count("*").alias("n_chan"))
    asked = asked.join(chans.select("ddid", "chan"), "ddid").join(bands, "ddid")

    def weights_of(value, axis):
        if len(axis) == 1:
            return np.zeros(len(value), int), np.zeros(len(value), int), np.zeros(len(value))
        at = np.clip(np.interp(value, axis, np.arange(len(axis))), 0, len(axis) - 1)
        low = np.minimum(at.astype(int), len(axis) - 2)
        return low, low + 1, at - low

    def look(batches):
        for b in batches:
            nu = b["chan"].to_numpy() * (size[1] - 1) / np.maximum(b["n_chan"].to_numpy() - 1, 1)
            sides = [weights_of(nu, np.arange(size[1])), weights_of(b["y"].to_numpy(), m_axis), weights_of(b["x"].to_numpy(), l_axis)]
            e = 0
            for corner in np.ndindex(2, 2, 2):
                w = np.prod([s[2] if c else 1 - s[2] for s, c in zip(sides, corner, strict=True)], axis=0)
                e = e + w * cube[:, sides[0][corner[0]], sides[1][corner[1]], sides[2][corner[2]]]
            cells = [[{"re": float(z.real), "im": float(z.imag)} for z in col] for col in e.T]
            yield pd.DataFrame({c: b[c] for c in ("scan", "field", "ddid", "time", "ant", "chan", "source")} | {"e": cells})

    return asked.mapInPandas(look, f"scan int, field int, ddid int, time double, ant int, chan int, source long, e {JONES}")
