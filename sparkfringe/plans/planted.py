"""Solved gains of every type against planted ones.

Visibilities are made from ``lineitem``: a model that differs from row to row, corrupted by gains that follow from antenna and
interval by a formula, and data that are far off where they are flagged. Each solution must give the formula's values again. A formula
is written once, as SQL that Spark (to make the data) and DuckDB (to tell the answer) both understand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones, polar, rotation
from ..operators import apply, large, preprocess, solver
from . import calibrate
from .config import SolverOptions, TermOptions
from .schemas import CHUNK, JONES

N_ANT, N_CHAN = 7, 7
TIME_CHUNK, TIME_BIN, FREQ_BIN = 40, 5, 2
LIGHT, TWO_PI = 299792458.0, 6.283185307179586
CELL = (*CHUNK, "t_bin", "f_bin", "ant")


@dataclass(frozen=True)
class Plant:
    """A gain type: its unknowns as formulas of ant, t_bin and f_bin, the unit and digits they are told in."""

    unknowns: tuple[str, ...]
    n_corr: int = 2
    step: float = 1e6
    whole_band: bool = False
    units: tuple[float, ...] = ()
    wrapped: tuple[int, ...] = ()
    digits: int = 3
    per: str = "antenna"
    real_model: bool = False
    rounds: int = 80

    def told(self) -> list[str]:
        """The formulas in the units they are told in."""
        units = self.units or (1.0,) * len(self.unknowns)
        return [f"({f}) / {u!r}" if u != 1 else f"({f})" for f, u in zip(self.unknowns, units, strict=True)]


_NS, _TEC = 1e-9, 1e8
_OFFSET, _DELAY = ("0.1 * ant", "-0.2 * ant"), ("2e-9 * ant + 1e-9 * ant * t_bin", "-3e-9 * ant")
_SHORT, _ELECTRONS = ("1e-10 * ant", "-2e-10 * ant"), ("1e8 * ant + 1e7 * ant * t_bin", "-2e8 * ant")


def _paired(*names: tuple[str, str]) -> tuple[str, ...]:
    return tuple(n[k] for k in range(2) for n in names)


_COMPLEX = ("1 + 0.02 * ant + 0.01 * t_bin", "0.05 * ant", "0.03 * ant", "0.02", "-0.02", "0.01 * ant", "0.9 + 0.01 * ant", "0.1 + 0.02 * f_bin")
_DIAGONAL = ("1 + 0.02 * ant + 0.01 * t_bin", "0.05 * ant", "0.9 + 0.01 * ant", "0.03 * ant + 0.005 * ant * f_bin")
_WIDE = {"step": 1e8, "whole_band": True}

PLANTS: dict[str, Plant] = {
    "complex": Plant(_COMPLEX, 4, rounds=120),
    "diag_complex": Plant(_DIAGONAL),
    "amplitude": Plant(("1 + 0.05 * ant + 0.01 * t_bin", "0.9 + 0.02 * ant + 0.01 * f_bin")),
    "phase": Plant(("0.1 * ant + 0.02 * ant * t_bin", "-0.15 * ant")),
    "delay": Plant(_DELAY, whole_band=True, units=(_NS, _NS)),
    "delay_and_offset": Plant(_paired(_OFFSET, _DELAY), whole_band=True, units=(1.0, _NS) * 2),
    "delay_and_tec": Plant(_paired(_ELECTRONS, _SHORT), units=(_TEC, _NS) * 2, **_WIDE),
    "delay_tec_and_offset": Plant(_paired(_OFFSET, _ELECTRONS, _SHORT), units=(1.0, _TEC, _NS) * 2, wrapped=(0, 3), rounds=300, **_WIDE),
    "tec_and_offset": Plant(_paired(_OFFSET, _ELECTRONS), units=(1.0, _TEC) * 2, wrapped=(0, 2), **_WIDE),
    "rotation": Plant(("0.05 * ant + 0.02 * t_bin",), 4),
    "rotation_measure": Plant(("0.5 * ant + 0.2 * t_bin",), 4, whole_band=True),
    "crosshand_phase": Plant(("0.1 + 0.05 * t_bin + 0.1 * f_bin",), 4, per="array"),
    "crosshand_phase_null_v": Plant(("0.1 + 0.05 * t_bin + 0.1 * f_bin",), 4, per="array", real_model=True),
    "leakage": Plant(("0.02 + 0.01 * ant", "0.01 * t_bin", "-0.03", "0.005 * ant"), 4, rounds=300),
    "parallactic_angle": Plant(("0.1 * ant + 0.02 * t_bin", "0.1 * ant - 0.01 * t_bin"), 4),
    "feed_flip": Plant((), 4),
}


def _gain(kind: str, p: list[Column], freq: Column, low: float, high: float) -> Jones:
    """The gain of given unknowns, in the units in which they are stored."""
    zero, one = Cx.lit(0), Cx.lit(1)
    ends = lambda phases: Jones(tuple(polar(1, x) for x in phases))
    centre, tilt = (low + high) / 2, F.log(F.lit(low / high)) / (high - low)
    match kind:
        case "complex":
            return Jones(tuple(Cx(p[k], p[k + 1]) for k in range(0, 8, 2)))
        case "diag_complex":
            return Jones((Cx(p[0], p[1]), Cx(p[2], p[3])))
        case "leakage":
            return Jones((one, Cx(p[0], p[1]), Cx(p[2], p[3]), one))
        case "amplitude":
            return Jones(tuple(Cx(x, F.lit(0.0)) for x in p))
        case "phase":
            return ends(p)
        case "delay":
            return ends([TWO_PI * x * (freq - centre) for x in p])
        case "delay_and_offset":
            return ends([p[k] + TWO_PI * p[k + 1] * (freq - centre) for k in (0, 2)])
        case "delay_and_tec":
            return ends([TWO_PI * (p[k] * (1 / freq + tilt) + p[k + 1] * (freq - centre)) for k in (0, 2)])
        case "delay_tec_and_offset":
            return ends([p[k] + TWO_PI * (p[k + 1] / freq + p[k + 2] * freq) for k in (0, 3)])
        case "tec_and_offset":
            return ends([p[k] + TWO_PI * p[k + 1] / freq for k in (0, 2)])
        case "rotation" | "rotation_measure":
            angle = p[0] if kind == "rotation" else p[0] * F.pow(LIGHT / freq, F.lit(2.0))
            return rotation(-angle, False)
        case "crosshand_phase" | "crosshand_phase_null_v":
            return Jones((polar(1, p[0]), zero, zero, one))
        case "parallactic_angle":
            return rotation(p[0], False, other_angle=p[1])
    return Jones((zero, one, one, zero))


def _measured(spark: SparkSession, sf_dir: str, kind: str, dealt: bool = False) -> tuple[DataFrame, TermOptions]:
    """Corrupted visibilities with chunks and the bins of the term G. With ``dealt`` rows go to the tasks of solving before models and
    data, many times their size, are made."""
    plant, c = PLANTS[kind], F.col
    apply.small_methods(spark)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = (c("l_partkey") % N_ANT).cast("int"), (c("l_suppkey") % N_ANT).cast("int")
    utime, chan = F.floor(c("l_orderkey") / 50).cast("int"), (c("l_linenumber") - 1).cast("int")
    scan = F.floor(utime / 100).cast("int")
    part, supp = (c("l_partkey") % 5) * 0.5, c("l_suppkey") % 3 - 1.0
    cross = F.lit(0.0) if plant.real_model else supp * 0.8
    parts = (Cx(0.5 + part, F.lit(0.0)), Cx(0.3 + supp * 0.5, cross), Cx(0.3 + supp * 0.5, -cross), Cx(1 + (c("l_partkey") % 3) * 0.5, F.lit(0.0)))
    model = Jones(parts if plant.n_corr == 4 else (parts[0], Cx(F.lit(0.8), supp * 0.2)))
    bad = c("l_quantity") == 7
    # Neither ddid nor f_chunk is a literal: rows in an order of which one is part would be sorted again when data have been made.
    vis = li.where(a != b).select(
        scan.alias("scan"), (scan % 2).alias("field"), (chan * 0).alias("ddid"), (utime * 8.0).alias("time"), F.lit(8.0).alias("interval"), chan.alias("chan"),
        F.least(a, b).alias("ant1"), F.greatest(a, b).alias("ant2"), "l_partkey", "l_suppkey", "l_quantity", "l_tax",
    )
    chans = spark.range(N_CHAN).select(F.lit(0).alias("ddid"), c("id").cast("int").alias("chan"), (1e9 + c("id") * plant.step).alias("freq"), F.lit(plant.step).alias("width"))
    term = TermOptions("G", kind, time_interval=TIME_BIN, freq_interval=0 if plant.whole_band else FREQ_BIN, solve_per=plant.per)
    vis, times, chans = calibrate.chunked(vis, chans, TIME_CHUNK, N_CHAN)
    vis = calibrate.bin_terms(vis, times, chans, [term])
    vis = solver.deal(vis) if dealt else vis
    vis = vis.select(
        *[x for x in vis.columns if not x.startswith("l_")], F.monotonically_increasing_id().alias("row_id"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"), F.lit(0.0).alias("w"),
        (1e9 + c("chan") * plant.step).alias("freq"), F.lit(plant.step).alias("width"), F.array(model.column()).alias("model"),
        F.array(*[1 / (0.01 + c("l_tax"))] * plant.n_corr).alias("weight"), F.array(*[bad] * plant.n_corr).alias("flag"), F.lit(False).alias("flag_row"),
    )
    ends = (1e9, 1e9 + (N_CHAN - 1) * plant.step)
    for side in ("ant1", "ant2"):
        own = {"ant": side, "t_bin": "G_t_bin", "f_bin": "G_pf_bin"}
        vis = vis.withColumns({f"_{side}_{k}": _formula(f, own) for k, f in enumerate(plant.unknowns)})
        made = _gain(kind, [c(f"_{side}_{k}") for k in range(len(plant.unknowns))], c("freq"), *ends)
        vis = vis.withColumn(f"_{side}", made.column())
    p, q = (Jones.of(c(f"_{s}"), plant.n_corr) for s in ("ant1", "ant2"))
    vis = vis.withColumn("_left", (p @ Jones.of(c("model")[0], plant.n_corr)).column())
    data = Jones.of(c("_left"), plant.n_corr) @ q.herm()
    off = F.when(c("flag")[0], 5.0).otherwise(0.0)
    vis = vis.withColumn("data", Jones(tuple(Cx(x.re + off, x.im) for x in data.parts)).column())
    return preprocess.preprocess(vis.drop(*[x for x in vis.columns if x.startswith("_")]), plant.n_corr, "weight"), term


def _formula(text: str, names: dict[str, str]) -> Column:
    text = re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", r"\g<0>D", text)  # decimals, which SQL makes of these, take far longer
    return F.expr(f"cast({re.sub(r'[a-z_]+', lambda m: names.get(m[0], m[0]), text)} as double)")


def _wrapped(x: Column) -> Column:
    return x - TWO_PI * F.floor((x + TWO_PI / 2) / TWO_PI)


def _told(found: DataFrame, kind: str, cells: bool = False) -> DataFrame:
    """Rows of the cells with the unknowns in the units they are told in, rounded, and whether nothing is left of the chunk's data.
    The chunk's chi-squared comes by a window, since a second look at ``found`` would solve all chunks again; so do, with ``cells``, the
    cells with data, which alone are told."""
    left = F.max(F.when(F.col("kind") == "stats", F.col("post"))).over(Window.partitionBy(*CHUNK))
    found = found.where("kind IN ('gain', 'param', 'stats', 'cell')").withColumn("post", left)
    if cells:
        found = found.withColumn("_cell", F.bool_or(F.col("kind") == "cell").over(Window.partitionBy(*CELL))).where("_cell")
    plant = PLANTS[kind]
    if kind in solver.PLAIN or kind == "feed_flip":
        rows = found.where("kind = 'gain'")
        g = Jones.of(F.col("g"), plant.n_corr)
        if kind == "complex":  # a phase common to all antennas is free
            one = [F.max(F.when(F.col("ant") == 0, x)).over(Window.partitionBy(*CHUNK, "t_bin", "f_bin")) for x in (F.col("g")[0]["re"], F.col("g")[0]["im"])]
            rows = rows.withColumns({"_re": one[0], "_im": one[1]})
            size = F.hypot("_re", "_im")
            g = Jones(tuple(x * Cx(F.col("_re") / size, -F.col("_im") / size) for x in g.parts))
        parts = g.parts[1:3] if kind == "leakage" else g.parts
        values = [x for z in parts for x in (z.re, z.im)]
    elif kind == "parallactic_angle":
        rows = found.where("kind = 'gain'").dropDuplicates([*CELL])  # alike in all channels
        values = [F.atan2(F.col("g")[1]["re"], F.col("g")[0]["re"]), F.atan2(-F.col("g")[2]["re"], F.col("g")[3]["re"])]
    else:
        rows = found.where("kind = 'param'")
        units = plant.units or (1.0,) * len(plant.unknowns)
        values = [F.col("p")[k] / u for k, u in enumerate(units)]
        values = [_wrapped(x) if k in plant.wrapped else x for k, x in enumerate(values)]
    told = [(F.round(x + 3.7e-6, plant.digits) + 0.0).alias(f"v{k}") for k, x in enumerate(values)]
    return rows.select(*CELL, F.col("flag").cast("int").alias("gain_flag"), *told, (F.col("post") < 1e-7).alias("exact"))


def solved(spark: SparkSession, sf_dir: str, kind: str, slice_rows: int = 0) -> DataFrame:
    """What the solver finds for every interval and antenna with data, and whether nothing is left of the data; with ``slice_rows``,
    by slices of chunks."""
    plant, direct = PLANTS[kind], kind != "parallactic_angle" and not slice_rows
    vis, term = _measured(spark, sf_dir, kind, direct)
    options = SolverOptions(terms=("G",), iter_recipe=(plant.rounds,), convergence_fraction=1.0, convergence_criteria=1e-8)
    plan = solver.Plan((term,), options, plant.n_corr, N_ANT)
    if direct:
        return _told(solver.solve(vis, plan, dealt=True, cells=True), kind, True)
    cells = [*CHUNK, F.col("G_t_bin").alias("t_bin"), F.col("G_pf_bin").alias("f_bin")]
    seen = vis.select(*cells, F.explode(F.array("ant1", "ant2")).alias("ant")).distinct()
    loaded = None
    if kind == "parallactic_angle":
        p = [_formula(f, {}) for f in plant.unknowns]
        loaded = seen.select(*CELL[:-1], "ant", F.lit("G").alias("term"), F.lit(0).alias("dir"), F.lit(None).cast(JONES).alias("g"), F.array(*p).alias("p"))
    found = large.solve(vis, plan, slice_rows) if slice_rows else solver.solve(vis, plan, loaded)
    told = _told(found, kind)
    if kind == "parallactic_angle":
        seen = seen.select(*CELL).distinct()
    return told.join(seen, list(CELL), "left_semi")


def truth(kind: str) -> str:
    """The same cells by the formulas."""
    plant = PLANTS[kind]
    width = 1 if kind == "parallactic_angle" else TIME_BIN
    f_bin = "0" if plant.whole_band or kind == "parallactic_angle" else f"chan // {FREQ_BIN}"
    told = plant.told() if kind != "feed_flip" else ["0", "0", "1", "0", "1", "0", "0", "0"]
    values = ", ".join(f"CAST(round(CAST({x} AS DOUBLE) + 3.7e-6, {plant.digits}) AS DOUBLE) AS v{k}" for k, x in enumerate(told))
    keys = ", ".join(f"CAST({k} AS INTEGER) AS {k}" for k in CELL)
    return f"""WITH v AS (SELECT l_orderkey // 5000 AS scan, l_orderkey // 50 AS t, l_linenumber - 1 AS chan, l_partkey % {N_ANT} AS a, l_suppkey % {N_ANT} AS b
      FROM lineitem WHERE l_partkey % {N_ANT} <> l_suppkey % {N_ANT}),
    times AS (SELECT scan, t, dense_rank() OVER (PARTITION BY scan ORDER BY t) - 1 AS n FROM (SELECT DISTINCT scan, t FROM v) AS x),
    cells AS (SELECT DISTINCT scan, scan % 2 AS field, 0 AS ddid, n // {TIME_CHUNK} AS t_chunk, 0 AS f_chunk, n % {TIME_CHUNK} // {width} AS t_bin, {f_bin} AS f_bin, unnest([a, b]) AS ant
      FROM v JOIN times USING (scan, t))
    SELECT {keys}, 0 AS gain_flag, {values}, true AS exact FROM cells"""


def query(kind: str, slice_rows: int = 0):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return solved(spark, sf_dir, kind, slice_rows)

    run.__doc__ = f"Gains of type {kind}, found again from data that they corrupted{', by slices' if slice_rows else ''}."
    return run


QUERIES = {f"solve_{kind}": query(kind) for kind in PLANTS} | {"sliced_delay_and_offset": query("delay_and_offset", 5000)}
ORACLE_SQL = {f"solve_{kind}": truth(kind) for kind in PLANTS} | {"sliced_delay_and_offset": truth("delay_and_offset")}
