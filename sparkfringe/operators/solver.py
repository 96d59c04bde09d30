"""Solving chains of gain terms: one grouped map per chunk.

A chunk is the unit of work that options set by time and bandwidth; its rows meet in one task, which holds
them as flat arrays. The map returns one table of several kinds of rows: gains, parameters, convergence, chi-squared,
and the flags and weights of the data. :func:`split` parts them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.config import SolverOptions, TermOptions
from ..plans.schemas import CHUNK, CPLX

#: Types whose gains change with every channel; their parameters have the coarser frequency bins.
FULL_RESOLUTION = ("delay", "delay_and_offset", "delay_and_tec", "delay_tec_and_offset", "tec_and_offset", "rotation_measure", "parallactic_angle")
PLAIN = ("complex", "diag_complex", "leakage")
#: Tasks of solving per core.
PER_CORE = 4

RESULT = f"""kind string, scan int, field int, ddid int, t_chunk int, f_chunk int, term string, type string,
t_bin int, f_bin int, gain_time double, gain_freq double, ant int, dir int, g array<{CPLX}>, p array<double>, flag byte,
loops bigint, converged double, pre double, post double, row_id bigint, chan int, weight array<double>"""


@dataclass(frozen=True)
class Plan:
    """What a chunk's task needs to know."""

    terms: tuple[TermOptions, ...]
    solver: SolverOptions
    n_corr: int
    n_ant: int
    circular: bool = False


def _complex(table: pa.Table, name: str, depth: int) -> np.ndarray:
    """(rows, ..., corr) from nested lists of structs of equal lengths."""
    column = table.column(name).combine_chunks()
    shape = [len(column)]
    for _ in range(depth):
        inner = column.flatten()
        shape.append(len(inner) // max(1, len(column)))
        column = inner
    re, im = (column.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return (re + 1j * im).reshape(shape)


def _cells(values: np.ndarray) -> pa.Array:
    """Complex (n, corr) as lists of structs."""
    n, k = values.shape
    flat = pa.StructArray.from_arrays([pa.array(values.real.ravel()), pa.array(values.imag.ravel())], names=["re", "im"])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), flat)


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(values.ravel().astype(float)))


_TYPES = {
    "kind": pa.string(), "scan": pa.int32(), "field": pa.int32(), "ddid": pa.int32(), "t_chunk": pa.int32(), "f_chunk": pa.int32(),
    "term": pa.string(), "type": pa.string(), "t_bin": pa.int32(), "f_bin": pa.int32(), "gain_time": pa.float64(), "gain_freq": pa.float64(),
    "ant": pa.int32(), "dir": pa.int32(), "g": pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())])), "p": pa.list_(pa.float64()),
    "flag": pa.int8(), "loops": pa.int64(), "converged": pa.float64(), "pre": pa.float64(), "post": pa.float64(), "row_id": pa.int64(),
    "chan": pa.int32(), "weight": pa.list_(pa.float64()),
}


def _rows(n: int, chunk: dict, **columns) -> pa.Table:
    """A part of the result with ``n`` rows; what isn't given is null."""
    out = {}
    for name, kind in _TYPES.items():
        value = columns.get(name, chunk.get(name))
        if isinstance(value, pa.Array):
            out[name] = value
        elif isinstance(value, np.ndarray):
            out[name] = pa.array(value.astype(kind.to_pandas_dtype()), kind)
        elif value is None:
            out[name] = pa.nulls(n, kind)
        else:
            out[name] = pa.repeat(pa.scalar(value, kind), n)
    return pa.table(out)


def _pairs(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each bin, in order."""
    order = np.lexsort((values, at))
    at, values = at[order], values[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (values[1:] != values[:-1])
    return at[new], values[new]


def _means(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The mean of the distinct values of each bin."""
    own, values = _pairs(at, values)
    count = np.bincount(own, minlength=n)
    return np.bincount(own, values, n) / np.maximum(count, 1)


def chunk_of(plan: Plan, table: pa.Table) -> K.Chunk:
    get = lambda name: table.column(name).to_numpy()
    weight = table.column("weight").combine_chunks().flatten().to_numpy().reshape(table.num_rows, plan.n_corr).copy()
    return K.Chunk(get("ant1").astype(int), get("ant2").astype(int), get("freq"), _complex(table, "data", 1), _complex(table, "model", 2), weight, get("flag").astype(np.int8), plan.n_ant)


def chain_of(plan: Plan, band: K.Band, bins: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[K.TermState]:
    """The terms with the intervals of every row, not solved yet."""
    chain = []
    for t in plan.terms:
        kind = K.KINDS[t.type](plan.n_corr, band)
        if isinstance(kind, K.ParallacticAngle):
            kind.circular = plan.circular
        chain.append(K.TermState(kind, *bins[t.name], t.direction_dependent, per_array=t.solve_per == "array", scalar=t.scalar, estimate=t.initial_estimate, pinned=t.pinned_directions))
    return chain


@dataclass
class Axes:
    """Times and channels of a chunk by the intervals of its terms."""

    channels: np.ndarray
    freqs: np.ndarray
    times: dict[str, tuple[np.ndarray, np.ndarray]]  # of a term, intervals and times
    bands: dict[str, tuple[np.ndarray, np.ndarray]]  # of a term, the interval of each channel's place

    @staticmethod
    def of(plan: Plan, table: pa.Table) -> Axes:
        get = lambda name: table.column(name).to_numpy()
        channels, at = np.unique(get("chan"), return_inverse=True)
        freqs = np.zeros(len(channels))
        freqs[at] = get("freq")
        times = {t.name: _pairs(get(f"{t.name}_t_bin").astype(int), get("time")) for t in plan.terms}
        bands = {}
        for t in plan.terms:
            own = np.zeros(len(channels), int)
            own[at] = get(f"{t.name}_pf_bin")
            bands[t.name] = own
        return Axes(channels, freqs, times, bands)


def told(plan: Plan, keys: dict, chain: list[K.TermState], axes: Axes, chi: dict) -> list[pa.Table]:
    """The rows of a chunk's gains, parameters, convergence and chi-squared."""
    parts = [_rows(1, keys, kind="stats", pre=chi["pre"], post=chi["post"])]
    for t, state in zip(plan.terms, chain, strict=True):
        named = keys | {"term": t.name, "type": t.type}
        parts.append(_rows(1, named, kind="conv", loops=state.loops, converged=state.converged))
        shape = state.flags.shape
        times = _means(*axes.times[t.name], shape[0])
        bands = axes.bands[t.name]
        if t.type in FULL_RESOLUTION:
            freqs, x, flags = axes.freqs, state.x[:, bands], state.flags[:, bands]
        else:
            freqs, x, flags = _means(bands, axes.freqs, shape[1]), state.x, state.flags
        grid = np.indices(flags.shape).reshape(4, -1)
        g = K.as_vector(state.kind.gains(x.reshape(flags.size, x.shape[-1]), freqs[grid[1]]), plan.n_corr)
        parts.append(_rows(len(g), named, kind="gain", t_bin=grid[0], f_bin=grid[1], ant=grid[2], dir=grid[3], gain_time=times[grid[0]], gain_freq=freqs[grid[1]], g=_cells(g), flag=flags.ravel()))
        if t.type not in PLAIN and state.kind.count():
            grid = np.indices(shape).reshape(4, -1)
            p = state.kind.stored(state.x).reshape(-1, state.kind.count())
            freqs = _means(bands, axes.freqs, shape[1])
            parts.append(_rows(len(p), named, kind="param", t_bin=grid[0], f_bin=grid[1], ant=grid[2], dir=grid[3], gain_time=times[grid[0]], gain_freq=freqs[grid[1]], p=_lists(p), flag=state.flags.ravel()))
    return parts


def _bins(plan: Plan, table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {t.name: tuple(table.column(f"{t.name}_{c}").to_numpy().astype(int) for c in ("t_bin", "pf_bin")) for t in plan.terms}


def _cells_of(plan: Plan, keys: dict, chunk: K.Chunk, chain: list[K.TermState]) -> list[pa.Table]:
    """A row for each interval and antenna with data, flagged or not."""
    parts = []
    for t, state in zip(plan.terms, chain, strict=True):
        at = np.nonzero(K.covered(chunk, state, flagged=True))
        parts.append(_rows(len(at[0]), keys | {"term": t.name, "type": t.type}, kind="cell", t_bin=at[0], f_bin=at[1], ant=at[2]))
    return parts


def _answer(plan: Plan, table: pa.Table, loaded: dict[str, np.ndarray] | None = None, cells: bool = False) -> pa.Table:
    keys = {k: table.column(k)[0].as_py() for k in CHUNK}
    chunk = chunk_of(plan, table)
    chain = chain_of(plan, K.Band(float(chunk.freq.min()), float(chunk.freq.max())), _bins(plan, table))
    for t, state in zip(plan.terms, chain, strict=True):
        if loaded and t.name in loaded:
            state.x = state.kind.loaded(loaded[t.name]) if t.type not in PLAIN else loaded[t.name]
    s = plan.solver
    chi = K.solve(chunk, chain, s.iter_recipe, s.robust, s.reference_antenna, stop_fraction=s.convergence_fraction, criterion=s.convergence_criteria, propagate=s.propagate_flags)
    parts = told(plan, keys, chain, Axes.of(plan, table), chi)
    if cells:
        return pa.concat_tables(parts + _cells_of(plan, keys, chunk, chain))
    parts.append(_rows(table.num_rows, keys, kind="vis", row_id=table.column("row_id").to_numpy(), chan=table.column("chan").to_numpy(), flag=chunk.flag, weight=_lists(chunk.weight)))
    return pa.concat_tables(parts)


def columns_of(plan: Plan) -> list[str]:
    return [*CHUNK, "row_id", "chan", "freq", "time", "ant1", "ant2", "data", "model", "weight", "flag", *[c for t in plan.terms for c in (f"{t.name}_t_bin", f"{t.name}_pf_bin")]]


def deal(vis: DataFrame) -> DataFrame:
    """Rows dealt to the tasks of solving, chunk by chunk. Columns that are made from a row's own may be added to them afterwards, and
    then aren't shuffled and sorted."""
    # A chunk's work is far above what its bytes say, so that small partitions must not be joined into few tasks.
    return vis.repartition(PER_CORE * vis.sparkSession.sparkContext.defaultParallelism, *CHUNK).sortWithinPartitions(*CHUNK)


def solve(vis: DataFrame, plan: Plan, loaded: DataFrame | None = None, dealt: bool = False, cells: bool = False) -> DataFrame:
    """The result table of all chunks. ``vis`` has the bins of every term (see :func:`plans.calibrate.bin_terms`).

    ``loaded`` gives starts: rows (keys, term, t_bin, f_bin, ant, dir, p) of parameters, or (…, g) of plain gains, on the bins of
    the terms. ``dealt`` tells that ``vis`` comes from :func:`deal`. With ``cells``, which is for solving without starts, there are
    rows of kind cell, one for each term's interval and antenna with data, in place of those of the data themselves.
    """
    vis = vis.select(*columns_of(plan))
    if loaded is None:
        vis = vis if dealt else deal(vis)

        def run(table: pa.Table) -> pa.Table:
            return _answer(plan, table, cells=cells)

        return vis.groupBy(*CHUNK).applyInArrow(run, RESULT)

    def start(table: pa.Table, gains: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(0, {}).cast(pa.schema(list(_TYPES.items())))
        return _answer(plan, table, _grids(plan, table, gains))

    own = loaded.select(*[F.col(c).alias(f"own_{c}") if c in CHUNK else F.col(c) for c in loaded.columns])
    return vis.groupBy(*CHUNK).cogroup(own.groupBy(*[f"own_{c}" for c in CHUNK])).applyInArrow(start, RESULT)


def _grids(plan: Plan, table: pa.Table, gains: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    rows = gains.to_pylist()
    n_dir = _complex(table, "model", 2).shape[1]
    for t in plan.terms:
        own = [r for r in rows if r["term"] == t.name]
        if not own:
            continue
        size = [int(table.column(f"{t.name}_{c}").to_numpy().max()) + 1 for c in ("t_bin", "pf_bin")]
        kind = K.KINDS[t.type](plan.n_corr, K.Band(1.0, 2.0))
        x = kind.start((*size, plan.n_ant, n_dir if t.direction_dependent else 1))
        for r in own:
            if r["t_bin"] < size[0] and r["f_bin"] < size[1]:
                value = [complex(z["re"], z["im"]) for z in r["g"]] if t.type in PLAIN else r["p"]
                x[r["t_bin"], r["f_bin"], r["ant"], r["dir"]] = np.array(value)[kind.elements()] if t.type in PLAIN else value
        out[t.name] = x
    return out


def split(result: DataFrame) -> dict[str, DataFrame]:
    """The kinds of rows of a result: gain, param, conv, stats and vis. Persist ``result`` first."""
    where = ["term", "type", *CHUNK, "t_bin", "f_bin"]
    of = lambda kind: result.where(F.col("kind") == kind)
    return {
        "gain": of("gain").select(*where, "gain_time", "gain_freq", "ant", "dir", "g", F.col("flag").alias("gain_flag")),
        "param": of("param").select(*where, F.col("gain_time").alias("param_time"), F.col("gain_freq").alias("param_freq"), "ant", "dir", "p", F.col("flag").alias("param_flag")),
        "conv": of("conv").select(*CHUNK, "term", "type", F.col("loops").alias("conv_iter"), F.col("converged").alias("conv_perc")),
        "stats": of("stats").select(*CHUNK, F.col("pre").alias("presolve_chisq"), F.col("post").alias("postsolve_chisq")),
        "vis": of("vis").select(*CHUNK, "row_id", "chan", "flag", "weight"),
    }


def convergence(conv: DataFrame) -> DataFrame:
    """How many chunks of a term have come to rest."""
    return conv.groupBy("term").agg(F.avg("conv_perc").alias("mean_converged"), F.max("conv_iter").alias("most_iterations"), F.count("*").alias("chunks"))


def gauss_newton_step(equations: DataFrame, gains: DataFrame, term: str, n_corr: int, keys: Sequence[str] = CHUNK, step: float = 0.5) -> DataFrame:
    """New diagonal gains from normal equations (:func:`operators.apply.normal_equations`): the solver's step as a
    join, for chunks too large for one task. The driver repeats it, writing gains in between. ``solved`` tells gains
    that all have moved from those without data, which stay."""
    from ..functions.jones import Cx, Jones

    own = gains.where(F.col("term") == term)
    out = own.join(equations, [*keys, "t_bin", "f_bin", "ant"], "left")
    parts = Jones.of(F.col("g"), n_corr).parts
    made, solved = [], F.lit(True)
    for k in range(n_corr):
        size = F.col(f"jhj{k}")
        solved = solved & F.coalesce(size > 1e-12, F.lit(False))
        known = F.coalesce(size > 1e-12, F.lit(False))
        update = Cx(F.col(f"re{k}") / size * step, F.col(f"im{k}") / size * step)
        made.append((parts[k] + update).where(known, parts[k]))
    return out.select(*[Jones(tuple(made)).column().alias("g") if c == "g" else F.col(c) for c in own.columns], solved.alias("solved"))
