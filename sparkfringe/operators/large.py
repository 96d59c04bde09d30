"""Solving chunks that are too large for one task.

The rows of a chunk are dealt into slices, which are packed once. What a chunk's solution needs to know besides its rows, its head, is
one small row. An iteration is a join of slices and heads, in which every slice sums up its part of the normal equations, and a
grouped map that adds the parts and moves the unknowns; heads are written in between, so that lineage stays short and a lost executor
costs one iteration at most. The sums are those of the solver for whole chunks (:mod:`functions.kernels`), so all gain types, chains
and directions go, and the results are the same but for the order of sums. Robust weights need all residuals at once and
loaded gains a whole chunk; neither goes here.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.schemas import CHUNK
from ..sources.temporary import folder, remove
from . import solver
from .solver import Axes, Plan

#: Rows of a chunk beyond which it is sliced, and rows of a slice.
LIMIT, SLICE = 4_000_000, 1_000_000
_KEYS = ", ".join(f"{k} int" for k in CHUNK)


@dataclass
class Head:
    """A chunk without its rows."""

    keys: dict
    axes: Axes
    band: K.Band
    freqs: tuple[float, float, float]
    chain: list[K.TermState]
    hidden: list[tuple[int, np.ndarray]] = field(default_factory=list)  # flags of gains that hide data, in order
    run: K.Iteration | None = None
    resting: bool = False
    chi: dict = field(default_factory=dict)


def _merged(plan: Plan, keys: dict, facts: list[dict]) -> Head:
    axes = [f["axes"] for f in facts]
    channels, at = np.unique(np.concatenate([a.channels for a in axes]), return_index=True)
    freqs = np.concatenate([a.freqs for a in axes])[at]
    times = {t.name: tuple(np.unique(np.concatenate([np.stack([a.times[t.name][0].astype(float), a.times[t.name][1]]) for a in axes], axis=1), axis=1)) for t in plan.terms}
    bands = {t.name: np.concatenate([a.bands[t.name] for a in axes])[at] for t in plan.terms}
    whole = Axes(channels, freqs, {n: (x[0].astype(int), x[1]) for n, x in times.items()}, bands)
    n, band = sum(f["n"] for f in facts), K.Band(float(freqs.min()), float(freqs.max()))
    chain = solver.chain_of(plan, band, {t.name: (np.empty(0, int), np.empty(0, int)) for t in plan.terms})
    for t, state in zip(plan.terms, chain, strict=True):
        n_dir = facts[0]["n_dir"] if t.direction_dependent else 1
        state.whole = (int(whole.times[t.name][0].max()) + 1, int(bands[t.name].max()) + 1, plan.n_ant, n_dir)
        good = np.zeros(state.whole[:3], bool)
        for f in facts:
            good[tuple(f["covered"][t.name].T)] = True
        K.prepare(state, state.whole, good)
    return Head(keys, whole, band, (band.low, sum(f["freq"] for f in facts) / n, band.high), chain)


class _Slice:
    """The rows of a slice with the chain of its head."""

    def __init__(self, plan: Plan, packed: bytes, head: Head):
        own = pickle.loads(packed)
        self.chunk: K.Chunk = own["chunk"]
        self.rows, self.chain = own, head.chain
        for t, state in zip(plan.terms, head.chain, strict=True):
            state.t, state.f = own["bins"][t.name]
        for k, flags in head.hidden:
            state = head.chain[k]
            now, state.flags = state.flags, flags
            K.flag_data(self.chunk, state)
            state.flags = now


def _bare(head: Head) -> bytes:
    for state in head.chain:
        state.t = state.f = np.empty(0, int)
    return pickle.dumps(head)


class _Heads:
    """The heads of all chunks, as a table of the shared folder, and passes over the slices."""

    def __init__(self, plan: Plan, parts: DataFrame, heads: DataFrame, to: str):
        self.plan, self.parts, self.to, self.n = plan, parts, to, 0
        self._write(heads)

    def _write(self, heads: DataFrame) -> None:
        path = f"{self.to}/heads{self.n}"
        heads.write.parquet(path)
        if self.n:
            remove(heads.sparkSession, f"{self.to}/heads{self.n - 1}")
        self.n += 1
        self.heads = heads.sparkSession.read.schema(heads.schema).parquet(path)

    def go(self, part: Callable[[_Slice, Head], object], merge: Callable[[Head, list], None]) -> None:
        """Adds up what ``part`` says of every slice into the heads. A slice of a head at rest says nothing."""
        plan = self.plan

        def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    head = pickle.loads(row.column("head")[0].as_py())
                    said = None if head.resting else part(_Slice(plan, row.column("packed")[0].as_py(), head), head)
                    yield pa.RecordBatch.from_arrays([*[row.column(c) for c in CHUNK], pa.array([pickle.dumps(said)], pa.binary())], [*CHUNK, "said"])

        def add(said: pa.Table, heads: pa.Table) -> pa.Table:
            head = pickle.loads(heads.column("head")[0].as_py())
            parts = [pickle.loads(x) for x in said.column("said").to_pylist()]
            if not head.resting:
                merge(head, parts)
            return _row(head)

        said = self.parts.select(*CHUNK, "packed").join(self.heads.select(*CHUNK, "head"), list(CHUNK)).select(*CHUNK, "packed", "head").mapInArrow(say, f"{_KEYS}, said binary")
        self._write(said.groupBy(*CHUNK).cogroup(self.heads.groupBy(*CHUNK)).applyInArrow(add, f"{_KEYS}, head binary, resting boolean"))

    def each(self, change: Callable[[Head], None]) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("head").to_pylist():
                    head = pickle.loads(x)
                    change(head)
                    yield from _row(head).to_batches()

        self._write(self.heads.mapInArrow(run, f"{_KEYS}, head binary, resting boolean"))


def _row(head: Head) -> pa.Table:
    kinds = [pa.int32()] * len(CHUNK)
    return pa.table({k: pa.array([head.keys[k]], t) for k, t in zip(CHUNK, kinds, strict=True)} | {"head": pa.array([_bare(head)], pa.binary()), "resting": pa.array([head.resting])})


def solve(vis: DataFrame, plan: Plan, rows: int = SLICE) -> DataFrame:
    """The result table of :func:`operators.solver.solve`, of chunks of any size."""
    if plan.solver.robust:
        raise ValueError("robust weights need chunks that fit a task; choose a shorter time chunk")
    spark, s = vis.sparkSession, plan.solver
    to = folder(spark)
    vis = vis.select(*solver.columns_of(plan))
    many = vis.groupBy(*CHUNK).agg(F.ceil(F.count("*") / rows).cast("int").alias("slices"))
    dealt = vis.join(many, list(CHUNK)).withColumn("slice", F.pmod(F.xxhash64("row_id", "chan"), F.col("slices")).cast("int")).drop("slices")

    def pack(table: pa.Table) -> pa.Table:
        chunk, bins = solver.chunk_of(plan, table), solver._bins(plan, table)
        own = {"chunk": chunk, "bins": bins, "row_id": table.column("row_id").to_numpy(), "chan": table.column("chan").to_numpy()}
        fine = chunk.flag != 1
        seen = {n: np.unique(np.concatenate([np.stack([t[fine], f[fine], ant[fine]], 1) for ant in (chunk.ant1, chunk.ant2)]), axis=0) for n, (t, f) in bins.items()}
        facts = {"axes": Axes.of(plan, table), "n": table.num_rows, "freq": float(chunk.freq.sum()), "n_dir": chunk.model.shape[1], "covered": seen}
        return pa.table({k: table.column(k)[:1] for k in CHUNK} | {"packed": pa.array([pickle.dumps(own)], pa.large_binary()).cast(pa.binary()), "facts": pa.array([pickle.dumps(facts)], pa.binary())})

    dealt.groupBy(*CHUNK, "slice").applyInArrow(pack, f"{_KEYS}, packed binary, facts binary").write.parquet(f"{to}/parts")
    parts = spark.read.parquet(f"{to}/parts")

    def merge(table: pa.Table) -> pa.Table:
        keys = {k: table.column(k)[0].as_py() for k in CHUNK}
        return _row(_merged(plan, keys, [pickle.loads(x) for x in table.column("facts").to_pylist()]))

    heads = _Heads(plan, parts, parts.select(*CHUNK, "facts").groupBy(*CHUNK).applyInArrow(merge, f"{_KEYS}, head binary, resting boolean"), to)

    def chi(name: str) -> None:
        def put(head: Head, found: list) -> None:
            total, n = (sum(x) for x in zip(*found, strict=True))
            head.chi[name] = total / n if n else float("nan")

        heads.go(lambda own, head: K.chi_sums(own.chunk, own.chain), put)

    for k, t in enumerate(plan.terms if any(s.iter_recipe) else ()):
        if t.initial_estimate and {"delay", "tec"} & set(getattr(K.KINDS[t.type], "names", ())):
            heads.go(
                lambda own, head, k=k: K.coherent(own.chunk, own.chain[k], head.axes.freqs, s.reference_antenna),
                lambda head, found, k=k: K.guess(head.chain[k], head.axes.freqs, sum(found)),
            )
    chi("pre")
    for at, loops in enumerate(s.iter_recipe):
        k = at % len(plan.terms)
        if not K.KINDS[plan.terms[k].type].solvable or not loops:
            continue

        def begin(head: Head, k: int = k) -> None:
            head.run = K.Iteration(head.chain[k], head.chain[k].whole, head.freqs, s.convergence_fraction, s.convergence_criteria)

        def equations(own: _Slice, head: Head, k: int = k) -> tuple[np.ndarray, ...]:
            return K.equations(own.chunk, own.chain, k)()

        def move(head: Head, found: list) -> None:
            head.resting = head.run.step(*(sum(x) for x in zip(*found, strict=True)))

        def finish(head: Head, k: int = k) -> None:
            head.run.finish(s.reference_antenna)
            head.run, head.resting = None, False
            if s.propagate_flags:
                head.hidden.append((k, head.chain[k].flags.copy()))

        heads.each(begin)
        for _ in range(loops):
            heads.go(equations, move)
            if heads.heads.where("NOT resting").isEmpty():
                break
        heads.each(finish)
    chi("post")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("head").to_pylist():
                head = pickle.loads(x)
                yield from pa.concat_tables(solver.told(plan, head.keys, head.chain, head.axes, head.chi)).combine_chunks().to_batches()

    def data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, x in zip(batch.column("packed").to_pylist(), batch.column("head").to_pylist(), strict=True):
                head = pickle.loads(x)
                own = _Slice(plan, packed, head)
                yield from solver._rows(len(own.chunk.flag), head.keys, kind="vis", row_id=own.rows["row_id"], chan=own.rows["chan"], flag=own.chunk.flag, weight=solver._lists(own.chunk.weight)).to_batches()

    both = parts.select(*CHUNK, "packed").join(heads.heads.select(*CHUNK, "head"), list(CHUNK)).select("packed", "head")
    return heads.heads.select("head").mapInArrow(tell, solver.RESULT).unionByName(both.mapInArrow(data, solver.RESULT))


def solve_any(vis: DataFrame, plan: Plan, loaded: DataFrame | None = None, limit: int = LIMIT, rows: int = SLICE) -> DataFrame:
    """Chunks of up to ``limit`` rows in one task each, larger ones by slices."""
    big = vis.groupBy(*CHUNK).count().where(F.col("count") > limit).select(*CHUNK)
    if big.isEmpty():
        return solver.solve(vis, plan, loaded)
    if loaded is not None or plan.solver.robust:
        raise ValueError(f"loaded gains and robust weights need chunks of at most {limit} rows; choose shorter time or frequency chunks")
    small = solver.solve(vis.join(big, list(CHUNK), "left_anti"), plan)
    return small.unionByName(solve(vis.join(big, list(CHUNK), "left_semi"), plan, rows))
