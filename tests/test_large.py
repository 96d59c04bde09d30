"""Chunks solved by slices against the same chunks solved in one task."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfringe.operators import large, preprocess, solver
from sparkfringe.plans import calibrate, planted
from sparkfringe.plans.config import SolverOptions, TermOptions
from test_calibrate import N_ANT, measurement

SF = "/root/testdata/sf0.001"
PLACE = ["kind", "scan", "t_chunk", "f_chunk", "term", "t_bin", "f_bin", "ant", "dir", "row_id", "chan"]


def same(spark, vis, plan, rows):
    at = vis.sparkSession.createDataFrame(vis.collect(), vis.schema)  # both see the same rows
    one, many = (df.orderBy(*PLACE).collect() for df in (solver.solve(at, plan), large.solve(at, plan, rows)))
    assert len(one) == len(many) > 0
    for a, b in zip(one, many, strict=True):
        assert [a[c] for c in PLACE] == [b[c] for c in PLACE] and a.flag == b.flag
        for name in ("g", "p", "weight"):
            if a[name] is not None:
                x, y = (np.array([z if isinstance(z, float) else [z.re, z.im] for z in r[name]]) for r in (a, b))
                scale = np.maximum(1e-12, np.abs(x).max(initial=0))
                assert np.abs(x - y).max(initial=0) < 1e-5 * scale + 1e-9
        for name in ("gain_time", "gain_freq", "pre", "post", "converged"):
            assert a[name] is None or np.isclose(a[name], b[name], rtol=1e-5, atol=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("kind", ["delay_tec_and_offset", "leakage", "crosshand_phase"])
def test_slices_give_the_same_gains(spark, kind):
    vis, term = planted._measured(spark, SF, kind)
    plan = solver.Plan((term,), SolverOptions(terms=("G",), iter_recipe=(12,)), planted.PLANTS[kind].n_corr, planted.N_ANT)
    same(spark, vis.where("t_chunk = 0 AND scan = 0 AND G_t_bin < 3"), plan, 150)


def test_slices_of_a_chain_with_directions(spark):
    vis, chans, _ = measurement(spark, scans=1)
    vis = preprocess.preprocess(vis, 2, "weight")
    d = F.col("data")
    other = F.transform(d, lambda z: F.struct((z["re"] * 0 + 0.3).alias("re"), (z["im"] * 0 + 0.1).alias("im")))
    one = F.transform(d, lambda z: F.struct((z["re"] * 0 + 1.0).alias("re"), (z["im"] * 0).alias("im")))
    vis = vis.withColumn("model", F.array(one, other))
    terms = [TermOptions("G", "diag_complex", freq_interval=0), TermOptions("D", "amplitude", direction_dependent=True, time_interval=0, freq_interval=0)]
    vis, times, chans = calibrate.chunked(vis, chans, 0, 0)
    vis = calibrate.bin_terms(vis, times, chans, terms)
    plan = solver.Plan(tuple(terms), SolverOptions(terms=("G", "D"), iter_recipe=(6, 4, 3, 0)), 2, N_ANT)
    same(spark, vis, plan, 60)
    found = large.solve_any(vis, plan, limit=100, rows=60)
    assert found.where("kind = 'stats'").count() == 1 and large.solve_any(vis, plan).where("kind = 'gain'").count() == found.where("kind = 'gain'").count()
    with pytest.raises(ValueError):
        large.solve_any(vis, solver.Plan(tuple(terms), SolverOptions(terms=("G", "D"), iter_recipe=(6, 4), robust=True), 2, N_ANT), limit=100)
