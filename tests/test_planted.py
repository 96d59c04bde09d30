"""Solved gains against the formulas that made the data."""

import os

import numpy as np
import pytest

from sparkfringe.functions import kernels as K
from sparkfringe.plans import planted

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("kind", ["diag_complex", "delay_tec_and_offset", "crosshand_phase", "leakage", "parallactic_angle"])
def test_planted_gains_are_found(spark, kind):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
        want = con.execute(planted.truth(kind)).df()
    got = planted.solved(spark, SF, kind).toPandas()
    names = list(want.columns)
    assert sorted(got.columns) == sorted(names) and len(got) == len(want)
    assert got[names].sort_values(names).values.tolist() == want.sort_values(names).values.tolist()


def corrupted(kind, n_corr, apart=1.0):
    """A chunk of one interval with gains of a kind, and its term; weights within two groups of antennas are less by ``apart``."""
    rng, n_ant, n = np.random.default_rng(11), 7, 400
    ant1 = rng.integers(0, n_ant, n)
    ant2 = (ant1 + rng.integers(1, n_ant, n)) % n_ant
    wave = lambda *shape: rng.normal(size=shape) + 1j * rng.normal(size=shape)
    weight = np.where((ant1 < 4) == (ant2 < 4), apart, 1.0)[:, None] * rng.uniform(10, 100, (n, n_corr))
    chunk = K.Chunk(np.minimum(ant1, ant2), np.maximum(ant1, ant2), np.full(n, 1e9), np.zeros((n, n_corr), complex), wave(n, 1, n_corr), weight, np.zeros(n, np.int8), n_ant)
    true, term = (K.TermState(K.KINDS[kind](n_corr, K.Band(1e9, 1e9)), np.zeros(n, int), np.zeros(n, int)) for _ in range(2))
    true.x = true.kind.start((1, 1, n_ant, 1))
    true.x = true.x + 0.1 * (rng.normal(size=true.x.shape) if true.kind.real else wave(*true.x.shape))
    chunk.data = K.model_visibilities(chunk, [true])
    return chunk, term, true


def test_amplitudes_of_two_loosely_joined_groups_are_found():
    """Antennas that nearly all look at those of the other group: solved for one by one they go back and forth, and after 80
    iterations something is left of the data."""
    chunk, term, true = corrupted("amplitude", 2, apart=0.01)
    left = K.solve(chunk, [term], (planted.PLANTS["amplitude"].rounds,), stop_fraction=1.0, criterion=1e-8)
    assert left["post"] < 1e-7 and np.allclose(term.x, true.x) and not (term.flags == 1).any()


@pytest.mark.parametrize(("kind", "n_corr"), [("complex", 4), ("complex", 2), ("leakage", 4), ("diag_complex", 4), ("amplitude", 4)])
def test_equations_of_all_antennas_agree_with_those_of_one(kind, n_corr):
    chunk, term, _ = corrupted(kind, n_corr)
    chunk.flag[::7] = 1
    K.start(chunk, term)
    term.x = term.x * 1.05
    own, together = K.normal_equations(chunk, [term], 0), K.Together(chunk, term)()
    assert all(np.allclose(a, b) for a, b in zip(own, together[:2], strict=True))
    cross = together[2].reshape(7 * term.kind.count(), -1)
    assert np.allclose(cross, cross.T)


@pytest.mark.parametrize("kind", ["complex", "leakage"])
def test_few_iterations_do(kind):
    """Antennas solved for one by one need some 70 iterations here."""
    chunk, term, true = corrupted(kind, 4)
    left = K.solve(chunk, [term], (planted.PLANTS[kind].rounds,), stop_fraction=1.0, criterion=1e-8)
    assert term.loops <= 12 and term.converged == 1 and left["post"] < 1e-12


def test_a_query_solves_its_chunks_once(spark, tmp_path):
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double"
    spark.createDataFrame([(k, k, 3 * k + 1, k % 7 + 1, 1.0, 0.0) for k in range(90)], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = planted.solved(spark, str(tmp_path), "diag_complex")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def lineitems(spark, path, n=300):
    """Rows of which those of the second interval are flagged."""
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_tax double"
    rows = [(50 * (k // 20), k, 3 * k + 1, k % 7 + 1, 7.0 if k // 100 == 1 else 1.0, 0.0) for k in range(n)]
    spark.createDataFrame(rows, names).write.parquet(f"{path}/lineitem.parquet")


def test_rows_are_dealt_before_their_data_are_made(spark, tmp_path):
    """What is shuffled and sorted for the solver are the columns that data are made of, and the lines are read once for it."""
    lineitems(spark, tmp_path)
    plan = planted.solved(spark, str(tmp_path), "leakage")._jdf.queryExecution().executedPlan().toString()
    made = plan.split("FlatMapGroupsInArrow")[1].split("Exchange")[0]
    assert "_left" in made and made.count("Sort [") == 1 and made.index("_left") < made.index("Sort [")
    assert plan.count("FileScan") == 3  # the other two tell times apart
    assert "decimal" not in plan


@pytest.mark.parametrize("kind", ["leakage", "delay", "crosshand_phase"])
def test_all_cells_with_data_are_told(spark, tmp_path, kind):
    """Those all of whose data are flagged, too."""
    duckdb = pytest.importorskip("duckdb")
    lineitems(spark, tmp_path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
        want = con.execute(f"SELECT {', '.join(planted.CELL)} FROM ({planted.truth(kind)})").fetchall()
    got = planted.solved(spark, str(tmp_path), kind).collect()
    assert sorted(tuple(r[k] for k in planted.CELL) for r in got) == sorted(want)
    assert any(r["gain_flag"] == 1 for r in got)
