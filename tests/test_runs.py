"""Runs with options that change what is read and written."""

import pytest
from pyspark.sql import functions as F

from sparkfringe.plans import calibrate, config
from sparkfringe.sources import tables

VIS = "scan int, field int, ddid int, row_id long, time double, interval double, ant1 int, ant2 int, u double, v double, w double, chan int, data array<struct<re:double,im:double>>, weight array<double>, flag array<boolean>, flag_row boolean"


def table(spark, path: str, corr_types=((9, 12),)):
    """Baselines of three antennas; those with antenna 2 are averaged over twice the time."""
    subs = {
        "ANTENNA": [(k, f"a{k}", "alt", 5e6, 1e6, -3e6, False) for k in range(3)], "SPECTRAL_WINDOW": [(0, [1e9, 1.1e9], [1e8, 1e8], 1e9, 2e8)],
        "POLARIZATION": [(k, list(c)) for k, c in enumerate(corr_types)], "DATA_DESCRIPTION": [(k, 0, k) for k in range(len(corr_types))],
        "FIELD": [(0, "f", 0, 0.1, 0.2)], "FEED": [(k, 0, ["X", "Y"], [0.0, 0.0]) for k in range(3)],
    }
    for name, rows in subs.items():
        spark.createDataFrame(rows, tables.SUB_TABLES[name]).write.parquet(f"{path}/{name}")
    rows, n = [], 0
    for d in range(len(corr_types)):
        for p, q, long in ((0, 1, 1), (0, 2, 2), (1, 2, 2)):
            for t in range(0, 4, long):
                n += 1
                z = (2.0 + 0.5 * p, 0.3 * q)
                rows += [(t // 2, 0, d, n, 8.0 * t + 4.0 * long, 8.0 * long, p, q, 10.0 * q, 5.0, 1.0, c, [z, z], [1.0 * long] * 2, [False] * 2, False) for c in (0, 1)]
    vis = spark.createDataFrame(rows, VIS)
    tables.write_main(vis.withColumn("raw", F.transform("data", lambda z: F.struct((z["re"] * 2).alias("re"), (z["im"] * 2).alias("im")))), path)
    return rows


def test_averaged_data_come_back_on_their_rows(spark, tmp_path):
    path = str(tmp_path)
    rows = table(spark, path)
    options = {
        "input_ms": {"path": path, "weight_column": "weight", "is_bda": True, "data_column": "raw", "group_by": ["field", "ddid"]}, "solver": {"iter_recipe": [0]},
        "G": {"type": "diag_complex"}, "output": {"path": f"{path}/out", "products": ["residual", "corrected_weight"], "columns": ["R", "W"], "flags": False},
    }
    done = calibrate.run(spark, config.load(options))
    back = spark.read.parquet(f"{path}/out/MAIN")
    assert "flag" not in back.columns
    got = {(r.row_id, r.chan): (round(r.R[0].re, 6), round(r.R[1].im, 6), round(r.W[0], 6)) for r in back.collect()}
    assert got == {(r[3], r[11]): (round(2 * r[12][0][0] - 1, 6), round(2 * r[12][1][1], 6), r[13][0]) for r in rows}
    assert done.stats.select("scan").distinct().count() == 1
    done.release()


def test_unlike_correlations_are_refused(spark, tmp_path):
    table(spark, str(tmp_path), ((9, 12), (5, 8)))
    with pytest.raises(ValueError, match="select_ddids"):
        calibrate.run(spark, config.load({"input_ms": {"path": str(tmp_path)}}))
    found = calibrate.run(spark, config.load({"input_ms": {"path": str(tmp_path), "select_ddids": [1]}, "solver": {"iter_recipe": [1]}}))
    assert {r.ddid for r in found.stats.collect()} == {1}


def test_robust_whitening_needs_the_robust_solver():
    with pytest.raises(config.ConfigError):
        config.load({"mad_flags": {"enable": True, "whitening": "robust"}})
    config.load({"mad_flags": {"enable": True, "whitening": "robust"}, "solver": {"robust": True}})
