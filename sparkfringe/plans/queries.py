"""Queries over a table of visibilities made from ``lineitem``, with the SQL that says the same.

The tables at hand are orders, not measurements, so each line item becomes one visibility of two correlations between
antennas 0-6 and 7-13, by plain expressions; gains follow from antenna and interval numbers by a formula, which
the SQL uses in place of the joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones, baseline_id, to_interpolable
from ..operators import angles, apply, bda, binning, flagging, interpolation, model, preprocess, solver, stats, weights
from . import chains, planted, stored
from .config import parse_recipe
from .schemas import CHUNK, KEYS

N_ANT, N_CORR, DIGITS = 14, 2, 6
TIME_CHUNK, TIME_BIN, FREQ_CHUNK, FREQ_BIN = 40, 5, 4, 2
TERM = apply.Term("G")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cx(re: Column, im: Column | float) -> Cx:
    return Cx(re.cast("double"), F.lit(float(im)) if isinstance(im, (int, float)) else im.cast("double"))


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    utime = F.floor(c("l_orderkey") / 50).cast("int")
    scan = F.floor(utime / 100).cast("int")
    chan = (c("l_linenumber") - 1).cast("int")
    data = Jones((_cx(c("l_extendedprice") / 10000, c("l_discount") * 10), _cx(c("l_quantity") / 10, c("l_tax") * 10)))
    models = [Jones((_cx(c("l_quantity") / 10, 0), _cx(F.lit(1.0), 0.5))), Jones((_cx(c("l_discount"), 0.25), _cx(F.lit(0.5), 0)))]
    return li.select(
        scan.alias("scan"), (scan % 2).alias("field"), F.lit(0).alias("ddid"), c("l_orderkey").alias("row_id"),
        (utime * 8.0).alias("time"), F.lit(8.0).alias("interval"), (c("l_partkey") % 7).cast("int").alias("ant1"),
        (7 + c("l_suppkey") % 7).cast("int").alias("ant2"), (c("l_partkey") % 100 * 10.0).alias("u"), (c("l_suppkey") % 50 * 10.0).alias("v"),
        (c("l_quantity") * 1.0).alias("w"), chan.alias("chan"), (1e9 + chan * 1e6).alias("freq"), F.lit(1e6).alias("width"), data.column().alias("data"),
        F.array(*[m.column() for m in models]).alias("model"), F.array(1 / (0.01 + c("l_tax")), F.lit(1.0)).alias("weight"),
        F.array(c("l_returnflag") == "R", c("l_quantity") == 7).alias("flag"), (c("l_quantity") == 50).alias("flag_row"),
    )


_VIS = f"""
WITH RECURSIVE v0 AS (
  SELECT CAST(floor(l_orderkey / 5000) AS INTEGER) AS scan, CAST(floor(l_orderkey / 5000) AS INTEGER) % 2 AS field, 0 AS ddid,
    l_orderkey AS row_id, floor(l_orderkey / 50) * 8.0 AS time, 8.0 AS ivl, CAST(l_partkey % 7 AS INTEGER) AS ant1,
    CAST(7 + l_suppkey % 7 AS INTEGER) AS ant2, l_partkey % 100 * 10.0 AS u, l_suppkey % 50 * 10.0 AS v, l_quantity AS w, l_linenumber - 1 AS chan,
    1e9 + (l_linenumber - 1) * 1e6 AS freq,
    l_extendedprice / 10000 AS d0r, l_discount * 10 AS d0i, l_quantity / 10 AS d1r, l_tax * 10 AS d1i,
    l_quantity / 10 AS m0r, 0.0 AS m0i, 1.0 AS m1r, 0.5 AS m1i, l_discount AS n0r, 0.25 AS n0i, 0.5 AS n1r, 0.0 AS n1i,
    1 / (0.01 + l_tax) AS w0, 1.0 AS w1, l_returnflag = 'R' AS f0, l_quantity = 7 AS f1, l_quantity = 50 AS frow
  FROM lineitem
), times AS (
  SELECT scan, field, ddid, time, count(*) AS n_rows, CAST((dense_rank() OVER (PARTITION BY scan, field, ddid ORDER BY time) - 1) // {TIME_CHUNK} AS INTEGER) AS t_chunk
  FROM v0 GROUP BY scan, field, ddid, time
), bins AS (
  SELECT *, CAST((dense_rank() OVER (PARTITION BY scan, field, ddid, t_chunk ORDER BY time) - 1) // {TIME_BIN} AS INTEGER) AS t_bin FROM times
), vis AS (
  SELECT v0.*, bins.t_chunk, bins.t_bin, chan // {FREQ_CHUNK} AS f_chunk, chan % {FREQ_CHUNK} // {FREQ_BIN} AS f_bin,
    CASE WHEN f0 OR f1 OR frow OR (d0r = 0 AND d0i = 0) OR (d1r = 0 AND d1i = 0) OR w0 = 0 THEN 1 ELSE 0 END AS bad
  FROM v0 JOIN bins USING (scan, field, ddid, time)
)"""

_GAINS = """, g AS (
  SELECT *, 1 + 0.01 * ant1 AS p0r, 0.02 * t_bin AS p0i, 0.9 AS p1r, 0.01 * ant1 + 0.001 * f_bin AS p1i,
    1 + 0.01 * ant2 AS q0r, 0.02 * t_bin AS q0i, 0.9 AS q1r, 0.01 * ant2 + 0.001 * f_bin AS q1i
  FROM vis
)"""


def _mul(a: tuple[str, str], b: tuple[str, str], conj: bool = False) -> tuple[str, str]:
    (ar, ai), (br, bi) = a, b
    s = "-" if conj else ""
    return f"(({ar}) * ({br}) - ({ai}) * ({s}({bi})))", f"(({ar}) * ({s}({bi})) + ({ai}) * ({br}))"


def _z(name: str) -> tuple[str, str]:
    return f"{name}r", f"{name}i"


def _corrupted(k: int, model_: str = "m") -> tuple[str, str]:
    return _mul(_mul(_z(f"p{k}"), _z(f"{model_}{k}")), _z(f"q{k}"), True)


def _resid(k: int) -> tuple[str, str]:
    parts = [_corrupted(k, m) for m in "mn"]
    return f"(d{k}r - {parts[0][0]} - {parts[1][0]})", f"(d{k}i - {parts[0][1]} - {parts[1][1]})"


_RESID = _GAINS + ", r AS (SELECT *, " + ", ".join(f"{_resid(k)[j]} AS r{k}{'ri'[j]}" for k in range(2) for j in range(2)) + " FROM g)"
_KEYS = ", ".join(CHUNK)


def _intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Times and channels with their chunks and the bins of the term G."""
    times = binning.time_chunks(binning.distinct_times(visibilities(spark, sf_dir)), TIME_CHUNK)
    times = binning.time_bins(times, TIME_BIN, TERM.t_bin)
    chans = binning.freq_chunks(_channels(spark), FREQ_CHUNK)
    return times, binning.freq_bins(chans, FREQ_BIN, TERM.f_bin)


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprocessed rows with chunks and bins of the term G."""
    vis = preprocess.preprocess(visibilities(spark, sf_dir), N_CORR, "weight", flag_autocorrelations=True)
    times, chans = _intervals(spark, sf_dir)
    out = binning.attach(vis, times.drop("interval", "n_rows"), [*KEYS, "time"])
    return binning.attach(out, F.broadcast(chans.drop("freq", "width")), ["ddid", "chan"])  # seven channels


def _channels(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(F.lit(0).alias("ddid"), F.col("id").cast("int").alias("chan"), (1e9 + F.col("id") * 1e6).alias("freq"), F.lit(1e6).alias("width"))


def gains_of(vis: DataFrame, n_dir: int = 1) -> DataFrame:
    """The gain table of the term G by its formula, on all intervals of ``vis``."""
    t, f, ant = F.col("t_bin"), F.col("f_bin"), F.col("ant")
    bins = vis.select(*CHUNK, F.col(TERM.t_bin).alias("t_bin"), F.col(TERM.f_bin).alias("f_bin")).distinct()
    rows = bins.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_ANT - 1))).alias("ant"))
    g = Jones((_cx(1 + 0.01 * ant, 0.02 * t), _cx(F.lit(0.9), 0.01 * ant + 0.001 * f)))
    flag = ((ant + t) % 11 == 0).cast("byte")
    return rows.select(F.lit("G").alias("term"), *CHUNK, "t_bin", "f_bin", "ant", F.lit(0).alias("dir"), g.column().alias("g"), flag.alias("gain_flag"))


def _all_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of every time and channel interval, from the tables of intervals alone."""
    times, chans = _intervals(spark, sf_dir)
    return gains_of(times.select(*KEYS, "t_chunk", TERM.t_bin).distinct().join(chans.select("ddid", "f_chunk", TERM.f_bin).distinct(), "ddid"))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.attach_gains(chunked(spark, sf_dir), _all_gains(spark, sf_dir), [TERM])


def _resid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.residual(_applied(spark, sf_dir), [TERM], N_CORR, 2)


def _flat(column: str, n: int = N_CORR) -> list[Column]:
    return [F.col(column)[k][p].alias(f"{column}{k}{p}") for k in range(n) for p in ("re", "im")]


def _sums(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Sums of a complex column by keys, rounded, for results that don't depend on the order of rows."""
    parts = [_r(F.sum(F.col(column)[k][p]), 4).alias(f"{column}{k}{p}") for k in range(N_CORR) for p in ("re", "im")]
    return rows.groupBy(*keys).agg(*parts, F.count("*").alias("n"))


def _sql_sums(name: str, cells: list[tuple[str, str]], source: str, keys: str) -> str:
    made = ", ".join(f"round(sum({x}), 4) AS {name}{k}{p}" for k, cell in enumerate(cells) for p, x in zip(("re", "im"), cell, strict=True))
    return f"SELECT {keys}, {made}, count(*) AS n FROM {source} GROUP BY {keys}"


def _r(x: Column, digits: int = DIGITS) -> Column:
    """Rounded, by a shift that keeps sums of short decimals away from ties, which the last bit would decide."""
    return F.round(x + float(f"3.7e-{digits + 2}"), digits)


def _shifted(sql: str) -> str:
    """The same shift in each ``round(x, digits)`` of a query."""
    out, at = [], 0
    while (k := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, k + 6, 0
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        out.append(f"{sql[at:k]}round({_shifted(sql[k + 6 : comma])} + 3.7e-{int(sql[comma + 1 : end - 1]) + 2}{sql[comma:end]}")
        at = end
    return "".join(out) + sql[at:]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _shifted(sql)
        return f

    return add


@query(f"""{_VIS}{_RESID} SELECT {_KEYS}, round(sum(CASE WHEN bad = 0 THEN (r0r*r0r + r0i*r0i) * w0 + (r1r*r1r + r1i*r1i) * w1 END) / (2 * count(CASE WHEN bad = 0 THEN 1 END)), 6) AS chisq,
  2 * count(CASE WHEN bad = 0 THEN 1 END) AS n FROM r GROUP BY {_KEYS}""")
def chunk_chisq(spark, sf_dir):
    return stats.chi_squared(_resid_rows(spark, sf_dir), N_CORR).withColumn("chisq", _r(F.col("chisq")))


@query(f"""{_VIS} SELECT {_KEYS}, round(sum(CASE WHEN bad = 0 THEN ((d0r-m0r-n0r)*(d0r-m0r-n0r) + (d0i-m0i-n0i)*(d0i-m0i-n0i)) * w0 + ((d1r-m1r-n1r)*(d1r-m1r-n1r) + (d1i-m1i-n1i)*(d1i-m1i-n1i)) * w1 END)
  / (2 * count(CASE WHEN bad = 0 THEN 1 END)), 6) AS presolve_chisq, 2 * count(CASE WHEN bad = 0 THEN 1 END) AS n FROM vis GROUP BY {_KEYS}""")
def presolve_chisq(spark, sf_dir):
    return stats.presolve_chi_squared(chunked(spark, sf_dir), N_CORR, 2).withColumn("presolve_chisq", _r(F.col("presolve_chisq")))


@query(f"""{_VIS}{_RESID}, c AS (SELECT {_KEYS}, sum(CASE WHEN bad = 0 THEN (r0r*r0r + r0i*r0i) * w0 + (r1r*r1r + r1i*r1i) * w1 END) / (2 * count(CASE WHEN bad = 0 THEN 1 END)) AS x FROM r GROUP BY {_KEYS})
  SELECT round(avg(x), 5) AS chisq_mean, round(stddev_pop(x), 5) AS chisq_std FROM c""")
def chisq_summary(spark, sf_dir):
    found = stats.chi_squared_summary(stats.chi_squared(_resid_rows(spark, sf_dir), N_CORR), ["chisq"])
    return found.select(_r(F.col("chisq_mean"), 5).alias("chisq_mean"), _r(F.col("chisq_std"), 5).alias("chisq_std"))


@query("SELECT CAST(l_orderkey // 5000 AS INTEGER) AS scan, count(*) AS n, round(sum(l_quantity / 10), 4) AS total FROM lineitem WHERE l_orderkey // 5000 % 2 = 1 GROUP BY ALL")
def select_partitions(spark, sf_dir):
    rows = preprocess.select_partitions(visibilities(spark, sf_dir), 1, [0])
    return rows.groupBy("scan").agg(F.count("*").alias("n"), _r(F.sum(F.col("data")[1]["re"]), 4).alias("total"))


@query("SELECT l_linenumber - 1 AS chan, count(*) AS n, round(sum(l_tax * 10), 4) AS total, count(*) FILTER (l_quantity = 7) AS flagged FROM lineitem GROUP BY ALL")
def select_correlations(spark, sf_dir):
    rows = preprocess.select_correlations(visibilities(spark, sf_dir), [1], N_CORR)
    return rows.groupBy("chan").agg(F.count("*").alias("n"), _r(F.sum(F.col("data")[0]["im"]), 4).alias("total"), F.count_if(F.col("flag")[0]).alias("flagged"))


@query(f"""{_VIS} SELECT scan, count(*) FILTER (bad = 1) AS hard, count(*) FILTER (bad = 0 AND NOT (sqrt(u*u + v*v) > 100 AND sqrt(u*u + v*v) < 800)) AS soft,
  count(*) FILTER (bad = 0 AND sqrt(u*u + v*v) > 100 AND sqrt(u*u + v*v) < 800) AS good FROM vis GROUP BY scan""")
def initial_flags(spark, sf_dir):
    rows = preprocess.preprocess(visibilities(spark, sf_dir), N_CORR, "weight", uv_range=(100.0, 800.0))
    return rows.groupBy("scan").agg(*[F.count_if(F.col("flag") == k).alias(n) for k, n in ((1, "hard"), (-1, "soft"), (0, "good"))])


@query("SELECT l_linenumber - 1 AS chan, round(sum(CASE WHEN l_tax <> 0 THEN 1 / (l_tax * l_tax) ELSE 0 END), 2) AS w0, CAST(count(*) AS DOUBLE) AS w1 FROM lineitem GROUP BY ALL")
def sigma_weights(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("chan"), F.array("l_tax", F.lit(1.0)).alias("sigma"))
    rows = li.withColumn("weight", preprocess.initial_weights(2, sigma="sigma"))
    return rows.groupBy("chan").agg(_r(F.sum(F.col("weight")[0]), 2).alias("w0"), F.sum(F.col("weight")[1]).alias("w1"))


@query(f"{_VIS} SELECT scan, time, n_rows, CAST(t_chunk AS INTEGER) AS t_chunk, CAST(t_bin AS INTEGER) AS t_bin FROM bins")
def time_intervals(spark, sf_dir):
    times = binning.time_chunks(binning.distinct_times(visibilities(spark, sf_dir)), TIME_CHUNK)
    return binning.time_bins(times, TIME_BIN).select("scan", "time", "n_rows", "t_chunk", "t_bin")


@query(f"""{_VIS}, x AS (SELECT scan, time, floor((row_number() OVER (PARTITION BY scan ORDER BY time) - 1) * 8.0 / 100.0) AS cell FROM (SELECT DISTINCT scan, time FROM v0) AS y),
  c AS (SELECT scan, time, dense_rank() OVER (PARTITION BY scan ORDER BY cell) - 1 AS t_chunk FROM x)
  SELECT scan, time, CAST(t_chunk AS INTEGER) AS t_chunk, CAST((row_number() OVER (PARTITION BY scan, t_chunk ORDER BY time) - 1) // 3 AS INTEGER) AS t_bin FROM c""")
def time_intervals_by_length(spark, sf_dir):
    """Chunks of 100 s and greedy intervals of 20 s, which are three slots of 8 s."""
    times = binning.time_chunks(binning.distinct_times(visibilities(spark, sf_dir)), 100.0)
    return binning.time_bins(times, 20.0).select("scan", "time", "t_chunk", "t_bin")


@query("""SELECT DISTINCT l_linenumber - 1 AS chan, (l_linenumber - 1) // 4 AS by_count, (l_linenumber - 1) // 3 AS by_width,
  ((l_linenumber - 1) % 3) // 2 AS bin_by_width, ((l_linenumber - 1) % 3) // 2 AS bin_by_count FROM lineitem""")
def channel_intervals(spark, sf_dir):
    """Chunks of 4 channels, and of more than 2 MHz; bins of 2 channels or 2 MHz in the latter."""
    chans = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("chan")).distinct()
    chans = chans.select(F.lit(0).alias("ddid"), "chan", (1e9 + F.col("chan") * 1e6).alias("freq"), F.lit(1e6).alias("width"))
    one = binning.freq_chunks(chans, 4).select("chan", F.col("f_chunk").alias("by_count"))
    two = binning.freq_bins(binning.freq_bins(binning.freq_chunks(chans, 2e6), 2e6, "bin_by_width"), 2, "bin_by_count")
    return one.join(two.select("chan", F.col("f_chunk").alias("by_width"), "bin_by_width", "bin_by_count"), "chan")


@query(f"{_VIS} SELECT scan, CAST(t_chunk AS INTEGER) AS t_chunk, CAST(t_bin AS INTEGER) AS t_bin, avg(time) AS gain_time, min(time) AS first, max(time) AS last, count(*) AS n FROM bins GROUP BY ALL")
def gain_coordinates(spark, sf_dir):
    times = binning.time_bins(binning.time_chunks(binning.distinct_times(visibilities(spark, sf_dir)), TIME_CHUNK), TIME_BIN)
    return binning.coordinates(times, ["scan", "t_chunk"], "t_bin", "time")


@query("""SELECT l_linenumber - 1 AS chan, round(sum(l_extendedprice / 10000 + l_quantity / 10), 4) AS a, round(sum(l_discount * 10 - l_quantity / 10), 4) AS b, round(sum(-(l_tax * 10)), 4) AS c FROM lineitem GROUP BY ALL""")
def model_recipe(spark, sf_dir):
    """Two directions: A+B and A~B, and one subtracted from nothing."""
    li = table(spark, sf_dir, "lineitem")
    one = lambda x: F.array(_cx(x, 0).column())
    rows = li.select((F.col("l_linenumber") - 1).alias("chan"), one(F.col("l_extendedprice") / 10000).alias("A"), one(F.col("l_quantity") / 10).alias("B"), one(F.col("l_discount") * 10).alias("C"), one(F.col("l_tax") * 10).alias("D"))
    rows = model.add_model(rows, parse_recipe("A+B:C~B:~D"), 1)
    return rows.groupBy("chan").agg(*[_r(F.sum(F.col("model")[d][0]["re"]), 4).alias(n) for d, n in enumerate("abc")])


@query(f"{_VIS}{_RESID} {_sql_sums('residual', [_z('r0'), _z('r1')], 'r', 'scan, chan')}")
def residual(spark, sf_dir):
    return _sums(_resid_rows(spark, sf_dir), "residual", "scan", "chan")


def _sql_corrected(k: int, of: str) -> tuple[str, str]:
    top = _mul(_mul(_z(f"{of}{k}"), _z(f"p{k}"), True), _z(f"q{k}"))
    size = f"((p{k}r*p{k}r + p{k}i*p{k}i) * (q{k}r*q{k}r + q{k}i*q{k}i))"
    return f"{top[0]} / {size}", f"{top[1]} / {size}"


@query(f"{_VIS}{_GAINS} {_sql_sums('corrected_data', [_sql_corrected(0, 'd'), _sql_corrected(1, 'd')], 'g', 'scan, chan')}")
def corrected_data(spark, sf_dir):
    return _sums(apply.corrected(_applied(spark, sf_dir), [TERM], N_CORR), "corrected_data", "scan", "chan")


@query(f"{_VIS}{_RESID} {_sql_sums('corrected_residual', [_sql_corrected(0, 'r'), _sql_corrected(1, 'r')], 'r', 'scan, chan')}")
def corrected_residual(spark, sf_dir):
    rows = apply.corrected(_resid_rows(spark, sf_dir), [TERM], N_CORR, "residual", "corrected_residual")
    return _sums(rows, "corrected_residual", "scan", "chan")


@query(f"""{_VIS}{_GAINS} SELECT scan, chan, round(sum((p0r*p0r+p0i*p0i)*(q0r*q0r+q0i*q0i)*w0), 4) AS w0, round(sum((p1r*p1r+p1i*p1i)*(q1r*q1r+q1i*q1i)*w1), 4) AS w1 FROM g GROUP BY scan, chan""")
def corrected_weight(spark, sf_dir):
    rows = apply.corrected_weight(_applied(spark, sf_dir), [TERM], N_CORR)
    return rows.groupBy("scan", "chan").agg(*[_r(F.sum(F.col("corrected_weight")[k]), 4).alias(f"w{k}") for k in range(2)])


@query(f"{_VIS} {_sql_sums('model_data', [('m0r + n0r', 'm0i + n0i'), ('m1r + n1r', 'm1i + n1i')], 'vis', 'scan, chan')}")
def summed_model(spark, sf_dir):
    return _sums(apply.summed_model(visibilities(spark, sf_dir), N_CORR, 2), "model_data", "scan", "chan")


def _sql_equations() -> str:
    rows = []
    for ant, first, second, sign in (("ant1", "p", "q", ""), ("ant2", "q", "p", "-")):
        cells = []
        for k in range(2):
            v = _mul(_mul(_z(f"p{k}"), _z(f"m{k}")), _z(f"q{k}"), True)
            m = (f"m{k}r", f"{sign}(m{k}i)")
            h = _mul(m, _z(f"{second}{k}"), True)
            r = (f"(d{k}r - {v[0]})", f"{sign}(d{k}i - {v[1]})")
            top = _mul(r, h, True)
            cells += [f"{top[0]} * w{k} AS re{k}", f"{top[1]} * w{k} AS im{k}", f"({h[0]} * {h[0]} + {h[1]} * {h[1]}) * w{k} AS jhj{k}"]
        rows.append(f"SELECT {_KEYS}, t_bin, f_bin, {ant} AS ant, {', '.join(cells)} FROM g WHERE bad = 0")
    return f", e AS ({' UNION ALL '.join(rows)}), n AS (SELECT {_KEYS}, t_bin, f_bin, ant, {', '.join(f'sum({n}{k}) AS {n}{k}' for k in range(2) for n in ('re', 'im', 'jhj'))} FROM e GROUP BY ALL)"


_EQUATIONS = f"{_VIS}{_GAINS}{_sql_equations()}"
_CAST = ", ".join(f"CAST({k} AS INTEGER) AS {k}" for k in (*CHUNK, "t_bin", "f_bin", "ant"))


@query(f"{_EQUATIONS} SELECT {_CAST}, {', '.join(f'round({n}{k}, 4) AS {n}{k}' for k in range(2) for n in ('re', 'im', 'jhj'))} FROM n")
def normal_equations(spark, sf_dir):
    found = apply.normal_equations(_applied(spark, sf_dir), [TERM], 0, N_CORR)
    names = [f"{n}{k}" for k in range(N_CORR) for n in ("re", "im", "jhj")]
    return found.select(*CHUNK, "t_bin", "f_bin", "ant", *[_r(F.col(n), 4).alias(n) for n in names])


@query(f"""{_EQUATIONS} SELECT {_CAST}, round(1 + 0.01 * ant + 0.5 * re0 / jhj0, 6) AS g0re, round(0.02 * t_bin + 0.5 * im0 / jhj0, 6) AS g0im,
  round(0.9 + 0.5 * re1 / jhj1, 6) AS g1re, round(0.01 * ant + 0.001 * f_bin + 0.5 * im1 / jhj1, 6) AS g1im FROM n WHERE jhj0 > 1e-12 AND jhj1 > 1e-12""")
def gauss_newton_step(spark, sf_dir):
    equations = apply.normal_equations(_applied(spark, sf_dir), [TERM], 0, N_CORR)
    found = solver.gauss_newton_step(equations, _all_gains(spark, sf_dir), "G", N_CORR).where("solved")
    return found.select(*CHUNK, "t_bin", "f_bin", "ant", *[_r(c).alias(n) for c, n in zip([F.col("g")[k][p] for k in range(2) for p in ("re", "im")], ("g0re", "g0im", "g1re", "g1im"), strict=True)])


_LONG = f"""{_VIS}{_RESID}, l AS (
  SELECT {_KEYS}, ant1, ant2, 0 AS corr, sqrt(w0) * r0r AS re, sqrt(w0) * r0i AS im FROM r WHERE bad <> 1
  UNION ALL SELECT {_KEYS}, ant1, ant2, 1, sqrt(w1) * r1r, sqrt(w1) * r1i FROM r WHERE bad <> 1
), bm AS (SELECT {_KEYS}, ant1, ant2, corr, median(re) AS re_med, median(im) AS im_med FROM l GROUP BY ALL),
b AS (SELECT {_KEYS}, ant1, ant2, corr, any_value(re_med) AS re_med, any_value(im_med) AS im_med, median(abs(re - re_med)) AS re_mad, median(abs(im - im_med)) AS im_mad FROM l JOIN bm USING ({_KEYS}, ant1, ant2, corr) GROUP BY {_KEYS}, ant1, ant2, corr),
cm AS (SELECT {_KEYS}, corr, median(re) AS re_med, median(im) AS im_med FROM l GROUP BY ALL),
c AS (SELECT {_KEYS}, corr, any_value(re_med) AS re_med, any_value(im_med) AS im_med, median(abs(re - re_med)) AS re_mad, median(abs(im - im_med)) AS im_mad FROM l JOIN cm USING ({_KEYS}, corr) GROUP BY {_KEYS}, corr),
s AS (SELECT {_KEYS}, corr, avg(1.4826 * re_mad) FILTER (re_mad > 0) AS re_mean, avg(1.4826 * im_mad) FILTER (im_mad > 0) AS im_mean, stddev_pop(1.4826 * re_mad) FILTER (re_mad > 0) AS re_std, stddev_pop(1.4826 * im_mad) FILTER (im_mad > 0) AS im_std FROM b GROUP BY ALL)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("re_med", "im_med", "re_mad", "im_mad"))
_CHUNK_CAST = ", ".join(f"CAST({k} AS INTEGER) AS {k}" for k in CHUNK)


def _long(spark, sf_dir) -> DataFrame:
    return flagging.long_residuals(flagging.whitened(_resid_rows(spark, sf_dir), N_CORR), CHUNK, range(N_CORR))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_r(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


_MAD = ("re_med", "im_med", "re_mad", "im_mad")


@query(f"{_LONG} SELECT {_CHUNK_CAST}, ant1, ant2, corr, {_ROUNDED} FROM b")
def mad_of_baselines(spark, sf_dir):
    return _rounded(flagging.mad_and_median(_long(spark, sf_dir), [*CHUNK, "ant1", "ant2", "corr"]), *_MAD)


@query(f"{_LONG} SELECT {_CHUNK_CAST}, corr, {_ROUNDED} FROM c")
def mad_of_chunks(spark, sf_dir):
    return _rounded(flagging.chunk_mad_and_median(_long(spark, sf_dir), [*CHUNK, "corr"]), *_MAD)


@query(f"{_LONG} SELECT {_CHUNK_CAST}, corr, round(re_mean, 6) AS re_mean, round(im_mean, 6) AS im_mean, round(re_std, 6) AS re_std, round(im_std, 6) AS im_std FROM s")
def mad_spread(spark, sf_dir):
    found = flagging.baseline_spread(flagging.mad_and_median(_long(spark, sf_dir), [*CHUNK, "ant1", "ant2", "corr"]), CHUNK)
    return _rounded(found, "re_mean", "im_mean", "re_std", "im_std")


def _sql_mad() -> str:
    tests = []
    for k in range(2):
        wr, wi = f"(sqrt(w{k}) * r{k}r)", f"(sqrt(w{k}) * r{k}i)"
        away = lambda t: f"(({wr} - {t}.re_med)**2 + {wi}**2) / (1.4826 * {t}.re_mad)**2 + (({wr} - {t}.im_med)**2 + {wi}**2) / (1.4826 * {t}.im_mad)**2"  # noqa: B023, E731
        dev = f"((1.4826 * b{k}.re_mad - s{k}.re_mean) / nullif(s{k}.re_std, 0))**2 + ((1.4826 * b{k}.im_mad - s{k}.im_mean) / nullif(s{k}.im_std, 0))**2 > 16"
        empty = lambda t: f"coalesce({t}.re_mad, 0) = 0 OR coalesce({t}.im_mad, 0) = 0"
        tests.append(f"CASE WHEN {empty(f'c{k}')} THEN true WHEN ant1 = ant2 THEN false WHEN {empty(f'b{k}')} OR coalesce({dev}, false) THEN true ELSE {away(f'b{k}')} > 36 OR {away(f'c{k}')} > 49 END")
    joins = " ".join(
        f"LEFT JOIN b b{k} ON {' AND '.join(f'r.{c} = b{k}.{c}' for c in (*CHUNK, 'ant1', 'ant2'))} AND b{k}.corr = {k} "
        f"LEFT JOIN c c{k} ON {' AND '.join(f'r.{c} = c{k}.{c}' for c in CHUNK)} AND c{k}.corr = {k} "
        f"LEFT JOIN s s{k} ON {' AND '.join(f'r.{c} = s{k}.{c}' for c in CHUNK)} AND s{k}.corr = {k}"
        for k in range(2)
    )
    inner = " OR ".join(f"({t})" for t in tests).replace("ant1", "r.ant1").replace("ant2", "r.ant2")
    return f"{_LONG}, t AS (SELECT r.scan, r.chan, r.bad, {inner} AS hit FROM r {joins}) SELECT scan, chan, count(*) FILTER (hit OR bad = 1) AS flagged, count(*) FILTER (hit AND bad <> 1) AS new, count(*) AS n FROM t GROUP BY scan, chan"


@query(_sql_mad())
def mad_flags(spark, sf_dir):
    rows = flagging.whitened(_resid_rows(spark, sf_dir), N_CORR).withColumn("before", F.col("flag"))
    rows = flagging.mad_flags(rows, N_CORR, 6.0, 7.0, 4.0)
    hit = F.col("flag") == 1
    return rows.groupBy("scan", "chan").agg(F.count_if(hit).alias("flagged"), F.count_if(hit & (F.col("before") != 1)).alias("new"), F.count("*").alias("n"))


@query(f"""{_VIS}, a AS (SELECT {_KEYS}, t_bin, f_bin, unnest([ant1, ant2]) AS ant, bad FROM vis) SELECT {_CAST}, CAST(min(bad) AS INTEGER) AS gain_flag, 0 AS dir FROM a GROUP BY {_KEYS}, t_bin, f_bin, ant""")
def initial_gain_flags(spark, sf_dir):
    found = apply.initial_gain_flags(chunked(spark, sf_dir), TERM)
    return found.select(*CHUNK, "t_bin", "f_bin", "ant", F.col("gain_flag").cast("int").alias("gain_flag"), "dir")


@query(f"{_VIS} SELECT scan, count(*) FILTER (bad = 1 OR (ant1 + t_bin) % 11 = 0 OR (ant2 + t_bin) % 11 = 0) AS flagged, count(*) AS n FROM vis GROUP BY scan")
def gain_flags_to_data(spark, sf_dir):
    vis = chunked(spark, sf_dir)
    rows = apply.flags_from_gains(vis, gains_of(vis), TERM)
    return rows.groupBy("scan").agg(F.count_if(F.col("flag") == 1).alias("flagged"), F.count("*").alias("n"))


@query(f"""{_VIS}, d AS (SELECT DISTINCT {_KEYS}, t_bin, f_bin, time, chan FROM vis), a AS (SELECT *, unnest(range(14)) AS ant FROM d)
  SELECT {_CHUNK_CAST}, time, chan, CAST(ant AS INTEGER) AS ant, 'G-net' AS term, CAST((ant + t_bin) % 11 = 0 AS INTEGER) AS gain_flag,
  round(CASE WHEN (ant + t_bin) % 11 = 0 THEN 1 ELSE 1 + 0.01 * ant END, 6) AS g0re, round(CASE WHEN (ant + t_bin) % 11 = 0 THEN 0 ELSE 0.02 * t_bin END, 6) AS g0im FROM a""")
def net_gains(spark, sf_dir):
    vis = chunked(spark, sf_dir)
    grid = vis.select(*CHUNK, TERM.t_bin, TERM.f_bin, "time", "chan").distinct()
    net = apply.net_gains(gains_of(vis), grid, [TERM], N_CORR)
    return net.select(*CHUNK, "time", "chan", "ant", "term", F.col("gain_flag").cast("int").alias("gain_flag"), _r(F.col("g")[0]["re"]).alias("g0re"), _r(F.col("g")[0]["im"]).alias("g0im"))


@query(f"""{_VIS}, d AS (SELECT DISTINCT {_KEYS}, t_bin, f_bin FROM vis), a AS (SELECT *, unnest(range(14)) AS ant FROM d)
  SELECT {_CHUNK_CAST}, CAST(ant AS INTEGER) AS ant, CAST(max(CASE WHEN (ant + t_bin) % 11 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS any_flag, CAST(min(CASE WHEN (ant + t_bin) % 11 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS all_flag FROM a GROUP BY {_KEYS}, ant""")
def gain_and_param_flags(spark, sf_dir):
    """Flags of gains joined by or, and of a parameter over a whole chunk, set where all its gains' are."""
    gains = gains_of(chunked(spark, sf_dir))
    any_ = apply.combine_gain_flags(gains, CHUNK).select(*CHUNK, "ant", F.col("gain_flag").cast("int").alias("any_flag"))
    all_ = apply.param_flags(gains, CHUNK, ()).select(*CHUNK, "ant", F.col("param_flag").cast("int").alias("all_flag"))
    return any_.join(all_, [*CHUNK, "ant"])


def _sql_baseline() -> str:
    cells = []
    for k in range(2):
        v = [_corrupted(k, m) for m in "mn"]
        v = (f"({v[0][0]} + {v[1][0]})", f"({v[0][1]} + {v[1][1]})")
        top = _mul(_z(f"d{k}"), v, True)
        cells += [f"sum({top[0]} * w{k}) FILTER (bad = 0) AS re{k}", f"sum({top[1]} * w{k}) FILTER (bad = 0) AS im{k}", f"sum(({v[0]} * {v[0]} + {v[1]} * {v[1]}) * w{k}) FILTER (bad = 0) AS size{k}"]
    return f"{_VIS}{_GAINS}, bl AS (SELECT {_KEYS}, ant1, ant2, chan, {', '.join(cells)} FROM g GROUP BY ALL), co AS (SELECT *, " + ", ".join(
        f"CASE WHEN size{k} > 0 THEN {p}{k} / size{k} ELSE {int(p == 're')} END AS c{k}{p[0]}" for k in range(2) for p in ("re", "im")
    ) + " FROM bl)"


@query(f"{_sql_baseline()} SELECT {_CHUNK_CAST}, ant1, ant2, chan, round(c0r, 6) AS bl_correction0re, round(c0i, 6) AS bl_correction0im, round(c1r, 6) AS bl_correction1re, round(c1i, 6) AS bl_correction1im FROM co")
def baseline_corrections(spark, sf_dir):
    found = apply.baseline_corrections(_applied(spark, sf_dir), [TERM], N_CORR, 2)
    return found.select(*CHUNK, "ant1", "ant2", "chan", *[_r(F.col("bl_correction")[k][p]).alias(f"bl_correction{k}{p}") for k in range(2) for p in ("re", "im")])


@query(f"""{_sql_baseline()}, x AS (SELECT vis.*, c0r, c0i, c1r, c1i FROM vis JOIN co USING ({_KEYS}, ant1, ant2, chan))
  SELECT scan, count(*) AS n, round(sum(CASE WHEN c0r = 0 AND c0i = 0 THEN d0r ELSE (d0r * c0r + d0i * c0i) / (c0r * c0r + c0i * c0i) END), 2) AS re0 FROM x GROUP BY scan""")
def apply_baseline_corrections(spark, sf_dir):
    rows = _applied(spark, sf_dir)
    found = apply.baseline_corrections(rows, [TERM], N_CORR, 2)
    out = apply.apply_baseline_corrections(rows, found, N_CORR, "data")
    return out.groupBy("scan").agg(F.count("*").alias("n"), _r(F.sum(F.col("data")[0]["re"]), 2).alias("re0"))


@query("SELECT CAST(l_orderkey // 5000 AS INTEGER) AS scan, count(DISTINCT l_orderkey) AS rows, count(DISTINCT l_orderkey // 50) AS times, count(DISTINCT l_linenumber) AS chans, 2 AS corrs FROM lineitem GROUP BY ALL")
def dimension_summary(spark, sf_dir):
    return stats.dimension_summary(visibilities(spark, sf_dir), ("scan",))


@query(f"""{_VIS} SELECT coalesce(scan, -1) AS scan, coalesce(field, -1) AS field, coalesce(ddid, -1) AS ddid, grouping(scan) = 1 AS is_total, round(100.0 * sum(CAST(f0 AS INTEGER) + CAST(f1 AS INTEGER)) / (2 * count(*)), 6) AS percent FROM vis GROUP BY GROUPING SETS ((scan, field, ddid), ())""")
def flag_summary(spark, sf_dir):
    return _rounded(stats.flag_summary(visibilities(spark, sf_dir)), "percent").fillna(-1, list(KEYS))


@query(f"{_VIS} SELECT scan, field, ddid, row_id, bool_and(bad = 1) AS flag_row FROM vis GROUP BY scan, field, ddid, row_id")
def row_flags(spark, sf_dir):
    vis = preprocess.preprocess(visibilities(spark, sf_dir), N_CORR, "weight")
    return preprocess.row_flags(preprocess.final_flags(vis, N_CORR))


@query("SELECT l_linenumber - 1 AS chan, round(sum(l_extendedprice / 10000), 4) AS first, 0.0 AS middle, round(sum(l_quantity / 10), 4) AS last, count(*) FILTER (l_returnflag = 'R' OR l_quantity = 7) AS flagged FROM lineitem GROUP BY ALL")
def expand_correlations(spark, sf_dir):
    """Two selected correlations back in the first and last of four."""
    vis = visibilities(spark, sf_dir)
    vis = vis.withColumns({"data": preprocess.expand_correlations(F.col("data"), (0, 3), 4, Cx.lit(0).column()), "flag": preprocess.expand_flags(F.col("flag"), 4)})
    sums = [_r(F.sum(F.col("data")[k]["re"]), 4).alias(n) for k, n in ((0, "first"), (1, "middle"), (3, "last"))]
    return vis.groupBy("chan").agg(*sums, F.count_if(F.col("flag")[2]).alias("flagged"))


@query("SELECT o_orderkey, o_totalprice AS value FROM orders")
def backup_restore(spark, sf_dir):
    """A column replaced and taken back from a copy."""
    orders = table(spark, sf_dir, "orders").select(F.lit(0).alias("scan"), F.lit(0).alias("field"), F.lit(0).alias("ddid"), F.col("o_orderkey").alias("row_id"), F.lit(0).alias("chan"), F.col("o_totalprice").alias("data"))
    from ..sources.tables import restore

    stored = orders.select(*KEYS, "row_id", "chan", F.col("data").alias("value"))
    back = restore(orders.withColumn("data", F.lit(0.0)), stored, "data")
    return back.select(F.col("row_id").alias("o_orderkey"), F.col("data").alias("value"))


@query(f"""{_VIS} SELECT chan * 2 + k AS chan, round(sum(w0 / 2), 4) AS w0, count(*) AS n FROM vis, (SELECT unnest(range(2)) AS k) GROUP BY ALL""")
def bda_upsample_channels(spark, sf_dir):
    rows = bda.upsample_channels(visibilities(spark, sf_dir), F.lit(2))
    return rows.groupBy(F.col("chan").cast("long").alias("chan")).agg(_r(F.sum(F.col("weight")[0]), 4).alias("w0"), F.count("*").alias("n"))


@query(f"{_VIS} SELECT time - 4 + (k + 0.5) * 2 AS time, round(sum(0.25), 4) AS row_weight, count(*) AS n FROM vis, (SELECT unnest(range(4)) AS k) GROUP BY ALL")
def bda_upsample_times(spark, sf_dir):
    rows = bda.upsample_times(visibilities(spark, sf_dir), 2.0)
    return rows.groupBy("time").agg(_r(F.sum("row_weight"), 4).alias("row_weight"), F.count("*").alias("n"))


@query(f"{_VIS} SELECT scan, ant1, ant2, CAST(chan // 3 AS INTEGER) AS chan, round(avg(d0r), 6) AS data0re, round(avg(d0i), 6) AS data0im, round(sum(w0), 6) AS w0, bool_or(f0) AS f0 FROM vis GROUP BY scan, ant1, ant2, chan // 3")
def bda_downsample(spark, sf_dir):
    rows = bda.downsample(visibilities(spark, sf_dir), N_CORR, F.lit(3), ("scan", "ant1", "ant2"))
    return rows.select("scan", "ant1", "ant2", "chan", *[_r(F.col("data")[0][p]).alias(f"data0{p}") for p in ("re", "im")], _r(F.col("weight")[0]).alias("w0"), F.col("flag")[0].alias("f0"))


_POINTS = """SELECT user_id % 5 AS k, event_id AS x, CASE WHEN event_id % 10 = 0 THEN value END AS y FROM events"""


@query(f"""WITH p AS ({_POINTS}), q AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER w AS xa, last_value(y IGNORE NULLS) OVER w AS ya,
  first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER v AS xb, first_value(y IGNORE NULLS) OVER v AS yb FROM p
  WINDOW w AS (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT k, x, round(CASE WHEN xa IS NULL THEN yb WHEN xb IS NULL OR xa = xb THEN ya ELSE ya + (yb - ya) / (xb - xa) * (x - xa) END, 6) AS y FROM q WHERE y IS NULL""")
def linear_lookup(spark, sf_dir):
    """Values between, before and after the tenth events of five series."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("k"), F.col("event_id").alias("x"), F.col("value").alias("y"))
    known, wanted = e.where("x % 10 = 0 AND y IS NOT NULL"), e.where("x % 10 <> 0 OR y IS NULL").select("k", "x")
    return _rounded(interpolation.linear_lookup(known, wanted, ["k"]), "y")


@query(f"""{_VIS}, t AS (SELECT DISTINCT scan, field, ddid, time FROM v0), a AS (SELECT *, unnest(range(3)) AS ant FROM t), b AS (
  SELECT *, CAST(5e6 + ant * 1000.0 AS DOUBLE) AS x, CAST(1e6 + ant * 500.0 AS DOUBLE) AS y, CAST(-3e6 AS DOUBLE) AS z, 0.5 + field * 0.25 AS ra, -0.6 + field * 0.1 AS dec, (time / 86400.0 - 51544.5) AS days FROM a),
  c AS (SELECT *, days / 36525.0 AS t, 0.7790572732640 + 1.00273781191135448 * days AS turns, sqrt(x * x + y * y) AS p, atan2(z * 6378137.0, sqrt(x * x + y * y) * (6378137.0 * (1 - 1 / 298.257223563))) AS theta,
    1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2, 6378137.0 * (1 - 1 / 298.257223563) AS minor FROM b),
  d AS (SELECT *, 2 * pi() * (turns - floor(turns)) + (0.014506 + 4612.15739966 * t + 1.39667721 * t * t) / 3600 * pi() / 180 + atan2(y, x) - ra AS hour,
    atan2(z + e2 / (1 - e2) * minor * pow(sin(theta), 3), p - e2 * 6378137.0 * pow(cos(theta), 3)) AS lat FROM c)
  SELECT scan, time, CAST(ant AS INTEGER) AS ant, round(atan2(sin(hour), cos(dec) * tan(lat) - sin(dec) * cos(hour)), 6) AS angle0 FROM d""")
def parallactic_angles(spark, sf_dir):
    ants = spark.range(3).select(F.col("id").cast("int").alias("ant"), (5e6 + F.col("id") * 1000.0).alias("x"), (1e6 + F.col("id") * 500.0).alias("y"), F.lit(-3e6).alias("z"))
    fields = spark.range(2).select(F.col("id").cast("int").alias("field"), (0.5 + F.col("id") * 0.25).alias("phase_ra"), (-0.6 + F.col("id") * 0.1).alias("phase_dec"))
    times = binning.distinct_times(visibilities(spark, sf_dir))
    return _rounded(angles.parallactic_angles(times, ants, fields).select("scan", "time", "ant", "angle0"), "angle0")


_PREDICT = """, src AS (SELECT * FROM (VALUES (0, 1.0, 0.1, 0.501, -0.599, 0.0), (0, 0.5, 0.0, 0.498, -0.602, -0.7), (1, 2.0, 0.2, 0.5, -0.6, 0.0)) t(cluster, i, q, ra, dec, spi)),
k AS (SELECT scan, chan, cluster, i, q, CASE WHEN spi = 0 THEN 1 ELSE pow(freq / 1e9, spi) END AS s,
  2 * pi() * freq / 299792458.0 * (u * cos(dec) * sin(ra - 0.5) + v * (sin(dec) * cos(-0.6) - cos(dec) * sin(-0.6) * cos(ra - 0.5))
    + w * (sqrt(greatest(1 - pow(cos(dec) * sin(ra - 0.5), 2) - pow(sin(dec) * cos(-0.6) - cos(dec) * sin(-0.6) * cos(ra - 0.5), 2), 0)) - 1)) AS a FROM vis, src)"""


@query(f"""{_VIS}{_PREDICT} SELECT scan, chan, round(sum(CASE WHEN cluster = 0 THEN (i + q) * s * cos(a) END), 3) AS c0re, round(sum(CASE WHEN cluster = 0 THEN (i + q) * s * sin(a) END), 3) AS c0im,
  round(sum(CASE WHEN cluster = 1 THEN (i - q) * s * cos(a) END), 3) AS c1re FROM k GROUP BY scan, chan""")
def predict(spark, sf_dir):
    """Two clusters of point sources, summed over the rows of a scan and channel."""
    rows = [("m", str(c), "point", ra, dec, i, q, 0.0, 0.0, spi, 1e9, 0.0, 0.0, 0.0) for c, i, q, ra, dec, spi in ((0, 1.0, 0.1, 0.501, -0.599, 0.0), (0, 0.5, 0.0, 0.498, -0.602, -0.7), (1, 2.0, 0.2, 0.5, -0.6, 0.0))]
    from .schemas import SOURCES

    sources = spark.createDataFrame(rows, SOURCES)
    fields = spark.range(2).select(F.col("id").cast("int").alias("field"), F.lit(0.5).alias("phase_ra"), F.lit(-0.6).alias("phase_dec"))
    sky = model.with_sky(visibilities(spark, sf_dir).select("scan", "field", "chan", "freq", "u", "v", "w"), sources, fields, N_CORR)
    one = lambda d, k, p: _r(F.sum(F.col("sky")[d][k][p]), 3)
    return sky.groupBy("scan", "chan").agg(one(0, 0, "re").alias("c0re"), one(0, 0, "im").alias("c0im"), one(1, 1, "re").alias("c1re"))


@query("""SELECT l_linenumber - 1 AS chan, round(sum(sqrt((l_quantity / 10) ** 2 + (l_tax * 10) ** 2)), 4) AS amplitude, round(sum(cos(atan2(l_tax * 10, l_quantity / 10))), 4) AS cos, round(sum(sin(atan2(l_tax * 10, l_quantity / 10))), 4) AS sin FROM lineitem GROUP BY ALL""")
def gains_to_real(spark, sf_dir):
    parts = to_interpolable(Cx.of(F.col("data")[1]))
    return visibilities(spark, sf_dir).groupBy("chan").agg(*[_r(F.sum(c), 4).alias(n) for n, c in parts.items()])


@query(f"""{_VIS}{_RESID}, m AS (SELECT {_KEYS}, avg(w0) FILTER (bad = 0) AS i0, avg(w1) FILTER (bad = 0) AS i1 FROM r GROUP BY ALL),
  e AS (SELECT r.*, CASE WHEN bad = 0 THEN 7.0 / (5.0 + (r0r*r0r + r0i*r0i) * i0 + (r1r*r1r + r1i*r1i) * i1) ELSE 0 END AS eta FROM r JOIN m USING ({_KEYS}))
  SELECT {_CHUNK_CAST}, round(count(*) FILTER (bad = 0) / sum(eta * (r0r*r0r + r0i*r0i)) FILTER (bad = 0), 6) AS icov0, round(count(*) FILTER (bad = 0) / sum(eta * (r1r*r1r + r1i*r1i)) FILTER (bad = 0), 6) AS icov1,
  round(avg(ln(eta) - eta) FILTER (bad = 0 AND eta > 0), 6) AS log_eta FROM e GROUP BY {_KEYS}""")
def robust_statistics(spark, sf_dir):
    """The mean weights, first etas, inverse covariances and the constant for the degrees of freedom."""
    rows = _resid_rows(spark, sf_dir)
    first = weights.eta(rows.join(weights.mean_weight(rows, N_CORR).withColumn("dof", F.lit(weights.START_DOF)), list(CHUNK)), N_CORR)
    found = weights.inverse_covariance(first, N_CORR)
    return found.select(*CHUNK, _r(F.col("icov")[0]).alias("icov0"), _r(F.col("icov")[1]).alias("icov1"), _r(F.col("log_eta")).alias("log_eta"))


@query()
def robust_weights(spark, sf_dir):
    rows = weights.robust_weights(_resid_rows(spark, sf_dir), N_CORR)
    return rows.groupBy(*CHUNK).agg(F.avg(F.col("weight")[0]).alias("w0"), F.avg(F.col("weight")[1]).alias("w1"))


@query("SELECT l_suppkey % 97 AS idx, round(sum(l_quantity), 4) AS total, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL")
def grouped_sums(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 97).alias("idx"), "l_quantity")
    return _rounded(binning.grouped_sums(rows, "idx", "l_quantity"), "total", "mean")


@query("""WITH t AS (SELECT DISTINCT user_id AS k, floor(event_id * 2) / 100 AS x FROM events), s AS (SELECT k, x, lag(x) OVER (PARTITION BY k ORDER BY x) AS b FROM t)
  SELECT k, round(sum(CASE WHEN abs(x - b) < 0.05 THEN b ELSE x END), 4) AS total, count(*) AS n FROM s GROUP BY k""")
def snapped_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.floor(F.col("event_id") * 2) / 100).alias("x"))
    lists = e.groupBy("k").agg(F.sort_array(F.collect_set("x")).alias("x"))
    rows = lists.select("k", F.explode(binning.snapped_times(F.col("x"))).alias("x"))
    return rows.groupBy("k").agg(_r(F.sum("x"), 4).alias("total"), F.count("*").alias("n"))


@query(f"{_VIS} SELECT ant1, ant2, CAST(floor(ant1 * (2 * 14 - ant1 - 1) / 2) + ant2 AS INTEGER) AS bl, count(*) AS n FROM vis GROUP BY ALL")
def baseline_ids(spark, sf_dir):
    vis = visibilities(spark, sf_dir)
    return vis.groupBy("ant1", "ant2", baseline_id(F.col("ant1"), F.col("ant2"), N_ANT).alias("bl")).agg(F.count("*").alias("n"))


@query(f"""{_VIS}, x AS (SELECT scan, chan, d0r, d0i, d1r, d1i, 0.01 * ant1 + 0.000125 * time AS a, 0.01 * ant2 + 0.000125 * time AS b FROM vis)
  SELECT scan, chan, round(sum((cos(a) * d0r + sin(a) * d1r) * cos(b) + (cos(a) * d1r + sin(a) * d0r) * sin(b)), 4) AS re0,
  round(sum((cos(a) * d0i + sin(a) * d1i) * cos(b) + (cos(a) * d1i + sin(a) * d0i) * sin(b)), 4) AS im0 FROM x GROUP BY scan, chan""")
def feed_rotation(spark, sf_dir):
    """R x R^H of linear feeds, with angles that grow with antenna and time."""
    vis = visibilities(spark, sf_dir)
    times = binning.distinct_times(vis).select(*KEYS, "time", F.explode(F.sequence(F.lit(0), F.lit(N_ANT - 1))).alias("ant"))
    angle = 0.01 * F.col("ant") + 0.000125 * F.col("time")
    turns = times.select("*", angle.alias("angle0"), angle.alias("angle1"))
    d = F.col("data")
    out = angles.apply_rotation(vis.withColumn("data", F.array(d[0], d[1], d[1], d[0])), turns, ["data"], False)
    return out.groupBy("scan", "chan").agg(*[_r(F.sum(F.col("data")[0][p]), 4).alias(f"{p}0") for p in ("re", "im")])


@query(f"{_VIS}{_RESID} {_sql_sums('wres', [('sqrt(w0) * r0r', 'sqrt(w0) * r0i'), ('sqrt(w1) * r1r', 'sqrt(w1) * r1i')], 'r', 'scan, chan')}")
def whitened_residual(spark, sf_dir):
    return _sums(flagging.whitened(_resid_rows(spark, sf_dir), N_CORR), "wres", "scan", "chan")


@query(f"""{_VIS}, d AS (SELECT DISTINCT {_KEYS}, t_bin, f_bin FROM vis), a AS (SELECT *, unnest(range(14)) AS ant FROM d)
  SELECT scan, CAST(ant AS INTEGER) AS ant, round(sum(CASE WHEN (ant + t_bin) % 11 = 0 THEN 1 ELSE 1 + 0.01 * ant END), 5) AS re0,
  round(sum(CASE WHEN (ant + t_bin) % 11 = 0 THEN 0 ELSE 0.01 * ant + 0.001 * f_bin END), 5) AS im1 FROM a GROUP BY scan, ant""")
def flagged_gains_to_identity(spark, sf_dir):
    gains = apply.identity_where_flagged(gains_of(chunked(spark, sf_dir)), N_CORR)
    return gains.groupBy("scan", "ant").agg(_r(F.sum(F.col("g")[0]["re"]), 5).alias("re0"), _r(F.sum(F.col("g")[1]["im"]), 5).alias("im1"))


@query(f"""{_VIS} SELECT chan, CASE field WHEN 0 THEN 'calibrator' ELSE 'UNKNOWN' END AS field_name, 1e9 + chan * 1e6 AS freq, 1e9 AS min_freq, 1.006e9 AS max_freq, count(*) AS n FROM vis GROUP BY ALL""")
def sub_table_joins(spark, sf_dir):
    """Channels, the band's ends and field names from sub-tables; one field has no row."""
    from ..sources.tables import with_axes
    from .schemas import SUB_TABLES

    rows = {"SPECTRAL_WINDOW": [(0, [1e9 + c * 1e6 for c in range(7)], [1e6] * 7, 1e9, 7e6)], "DATA_DESCRIPTION": [(0, 0, 0)], "FIELD": [(0, "calibrator", 0, 0.5, -0.5)]}
    tables = {n: spark.createDataFrame(r, SUB_TABLES[n]) for n, r in rows.items()}
    out = with_axes(visibilities(spark, sf_dir), tables)
    return out.groupBy("chan", "field_name", "freq", "min_freq", "max_freq").agg(F.count("*").alias("n"))


@query(f"""{_VIS}, d AS (SELECT DISTINCT {_KEYS}, t_bin, f_bin FROM vis), a AS (SELECT *, unnest(range(14)) AS ant FROM d)
  SELECT CAST(ant AS INTEGER) AS ant, t_bin, round(avg(CASE WHEN (ant + t_bin) % 11 <> 0 THEN atan2(0.01 * ant + 0.001 * f_bin, 0.9) END), 6) AS value FROM a GROUP BY ant, t_bin""")
def plotted_phases(spark, sf_dir):
    """The phase of the second correlation over time, flagged gains left out, averaged over frequency and chunks."""
    from ..sources.tables import plot_data

    return _rounded(plot_data(gains_of(chunked(spark, sf_dir)), "phase", 1, "t_bin", ("ant",), ("f_bin", *CHUNK, "dir")), "value")


@query("""WITH s AS (SELECT user_id % 50 AS k, event_id, value AS x, event_id % 7 <> 0 AS good, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 50) AS n FROM events),
  t AS (SELECT k, event_id, n, exp(-t * t / 2.0) AS w, i + t AS j FROM s, (SELECT unnest(range(-4, 5)) AS t)),
  m AS (SELECT k, event_id, w, CASE WHEN j < 0 THEN -j - 1 WHEN j >= n THEN 2 * n - 1 - j ELSE j END AS j FROM t)
  SELECT m.k, m.event_id, round(sum(w * s.x) / sum(w), 6) AS smoothed FROM m JOIN s ON m.k = s.k AND m.j = s.i AND s.good GROUP BY m.k, m.event_id""")
def smoothed_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k"), "event_id", F.col("value").alias("x"), (F.col("event_id") % 7 != 0).alias("good"))
    return interpolation.smooth(e, ["k"], "event_id", "x", "good").select("k", "event_id", _r(F.col("smoothed")).alias("smoothed"))


QUERIES |= planted.QUERIES | chains.QUERIES | stored.QUERIES
ORACLE_SQL |= planted.ORACLE_SQL | {name: _shifted(sql) for name, sql in (chains.ORACLE_SQL | stored.sql()).items()}
