"""Queries of four correlations, two terms and two directions, one of the terms direction-dependent, with their SQL.

Gains follow from antenna, interval and direction by formulas, written once as SQL that Spark (to make the table of gains) and DuckDB
(which puts them in place of the joins) both understand. The SQL spells out each product as a step of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones
from ..operators import apply, binning, preprocess, stats
from .schemas import CHUNK, KEYS

N_CORR, N_DIR, N_ANT = 4, 2, 14
TIME_CHUNK, FREQ_CHUNK = 40, 4
BINS = {"G": (5, 2), "D": (8, 3)}
TERMS = [apply.Term("G"), apply.Term("D", True)]
FORMULAS = {
    "G": ("1 + 0.01 * ant", "0.02 * t_bin", "0.05", "0.01 * ant", "-0.02 * f_bin", "0.03", "0.9", "0.01 * ant + 0.001 * f_bin"),
    "D": ("1 + 0.01 * dir", "0.02 * t_bin", "0.02", "0.001 * ant * dir", "0.002 * ant", "-0.03", "0.8 + 0.1 * dir", "0.01 * f_bin"),
}
_DATA = ("l_extendedprice / 10000", "l_discount * 10", "l_quantity / 20", "0.1", "l_tax * 10", "-0.2", "l_quantity / 10", "l_tax * 10")
_MODELS = (("l_quantity / 10", "0", "0.1", "l_tax", "0.1", "-l_tax", "1", "0.5"), ("l_discount", "0.25", "0", "0.1", "l_discount", "0", "0.5", "0"))
_WEIGHTS = ("1 / (0.01 + l_tax)", "1", "0.5", "1 / (1 + l_discount)")

Z = tuple[str, str]
M = list[Z]


def _cells(formulas: tuple[str, ...]) -> Jones:
    c = [F.expr(f"cast({x} as double)") for x in formulas]
    return Jones(tuple(Cx(c[k], c[k + 1]) for k in range(0, len(c), 2)))


def _bins(spark: SparkSession, vis: DataFrame) -> tuple[DataFrame, DataFrame]:
    times = binning.time_chunks(binning.distinct_times(vis), TIME_CHUNK)
    chans = spark.range(7).select(F.lit(0).alias("ddid"), F.col("id").cast("int").alias("chan"), (1e9 + F.col("id") * 1e6).alias("freq"), F.lit(1e6).alias("width"))
    chans = binning.freq_chunks(chans, FREQ_CHUNK)
    for term in TERMS:
        times = binning.time_bins(times, BINS[term.name][0], term.t_bin)
        chans = binning.freq_bins(chans, BINS[term.name][1], term.f_bin)
    return times, chans


def visibilities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows with chunks and bins, and the gains of both terms on all intervals."""
    c = F.col
    utime, chan = F.floor(c("l_orderkey") / 50).cast("int"), (c("l_linenumber") - 1).cast("int")
    scan = F.floor(utime / 100).cast("int")
    vis = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        scan.alias("scan"), (scan % 2).alias("field"), F.lit(0).alias("ddid"), c("l_orderkey").alias("row_id"), (utime * 8.0).alias("time"),
        F.lit(8.0).alias("interval"), (c("l_partkey") % 7).cast("int").alias("ant1"), (7 + c("l_suppkey") % 7).cast("int").alias("ant2"),
        F.lit(1.0).alias("u"), F.lit(1.0).alias("v"), F.lit(0.0).alias("w"), chan.alias("chan"), _cells(_DATA).column().alias("data"),
        F.array(*[_cells(m).column() for m in _MODELS]).alias("model"), F.array(*[F.expr(f"cast({w} as double)") for w in _WEIGHTS]).alias("weight"),
        F.array(*[c("l_quantity") == 7] * 4).alias("flag"), F.lit(False).alias("flag_row"),
    )
    vis = preprocess.preprocess(vis, N_CORR, "weight")
    times, chans = _bins(spark, vis)
    out = binning.attach(vis, times.drop("interval", "n_rows"), [*KEYS, "time"])
    out = binning.attach(out, F.broadcast(chans.drop("freq", "width")), ["ddid", "chan"])  # seven channels
    gains = None
    for term in TERMS:
        own = times.select(*KEYS, "t_chunk", F.col(term.t_bin).alias("t_bin")).distinct().join(chans.select("ddid", "f_chunk", F.col(term.f_bin).alias("f_bin")).distinct(), "ddid")
        own = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_ANT - 1))).alias("ant"))
        own = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_DIR - 1 if term.direction_dependent else 0))).alias("dir"))
        own = own.select(F.lit(term.name).alias("term"), *CHUNK, "t_bin", "f_bin", "ant", "dir", _cells(FORMULAS[term.name]).column().alias("g"), F.expr("cast((ant + t_bin) % 11 = 0 as byte)").alias("gain_flag"))
        gains = own if gains is None else gains.unionByName(own)
    return out, gains


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.attach_gains(*visibilities(spark, sf_dir), TERMS)


class Steps:
    """A chain of SQL steps, each of which adds the cells of a matrix to the rows of the one before."""

    def __init__(self, first: str):
        self.sql, self.at = [first], "s0"

    def put(self, name: str, cells: M) -> M:
        made = ", ".join(f"{x} AS {name}{k}{p}" for k, cell in enumerate(cells) for p, x in zip("ri", cell, strict=True))
        self.sql.append(f"s{len(self.sql)} AS MATERIALIZED (SELECT *, {made} FROM {self.at})")
        self.at = f"s{len(self.sql) - 1}"
        return named(name, len(cells))

    def text(self, select: str) -> str:
        return f"WITH {', '.join(self.sql)} {select.replace('FROM rows', f'FROM {self.at}')}"


def named(name: str, n: int = 4) -> M:
    return [(f"{name}{k}r", f"{name}{k}i") for k in range(n)]


def times_(a: Z, b: Z) -> Z:
    return f"({a[0]} * {b[0]} - {a[1]} * {b[1]})", f"({a[0]} * {b[1]} + {a[1]} * {b[0]})"


def plus(*many: Z) -> Z:
    return "(" + " + ".join(z[0] for z in many) + ")", "(" + " + ".join(z[1] for z in many) + ")"


def dot(a: M, b: M) -> M:
    return [plus(times_(a[2 * r], b[c]), times_(a[2 * r + 1], b[2 + c])) for r in range(2) for c in range(2)]


def herm(a: M) -> M:
    return [(a[k][0], f"(-{a[k][1]})") for k in (0, 2, 1, 3)]


def _first() -> str:
    cells = [f"{x} AS d{k // 2}{'ri'[k % 2]}" for k, x in enumerate(_DATA)]
    cells += [f"{x} AS m{d}_{k // 2}{'ri'[k % 2]}" for d, m in enumerate(_MODELS) for k, x in enumerate(m)]
    cells += [f"{x} AS w{k}" for k, x in enumerate(_WEIGHTS)]
    bins = ", ".join(f"n % {TIME_CHUNK} // {t} AS {name}_t_bin" for name, (t, _) in BINS.items())
    chans = ", ".join(f"chan % {FREQ_CHUNK} // {f} AS {name}_f_bin" for name, (_, f) in BINS.items())
    gains = []
    for term, formulas in FORMULAS.items():
        for side in ("ant1", "ant2"):
            for d in range(N_DIR if term == "D" else 1):
                for k, x in enumerate(formulas):
                    for a, b in (("ant", side), ("t_bin", f"{term}_t_bin"), ("f_bin", f"{term}_f_bin"), ("dir", str(d))):
                        x = x.replace(a, b)
                    gains.append(f"{x} AS {term.lower()}{'p' if side == 'ant1' else 'q'}{d}_{k // 2}{'ri'[k % 2]}")
    return f"""v AS (SELECT CAST(l_orderkey // 5000 AS INTEGER) AS scan, l_orderkey // 50 AS t, CAST(l_linenumber - 1 AS INTEGER) AS chan, l_partkey % 7 AS ant1, 7 + l_suppkey % 7 AS ant2,
      {', '.join(cells)}, l_quantity = 7 AS bad FROM lineitem),
    times AS (SELECT scan, t, dense_rank() OVER (PARTITION BY scan ORDER BY t) - 1 AS n FROM (SELECT DISTINCT scan, t FROM v) AS x),
    b AS (SELECT v.*, n // {TIME_CHUNK} AS t_chunk, chan // {FREQ_CHUNK} AS f_chunk, {bins}, {chans} FROM v JOIN times USING (scan, t)),
    s0 AS (SELECT *, {', '.join(gains)} FROM b)"""


def _corrupted() -> tuple[Steps, M]:
    steps, parts = Steps(_first()), []
    for d in range(N_DIR):
        x = named(f"m{d}_")
        for term, at in (("d", d), ("g", 0)):
            x = steps.put(f"a{term}{d}_", dot(named(f"{term}p{at}_"), x))
            x = steps.put(f"b{term}{d}_", dot(x, herm(named(f"{term}q{at}_"))))
        parts.append(x)
    return steps, steps.put("v", [plus(*cells) for cells in zip(*parts, strict=True)])


def _residual() -> Steps:
    steps, v = _corrupted()
    steps.put("r", [(f"({a[0]} - {b[0]})", f"({a[1]} - {b[1]})") for a, b in zip(named("d"), v, strict=True)])
    return steps


def _corrected() -> Steps:
    steps, x = Steps(_first()), named("d")
    for term in ("g", "d"):
        inverse = []
        for side in "pq":
            g = named(f"{term}{side}0_")
            (det,) = steps.put(f"e{term}{side}", [plus(times_(g[0], g[3]), tuple(f"(-{y})" for y in times_(g[1], g[2])))])
            size = f"({det[0]} * {det[0]} + {det[1]} * {det[1]})"
            over = (f"({det[0]} / {size})", f"(-{det[1]} / {size})")
            turned = [g[3], tuple(f"(-{y})" for y in g[1]), tuple(f"(-{y})" for y in g[2]), g[0]]
            inverse.append(steps.put(f"i{term}{side}", [times_(y, over) for y in turned]))
        x = steps.put(f"x{term}", dot(inverse[0], x))
        x = steps.put(f"y{term}", dot(x, herm(inverse[1])))
    steps.put("c", x)
    return steps


def _sums(name: str, keys: str = "scan, chan", digits: int = 4) -> str:
    cells = ", ".join(f"round(sum({name}{k}{p}), {digits}) AS {name}{k}{p}" for k in range(4) for p in "ri")
    return f"SELECT {keys}, {cells}, count(*) AS n FROM rows GROUP BY {keys}"


def _weights() -> Steps:
    steps = Steps(_first())
    w = [f"w{k}" for k in range(4)]
    for n, term in enumerate("dg"):  # the weights of x' = K x: sum_k |K_ki|^2 w_k
        size = lambda s, k: f"({term}{s}0_{k}r * {term}{s}0_{k}r + {term}{s}0_{k}i * {term}{s}0_{k}i)"  # noqa: B023, E731
        made = [" + ".join(f"{size('p', 2 * (r // 2) + c // 2)} * {size('q', 2 * (r % 2) + c % 2)} * {w[r]}" for r in range(4)) for c in range(4)]
        steps.sql.append(f"t{n} AS (SELECT *, {', '.join(f'{x} AS u{n}_{c}' for c, x in enumerate(made))} FROM {steps.at})")
        steps.at, w = f"t{n}", [f"u{n}_{c}" for c in range(4)]
    return steps


def _sum_of(rows: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    from .queries import _r

    parts = [_r(F.sum(F.col(column)[k][p]), 4).alias(f"{name}{k}{p[0]}") for k in range(4) for p in ("re", "im")]
    return rows.groupBy(*keys).agg(*parts, F.count("*").alias("n"))


def chain_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data less the model of both directions through both terms."""
    return _sum_of(apply.residual(_applied(spark, sf_dir), TERMS, N_CORR, N_DIR), "residual", "r", "scan", "chan")


def chain_corrected_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse 2x2 gains of both terms on data."""
    return _sum_of(apply.corrected(_applied(spark, sf_dir), TERMS, N_CORR), "corrected_data", "c", "scan", "chan")


def chain_corrected_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _r

    rows = apply.corrected_weight(_applied(spark, sf_dir), TERMS, N_CORR)
    return rows.groupBy("scan", "chan").agg(*[_r(F.sum(F.col("corrected_weight")[k]), 4).alias(f"w{k}") for k in range(4)])


def chain_chisq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-squared of every chunk after two terms of two directions."""
    from .queries import _r

    rows = apply.residual(_applied(spark, sf_dir), TERMS, N_CORR, N_DIR)
    return stats.chi_squared(rows, N_CORR).select("scan", "t_chunk", "f_chunk", _r(F.col("chisq"), 5).alias("chisq"))


def chain_net_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of both terms' gains, on times and channels; flagged ones are the identity."""
    from .queries import _r

    vis, gains = visibilities(spark, sf_dir)
    grid = vis.select(*CHUNK, *[x for t in TERMS for x in (t.t_bin, t.f_bin)], "time", "chan").distinct()
    net = apply.net_gains(gains, grid, TERMS, N_CORR)
    sums: list[Column] = [_r(F.sum(F.col("g")[k][p]), 4).alias(f"g{k}{p[0]}") for k in range(4) for p in ("re", "im")]
    return net.groupBy("scan", "ant", "chan").agg(*sums, F.sum(F.col("gain_flag").cast("int")).alias("flagged"))


def chain_baseline_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _r

    found = apply.baseline_corrections(_applied(spark, sf_dir), TERMS, N_CORR, N_DIR)
    return found.select("scan", "t_chunk", "chan", "ant1", "ant2", *[_r(F.col("bl_correction")[k][p], 5).alias(f"c{k}{p[0]}") for k in range(4) for p in ("re", "im")])


def _sql_net() -> str:
    steps = Steps(_first())
    grid = f"grid AS (SELECT DISTINCT scan, t, chan, G_t_bin, D_t_bin, G_f_bin, D_f_bin FROM {steps.at}), a AS (SELECT *, unnest(range({N_ANT})) AS ant FROM grid)"
    cells = []
    for term, formulas in FORMULAS.items():
        for k, x in enumerate(formulas):
            x = x.replace("t_bin", f"{term}_t_bin").replace("f_bin", f"{term}_f_bin").replace("dir", "0")
            cells.append(f"{x} AS {term.lower()}{k // 2}{'ri'[k % 2]}")
    steps.sql += [grid, f"h AS (SELECT *, {', '.join(cells)}, greatest((ant + G_t_bin) % 11 = 0, (ant + D_t_bin) % 11 = 0) AS hit FROM a)"]
    steps.at = "h"
    net, one = dot(named("g"), named("d")), (1, 0, 0, 1)
    sums = ", ".join(f"round(sum(CASE WHEN hit THEN {one[k] if p == 'r' else 0} ELSE {x} END), 4) AS g{k}{p}" for k, cell in enumerate(net) for p, x in zip("ri", cell, strict=True))
    return steps.text(f"SELECT scan, CAST(ant AS INTEGER) AS ant, chan, {sums}, count(*) FILTER (hit) AS flagged FROM rows GROUP BY scan, ant, chan")


def _sql_chisq() -> str:
    terms = " + ".join(f"(r{k}r * r{k}r + r{k}i * r{k}i) * w{k}" for k in range(4))
    return _residual().text(f"SELECT scan, CAST(t_chunk AS INTEGER) AS t_chunk, CAST(f_chunk AS INTEGER) AS f_chunk, round(sum({terms}) FILTER (NOT hidden) / (4 * count(*) FILTER (NOT hidden)), 5) AS chisq FROM rows GROUP BY ALL").replace("hidden", _HIDDEN)


_HIDDEN = "(bad OR (d0r = 0 AND d0i = 0) OR (d1r = 0 AND d1i = 0) OR (d2r = 0 AND d2i = 0) OR (d3r = 0 AND d3i = 0))"


def _sql_baseline() -> str:
    steps, v = _corrupted()
    cells = []
    for k in range(4):
        top = times_((f"v{k}r", f"(-v{k}i)"), (f"d{k}r", f"d{k}i"))
        size = f"sum((v{k}r * v{k}r + v{k}i * v{k}i) * w{k}) FILTER (NOT hidden)"
        cells += [f"round(CASE WHEN {size} > 0 THEN sum({x} * w{k}) FILTER (NOT hidden) / {size} ELSE {int(p == 'r')} END, 5) AS c{k}{p}" for p, x in zip("ri", top, strict=True)]
    keys = "scan, CAST(t_chunk AS INTEGER) AS t_chunk, chan, CAST(ant1 AS INTEGER) AS ant1, CAST(ant2 AS INTEGER) AS ant2"
    return steps.text(f"SELECT {keys}, {', '.join(cells)} FROM rows GROUP BY scan, t_chunk, f_chunk, chan, ant1, ant2").replace("hidden", _HIDDEN)


QUERIES = {f.__name__: f for f in (chain_residual, chain_corrected_data, chain_corrected_weight, chain_chisq, chain_net_gains, chain_baseline_corrections)}
ORACLE_SQL = {
    "chain_residual": _residual().text(_sums("r")),
    "chain_corrected_data": _corrected().text(_sums("c")),
    "chain_corrected_weight": _weights().text("SELECT scan, chan, " + ", ".join(f"round(sum(u1_{k}), 4) AS w{k}" for k in range(4)) + " FROM rows GROUP BY scan, chan"),
    "chain_chisq": _sql_chisq(),
    "chain_net_gains": _sql_net(),
    "chain_baseline_corrections": _sql_baseline(),
}
