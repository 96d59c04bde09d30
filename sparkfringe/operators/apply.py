"""Applying gains: model visibilities, residuals, corrected data and weights, net gains, baseline corrections.

Gains are a long table; a term's gains join the visibilities twice, for either antenna, by equality on partition,
chunk and bins. A row gets an array over directions, so that direction dependence costs no
more rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones, corrected_weights
from ..plans.schemas import CHUNK


@dataclass(frozen=True)
class Term:
    """A gain term of a chain, in the order of application, with the names of its bin columns in the data."""

    name: str
    direction_dependent: bool = False

    @property
    def t_bin(self) -> str:
        return f"{self.name}_t_bin"

    @property
    def f_bin(self) -> str:
        return f"{self.name}_f_bin"


def attach_gains(vis: DataFrame, gains: DataFrame, terms: Sequence[Term], keys: Sequence[str] = CHUNK) -> DataFrame:
    """Columns ``<term>_p`` and ``<term>_q``: arrays over directions of the gains of ant1 and ant2."""
    keys = list(keys)
    for term in terms:
        own = gains.where(F.col("term") == term.name).groupBy(*keys, "t_bin", "f_bin", "ant").agg(
            F.array_sort(F.collect_list(F.struct("dir", "g"))).alias("_d")
        )
        own = own.select(*keys, F.col("t_bin").alias(term.t_bin), F.col("f_bin").alias(term.f_bin), "ant", F.col("_d.g").alias("_g"))
        for ant, side in (("ant1", "p"), ("ant2", "q")):
            one = own.withColumnsRenamed({"ant": ant, "_g": f"{term.name}_{side}"})
            vis = vis.join(one, [*keys, term.t_bin, term.f_bin, ant])
    return vis


#: Generated methods above this many bytes of code are never compiled by the JVM, and many products make such
#: methods; the session's limit is lowered to it, above which Spark splits the work into smaller methods.
HUGE_METHOD = 8000


def small_methods(spark: SparkSession) -> None:
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > HUGE_METHOD:
        spark.conf.set(name, HUGE_METHOD)


class Steps:
    """Products in steps: each becomes a column of its own, so that expressions stay as long as one product.

    An expression over expressions is a tree, and one that uses every part several times grows with the power of the
    products; a column is computed once and read several times.
    """

    def __init__(self, rows: DataFrame):
        self.rows, self.names = rows, []
        small_methods(rows.sparkSession)

    def put(self, value: Jones) -> Jones:
        name = f"_step{len(self.names)}"
        self.rows = self.rows.withColumn(name, value.column())
        self.names.append(name)
        return Jones.of(F.col(name), value.n_corr)

    def done(self, name: str, value: Column) -> DataFrame:
        return self.rows.withColumn(name, value).drop(*self.names)


def _gain(term: Term, side: str, direction: int, n_corr: int) -> Jones:
    column = F.col(f"{term.name}_{side}")
    return Jones.of(column[direction if term.direction_dependent else 0], n_corr)


def corrupted(steps: Steps, terms: Sequence[Term], model: Jones, direction: int) -> Jones:
    """G1 G2 ... M ... G2^H G1^H of one direction."""
    for term in reversed(terms):
        p, q = (_gain(term, side, direction, model.n_corr) for side in "pq")
        model = steps.put(steps.put(p @ model) @ q.herm())
    return model


def model_sum(steps: Steps, terms: Sequence[Term], n_corr: int, directions: Sequence[int], model: str = "model") -> Jones:
    parts = [corrupted(steps, terms, Jones.of(F.col(model)[d], n_corr), d) for d in directions]
    return steps.put(reduce(lambda a, b: a + b, parts))


def residual(vis: DataFrame, terms: Sequence[Term], n_corr: int, n_dir: int, subtract: Sequence[int] = ()) -> DataFrame:
    """``residual``: data less the corrupted model of all directions, or of those to be subtracted."""
    wanted = list(subtract) or list(range(n_dir))
    if any(not 0 <= d < n_dir for d in wanted):
        raise ValueError(f"directions {wanted} of {n_dir}")
    steps = Steps(vis)
    v = model_sum(steps, terms, n_corr, wanted)
    return steps.done("residual", (Jones.of(F.col("data"), n_corr) - v).column())


def _net(steps: Steps, terms: Sequence[Term], side: str, n_corr: int) -> Jones:
    if not terms:
        return Jones.identity(n_corr)
    return reduce(lambda a, b: steps.put(a @ b), [_gain(t, side, 0, n_corr) for t in terms])


def corrected(vis: DataFrame, terms: Sequence[Term], n_corr: int, of: str = "data", name: str = "corrected_data") -> DataFrame:
    """G^-1 x G^-H with the gains of direction 0, term by term; 0 where a gain is singular."""
    steps = Steps(vis)
    value = Jones.of(F.col(of), n_corr)
    for term in terms:
        p, q = (_inverse(steps, _gain(term, side, 0, n_corr)) for side in "pq")
        value = steps.put(steps.put(p @ value) @ q.herm())
    return steps.done(name, value.column())


def _inverse(steps: Steps, gain: Jones) -> Jones:
    return steps.put(gain.inverse(det=steps.put(Jones((gain.det(),))).parts[0]))


def corrected_weight(vis: DataFrame, terms: Sequence[Term], n_corr: int) -> DataFrame:
    """Weights of corrected data, with the gains of direction 0."""
    weights = [F.col("weight")[k] for k in range(n_corr)]
    rows = vis
    for n, term in enumerate(reversed(terms)):
        made = corrected_weights(_gain(term, "p", 0, n_corr), _gain(term, "q", 0, n_corr), weights)
        rows = rows.withColumn(f"_weight{n}", F.array(*made))
        weights = [F.col(f"_weight{n}")[k] for k in range(n_corr)]
    return rows.withColumn("corrected_weight", F.array(*weights)).drop(*[f"_weight{n}" for n in range(len(terms))])


def summed_model(vis: DataFrame, n_corr: int, n_dir: int) -> DataFrame:
    """``model_data``: the model summed over directions."""
    steps = Steps(vis)
    return steps.done("model_data", model_sum(steps, (), n_corr, range(n_dir)).column())


def net_gains(gains: DataFrame, grid: DataFrame, terms: Sequence[Term], n_corr: int, keys: Sequence[str] = CHUNK) -> DataFrame:
    """The product of terms on every (time, chan) of ``grid``, which has the terms' bins; any flagged gain
    makes the net gain flagged and the identity."""
    out, values, flags = grid, [], []
    for term in terms:
        own = gains.where(F.col("term") == term.name).select(
            *keys, F.col("t_bin").alias(term.t_bin), F.col("f_bin").alias(term.f_bin), "ant", "dir",
            F.col("g").alias(f"_{term.name}"), F.col("gain_flag").alias(f"_{term.name}_flag"),
        )
        on = [*keys, term.t_bin, term.f_bin]
        out = out.join(own, on if not values else [*on, "ant", "dir"])
        values.append(Jones.of(F.col(f"_{term.name}"), n_corr))
        flags.append(F.col(f"_{term.name}_flag"))
    flag = reduce(lambda a, b: a.bitwiseOR(b), flags)
    steps = Steps(out)
    net = reduce(lambda a, b: steps.put(a @ b), values).where(flag == 0, Jones.identity(n_corr))
    name = "".join(t.name for t in terms) + "-net"
    return steps.rows.select(F.lit(name).alias("term"), *keys, "time", "chan", "ant", "dir", net.column().alias("g"), flag.alias("gain_flag"))


def baseline_corrections(vis: DataFrame, terms: Sequence[Term], n_corr: int, n_dir: int, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Per chunk, baseline, channel and correlation: sum conj(v) w d / sum conj(v) w v over unflagged rows, 1 without any."""
    steps = Steps(vis)
    v = model_sum(steps, terms, n_corr, range(n_dir))
    d = Jones.of(F.col("data"), n_corr)
    good = F.col("flag") == 0
    sums = []
    for k in range(n_corr):
        top, weight = v.parts[k].conj() * d.parts[k], F.col("weight")[k]
        sums += [
            F.sum(F.when(good, top.re * weight)).alias(f"re{k}"), F.sum(F.when(good, top.im * weight)).alias(f"im{k}"),
            F.sum(F.when(good, v.parts[k].abs2() * weight)).alias(f"size{k}"),
        ]
    out = steps.rows.groupBy(*keys, "ant1", "ant2", "chan").agg(*sums)
    one = Cx.lit(1)
    made = [Cx(F.col(f"re{k}") / F.col(f"size{k}"), F.col(f"im{k}") / F.col(f"size{k}")).where(F.col(f"size{k}") > 0, one) for k in range(n_corr)]
    return out.select(*keys, "ant1", "ant2", "chan", Jones(tuple(made)).column().alias("bl_correction"))


def apply_baseline_corrections(vis: DataFrame, corrections: DataFrame, n_corr: int, of: str = "corrected_data", keys: Sequence[str] = CHUNK) -> DataFrame:
    """Values divided by their correction; without one, or by 0, they stay."""
    on = [*keys, "ant1", "ant2", "chan"]
    out = vis.join(corrections.select(*on, "bl_correction"), on, "left")
    value, by = Jones.of(F.col(of), n_corr), Jones.of(F.col("bl_correction"), n_corr)
    one = Cx.lit(1)
    usable = [F.coalesce(~b.is_zero(), F.lit(False)) for b in by.parts]
    made = [v / b.where(ok, one) for v, b, ok in zip(value.parts, by.parts, usable, strict=True)]
    return out.withColumn(of, Jones(tuple(made)).column()).drop("bl_correction")


def flags_from_gains(vis: DataFrame, gains: DataFrame, term: Term, keys: Sequence[str] = CHUNK) -> DataFrame:
    """Data are flagged where the gain of either antenna is (direction 0)."""
    own = gains.where((F.col("term") == term.name) & (F.col("dir") == 0)).select(
        *keys, F.col("t_bin").alias(term.t_bin), F.col("f_bin").alias(term.f_bin), "ant", F.col("gain_flag").alias("_flag")
    )
    out = vis
    for ant, side in (("ant1", "_p"), ("ant2", "_q")):
        out = out.join(own.withColumnsRenamed({"ant": ant, "_flag": side}), [*keys, term.t_bin, term.f_bin, ant], "left")
    bad = (F.coalesce("_p", F.lit(0)) == 1) | (F.coalesce("_q", F.lit(0)) == 1)
    return out.withColumn("flag", F.when(bad, F.lit(1).cast("byte")).otherwise(F.col("flag"))).drop("_p", "_q")


def initial_gain_flags(vis: DataFrame, term: Term, n_dir: int = 1, keys: Sequence[str] = CHUNK) -> DataFrame:
    """A gain is flagged where all its data are; antennas without data don't appear."""
    hard = (F.col("flag") == 1).cast("byte")
    own = vis.select(*keys, F.col(term.t_bin).alias("t_bin"), F.col(term.f_bin).alias("f_bin"), F.explode(F.array("ant1", "ant2")).alias("ant"), hard.alias("_f"))
    out = own.groupBy(*keys, "t_bin", "f_bin", "ant").agg(F.min("_f").alias("gain_flag"))
    return out.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_dir - 1))).alias("dir"))


def identity_where_flagged(gains: DataFrame, n_corr: int) -> DataFrame:
    g = Jones.of(F.col("g"), n_corr)
    return gains.withColumn("g", Jones.identity(n_corr).where(F.col("gain_flag") == 1, g).column())


def param_flags(gains: DataFrame, keys: Sequence[str], param_bins: Sequence[str]) -> DataFrame:
    """A parameter is flagged where all gains that it makes are."""
    return gains.groupBy(*keys, *param_bins, "ant", "dir").agg(F.min((F.col("gain_flag") == 1).cast("byte")).alias("param_flag"))


def combine_gain_flags(gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gains.groupBy(*keys, "ant", "dir").agg(F.bit_or("gain_flag").alias("gain_flag"))


def normal_equations(vis: DataFrame, terms: Sequence[Term], active: int, n_corr: int, keys: Sequence[str] = CHUNK) -> DataFrame:
    """One accumulation of a Gauss-Newton step for a diagonal (or scalar) term of a direction-independent chain.

    Per interval, antenna and correlation, from both sides of every baseline: jhj = sum w |h|^2 and
    jhr = sum w r conj(h), with h what the gain multiplies. Sums are combined before the shuffle.
    """
    term = terms[active]
    model = Jones.of(F.col("model")[0], n_corr)
    data = Jones.of(F.col("data"), n_corr)
    steps = Steps(vis.where("flag = 0"))
    inner = corrupted(steps, terms[active + 1 :], model, 0)
    left = [_net(steps, terms[:active], side, n_corr) for side in "pq"]
    p, q = (_gain(term, side, 0, n_corr) for side in "pq")
    r = steps.put(data - corrupted(steps, terms, model, 0))
    sides = (
        ("ant1", steps.put(steps.put(left[0].elementwise(inner)).elementwise((left[1].elementwise(q)).conj())), r),
        ("ant2", steps.put(steps.put(left[1].elementwise(inner.conj())).elementwise((left[0].elementwise(p)).conj())), r.conj()),
    )
    good = steps.rows
    views = []
    for ant, h, rest in sides:
        top = rest.elementwise(h.conj())
        cells = [c for k in range(n_corr) for c in (top.parts[k].re * F.col("weight")[k], top.parts[k].im * F.col("weight")[k], h.parts[k].abs2() * F.col("weight")[k])]
        views.append(F.struct(F.col(ant).alias("ant"), *[c.alias(f"{n}{k // 3}") for k, (c, n) in enumerate(zip(cells, ["re", "im", "jhj"] * n_corr, strict=True))]))
    rows = good.select(*keys, F.col(term.t_bin).alias("t_bin"), F.col(term.f_bin).alias("f_bin"), F.explode(F.array(*views)).alias("_v")).select(*keys, "t_bin", "f_bin", "_v.*")
    names = [f"{n}{k}" for k in range(n_corr) for n in ("re", "im", "jhj")]
    return rows.groupBy(*keys, "t_bin", "f_bin", "ant").agg(*[F.sum(n).alias(n) for n in names])
