"""Selection, cleaning, weights and flags of visibilities: everything before the model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jones import Cx, Jones


def select_partitions(vis: DataFrame, fields: Sequence[int] | int = (), ddids: Sequence[int] | int = ()) -> DataFrame:
    """Rows of some fields and data descriptions; none given means all. The filters reach the scan."""
    for name, wanted in (("field", fields), ("ddid", ddids)):
        wanted = [wanted] if isinstance(wanted, int) else list(wanted)
        if wanted:
            vis = vis.where(F.col(name).isin(wanted))
    return vis


def require_rows(vis: DataFrame, what: str = "selection") -> DataFrame:
    if vis.isEmpty():
        raise ValueError(f"the {what} leaves no rows")
    return vis


def select_correlations(vis: DataFrame, wanted: Sequence[int], n_corr: int) -> DataFrame:
    """Only the correlations ``wanted`` of data, model, weight and flag."""
    if any(not 0 <= c < n_corr for c in wanted):
        raise IndexError(f"correlations {list(wanted)} of {n_corr}")
    if len(wanted) not in (1, 2, 4):
        raise ValueError("1, 2 or 4 correlations are supported")

    def pick(name: str) -> Column:
        return F.array(*[F.col(name)[c] for c in wanted])

    own = {c: pick(c) for c in ("data", "weight", "flag") if c in vis.columns}
    if "model" in vis.columns:
        own["model"] = F.transform("model", lambda m: F.array(*[m[c] for c in wanted]))
    return vis.withColumns(own)


def zero_bad_data(vis: DataFrame, n_corr: int, column: str = "data") -> DataFrame:
    """Values with a part that isn't finite become 0."""
    parts = Jones.of(F.col(column), n_corr).parts
    return vis.withColumn(column, Jones(tuple(p.where(p.is_finite(), Cx.lit(0)) for p in parts)).column())


def initial_weights(n_corr: int, weight: str = "", sigma: str = "") -> Column:
    """A weight column as it is, 1 / sigma^2 (0 stays 0), or 1."""
    if weight:
        return F.array(*[F.col(weight)[k].cast("double") for k in range(n_corr)])
    if sigma:
        s = [F.col(sigma)[k].cast("double") for k in range(n_corr)]
        return F.array(*[F.when(x != 0, 1 / (x * x)).otherwise(0.0) for x in s])
    return F.array(*[F.lit(1.0)] * n_corr)


def initial_flags(n_corr: int) -> Column:
    """1 where any correlation or the row is flagged, or a diagonal value or weight is 0; else 0."""
    diagonal = (0, 3) if n_corr == 4 else range(n_corr)
    data = Jones.of(F.col("data"), n_corr).parts
    bad = F.coalesce(F.col("flag_row"), F.lit(False))
    for k in range(n_corr):
        bad = bad | F.coalesce(F.col("flag")[k], F.lit(False))
    for k in diagonal:
        bad = bad | data[k].is_zero() | (F.col("weight")[k] == 0)
    return bad.cast("byte")


def soft_flag(flag: Column, condition: Column) -> Column:
    """-1, a flag for the solver only, where the condition holds and nothing is flagged."""
    return F.when(condition & (flag == 0), F.lit(-1).cast("byte")).otherwise(flag)


def uv_outside(low: float, high: float) -> Column:
    """Not within the open range of uv distances; an upper end of 0 is none."""
    distance = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return ~((distance > low) & (distance < (high or float("inf"))))


def preprocess(
    vis: DataFrame,
    n_corr: int,
    weight: str = "",
    sigma: str = "",
    uv_range: tuple[float, float] = (0.0, 0.0),
    flag_autocorrelations: bool = True,
) -> DataFrame:
    """Clean data, weights, and the flags 0 (good), 1 (flagged) and -1 (not to be solved with)."""
    vis = zero_bad_data(vis, n_corr).withColumn("weight", initial_weights(n_corr, weight, sigma))
    vis = vis.withColumn("flag", initial_flags(n_corr))
    if flag_autocorrelations:
        vis = vis.withColumn("flag", soft_flag(F.col("flag"), F.col("ant1") == F.col("ant2")))
    if any(uv_range):
        vis = vis.withColumn("flag", soft_flag(F.col("flag"), uv_outside(*uv_range)))
    return vis


def final_flags(vis: DataFrame, n_corr: int) -> DataFrame:
    """The stored form: a flag for each correlation, without the temporary ones; rows whose channels are all
    flagged get flag_row (see :func:`row_flags`)."""
    hard = F.col("flag") == 1
    return vis.withColumn("flag", F.array_repeat(hard, n_corr))


def row_flags(vis: DataFrame, keys: Sequence[str] = ("scan", "field", "ddid", "row_id")) -> DataFrame:
    """Per row, whether all its channels and correlations are flagged."""
    return vis.groupBy(*keys).agg(F.bool_and(F.forall("flag", lambda x: x)).alias("flag_row"))


def expand_correlations(column: Column, at: Sequence[int], n_corr: int, zero: Column) -> Column:
    """Back to ``n_corr`` correlations, with ``zero`` where one was not selected."""
    places = {c: k for k, c in enumerate(at)}
    return F.array(*[column[places[c]] if c in places else zero for c in range(n_corr)])


def expand_flags(column: Column, n_corr: int) -> Column:
    """Any selected correlation's flag for all of them."""
    return F.array_repeat(F.exists(column, lambda x: x), n_corr)
