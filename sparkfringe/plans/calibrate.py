"""A calibration run: from a measurement table and options to gains, statistics and corrected columns."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import angles, apply, bda, binning, flagging, interpolation, large, model, preprocess, solver, stats
from ..sources import tables as sources
from .config import Config, TermOptions, final_config, parse_recipe
from .schemas import CHUNK, JONES, KEYS

LOG = logging.getLogger(__name__)


@dataclass
class Outcome:
    """``vis`` has the products; the rest is what the solver says of gains, parameters, convergence and chi-squared."""

    vis: DataFrame
    gain: DataFrame
    param: DataFrame
    conv: DataFrame
    stats: DataFrame
    net: dict[str, DataFrame]
    baseline: DataFrame | None
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Gives back what the run persisted; call it when the results have been written."""
        for df in self.held:
            df.unpersist()

    def log(self) -> None:
        for row in solver.convergence(self.conv).collect():
            LOG.info("%s: converged %.3f, at most %s iterations, %s chunks", *row)
        for row in stats.chi_squared_summary(self.stats, ["presolve_chisq", "postsolve_chisq"]).collect():
            LOG.info("chi-squared: %s", row.asDict())


def chunked(vis: DataFrame, chans: DataFrame, time_chunk: int | float, freq_chunk: int | float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with t_chunk and f_chunk, and the tables of times and channels that they come from."""
    times = binning.time_chunks(binning.distinct_times(vis), time_chunk)
    chans = binning.freq_chunks(chans, freq_chunk)
    out = binning.attach(vis, times.drop("interval", "n_rows"), ["scan", "field", "ddid", "time"])
    return binning.attach(out, chans.drop("freq", "width"), ["ddid", "chan"]), times, chans


def bin_terms(vis: DataFrame, times: DataFrame, chans: DataFrame, terms: list[TermOptions]) -> DataFrame:
    """``<term>_t_bin``, ``<term>_f_bin`` (of gains) and ``<term>_pf_bin`` (of unknowns) on every row."""
    t, f = times, chans
    for term in terms:
        t = binning.time_bins(t, term.time_interval, f"{term.name}_t_bin", term.respect_scan_boundaries)
        f = binning.freq_bins(f, term.freq_interval, f"{term.name}_pf_bin")
        f = binning.freq_bins(f, 1 if term.type in solver.FULL_RESOLUTION else term.freq_interval, f"{term.name}_f_bin")
    out = binning.attach(vis, t.drop("interval", "n_rows", "t_chunk"), ["scan", "field", "ddid", "time"])
    return binning.attach(out, f.drop("freq", "width", "f_chunk"), ["ddid", "chan"])


def load_terms(spark: SparkSession, vis: DataFrame, config: Config, n_corr: int, turns: DataFrame | None = None) -> DataFrame | None:
    """Stored gains or parameters of terms with load_from, interpolated onto the bins of this run; parallactic angles
    come from ``turns`` (scan, field, ddid, time, ant, angle0, angle1)."""
    out = None
    for term in config.chain():
        if term.type == "parallactic_angle":
            if turns is None:
                raise ValueError(f"{term.name} needs parallactic angles")
            bins = vis.select(*CHUNK, F.col(f"{term.name}_t_bin").alias("t_bin"), F.col(f"{term.name}_pf_bin").alias("f_bin"), "time").distinct()
            own = bins.join(turns, [*KEYS, "time"]).select(
                *CHUNK, F.lit(term.name).alias("term"), "t_bin", "f_bin", "ant", F.lit(0).alias("dir"),
                F.lit(None).cast(JONES).alias("g"), F.array("angle0", "angle1").alias("p"),
            )
            out = own if out is None else out.unionByName(own)
            continue
        if not term.load_from:
            continue
        stored = spark.read.parquet(term.load_from).where(F.col("term") == term.name)
        plain = term.type in solver.PLAIN
        kinds = {r["type"] for r in stored.select("type").distinct().collect()}
        if kinds - {term.type}:
            raise ValueError(f"{term.name} is stored as {', '.join(sorted(kinds))}, not {term.type}")
        if plain:
            interpolation.check_overlap(stored)
            values = interpolation.to_real(stored, n_corr)
        else:
            values = stored.withColumnsRenamed({"param_time": "gain_time", "param_freq": "gain_freq"}).withColumn("v", F.when(F.col("param_flag") != 1, F.col("p")))
        bins = [F.col(f"{term.name}_t_bin").alias("t_bin"), F.col(f"{term.name}_pf_bin").alias("f_bin")]
        to = vis.select(*CHUNK, *bins, "time", "freq").distinct().groupBy(*CHUNK, "t_bin", "f_bin")
        to = to.agg((F.sum_distinct("time") / F.countDistinct("time")).alias("gain_time"), (F.sum_distinct("freq") / F.countDistinct("freq")).alias("gain_freq"))
        found = interpolation.interpolate(values.select("term", "ant", "dir", "gain_time", "gain_freq", "v"), to.withColumn("term", F.lit(term.name)), term.interp_method)
        if plain:
            found = interpolation.from_real(found, n_corr).withColumn("p", F.lit(None).cast("array<double>"))
        else:
            found = found.withColumnRenamed("v", "p").withColumn("g", F.lit(None).cast(JONES))
        own = found.select(*CHUNK, "term", "t_bin", "f_bin", "ant", "dir", "g", "p")
        out = own if out is None else out.unionByName(own)
    return out


def calibrate(
    vis: DataFrame, chans: DataFrame, config: Config, n_corr: int, n_ant: int, circular: bool = False,
    clusters: dict[str, list[str]] | None = None, turns: DataFrame | None = None,
) -> Outcome:
    """Solves and applies. ``vis`` has the columns of :data:`plans.schemas.VIS` and those the recipe names; a
    ``row_weight`` column, of averaged data, scales the weights."""
    for line in final_config(config):
        LOG.debug(line)
    spark, ms = vis.sparkSession, config.input_ms
    vis = preprocess.require_rows(preprocess.select_partitions(vis, ms.select_fields, ms.select_ddids))
    if ms.data_column != "data":
        vis = vis.withColumn("data", F.col(ms.data_column))
    if "scan" not in ms.group_by:
        vis = vis.withColumn("scan", F.lit(0))
    if ms.select_corr:
        vis = preprocess.select_correlations(vis, ms.select_corr, n_corr)
        n_corr = len(ms.select_corr)
    vis = preprocess.preprocess(vis, n_corr, ms.weight_column, ms.sigma_column, ms.select_uv_range)
    if "row_weight" in vis.columns:
        vis = vis.withColumn("weight", F.transform("weight", lambda w: w * F.col("row_weight")))
    recipe = parse_recipe(config.input_model.recipe)
    vis = model.add_model(vis, recipe, n_corr, clusters)
    n_dir = model.n_directions(recipe, clusters)
    vis, times, chans = chunked(vis, chans, ms.time_chunk, ms.freq_chunk)
    vis = bin_terms(vis, times, chans, config.chain()).persist(StorageLevel.MEMORY_AND_DISK)
    plan = solver.Plan(tuple(config.chain()), config.solver, n_corr, n_ant, circular)
    result = large.solve_any(vis, plan, load_terms(spark, vis, config, n_corr, turns)).persist(StorageLevel.MEMORY_AND_DISK)
    held = [vis, result]
    found = solver.split(result)
    on = [*CHUNK, "row_id", "chan"]
    kept = found["vis"].select(*on, F.col("flag").alias("_flag"), F.col("weight").alias("_weight"))
    flag = F.col("_flag") if config.solver.propagate_flags else F.col("flag")
    out = vis.join(kept, on).withColumns({"flag": flag, "native_weight": F.col("weight"), "weight": F.col("_weight")}).drop("_flag", "_weight")
    terms = [apply.Term(t.name, t.direction_dependent) for t in config.chain()]
    out = apply.attach_gains(out, found["gain"], terms)
    out = apply.residual(out, terms, n_corr, n_dir, config.output.subtract_directions)
    out = apply.corrected(out, terms, n_corr)
    out = apply.corrected(out, terms, n_corr, "residual", "corrected_residual")
    out = apply.corrected_weight(out, terms, n_corr)
    out = apply.summed_model(out, n_corr, n_dir)
    baseline = None
    if config.output.compute_baseline_corrections:
        baseline = apply.baseline_corrections(out, terms, n_corr, n_dir)
        if config.output.apply_baseline_corrections:
            out = apply.apply_baseline_corrections(out, baseline, n_corr)
            out = apply.apply_baseline_corrections(out, baseline, n_corr, "corrected_residual")
    if config.mad_flags.enable:
        mad = config.mad_flags
        weights = {"disabled": None, "native": "native_weight", "robust": "weight"}[mad.whitening]
        out = flagging.whitened(out, n_corr, weights=weights)
        out = flagging.mad_flags(out, n_corr, mad.threshold_bl, mad.threshold_global, mad.max_deviation, mad.use_off_diagonals, held=held)
    if config.output.apply_p_jones_inv:
        if turns is None:
            raise ValueError("derotation needs parallactic angles")
        products = ["residual", "corrected_data", "corrected_residual"]
        out = angles.apply_rotation(out, turns, products, circular, derotate=True, n_corr=n_corr)
    net = {}
    for names in config.output.net_gains:
        own = [t for t in terms if t.name in names]
        bins = [c for t in own for c in (t.t_bin, t.f_bin)]
        grid = out.select(*CHUNK, *bins, "time", "chan").distinct()
        net["".join(names)] = apply.net_gains(found["gain"], grid, own, n_corr)
    out = preprocess.final_flags(out, n_corr)
    return Outcome(out, found["gain"], found["param"], found["conv"], found["stats"], net, baseline, held)


def add_sky(spark: SparkSession, vis: DataFrame, tables: dict[str, DataFrame], chans: DataFrame, config: Config, n_corr: int, circular: bool, turns: DataFrame | None) -> tuple[DataFrame, dict[str, list[str]]]:
    """The sky models of the recipe as array columns, and the clusters that each has."""
    options, clusters = config.input_model, {}
    recipe = parse_recipe(options.recipe)
    tags = {name: t for d in recipe.directions for _, name, t in d}
    beams_of = None
    if options.beam:
        paths = {c: (options.beam.replace("$(corr)", str(c)).replace("$(reim)", "re"), options.beam.replace("$(corr)", str(c)).replace("$(reim)", "im")) for c in range(4)}
        grid = sources.beam_grid(spark, paths)
        beams_of = lambda src: model.beam_jones(src, tables["FIELD"], turns, chans, grid, list(options.beam_l_axis), list(options.beam_m_axis))
    for name in recipe.sky_models:
        src = sources.read_sky_models(spark, {name: tags[name]})
        clusters[name] = model.cluster_order(r["cluster"] for r in src.select("cluster").distinct().collect())
        if beams_of is None:
            vis = model.with_sky(vis, src, tables["FIELD"], n_corr, circular, model.column_of(name), options.invert_uvw)
            continue
        sky = model.predict(vis, src, tables["FIELD"], n_corr, circular, model.column_of(name), invert_uvw=options.invert_uvw, beams=beams_of(src))
        vis = vis.join(sky, [*KEYS, "row_id", "chan"])
    return vis, {n: c for n, c in clusters.items() if tags[n]}


def run(spark: SparkSession, config: Config) -> Outcome:
    """Reads the table of ``config``, calibrates and writes products and gains under the output path."""
    tables = sources.read_sub_tables(spark, config.input_ms.path)
    vis = sources.with_axes(sources.read_main(spark, config.input_ms.path), tables)
    n_ant = tables["ANTENNA"].agg(F.max("ant")).first()[0] + 1
    names = sources.one_set_of_names(tables, preprocess.select_partitions(vis, config.input_ms.select_fields, config.input_ms.select_ddids))
    if config.input_ms.is_bda:
        vis = bda.regular(vis)
    chans = binning.channels(tables["SPECTRAL_WINDOW"], tables["DATA_DESCRIPTION"])
    circular, turns = names[0][0] in "RL", None
    if config.output.apply_p_jones_inv or config.input_model.apply_p_jones or config.input_model.beam or any(t.type == "parallactic_angle" for t in config.chain()):
        angles.check_receptors(tables["FEED"])
        turns = angles.parallactic_angles(binning.distinct_times(vis).select(*KEYS, "time"), tables["ANTENNA"], tables["FIELD"], tables["FEED"])
    vis, clusters = add_sky(spark, vis, tables, chans, config, len(names), circular, turns)
    if config.input_model.apply_p_jones:
        models = parse_recipe(config.input_model.recipe).columns
        vis = angles.apply_rotation(vis, turns, models, circular, n_corr=len(names))
    found = calibrate(vis, chans, config, len(names), n_ant, circular, clusters, turns)
    to = config.output.path
    if to:
        if config.output.products:
            written = bda.restored(found.vis, config.output.products, len(names)) if config.input_ms.is_bda else found.vis
            sources.write_products(written, to, dict(zip(config.output.products, config.output.columns, strict=True)), flags=config.output.flags)
        sources.write_gains(found.gain, f"{to}/gains")
        sources.write_gains(found.param, f"{to}/params")
        for name, net in found.net.items():
            sources.write_gains(net, f"{to}/net/{name}")
        if found.baseline is not None:
            found.baseline.write.parquet(f"{to}/baseline_corrections")
    return found
