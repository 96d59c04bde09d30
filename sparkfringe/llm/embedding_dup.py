"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors of like directions are dealt into blocks; each pair of blocks is a tile, but for pairs whose cones are further apart
than the threshold allows. Every vector is scaled to length 1 (double precision) and rounded to int8 with a scale of its own,
once; e is the length of what rounding took off. Tiles are given these alone. The product of two rounded vectors is exact, and
differs from their cosine by at most e_a + e_b + e_a * e_b. Pairs that are above the threshold by more than that are links, pairs
that are below it by more are none, and only the others are open: a tile names the vectors of its open pairs, and in a second
pass these come in full and their open pairs are computed in double precision.

A tile returns a count of links and a spanning forest of them, never the pairs, so a large group of copies
costs no more rows than other vectors.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths. Rows with the same vec_id are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, joined, lean
from .space import dealt, matrix, slices, unit

THRESHOLD = 0.9
BLOCK, STRIPE = 8192, 512
#: More than double-precision sums of a tile can be off.
SLACK = 1e-6


def is_usable(column: str = "embedding") -> F.Column:
    """Holds components, all of them finite."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) > 0) & fine, F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and rounding errors' lengths of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    return small, scale, np.linalg.norm(unit - small * scale[:, None], axis=1)


class Side:
    """The rounded vectors of one side of a tile, and the full ones where they are at hand."""

    def __init__(self, vectors: np.ndarray | None, rounded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.unit = None if vectors is None else unit(vectors.astype(float))
        small, scale, error = rounded or quantised(self.unit)
        exact = np.float32 if 127 * 127 * small.shape[1] < 2**24 else np.float64
        self.small, self.scale, self.error = small.astype(exact), scale.astype(exact), error


def tile(a: Side, b: Side, threshold: float, own: bool):
    """(first, second, open?) of pairs of two sides that are links or may be, stripe by stripe; with ``own`` each pair of one side
    once."""
    widest = b.error.max() + SLACK
    for at in range(0, len(a.small), STRIPE):
        part = slice(at, at + STRIPE)
        near = (a.small[part] @ b.small.T) * b.scale[None, :]
        least = (threshold - (a.error[part] + widest + a.error[part] * widest)) / a.scale[part]
        i, j = np.nonzero(near >= least[:, None].astype(near.dtype) * (1 - np.sign(least[:, None]) * 1e-6))
        if own:
            i, j = i[i + at < j], j[i + at < j]
        about = near[i, j].astype(float) * a.scale[i + at]
        e_a, e_b = a.error[i + at], b.error[j]
        bound = e_a + e_b + e_a * e_b + SLACK
        sure, open_ = about - bound >= threshold, np.abs(about - threshold) < bound
        kept = sure | open_
        yield i[kept] + at, j[kept], open_[kept]


def exactly(a: Side, b: Side, threshold: float, own: bool):
    """Those open pairs of :func:`tile` that are links, from the full vectors."""
    for i, j, open_ in tile(a, b, threshold, own):
        i, j = i[open_], j[open_]
        sure = np.zeros(len(i), bool)
        for k in np.array_split(np.arange(len(i)), 1 + len(i) // 100_000):
            sure[k] = np.einsum("ij,ij->i", a.unit[i[k]], b.unit[j[k]]) >= threshold
        yield i[sure], j[sure]


def forest(n: int, found) -> tuple[np.ndarray, np.ndarray]:
    """(links of each of n nodes, smallest node each is connected with) from batches of links."""
    degree, label = np.zeros(n, np.int64), np.arange(n)
    for i, j in found:
        degree += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        while len(i):
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
            left = label[i] != label[j]
            i, j = i[left], j[left]
    return degree, label


def _gathered(table: pa.Table) -> pa.Table:
    """One row of a block: nodes and rounded vectors, and the cone that holds them."""
    full = unit(matrix(table, "embedding"))
    small, scale, error = quantised(full)
    mean = full.mean(0)
    size = np.linalg.norm(mean)
    axis = mean / size if size > 1e-9 else np.eye(1, full.shape[1])[0]
    width = float(np.arccos(np.clip((full @ axis).min(), -1, 1))) if size > 1e-9 else np.pi
    cells = {"nodes": table.column("node").to_numpy().tobytes(), "small": small.tobytes(), "scale": scale.tobytes(), "error": error.tobytes()}
    cells = {n: pa.array([v], pa.binary()) for n, v in cells.items()}
    return pa.table({"dims": table.column("dims")[:1], "block": table.column("block")[:1], **cells, "axis": pa.array([axis.tolist()]), "width": pa.array([width])})


def _near(cones: dict, threshold: float):
    """Pairs of a block and one with no smaller number whose cones may hold a link."""
    reach = np.arccos(np.clip(threshold, -1, 1)) + 1e-6

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, block, axis, width in zip(*(batch.column(c).to_pylist() for c in ("dims", "block", "axis", "width")), strict=True):
                if dims in cones:
                    blocks, axes, widths = cones[dims]
                    apart = np.arccos(np.clip(axes @ np.array(axis), -1, 1))
                    found = blocks[(blocks >= block) & (apart <= reach + width + widths)]
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([dims] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(found, pa.int64())], ["dims", "low", "high"])

    return pair


def _answer(every: np.ndarray, found) -> dict:
    """Rows of the nodes with links."""
    degree, label = forest(len(every), found)
    hit = np.flatnonzero(degree)
    return {"node": every[hit], "n_links": degree[hit], "root": every[label[hit]]}


def _multiply(table: pa.Table, threshold: float) -> pa.Table:
    """What is sure of a tile, and the vectors of its open pairs as rows without a root, with their side."""
    rows = {r["block"]: r for r in table.to_pylist()}
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    sides, nodes = [], []
    for r in [rows[low], rows[high]][: 1 + (low != high)]:
        nodes.append(np.frombuffer(r["nodes"], np.int64))
        small = np.frombuffer(r["small"], np.int8).reshape(len(nodes[-1]), -1)
        sides.append(Side(None, (small, np.frombuffer(r["scale"]), np.frombuffer(r["error"]))))
    shift, opened = (len(nodes[0]) if low != high else 0), [np.zeros(len(n), bool) for n in nodes]

    def sure():
        for i, j, open_ in tile(sides[0], sides[-1], threshold, low == high):
            opened[0][i[open_]] = True
            opened[-1][j[open_]] = True
            yield i[~open_], j[~open_] + shift

    out = _answer(np.concatenate(nodes), sure())
    n, m = len(out["node"]), sum(int(o.sum()) for o in opened)
    left = np.concatenate([own[o] for own, o in zip(nodes, opened, strict=True)])
    side = np.repeat(np.arange(len(opened)), [int(o.sum()) for o in opened])
    of = {c: pa.repeat(table.column(c)[0], n + m) for c in ("dims", "low", "high")}
    return pa.table(of | {
        "node": np.concatenate([out["node"], left]), "n_links": pa.array([*out["n_links"].tolist(), *[None] * m], pa.int64()),
        "root": pa.array([*out["root"].tolist(), *[None] * m], pa.int64()), "side": pa.array([None] * n + side.tolist(), pa.int32()),
    })


def _settle(table: pa.Table, threshold: float) -> pa.Table:
    """Links among the open vectors of a tile."""
    side, nodes = table.column("side").to_numpy(), table.column("node").to_numpy()
    vectors, own = matrix(table, "embedding"), bool(table.column("low")[0] == table.column("high")[0])
    order = [np.flatnonzero(side == k) for k in range(1 if own else 2)]
    if any(not len(x) for x in order):
        return pa.table({"node": nodes[:0], "n_links": nodes[:0], "root": nodes[:0]})
    sides = [Side(vectors[x]) for x in order]
    shift = 0 if own else len(order[0])
    found = ((i, j + shift) for i, j in exactly(sides[0], sides[-1], threshold, own))
    return pa.table(_answer(np.concatenate([nodes[x] for x in order]), found))


def links(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """From (node, embedding), all usable and not zero: rows (node, n_links, root) of each tile with links."""
    vectors = dealt(vectors.select("node", F.col("embedding").cast("array<double>"), F.size("embedding").alias("dims")), scratch, block, scaled=True)
    made = "dims int, block long, nodes binary, small binary, scale binary, error binary, axis array<double>, width double"
    blocks = scratch.table(vectors.groupBy("dims", "block").applyInArrow(_gathered, made))
    sizes = blocks.groupBy("dims").count().agg(F.max("count"), F.max("dims")).first()
    n_slices, tiles = slices(sizes[0] or 0, sizes[1] or 0), None
    for at in range(n_slices):
        cones = blocks.select("dims", "block", "axis", "width").where(F.pmod(F.xxhash64("block"), F.lit(n_slices)) == at).toArrow()
        dims = cones.column("dims").to_numpy()
        by_dims = {int(d): (own.column("block").to_numpy(), matrix(own, "axis"), own.column("width").to_numpy()) for d in np.unique(dims) for own in [cones.filter(pa.array(dims == d))]}
        near = scratch.table(blocks.select("dims", "block", "axis", "width").mapInArrow(lean(_near(by_dims, threshold)), "dims int, low long, high long"))
        tiles = near if tiles is None else tiles.unionByName(near)
    given = blocks.drop("axis", "width")
    sides = tiles.select("dims", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    whole = sides.join(given, ["dims", "block"]).groupBy("dims", "low", "high")
    found = scratch.table(whole.applyInArrow(lambda t: _multiply(t, threshold), "dims int, low long, high long, node long, n_links long, root long, side int"))
    open_ = found.where("root IS NULL").drop("n_links", "root")
    full = open_.join(vectors.select("node", "embedding"), "node").groupBy("dims", "low", "high")
    settled = full.applyInArrow(lambda t: _settle(t, threshold), "node long, n_links long, root long")
    return found.where("root IS NOT NULL").select("node", "n_links", "root").unionByName(settled)


def classes(embeddings: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``embeddings``."""
    usable = is_usable() & F.exists("embedding", lambda x: x != 0)
    rows = scratch.table(
        embeddings.select(F.col("vec_id").cast("long"), F.when(usable, F.col("embedding")).alias("embedding"), F.monotonically_increasing_id().alias("node"))
    )
    found = scratch.table(links(rows.where("embedding IS NOT NULL"), scratch, threshold, block))
    degrees = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    labels = components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    each = rows.select("vec_id", "node").join(degrees, "node", "left").join(labels, "node", "left")
    each = scratch.table(each.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "node").alias("label")))
    least = each.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    out = joined(scratch, each, least, "label").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return scratch.keep(out)
