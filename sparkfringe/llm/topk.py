"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Candidates that lie near each other are dealt into shards, each with a ball tree (centre and radius per node). The inner product
of a query with anything in a node is at most q . centre + |q| * radius; a node is left out if that is
below the query's k-th score so far. A batch of queries goes down the tree together; at every node the
queries split by which child promises more and go there first, then to the other with what the first has
taught. Shards are gone through in waves: a query's own shard, the one that promises most, the next four, and the others; before
each wave the k-th scores of all waves before are shared, and shards whose ball is below them are left out. A tree is built
once and goes to a task with at most ``BATCH`` queries.

Vectors are integers: each component x becomes floor(256 * x). Vectors that are null, empty or hold null or non-finite
components, and rows without vec_id, take no part; vectors of different lengths don't meet. Scores
beyond 64 bits stop at the largest long. Ties go to the smaller vec_id. A query's own rows (its
vec_id) are no candidates; repeated query rows get results each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean
from .embedding_dup import is_usable
from .space import dealt, matrix, slices

K = 5
SHARD, LEAF, BATCH = 16_384, 256, 2048
LONG = 2**63 - 1
#: Shards by promise that a wave looks at, queries whose shards are ranked at a time, and rows of a batch that goes on.
WAVES, ASKED, ROWS = ((0, 1), (1, 5), (5, None)), 64, 1000


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x): 64-bit integers where they and their scores fit in a double, else Python's."""
    scaled = np.floor(values.astype(float) * 256.0) if np.abs(values).max(initial=0) < 1e300 else None
    if scaled is not None and np.abs(scaled).max(initial=0) ** 2 * max(1, values.shape[1]) < 2**53:
        return scaled
    exact = [[int(x) * 256 if abs(x) > 2**60 else int(np.floor(x * 256.0)) for x in row] for row in values.astype(float).tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact scores as 64-bit integers."""
    if queries.dtype == object or candidates.dtype == object or (np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * queries.shape[1]) >= 2**53:
        exact = [[int(x) for x in row] for row in queries.tolist()], [[int(x) for x in row] for row in candidates.tolist()]
        a, b = (np.array(x, dtype=object).reshape(-1, queries.shape[1]) for x in exact)
        return np.clip(a @ b.T, -LONG - 1, LONG).astype(np.int64)
    return (queries @ candidates.T).astype(np.int64)


class BallTree:
    """Nodes in a list: (first, last, left, right, centre, radius) over vectors in tree order."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.points = vectors.astype(float)
        self.nodes: list[list] = []
        self._build(0, len(vectors), leaf)
        self.vectors, self.ids = vectors[self.order], ids[self.order]

    def _build(self, first: int, last: int, leaf: int) -> int:
        own = self.points[self.order[first:last]]
        centre = own.mean(0)
        away = np.linalg.norm(own - centre, axis=1)
        me = len(self.nodes)
        self.nodes.append([first, last, -1, -1, centre, away.max()])
        if last - first > leaf and away.max() > 0:
            one = own[away.argmax()]
            two = own[np.linalg.norm(own - one, axis=1).argmax()]
            along = own @ (two - one)
            half = (last - first) // 2
            self.order[first:last] = self.order[first:last][np.argpartition(along, half)]
            self.nodes[me][2] = self._build(first, first + half, leaf)
            self.nodes[me][3] = self._build(first + half, last, leaf)
        return me


class Search:
    """The best of one tree for a batch of queries; ``bounds`` are the k-th scores known so far."""

    def __init__(self, tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int):
        self.tree, self.queries, self.query_ids, self.k = tree, queries, query_ids, k
        self.points = queries.astype(float)
        self.lengths = np.linalg.norm(self.points, axis=1)
        self.bounds = bounds
        self.scores = np.full((len(queries), k), -LONG - 1, np.int64)
        self.found = np.full((len(queries), k), LONG, np.int64)  # LONG: none
        self.full = np.zeros(len(queries), bool)
        if len(queries):
            every = np.arange(len(queries))
            self._visit(0, every, self._most(0, every))

    def _most(self, node: int, active: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in a node, above rounding errors."""
        _, _, _, _, centre, radius = self.tree.nodes[node]
        size = self.lengths[active] * (np.linalg.norm(centre) + radius)
        return self.points[active] @ centre + self.lengths[active] * radius + 1e-9 * size + 1e-6

    def _visit(self, node: int, active: np.ndarray, most: np.ndarray) -> None:
        active = active[~(most < self.bounds[active])]
        if not len(active):
            return
        first, last, left, right, _, _ = self.tree.nodes[node]
        if left < 0:
            self._score(first, last, active)
            return
        to_left, to_right = self._most(left, active), self._most(right, active)
        leftward = to_left >= to_right
        for part, order in ((leftward, ((left, to_left), (right, to_right))), (~leftward, ((right, to_right), (left, to_left)))):
            if part.any():
                for child, bound in order:
                    self._visit(child, active[part], bound[part])

    def _score(self, first: int, last: int, active: np.ndarray) -> None:
        ids = self.tree.ids[first:last]
        scores = products(self.queries[active], self.tree.vectors[first:last])
        valid = (ids[None, :] != self.query_ids[active, None]) & (scores >= self.bounds[active, None])
        for row in np.flatnonzero(valid.any(1)):
            q, own = active[row], np.flatnonzero(valid[row])
            s = np.concatenate([self.scores[q], scores[row, own]])
            i = np.concatenate([self.found[q], ids[own]])
            best = np.lexsort((i, -s.astype(float) if abs(s[s > -LONG]).max(initial=0) < 2**53 else np.array([-int(x) for x in s], dtype=object)))[: self.k]
            self.scores[q], self.found[q] = s[best], i[best]
            if self.found[q, -1] != LONG:
                self.bounds[q] = max(self.bounds[q], self.scores[q, -1])

    def rows(self, nodes: np.ndarray) -> dict:
        q, r = np.nonzero(self.found != LONG)
        return {"query": nodes[q], "query_id": self.query_ids[q], "vec_id": self.found[q, r], "score": self.scores[q, r]}


def _rooted(table: pa.Table, leaf: int) -> pa.Table:
    """One row of a shard: its tree, and its ball."""
    tree = BallTree(integers(matrix(table, "embedding")), table.column("vec_id").to_numpy(), leaf)
    centre, radius = tree.nodes[0][4:]
    tree.points = None
    narrow = tree.vectors.dtype != object and np.abs(tree.vectors).max(initial=0) < 2**15
    tree.vectors = tree.vectors.astype(np.int16) if narrow else tree.vectors
    return pa.table({"dims": table.column("dims")[:1], "block": table.column("block")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary()), "centre": pa.array([centre.tolist()]), "radius": pa.array([float(radius)])})


def _look(trees: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    out: dict = {"query": np.empty(0, np.int64), "query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)}
    if trees.num_rows and asked.num_rows:
        tree = pickle.loads(trees.column("tree")[0].as_py())
        tree.vectors = tree.vectors.astype(float) if tree.vectors.dtype != object else tree.vectors
        points, ids = integers(matrix(asked, "query")), asked.column("query_id").to_numpy()
        out = Search(tree, points, ids, asked.column("bound").to_numpy().copy(), k).rows(asked.column("node").to_numpy())
    return pa.table(out)


def search(embeddings: DataFrame, scratch: Scratch, is_query: Column, k: int = K, shard: int = SHARD, leaf: int = LEAF, batch: int = BATCH) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of every row that ``is_query`` holds for."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & is_usable()).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.size("embedding").alias("dims"), F.monotonically_increasing_id().alias("node"), is_query.alias("is_query")
    )
    rows = dealt(rows, scratch, shard)
    made = "dims int, block long, tree binary, centre array<double>, radius double"
    trees = scratch.table(rows.select("dims", "block", "vec_id", "embedding").groupBy("dims", "block").applyInArrow(lambda t: _rooted(t, leaf), made))
    queries = rows.where("is_query").select("dims", F.col("block").alias("home"), F.col("vec_id").alias("query_id"), "node", F.col("embedding").alias("query"))
    none = F.lit(-LONG - 1).cast("long")

    def searched(asked: DataFrame) -> DataFrame:
        asked = scratch.table(asked)
        many = asked.groupBy("dims", "block").agg(F.ceil(F.count("*") / batch).cast("long").alias("many"))
        asked = asked.join(many, ["dims", "block"]).withColumn("batch", F.pmod(F.xxhash64("node", F.lit(3)), F.col("many"))).drop("many")
        given = trees.select("dims", "block", "tree").join(many, ["dims", "block"]).select("dims", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("batch"), "tree")
        on = ("dims", "block", "batch")
        return scratch.table(given.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(lambda a, b: _look(a, b, k), "query long, query_id long, vec_id long, score long"))

    found = searched(queries.select("dims", F.col("home").alias("block"), "query_id", "node", "query", none.alias("bound")))
    shards = trees.groupBy("dims").count().agg(F.sum("count"), F.max("count"), F.max("dims")).first()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    n_slices = slices(shards[1] or 0, shards[2] or 0)
    for at in range(n_slices if (shards[1] or 0) > 1 else 0):
        balls = trees.select("dims", "block", "centre", "radius").where(F.pmod(F.xxhash64("block"), F.lit(n_slices)) == at).toArrow()
        by_dims = _balls(balls)
        for low, high in WAVES:
            if not any(len(b[0]) > low for b in by_dims.values()):
                break
            found = scratch.table(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
            kth = found.groupBy(F.col("query").alias("node")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
            known = queries.join(kth, "node", "left").select("dims", "home", "query_id", "node", "query", F.coalesce("bound", none).alias("bound"))
            kinds = "dims int, block long, query_id long, node long, query array<double>, bound long"
            asked = known.mapInArrow(lean(_promising(by_dims, low, high)), kinds)
            found = found.unionByName(searched(asked))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return scratch.keep(ranked.select("query_id", "rank", "vec_id", "score"))


def _balls(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks, centres and radii of each length of vectors."""
    dims = table.column("dims").to_numpy()
    return {int(d): (own.column("block").to_numpy(), matrix(own, "centre"), own.column("radius").to_numpy()) for d in np.unique(dims) if (own := table.filter(pa.array(dims == d))).num_rows}


def _promising(balls: dict, low: int, high: int | None):
    """Queries once for each shard whose ball may hold a better score, of those from the ``low``-th to the ``high``-th by promise."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                if int(d) not in balls:
                    continue
                blocks, centres, radii = balls[int(d)]
                points, bounds = integers(matrix(own, "query")).astype(float), own.column("bound").to_numpy()
                for at in range(0, len(points), ASKED):
                    part = points[at : at + ASKED]
                    size = np.linalg.norm(part, axis=1)
                    far = size[:, None] * radii[None, :]
                    most = part @ centres.T + far + 1e-9 * (size[:, None] * np.linalg.norm(centres, axis=1)[None, :] + far) + 1e-6
                    at_home = blocks[None, :] == own.column("home").to_numpy()[at : at + ASKED, None]
                    most[at_home] = -np.inf
                    place = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1, kind="stable")
                    wanted = (place >= low) & ~(most < bounds[at : at + ASKED, None]) & ~at_home
                    q, b = np.nonzero(wanted & (place < high) if high is not None else wanted)
                    for first in range(0, len(q), ROWS):
                        rows = own.take(pa.array(q[first : first + ROWS] + at))
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("dims"), pa.array(blocks[b[first : first + ROWS]], pa.int64()), *(rows.column(c) for c in ("query_id", "node", "query", "bound"))],
                            ["dims", "block", "query_id", "node", "query", "bound"],
                        )

    return ask
