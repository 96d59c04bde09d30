"""Blocks of vectors that lie near each other.

Planes through the medians of a bounded sample (of at most ``SAMPLE_BYTES``) part space; every vector goes to the side it is on, and
what is still too large for a block, such as a group of copies, is parted by a hash. Results never depend on how vectors are dealt,
only the number of blocks that bounds rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

#: Bytes of the sample that planes are fitted on, its least vectors per part, and bytes of balls looked at in one go.
SAMPLE_BYTES, PER_PART, BALL_BYTES = 1 << 25, 8, 1 << 26
SUBS = 1 << 24


def matrix(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """The vectors of a column, all of one length."""
    values = table.column(name)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(float)


class Planes:
    """A tree of planes: direction, cut and the two children, or the number of a part as -1 - part."""

    def __init__(self, points: np.ndarray, parts: int):
        self.direction: list[np.ndarray] = []
        self.cut: list[float] = []
        self.children: list[list[int]] = []
        self.parts = 0
        self.root = self._split(points, parts)

    def _split(self, points: np.ndarray, parts: int) -> int:
        if parts > 1 and len(points) >= 2 * PER_PART:
            one = points[np.linalg.norm(points - points.mean(0), axis=1).argmax()]
            way = points[np.linalg.norm(points - one, axis=1).argmax()] - one
            along = points @ way
            cut = float(np.median(along))
            right = along > cut
            if right.any() and not right.all():
                me = len(self.cut)
                self.direction.append(way)
                self.cut.append(cut)
                self.children.append([0, 0])
                self.children[me] = [self._split(points[~right], parts // 2), self._split(points[right], parts - parts // 2)]
                return me
        self.parts += 1
        return -self.parts

    def route(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                right = points[own] @ self.direction[node] > self.cut[node]
                todo += [(self.children[node][0], own[~right]), (self.children[node][1], own[right])]
        return out


def unit(points: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision, whatever their size."""
    points = points / np.abs(points).max(1, initial=1e-300)[:, None]
    return points / np.linalg.norm(points, axis=1)[:, None]


def dealt(rows: DataFrame, scratch: Scratch, size: int, scaled: bool = False) -> DataFrame:
    """``rows`` (node, embedding, dims, ...) with ``block``, a number for at most about ``size`` vectors of one length; ``scaled``
    looks at directions alone. Vectors of other lengths than the most common one are parted by the hash only."""
    rows = scratch.table(rows)
    common = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return rows.withColumn("block", F.lit(0).cast("long"))
    dims, n = common["dims"], common["count"]
    wanted, planes = -(-n // size), None
    if wanted > 1:
        most = max(2 * PER_PART, SAMPLE_BYTES // (8 * dims))
        share = min(1.0, 1.2 * most / n)
        sample = rows.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000))
        points = matrix(sample.select("embedding").limit(most).toArrow(), "embedding")
        if len(points):
            planes = Planes(unit(points) if scaled else points, min(wanted, len(points) // PER_PART))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch, "embedding")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(planes.route(unit(points) if scaled else points), pa.int64())], ["node", "part"])

    if planes is None or planes.parts < 2:
        found = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        parts = rows.where(F.col("dims") == dims).select("node", "embedding").mapInArrow(lean(part), "node long, part long")
        found = rows.join(parts, "node", "left").fillna(0, ["part"])
    found = scratch.table(found)
    subs = found.groupBy("dims", "part").agg(F.ceil(F.count("*") / size).cast("long").alias("subs"))
    number = F.col("part") * SUBS + F.pmod(F.xxhash64("node"), F.col("subs"))
    return scratch.table(found.join(subs, ["dims", "part"]).withColumn("block", number).drop("part", "subs"))


def slices(n: int, dims: int) -> int:
    """How many parts the balls of ``n`` blocks are looked at in, so that what tasks are given is bounded."""
    return max(1, -(-n * (dims + 2) * 8 // BALL_BYTES))
