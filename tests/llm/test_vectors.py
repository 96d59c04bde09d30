"""Top-k search and embedding near-duplicates against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sparkfringe.llm import embedding_dup, topk
from sparkfringe.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    rows = [v for b in base for v in b + rng.normal(size=(rng.integers(1, 8), 16)).astype(np.float32) * rng.choice([0.1, 0.3, 0.33])]
    rows += [rows[0]] * 30
    rows += [2 * rows[3], 1e-30 * rows[4], -rows[5]]
    out = [(k, [float(x) for x in v], k) for k, v in enumerate(rows)]
    n = len(out)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    out += [(n + k, v, 0) for k, v in enumerate(odd)] + [(None, out[1][1], None), (7, out[7][1], 7)]
    return out


def fine(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def test_topk_is_that_of_brute_force(spark):
    rows = vectors()
    want = []
    for q, v, _ in rows:
        if q is None or q % 5 or not fine(v):
            continue
        best = sorted((-int(np.floor(256 * np.array(v)).astype(object) @ np.floor(256 * np.array(w)).astype(object)), i) for i, w, _ in rows if i is not None and i != q and fine(w) and len(w) == len(v))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).repartition(3)
    for shard in (30, 10_000):
        with Scratch(spark) as scratch:
            out = topk.search(df, scratch, F.col("vec_id") % 5 == 0, shard=shard, leaf=4)
        assert sorted(map(tuple, out.collect())) == sorted(want)
    with Scratch(spark) as scratch:
        assert topk.search(df.limit(0), scratch, F.lit(True)).count() == 0


def test_large_components_are_exact():
    a = topk.integers(np.array([[1e12, -3.5e9, 0.001]]))
    assert topk.products(a, a)[0, 0] == min(topk.LONG, sum(x * x for x in (256 * 10**12, -896 * 10**9, 0)))
    b = topk.integers(np.array([[1e8, 1.0, 2.0]]))
    c = topk.integers(np.array([[3e5, 5.0, -1.0]]))
    assert topk.products(b, c)[0, 0] == 256 * 10**8 * 256 * 3 * 10**5 + 256 * 1280 - 512 * 256


def test_links_are_those_of_all_pairs(spark):
    rows = vectors()
    own = [np.array(v, float) if fine(v) and any(v) else None for _, v, _ in rows]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if own[a] is not None and own[b] is not None and len(own[a]) == len(own[b]):
                if own[a] @ own[b] / np.linalg.norm(own[a]) / np.linalg.norm(own[b]) >= 0.9:
                    links[a].add(b)
                    links[b].add(a)
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        want.append((i, len(links[k]), least, i == least))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).repartition(3)
    for block in (25, 10_000):
        with Scratch(spark) as scratch:
            out = embedding_dup.classes(df, scratch, block=block)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    with Scratch(spark) as scratch:
        assert embedding_dup.classes(df.limit(0), scratch).count() == 0


def test_error_bounds_hold():
    side = embedding_dup.Side(np.random.default_rng(1).normal(size=(300, 64)))
    about = (side.small @ side.small.T) * side.scale[:, None] * side.scale[None, :]
    e = side.error
    assert (np.abs(about - side.unit @ side.unit.T) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + embedding_dup.SLACK).all()
