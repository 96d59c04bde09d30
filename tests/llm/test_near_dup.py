"""Near-duplicates against all pairs compared."""

import random
import re
from collections import Counter

import numpy as np

from sparkfringe.llm import near_dup
from sparkfringe.llm.common import Scratch, components

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def edited(words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        at = RNG.randrange(len(out))
        match RNG.randrange(3):
            case 0:
                out[at] = RNG.choice(VOCABULARY)
            case 1:
                out.insert(at, RNG.choice(VOCABULARY))
            case _:
                del out[at]
    return out


def similar(a: list[str], b: list[str]) -> float:
    """Words in common, in order, by the table of all places."""
    if 9 * min(len(a), len(b)) < 4 * (len(a) + len(b)) or 9 * (Counter(a) & Counter(b)).total() < 4 * (len(a) + len(b)):
        return 0.0
    names = {w: k for k, w in enumerate({*a, *b})}
    of_b, row = np.array([names[w] for w in b]), np.zeros(len(b) + 1, int)
    for w in a:
        row = np.maximum.accumulate(np.concatenate([[0], np.maximum(row[1:], row[:-1] + (of_b == names[w]))]))
    return row[-1] / (len(a) + len(b) - row[-1])


def brute(rows: list[tuple]) -> list[tuple]:
    """Classes of the texts' words by all pairs, then the smallest doc_id of each."""
    words = [(re.findall(r"\w+", t.lower()) or t.lower().split()) if t else [] for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if words[a] and words[b] and top(a) != top(b) and (words[a] == words[b] or similar(words[a], words[b]) >= 0.8):
                label[top(a)] = top(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, i if not words[k] else least.get(top(k))) for k, (i, _) in enumerate(rows)), key=str)


def fixture() -> list[tuple]:
    rows, base = [], []
    for _ in range(25):
        own = [RNG.choice(VOCABULARY) for _ in range(RNG.randint(3, 300))]
        base.append(own)
        rows.append(own)
        for _ in range(RNG.randint(0, 4)):
            rows.append(edited(own, max(1, len(own) // RNG.choice([40, 60, 100]))))
        rows += [list(own)] * RNG.randint(0, 3)
    hot = [RNG.choice(VOCABULARY) for _ in range(200)]
    rows += [edited(hot, RNG.randint(2, 9)) for _ in range(60)]  # many pairs near the threshold
    texts = [" ".join(x) for x in rows] + [None, "", "  \n", "%% ##", "%% ##", "One two", "one, TWO", "x " * 5000, "x " * 5000]
    RNG.shuffle(texts)
    return [(k * 3 + 1 if k % 40 else None, t) for k, t in enumerate(texts)]


def test_classes_are_those_of_all_pairs(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS words")
    with Scratch(spark) as scratch:
        out = near_dup.classes(docs, scratch)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_one_document_of_a_class_stays(spark):
    same = " ".join(VOCABULARY[:50])
    docs = spark.createDataFrame([(3, same), (3, same), (2, same + " x"), (9, "other text"), (None, None), (None, None)], "doc_id long, text string")
    with Scratch(spark) as scratch:
        assert sorted(r.doc_id or 0 for r in near_dup.without_copies(docs, scratch).collect()) == [0, 0, 2, 9]
        assert near_dup.without_copies(docs.limit(0), scratch).count() == 0


def test_alignment_is_that_of_the_whole_table():
    words = VOCABULARY[:100]
    assert near_dup.alignment(words, words) == 1.0 and near_dup.alignment(words, words[50:] + words[:50]) == 0.0
    assert len(np.unique(near_dup.windows(["x"] * 50, near_dup._Hashes()))) == 46
    rng = random.Random(11)
    for _ in range(3000):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 50))]
        b = edited(a, rng.randint(0, 1 + len(a) // 6)) if len(a) > 20 else [rng.choice("abcdefghij") for _ in range(rng.randint(1, 20))]
        b = b if rng.random() < 0.8 else [x if len(x) == 1 else "j" for x in b]
        want = similar(a, b)
        assert near_dup.alignment(a, b) == (want if want >= 0.8 else 0.0)


def test_recall_of_edited_texts():
    """Of texts of which some words of a hundred are edited, those that meet in a bucket; all aligned ones count."""
    known = near_dup._Hashes()
    for rate, least in ((0.02, 0.99), (0.04, 0.97), (0.06, 0.9)):
        met = tried = 0
        for _ in range(300):
            a = [RNG.choice(VOCABULARY) for _ in range(RNG.randint(40, 400))]
            b = edited(a, max(1, round(rate * len(a))))
            if similar(a, b) >= 0.8:
                tried += 1
                met += bool(set(near_dup.buckets(near_dup.windows(a, known)).tolist()) & set(near_dup.buckets(near_dup.windows(b, known)).tolist()))
        assert tried > 250 and met >= least * tried


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.range(2).selectExpr("id + 500 AS a", "501 AS b"))
    with Scratch(spark) as scratch:
        out = {r.node: r.label for r in components(scratch, edges).collect()}
    assert out == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_no_short_pair_is_missed():
    rng, known = random.Random(8), near_dup._Hashes()
    for k in range(30_000):
        words = [f"w{k}x{j}" for j in range(rng.choice([8, 9, 13, 20, 24]))]
        n = len(words) - near_dup.WINDOW + 1
        a, b = near_dup.windows(words, known), near_dup.windows([*words[: len(words) - n // 5], *(["z"] if k % 2 else [])], known)
        common = len(np.intersect1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            assert set(near_dup.buckets(a).tolist()) & set(near_dup.buckets(b).tolist())


def test_short_texts_meet_longer_ones():
    rng = np.random.default_rng(3)
    for n in range(1, 26):
        for m in range(n, 32):
            for _ in range(20):
                for common in range(1, n + 1):
                    if common / (n + m - common) >= 0.8 and n <= 20:
                        every = rng.integers(1, 2**63, n + m - common, dtype=np.uint64)
                        a, b = every[:n], every[n - common :]
                        assert set(near_dup.buckets(a).tolist()) & set(near_dup.buckets(b).tolist())


def test_rows_of_one_doc_id_are_told_apart_by_their_words(spark):
    a, b, c, d = (" ".join(VOCABULARY[k : k + 40]) for k in (0, 50, 100, 150))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, d.upper()), (8, ""), (8, ""), (8, d), (None, c), (None, "only here and there"), (None, "Only here, and there"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' AS key", "1 AS row")
    with Scratch(spark) as scratch:
        left = near_dup.without_copies(docs, scratch)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text and r.text.lower().replace(",", "")) for r in left.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, c), (7, d), (8, ""), (None, "only here and there"), (None, None)], key=str)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from sparkfringe.llm import common

    monkeypatch.setattr(common, "HOT", 50)
    left = spark.range(400).selectExpr("id", "CASE WHEN id < 150 THEN 1 WHEN id < 290 THEN NULL WHEN id < 360 THEN 9 ELSE id END AS k")
    right = spark.createDataFrame([(1, "a"), (360, "b"), (399, "c"), (1000, "d")], "k long, v string")
    with Scratch(spark) as scratch:
        for how in ("inner", "left"):
            got = common.joined(scratch, left, right, "k", how)
            assert sorted(got.select("id", "v").collect(), key=str) == sorted(left.join(right, "k", how).select("id", "v").collect(), key=str)
        edges = spark.range(300).selectExpr("0 AS a", "id + 1 AS b").union(spark.range(120).selectExpr("id + 300 AS a", "id + 301 AS b"))
        assert {r.label for r in components(scratch, edges).collect()} == {0}


def test_kept_tables_go_with_their_block(spark):
    import os

    from sparkfringe.llm.common import releasing, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with releasing(spark):
        with Scratch(spark) as scratch:
            table = scratch.keep(spark.range(3))
        assert table.count() == 3 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_thinned_links_connect_the_same(spark):
    rng = random.Random(21)
    links = sorted({(a, b) for _ in range(120) for a, b in [sorted(rng.sample(range(90), 2))]})
    df = spark.createDataFrame(links, "a long, b long")
    with Scratch(spark) as scratch:
        want, got = ({r.node: r.label for r in components(scratch, x).collect()} for x in (df, near_dup.thinned(df)))
    assert want == got
