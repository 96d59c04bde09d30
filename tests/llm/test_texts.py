"""Chat formatting, mixing and line deduplication: round trips, brute force and odd rows."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from sparkfringe.llm import chat_format, line_dedup, mixing
from sparkfringe.llm.common import Scratch


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", "<\\|", "<\\\\|im_end|>\n", "é😀", "$1", "%0A", "%25", " "]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "sys\ntem%", "", None, "<|im_end|>\n"])
            text = rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))])
            rows.append((c if c else None, t if rng.random() < 0.9 else None, role, text))
    rows += [rows[5], (99, 0, "user", "x" * 200_000), (99, 1, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.prefix_targets(df)).collect()}
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat_format.prefix_targets(df).where("conv_id = 99").collect()
    assert [(e.target, e.loss_length) for e in examples] == [(1, 200_000)]
    assert chat_format.digests(chat_format.prefix_targets(df.limit(0))).count() == 0


def water(sizes: list[int], weights: list[int], epochs: int) -> list[float]:
    """By rounds: clamp what is above, share the rest again."""
    total, clamped = float(sum(sizes)), set()
    while True:
        left = total - sum(epochs * sizes[k] for k in clamped)
        open_ = [k for k in range(len(sizes)) if k not in clamped]
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > epochs * sizes[k]}
        if not over:
            return [float(epochs * s) if k in clamped else share[k] for k, s in enumerate(sizes)]
        clamped |= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = []
    for k, source in enumerate(["a", "B", "é", "z", "", None, "hot"]):
        for _ in range([5, 40, 200, 3, 60, 30, 800][k]):
            rows.append((len(rows), source, "w " * rng.randint(0, 30), "x"))
    rows += [(5000, "empty", None, None), (5001, "empty", " \t", None), (None, "hot", "null id", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    with Scratch(spark) as scratch:
        sized = scratch.table(mixing.sizes(df))
        out = mixing.with_repeats(sized, mixing.plan(sized, scratch)).collect()
        taken = Counter(r.doc_id for r in mixing.mix(df, scratch).collect())
        assert mixing.mix(df.limit(0), scratch).count() == 0
    assert len(out) == len(rows)
    names = sorted({r.source for r in out}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r.size for r in out if r.source == n) for n in names]
    want = dict(zip(names, water(sizes, [[5, 2, 1][k % 3] for k in range(len(names))], 3), strict=True))
    for n, s in zip(names, sizes, strict=True):
        own = [r for r in out if r.source == n]
        assert {r.source_size for r in own} == {s} and all(abs(r.target - want[n]) < 1e-6 for r in own)
        assert abs(sum(r.size * r.repeats for r in own) - want[n]) <= 31 and all(r.repeats <= 3 for r in own)
    assert all(taken[i] == sum(r.repeats for r in out if r.doc_id == i) for i in {r.doc_id for r in out})


def test_repeated_line_chunks_go(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["aa", "b", "ccc", "dd"]) for _ in range(6))
    shared = [line() for _ in range(30)]
    rows = [(k, "\n".join([line() for _ in range(rng.randint(0, 9))] + (shared if k % 2 else []) + [line() for _ in range(rng.randint(0, 9))])) for k in range(40)]
    rows += [(100, rows[1][1]), (1, rows[1][1]), (101, None), (102, ""), (103, "one line"), (104, "one line"), (None, rows[1][1]), (105, "\n\n\n" * 50), (106, "z" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "'q' AS marks")
    first: dict = {}
    for i, text in rows:
        for k, c in enumerate(line_dedup.chunks(text)) if i is not None and text is not None else ():
            if line_dedup._counts(c):
                first[c] = min(first.get(c, (i, k)), (i, k))
    want = []
    for i, text in rows:
        kept = text
        if i is not None and text is not None:
            parts = line_dedup.chunks(text)
            assert "\n".join(parts) == text
            kept = "\n".join(c for k, c in enumerate(parts) if c not in first or first[c] == (i, k))
        want.append((i, kept))
    with Scratch(spark) as scratch:
        out = line_dedup.dedup(df, scratch)
        assert out.columns == [*df.columns, "removed_chunks", "removed_lines"]
        assert line_dedup.dedup(df.limit(0), scratch).count() == 0
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.removed_lines for r in got) > 20 * 15


def test_chunks_that_share_a_hash_are_told_apart(spark, monkeypatch):
    rows = [(1, "a\nb"), (2, "c\nd"), (3, "a\nb"), (4, "c\nd")]
    monkeypatch.setattr(line_dedup, "_hash", lambda chunk: 7)
    monkeypatch.setattr(line_dedup, "chunks", lambda text: [text])
    with Scratch(spark) as scratch:
        marks = line_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted(r.doc_id for r in marks) == [3, 4]


def test_whole_passages_go_wherever_they_stand(spark):
    rng = random.Random(6)
    count = iter(range(10**6))
    line = lambda n: " ".join(f"w{next(count)}" for _ in range(n))
    around = lambda: [line(rng.randint(1, 12)) for _ in range(rng.randint(0, 4))]
    rows, want = [], {}
    for n in [*range(2, 11)] * 6:
        sizes = [rng.randint(1, 9) for _ in range(n)]
        sizes[rng.randrange(n)] += max(0, 51 - sum(sizes))  # over 50 words, with lines of one word among them
        passage = [line(k) for k in sizes]
        passage[1:1] = [""] * rng.randint(0, 2)
        for copy in range(2):
            before, after = around(), around()
            want[len(rows)] = "\n".join([*before, *([] if copy else passage), *after])
            rows.append((len(rows), "\n".join([*before, *passage, *after])))
    rows += [(500, "Yes.\nNo.\nYes.\nNo.\nYes."), (501, "Yes."), (502, "x\nx\nx\nx"), (503, "Yes.\nelse")]
    want |= {500: "Yes.\nNo.", 501: "Yes.", 502: "x\nx", 503: "Yes.\nelse"}
    with Scratch(spark) as scratch:
        got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got == want
