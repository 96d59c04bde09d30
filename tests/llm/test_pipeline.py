"""The pipeline against a brute-force version of all its stages."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from sparkfringe.llm import line_dedup, near_dup, queries, toxicity
from sparkfringe.llm.common import Scratch

from test_near_dup import brute as near_brute
from test_texts import water

pytest.importorskip("public_tokenizers")


def rows() -> tuple[list, list]:
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    shared = [line(9) for _ in range(12)]
    docs, labels = [], []
    for k in range(260):
        lines = [line(rng.randint(3, 25)) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.2:
            lines[1:1] = shared
        toxic = rng.random() < 0.2
        if toxic:
            lines[-1] += " " + rng.choice(["idiot", "moron", "scum"])
        docs.append((k, "\n".join(lines), rng.choice(["en", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None]), 7))
        labels.append((k, 1, int(toxic)))
    long = line(4000)
    docs += [(300, docs[0][1], "en", "s2", 1), (301, docs[1][1].replace("a", "A", 1), "en", "s4", 1), (302, long, "en", "s5", 1), (303, None, "en", "s1", None), (304, "", "en", "s1", 0), (305, docs[5][1] + " more", None, None, None)]
    return docs, labels


def expected(docs: list, model: toxicity.Model) -> Counter:
    docs = [d for d in docs if model.score(d[1]) < 0.7]
    first: dict = {}
    for d in docs:
        for k, c in enumerate(line_dedup.chunks(d[1])) if d[1] is not None else ():
            if line_dedup._counts(c):
                first[c] = min(first.get(c, (d[0], k)), (d[0], k))
    left = []
    for d in docs:
        text = d[1]
        if text is not None:
            text = "\n".join(c for k, c in enumerate(line_dedup.chunks(text)) if c not in first or first[c] == (d[0], k))
        if text == d[1] or text.strip():
            left.append((d[0], text, *d[2:]))
    classes = dict(near_brute([(d[0], d[1]) for d in left]))
    left = [d for d in left if classes[d[0]] == d[0]]
    size = lambda t: len(queries_words(t))
    by = defaultdict(list)
    for d in left:
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        by[d[3]].append((md5(f"mix-1|{d[0]}|{md5(d[1] or '')}"), size(d[1]), d))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(x[1] for x in by[n]) for n in names]
    taken: list = []
    for n, total, goal in zip(names, sizes, water(sizes, [[5, 2, 1][k % 3] for k in range(len(names))], 3), strict=True):
        whole = int(goal // total) if total else 0
        rest, upto = goal - whole * total, 0
        for _, s, d in sorted(by[n], key=lambda x: x[:2]):
            upto += s
            taken += [d] * (whole + (rest > 0 and 2 * upto - s < 2 * rest))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out: Counter = Counter()
    for d in taken:
        ids = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            out[d[0], k // 2048, k, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    return out


def queries_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_pipeline_is_that_of_brute_force(spark, tmp_path):
    docs, labels = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    with Scratch(spark) as scratch:
        model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), scratch)
    want = expected(docs, model)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    total = sum(k[3] * n for k, n in want.items())
    assert len({r.sequence_id for r in out}) <= total / 2048 * 1.05 + 2


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels = rows()
    df = spark.createDataFrame(docs[:80], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "2 AS size", "3 AS key")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).schema.simpleString() == df.schema.simpleString()


def test_copies_leave_no_scraps(spark, tmp_path):
    rng = random.Random(12)
    count = iter(range(10**6))
    docs = []
    for n in [1, 2, 3, 5, 8, 13] * 5:
        lines = [" ".join(f"w{next(count)}" for _ in range(rng.randint(1, 14))) for _ in range(n)]
        lines[rng.randrange(n + 1) : 0] = rng.choice([[], [""], ["\u3000"], ["\x0b"]])
        docs += [(len(docs) + k, "\n".join(lines), "en", "s1", 1) for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_repeated_lines(spark, df, str(tmp_path))
    assert {r.doc_id for r in left.collect() if r.doc_id % 3} <= {d[0] for d in docs if len(d[1].split()) < 6 and len(d[1].split("\n")) < 3}
    out = corpus_pipeline.drop_near_copies(spark, left, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [d[:2] for d in docs[::3]]
