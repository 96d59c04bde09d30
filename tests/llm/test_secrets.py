"""The combined automaton against Python's own regular expressions."""

import random
import re

from sparkfringe.llm import secrets

PIECES = [
    "token", "secret", "passwd", "Password", "api_key", "APIKEY", " ", "  ", ":", "=", '"', "'", "AKIA", "abcdef0123",
    "0123456789abcdef" * 2, "ABCD1234EFGH", "é", "x", "\n", "-", "ghp_", "A" * 36, "xoxb-", "-----BEGIN PRIVATE KEY-----",
    "-----BEGIN RSA ", "PRIVATE KEY-----", "zz.z", "ſ",
]


def brute(data: bytes, rules) -> list:
    found = []
    for k, r in enumerate(rules):
        for m in re.compile(r.regex.encode(), re.I * r.any_case).finditer(data):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_matches_are_those_of_regular_expressions():
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    rng = random.Random(1)
    for _ in range(8000):
        data = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))).encode()
        assert secrets.scanner(rules).matches(data) == brute(data, rules), data


def test_minimised_arrays_have_one_row_per_state():
    automaton = secrets.scanner(secrets.BASE_RULES).all
    assert len({(tuple(row), a, tuple(sorted(d.items()))) for row, a, d in zip(automaton.to, automaton.accepts, automaton.dropped)}) == len(automaton.to)


def test_rows(spark):
    text = "é token = abcdefgh1, AKIA" + "B" * 12 + " " + "0a" * 20
    rows = [(1, text), (2, None), (3, ""), (4, "token=short"), (4, "token=short"), (5, "x" * 300_000 + " secret:abcdefgh"), (None, "passwd=longenough")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", secrets.F.lit(1))
    out = secrets.digests(secrets.scan(docs)).collect()
    assert len(out) == 7
    by = {r.doc_id: r for r in out}
    assert by[1].spans == "assign:2:19,access:21:37,hex:38:78"
    assert (by[2].spans, by[3].spans, by[4].spans, by[None].n_assign) == ("", "", "", 1)
    assert by[5].spans == "assign:300001:300016"
    assert secrets.scan(docs.limit(0)).count() == 0


# The contract's own patterns, and the least length of what counts.
CONTRACT = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def by_contract(text: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(CONTRACT) for m in rule.finditer(text) if len(m.group(group)) >= least]
    return sorted(spans)


def test_digests_are_those_of_the_contract(spark):
    import hashlib
    import os

    rng = random.Random(5)
    texts = ["".join(rng.choice([*PIECES, "Secret=", "tOkEn: '", "apikey", "f" * 31, "f" * 32, "AKIA" + "Z" * 11, "漢", "é", "=:"]) for _ in range(rng.randint(0, 20))).replace("ſ", "s") for _ in range(3000)]
    path = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(path):
        texts += [r.text or "" for r in spark.read.parquet(path).select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(docs)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = by_contract(text)
        named = [f"{CONTRACT[kind][0]}:{a}:{b}" for a, kind, b in want]
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(kind == j for _, kind, _ in want) for j in range(3)], text
        assert got[k].base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest(), text
        assert set(named) <= set(got[k].spans.split(","))
