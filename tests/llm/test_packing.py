"""Packing against the tokenizer itself and against its capacities."""

import random
import struct
import zlib

import numpy as np
import pytest

from sparkfringe.llm import packing
from sparkfringe.llm.common import Scratch
from sparkfringe.llm.queries import tokenizer_path

pytest.importorskip("public_tokenizers")


def test_word_ids_are_those_of_the_whole_text():
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    rng = random.Random(3)
    parts = ["The", "don't", "ünï", "é", "́", " ", "\n", "\t", "\r\n", " ", "\x1c", "\x85", " ", "42", "<|endoftext|>", "<|end", "oftext|>", "İ", "ΣΑΣ", "%%%", "漢字", "x" * 90, "'s", "\v", "\f", "‍", "﻿", " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = plain.encode(text, add_special_tokens=False).ids
        assert words(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 3000)
    bins, offsets = packing.best_fit(lengths, (100.0, 4.0, 5000.0), rule=rule) if lengths.max() ** 2 <= 5000 else packing.best_fit(lengths, (100.0, 4.0, 9900.0), rule=rule)
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        assert lengths[own].sum() <= 100 and len(own) <= 4 and (lengths[own] ** 2).sum() <= 9900
        order = own[np.argsort(offsets[own])]
        assert (offsets[order] == np.concatenate([[0], np.cumsum(lengths[order])[:-1]])).all()


def test_best_fit_is_near_the_lower_bound():
    lengths = np.random.default_rng(2).integers(1, 2049, 4000)
    bins, _ = packing.best_fit(lengths, (2048.0, 2048.0, 2048.0**2))
    large = (lengths > 1024).sum()
    assert bins.max() + 1 <= 1.01 * max(large, lengths.sum() / 2048) + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5]), (4.0, 1.0, 99.0))


def test_rows(spark):
    rows = [(1, "The cat sat."), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS piece")
    with Scratch(spark) as scratch:
        cut = packing.pieces(docs, tokenizer_path(), keep_ids=True)
        out = packing.pack(cut, scratch).collect()
        none = packing.pack(packing.pieces(docs.limit(0), tokenizer_path()), scratch).count()
    assert none == 0 and len(out) == 4 + 2 * 3
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)
    assert {r.length for r in out if r.doc_id in (2, 3)} == {1}
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert sum(n for _, n in own) <= 2048
    assert len(by) == 2 * 2 + 1 + 1 or len(by) <= 7


def test_capacities_bind_and_cost_few_sequences(spark):
    rng = np.random.default_rng(4)
    many = [(k, "word " * int(n)) for k, n in enumerate(np.concatenate([rng.integers(0, 4, 400), rng.integers(100, 2047, 200)]))]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    with Scratch(spark) as scratch:
        cut = scratch.table(packing.pieces(docs, tokenizer_path()))
        free = packing.pack(cut, scratch).select("sequence_id").distinct().count()
        documents, cost = packing.TIGHT
        out = packing.pack(cut, scratch, max_documents=documents, max_cost=cost * 2048**2).collect()
    assert len(out) == 600
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r.length)
    lone = [own for own in by.values() if sum(n * n for n in own) > cost * 2048**2]
    assert lone and all(len(own) == 1 for own in lone)
    assert max(map(len, by.values())) == documents and all(sum(own) <= 2048 for own in by.values())
    assert free <= len(by) <= 1.05 * free + 1


def test_first_fitting_bins_by_hand():
    """Against the rule spelt out piece by piece."""
    rng = np.random.default_rng(6)
    for rule in ("norm", "dot"):
        for _ in range(30):
            lengths, room, w = rng.integers(1, 60, 80), np.array([100.0, 5.0, 3000.0]), np.array([1.0, 0.4, 0.3])
            bins, offsets = packing.best_fit(lengths, tuple(room), tuple(w), rule)
            left: dict = {}
            n_alone = 0
            for i in np.flatnonzero(lengths**2 > 3000):
                left[n_alone] = None
                assert bins[i] == n_alone and offsets[i] == 0
                n_alone += 1
            for i in np.argsort(-lengths, kind="stable"):
                own = np.array([lengths[i], 1, lengths[i] ** 2], float)
                if lengths[i] ** 2 > 3000:
                    continue
                scores = {}
                for b, rest in left.items():
                    if rest is not None and (rest >= own).all():
                        scores[b] = (((w * (rest - own) / room) ** 2).sum() if rule == "norm" else -(w * own / room * rest / room).sum())
                if scores:
                    assert np.isclose(scores[bins[i]], min(scores.values()))
                    left[bins[i]] = left[bins[i]] - own
                else:
                    assert bins[i] == len(left)
                    left[len(left)] = room - own


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    rules = json.load(open(tokenizer_path(), encoding="utf-8"))
    rules["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(rules))
    path = str(tmp_path / "t.json")
    plain, words = Tokenizer.from_file(path), packing.WordIds(path)
    for text in ("The Cat  SAT", "", "\n\nA\tb"):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert words(text) == struct.pack(f"<{len(ids)}I", *ids)
