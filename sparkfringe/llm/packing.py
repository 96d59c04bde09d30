"""Packing tokenised documents into sequences by vector best-fit.

A document is its token ids and one end id. Only documents longer than a sequence are cut, into pieces
of a whole sequence and a shorter last one. Pieces fill bins under three capacities (tokens,
documents, attention cost as the sum of squared lengths). Going by falling length, each piece goes to
the open bin that fits under every capacity and has the smallest weighted norm of what would remain
("norm"), or the largest weighted dot-product of piece and residual ("dot"); a new bin opens only if
none fits. A piece that is above the capacity of documents or cost by itself has a sequence of its own.

Pieces are dealt into groups of about ``GROUP_PIECES`` by a hash of document, piece and row, so
that no source or group of copies meets in one task; each group closes its own bins, which costs less
than one bin in some thousands.

Null texts count as empty: a document of the end id alone. Repeated rows are packed each. Tokens of a
word are looked up: the tokenizer never joins text across blanks, tabs and line ends, so a text's ids
are the ids of its words, one after the other.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, release

SEQUENCE = 2048
END_ID = 0
GROUP_PIECES = 16_384
#: Capacities for documents and, as shares of the square of the sequence, for attention cost: of the registered query, which is
#: to make few sequences of any table, and of mixes of longer documents.
WIDE, TIGHT = (512, 0.95), (64, 0.9)
#: Words whose ids a worker remembers, and the longest of them.
CACHE_WORDS, KEPT_WORDS, CACHE_CHARS = 600_000, 300_000, 64
_TAIL = ".,;:!?%&$#*"
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


def _lowered(text: str) -> str:
    """Lower case, where that changes no id: the tokenizer goes letter by letter (a capital sigma has two small
    forms), and it takes its own marks as they are written."""
    return text if "Σ" in text or "<|" in text else text.lower()


def _goes_by_words(path: str) -> bool:
    """Whether a tokenizer file says that text is put in lower case, and that no token crosses white space."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    steps = (rules.get("normalizer") or {}).get("normalizers") or []
    parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = parts[0].get("pattern", {}).get("Regex", "") if parts and parts[0]["type"] == "Split" and parts[0].get("invert") else ""
    return [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and split.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordIds:
    """Token ids of a text as little-endian 32-bit words.

    Most new words are Latin letters and some punctuation after them, which the tokenizer takes apart
    there and puts in lower case letter by letter; the letters of all new words of a text are encoded in one
    call, which costs far less than one call each. Other words are encoded as they are. When too many
    words are known, those learnt first stay, which are the frequent ones for the most part. All this goes for tokenizers that
    put text in lower case and part it at white space first (:func:`_goes_by_words`); with others each text is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _goes_by_words(path)
        self.known: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}

    def __call__(self, text: str) -> bytes:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _lowered(text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        new = set(words).difference(self.known)
        if new:
            if len(self.known) > CACHE_WORDS:
                self.known = dict(islice(self.known.items(), KEPT_WORDS))
                new = set(words).difference(self.known)
            self._learn(new)
        out = b"".join(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return out

    def _learn(self, new: set[str]) -> None:
        if len(self.stems) > CACHE_WORDS // 2:
            self.stems = {"": b""}
        stems, rest, parts = self.stems, [], []
        for w in new:
            letters = w.rstrip(_TAIL)
            if letters and (letters.isalpha() if letters.isascii() else _LATIN.match(letters)):
                parts.append((w, letters.lower(), w[len(letters) :]))
            else:
                rest.append(w)
        wanted = list({p[1] for p in parts}.difference(stems))
        if wanted:
            found = self.tokenizer.encode(" ".join(wanted), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.array(found.word_ids), minlength=len(wanted)))).tolist()
            stems.update(zip(wanted, map(ids.__getitem__, map(slice, [0, *ends], ends))))
        tails = list({p[2] for p in parts}.difference(stems))
        for to, many in ((stems, tails), (self.known, rest)):
            if many:
                encoded = self.tokenizer.encode_batch(many, add_special_tokens=False)
                to.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(many, encoded, strict=True))
        self.known.update([(w, stems[a] + stems[z] if z else stems[a]) for w, a, z in parts])


@cache
def shared_word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False, share_words: bool = True) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), with ``ids`` (32-bit words) if they are kept.

    With ``share_words`` the tasks of a Python worker share the words that they have learnt, which halves the work
    and takes some 150 MB that a worker keeps while it is idle; without, each task learns its own.
    """
    ids = ", ids binary" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = (shared_word_ids if share_words else WordIds)(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = encode(text or "") + end
                for k, at in enumerate(range(0, len(whole), 4 * sequence)):
                    own = whole[at : at + 4 * sequence]
                    out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), *([own] if keep_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if keep_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lean(cut), f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}"
    )


def best_fit(
    lengths: np.ndarray,
    capacities: tuple[float, float, float],
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. A piece above the capacity of documents or cost by itself has a bin of its own; one
    above that of tokens is an error."""
    size = np.stack([lengths, np.ones_like(lengths), lengths * lengths]).astype(float)
    room = np.array(capacities, float)[:, None]
    if (size[0] > room[0]).any():
        raise ValueError("a piece is longer than a sequence")
    alone = (size > room).any(0)
    order = np.argsort(-lengths, kind="stable")
    order = order[~alone[order]]
    least = np.minimum.accumulate(size[:, order[::-1]], axis=1)[:, ::-1]  # of what is still to come
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins[alone] = np.arange(alone.sum())
    left = np.empty((3, 64))
    used = np.empty(64, np.int64)
    name = np.empty(64, np.int64)
    n_open, made = 0, int(alone.sum())
    w = np.array(weights, float)[:, None]
    for step, i in enumerate(order):
        own = size[:, i]
        if step % 256 == 0 and n_open:  # bins that no later piece fits need not be looked at again
            stay = np.flatnonzero((left[:, :n_open] >= least[:, step][:, None]).all(0))
            left[:, : len(stay)], used[: len(stay)], name[: len(stay)] = left[:, stay], used[stay], name[stay]
            n_open = len(stay)
        rest = left[:, :n_open] - own[:, None]
        fits = np.flatnonzero((rest >= 0).all(0))
        if len(fits):
            if rule == "norm":
                score = ((w * rest[:, fits] / room) ** 2).sum(0)
            else:
                score = -(w * (own[:, None] / room) * (left[:, fits] / room)).sum(0)
            to = fits[np.argmin(score)]
        else:
            if n_open == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                used, name = np.concatenate([used, np.empty_like(used)]), np.concatenate([name, np.empty_like(name)])
            to = n_open
            left[:, to], used[to], name[to] = room[:, 0], 0, made
            n_open, made = n_open + 1, made + 1
        bins[i], offsets[i] = name[to], used[to]
        left[:, to] -= own
        used[to] += lengths[i]
    return bins, offsets


def pack(
    rows: DataFrame,
    scratch: Scratch,
    sequence: int = SEQUENCE,
    max_documents: int | None = None,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02),
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Rows with a ``length`` (of at most ``sequence``) get sequence_id and offset.

    ``max_cost`` is the most that squared lengths in a sequence may sum up to. Without it and ``max_documents`` only tokens bind.
    """
    capacities = (float(sequence), float(max_documents or sequence), float(max_cost or sequence * sequence))
    rows = scratch.table(rows)
    groups = max(1, -(-rows.count() // group_pieces))
    dealt = rows.withColumn(
        "pack_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
    )
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    names = rows.columns

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets = best_fit(lengths, capacities, weights, rule)
        out = table.select(names)
        out = out.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32), pa.int64()))
        release()
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("pack_group").applyInArrow(fill, ", ".join([*kinds, "sequence_id long", "offset long"]))
