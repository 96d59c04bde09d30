"""Removing repeated passages of lines.

What is looked for are units of a text: every line of at least ``LONG_WORDS`` words (or ``LONG_CHARS``
characters, where no blanks part words) by itself, and every two lines that aren't blank and follow each other
(with the blank lines between them) where one of both is shorter. Units that occur more than once over all
documents stay in the first place (smallest doc_id, then place) and go everywhere else. Units overlap, so a
repeated run of two or more lines goes as a whole, wherever it stands and whatever is around it; a
single short line stays. Two long lines need no unit of both: each goes where the two would.

Only hashes are counted at first. The bytes of repeated units are then compared: if the least
and the greatest text of a hash are equal, all are; hashes that several texts share are told apart by
those texts.

Rows of one doc_id with one text count as one document. Rows without doc_id or text stay as they are.
Blank lines between two lines that go, go with them. A text that loses all its lines becomes empty. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, joined, lean, small

LONG_WORDS, LONG_CHARS = 6, 60


def chunks(text: str) -> list[str]:
    """The lines of a text; joined by line feeds they are the text."""
    return text.split("\n")


def _blank(chunk: str) -> bool:
    return not chunk or chunk.isspace()


def _counts(chunk: str) -> bool:
    """Whether a chunk is a unit by itself."""
    if "\n" in chunk and sum(not _blank(x) for x in chunk.split("\n")) > 1:
        return True
    return len(chunk.split(None, LONG_WORDS - 1)) == LONG_WORDS or (len(chunk) >= LONG_CHARS and not _blank(chunk))


def units(text: str) -> dict[int, tuple[int, int, str]]:
    """First chunk, last chunk and text of each unit, by place: twice its first chunk, and one more for two lines."""
    own = chunks(text)
    out: dict[int, tuple[int, int, str]] = {}
    last, counted = -1, False
    for k, c in enumerate(own):
        if _blank(c):
            continue
        counts = _counts(c)
        if counts:
            out[2 * k] = (k, k, c)
        if last >= 0 and not (counts and counted):
            out[2 * last + 1] = (last, k, "\n".join(own[last : k + 1]))
        last, counted = k, counts
    return out


def _hash(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def hashed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, place, hash) of the units."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (doc_id, place, _hash(unit))
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for place, (_, _, unit) in units(text).items()
            ]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "place", "hash"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lean(make), "doc_id long, place int, hash long")


def _texts(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (hash, chunk, doc_id, place) of the units ``wanted`` (doc_id, place, hash)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = units(text)
                out += [(m["hash"], own[m["place"]][2], doc_id, m["place"]) for m in marks if m["place"] in own and _hash(own[m["place"]][2]) == m["hash"]]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["hash", "chunk", "doc_id", "place"])

    marks = scratch.table(wanted.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("place", "hash")).alias("marks")))
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.join(small(marks), "doc_id").select("doc_id", "text", "marks").mapInArrow(lean(make), "hash long, chunk string, doc_id long, place int")


def repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (doc_id, marks array<struct<place, hash, first>>): the units that go, with the place of the first one
    where that is in the same document."""
    marked = ("doc_id", "place", "hash", F.when(F.col("first.doc_id") == F.col("doc_id"), F.col("first.place")).alias("first"))
    every = scratch.table(hashed(docs))
    first = F.min(F.struct("doc_id", "place")).alias("first")
    counted = scratch.table(every.groupBy("hash").agg(first, F.max(F.struct("doc_id", "place")).alias("last")).where("first <> last"))
    shared = scratch.table(joined(scratch, every, counted.select("hash", "first"), "hash"))
    texts = _texts(docs, shared.select("doc_id", "place", "hash"), scratch)
    compared = scratch.table(texts.groupBy("hash").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).selectExpr("hash", "low = high AS same"))
    gone = joined(scratch, shared, compared, "hash").where("same AND struct(doc_id, place) <> first").select(*marked)
    unlike = scratch.table(compared.where("NOT same").select("hash"))
    if not unlike.isEmpty():
        mixed = scratch.table(joined(scratch, shared, unlike, "hash").select("doc_id", "place", "hash"))
        own = scratch.table(_texts(docs, mixed, scratch))
        firsts = own.groupBy("hash", "chunk").agg(first)
        gone = gone.unionByName(own.join(firsts, ["hash", "chunk"]).where("struct(doc_id, place) <> first").select(*marked))
    return scratch.table(gone.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("place", "hash", "first")).alias("marks")))


def _left(text: str, marks: list[dict]) -> tuple[str, int, int]:
    """What is left of a text, and how many passages and lines went."""
    own, found = chunks(text), units(text)
    gone: set[int] = set()
    for m in marks:
        if m["place"] in found and _hash(found[m["place"]][2]) == m["hash"]:
            low, high, _ = found[m["place"]]
            first = found.get(m["first"])
            gone.update(range(low + (first is not None and first[1] == low < high), high + 1))  # the first one stays whole
    if not gone:
        return text, 0, 0
    last = -1
    for k, c in enumerate(own):
        if not _blank(c):
            if k in gone and last in gone:
                gone.update(range(last, k))
            last = k
    kept = [c for k, c in enumerate(own) if k not in gone]
    if all(map(_blank, kept)):
        kept, gone = [], set(range(len(own)))
    return "\n".join(kept), sum(k - 1 not in gone for k in gone), len(gone)


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` with what is left of text, removed_chunks (passages that went) and removed_lines."""
    marks = scratch.keep(repeated(docs, scratch))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_left(text, own) if own else (text, 0, 0) for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["row", "text", "removed_chunks", "removed_lines"])

    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    packed = packed.join(small(marks), "doc_id", "left").select("row", "text", "marks")
    kind = packed.schema["row"].dataType.simpleString()
    found = packed.mapInArrow(lean(cut), f"row {kind}, text string, removed_chunks long, removed_lines long")
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], "removed_chunks", "removed_lines")
