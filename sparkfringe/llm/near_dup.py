"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its lower-case words (runs of word characters; where it has none, runs of non-blanks) and
its windows of five words, each labelled with its occurrence number; a text of fewer words is one window.
One sketch keeps, under one hash order, the ``TAKEN`` smallest labelled windows in text order; texts
that agree on one of ``BANDS`` sketches are candidates. Texts of up to ``SHORT`` windows, and those that
can be similar to one, are candidates also if they share one of so many of their smallest windows, under one order for
all, that no pair whose windows have at least the threshold in common is missed. A candidate pair is aligned word by
word: the longest common subsequence within the band of diagonals that the threshold allows, of M words, gives the similarity
M / (words of a + words of b - M), so that one edit costs one word. It is never below the similarity of the texts' windows in order.
Pairs of at least ``SIMILARITY`` are links; classes are what links connect.

No bucket is expanded into all its pairs, and none is capped. Members of a bucket are compared with
the bucket's first member. In buckets that are not one class by then, products of 0/1 matrices of texts
and words (with their occurrence numbers), in tiles of bounded size, tell how many words texts of different classes
share, which is never less than M; those that share enough are aligned, and a tile returns no more links than connect its texts.

Exact copies (of the words) are one node from the start, so their number doesn't matter. Texts that
are null, empty or blank are in classes of their own. Rows with one doc_id count as one document only
in :func:`without_copies`; a null doc_id takes no part in naming a class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, joined, lean, release, small

WINDOW = 5
SIMILARITY = 0.8
BANDS, TAKEN = 32, 3
#: Texts of up to this many windows have candidates by the least of them, which misses none.
SHORT = 20
#: Texts of a bucket in one block, their characters, and windows multiplied at once.
BLOCK, BLOCK_CHARS, SLICE = 1024, 4_000_000, 2048
CACHE_WORDS = 200_000
_WORD = re.compile(r"\w+")
_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)
_ODD = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RNG.integers(1, 2**63, TAKEN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def words_of(text: str | None) -> list[str]:
    return (_WORD.findall(text.lower()) or text.lower().split()) if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def windows(words: list[str], known: dict) -> np.ndarray:
    """Hashes of the windows in text order, equal ones told apart by their occurrence number."""
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(own) - WINDOW + 1)
    sums = np.full(n, min(len(own), WINDOW), np.uint64)
    for j in range(min(len(own), WINDOW)):
        sums += own[j : j + n] * _PLACE[j]
    return labelled(_mixed(sums))


def labelled(found: np.ndarray) -> np.ndarray:
    """Hashes of which equal ones are told apart by their occurrence number."""
    n = len(found)
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        at = np.arange(n)
        times = np.empty(n, np.uint64)
        times[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        found = np.where(times > 0, _mixed(found + times * np.uint64(0xC2B2AE3D27D4EB4F)), found)
    return found


def sketches(found: np.ndarray) -> np.ndarray:
    """One hash per band, of its smallest windows in text order."""
    taken = min(TAKEN, len(found))
    out = np.empty(BANDS, np.uint64)
    step = max(1, 1_000_000 // len(found))
    for at in range(0, BANDS, step):
        ranks = (found[None, :] ^ _SEED[at : at + step, None]) * _ODD[at : at + step, None]
        least = np.argpartition(ranks, taken - 1, axis=1)[:, :taken] if taken < len(found) else np.tile(np.arange(taken), (len(ranks), 1))
        out[at : at + step] = (found[np.sort(least, axis=1)] * _ORDER[:taken]).sum(1, dtype=np.uint64)
    return _mixed(out + np.arange(BANDS, dtype=np.uint64))


def buckets(found: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Sketches, and for short texts their smallest windows.

    Of two sets of similarity ``least`` at least ceil(least * n) of the n windows of each are common, so the first
    n - ceil(least * n) + 1 of both in one order can't be all different.
    """
    n, parts = len(found), [sketches(found)]
    if n * least <= SHORT + 1e-9:
        parts.append(_mixed(np.sort(_mixed(found))[: n - ceil(least * n - 1e-9) + 1] + np.uint64(BANDS)))
    return np.concatenate(parts)


def alignment(a: list[str], b: list[str], least: float = SIMILARITY) -> float:
    """The similarity of two lists of words; 0 where it can't reach ``least``.

    The subsequence is counted by bits: a row's bit is 0 where the count grows by that word of ``a``. Only the band's bits are kept;
    an alignment of ``need`` words never leaves the band.
    """
    total = len(a) + len(b)
    need = ceil(least / (1 + least) * total - 1e-9)
    if min(len(a), len(b)) < need:
        return 0.0
    band = total - 2 * need
    ends = 0
    for _ in range(2):  # equal words at the beginning and, turned round, at the end
        k, upto = 0, min(len(a), len(b))
        while k < upto and a[k] == b[k]:
            k += 1
        ends, a, b = ends + k, a[k:][::-1], b[k:][::-1]
    n, at = len(a), {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    low = high = counted = row = 0
    for j, w in enumerate(b):
        upto = min(n, j + band + 1)
        if upto > high:
            row |= ((1 << (upto - high)) - 1) << (high - low)
            high = upto
        if j - band > low:
            drop = min(j - band, high) - low
            counted += drop - (row & ((1 << drop) - 1)).bit_count()
            row, low = row >> drop, low + drop
        hit = row & (at.get(w, 0) >> low)
        if hit:
            row = ((row + hit) | (row - hit)) & ((1 << (high - low)) - 1)
        if j & 127 == 127 and ends + counted + (high - low) - row.bit_count() + len(b) - j - 1 < need:
            return 0.0
    m = ends + counted + (high - low) - row.bit_count()
    return m / (total - m) if m >= need else 0.0


def _key(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode(), usedforsecurity=False).digest()


def sketched(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, key, bands); key names the words, null where there are none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            keys, bands, done = [], [], {}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                key = _key(words) if words else None
                if key and key not in done:
                    done[key] = buckets(windows(words, known), least).view(np.int64)
                keys.append(key)
                bands.append(done.get(key))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "bands"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(make), "doc_id long, key binary, bands array<long>")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_key(words_of(t)) for t in batch.column(0).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["text", "key"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, words) of the nodes ``wanted`` (key, doc_id)."""
    wanted = small(wanted)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    own = rows.join(wanted, "doc_id").select("text", "key")
    nameless = wanted.where("doc_id IS NULL").select("key")
    if not nameless.isEmpty():
        of_words = rows.where("doc_id IS NULL AND text IS NOT NULL").select("text").mapInArrow(lean(_keyed), "text string, key binary")
        own = own.unionByName(of_words.join(nameless, "key", "left_semi").select("text", "key"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if _key(words) == key:
                    keys.append(key)
                    out.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "words"])

    return own.mapInArrow(lean(make), "key binary, words string").groupBy("key").agg(F.min("words").alias("words"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("words").alias("words_b")), "b").join(
        texts.select(F.col("key").alias("a"), F.col("words").alias("words_a")), "a"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a, b, of_a, of_b = (c.to_pylist() for c in batch.columns)
            hits = []
            for k in range(len(a)):
                if a[k] != last:
                    last, own = a[k], of_a[k].split(" ")
                hits.append(alignment(own, of_b[k].split(" "), least) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).filter(pa.array(hits, pa.bool_())) for c in (a, b)], ["a", "b"])

    return both.select("a", "b", "words_a", "words_b").mapInArrow(lean(check), "a binary, b binary")


def _tile(rows: dict, least: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between different labels in a tile of one or two blocks."""
    known = _Hashes()
    texts = [w.split(" ") for w in rows["words"]]
    own = [labelled(_mixed(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))) for w in texts]
    sizes = np.array([len(w) for w in own])
    block = np.array(rows["block"])
    sides = [np.flatnonzero(block == x) for x in dict.fromkeys(rows["block"])]
    a, b = sides[0], sides[-1]
    _, label = np.unique(np.array(rows["label"], dtype=object), return_inverse=True)
    every, at = np.unique(np.concatenate(own), return_inverse=True)
    shared = np.bincount(at, minlength=len(every)) > 1
    place = np.cumsum(shared) - 1
    node = np.repeat(np.arange(len(own)), sizes)[shared[at]]
    at = place[at][shared[at]]
    common = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(shared.sum()), SLICE):
        has = np.zeros((len(own), SLICE), np.float32)
        here = (at >= low) & (at < low + SLICE)
        has[node[here], at[here] - low] = 1
        common += has[a] @ has[b].T
    i, j = np.nonzero(common >= least / (1 + least) * (sizes[a][:, None] + sizes[b][None, :]) - 1e-3)
    i, j = a[i], b[j]
    out = []
    while True:
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        if not len(i):
            return out
        _, first = np.unique(i, return_index=True)  # one pair of each text, then look again
        for x, y in zip(i[first], j[first], strict=True):
            if label[x] != label[y] and alignment(texts[x], texts[y], least) > 0:
                out.append((rows["key"][x], rows["key"][y]))
                label[label == label[y]] = label[x]
        keep = np.ones(len(i), bool)
        keep[first] = False
        i, j = i[keep], j[keep]


def _within(labelled: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members (bucket, key, label) of one bucket and different labels.

    Buckets of the same members, told by their number, characters and two sums of hashes, are looked at once. The
    numbers of words that texts share come from products of 0/1 matrices, tile by tile of at most two blocks; only pairs that share enough are aligned.
    """
    sizes = texts.select("key", F.length("words").alias("chars"))
    marks = [F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in range(2)]
    open_ = (
        labelled.join(sizes, "key")
        .groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("chars").alias("chars"), *marks)
        .where("low <> high AND n > 2")
    )
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars") / BLOCK_CHARS)).cast("int")
    once = open_.groupBy("n", "chars", "mark0", "mark1").agg(F.min("bucket").alias("bucket")).select("bucket", blocks.alias("blocks"))
    dealt = labelled.join(once, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("bucket", "key", "label", "block", other.alias("other"))
    dealt = dealt.select("bucket", "key", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def look(table: pa.Table) -> pa.Table:
        out = list(zip(*_tile(table.to_pydict(), least), strict=True)) or [(), ()]
        if table.num_rows > BLOCK // 4:
            release()
        return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})

    return dealt.join(texts, "key").groupBy("bucket", "low", "high").applyInArrow(look, "a binary, b binary")


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links that connect the same: each member stays with the least of its hubs, and that with its other hubs, which
    members share. A member has no more hubs than buckets."""
    least = F.min("a").over(Window.partitionBy("b")).alias("least")
    each = links.select("a", "b", least)
    return each.select(F.col("least").alias("a"), "b").unionByName(each.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))).distinct()


def _classes(docs: DataFrame, scratch: Scratch, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, bands) of ``docs``, and (key, label, class_id) of the words there are."""
    rows = scratch.table(sketched(docs, least))
    nodes = scratch.table(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    )
    entries = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("key").alias("hub"), F.max("key").alias("other")).where("hub <> other")
    members = scratch.table(joined(scratch, entries, scratch.table(shared.select("bucket", "hub")), "bucket"))
    pairs = scratch.table(members.where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    wanted = scratch.table(members.select("key").distinct().join(nodes.select("key", "doc_id"), "key"))
    texts = scratch.table(_texts(docs, wanted))
    links = scratch.table(thinned(_verified(pairs, texts, least)))
    labels = components(scratch, links)
    labelled = members.select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    more = scratch.table(_within(scratch.table(labelled.withColumn("label", F.coalesce("label", "key"))), texts, least))
    if not more.isEmpty():
        labels = components(scratch, links.unionByName(more))
    named = nodes.select("key", "doc_id").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("key", "doc_id", F.coalesce("label", "key").alias("label"))
    named = scratch.table(named)
    named = joined(scratch, named, named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("key", "label", "class_id")
    return rows, named


def classes(docs: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, class_id): one per row of ``docs``; class_id is the smallest doc_id of the class."""
    rows, named = _classes(docs, scratch, least)
    found = joined(scratch, rows.select("doc_id", "key"), scratch.table(named), "key", "left")
    return scratch.keep(found.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")))


def without_copies(docs: DataFrame, scratch: Scratch, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` but for all texts of a class except one of the smallest doc_id.

    Rows whose doc_id other rows have too, or that have none, are told apart by their words: of one class the smallest doc_id
    stays (none comes last) with one text. Of equal doc_id and no words one row stays; without both all do.
    """
    rows, named = _classes(docs, scratch, least)
    found = scratch.table(joined(scratch, rows.select("doc_id", "key"), scratch.table(named), "key", "left"))
    mixed = scratch.keep(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("own")))
    gone = scratch.keep(found.where("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct())

    own_id = F.col("doc_id").cast("long")
    nameless = found.where("doc_id IS NULL AND key IS NOT NULL")
    if mixed.isEmpty() and nameless.isEmpty():
        return docs.join(small(gone), own_id == F.col("gone"), "left_anti")
    away = scratch.keep(gone.unionByName(mixed.withColumnRenamed("own", "gone")).distinct())
    clear = docs.where("doc_id IS NOT NULL").join(small(away), own_id == F.col("gone"), "left_anti")
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("chosen")
    kept = found.where("key IS NOT NULL").groupBy("label").agg(chosen).select(F.col("chosen.doc_id").alias("kept_id"), F.col("chosen.key").alias("kept_key"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = map(words_of, batch.column(1).to_pylist())
            keys = pa.array([_key(w) if w else None for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["row", "text", "key"])

    unclear = docs.where("doc_id IS NOT NULL").join(small(mixed), own_id == F.col("own"), "left_semi").unionByName(docs.where("doc_id IS NULL"))
    rest = [c for c in docs.columns if c != "text"]
    packed = unclear.select(F.struct(*rest).alias("row"), "text")
    kind = packed.schema["row"].dataType.simpleString()
    keyed = scratch.keep(packed.mapInArrow(lean(key), f"row {kind}, text string, key binary"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    said = keyed.where("key IS NOT NULL").join(kept, same, "left_semi")
    silent = keyed.where("key IS NULL AND row.doc_id IS NOT NULL")
    whole = F.min(F.struct("text", "row")).alias("whole")
    single = [x.groupBy(F.col("row.doc_id").alias("id"), "key").agg(whole).select("whole.row", "whole.text") for x in (said, silent)]
    left = single[0].unionByName(single[1]).unionByName(keyed.where("key IS NULL AND row.doc_id IS NULL").select("row", "text"))
    left = left.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return scratch.keep(clear.unionByName(left))
