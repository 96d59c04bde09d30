"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters are lexicons and patterns. Four lexicons are public lists of insults, one per language. Six are mined, of whole words and of
words' first 3 to 7 letters (for inflected and compounded words): terms that stand out in toxic documents of a bounded sample
of labelled ones, by likelihood ratio and odds. A term counts once for each different word before it and must come
from more than one document after that, so that copies of one text don't teach their words. Each mined lexicon has
two voters: one says toxic where there are several hits and clean where there is none, the other goes by their density alone. Public
lists and patterns say toxic or nothing. No list is cut.

The label model takes each voter's vote as drawn from a distribution of its own for each class and estimates class
shares and distributions by expectation-maximisation, beginning from the majority of the votes; labels have no say in it. How far voters'
votes go together within a class is estimated too, and a voter counts for 1 / (1 + the sum of its correlations), so that voters that
say the same thing count once. The posterior of each sampled document then labels it for a logistic regression on how often and
how densely the lexicons occur, on their words and on the patterns, which scores all documents.

Null and empty texts get the score of a text without terms. Labels of null doc_id or class are left out;
several labels of one doc_id count as toxic if any is. Without labels of both classes, the public
lists alone decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

#: The bound: labelled documents the model is fitted on.
SAMPLE = 16_000
THRESHOLD = 0.7
#: What makes a term stand out: likelihood ratio, odds, places per toxic document and documents.
RATIO, ODDS, SHARE, LEAST, DOCUMENTS = 20.0, 6.0, 0.01, 3, 2
#: Lengths of beginnings; 0 stands for whole words.
KINDS = (0, 3, 4, 5, 6, 7)
LISTS = 2 * len(KINDS)
#: Hits, and hits per word, that the classifier tells apart.
HITS, DENSITIES = (1, 2, 3, 5), (0.0025, 0.005, 0.01, 0.02)
#: Hits per word from which voters say toxic, and below which the second ones say clean.
MANY, DENSE, SPARSE = 0.005, 0.01, 0.0025
CACHE_WORDS, PLACES = 300_000, 100_000
_WORD = re.compile(r"\w+")

# Common insults in the four languages of the documents.
INSULTS = {
    "en": frozenset(
        """idiot idiots moron morons stupid dumb loser losers scum trash clown worthless pathetic disgusting imbecile fool
        garbage filth jerk bastard""".split()
    ),
    "de": frozenset("idioten dumm dummkopf trottel abschaum versager widerlich arschloch".split()),
    "fr": frozenset("connard imbécile crétin abruti minable ordure salaud idiote".split()),
    "es": frozenset("imbécil estúpido escoria basura payaso patético tonto asqueroso".split()),
}
PATTERNS = (
    re.compile(r"(?i)\b(?:you|you're|your|du|ihr|tu|vous|tú|usted)\b.{0,20}\b(?:are|bist|seid|es|êtes|eres)\b.{0,20}!"),
    re.compile(r"(?i)\b(?:shut up|go away|get lost|halt's maul|ta gueule|cállate)\b"),
    re.compile(r"!{3,}"),
    re.compile(r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b){3,}"),
)
#: What a text must hold for a pattern to be looked for.
NEEDED = ("!", "", "!!!", "")
GRADES = len(HITS) + len(DENSITIES)
#: Features before those of single words: grades of the mined lexicons, the public lists, the patterns.
WIDTH = len(KINDS) * GRADES + len(INSULTS) + len(PATTERNS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(word: str) -> list[str]:
    """A word as a term of each kind: its number, and the word or its beginning (all of a shorter word)."""
    return [f"{n}{word[:n] if n else word}" for n in KINDS]


@dataclass
class Model:
    """The mined terms, weights of the features and a constant."""

    terms: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0] * (WIDTH - len(INSULTS) - len(PATTERNS)) + [6.0] * len(INSULTS) + [0.0] * len(PATTERNS)))
    bias: float = -4.0
    voters: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.places = {t: WIDTH + k for k, t in enumerate(sorted(t[1:] for t in self.terms if t[0] == "0"))}
        #: The beginnings of all words that mean anything.
        self.heads = {t[1 : 1 + KINDS[1]] for t in self.terms} | {w[: KINDS[1]] for known in INSULTS.values() for w in known}
        #: Words looked at, and of those that mean anything their mined lexicons and places.
        self.seen: set[str] = set()
        self.telling: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def width(self) -> int:
        return WIDTH + len(self.places)

    def _look(self, new: set[str]) -> None:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
            self.telling.clear()
        at, fewest = len(KINDS) * GRADES, KINDS[1]
        for word in new:
            if word[:fewest] not in self.heads:
                continue
            kinds = tuple(k for k, t in enumerate(terms_of(word)) if t in self.terms)
            places = [at + k for k, known in enumerate(INSULTS.values()) if word in known]
            if word in self.places:
                places.append(self.places[word])
            if kinds or places:
                self.telling[word] = kinds, tuple(places)
        self.seen |= new

    def hits(self, text: str | None) -> tuple[list[int], int, list[int]]:
        """Hits of each mined lexicon, the number of words, and places of words, public lists and patterns."""
        own = words(text)
        hits, places, counted = [0] * len(KINDS), set(), Counter(own)
        new = counted.keys() - self.seen
        if new:
            self._look(new)
        for word in counted.keys() & self.telling.keys():
            kinds, found = self.telling[word]
            for k in kinds:
                hits[k] += counted[word]
            places.update(found)
        at = len(KINDS) * GRADES + len(INSULTS)
        return hits, len(own), [*sorted(places), *[at + k for k, p in enumerate(PATTERNS) if text and NEEDED[k] in text and p.search(text)]]

    def found(self, text: str | None) -> list[int]:
        """Places of the features that a text has."""
        hits, n, out = self.hits(text)
        for k, h in enumerate(hits):
            if h:
                at = k * GRADES
                out += [at + j for j, least in enumerate(HITS) if h >= least]
                out += [at + len(HITS) + j for j, least in enumerate(DENSITIES) if h >= least * n]
        return out

    def votes(self, text: str | None) -> list[int]:
        """1 toxic, -1 clean, 0 nothing, by each voter."""
        hits, n, places = self.hits(text)
        out = [1 if h > 1 and h >= MANY * n else 0 if h else -1 for h in hits]
        out += [1 if h and h >= DENSE * n else 0 if h and h >= SPARSE * n else -1 for h in hits]
        at = len(KINDS) * GRADES
        return out + [int(at + k in places) for k in range(len(INSULTS) + len(PATTERNS))]

    def score(self, text: str | None) -> float:
        z = self.bias + self.weights[self.found(text)].sum()
        return float(1 / (1 + np.exp(-z)))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places (term, context, doc_id, toxic) of a document, each once; context numbers the word before."""
    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["term", "context", "doc_id", "toxic"])

    out: list[tuple] = []
    for batch in batches:
        for doc_id, text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            before, seen = 0, set()
            for w in words(text):
                seen.add((w, before))
                before = zlib.crc32(w.encode()) & 0xFFFF
            out += {(t, before, doc_id, toxic) for w, before in seen for t in terms_of(w)}
            if len(out) > PLACES:
                yield batch_of(out)
                out = []
    yield batch_of(out)


def _mined(sample: DataFrame, n_toxic: int, scratch: Scratch) -> frozenset[str]:
    """Terms that stand out in toxic documents, of those that occur often enough there."""
    places = "term string, context int, doc_id long, toxic int"
    rows = sample.select("doc_id", "text", "toxic")
    toxic = rows.where("toxic = 1").mapInArrow(lean(_places), places)
    toxic = toxic.groupBy("term", "context").agg(F.min("doc_id").alias("doc_id"))
    toxic = scratch.table(toxic.groupBy("term").agg(F.count("*").alias("a"), F.countDistinct("doc_id").alias("docs")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                own = words(text)
                for w, n in Counter(w for w, _ in set(zip(own, [None, *own], strict=False))).items():
                    for t in terms_of(w):
                        seen[t] += n
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "c"])

    clean = rows.where("toxic = 0").select("text").mapInArrow(lean(count), "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))
    clean = scratch.table(clean)
    whole = F.col("term").startswith("0")
    total = {n: float(df.where(whole).agg(F.sum(n)).first()[0] or 1) for n, df in (("a", toxic), ("c", clean))}
    both = toxic.where((F.col("a") >= max(LEAST, SHARE * n_toxic)) & (F.col("docs") >= DOCUMENTS)).join(clean, "term", "left").fillna(0, ["c"])
    a, c, share = F.col("a"), F.col("c"), total["a"] / (total["a"] + total["c"])
    ratio = 2 * (a * F.log(a / ((a + c) * share)) + F.when(c > 0, c * F.log(c / ((a + c) * (1 - share)))).otherwise(0.0))
    odds = (a / total["a"]) / ((c + 0.5) / total["c"])
    return frozenset(r.term for r in both.where((ratio >= RATIO) & (odds >= ODDS)).select("term").collect())


def _together(votes: np.ndarray) -> np.ndarray:
    """How far votes of one class go together: correlations above 0, of different voters."""
    centred = votes - votes.mean(0) if len(votes) else np.zeros((1, votes.shape[1]))
    cov = centred.T @ centred / len(centred)
    spread = np.sqrt(np.diag(cov)) + 1e-9
    return np.clip(cov / spread[:, None] / spread[None, :] - np.eye(len(cov)), 0, 1)


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, list[dict]]:
    """Posteriors of the toxic class, and each voter's accuracy where it votes, correlation and weight."""
    hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    posterior = np.where(start > 0, 0.9, 0.1)
    for _ in range(rounds):
        share = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        chance = [((p[:, None, None] * hot).sum(0) + 0.1) / (p.sum() + 0.3) for p in (posterior, 1 - posterior)]
        # Sharp classes, as in blurred ones votes go together that differ by class alone.
        together = np.maximum(*(_together(votes[own]) for own in (posterior > 0.5, posterior <= 0.5)))
        weight = 1 / (1 + together.sum(1))
        ratio = np.log(chance[0]) - np.log(chance[1])
        z = np.log(share / (1 - share)) + (hot * (ratio * weight[:, None])[None]).sum((1, 2))
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    said = [share * (1 - t[1]) + (1 - share) * (1 - c[1]) for t, c in zip(*chance, strict=True)]
    right = [float((share * t[2] + (1 - share) * c[0]) / x) for t, c, x in zip(*chance, said, strict=True)]
    return posterior, [{"accuracy": a, "correlation": float(t), "weight": float(w)} for a, t, w in zip(right, together.sum(1), weight, strict=True)]


def logistic(found: list[list[int]], width: int, target: np.ndarray, rounds: int = 25, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge regression of the posteriors by Newton steps over the distinct feature sets."""
    groups: dict[tuple[int, ...], list[float]] = {}
    for own, y in zip(found, target, strict=True):
        one = groups.setdefault(tuple(sorted(own)), [0.0, 0.0])
        one[0] += 1
        one[1] += y
    x = np.zeros((len(groups), width + 1), np.float32)
    x[:, -1] = 1
    for k, own in enumerate(groups):
        x[k, list(own)] = 1
    n, y = (np.array([g[k] for g in groups.values()]) for k in (0, 1))
    beta, keep = np.zeros(width + 1), np.full(width + 1, ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - n * p) - keep * beta
        curve = (x * (n * p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(keep)
        step = np.linalg.solve(curve.astype(float), slope)
        beta += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-4:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """Learns from labels whose doc_id isn't held out, from at most ``sample`` documents by a seeded hash."""
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = scratch.table(own.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(own), "doc_id")
    texts = scratch.table(texts.where("text IS NOT NULL").select("doc_id", "text", "toxic"))
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    model = Model(_mined(texts, sizes[1], scratch))
    if not model.terms:
        return model if model.voters else Model()
    found, votes = _found(texts, model)
    posterior, model.voters = label_model(votes, np.sign(votes.sum(1, dtype=int)))
    model.weights, model.bias = logistic(found, model.width(), posterior)
    return model


def _found(texts: DataFrame, model: Model) -> tuple[list[list[int]], np.ndarray]:
    """Features and votes of the sample, in an order that doesn't depend on tasks."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            out = [pa.array([model.found(t) for t in own], pa.list_(pa.int32())), pa.array([model.votes(t) for t in own], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", "found", "votes"])

    rows = texts.select("doc_id", "text").mapInArrow(lean(look), "doc_id long, found array<int>, votes array<byte>").toPandas().sort_values("doc_id", ignore_index=True)
    return [list(map(int, f)) for f in rows["found"]], np.stack(rows["votes"].to_list()).astype(np.int8)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in (row, score)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    kept = docs.columns
    packed = docs.select(F.struct(*kept).alias("row"), "text")
    return packed.mapInArrow(lean(look), f"row {packed.schema['row'].dataType.simpleString()}, score double")
