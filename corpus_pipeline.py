"""The corpus pipeline: filter toxic documents, remove repeated passages and near copies, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before has kept, and
returns the columns of ``documents``; the last returns packed pieces. :func:`run` writes what a stage
returns as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfringe.llm import line_dedup, mixing, near_dup, packing, toxicity
from sparkfringe.llm.common import Scratch, releasing
from sparkfringe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold, under a model fitted on labels that aren't held out."""
    with Scratch(spark) as scratch:
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch)
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; one that loses all its text goes, as what it said stays
    elsewhere. n_chars follows the text."""
    with Scratch(spark) as scratch:
        left = line_dedup.dedup(docs, scratch)
    cut = F.col("removed_chunks") > 0
    left = left.where(~cut | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    with Scratch(spark) as scratch:
        return near_dup.without_copies(docs, scratch)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    with Scratch(spark) as scratch:
        return mixing.mix(docs, scratch)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place, under capacities of tokens, documents and attention cost. Other
    stages share the workers, so no words are kept."""
    documents, cost = packing.TIGHT
    with Scratch(spark) as scratch:
        cut = packing.pieces(docs, tokenizer_path(), share_words=False)
        return scratch.keep(packing.pack(cut, scratch, max_documents=documents, max_cost=cost * packing.SEQUENCE**2))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores, rolling hashes and alignments are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            with releasing(spark):
                docs = scratch.table(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)  # which writes its pieces itself
