"""Mixing sources to target weights by capped water-filling.

Sources share all words by weight; a source's target stops at ``max_epochs`` times its size and the
excess is shared again by weight until no target is above. A source is then taken ``floor(target /
size)`` times as a whole, and the rest of its target comes from the documents first in a seeded order
(md5), up to the place nearest to the target. The order's sums are taken in two steps, over 4096
ranges of the order and then within the one range that holds the end, so that no task sorts a source.

Null texts have no words; a null source is a source of its own, the last; sources without words get
target 0. Rows with the same doc_id and text share their fate. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: A plan of up to this many sources is broadcast; beyond it, the join shuffles.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str = SEED) -> Column:
    own = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.md5(own)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in order of cap / weight fill up one after the other; the first that does not reach its
    cap at the level that the rest would have fixes the level. One row per source goes to one task.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_room = Window.partitionBy(F.lit(0)).orderBy("room", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    listed = F.array(*[F.lit(w) for w in weights])
    found = sources.select(
        "source",
        "source_size",
        F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)).alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    ).withColumn("room", F.col("cap").cast("double") / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    found = found.withColumn("level", level)
    found = found.withColumn("open", F.when(F.col("level") <= F.col("room"), F.struct("room", F.col("source").isNull(), "source", "level")))
    found = found.withColumn("level", F.min("open").over(every)["level"])
    return found.select(
        "source",
        "source_size",
        F.when(F.col("level") <= F.col("room"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def plan(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From rows (source, size, key): (source, source_size, target, whole, cut).

    A document is taken ``whole`` times, once more if its key is at most ``cut``.
    """
    ranges = scratch.table(
        sized.groupBy("source", F.substring("key", 1, 3).alias("range")).agg(F.sum("size").alias("range_size"))
    )
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    )
    goal = scratch.table(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    steps = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (
        ranges.withColumn("upto", F.sum("range_size").over(steps))
        .join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")))
        .groupBy("source")
        .agg(F.min_by(F.struct("range", (F.col("upto") - F.col("range_size")).alias("below"), "rest"), "range").alias("at"))
        .select(F.col("source").alias("s"), "at.*")
    )
    at = scratch.table(at)
    inside = sized.withColumn("range", F.substring("key", 1, 3)).join(
        _small(at.withColumnRenamed("range", "r")), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))
    )
    order = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        inside.withColumn("upto", F.col("below") + F.sum("size").over(order))
        .where(2 * F.col("upto") - F.col("size") < 2 * F.col("rest"))
        .groupBy("source")
        .agg(F.max("key").alias("cut"))
        .withColumnRenamed("source", "s2")
    )
    # Where not even the first document of the range is taken, the cut is below all its keys.
    return scratch.table(
        goal.join(at.select("s", "range"), F.col("source").eqNullSafe(F.col("s")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("cut", "range", F.lit("")).alias("cut"))
    )


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def with_repeats(rows: DataFrame, planned: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` (with source and key) with source_size, target and repeats, how often each is taken."""
    to = _small(planned.withColumnRenamed("source", "plan_source"))
    repeats = (F.col("whole") + F.when(F.col(key) <= F.col("cut"), 1).otherwise(0)).cast("long")
    return (
        rows.join(to, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("repeats", repeats)
        .drop("plan_source", "whole", "cut")
    )


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), order_key(seed).alias("key"))


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    planned = scratch.keep(plan(scratch.table(sizes(docs, seed)), scratch, weights, max_epochs))
    keyed = docs.select(F.struct("*").alias("row"), F.col("source"), order_key(seed).alias("key"))
    taken = with_repeats(keyed, planned).where("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")).select("row.*")
