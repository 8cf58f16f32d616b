"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash. Words are summed by source and hash bucket; a source
takes the buckets below its budget and only the bucket at the boundary is split further,
by the next bits, until it holds one hash. Documents are then filtered by their hash
alone; nothing is sorted. The thresholds are nested: a larger budget takes a superset.

Edge cases: a null source is a source of its own, ordered last; a null or empty text has
size 0 and is never taken; rows with equal ``doc_id`` and text share a hash and are taken
together; texts of any length are counted whole; an empty table gives an empty one; ``mix``
keeps all other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import NUMBER, numbered
from .common import staged, word_count

BITS, LEVELS = 12, 5
WEIGHTS = (5, 2, 1)
#: A table of one row a source is broadcast up to so many rows, joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def row_hash() -> Column:
    """60 bits from the id and the text."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``target`` per source (columns ``source``, ``source_size``): shares by weight, none above ``most`` times its size.

    What a capped source leaves goes to the others by weight: each round raises the level
    per unit of weight by what the sources below it leave, until no further one is capped.
    A round is one aggregate; caps and weights are whole numbers, so sums are exact and
    reruns agree. Ties and the null source need no order but that of the weights.
    """
    rank = F.pmod(F.col(NUMBER) - 1, F.lit(len(weights))).cast("int") + 1
    rows = numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()])
    t = staged(rows.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), rank).cast("double").alias("weight"), (most * F.col("source_size")).alias("cap")))
    level, before = 0.0, -1.0
    while level is not None and level != before:
        before, free = level, F.col("cap") > level * F.col("weight")
        spent, units, total = t.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight"))), F.sum("source_size")).first()
        level = (share * total - (spent or 0.0)) / units if units else None
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join a staged table of one row a source; broadcast behind a check of its size."""
    small = per_source.withColumnRenamed("source", "_s")
    if per_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return rows.join(small, F.col("source").eqNullSafe(F.col("_s")), "inner").drop("_s")


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: take each row with hash below ``cut`` (or equal to it, if ``closed``) once more.

    rows: ``source``, ``size``, ``hash``; plan: ``source``, ``source_size``, ``target``.
    """
    budget = F.when(F.col("target") >= F.col("source_size"), F.col("target") - F.col("source_size")).otherwise(F.col("target"))
    state = plan.select("*", budget.alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("cut"), F.lit(False).alias("closed"))
    done = None
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = _with(rows, state.select("source", "prefix")).where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
        bins = inside.groupBy("source", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        bins = _with(bins, state.drop("cut", "closed"))
        upto = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        over = bins.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        first = over.groupBy("source", "source_size", "target", "budget").agg(F.min_by(F.struct("bin", "words", "upto", "lo", "hi"), "bin").alias("b"))
        under = F.col("b.upto") - F.col("b.words")
        single = F.col("b.lo") == F.col("b.hi")
        closed = single & (F.col("b.upto") - F.col("budget") < F.col("budget") - under)
        state = staged(first.select("source", "source_size", "target", "budget", F.col("b.bin").alias("prefix"), under.cast("long").alias("below"), F.when(single, F.col("b.lo")).alias("cut"), closed.alias("closed")))
        ended = state.where("cut is not null")
        done = ended if done is None else done.unionByName(ended)
        state = state.where("cut is null")
        if state.isEmpty():
            break
    return done.select("source", "cut", "closed")


def _times(rows: DataFrame) -> tuple[Column, Column, DataFrame]:
    """How often a row is taken, as a sum of two columns over ``rows`` with their source's line of the third."""
    plan = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    cuts = staged(plan.join(thresholds(rows, plan).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    whole = (F.col("target") >= F.col("source_size")).cast("int")
    more = F.when(F.col("cut").isNull() | (F.col("hash") < F.col("cut")) | (F.col("closed") & (F.col("hash") == F.col("cut"))), 1).otherwise(0)
    return whole, more, cuts


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with size, source_size, target (its source's) and taken (0, 1 or 2 times its size)."""
    rows = staged(docs.select("doc_id", "source", word_count("text").alias("size"), row_hash().alias("hash")))
    whole, more, cuts = _times(rows)
    return _with(rows, cuts).select("doc_id", "source", "hash", "size", "source_size", "target", (F.col("size") * (whole + more)).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row once for each time that the mix takes it.

    The text never moves: each row is decided in place, from its own hash and the small
    table of thresholds.
    """
    rows = staged(docs.select("source", word_count("text").alias("size"), row_hash().alias("hash")))
    whole, more, cuts = _times(rows)
    here = docs.select(F.struct("*").alias("row"), "source", word_count("text").alias("size"), row_hash().alias("hash"))
    times = F.when(F.col("size") > 0, whole + more).otherwise(0)
    return _with(here, cuts).select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")
