"""Merkle manifest of a dataset: a digest a row, a root a source, one root, and a proof for every row.

Leaves are numbered within their source by range partitions, so that a hot source lies in many.
Aligned blocks of ``3**LEVELS`` leaves are whole subtrees: one task walks a block in postorder,
returns its root and, while it unwinds, appends the siblings of each node to the leaves below.
The block roots are the leaves of the next distributed walk, until a source has one node; the
sources' roots are walked the same way. A leaf's proof is the siblings of its walks, joined by
block; only block roots and their siblings are ever joined, texts never leave their scan.

Edge cases: nulls in any column stand as ``-``; an empty or very long text is hashed whole; in a
source, null ids come first and rows with equal ids go by their leaf digest (rows repeated with
all their values have equal leaves, whose order does not show); a null source is the first; rows
with a null id are never tampered with; an empty table gives an empty manifest; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import staged, streamed

ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: Tables of one row a part and source, or a block, are broadcast up to so many rows, joined by shuffle beyond.
BROADCAST_ROWS = 20_000
STEPS = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))
WALKED = "source string, block long, place int, id long, own string, other string, path array<struct<left: string, right: string>>, root string"


def leaf(*columns: Column) -> Column:
    """H of values, each ``-`` if null, else its UTF-8 bytes' count, a colon and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _small(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (source, id, own, other) with their ``at`` in the source, from 0, and per source the number ``n`` of rows.

    Equal rows are told apart by where they were read, so that no range holds all of them.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    keys = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("own").asc_nulls_first(), "_tie"]
    ordered = rows.withColumn("_tie", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id()
    kept = staged(ordered.select("*", F.shiftright(at, 33).alias("part"), at.alias("at")))
    runs = kept.groupBy("source", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    # a source has a run in each range that it reaches: as many rows as ranges, in order of the ranges
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = staged(runs.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "size", (before - F.col("first")).alias("shift")))
    shifted = kept.join(_small(runs.drop("size")), (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    return shifted.select("source", "id", "own", "other", (F.col("at") + F.col("shift")).alias("at")), staged(runs.groupBy(F.col("_s").alias("source")).agg(F.sum("size").alias("n")))


def postorder(nodes: list[str], levels: int, paths: list[list[tuple[str, str]]], low: int = 0) -> str:
    """Digest of the subtree of ``levels`` levels over ``nodes``; each leaf's path gets its siblings, lowest level first."""
    if not levels:
        return nodes[0]
    step = ARITY ** (levels - 1)
    children = [postorder(nodes[a : a + step], levels - 1, paths, low + a) for a in range(0, len(nodes), step)]
    for k, a in enumerate(range(0, len(nodes), step)):
        beside = ("".join(children[:k]), "".join(children[k + 1 :]))
        for p in paths[low + a : low + min(a + step, len(nodes))]:
            p.append(beside)
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of blocks (source, block, place, id, own, other, n), in order, with the paths in their block and its root."""

    def closed(block: list[tuple]) -> Iterator[tuple]:
        n, levels = block[0][6], 0
        while levels < LEVELS and ARITY**levels < n:  # a small source has fewer levels than a block
            levels += 1
        paths: list[list[tuple[str, str]]] = [[] for _ in block]
        root = postorder([r[4] for r in block], levels, paths)
        for r, p in zip(block, paths, strict=True):
            yield (*r[:6], [{"left": a, "right": b} for a, b in p], root)

    block: list[tuple] = []
    for r in rows:
        if block and r[:2] != block[0][:2]:
            yield from closed(block)
            block = []
        block.append(r)
    if block:
        yield from closed(block)


def walked(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One distributed walk: ``rows`` (source, id, own, other, at) with block, place in it, path and block root."""
    block = F.expr(f"at div {BLOCK}")
    n = _small(sizes.select(F.col("source").alias("_s"), "n"))
    dealt = rows.join(n, F.col("source").eqNullSafe(F.col("_s"))).select("source", block.alias("block"), (F.col("at") % BLOCK).cast("int").alias("place"), "id", "own", "other", "n")
    ordered = dealt.repartition("source", "block").sortWithinPartitions("source", "block", "place")
    return ordered.mapInArrow(streamed(_walk, WALKED), WALKED)


def _extended(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """``lower`` with the paths and roots of ``upper``, where its blocks are rows."""
    u = upper.select(F.col("source").alias("_s"), (F.col("block") * BLOCK + F.col("place")).alias("_b"), F.col("path").alias("_path"), F.col("root").alias("_root"))
    joined = lower.join(_small(u), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    return joined.withColumns({"path": F.concat("path", "_path"), "root": F.col("_root")}).drop("_s", "_b", "_path", "_root")


def tree(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` (source, id, own, other, at) with the ``path`` to, and the digest of, their source's root."""
    passes, n = [staged(walked(rows, sizes))], sizes
    while not (n := n.where(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK).cast("long"))).isEmpty():
        roots = passes[-1].where("place = 0").select("source", F.lit(None).cast("long").alias("id"), F.col("root").alias("own"), F.lit(None).cast("string").alias("other"), F.col("block").alias("at"))
        passes.append(staged(walked(roots, n := staged(n))))
    above = passes.pop()
    for lower in reversed(passes):  # sources that ended with the lower walk have no more above
        joined = _extended(lower, above)
        ended = lower.join(_small(above.select(F.col("source").alias("_s")).distinct()), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
        above = joined.unionByName(ended)
        above = staged(above) if lower is not passes[0] else above
    return above


def folded(own: Column, path: Column) -> Column:
    """The root over ``own``, digested with its siblings level by level."""
    return F.aggregate(path, own, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, and what a check of its (tampered) leaf against its proof gives.

    ``tampered`` is the text as the check sees it; by default, rows whose id has an even CRC-32 lose their newlines.
    """
    if tampered is None:
        hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
        tampered = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    meta = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select("source", F.col("doc_id").alias("id"), leaf(*meta, F.col("text")).alias("own"), leaf(*meta, tampered).alias("other"))
    at, sizes = placed(rows.withColumn("other", F.when(F.col("own") != F.col("other"), F.col("other"))))
    leaves = staged(tree(at, sizes))
    subroots = staged(leaves.groupBy("source").agg(F.min("root").alias("own")))
    # the sources are the leaves of one more tree
    ranked, count = placed(subroots.select(F.lit(None).cast("string").alias("source"), F.struct(F.col("source").isNotNull(), "source").alias("id"), "own", F.lit(None).cast("string").alias("other")))
    named = staged(ranked.select(F.col("id.source").alias("name"), "at", "own"))
    top = tree(named.select(F.lit(None).cast("string").alias("source"), F.col("at").alias("id"), "own", F.col("name").alias("other"), "at"), count)
    top = staged(top.select(F.col("other").alias("_s"), F.col("path").alias("_path"), F.col("root").alias("_root")))
    whole = leaves.join(_small(top), F.col("source").eqNullSafe(F.col("_s"))).withColumn("proof", F.concat("path", "_path"))
    fold = folded(F.coalesce("other", "own"), F.col("proof"))
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    out = whole.select(F.col("id").alias("doc_id"), F.col("own").alias("leaf"), F.col("root").alias("subroot"), F.col("_root").alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
