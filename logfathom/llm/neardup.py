"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded.

One hash of each shingle gives both its bin and its value; the smallest value of a bin is
kept, and an empty bin copies a full one in a random order fixed for that bin. Bands of the
signature are bucket keys. Equal shingle sets are one class first; classes of a bucket are
compared with its smallest member only (a star), links are confirmed on the texts' full
shingle sets, and where a bucket still spans several components its members are compared
across components, so that no link of a bucket is lost.

With 42 bands of 6 rows a pair of similarity 0.8 shares no bucket with probability 3e-6.

Edge cases: a text with fewer words than a shingle is one shingle; a null, empty or blank
text has none and links with nothing; rows that share a doc_id are one node; a null doc_id
is linked with nothing, has a null component and is kept; repeated rows are copies; texts of any length are sketched and
compared whole; an
empty table gives an empty one; other columns pass through ``deduplicated`` unchanged, which
knows rows by id and text, so that null and repeated ids are no exception there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_bytes, mixed, staged, word_hashes
from .components import components

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
#: A star of more members than this is verified in several tasks.
STAR_MEMBERS = 2000
#: Hashes that several rows share are broadcast up to so many.
SHARED = 100_000
_rng = np.random.default_rng(20_240_229)
#: For each bin, the order in which it looks for a full one.
PROBES = np.argsort(_rng.random((BINS, BINS)), axis=1).astype(np.int16)
SKETCH = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``n`` words; of the whole text if it has fewer."""
    h = word_hashes(words)
    k = min(n, len(h))
    if not k:
        return h
    s = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
    return np.unique(mixed(s + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted hashes, densified."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    sig, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[first]], full[bins[first]] = s[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = PROBES[empty]
        sig[empty] = sig[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return sig


_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(s: np.ndarray) -> np.ndarray:
    rows = signature(s).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _sketcher(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, bands = [], [], []
            for raw in doc_bytes(batch.column(1)):
                s = shingle_hashes(raw.lower().split(), n)
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"])

    return sketch


@lru_cache(4)
def shingle_set(raw: bytes, n: int) -> frozenset:
    """The distinct runs of ``n`` words themselves."""
    words = raw.lower().split()
    return frozenset(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def _verifier(n: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = None
        centers: list[bytes] = []
        for batch in batches:
            out = []
            for c, m, is_member, raw in zip(batch.column("center").to_pylist(), batch.column("member").to_pylist(), batch.column("is_member").to_pylist(), doc_bytes(batch.column("text")), strict=True):
                if not is_member:  # a star's center comes before its members
                    if c != center:
                        centers = [raw]
                    elif raw not in centers:  # rows repeated under one doc_id are one text
                        centers.append(raw)
                    center = c
                    continue
                mine = shingle_set(raw, n)
                for other in centers:
                    theirs = shingle_set(other, n)
                    both = len(mine & theirs)
                    if both and 100 * both >= percent * (len(mine) + len(theirs) - both):
                        out.append((c, m))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["center", "member"])

    return verify


def confirmed(stars: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those (center, member) whose texts are similar enough; each star's texts meet in a few sorted tasks."""
    parts = F.ceil(F.count(F.lit(1)) / STAR_MEMBERS).cast("int")
    sizes = stars.groupBy("center").agg(parts.alias("parts"))
    members = stars.join(sizes, "center").select(F.col("member").alias("_id"), "center", F.pmod(F.hash("member"), "parts").alias("part"), F.lit(True).alias("is_member"))
    heads = sizes.select(F.col("center").alias("_id"), "center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_member"))
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(members.unionByName(heads), "_id")
    rows = rows.select("center", "part", F.col("_id").alias("member"), "is_member", "text")
    rows = rows.repartition("center", "part").sortWithinPartitions("center", "part", "is_member")
    return rows.mapInArrow(_verifier(n, percent), "center long, member long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept (links are ``percent`` % similar sets of ``n``-word shingles)."""
    sketches = staged(docs.select("doc_id", "text").mapInArrow(_sketcher(n), SKETCH))
    alive = sketches.where("set_id is not null and doc_id is not null")
    reps = staged(alive.groupBy("set_id").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r")).select("set_id", F.col("r.doc_id").alias("rep"), "r.bands"))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("top")).where("center < top")
    buckets = staged(keys.join(shared.select("key", "center"), "key"))
    stars = staged(buckets.where("center < rep").select("center", F.col("rep").alias("member"), F.lit(False).alias("again")).distinct())
    # all texts move once; what follows moves only those that share a bucket
    near = docs.select("doc_id", "text").join(buckets.select(F.col("rep").alias("_rep")).distinct(), F.col("doc_id") == F.col("_rep"), "left_semi")
    texts = staged(near)
    links = staged(confirmed(stars, texts, n, percent))
    comps = staged(components(links, "center", "member"))
    spanning = staged(_spanning(buckets, comps))
    if not spanning.isEmpty():
        shingles = staged(texts.join(spanning.select("rep").distinct(), F.col("doc_id") == F.col("rep")).select("rep", F.col("text")).mapInArrow(_exploder(n), "rep long, own long, size long, h long"))
        # one more star, around the text of a bucket that shares most with the others
        stars = stars.unionByName(staged(_medoid_stars(spanning, shingles, stars)))
        links = links.unionByName(staged(confirmed(stars.where("again"), texts, n, percent)))
        comps = staged(components(links, "center", "member"))
        rest = staged(_across(staged(_spanning(buckets, comps)), shingles, stars, percent))
        if not rest.isEmpty():
            links = links.unionByName(staged(confirmed(rest, texts, n, percent)))
    # rows that share a doc_id are one node, also where their texts differ
    twins = alive.join(reps, "set_id").select(F.col("rep").alias("center"), F.col("doc_id").alias("member")).where("center <> member").distinct()
    comps = staged(components(links.unionByName(twins), "center", "member"))
    found = sketches.select("doc_id", "n_shingles").join(comps, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _exploder(n: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, raw in zip(batch.column(0).to_pylist(), doc_bytes(batch.column(1)), strict=True):
                s = shingle_hashes(raw.lower().split(), n)
                own = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), v, np.int64)) for v in (rep, own, len(s))] + [pa.array(s.view(np.int64))], ["rep", "own", "size", "h"])

    return explode


def _spanning(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, rep, comp) of those buckets whose members lie in several components."""
    placed = buckets.join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return placed.join(several, "key")


def _medoid_stars(spanning: DataFrame, shingles: DataFrame, stars: DataFrame) -> DataFrame:
    """Stars of buckets around the text whose shingles are met most often among the others.

    Copies that were changed in different places are less like each other than like the text
    they come from. Compared with one of them, few are linked; with that text, most are.
    """
    met = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("met"))
    shared = shingles.join(met, "h").groupBy(F.col("rep").alias("_rep")).agg(F.avg("met").alias("met"))
    scored = spanning.join(shared, F.col("rep") == F.col("_rep"))
    best = scored.groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("low"), "comp")).alias("b")).select("key", (-F.col("b.low")).alias("center"), F.col("b.comp").alias("_comp"))
    pairs = spanning.join(best, "key").where("comp <> _comp").select("center", F.col("rep").alias("member")).distinct()
    known = stars.select(F.col("center").alias("_c"), F.col("member").alias("_m"))
    new = (F.least("center", "member") == F.col("_c")) & (F.greatest("center", "member") == F.col("_m"))
    return pairs.join(known, new, "left_anti").withColumn("again", F.lit(True))


def _across(spanning: DataFrame, shingles: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be linked among the texts whose bucket still spans several components; none that were compared.

    The buckets are not paired out. With a text's shingles from the rarest to the most
    common, two texts that share enough have one in common among the first of each, as many
    as may be missing and one more; texts changed in many places begin with shingles of
    their own and meet nobody. How much can be shared behind that shingle bounds the rest.
    """
    shingles = shingles.join(spanning.select(F.col("rep").alias("_rep"), "comp").distinct(), F.col("rep") == F.col("_rep")).drop("_rep")
    met = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    by_text = Window.partitionBy("rep", "own")
    alone = F.col("size") - F.count(F.lit(1)).over(by_text)
    place = alone + F.row_number().over(by_text.orderBy("met", "h"))
    first = shingles.join(met, "h").withColumn("place", place).where(f"100 * (size - place + 1) >= {percent} * size").drop("met", "own")
    other = first.select("h", F.col("rep").alias("center"), F.col("comp").alias("_comp"), F.col("size").alias("_size"), F.col("place").alias("_place"))
    shared = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) + 1
    enough = (100 + percent) * shared >= percent * (F.col("size") + F.col("_size"))
    pairs = first.join(other, "h").where("center < rep and comp <> _comp").where(enough).select("center", F.col("rep").alias("member")).distinct()
    compared = stars.select(F.least("center", "member").alias("center"), F.greatest("center", "member").alias("member"))
    return pairs.join(compared, ["center", "member"], "left_anti")


def row_hashes() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id (null last; of rows with equal id and text, one).

    A row is known by its id and text: a null id is no bar to being a copy, and of texts that
    share an id only those that are copies go. They stand for it as two hashes of 64 bits: where
    rows share the first but not the second, which a few in 10**10 do, the second takes its place.
    """
    first, second = row_hashes()
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", first.alias("_node"), second.alias("_other"))
    met = rows.groupBy("_node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n"), F.min("_other").alias("_low"), F.max("_other").alias("_high"))
    nodes = staged(met)
    shared = staged(nodes.where("_low <> _high").select(F.col("_node").alias("_shared")))
    if not shared.isEmpty():
        rows = rows.join(F.broadcast(shared) if shared.limit(SHARED + 1).count() <= SHARED else shared, F.col("_node") == F.col("_shared"), "left")
        rows = rows.withColumn("_node", F.when(F.col("_shared").isNull(), F.col("_node")).otherwise(F.col("_other"))).drop("_shared")
        nodes = staged(rows.groupBy("_node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_n")))
    judged = near_duplicates(rows.select(F.col("_node").alias("doc_id"), "text"), n, percent)
    linked = judged.select(F.col("doc_id").alias("_node"), F.col("component_id").alias("_comp")).distinct().join(nodes, "_node")
    best = linked.groupBy("_comp").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_node"))["_node"].alias("_best"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    gone = staged(linked.join(best, "_comp").where("_node <> _best").select("_node"))
    # texts stay where they are but for rows that are repeated
    repeated = nodes.where("_n > 1").select("_node")
    left = rows.join(gone, "_node", "left_anti")
    once, again = left.join(repeated, "_node", "left_anti"), left.join(repeated, "_node", "left_semi")
    return once.unionByName(again.dropDuplicates(["_node"])).select("_row.*")
