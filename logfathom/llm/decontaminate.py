"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

An item is found in a document if the document has at least ``threshold`` of the item's
distinct five-word shingles, wherever and however far apart. Items fall into classes by the
size of their shingle set. An item is searched by the smallest of its shingle hashes, as
many as its class needs: a document with ``t * n`` of ``n`` shingles has at least one of any
``n - ceil(t * n) + 1`` of them, so no contained item is lost, however long the document. A
class is searched only in documents that have the shingles its smallest item needs.
Candidates are verified on the shingles themselves. Only DataFrame functions are used.

Words are runs of letters and digits, A-Z in lower case. A text of one to four words has
itself as its only shingle and is found wherever those words stand in a row; a text without
words (null, empty) has none and neither contains anything nor is found. Texts of any length
are read whole. Repeated rows give one result per (doc_id, item_id); rows with a null id are
compared like others; a row count of zero on either side gives no rows; other columns,
whatever their names, stay as they are in ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: So many sketch hashes fit into an expression; beyond, the search is a join.
LITERAL_HASHES = 4096
#: A table of so many sketch hashes (16 bytes each) is broadcast.
BROADCAST_ROWS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once a row, also where a filter is pushed below a projection."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(words: Column, lengths: Sequence[int], one) -> Column:
    """All runs of each of some lengths; of the texts with fewer words none."""

    def of(w: Column) -> Column:
        def runs(k: int) -> Column:
            places = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
            return F.filter(F.transform(places, lambda i: F.when(F.size(w) >= k, one([F.get(w, i + j - 1) for j in range(k)]))), lambda x: x.isNotNull())

        return F.concat(*map(runs, lengths)) if len(lengths) > 1 else runs(lengths[0])

    return _once(words, of)


def shingle_texts(words: Column, lengths: Sequence[int]) -> Column:
    return F.array_distinct(_runs(words, lengths, lambda parts: F.concat_ws(" ", *parts)))


def shingle_hashes(words: Column, lengths: Sequence[int]) -> Column:
    return _runs(words, lengths, lambda parts: F.xxhash64(*parts))


def _of_item(shingles) -> Column:
    """An item's shingles: of ``SHINGLE`` words, or the whole of a shorter text."""
    out = F.when(F.size("_w") >= SHINGLE, shingles(F.col("_w"), [SHINGLE]))
    for k in range(1, SHINGLE):
        out = out.when(F.size("_w") == k, shingles(F.col("_w"), [k]))
    return out


def _need(n: Column, threshold: float) -> Column:
    """Shingles that make up the containment; the tiny term keeps 0.8 * 35 at 28."""
    return F.greatest(F.ceil(n * threshold - 1e-9), F.lit(1)).cast("int")


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """Per item, its class and the hashes that it is searched by."""
    sets = items.select("item_id", "_n", F.array_sort(F.array_distinct(_of_item(shingle_hashes))).alias("_h")).where("_n > 0")
    need = _need(F.col("_n"), threshold)
    sized = sets.withColumns({"size_class": F.floor(F.log2("_n")).cast("int"), "need": need})
    return sized.select("item_id", "size_class", "need", F.explode(F.slice("_h", 1, F.col("_n") - F.col("need") + 1)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item found in a document."""
    items = items.select("item_id", tokens("text").alias("_w"))
    items = items.where(F.size("_w") > 0).withColumn("_t", _of_item(shingle_texts)).withColumn("_n", F.size("_t")).dropDuplicates(["item_id", "_t"])
    lengths = sorted(k for (k,) in items.select(F.least(F.size("_w"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    sketch = sketches(items, threshold)
    key = F.xxhash64("doc_id", "text")
    docs = docs.select("doc_id", key.alias("_key"), tokens("text").alias("_w")).withColumn("_h", shingle_hashes(F.col("_w"), lengths))
    few = [(r["hash"], r["size_class"], r["need"]) for r in sketch.select("hash", "size_class", "need").limit(LITERAL_HASHES + 1).collect()]
    if len(few) <= LITERAL_HASHES:
        # each class's hashes, sought only in documents that are large enough for its smallest item
        classes = {c: (min(n for _, k, n in few if k == c), sorted({h for h, k, _ in few if k == c})) for c in {k for _, k, _ in few}}
        by_need = sorted(classes.values())

        def hit(h: Column) -> Column:
            test = F.lit(False)
            for need, hashes in by_need:
                test |= (F.size(h) >= need) & F.arrays_overlap(h, F.lit(hashes))
            return test

        found = docs.where(F.exists(F.array("_h"), hit)) if by_need else docs.limit(0)
    else:
        least = sketch.groupBy("hash").agg(F.min("need").alias("need"))
        if least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then no shingle of a document moves
            least = F.broadcast(least)
        hits = docs.select("_key", F.size("_h").alias("_size"), F.explode("_h").alias("hash")).join(least, "hash").where("_size >= need").select("_key").distinct()
        found = docs.join(hits, "_key", "left_semi")
    mine = found.dropDuplicates(["doc_id", "_key"]).select("doc_id", "_key", F.explode(shingle_texts(F.col("_w"), lengths)).alias("_s"))
    theirs = items.select("item_id", F.col("_n").alias("n_item"), F.explode("_t").alias("_s"))
    shared = mine.join(theirs, "_s").groupBy("doc_id", "_key", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    whole = shared.where(F.col("n_shared") >= _need(F.col("n_item"), threshold))
    best = whole.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", F.col("b.n_item").cast("long").alias("n_item"), (F.col("b.n_shared") / F.col("b.n_item")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows in which an item is found. Rows with a null doc_id are judged like others."""
    bad = contained(docs, items, threshold).select(F.col("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))  # names of other columns cannot clash
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
