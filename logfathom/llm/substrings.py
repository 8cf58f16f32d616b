"""Substring deduplication: sparse suffix trees, partitioned by variable-length prefixes.

Only suffixes that start at anchors are indexed: of the runs of a few words inside a
window, the one with the smallest fingerprint (the first, if equal). Equal windows have
equal anchors, and every window has one, so each window hangs under one anchor's prefix.
Suffixes are split by that prefix, of two words; while a prefix is that of too many, its
windows hang under a longer one (``PREFIXES``, at last the window itself), for as many rounds
as needed. The words of each window move to its group. There, and before in every batch of
texts, the suffixes are sorted by their words; those that share ``window`` words are the
leaves under one internal node of that depth. A node with several leaves is a repeat, and all
its leaves but the first are marked. A batch sends only the first leaf of each node, so that a
passage in very many documents arrives once a batch, not once a copy.

Fingerprints only decide where suffixes meet and which are leaves of their own; that
windows are equal is decided by their words. The trees end at depth ``window``, since
what is below changes no mark.

Edge cases: a null, empty or blank text has no words; texts with fewer words than a window
lose none; a text of any length is read whole, a very long one as a batch of its own; a null
doc_id comes after all others, a document for each text; rows with equal doc_id are one document, so that exactly
repeated rows do not mark each other; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST, doc_bytes, mixed, rolled, word_hashes

WINDOW = 20
#: Words of a prefix: longer ones where the shorter is that of too many suffixes.
PREFIXES = (2, 4, 8, 14)
#: Words that a batch's tree holds at once, suffixes that a group does, and those sorted by words at once.
BATCH_WORDS, GROUP_ROWS, SORTED_ROWS = 500_000, 2_000_000, 100_000
#: Texts of which one is read to estimate how many suffixes a prefix has; that only decides how they are split.
ONE_IN = 64
#: Bytes of words that a group takes up at once.
LEAF_BYTES = 4_000_000
ZSTD = pa.Codec("zstd", compression_level=5)
MARKS = "doc_id long, key long, starts binary"


def windows_of(docs: DataFrame, text: str = "text") -> int:
    """About how many windows there are, at six bytes a word."""
    return (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 6


def parts_of(docs: DataFrame, windows: int) -> int:
    """Groups such that each holds about a million and a half windows."""
    return int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), windows // 1_500_000 + 1)) | 1


def lowest(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` neighbours, the first if equal."""
    at, span = np.arange(len(g), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = g[step:] < g[:-step]
        at, g, span = np.where(right, at[step:], at[:-step]), np.where(right, g[step:], g[:-step]), span + step
    return at


def gaps(text: bytes) -> np.ndarray:
    """Which bytes stand between words."""
    b = np.frombuffer(text, np.uint8)
    return (b == 32) | (b - np.uint8(9) < 5)


def count_words(text: bytes) -> int:
    gap = gaps(text)
    return int(np.count_nonzero(gap[:-1] > gap[1:])) + int(len(gap) > 0 and not gap[0])


def coded(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The code of each word of a text that ends in a gap, the different words by code with a space behind each, and where each word starts."""
    gap = gaps(text)
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # words start and end in turn
    start, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start + 1, out=offsets[1:])
    stay = ~gap
    stay[end] = True
    data = np.where(gap, np.uint8(32), np.frombuffer(text, np.uint8))[stay]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary, start


def bytes_of(words: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each word starts and the last ends, and the bytes of all, in order."""
    if not len(words):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(words) + 1)
    return offsets, memoryview(data)[: offsets[-1]]


class Suffixes:
    """The windows of some texts: text, start, place among all words and fingerprint of each."""

    def __init__(self, texts: list[bytes | list[bytes]], window: int):
        """Texts are given whole or as lists of words."""
        texts = [t if isinstance(t, bytes) else b" ".join(t) for t in texts]
        self.size = window
        self.codes, self.words, place = coded(b" ".join([*texts, b""]))
        lens = np.diff(np.searchsorted(place, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
        self.hashes = word_hashes(bytes(bytes_of(self.words)[1]).split())[self.codes]
        doc = np.repeat(np.arange(len(texts)), lens)
        first = np.cumsum(lens) - lens
        at = np.arange(max(len(self.codes) - window + 1, 0))
        self.at = at[at + window <= (first + lens)[doc[at]]]  # windows within one text
        self.row = doc[self.at]
        self.start = self.at - first[self.row]
        self.window = rolled(self.hashes, window)[self.at]

    def prefix(self, length: int) -> np.ndarray:
        """The fingerprint of ``length`` words at the anchor of each window."""
        if length >= self.size or not len(self.at):
            return self.window
        g = rolled(self.hashes, length)
        return g[lowest(g, self.size - length + 1)[self.at]]

    def groups(self, hot: list[np.ndarray]) -> np.ndarray:
        """The prefix that each window hangs under; a hot one is replaced by the next longer."""
        out = self.prefix(PREFIXES[0])
        for length, many in zip((*PREFIXES[1:], self.size), hot, strict=False):
            out = np.where(np.isin(out, many), self.prefix(length), out)
        return out


def later_leaves(window: np.ndarray, codes: np.ndarray, at: np.ndarray, size: int, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows occur at an earlier (doc, start) too: all leaves of a node but its first.

    Windows of different fingerprints are different; those that share one are sorted by their
    words, ``codes`` from ``at`` on, and a node is a run of suffixes with ``size`` common words.
    """
    order = np.argsort(window)
    w = window[order]
    same = np.zeros(len(w), bool)
    eq = w[1:] == w[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    some = order[same]
    later = np.zeros(len(w), bool)
    w = window[some]
    a = 0
    while a < len(some):
        b = int(np.searchsorted(w, w[min(a + SORTED_ROWS, len(some)) - 1], side="right"))
        leaf = some[a:b]
        words = np.empty((len(leaf), size), ">u4")
        for k in range(size):
            words[:, k] = codes[at[leaf] + k]
        suffix = np.lexsort((start[leaf], doc[leaf], words.view(f"S{4 * size}").ravel()))
        leaf, words = leaf[suffix], words[suffix]
        common = words[1:] == words[:-1]
        depth = np.where(common.all(axis=1), size, common.argmin(axis=1))  # of the node above two neighbours
        head = np.append(True, depth < size)
        lead = leaf[np.maximum.accumulate(np.where(head, np.arange(len(leaf)), 0))]
        later[leaf] = (doc[leaf] != doc[lead]) | (start[leaf] != start[lead])
        a = b
    return later


def _shrunk(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def _whole(small: bytes) -> bytes:
    return ZSTD.decompress(small[8:], int.from_bytes(small[:8], "little"), asbytes=True)


def _packed(s: Suffixes, ids: np.ndarray, keys: np.ndarray, lead: np.ndarray, sizes: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each part, which ascend, its runs of windows (whether of a new text, first start, length), and their words."""
    lens = sizes + s.size - 1
    ends = np.cumsum(lens)
    at = np.repeat(s.at[lead] - (ends - lens), lens)
    at += np.arange(len(at))
    offsets, words = bytes_of(s.words.take(pa.array(s.codes[at])))
    del at
    row, starts, short = s.row[lead], s.start[lead].astype(np.int32), sizes.astype(np.uint8)
    begins = offsets[np.append(0, ends)]
    turn = part[1:] != part[:-1]
    new = np.append(len(row) > 0, turn | (row[1:] != row[:-1]))[: len(row)]
    edges = np.concatenate([[0], np.flatnonzero(turn) + 1, [len(row)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a < b:
            docs = row[a:b][new[a:b]]
            arrays = (np.array([len(docs), b - a], np.int64), ids[docs], keys[docs], starts[a:b], new[a:b], short[a:b])
            yield int(part[a]), _shrunk(b"".join([*(x.tobytes() for x in arrays), words[begins[a] : begins[b]]]))


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """doc_ids, keys, starts, whether of a new text, lengths, and bytes of the words."""
    blob = _whole(blob)
    d, r = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    out, at = [], 16
    for kind, count in ((np.int64, d), (np.int64, d), (np.int32, r), (np.bool_, r), (np.uint8, r)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    return *out, np.frombuffer(blob, np.uint8, offset=at)


def _leaves(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, ...]:
    """(fingerprint, doc_id, key, start, place) of every window, and the codes of all words."""
    runs, codes, known, parts, held, first = [], [], [], [], 0, 0
    for k, blob in enumerate(column, 1):
        parts.append(_unpacked(blob.as_py()))
        held += len(parts[-1][-1])
        if held >= LEAF_BYTES or k == len(column):
            *run, words = (np.concatenate(x) for x in zip(*parts, strict=True))
            code, different, _ = coded(words.tobytes())
            runs.append(run)
            codes.append(code + np.int32(first))
            known.append(bytes(bytes_of(different)[1]))
            parts, held, first = [], 0, first + len(different)
    same, _, _ = coded(b"".join(known))  # words that several of these slices have
    words = np.empty(sum(map(len, codes)), np.int32)
    out = [np.empty(sum(int(run[-1].sum()) for run in runs), kind) for kind in (np.uint64, np.int64, np.int64, np.int32, np.int64)]
    done = before = 0
    for code, (ids, keys, starts, new, sizes) in zip(codes, runs, strict=True):
        code = same[code]
        words[before : before + len(code)] = code
        sizes = sizes.astype(np.int64)
        lens = sizes + size - 1
        text = np.repeat(np.cumsum(new) - 1, sizes)
        step = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(np.cumsum(lens) - lens, sizes) + step
        window = rolled(mixed(code.astype(np.uint64)), size)[place]
        for whole, part in zip(out, (window, ids[text], keys[text], np.repeat(starts, sizes) + step, place + before), strict=True):
            whole[done : done + len(text)] = part
        done, before = done + len(text), before + len(code)
    return *out, words


def _marks(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows of ``MARKS``: the starts of marked windows of each text."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order].astype(np.int32)
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1
    for a, b in zip([0, *cut], [*cut, len(ids)], strict=True):
        if a < b:
            yield int(ids[a]), int(keys[a]), starts[a:b].tobytes()


def _rows(part: list, leaves: list, ids: list, keys: list, starts: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((part, leaves, ids, keys, starts), kinds, strict=True)], ["part", "leaves", "doc_id", "key", "starts"])


def _batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_ids, keys, texts) with about ``words`` words; long texts alone."""
    ids, keys, texts, n = [], [], [], 0
    for batch in batches:
        for i, k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), doc_bytes(batch.column(2)), strict=True):
            ids.append(i)
            keys.append(k)
            texts.append(raw)
            n += count_words(raw)
            if n >= words:
                yield np.array(ids, np.int64), np.array(keys, np.int64), texts
                ids, keys, texts, n = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(keys, np.int64), texts


def _grower(parts: int, window: int, hot: list[np.ndarray]):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _batches(batches, BATCH_WORDS):
            s = Suffixes(texts, window)
            del texts
            later = later_leaves(s.window, s.codes, s.at, window, ids[s.row], s.start)
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, k, starts in _marks(ids[s.row[later]], keys[s.row[later]], s.start[later]):
                for x, v in zip(out, (abs(i) % parts, None, i, k, starts), strict=True):
                    x.append(v)
            stay = np.flatnonzero(~later)
            g, row, start = s.groups(hot)[stay], s.row[stay], s.start[stay]
            new = np.ones(len(stay), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (g[1:] != g[:-1])
            lead = np.flatnonzero(new)
            size = np.diff(np.append(lead, len(stay)))
            long_ = size > 255  # the same prefix again and again
            if long_.any():
                lead = np.sort(np.concatenate([lead, *(np.arange(a + 255, a + n, 255) for a, n in zip(lead[long_], size[long_], strict=True))]))
                size = np.diff(np.append(lead, len(stay)))
            part = (g[lead] >> np.uint64(16)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            for p, leaves in _packed(s, ids, keys, stay[lead[order]], size[order], part[order]):
                for x, v in zip(out, (p, leaves, None, None, None), strict=True):
                    x.append(v)
            yield _rows(*out)

    return grow


def _joiner(window: int):
    def joined(group: pa.Table) -> pa.Table:
        """One group's tree from all batches' leaves: marks of all leaves of a node but the first."""
        local = group.filter(pa.compute.is_null(group.column("leaves"))).select(["doc_id", "key", "starts"])
        marks: list[tuple] = []
        leaves = group.column("leaves").drop_null()
        if len(leaves):
            w, ids, keys, starts, at, codes = _leaves(leaves, window)
            later = later_leaves(w, codes, at, window, ids, starts)
            marks = list(_marks(ids[later], keys[later], starts[later]))
        new = pa.table([pa.array([r[k] for r in marks], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "key", "starts"])
        return pa.concat_tables([new, local.cast(new.schema)])

    return joined


def hot_prefixes(rows: DataFrame, window: int, windows: int) -> list[np.ndarray]:
    """By length, the prefixes of very many suffixes, round by round; a round has at most about a million (8 MB)."""
    bound = max(GROUP_ROWS // 8, windows >> 20)
    hot: list[np.ndarray] = []
    some = rows.where(F.pmod("key", F.lit(ONE_IN)) == 0)
    while len(hot) < len(PREFIXES):

        def count(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, ...] = tuple(hot)) -> Iterator[pa.RecordBatch]:
            for _, _, texts in _batches(batches, BATCH_WORDS):
                g, n = np.unique(Suffixes(texts, window).groups(list(known)), return_counts=True)
                met = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(g[met].view(np.int64)), pa.array(n[met], pa.int64())], ["g", "n"])

        large = some.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") * ONE_IN > bound)
        found = np.array([r["g"] for r in large.collect()], np.int64).view(np.uint64)
        if not len(found):
            break
        hot.append(found)
    return hot


@F.arrow_udf(T.BinaryType())
def _small(text: pa.Array) -> pa.Array:
    return pa.array(list(map(_shrunk, doc_bytes(text))), pa.binary())


@F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
def _cut(text: pa.Array, marks: pa.Array, size: pa.Array) -> pa.Array:
    out = []
    for raw, starts, n in zip(text.to_pylist(), marks.to_pylist(), size.to_pylist(), strict=True):
        words = _whole(raw).split()
        kept = words
        if starts:
            at = np.frombuffer(b"".join(starts), np.int32)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            kept = [w for w, c in zip(words, np.cumsum(edge).tolist(), strict=False) if not c]
        out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["n_words", "n_removed", "kept"])


_cut = _cut.asNondeterministic()


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and ``kept``, its words outside repeats joined by one space."""
    # texts without an id are told apart by 104 bits of their hash: 40 of them in place of the id
    unnamed = F.lit(LAST) - F.xxhash64(F.lit(1), "text").bitwiseAND(F.lit(2**40 - 1))
    named = docs.select("doc_id", F.coalesce("doc_id", unnamed).alias("id"), F.xxhash64("text").alias("key"), "text")
    rows = named.select("id", "key", "text")
    windows = windows_of(docs)
    parts, hot = parts_of(docs, windows), hot_prefixes(rows, window, windows)
    leaves = rows.mapInArrow(_grower(parts, window, hot), "part int, leaves binary, doc_id long, key long, starts binary")
    marks = leaves.repartition(parts, "part").groupBy("part").applyInArrow(_joiner(window), MARKS)
    by_doc = marks.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list("starts").alias("starts"))
    texts = named.select("doc_id", "id", "key", _small("text").alias("text"))  # what moves to the marks is compressed
    found = texts.join(by_doc, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    cut = found.select("doc_id", _cut(F.col("text"), F.col("starts"), F.lit(window)).alias("c"))
    return cut.select("doc_id", "c.*")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and the SHA-256 of what is kept."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
