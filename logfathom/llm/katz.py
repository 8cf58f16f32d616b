"""Language-model scoring: Katz backoff over words, with Good-Turing discounts, order 3.

The model has all words, pairs and triples of neighbours of the training texts, an end token
and two start tokens before each text. A token's probability is evaluated recursively: that
of its triple, discounted, if it was met, else the history's backoff weight times what the
shorter history gives, and so on to the word alone; words never met have one share of it. A
history that was never met passes on to the shorter one. Backoff weights make each history's
probabilities sum to one exactly: what the discounts leave, over what the tokens outside the
history's own have by the shorter history. A history whose tokens were all met too often to
be discounted sets one count aside.

Tables (all in the shared folder): ``words`` (key, c), and one table partitioned by kind with
a packed row a partition of n-grams: ``grams`` (counts, by last history word, word, and word
before), ``asked`` and ``late`` (what the texts need of that partition), ``head`` (the texts' own sums).
An n-gram lies in the partition of its last history word, so that pairs, triples and both
histories' sums meet in one task after one shuffle. A history word with more tokens than one
and a half partitions hold is hot: its n-grams are dealt by word as well, its sums are added up
over partitions, packed, and what is asked of it waits for those. Triples of other words that were met need
only their text's counts by how often they were met, as the discounts are known last.

Words are known by 63-bit hashes. Tasks hold the most frequent words (``CACHED_WORDS`` at
most, a short code each), which only makes packed rows smaller; the counts of the others are
joined by partition and word.

Edge cases: a null, empty or blank text is its end token; texts of any length are scored
whole; repeated rows get equal rows; a null doc_id counts as training; without training
texts every token is unknown and the base probability is 0.5 / 0.5 at N = V = 0; an empty
table gives an empty one; other columns are not read. The rows of ``docs`` must come in the
same order if a lost task reads them again, as those of files and written tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST, doc_bytes, mixed, released, staged

#: Most words that tasks have a code for; it changes no score.
CACHED_WORDS = 1_000_000
#: Good-Turing discounts hold up to this count.
DISCOUNT_UP_TO = 5
#: Tokens in a partition of the n-grams, and in a batch of texts.
PART_TOKENS, BATCH_TOKENS = 800_000, 1_000_000
#: Texts whose sums, and words whose counts, a task holds before it sends them on.
TEXTS, WORDS = 1_000_000, 1_000_000
END = b""
RARE = np.uint64(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)
ROWS = "kind string, part int, uid long, key long, vec array<long>, q double, blob binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.binary())


def trains() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1, F.lit(True))


# ---- packing ----


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; equal bytes of neighbours lie together."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *planes]))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = np.frombuffer(raw, np.int64, 1 + len(kinds))[1:]
    at, out = 8 * (1 + len(kinds)), []
    for size, kind in zip(n.tolist(), map(np.dtype, kinds), strict=True):
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def _short(*columns: np.ndarray) -> list[np.ndarray]:
    """Columns of word ids as codes of four bytes and the distinct ids of words without a code."""
    rare = [c >= RARE for c in columns]
    vocabulary, at = np.unique(np.concatenate([c[r] for c, r in zip(columns, rare, strict=True)]), return_inverse=True)
    out, k = [np.diff(vocabulary, prepend=np.uint64(0))], 0
    for c, r in zip(columns, rare, strict=True):
        code = c.astype(np.uint32)
        n = int(r.sum())
        code[r] = at[k : k + n].astype(np.uint32) | np.uint32(1 << 31)
        out.append(code)
        k += n
    return out


def _wide(vocabulary: np.ndarray, *codes: np.ndarray) -> list[np.ndarray]:
    """The ids of ``_short``."""
    vocabulary, out = np.cumsum(vocabulary, dtype=np.uint64), []
    for code in codes:
        c = code.astype(np.uint64)
        rare = code >= np.uint32(1 << 31)
        c[rare] = vocabulary[code[rare] & np.uint32((1 << 31) - 1)]
        out.append(c)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


# ---- texts ----


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) | RARE


#: No word has a space.
START = int(_hashes([b" "])[0])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, which train, numbers of tokens, ids of all tokens) of about ``BATCH_TOKENS`` tokens; a longer text is not cut."""
    ids, train, found, n = [], [], [], 0

    def out() -> tuple[np.ndarray, ...]:
        return np.array(ids, np.int64), np.array(train, bool), np.array(list(map(len, found)), np.int64), np.concatenate(found)

    for batch in batches:
        for i, t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), doc_bytes(batch.column(2)), strict=True):
            words = raw.lower().split()
            words.append(END)
            ids.append(i)
            train.append(t)
            found.append(_hashes(words))
            n += len(words)
            if n >= BATCH_TOKENS:
                yield out()
                ids, train, found, n = [], [], [], 0
    if ids:
        yield out()


def _count_words(parts: int):
    """Counts of words, added up in the task and packed by partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            part = (mixed(keys) % np.uint64(parts)).astype(np.int64)
            at = [np.flatnonzero(part == k) for k in range(parts)] if len(keys) else []
            blobs = [_pack(np.diff(keys[x], prepend=np.uint64(0)), counts[x]) for x in at]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        for _, train, lens, ids in _streams(batches):
            u, c = np.unique(ids[np.repeat(train, lens)], return_counts=True)
            both, at = np.unique(np.concatenate([keys, u]), return_inverse=True)
            keys, counts = both, np.bincount(at, np.concatenate([counts, c]), len(both)).astype(np.int64)
            if len(keys) > WORDS:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    return count


def _words(packed: pa.Table) -> pa.Table:
    got = [_unpack(blob, "u8", "i8") for blob in packed.column("blob").to_pylist()]
    keys, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in got]), return_inverse=True)
    return pa.table([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, np.concatenate([c for _, c in got]), len(keys)).astype(np.int64), pa.int64())], ["key", "c"])


class Codes:
    """The most frequent words: a code and a count each; the start token has one too."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, hot_from: int):
        order = np.lexsort((keys, -counts))
        keys, counts = np.append(keys[order], np.uint64(START)), np.append(counts[order], 0)
        self.counts = counts.astype(np.uint32 if counts[0] < 2**32 else np.uint64)
        self.code = np.argsort(keys).astype(np.uint32)
        self.keys = keys[self.code]
        ends = counts[keys == _hashes([END])[0]]
        as_history = np.append(counts[:-1], ends[0] if len(ends) else 0)  # as many starts as ends
        #: Codes of words that are too frequent as a history for one partition.
        self.hot = as_history >= hot_from

    def of(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, ids), len(self.keys) - 1)
        return np.where(self.keys[at] == ids, self.code[at].astype(np.uint64), ids)

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        return (ids < RARE) & self.hot[np.where(ids < RARE, ids, np.uint64(0)).astype(np.int64)]

    def part(self, h1: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
        return (mixed(np.where(self.is_hot(h1), mixed(h1 + ODD) ^ w, h1) + ODD) % np.uint64(parts)).astype(np.int64)


def _histories(w: np.ndarray, lens: np.ndarray, start: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the one before that."""
    first = np.cumsum(lens) - lens
    h1, h2 = np.empty_like(w), np.empty_like(w)
    h1[1:], h2[2:] = w[:-1], w[:-2]
    h1[first] = h2[first] = start
    h2[(first + 1)[lens > 1]] = start
    return h1, h2


def _rare_words(shared: Broadcast, parts: int):
    """(part, key) of words without a code, for the partitions that their n-grams go to."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for _, _, lens, ids in _streams(batches):
            w = codes.of(ids)
            h1, _ = _histories(w, lens, codes.of(np.array([START], np.uint64))[0])
            rare = w >= RARE
            w, part = w[rare], codes.part(h1[rare], w[rare], parts)
            _, one = np.unique(mixed(w + ODD * part.astype(np.uint64)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part[one], pa.int32()), pa.array(w[one].view(np.int64))], ["part", "key"])

    return found


def _sender(shared: Broadcast, parts: int, total: float):
    """The n-grams of all tokens, packed by partition, and the texts' own sums."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        base, unknown = np.log10((codes.counts + 0.5) / total), np.log10(0.5 / total)
        for k, (ids, train, lens, tokens) in enumerate(_streams(batches)):
            uid = (TaskContext.get().partitionId() << 32) | k
            w = codes.of(tokens)
            h1, h2 = _histories(w, lens, codes.of(np.array([START], np.uint64))[0])
            known = w < RARE
            own = np.where(known, base[np.where(known, w, np.uint64(0)).astype(np.int64)], unknown)
            row = np.repeat(np.arange(len(ids)), lens)
            sums = lambda x: np.bincount(row, x, len(ids))  # noqa: B023, E731
            rows = [("head", uid % parts, uid, None, None, None, _pack(ids, train.view(np.uint8), lens, sums(known.astype(float)).astype(np.int64), sums(own)))]
            part = codes.part(h1, w, parts)
            order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = order[a:b]  # in the order of the texts
                new = np.flatnonzero(np.diff(row[at], prepend=-1))
                doc = row[at[new]]
                blob = _pack(np.diff(doc, prepend=0).astype(np.uint32), train[doc].view(np.uint8), np.diff(np.append(new, b - a)).astype(np.uint32), *_short(w[at], h1[at], h2[at]))
                rows.append(("asked", int(part[at[0]]), uid, None, None, None, blob))
            yield _batch(rows)

    return send


# ---- partitions of n-grams ----


def _by_count(of: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` histories, how many of its n-grams have each count that is discounted, and the sum of all other counts."""
    out = [np.bincount(of[c == r], minlength=n) for r in range(1, DISCOUNT_UP_TO + 1)]
    return np.array([*out, np.bincount(of[c > DISCOUNT_UP_TO], c[c > DISCOUNT_UP_TO], n)], np.int32)


class Grams:
    """Ids of pairs, triples and histories of some tokens, and their counts."""

    def __init__(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, train: np.ndarray):
        def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            u, first, at = np.unique(keys, return_index=True, return_inverse=True)
            return u, first.astype(np.int32), at.astype(np.int32)

        pair = mixed(h1 * ODD + w)
        _, self.first, self.triple = distinct(mixed(pair * ODD + h2))
        _, self.pair_first, self.pair = distinct(pair)
        self.context_key, self.context_first, self.context = distinct(mixed((h2 ^ RARE) * ODD + mixed(h1 + ODD)))
        self.word, _, self.history = distinct(h1)
        self.c3 = np.bincount(self.triple, train, len(self.first)).astype(np.int64)
        self.c2 = np.bincount(self.pair, train, len(self.pair_first)).astype(np.int64)

    def contexts(self) -> np.ndarray:
        """Per pair of history words: its triples by count, and by the count of the pair that remains without the first word."""
        met = self.c3 > 0
        at, n = self.context[self.first[met]], len(self.context_key)
        return np.concatenate([_by_count(at, self.c3[met], n), _by_count(at, self.c2[self.pair[self.first[met]]], n)])

    def histories(self, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per history word: its pairs by count, and the sum of their words' own probabilities."""
        met = self.c2 > 0
        at = self.history[self.pair_first[met]]
        return _by_count(at, self.c2[met], len(self.word)), np.bincount(at, p1[self.pair_first[met]], len(self.word))

    def stored(self, w: np.ndarray, h2: np.ndarray) -> bytes:
        """Counts of all triples met: history words, the words after each, and the words before each pair."""
        met = np.flatnonzero(self.c3)
        at = self.first[met]
        order = np.lexsort((h2[at], w[at], self.history[at]))
        at, c = at[order], self.c3[met][order]
        pairs = np.flatnonzero(np.diff(self.pair[at], prepend=-1))
        words = np.flatnonzero(np.diff(self.history[at[pairs]], prepend=-1))
        sizes = (np.diff(np.append(x, n)).astype(np.uint32) for x, n in ((words, len(pairs)), (pairs, len(at))))
        return _pack(c.astype(np.uint32), *sizes, *_short(self.word[self.history[at[pairs[words]]]], w[at[pairs]], h2[at]))


def grams_of(blob: bytes) -> tuple[np.ndarray, ...]:
    """(h2, h1, w, count) of all triples in a row of kind ``grams``; words by code or hash."""
    c, per_word, per_pair, *ids = _unpack(blob, "u4", "u4", "u4", "u8", "u4", "u4", "u4")
    h1, w, h2 = _wide(*ids)
    return h2, np.repeat(np.repeat(h1, per_word), per_pair), np.repeat(w, per_pair), c


ASKED = ("u8", "i4", "u4", "f4", *["u4"] * DISCOUNT_UP_TO, "u8", "u4", "u4", "u4", "u4", "u4", "u4", "u4", "u4", *["i4"] * 12, "u8", "f8", *["i4"] * 6)
#: Sums of logarithms wait as whole numbers of so many to the unit.
FINE = 100_000


def _met(shared: Broadcast, total: float, spread: int):
    """One partition: the counts of its n-grams, and what its texts need of them."""

    def met(asked: pa.Table, found: pa.Table) -> pa.Table:
        codes = shared.value
        rows = [tuple(r[n] for n in NAMES) for r in asked.filter(pa.compute.equal(asked.column("kind"), "head")).to_pylist()]
        asked = asked.filter(pa.compute.equal(asked.column("kind"), "asked"))
        if not len(asked):
            return pa.Table.from_batches([_batch(rows)] if rows else [], pa.schema(list(zip(NAMES, TYPES, strict=True))))
        part = asked.column("part")[0].as_py()
        uids, ordinals, trained, sizes, columns = [], [], [], [], []
        for uid, blob in zip(asked.column("uid").to_pylist(), asked.column("blob").to_pylist(), strict=True):
            step, train, n, *ids = _unpack(blob, "u4", "u1", "u4", "u8", "u4", "u4", "u4")
            uids.append(np.full(len(step), uid, np.int64))
            ordinals.append(np.cumsum(step))
            trained.append(train)
            sizes.append(n)
            columns.append(_wide(*ids))
        uid, ordinal, train, size = map(np.concatenate, (uids, ordinals, trained, sizes))
        w, h1, h2 = (np.concatenate(x) for x in zip(*columns, strict=True))
        del columns
        doc = np.repeat(np.arange(len(uid)), size)
        g = Grams(w, h1, h2, train[doc])
        # counts of the words themselves
        order = np.argsort(found.column("key").to_numpy().view(np.uint64)) if len(found) else np.zeros(0, np.int64)
        keys, counts = (found.column(c).to_numpy()[order] for c in ("key", "c"))
        is_rare = w >= RARE
        c1 = np.zeros(len(w), np.int64)
        c1[~is_rare] = codes.counts[w[~is_rare].astype(np.int64)]
        if len(keys):
            at = np.minimum(np.searchsorted(keys.view(np.uint64), w[is_rare]), len(keys) - 1)
            c1[is_rare] = np.where(keys.view(np.uint64)[at] == w[is_rare], counts[at], 0)
        more = is_rare & (c1 > 0)
        sums = lambda x, on: np.bincount(doc[on], x[on] if x is not None else None, len(uid))
        base, known = sums(np.log10((c1 + 0.5) / 0.5), more), sums(None, more)
        # sums of histories
        contexts = g.contexts()
        pairs, q = g.histories((c1 + 0.5) / total)
        hot = codes.is_hot(g.word)
        hot_context = hot[g.history[g.context_first]]
        for k in np.flatnonzero(hot):
            rows.append(("hot", part, None, int(g.word[k]), pairs[:, k].tolist(), float(q[k]), None))
        # triples that were met: all but the discount is known here
        c3, on_hot = g.c3[g.triple], hot[g.history]
        seen = (c3 > 0) & ~on_hot
        divisor = np.maximum(_totals(contexts[:6])[1], 1)
        plain = np.log10(np.maximum(c3, 1) / divisor[g.context])
        by_count = [sums(None, seen & (c3 == r)).astype(np.uint32) for r in range(1, DISCOUNT_UP_TO + 1)]
        to = _adder(g.context_key, spread)

        def waiting(left: np.ndarray, first: bool) -> bytes:
            """What waits for discounts, and with the first of them what the texts have so far."""
            docs = np.arange(len(uid)) if first else np.unique(doc[left])
            had = [x[docs] * first for x in (known.astype(np.uint32), base.astype(np.float32), *by_count, np.rint(-FINE * sums(plain, seen)).astype(np.uint64))]
            own_context, context = np.unique(g.context[left], return_inverse=True)
            own_history, history = np.unique(g.history[left], return_inverse=True)
            of_context = np.searchsorted(own_history, g.history[g.context_first[own_context]])
            waits = [np.diff(np.searchsorted(docs, doc[left]), prepend=0), context, history, np.where(on_hot, c3, 0)[left], g.c2[g.pair[left]], c1[left]]
            vectors = [*(contexts[:, own_context] * first), np.where(hot[own_history], g.word[own_history] + np.uint64(1), np.uint64(0)), q[own_history], *pairs[:, own_history]]
            adder = to[own_context] * (not first)  # with the order, this tells which sums are whose: all hot histories are here, as sent
            return _pack(uid[docs].view(np.uint64), np.diff(ordinal[docs], prepend=0).astype(np.int32), *had, *(x.astype(np.uint32) for x in waits), adder.astype(np.uint32), of_context.astype(np.uint32), *vectors)

        rows.append(("asked", part, None, None, None, None, waiting(np.flatnonzero(~seen & ~on_hot), True)))
        if on_hot.any():
            rows.append(("late", part, None, None, None, None, waiting(np.flatnonzero(on_hot), False)))
        numbers = [int((c == r).sum()) for c in (g.c2, g.c3) for r in range(1, DISCOUNT_UP_TO + 2)]
        rows.append(("grams", part, None, None, numbers, None, g.stored(w, h2)))
        for k in np.unique(to[hot_context]):
            at = np.flatnonzero(hot_context & (to == k))
            rows.append(("context", part, None, int(k), None, None, _pack(np.diff(g.context_key[at], prepend=np.uint64(0)), *contexts[:, at])))
        return pa.Table.from_batches([_batch(rows)])

    return met


def _adder(keys: np.ndarray, spread: int) -> np.ndarray:
    """The task that adds up each hot history."""
    return (mixed(keys + ODD) % np.uint64(spread)).astype(np.int64)


def _added(table: pa.Table) -> pa.Table:
    """Sums of hot histories of two words over all partitions, back to each in the order in which it sent them."""
    got = [_unpack(blob, "u8", *["i4"] * 12) for blob in table.column("blob").to_pylist()]
    keys = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
    _, at = np.unique(keys, return_inverse=True)
    sums = [np.bincount(at, np.concatenate(v)).astype(np.int64)[at] for v in zip(*(x[1:] for x in got), strict=True)]
    cut = np.cumsum([0, *(len(x[0]) for x in got)])
    blobs = [_pack(*(v[a:b] for v in sums)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table([table.column("part"), table.column("key"), pa.array(blobs, pa.binary())], ["to", "adder", "blob"])


def discounts(n: dict[int, int], k: int = DISCOUNT_UP_TO) -> list[float]:
    """Katz's factors for counts 1 to ``k`` from the counts of counts; (r - 0.5) / r where Good-Turing gives none."""
    out = []
    common = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        star = (r + 1) * n.get(r + 1, 0) / n[r] if n.get(r) else 0.0
        d = (star / r - common) / (1 - common) if common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _totals(by_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per history: how often it was met, and what counts are divided by; one more if nothing is discounted."""
    full = (np.arange(1, DISCOUNT_UP_TO + 1) @ by_count[:DISCOUNT_UP_TO]) + by_count[DISCOUNT_UP_TO]
    return full, full + (by_count[:DISCOUNT_UP_TO].sum(axis=0) == 0)


def _mass(by_count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What discounting leaves to the n-grams met, in counts."""
    return (np.arange(1, DISCOUNT_UP_TO + 1) * d) @ by_count[:DISCOUNT_UP_TO] + by_count[DISCOUNT_UP_TO]


def _answered(d2: np.ndarray, d3: np.ndarray, total: float, hot: dict[int, tuple]):
    """The sums of the texts that asked a partition, packed by batch of texts."""
    times = lambda c, d: c * np.where(c <= DISCOUNT_UP_TO, d[np.clip(c, 1, DISCOUNT_UP_TO) - 1], 1.0)

    def one(blob: bytes, sums: dict[int, np.ndarray] | None) -> Iterator[tuple]:
        """(batch of texts, place in it, and three sums) of a packed row."""
        uid, ordinal, known, base, *rest = _unpack(blob, *ASKED)
        ordinal = np.cumsum(ordinal, dtype=np.int64).astype(np.uint32)
        e, plain = rest[:DISCOUNT_UP_TO], rest[DISCOUNT_UP_TO].astype(float) / -FINE
        doc, context, history, c3, c2, c1 = (x.astype(np.int64) for x in rest[6:12])
        doc = np.cumsum(doc)
        adder, of_context, contexts = rest[12], rest[13].astype(np.int64), np.array(rest[14:26], np.int64)
        hot_word, q, pairs = rest[26], rest[27], np.array(rest[28:], np.int64)
        for k in np.flatnonzero(hot_word):
            pairs[:, k], q[k] = hot[int(hot_word[k]) - 1]
        if sums is not None:
            for k, found in sums.items():
                contexts[:, adder == k] = found
        met2, all2 = _totals(pairs)
        back2 = np.log10(np.maximum((1 - _mass(pairs, d2) / all2) / (1 - q), 1e-300))
        lower = np.log10((c1 + 0.5) / total)
        p2 = np.where(c2 > 0, np.log10(np.maximum(times(c2, d2), 1e-300) / all2[history]), np.where(met2[history] > 0, back2[history], 0.0) + lower)
        met3, all3 = _totals(contexts[:6])
        q3 = _mass(contexts[6:], d2) / all2[of_context]
        back3 = np.log10(np.maximum((1 - _mass(contexts[:6], d3) / all3) / (1 - q3), 1e-300))
        p3 = np.where(c3 > 0, np.log10(np.maximum(times(c3, d3), 1e-300) / all3[context]), np.where(met3[context] > 0, back3[context], 0.0) + p2)
        score = plain + sum(n * np.log10(x) for n, x in zip(e, d3, strict=True)) + np.bincount(doc, p3, len(uid))
        edges = np.flatnonzero(np.diff(uid.view(np.int64), prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(uid[a]), ordinal[a:b], known[a:b], base[a:b], score[a:b]

    def packed(rows: Iterator[tuple[int, bool, bytes]]) -> list[pa.Array]:
        got = list(zip(*rows, strict=True)) or [[]] * 3
        return [pa.array(x, t) for x, t in zip(got, (pa.int64(), pa.bool_(), pa.binary()), strict=True)]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over all partitions that a task reads, sent on before they are too many."""
        texts: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            dense = ((u, np.flatnonzero(x[3]).astype(np.uint32), x) for u, x in texts.items())
            return pa.RecordBatch.from_arrays(packed((u, False, _pack(at, x[0, at].astype(np.uint32), *(x[k, at].astype(np.float32) for k in (1, 2)))) for u, at, x in dense), ["uid", "head", "blob"])

        for batch in batches:
            for kind, uid, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "uid", "blob")), strict=True):
                if kind == "head":
                    yield pa.RecordBatch.from_arrays(packed([(uid, True, blob)]), ["uid", "head", "blob"])
                    continue
                for u, at, *found in one(blob, None):
                    x = texts.get(u, np.zeros((4, 0)))
                    if x.shape[1] <= at[-1]:
                        x = texts[u] = np.pad(x, ((0, 0), (0, int(at[-1]) + 1 - x.shape[1])))
                    for k, v in enumerate((*found, 1)):
                        x[k, at] += v
                if sum(x.shape[1] for x in texts.values()) > TEXTS:
                    yield out()
                    texts = {}
        yield out()

    def with_sums(table: pa.Table, found: pa.Table) -> pa.Table:
        sums = {k: np.array(_unpack(blob, *["i8"] * 12)) for k, blob in zip(found.column("adder").to_pylist(), found.column("blob").to_pylist(), strict=True)}
        rows = ((u, False, _pack(at, known, base, score.astype(np.float32))) for blob in table.column("blob").to_pylist() for u, at, known, base, score in one(blob, sums))
        return pa.table(packed(rows), ["uid", "head", "blob"])

    return here, with_sums


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _summed(packed: pa.Table) -> pa.Table:
    """The rows of one batch of texts, from its own sums and what the partitions answered."""
    heads, blobs = packed.column("head").to_pylist(), packed.column("blob").to_pylist()
    ids, train, n, known, base = _unpack(blobs[heads.index(True)], "i8", "u1", "i8", "i8", "f8")
    score, known, base = np.zeros(len(ids)), known.copy(), base.copy()
    for is_head, blob in zip(heads, blobs, strict=True):
        if not is_head:
            at, more, own, got = _unpack(blob, "u4", "u4", "f4", "f4")
            score[at] += got
            known[at] += more
            base[at] += own
    columns = (pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(train.astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(score))
    return pa.table(list(columns), [x.split()[0] for x in SCORED.split(", ")])


# ---- the model ----


def most_frequent(words: DataFrame, most: int, hot_from: int) -> Codes:
    """Codes of the words met so often that there are at most ``most`` of them; only those counts are collected."""
    least, seen = 1, 0
    by_count = words.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).count().toPandas().sort_values("c", ascending=False)
    for c, n in zip(by_count["c"].tolist(), by_count["count"].tolist(), strict=True):
        seen += n
        if seen > most:
            least = c + 1
            break
    top = words.where(F.col("c") >= least).toArrow()
    return Codes(top.column("key").to_numpy().view(np.uint64), top.column("c").to_numpy(), hot_from)


def scored(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    The model learns from the rows for which ``train`` holds, by default those that are not held out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), (trains() if train is None else train).alias("train"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(spark.sparkContext.defaultParallelism, size // (6 * PART_TOKENS) + 1))
    words = staged(texts.mapInArrow(_count_words(parts), "part int, blob binary").groupBy("part").applyInArrow(_words, "key long, c long"))
    n, v = (int(x or 0) for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
    total = n + 0.5 * (v + 1)
    codes = spark.sparkContext.broadcast(most_frequent(words, CACHED_WORDS, PART_TOKENS + PART_TOKENS // 2))
    rare = texts.mapInArrow(_rare_words(codes, parts), "part int, key long").join(words, "key").select("part", "key", "c")
    # tasks that add up what several partitions have of one history
    spread = int(codes.value.counts[codes.value.hot].sum() // (2 * PART_TOKENS) + 1)
    asked = texts.mapInArrow(_sender(codes, parts, total), ROWS)
    # in one task a partition, whatever the session's number
    met = asked.repartition(parts, "part").groupBy("part").cogroup(rare.repartition(parts, "part").groupBy("part")).applyInArrow(_met(codes, total, spread), ROWS)
    tables = staged(met, "kind")
    del asked, met
    released(spark)
    r = range(DISCOUNT_UP_TO + 1)
    numbers = tables.where("kind = 'grams'").agg(*(F.sum(F.col("vec")[k]) for k in range(2 * len(r)))).first()
    d2, d3 = (np.array(discounts({k + 1: int(numbers[k + x] or 0) for k in r})) for x in (0, len(r)))
    vectors = lambda m: F.array(*(F.sum(F.col("vec")[k]) for k in range(m))).alias("vec")
    # at most one row a cached word
    hot = {x["key"]: (x["vec"], x["q"]) for x in tables.where("kind = 'hot'").groupBy("key").agg(vectors(6), F.sum("q").alias("q")).collect()}
    here, with_sums = _answered(d2, d3, total, hot)
    schema = "uid long, head boolean, blob binary"
    answers = tables.where("kind in ('head', 'asked')").select("kind", "uid", "blob").mapInArrow(here, schema)
    if hot:
        found = tables.where("kind = 'context'").select("part", "key", "blob").groupBy("key").applyInArrow(_added, "to int, adder long, blob binary")
        late = tables.where("kind = 'late'").select("part", "blob")
        answers = answers.unionByName(late.repartition(parts, "part").groupBy("part").cogroup(found.repartition(parts, "to").groupBy("to")).applyInArrow(with_sums, schema))
    rows = answers.groupBy("uid").applyInArrow(_summed, SCORED)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
