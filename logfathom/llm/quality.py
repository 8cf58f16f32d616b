"""Quality rules: statistics of each text, and a decision list learned from labelled ones.

Sequential covering: a rule for bad texts is grown, condition by condition, on two thirds
of the labelled rows, pruned on the rest, and what it covers is taken out, until no rule
pays. The list becomes ordered Spark conditional expressions (``CASE WHEN``).

Edge cases: a null or empty text has zero words and fails the base rule; texts of any
length are read whole; repeated rows give repeated results; of conditions that gain equally the first in the order of features is
taken, and of rules that fit a text the first in the list; columns of the results replace those of the same name; without labelled rows of both
classes the list is empty and keeps everything; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

#: At most so many labelled rows, those with the smallest hashes, are used to learn the list.
MAX_LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_digits")
SYMBOLS, GAPS = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 5


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words in windows of ``n`` words that the text has twice or more."""
    if len(words) <= n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(w)]
    order = np.argsort(w)
    same = w[order[1:]] == w[order[:-1]]
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    if not again.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    edge[:-n] += again
    edge[n:] -= again
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, seen, dup = raw.split(b"\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
    chars = len(text) - sum(map(text.count, GAPS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), len(set(words)), len(lines), sum(map(text.count, "0123456789"))


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(text: pa.Array) -> pa.Array:
    columns = list(zip(*map(counts, text.to_pylist()), strict=True)) or [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


_counts = _counts.asNondeterministic()


def features() -> dict[str, Column]:
    """What the rules may test, from the counts: all are defined for empty texts."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
        "digits_per_char": per("n_digits", "word_chars"),
    }


Condition = tuple[int, bool, float]  # feature, at least (else below), threshold


def _holds(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, at_least, t in rule:
        ok &= (x[:, f] >= t) == at_least
    return ok


def _grown(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> list[Condition]:
    """Add the condition of the largest information gain until no good text is covered."""
    rule: list[Condition] = []
    on = np.ones(len(x), bool)
    while (on & ~bad).any() and len(rule) < 6:
        p, n = int((on & bad).sum()), int((on & ~bad).sum())
        base, best = np.log2(p / (p + n)), (0.0, None)
        for f, ts in enumerate(cuts):
            at = np.searchsorted(ts, x[on, f], side="right")  # thresholds that a value reaches
            for sign in (True, False):
                hit = lambda y: np.bincount(at[y], minlength=len(ts) + 1)  # noqa: B023, E731
                ps, ns = (np.cumsum(hit(y)[::-1])[::-1][1:] if sign else np.cumsum(hit(y))[:-1] for y in (bad[on], ~bad[on]))
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1e-9) / np.maximum(ps + ns, 1e-9)) - base), 0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), (f, sign, float(ts[int(gain.argmax())])))
        if best[1] is None:
            break
        rule.append(best[1])
        on = _holds(x, rule)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 12) -> list[list[Condition]]:
    """The decision list: rules for bad rows, in order. Rows come in a random but fixed order."""
    part = np.arange(len(x)) % 3 == 0
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and (left & bad & ~part).any() and (left & ~bad).any():
        g, v = left & ~part, left & part
        cuts = [np.unique(np.quantile(x[g, f], np.linspace(0, 1, 129)[1:-1], method="nearest")) for f in range(x.shape[1])]
        rule = _grown(x[g], bad[g], cuts)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            on = _holds(x[v], r)  # noqa: B023
            p, n = (on & bad[v]).sum(), (on & ~bad[v]).sum()  # noqa: B023
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        if worth(rule) < 0.5:
            break
        rules.append(rule)
        left &= ~_holds(x, rule)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that a row meets, from 1, else null, as ordered conditional expressions."""
    cols = list(features().values())
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, at_least, t in rule:
            test &= (cols[f] >= t) if at_least else (cols[f] < t)
        out = out.when(test, k) if out is not None else F.when(test, k)
    return out if out is not None else F.lit(None).cast("int")


def judged(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: its counts, ``base_failed``, ``rule`` (the first that it meets) and ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (0 for bad); rows with a null in either are left out.
    """
    stats = staged(docs.select("doc_id", _counts(F.col("text")).alias("_c")).select("doc_id", "_c.*"))
    some = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(max_labelled)
    rows = stats.join(F.broadcast(some), "doc_id").select((F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("at"), *(c.alias(n) for n, c in features().items()))
    got = rows.orderBy("at", *features()).limit(max_labelled).toPandas()
    rules = learn(got[list(features())].to_numpy(float), got["bad"].to_numpy(bool)) if len(got) else []
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumns({"base_failed": failed, "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
