"""Toxicity: a lexicon trie walked by Levenshtein automata, with context windows around hits.

The lexicon is learned from labelled rows: words, and stems of words, that toxic texts have
far more often than others. A text's words run through the product of the trie and the
edit-distance automaton; its states (sets of trie node and edits used) are made when first
met and kept, so that most words end after a few letters. Words of ``FUZZY_LENGTH`` letters
or more match within one edit. Around each hit a window decides whether the term is quoted
or reported, or used. The evidence for both is weighed by a logistic model.

Edge cases: a null or empty text has no hits and gets the score of such texts; texts of any
length are read whole; repeated rows give repeated results; a score at the threshold is toxic, and
of terms with equal evidence the first by name is taken; ``with_score`` replaces a column of its result's name; without labelled rows of both
classes the lexicon is empty and every score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: At most so many labelled rows of each class, those with the smallest hashes, teach lexicon and weights.
MAX_LABELLED = 10_000
#: A term is in so many toxic texts of the sample at least, and has such log odds. All such terms are kept;
#: as the sample is bounded, so are they.
MIN_TEXTS, MIN_ODDS = 8, 3.0
STEMS, FUZZY_LENGTH, WINDOW = (4, 5, 6), 5, 6
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
QUOTES = "\"“”„«»‘’"
# Verbs that report what others said, in the corpus' languages.
REPORTING = frozenset("said says called quoted wrote sagte nannte schrieb dit appela dijo llamó escribió écrit".split())


@dataclass
class Term:
    text: str
    stem: bool  # any word that starts with it, spelled exactly
    weight: float


@dataclass
class Lexicon:
    """Terms, and the lazily made deterministic automaton over trie node and edits."""

    terms: list[Term]
    max_states: int = 200_000
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, list[int]] = field(default_factory=dict)
    steps: list[dict[str, int]] = field(default_factory=list)
    states: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)

    def __post_init__(self) -> None:
        for k, t in enumerate(self.terms):
            at = 0
            for ch in t.text:
                at = self.nodes[at].setdefault(ch, len(self.nodes))
                if at == len(self.nodes):
                    self.nodes.append({})
            self.ends.setdefault(at, []).append(k)
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set[tuple]) -> frozenset:
        """With the trie letters that a misspelled word leaves out. An item: node, edits, a term whose stem is found."""
        out = set(items)
        for node, edits, stem in items:
            if edits == 0 and stem == "":
                out |= {(n, 1, "") for n in self.nodes[node].values()}
        return frozenset(out)

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.steps.append({})
        return self.states[items]

    def _step(self, state: int, ch: str) -> int:
        """The state after a letter; -1 if no term can be reached."""
        nxt: set[tuple] = set()
        for node, edits, stem in self.sets[state]:
            if stem != "":
                nxt.add((node, edits, stem))
                continue
            if (to := self.nodes[node].get(ch)) is not None:
                nxt.add((to, edits, ""))
                if edits == 0:
                    nxt |= {(to, 0, k) for k in self.ends.get(to, ()) if self.terms[k].stem}
            if edits == 0:
                nxt.add((node, 1, ""))  # a letter too many
                nxt |= {(n, 1, "") for n in self.nodes[node].values()}  # another letter
        to = self._state(self._closed(nxt)) if nxt else -1
        self.steps[state][ch] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest term, or None."""
        if len(self.sets) > self.max_states:  # begins anew instead of growing without bound
            self.steps, self.states, self.sets = [], {}, []
            self.start = self._state(self._closed({(0, 0, "")}))
        at, steps = self.start, self.steps
        for ch in word:
            to = steps[at].get(ch)
            at = self._step(at, ch) if to is None else to
            if at < 0:
                return None
        found = [(edits, k) for node, edits, stem in self.sets[at] for k in ([stem] if stem != "" else self.ends.get(node, ())) if stem != "" or edits == 0 or (len(self.terms[k].text) >= FUZZY_LENGTH and not self.terms[k].stem)]
        if not found:
            return None
        edits, k = min(found)
        return k, edits


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the window around a hit shows it as quoted or reported."""
    before, after = text[max(0, start - 80) : start], text[end : end + 80]
    near = WORD.findall(before.lower())[-WINDOW:]
    opened = any(q in before[-24:] for q in QUOTES) and any(q in after[:24] for q in QUOTES)
    return opened or any(w in REPORTING for w in near)


FEATURES = 6


def evidence(text: str | None, lexicon: Lexicon) -> list[float]:
    """Evidence of terms used and quoted, by distinct term, the same of misspelled ones, hits, and their density."""
    text = text or ""
    words = WORD.findall(text.lower())
    hits = {w: m for w in set(words) if (m := lexicon.match(w))}
    if not hits:
        return [0.0] * FEATURES
    found: tuple[dict, ...] = ({}, {}, {}, {})  # used, quoted; misspelled: used, quoted
    n = 0
    for m in WORD.finditer(text):
        if hit := hits.get(m[0].lower()):
            k, edits = hit
            n += 1
            found[2 * (edits > 0) + quoted(text, m.start(), m.end())][k] = lexicon.terms[k].weight
    return [*(math.log1p(sum(x.values())) for x in found), math.log1p(n), min(1.0, 20 * n / len(words))]


def _crc(mod: int = 3):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def held_out():
    """Rows that teach nothing; a null doc_id is not held out and has no label."""
    return F.coalesce(_crc() == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows of each class outside the held-out part; equal texts once."""
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    ids = None
    for kind in (True, False):
        part = own.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id")).limit(most)
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def learn_lexicon(sample: DataFrame) -> list[Term]:
    """Words and stems that toxic texts have far more often, the shortest that says it."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return []
    words = sample.select("h", "toxic", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))).alias("w")).where("length(w) between 4 and 40")
    kinds = [F.struct(F.col("w").alias("t"), F.lit(False).alias("stem"))] + [F.when(F.length("w") >= k, F.struct(F.substring("w", 1, k).alias("t"), F.lit(True).alias("stem"))) for k in STEMS]
    terms = words.select("h", "toxic", F.explode(F.array(*kinds)).alias("f")).where("f is not null").select("h", "toxic", "f.*").distinct()
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    counted = terms.groupBy("t", "stem").agg(F.count_if("toxic").alias("c1"), F.count_if(~F.col("toxic")).alias("c0")).where(F.col("c1") >= MIN_TEXTS).withColumn("odds", odds)
    rows = counted.where(F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), "t", "stem").collect()
    whole = {r["t"]: r for r in rows if not r["stem"]}
    chosen: list[Term] = []
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["t"]), r["t"])):
        one = [w for w in whole.values() if w["t"].startswith(r["t"])]
        if any(r["t"].startswith(t.text) for t in chosen) or (one and max(w["c1"] for w in one) >= 0.8 * r["c1"]):
            continue  # a shorter stem has it, or it is one word in fact
        chosen.append(Term(r["t"], True, r["odds"]))
    chosen += [Term(t, False, w["odds"]) for t, w in sorted(whole.items()) if not any(t.startswith(c.text) for c in chosen)]
    return sorted(chosen, key=lambda t: (-t.weight, t.text))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence_udf(terms: Iterable[Term]):
    lexicon = Lexicon(list(terms))

    @F.arrow_udf("array<double>")
    def found(text: pa.Array) -> pa.Array:
        return pa.array([evidence(t, lexicon) for t in text.to_pylist()], pa.list_(pa.float64()))

    return found.asNondeterministic()


@dataclass
class Model:
    terms: list[Term]
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Lexicon and weights from at most ``most`` labelled rows of each class."""
    sample = staged(labelled_sample(docs, labels, most))
    terms = learn_lexicon(sample)
    if not terms:
        return Model([], [])
    got = sample.select(_evidence_udf(terms)(F.col("text")).alias("x"), F.col("toxic").cast("double").alias("y"), "h").orderBy("h").limit(2 * most).collect()
    w = fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))
    return Model(terms, [float(v) for v in w])


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each text, from 0 to 1."""
    if not model.terms:
        return docs.withColumn(out, F.lit(0.0))
    lexicon, w, b = Lexicon(model.terms), np.array(model.weights[:-1]), model.weights[-1]

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([evidence(t, lexicon) for t in texts.to_pylist()]).reshape(-1, FEATURES)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w + b, -35, 35))), pa.float64())

    return docs.withColumn(out, score.asNondeterministic()(F.col(text)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = with_score(docs.select("doc_id", "text"), train(docs, labels), out="score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
