"""URL filter: rules, and for the rest host word segmentation with multinomial naive Bayes.

Concatenated host names are split into words by Viterbi over a unigram model, which is
counted from the titles and URLs of the corpus without the hosts: the parts of each distinct
name are looked up in the table of all words. A word that was never met costs, once, the share of words
met once (Good-Turing) and what a bigram model of letters gives it, so that a name is split only where
that is likelier than that it is one word.

Host words and path tokens are scored by naive Bayes with two classes. No labels exist: hosts with a
seed word teach the blocked class and the others the allowed one. Seed words are no features, so
the other words must tell; a host never teaches its own score, since counts are split into folds by
host and a page is scored by the folds that its host is not in. That a host has a seed word itself
counts as fixed odds (``SEED_ODDS``). Weights are a table of all tokens; tasks hold those of
the most frequent ones, the others are joined and summed a page.

Edge cases: a null URL or one without ``://`` has an empty host and path, meets no rule and
is judged by the prior alone; names of more than 63 letters, longer than a label of a host may be, are split in pieces
of that length, so that a host of any length is whole; repeated rows give repeated results and teach as often; at a
score of 0 a page is allowed; on an empty table the models are empty; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import staged

#: action, host, path
Rule = tuple[str, str, str]
# Rules as given, and words that mark a host as unwanted.
RULES: tuple[Rule, ...] = (("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/"))
SEEDS = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "warez", "xxx")
#: Labels that make a public suffix with the country after them, as in co.uk.
SECOND_LEVEL = frozenset(("ac", "co", "com", "edu", "gob", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch"))
#: Log odds of block for a seed word in the host itself; folds of hosts for scores that hosts do not teach themselves.
SEED_ODDS, FOLDS = 8.0, 5
#: The most frequent tokens whose weights every task holds; it changes no verdict.
CACHED_TOKENS = 100_000
#: Hosts whose words are broadcast to their pages; with more they are joined by shuffle.
HOSTS = 50_000
#: A label of a host has no more letters than this, so longer words stand in none.
LABEL = 63
STRINGS = ArrayType(StringType())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, AFTER_SCHEME, 1), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def rule_of(rules: Sequence[Rule], h: Column, p: Column) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits host and path, else nulls."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, name, start in sorted(rules, key=lambda r: len(f"{r[1]}/{r[2]}")):
        fits = ((h == name) | h.endswith(f".{name}")) & p.startswith(f"/{start}")
        text, action = F.when(fits, f"{name}/{start}").otherwise(text), F.when(fits, act).otherwise(action)
    return text, action


def _letters(word: str) -> str:
    """A word between its ends, its letters other than a to z as one."""
    return "$" + re.sub("[^a-z]", "*", word) + "$"


class Segmenter:
    """Splits a name into the most probable words; a word that was not met is judged by its letters."""

    def __init__(self, counts: dict[str, int], total: int | None = None, once: int | None = None, pairs: dict[str, int] | None = None):
        total = sum(counts.values()) if total is None else total
        once = sum(c == 1 for c in counts.values()) if once is None else once
        new = (once + 1) / (total + 2)
        self.counts, self.known, self.new = counts, math.log((1 - new) / max(total, 1)), math.log(new)
        first = Counter()
        for p, c in (pairs or {}).items():
            first[p[0]] += c
        self.pair = lambda p: math.log(((pairs or {}).get(p, 0) + 1) / (first[p[0]] + 28))
        self.longest = max(map(len, counts), default=1)
        self.memo: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        if name not in self.memo:
            if len(self.memo) >= 65536:
                self.memo.clear()
            self.memo[name] = self._split(name)
        return self.memo[name]

    def _split(self, name: str) -> tuple[str, ...]:
        s = _letters(name)[1:-1]
        inner = [0.0, *accumulate(self.pair(s[k : k + 2]) for k in range(len(s) - 1))]
        starts, ends = [self.pair("$" + x) for x in s], [self.pair(x + "$") for x in s]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(end):
                unknown = self.new + starts[start] + inner[end - 1] - inner[start] + ends[end - 1]
                c = self.counts.get(name[start:end]) if end - start <= self.longest else None
                options.append((best[start][0] + (math.log(c) + self.known if c else unknown), -start))
            score, start = max(options)  # of equal ones the longest word
            best.append((score, -start))
        words, end = [], len(name)
        while end:
            words.append(name[best[end][1] : end])
            end = best[end][1]
        return tuple(reversed(words))


def own_labels(h: str) -> list[str]:
    """The labels of a host before its public suffix; of an address or a lone label, all."""
    labels = [x for x in h.rpartition("@")[2].partition(":")[0].split(".") if x]
    if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL:
        return labels[:-2]
    return labels[:-1] or labels


@F.arrow_udf(STRINGS)
def _names(h: pa.Array) -> pa.Array:
    """Runs of letters in the labels of each host, none longer than a label may be."""
    return pa.array([[x for name in own_labels(v) for x in re.findall(rf"[^\W\d_]{{1,{LABEL}}}", name)] for v in h.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(STRINGS)
def _parts(names: pa.Array) -> pa.Array:
    return pa.array([list({x[a:b] for a in range(len(x)) for b in range(a + 2, min(a + LABEL, len(x)) + 1)}) for x in names.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(STRINGS)
def _path_tokens(p: pa.Array) -> pa.Array:
    """``p:`` tokens of each path; digits are one token."""
    return pa.array([["p:#" if t.isdigit() else f"p:{t.lower()}" for t in re.findall(r"\w+", x)] for x in p.to_pylist()], pa.list_(pa.string()))


def word_counts(pages: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """(w, c): counts of all words of titles and URLs without hosts; a seed has two at least."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*", "")  # a host must not teach that its name is one word
    text = F.lower(F.concat_ws(" ", title, rest))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w")).where(f"length(w) between 2 and {LABEL}").groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    known = pages.sparkSession.createDataFrame([(w, 2) for w in seeds], "w string, c long")
    return words.unionByName(known).groupBy("w").agg(F.max("c").alias("c"))


def host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, host_tokens): the ``h:`` words of each distinct host."""
    total, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1)).first()
    s = F.concat(F.lit("$"), F.regexp_replace("w", "[^a-z]", "*"), F.lit("$"))
    two = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda k: F.substr(s, k, F.lit(2)))).alias("p")).groupBy("p").count()
    pairs = {r["p"]: r["count"] for r in two.collect()}  # 28 letters: 784 rows at most

    @F.arrow_udf(STRINGS)
    def split(names: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(names.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([[f"h:{w}" for w in Segmenter({x["w"]: x["c"] for x in f or ()}, total, once, pairs).split(n)] for n, f in rows], pa.list_(pa.string()))

    # a number stands for a host, which may be long and have many names
    hosts = staged(hosts.select("host", F.monotonically_increasing_id().alias("id")))
    placed = staged(hosts.select("id", _names("host").alias("names")).select("id", F.posexplode("names").alias("pos", "name")))
    names = placed.select("name").distinct()
    parts = names.select("name", F.explode(_parts("name")).alias("w")).join(words, "w")
    found = parts.groupBy("name").agg(F.collect_list(F.struct("w", "c")).alias("found"))
    known = names.join(found, "name", "left").select("name", split("name", "found").alias("words"))
    one = placed.join(known, "name").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("x"))
    return hosts.join(one, "id", "left").select("host", F.coalesce(F.flatten("x.words"), F.array().cast("array<string>")).alias("host_tokens"))


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, seeds: Sequence[str] = SEEDS, cached: int = CACHED_TOKENS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the classifier's ``score`` (log odds of block)."""
    urls = pages.select("page_id", host().alias("host"), path().alias("path"))
    split = staged(host_tokens(urls.select("host").distinct(), staged(word_counts(pages, seeds))))
    known = F.array(*(F.lit(f"h:{s}") for s in seeds))
    split = split.select("host", F.arrays_overlap("host_tokens", known).alias("bad"), F.filter("host_tokens", lambda t: ~F.array_contains(known, t)).alias("host_tokens"))
    few = F.broadcast(split) if split.limit(HOSTS + 1).count() <= HOSTS else split
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    rows = staged(urls.join(few, "host").select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "bad", fold.alias("fold"), F.concat("host_tokens", _path_tokens("path")).alias("tokens")))
    each = range(FOLDS)
    # of each fold: what all others teach
    by_fold = {r["fold"]: (r["b"], r["g"]) for r in rows.groupBy("fold").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect()}
    others_taught = [[sum(by_fold.get(j, (0, 0))[c] for j in each if j != k) for c in (0, 1)] for k in each]
    priors = [math.log((b + 1) / (g + 1)) for b, g in others_taught]
    met = rows.select("fold", "bad", F.explode("tokens").alias("t"))
    taught = [f(F.col("fold") != k) for k in each for f in (lambda w: F.count_if(w & F.col("bad")), lambda w: F.count_if(w & ~F.col("bad")))]
    by_token = staged(met.groupBy("t").agg(F.array(*taught[::2]).alias("b"), F.array(*taught[1::2]).alias("g"), F.count(F.lit(1)).alias("c")))
    total = by_token.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for k in each for c in "bg")).first()
    v = total[0] + 1
    rest = [math.log((total[2 + 2 * k] + v) / (total[1 + 2 * k] + v)) for k in each]
    weight = F.array(*(F.log((F.col("b")[k] + 1) / (F.col("g")[k] + 1)) + rest[k] for k in each))
    top = by_token.orderBy(F.desc("c"), "t").limit(cached).select("t", weight.alias("x")).collect()
    weights = {r["t"]: r["x"] for r in top}

    @F.arrow_udf("double")
    def log_odds(tokens: pa.Array, fold: pa.Array) -> pa.Array:
        none = [0.0] * FOLDS
        return pa.array([priors[k] + sum(weights.get(t, none)[k] for t in ts) for ts, k in zip(tokens.to_pylist(), fold.to_pylist(), strict=True)], pa.float64())

    @F.arrow_udf(STRINGS)
    def others(tokens: pa.Array) -> pa.Array:
        return pa.array([[t for t in ts if t not in weights] for ts in tokens.to_pylist()], pa.list_(pa.string()))

    text, action = rule_of(rules, F.col("host"), F.col("path"))
    scored = rows.withColumn("score", log_odds(F.col("tokens"), F.col("fold")) + F.when(F.col("bad"), SEED_ODDS).otherwise(0.0))
    if total[0] > len(top):
        rare = rows.select("row", "fold", F.explode(others("tokens")).alias("t")).join(by_token.select("t", weight.alias("w")), "t").select("row", F.col("w")[F.col("fold")].alias("x"))
        scored = scored.join(rare.groupBy("row").agg(F.sum("x").alias("x")), "row", "left").withColumn("score", F.col("score") + F.coalesce("x", F.lit(0.0)))
    return scored.select("page_id", "host", "path", text.alias("rule"), F.coalesce(action, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
