"""Secret scan: keyword prefilter, anchored patterns near the hits, checksum validation.

An Aho-Corasick automaton finds the keywords in one pass over the text. Only where one
was found is an anchored pattern tried. Kinds whose format carries a checksum are kept
only if it fits. Runs of hexadecimal digits have no keyword; one pattern scans for them.

Edge cases: a null or empty text has no spans; texts of any length are scanned whole;
repeated rows give repeated results; an empty table gives an empty one. ``with_secret_spans``
replaces a column named like its output; ``redact`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# The formats as given.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyj",)}
#: A decoded token header with more brackets than this is none.
MAX_NESTING = 100
#: Where the first part of a token ends: no later start before it can match if this one does not.
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """The six check characters of a token: its CRC-32 in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out.rjust(6, "0")


def _jwt_header(part: str) -> bool:
    try:
        raw = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
        if raw.count(b"[") + raw.count(b"{") > MAX_NESTING:  # no header nests so deeply; the parser would recurse
            return False
        head = json.loads(raw)
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


#: Pattern and validation of the match, by kind. A match that fails is consumed all the same.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, lambda m: crc_base62(m[1]) == m[2]),
    "npm": (NPM, lambda m: crc_base62(m[1]) == m[2]),
    "jwt": (JWT, lambda m: _jwt_header(m[1])),
}


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, sorted by start, then by kind as listed."""
    if not text:
        return []
    found = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    past = dict.fromkeys(RULES, 0)
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = [(last - n + 1, kind) for last, (kind, n) in automaton().iter(lowered)]
    for start, kind in sorted(hits):
        pattern, valid = RULES[kind]
        if start < past[kind]:
            continue
        if m := pattern.match(text, start):
            past[kind] = m.end()
            if valid(m):
                found.append((start, kind, m.end()))
        elif kind == "jwt":  # so that a long run of starts is scanned once
            past[kind] = JWT_RUN.match(text, start).end()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


@F.arrow_udf(SPAN)
def _spans(text: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in spans(t)] for t in text.to_pylist()], SPAN_ARROW)


_spans = _spans.asNondeterministic()  # a filter on the result must not scan the text again


def with_secret_spans(df: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """Add the spans of all secrets of ``text`` (see the module) as ``out``."""
    return df.withColumn(out, _spans(F.col(text)))


@F.arrow_udf(T.StringType())
def _redacted(text: pa.Array, found: pa.Array) -> pa.Array:
    out = []
    for t, marks in zip(text.to_pylist(), found.to_pylist(), strict=True):
        if marks:
            parts, at = [], 0
            for m in marks:  # sorted by start; overlapping spans join
                if m["start"] >= at:
                    parts += [t[at : m["start"]], f"[{m['kind']}]"]
                at = max(at, m["end"])
            t = "".join([*parts, t[at:]])
        out.append(t)
    return pa.array(out, text.type)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace each secret (overlapping ones together) by its first kind in brackets; texts without one stay as they are."""
    found = df.select(F.struct("*").alias("row"), F.col(text).alias("text"), _spans(F.col(text)).alias("found"))
    clean = F.when(F.size("found") > 0, _redacted(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    return found.withColumn("row", F.col("row").withField(text, clean)).select("row.*")


def digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    found = with_secret_spans(df.select("doc_id", text), text, "_found")
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("_found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("_found")).alias("spans")
    )
