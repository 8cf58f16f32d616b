"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, katz, merkle, mixing, neardup, quality, repair, secrets, substrings, toxicity, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more))


def repair_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op11_repair`` that need no search for the cheapest edits."""
    return op11_repair(spark, sf_dir).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op3_quality`` that the learned rules do not touch."""
    return op3_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_urls`` that the learned scores do not touch."""
    return op8_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op9_secrets`` that kinds with a checksum do not touch."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


OPERATORS = (op1_warc, op2_decontaminate, op3_quality, op4_toxicity, op5_mixing, op6_substrings, op7_katz, op8_urls, op9_secrets, op10_neardup, op11_repair, op12_merkle, op13_chat)
QUERIES: dict[str, Query] = {f.__name__: f for f in (*OPERATORS, quality_base, url_rules, secrets_base, repair_faults)}

# ---- the same in SQL; models (op3's rules, op4, op7, op8's scores) and the hashes of op5 have none ----

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TOKENS = rf"list_filter(string_split_regex({_LOWER.format('text')}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


#: CRC-32 of an ASCII text: bit by bit, over its characters.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, place: int, pattern: str, valid: str) -> str:
    """Matches and their places in code points, from the pieces between them."""
    return f"""SELECT doc_id, id, '{kind}' AS kind, {place} AS place, start_at, start_at + length(m) AS end_at FROM (
    SELECT doc_id, id, unnest(m) AS m, unnest(b) AS b, unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)))::BIGINT AS start_at
    FROM (SELECT doc_id, id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {2 if kind == "assign" else 0}) AS b, string_split_regex(text, '{pattern}') AS p FROM d) WHERE len(m) > 0) WHERE {valid}"""


ORACLES: dict[str, str] = {
    "op1_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, nullif(first, page_id) AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100""",
    "op2_decontaminate": rf"""
WITH i AS (SELECT DISTINCT item_id, {_TOKENS} AS w FROM benchmark), lengths AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
theirs AS (SELECT item_id, w, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j+k-1], ' ')))) AS s FROM (SELECT *, least(len(w), 5) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT item_id, w, count(*) AS n_item FROM theirs GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, text, {_TOKENS} AS w FROM documents),
mine AS (SELECT DISTINCT doc_id, text, s FROM (SELECT doc_id, text, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j+k-1], ' '))) AS s FROM d, lengths)),
shared AS (SELECT doc_id, text, item_id, w, count(*) AS n_shared FROM mine JOIN theirs USING (s) GROUP BY ALL),
best AS (SELECT doc_id, item_id, max((n_shared, n_item)) AS b FROM shared JOIN sizes USING (item_id, w) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9) GROUP BY ALL)
SELECT doc_id, item_id, b[1] AS n_shared, b[2] AS n_item, b[1] / b[2] AS containment FROM best""",
    "op6_substrings": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word, unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i+19], ' ') END)) AS run FROM d),
q AS (SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, pos) > 1 AS again FROM p),
r AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM q),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM r GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id""",
    "op10_neardup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = a""",
    "quality_base": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT id, sum(n - 1) AS n FROM (SELECT id, line, count(*) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) GROUP BY ALL) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
runs AS (SELECT id, unnest(range(1, len(w) - 3)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS run FROM d),
again AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(pos, pos + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY id, run) AS c FROM runs) WHERE c > 1) GROUP BY 1),
t AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN lines USING (id) LEFT JOIN again USING (id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM t""",
    "url_rules": rf"""
WITH u AS (SELECT page_id, {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, CASE
WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u""",
    "secrets_base": f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans("assign", 0, _ASSIGN, "length(b) >= 6")} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_spans("hex", 2, "[0-9a-f]{24,}", "true")})
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
sha256(coalesce(string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, place), '')) AS base_sha256 FROM d LEFT JOIN s USING (id) GROUP BY d.id""",
    "op12_merkle": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="CASE WHEN " + _CRC.format("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS lvl, i, leaf AS h, n FROM o UNION ALL SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lvl, i // 3),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, h, n FROM s UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, i // 3),
g AS (SELECT source, lvl, i // 3 AS g, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL),
k AS (SELECT lvl, i // 3 AS g, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY ALL),
upper AS (SELECT s.source, list({{'l': array_to_string(hs[:a], ''), 'r': array_to_string(hs[a+2:], ''), 'h': ''}} ORDER BY lvl) AS steps FROM (SELECT s.*, lvl, hs, (i // (3 ** lvl)::BIGINT) % 3 AS a FROM s JOIN k ON k.g = i // (3 ** (lvl + 1))::BIGINT) s GROUP BY 1),
lower AS (SELECT source, i, list({{'l': array_to_string(hs[:a], ''), 'r': array_to_string(hs[a+2:], ''), 'h': ''}} ORDER BY lvl) AS steps FROM (SELECT o.source, i, lvl, hs, (i // (3 ** lvl)::BIGINT) % 3 AS a FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source AND g.g = i // (3 ** (lvl + 1))::BIGINT) GROUP BY 1, 2),
p AS (SELECT doc_id, leaf, other, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(lower.steps, []), coalesce(upper.steps, [])) AS steps
    FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source LEFT JOIN lower ON o.source IS NOT DISTINCT FROM lower.source AND o.i = lower.i LEFT JOIN upper ON o.source IS NOT DISTINCT FROM upper.source),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) AS proof_sha256, list_reduce(list_prepend({{'l': '', 'r': '', 'h': other}}, steps), lambda a, x: {{'l': '', 'r': '', 'h': sha256(x.l || a.h || x.r)}}).h AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM f""",
    "op13_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(24 + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars FROM c GROUP BY 1""",
    "repair_faults": rf"""
WITH a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS act FROM conversations),
r AS (SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM (SELECT *, unnest(range(CASE act WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM a)),
o AS (SELECT *, lag(role[1]) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS k, right(regexp_replace(text, '[ 	-]+$', ''), 1) AS last FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (last = '') AS blank, count(*) FILTER (last <> '' AND k > 1) AS duplicate, count(*) FILTER (last NOT IN ('', '.', '!', '?') AND k = 1) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id""",
}
