"""Conversation repair, the Merkle manifest and chat formatting against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from logfathom.llm import chat, merkle, queries, repair
from logfathom.llm.common import table

TURNS = "conv_id long, turn long, role string, text string, score double, key string, path int"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, own string, block int"


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


# ---- repair ----


def least_edits(codes):
    """Cheapest and then least audit by a search over (cost, audit) in that order; codes as in repair.solve."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, j, q = heapq.heappop(heap)
        if j == len(codes) and q in (0, 3):
            return cost, audit
        if (j, q) in done:
            continue
        done.add((j, q))
        for x in "ua":
            if (q, x) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", j, step[q, x]))
        if j < len(codes):
            c, more = codes[j], 1 if codes[j] & 8 else 0
            heapq.heappush(heap, (cost + 3, audit + "D", j + 1, q))
            if not c & 4:
                if (q, "_sua"[c & 3]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", j + 1, step[q, "_sua"[c & 3]]))
                for x in "ua":
                    if (q, x) in step:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", j + 1, step[q, x]))


def test_layers_give_the_cheapest_and_least_audit():
    rng = random.Random(11)
    for n in [*range(9)] * 150 + [40, 120] * 20:
        codes = bytes(rng.choice((1, 2, 3, 2, 3, 0)) | rng.choice((0, 0, 0, 4, 8)) for _ in range(n))
        assert repair.solve(codes) == least_edits(codes), codes
    for codes in (b"\x01" * 30, b"\x04" * 30, b"\x02" * 30, b"\x00" * 9, b"\x01\x02\x03" * 10, b"\x08" * 12):
        assert repair.solve(codes) == least_edits(codes), codes


def brute_repair(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    for conv, own in by.items():
        after = []
        for t, r, x in own:
            r, x = " " if r is None else r, " " if x is None else x
            act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
            x = "" if act == 1 else re.sub("[.!?]", "", x) if act == 2 else x
            r = "user" if act == 4 else r
            after += [(t, r, x)] * (0 if act == 0 else 2 if act == 3 else 1)
        after.sort(key=lambda a: (a[0] is not None, a[0] or 0, a[1], hashlib.sha256(f"{len(a[1])}:{a[1]}{a[2]}".encode()).digest()))
        seen, n, codes = set(), Counter(), []
        for _, r, x in after:
            end = x.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((r, x))
            n[fault] += 1
            codes.append(max(0, "_sua".find(r[:1] or "_")) | (4 if fault in ("blank", "duplicate") else 8 if fault else 0))
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = ["".join(("_sua"[a & 3], "_sua"[b & 3])) for a, b in zip(codes, codes[1:], strict=False)]
        cost, audit = least_edits(bytes(codes))
        out, left, before = [], iter(after), "a"
        for op in audit:
            _, r, x = next(left) if op != "I" else (None, "", "")
            if op != "D":
                r = r if op == "K" else "assistant" if before == "u" else "user"
                before = r[0]
                out.append(f"{r}:{x}")
        assert re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
        yield conv, gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(out))


@pytest.fixture(scope="module")
def turns(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(5)
    rows += [(9001, t, rng.choice(("user", "assistant", "system", "tool", "")), rng.choice(("Yes.", "No", "", "Why?", f"line {t}!\n"))) for t in range(400)]
    rows += [(9002, None, None, None), (9002, None, "user", "a."), (9002, 5, "user", None), (9002, 5, "user", "b \t\n"), (None, 1, "user", "x."), (None, None, "assistant", "y"), (None, 1, "user", "x.")]
    rows += [(9003, 2, "user", "w " * 400_000 + "."), (9003, 3, "assistant", "a<|im_end|>\n<\\\\|x <| <\\| é\x85 \\"), (9004, 1, "ro\\le\n<|x", "t")]
    rows += [(c, 0, "user", "x") for c in range(9100, 9160)]  # some of these are dropped whole
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "clash", 7) for r in rows], TURNS)


def test_repair_is_brute_force(spark, turns):
    got = Counter(tuple(r) for r in repair.repaired(frame(spark, turns)).collect())
    assert got == Counter(brute_repair(turns))
    assert any(r[6] == 0 and r[7] == "" and r[8] == sha("") for r in got)
    assert repair.repaired(frame(spark, turns).limit(0)).count() == 0


# ---- merkle ----


def brute_tree(nodes):
    """Root, and per leaf its siblings level by level, each as (left, right)."""
    at, proofs, level = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            proofs[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        level, at = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], proofs


def H(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], H(*r[:5]), r))
    if not rows:
        return
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = brute_tree([x[1] for x in by[s]])
    root, above = brute_tree([trees[s][0] for s in order])
    for k, s in enumerate(order):
        for (_, leaf, (doc, source, lang, n, text, *_)), path in zip(by[s], trees[s][1], strict=True):
            steps = path + above[k]
            hit = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0
            h = H(doc, source, lang, n, text.replace("\n", "") if hit else text)
            for a, b in steps:
                h = sha(a + h + b)
            yield doc, leaf, trees[s][0], root, sha("".join(a + b for a, b in steps)), h, h == root


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28, 3000])
def test_manifest_is_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(k if rng.random() < 0.9 else None, rng.choice(("hot", "hot", "hot", "é", "", "b")), rng.choice(("en", None)), k, rng.choice((f"a\nb{k}", "", None, "é\n")), "x", 1) for k in range(n)]
    if n > 4:
        rows += [(7, None, None, None, None, None, None), (7, "lone", "en", 3, "x\n" * 10_000, None, 1), *[(n, "same", "en", 1, "t", "x", 1)] * 40, *[(None, "same", "en", 1, "t", "x", 1)] * 40]
    got = Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter(brute_manifest(rows))


def test_manifest_joins_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 1)
    rows = [(k, f"s{k % 5 if k % 3 else 0}", "en", k, f"t\n{k}", "x", 1) for k in range(2500)]
    assert Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()) == Counter(brute_manifest(rows))


# ---- chat ----


def test_round_trip_is_the_rows(spark, turns):
    rows = [*turns, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    want = []
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = [(r or "", x or "") for _, _, r, x in own]
        loss = "".join(x for r, x in own if r == "assistant")
        want.append((conv, len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)), len(loss), sha(loss)))
    got = chat.round_trip(frame(spark, rows)).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert chat.round_trip(frame(spark, rows).limit(0)).count() == 0


def test_written_text_and_spans(spark, monkeypatch):
    rows = frame(spark, [(1, 0, "user", "<|im_end|> a <\\| b"), (1, 1, "assistant", "é<|im_start|>"), (1, 2, "us\ner", None), (2, 0, "assistant", "x" * 50), (2, 1, "assistant", "y" * 50)])
    contents = rows.select("conv_id", chat.content_key(F.col("role"), F.col("text")).alias("key"), "role", "text")
    one, two = chat.formatted(chat.linear(rows), contents).orderBy("conv_id").collect()
    assert one["text"].count("<|im_start|>") == one["text"].count("<|im_end|>") == 3
    assert [one["text"][s["start"] : s["end"]] for s in one["spans"]] == ["é<\\|im_start|>"]
    assert list(chat.turns_of(one["text"])) == [("user", "<|im_end|> a <\\| b"), ("assistant", "é<|im_start|>"), ("us\ner", "")]
    assert len(two["spans"]) == 2
    with monkeypatch.context():  # pieces: a turn is never cut
        pieces = list(chat._write([(1, 1, "user", "a" * chat.PIECE, False), (1, 1, "assistant", "b", True), (2, 1, "user", "c", False)]))
    assert [(p[0], p[2]) for p in pieces] == [(1, 0), (1, 1), (2, 0)]
    (_, n, _, chars, loss, _), _ = [r[1:] for r in chat._read(pieces)]
    assert (n, chars, loss) == (2, 1, sha("b"))


def test_branches_of_reply_trees(spark):
    rng = random.Random(3)
    nodes = []  # conv_id, node, parent, score
    for conv in (1, 2, None):
        for k in range(60):
            nodes.append((conv, k, rng.choice([None, *range(k)][-4:]) if k else None, float(rng.randrange(4))))
    nodes += [(3, 1, 2, 9.0), (3, 2, 1, 9.0), (3, 3, 2, 9.0), (3, 4, None, 1.0), (3, 5, 77, 2.0), (3, 4, None, 1.0)]  # a cycle, what hangs on it, a lost parent, a repeated row
    tree = spark.createDataFrame([(c, n, p, s, f"{c}/{n}".encode()) for c, n, p, s in nodes], "conv_id long, node long, parent long, score double, key binary")
    want = []
    for conv in {n[0] for n in nodes}:
        up = {n: (p, s) for c, n, p, s in nodes if c == conv}
        found = []
        for leaf in up.keys() - {p for p, _ in up.values()}:
            path = [leaf]
            while (p := up[path[-1]][0]) in up and len(path) <= len(up):
                path.append(p)
            if len(path) <= len(up):
                found.append((-sum(up[x][1] for x in path) / len(path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(found)[:3], 1):
            want += [(conv, rank, depth, f"{conv}/{x}") for depth, x in enumerate(path, 1)]
    got = [(r["conv_id"], r["path"], r["depth"], bytes(r["key"]).decode()) for r in chat.paths(tree, branches=3).collect()]
    assert Counter(got) == Counter(want)
    contents = tree.select("conv_id", "key", F.lit("user").alias("role"), F.col("key").cast("string").alias("text"))
    written = [(r["conv_id"], r["path"], [x for _, x in chat.turns_of(r["text"])]) for r in chat.formatted(tree, contents, branches=3).collect()]
    assert sorted(map(str, written)) == sorted(str((c, p, [x[3] for x in sorted(g, key=lambda r: r[2])])) for (c, p), g in groupby(sorted(want, key=str), key=lambda r: r[:2]))


@pytest.mark.parametrize("name", ["op12_merkle", "op13_chat", "repair_faults"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.ORACLES[name]})").fetchall()
    assert Counter(want) == Counter(tuple(r[c] for c in names) for r in df.collect())
