"""The stages of the pipeline and the whole of it on a small table with nulls, repeated rows, long and empty texts."""

import shutil
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from logfathom.llm import neardup, toxicity
from logfathom.llm.common import staged, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"p{k}" for k in range(60))
ROWS = [
    (9001, None, None, None, None), (9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, " \t\n ", "en", None, 4), (9004, " ".join(f"w{k % 977}" for k in range(30_000)), "en", "src1", 1),
    *[(9005, f"{PASSAGE} four", "en", "src1", 1)] * 50, (9006, f"{PASSAGE} five", "en", "src1", 1), (None, f"{PASSAGE} four", "en", "src1", 1), (None, f"{PASSAGE} four", "en", "src1", 1),
    (9005, "another text that only shares its id with the passage", "en", "src1", 1), (9006, "a second text that has the id of a copy that goes", "en", "src2", 1), (None, "some text with no id", "en", "src2", 1), (9007, "now password=hunter22 end", "en", "src2", 1),
]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for name in ("labels", "benchmark"):
        shutil.copy(Path(sf_dir) / f"{name}.parquet", top)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    docs.unionByName(spark.createDataFrame(ROWS, DOCS)).write.parquet(f"{top}/documents.parquet")
    return str(top)


def brute_deduplicated(rows, n, percent=80):
    """Rows by (id, text), linked by their shingle sets; the first of each component."""
    rows = sorted({tuple(r)[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else {tuple(w)} if w else set())

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s and t and 100 * (k := len(s & t)) >= percent * (len(s) + len(t) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    comps = {}
    for i, (d, t) in enumerate(rows):
        comps.setdefault(find(i), []).append((d, t))
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in comps.values()], comps


def test_deduplicated_keeps_one_row_a_component(spark, folder):
    docs = table(spark, folder, "documents")
    want, comps = brute_deduplicated(docs.collect(), 5)
    got = [tuple(r)[:2] for r in neardup.deduplicated(docs).collect()]
    assert Counter(d for d, _ in got) == Counter(d for d, _ in want)
    where = {r: k for k, c in comps.items() for r in c}
    assert Counter(where[r] for r in got) == Counter(dict.fromkeys(comps, 1))
    assert got.count((9005, f"{PASSAGE} four")) == 1 and (None, f"{PASSAGE} four") not in got
    assert (9006, "a second text that has the id of a copy that goes") in got
    assert neardup.deduplicated(docs.limit(0)).count() == 0


def test_stages_and_run(spark, folder):
    docs = table(spark, folder, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r["doc_id"] for r in docs.collect())
        out = staged(stage(spark, docs, folder))
        after = Counter(r["doc_id"] for r in out.collect())
        sizes.append(sum(after.values()))
        # the mix takes texts of small sources more than once
        assert set(after) <= set(before) if name == "mixing" else not after - before
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, folder, "labels"))
            scores = toxicity.with_score(docs, model, out="s").select("doc_id", "s").collect()
            assert after == Counter(r["doc_id"] for r in scores if r["s"] < toxicity.THRESHOLD)
        if name == "near_duplicates":
            assert after == Counter(d for d, _ in brute_deduplicated(docs.collect(), 5)[0])
        if name == "secrets":
            assert after == before and {r["text"] for r in out.where("doc_id = 9007").collect()} == {"now [assign] end"}
        docs = out
    assert 0 < sizes[-1] == corpus_pipeline.run(spark, folder).count()
