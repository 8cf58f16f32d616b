"""Questions over a time range, their runs, exact percentiles by selection and bounded lists."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from logfathom.functions.aggregates import AGGREGATES as agg
from logfathom.operators import select
from logfathom.plans.saved import Notebook, Question, Scope, in_folder

AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def both_arms(t):
    errors = t("events").where(F.col("event_type") == "error").project("user_id", "event_id")
    buys = t("events").where(F.col("event_type") == "purchase").project("user_id", "value")
    return errors.join(buys, "user_id", "inner").union(t("events").where(F.col("event_type") == "click").project("user_id"))


def broken(t):
    return t("events").where(F.col("nowhere") == 1)


def test_range_reaches_every_scan_and_runs_are_kept(spark, sf_dir, tmp_path):
    tables = in_folder(spark, sf_dir, {"events": "ts"})
    first, last = tables("events").df.agg(F.min("ts"), F.max("ts")).first()
    cut = first + (last - first) / 4
    scope = Scope(tables, None, cut)
    plan = both_arms(scope).df._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:]]
    assert len(scans) == 3 and all("LessThanOrEqual(ts" in s.split("ReadSchema")[0] for s in scans)
    assert scope("region").df.count() == 5  # without a time column, whole
    book = Notebook(spark, f"file://{tmp_path}/book", tables, {"arms": both_arms, "broken": broken, "all": lambda t: t("events").summarize(n=agg["count"]())})
    id_ = book.save(Question("all events", "all"))
    early = book.save(Question("early", "all", end=cut.isoformat()))
    bad = book.save(Question("wrong", "broken"))
    whole = book.run(id_).first()["n"]
    part = book.run(early).first()["n"]
    assert 0 < part < whole
    with pytest.raises(Exception, match="nowhere"):
        book.run(bad)
    runs = {r["name"]: r for r in book.last_runs().collect()}
    assert runs["all events"]["rows_read"] >= whole and runs["all events"]["rows_returned"] == 1 and runs["early"]["range_end"] is not None
    assert runs["wrong"]["error"] and runs["wrong"]["rows_returned"] is None
    book.run(id_)
    assert [q.name for q in book.questions()][0] == "all events" and book.last_runs(id_).count() == 2
    assert {r["name"]: (r["runs"], r["failed"]) for r in book.costs().collect()} == {"all events": (2, 0), "early": (1, 0), "wrong": (1, 1)}
    assert book.delete(bad) and not book.delete(bad) and len(book.questions()) == 2
    with pytest.raises(ValueError, match="no question"):
        book.save(Question("x", "missing"))
    assert Question("q", "all", last_seconds=60).bounds(AT) == (AT - dt.timedelta(seconds=60), AT)
    book.clear_runs()
    assert book.runs().count() == 0


def nearest(values, p):
    return sorted(values)[max(1, math.ceil(p / 100 * len(values))) - 1] if values else None


@pytest.mark.parametrize(("few", "accuracy"), [(50_000, 10_000), (20, 50)])
def test_percentiles_by_selection(spark, monkeypatch, few, accuracy):
    """Also where brackets are wide and several rounds are needed."""
    monkeypatch.setattr(select, "FEW", few)
    monkeypatch.setattr(select, "ACCURACY", accuracy)
    rng = random.Random(2)
    rows = [("hot", rng.choice([float(rng.randrange(5)), rng.gauss(0, 1e6), 7.0])) for _ in range(6000)] + [("nan", float("nan")), ("none", None), (None, 3.0), ("one", 1.5), ("nan", 2.0), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = (0, 1, 50, 50, 99.9, 100)
    got = {(r["g"], r["p"]): r["value"] for r in select.percentiles(df, ["g"], F.col("x"), ps).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = [x for h, x in rows if h == g and x is not None and math.isfinite(x)]
        want.update({(g, float(p)): nearest(own, p) for p in ps})
    assert got == want
    longs = spark.range(3000).select((F.col("id") + 2**60).alias("x"))
    assert [r["value"] for r in select.percentiles(longs, [], F.col("x"), [10]).collect()] == [2**60 + 299]
    assert select.percentiles(df.limit(0), ["g"], F.col("x"), [1]).count() == 0


def test_lists_are_cut_before_the_shuffle(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(100), rng.choice([None, rng.randrange(1000)])) for _ in range(3000)] + [("null", 1, None)]
    df = spark.createDataFrame(rows, "g string, o int, x int")
    found = select.first_values(df, ["g"], F.col("x"), [F.col("o"), (F.col("x"), "desc")], 5)
    want = {g: [x for _, _, x in sorted(((o, -x, x) for h, o, x in rows if h == g and x is not None))[:5]] for g in ("a", "b", "null")}
    assert {r["g"]: r["values"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit") :] and plan.rindex("WindowGroupLimit") > plan.rindex("Exchange hashpartitioning")
