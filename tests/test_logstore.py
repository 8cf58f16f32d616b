"""The kept log table: what a second run reads, sources, the term index, retention, journal units."""

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from logfathom.functions import values as v
from logfathom.sources import files
from logfathom.sources.logstore import LogStore, follow_journal, journal_entries

LINE = "2026-09-21 11:02:0{0},000 [main] INFO a.B: m{0}\n"


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "in" / "deep" / "er").mkdir(parents=True)
    return LogStore(spark, f"file://{tmp_path}/store"), tmp_path / "in"


def ingest(store, folder, pattern="*"):
    """By file name: action, events added, bytes read."""
    return {r["Path"].rpartition("/")[2]: (r["Action"], r["Events"], r["ReadBytes"]) for r in store.ingest(str(folder), pattern).collect()}


def messages(store, name=None):
    rows = store.events()
    return sorted(r["Message"] for r in (rows if name is None else rows.where(F.col("SourceName") == name)).collect())


def test_ingestion_goes_on_where_it_stopped(store):
    store, d = store
    app, deep, zipped = d / "app.log", d / "deep" / "er" / "plain.log", d / "old.log.gz"
    app.write_text("".join(map(LINE.format, range(5))) + "2026-09-21 11:02:09,000 [ma")
    deep.write_text("one\ntwo\n")
    with gzip.open(zipped, "wt") as f:
        f.write(LINE.format(1) + LINE.format(2) + "unfinished")
    assert ingest(store, d) == {"app.log": ("new", 5, 5 * len(LINE.format(0))), "plain.log": ("new", 2, 8), "old.log.gz": ("new", 2, zipped.stat().st_size)}
    rows = {r["Path"].rpartition("/")[2]: r for r in store.sources().collect()}
    assert (rows["app.log"]["Format"], rows["app.log"]["Events"], rows["app.log"]["Lines"], rows["old.log.gz"]["Compressed"]) == ("python", 5, 5, True)
    assert rows["app.log"]["FirstEvent"] < rows["app.log"]["LastEvent"] and rows["app.log"]["Untimed"] == 0
    assert set(ingest(store, d).values()) == {("unchanged", 0, 0)}
    # appended: only the new bytes, from the last line end; line numbers go on
    with app.open("a") as f:
        f.write("in] INFO a.B: m9\n" + LINE.format(6))
    assert ingest(store, d)["app.log"] == ("appended", 2, 2 * len(LINE.format(0)))
    assert sorted(r["LineNumber"] for r in store.events().where("SourceName = 'app.log'").collect()) == list(range(1, 8))
    # touched only
    os.utime(deep, (1, 1))
    assert ingest(store, d)["plain.log"] == ("unchanged", 0, 0)
    # rewritten with the same size, and with fewer bytes
    app.write_text(app.read_text().replace("m0", "X0"))
    assert ingest(store, d)["app.log"] == ("rotated", 7, 7 * len(LINE.format(0)))
    assert messages(store, "app.log") == ["X0", "m1", "m2", "m3", "m4", "m6", "m9"]
    deep.write_text("x\n")
    assert ingest(store, d)["plain.log"] == ("rotated", 1, 2)
    assert messages(store) == sorted(["X0", "m1", "m2", "m3", "m4", "m6", "m9", "x", "m1", "m2\nunfinished"])
    # renamed, and a new file under the old name: both are read, nothing counts twice
    app.rename(d / "app.log.1")
    app.write_text(LINE.format(8))
    assert ingest(store, d)["app.log"][:2] == ("rotated", 1)
    assert messages(store, "app.log") == ["m8"] and len(messages(store, "app.log.1")) == 7
    assert {r["Path"].rpartition("/")[2]: r["Events"] for r in store.sources().collect()} == {"app.log": 1, "app.log.1": 7, "plain.log": 1, "old.log.gz": 2}


def test_failed_files_are_tried_again(store):
    store, d = store
    whole = gzip.compress("".join(f"line {k}\n" for k in range(2000)).encode())
    (d / "cut.gz").write_bytes(whole[: len(whole) // 2])
    (d / "ok.log").write_text("fine\n")
    assert ingest(store, d) == {"cut.gz": ("failed", 0, 0), "ok.log": ("new", 1, 5)}
    assert messages(store) == ["fine"]  # no line of half a file
    (d / "cut.gz").write_bytes(whole)
    assert ingest(store, d)["cut.gz"] == ("new", 2000, len(whole))
    assert len(messages(store)) == 2001
    assert store.ingest(str(d / "nothing.log")).first()["Action"] == "failed"
    bad = b"\xff\xfe bad bytes\n"
    (d / "bad.log").write_bytes(bad)
    assert ingest(store, d, "*.log")["bad.log"] == ("new", 1, len(bad))


def test_a_run_that_failed_leaves_nothing(store, spark, monkeypatch):
    store, d = store
    (d / "a.log").write_text("one\n")
    ingest(store, d)
    (d / "b.log").write_text("two\n")
    with monkeypatch.context() as m:
        m.setattr(LogStore, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.ingest(str(d))
    assert messages(store) == ["one"]  # written, but not committed
    store.enable(f"file://{d}/a.log", False)  # another commit does not bring it to light
    assert messages(store) == []
    store.enable(f"file://{d}/a.log")
    assert ingest(store, d)["b.log"] == ("new", 1, 4) and messages(store) == ["one", "two"]


def test_long_files_are_read_in_ranges_and_csv_goes_on(store, monkeypatch):
    store, d = store
    monkeypatch.setattr(files, "RANGE", 50)
    rows = [f"2026-01-02 03:04:{k:02},error,m{k}" for k in range(30)]
    (d / "t.csv").write_text("time,level,message\n" + "\n".join(rows[:20]) + "\n")
    assert ingest(store, d)["t.csv"][:2] == ("new", 20)
    with (d / "t.csv").open("a") as f:
        f.write("\n".join(rows[20:]) + "\n")
    assert ingest(store, d)["t.csv"][:2] == ("appended", 10)
    got = store.events().orderBy("LineNumber").collect()
    assert [r["Message"] for r in got] == [f"m{k}" for k in range(30)] and {r["Level"] for r in got} == {"error"}
    assert [r["LineNumber"] for r in got] == list(range(2, 32))


def _files(d):
    return {str(p.relative_to(d)): p.stat().st_mtime_ns for p in (d / "events").rglob("*.parquet")}


def test_sources_are_disabled_and_forgotten(store, tmp_path):
    store, d = store
    for k in range(40):
        (d / f"s{k}.log").write_text("".join(f"2026-09-{1 + j:02} 11:02:03,000 [main] INFO a.B: s{k} {j}\n" for j in range(3)))
    ingest(store, d)
    before = _files(tmp_path / "store")
    store.enable(f"file://{d}/s3.log", False)
    assert len(messages(store)) == 117 and _files(tmp_path / "store") == before
    (d / "s3.log").write_text("new\n")
    assert ingest(store, d)["s3.log"] == ("disabled", 0, 0)
    assert store.forget(f"file://{d}/s5.log") == 3 and len(messages(store)) == 114
    after = _files(tmp_path / "store")
    places = {(r["Run"], str(r["Day"]), r["Bucket"]) for r in store._raw().where("SourceName = 's7.log'").select("Run", "Day", "Bucket").collect()}
    bucket = store.spark.sql(f"select pmod(hash('file://{d}/s5.log'), 16)").first()[0]
    same = {k for k in before if f"Bucket={bucket}/" not in k}
    assert places and same and all(after.get(k) == before[k] for k in same)
    assert not any(k in after for k in before if f"Bucket={bucket}/" in k)
    assert "s5.log" not in {r["Path"].rpartition("/")[2] for r in store.sources().collect()}
    assert ingest(store, d)["s5.log"][:2] == ("new", 3) and len(messages(store)) == 117
    store.clear()
    assert not store.sources().count() and not store.events().count() and ingest(store, d)["s5.log"][:2] == ("new", 3)


def test_rare_terms_skip_files(store, monkeypatch):
    store, d = store
    for k in range(120):
        (d / f"f{k}.log").write_text("".join(f"2026-{1 + k % 12:02}-{1 + k // 12:02} 11:02:03,000 [main] INFO a.B: common word{j} of K{k}\n" for j in range(20)) + ("2026-05-05 11:02:03,000 [main] WARN a.B: Needle-in hay; Kelvin needles\n" if k == 77 else ""))
    ingest(store, d)
    total = store.events().count()
    for needle in ("needle", "in hay", "NEEDLE in HAY", "needles", "elvin", "word3", "common", "K77", "absent", "hay needle", "..."):
        want = sorted(r["EventId"] for r in store.events().where(v.has(F.col("Message"), needle)).collect())
        assert sorted(r["EventId"] for r in store.search(needle).collect()) == want, needle
    assert 0 < store.having("needle").count() < 0.01 * total * 2 and store.having("absent").count() == 0
    rows = [r for r in store.having("needle").select("Run", "Day", "Bucket").distinct().collect()]
    assert len(rows) == 1
    store.forget(f"file://{d}/f5.log")  # rewritten files are indexed again
    assert store.search("needle").count() == 1 and store.having("needle").count() < 0.02 * total
    monkeypatch.setattr("logfathom.sources.logstore.NAMED_FILES", 1)
    assert store.search("common").count() == total - 21


def test_retention(store, tmp_path):
    store, d = store
    for k in range(10):
        (d / f"d{k}.log").write_text("".join(f"2026-09-{1 + k:02} {j // 60 % 24:02}:{j % 60:02}:03,000 [main] INFO a.B: {k} {j} {hash((k, j))}\n" for j in range(600)))
    (d / "untimed.log").write_text("no time here\n")
    ingest(store, d)
    before = _files(tmp_path / "store")
    most = int(store.size() * 0.55)
    store.retain_bytes(most)
    after, kept = _files(tmp_path / "store"), store.events().groupBy("Day").count().collect()
    assert 0.4 * most < store.size() <= most
    days = sorted((str(r["Day"]), r["count"]) for r in kept if r["Day"])
    assert [n for _, n in days[1:]] == [600] * (len(days) - 1) and days[-1][0] == "2026-09-10" and None in {r["Day"] for r in kept}
    cut = days[0][0]
    assert all(after.get(k) == t for k, t in before.items() if f"Day={cut}" not in k and (f"Day={days[1][0]}" <= k[k.index("Day="):][:14] or "HIVE" in k))
    newest = store.events().where(F.col("Day") == cut).agg(F.min("Timestamp")).first()[0] if days[0][1] < 600 else None
    assert newest is None or store.events().where((F.col("Day") == cut) & (F.col("Timestamp") < newest)).count() == 0
    sums = {r["Path"].rpartition("/")[2]: r["Events"] for r in store.sources().collect()}
    assert sums["d0.log"] == 0 and sums["d9.log"] == 600 and sums["untimed.log"] == 1 and sum(sums.values()) == store.events().count()
    store.retain_age(dt.datetime(2026, 9, 11, 5, tzinfo=dt.timezone.utc), days=1)
    assert store.events().where("Day is not null").agg(F.min("Timestamp")).first()[0] >= dt.datetime(2026, 9, 10, 5) and store.events().where("Day is null").count() == 1


def entry(k, unit, message):
    return json.dumps({"__CURSOR": f"c{k}", "__REALTIME_TIMESTAMP": str(1_790_000_000_000_000 + k * 1_000_000), "PRIORITY": "3", "_SYSTEMD_UNIT": unit, "MESSAGE": message})


def test_journal_units_are_sources(spark, store, tmp_path):
    store, d = store
    lines = lambda rows: journal_entries(spark.createDataFrame([(entry(*r),) for r in rows], "line string"))
    store.ingest_journal(lines([(1, "ssh.service", "a"), (2, "ssh.service", "b"), (3, "cron.service", "c"), (9, "", "d")]), 0)
    units = lambda: {r["App"]: (r["Events"], r["Kind"]) for r in store.sources().collect()}
    assert units() == {"ssh.service": (2, "journal"), "cron.service": (1, "journal"), "journal": (1, "journal")}
    assert {r["App"] for r in store.events().collect()} == {"ssh.service", "cron.service", "journal"}
    again = [(4, "ssh.service", "e"), (5, "cron.service", "f")]
    store.enable("journal:cron.service", False)
    assert {r["Path"]: (r["Action"], r["Events"]) for r in store.ingest_journal(lines(again), 1).collect()} == {"journal:ssh.service": ("appended", 1)}
    before = (sorted(map(tuple, store.sources().select("Path", "Events", "FirstEvent", "LastEvent").collect())), store.version())
    assert store.ingest_journal(lines(again), 1) is None  # a replay
    assert (sorted(map(tuple, store.sources().select("Path", "Events", "FirstEvent", "LastEvent").collect())), store.version()) == before
    assert messages(store) == ["a", "b", "d", "e"]
    store.enable("journal:cron.service")
    assert messages(store) == ["a", "b", "c", "d", "e"] and units()["ssh.service"] == (3, "journal")
    assert store.forget_journal() == 5 and messages(store) == [] and units() == {}
    # as a stream: each batch once
    (d / "j.json").write_text(entry(1, "x.service", "one") + "\n")
    stream = lambda: follow_journal(store, spark.readStream.schema("line string").text(str(d)), f"{tmp_path}/check").awaitTermination()
    store = LogStore(spark, f"file://{tmp_path}/other")
    stream()
    (d / "k.json").write_text(entry(2, "x.service", "two") + "\n" + entry(3, "y.service", "three") + "\n")
    stream()
    stream()
    assert messages(store) == ["one", "three", "two"] and {k: n for k, (n, _) in units().items()} == {"x.service": 2, "y.service": 1}
