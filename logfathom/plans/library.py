"""Ready-made log questions, as functions of a log ``Table``.

A log table has Timestamp, Level, Message, App, Source, SourceName, Format, Location,
LineNumber, Raw, Extra (JSON text) and EventId (see ``sources.formats``). ``QUERIES`` holds
category, title and function of each. ``OVER_TABLES`` holds the questions over the source
table (``sources.ingest.source_table``), the scans and the detections of a virus scanner;
their functions take these tables by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.aggregates import AGGREGATES as agg
from ..functions.scalar import fn
from ..operators.table import Table

c = F.col
BAD = ("error", "critical", "alert", "emergency")
SHOWN = ("Timestamp", "Level", "App", "Message")


@dataclass(frozen=True)
class Query:
    category: str
    title: str
    run: Callable[[Table], Table]


QUERIES: dict[str, Query] = {}
OVER_TABLES: dict[str, Query] = {}


def _add(id_: str, category: str, title: str):
    def keep(f):
        QUERIES[id_] = Query(category, title, f)
        return f

    return keep


def bad() -> F.Column:
    return F.lower("Level").isin(*BAD)


def template(message: F.Column) -> F.Column:
    """A message with its numbers, hashes and addresses masked, so that repeats of a kind group together."""
    return F.substring(F.regexp_replace(F.regexp_replace(message, r"\b[0-9a-fA-F]{8,}\b", "#"), r"\d+", "#"), 1, 160)


def newest(t: Table, n: int = 200) -> Table:
    return t.top(n, "Timestamp", "EventId").project(*SHOWN)


def _words(*words: str, n: int = 200):
    return lambda t: newest(t.where(v.has_any(c("Message"), *words)), n)


_add("recent", "start", "The latest events")(newest)
_add("recent-errors", "start", "The latest errors")(lambda t: newest(t.where(bad())))
_add("by-app", "start", "Events by application")(lambda t: t.summarize(by="App", Count=agg["count"]()).sort_by("Count", ("App", "asc")))
_add("search-text", "start", "A word anywhere")(lambda t: newest(t.search("failed")))
_add("timechart", "start", "Events by hour")(lambda t: t.where(c("Timestamp").isNotNull()).summarize(by={"Hour": fn.bin(c("Timestamp"), "1h")}, Count=agg["count"]()).sort_by(("Hour", "asc")).render("timechart"))


@_add("error-rate", "errors", "Share of errors by application")
def error_rate(t: Table, least: int = 10) -> Table:
    rows = t.summarize(by="App", Events=agg["count"](), Errors=agg["countif"](bad())).where(c("Events") >= least)
    return rows.extend(Percent=fn.round(100.0 * c("Errors") / c("Events"), 1)).sort_by("Percent", ("App", "asc"))


@_add("error-storms", "errors", "The same error again and again")
def error_storms(t: Table, least: int = 5) -> Table:
    rows = t.where(bad()).summarize(by={"App": c("App"), "Template": template(c("Message"))}, Count=agg["count"](), First=agg["min"](c("Timestamp")), Last=agg["max"](c("Timestamp")))
    return rows.where(c("Count") >= least).top(100, "Count", ("App", "asc"), ("Template", "asc"))


_add("crashes", "errors", "Crashes")(_words("segfault", "core dumped", "panic", "crashed", "SIGSEGV", "SIGABRT", "unhandled exception"))
_add("out-of-memory", "errors", "Memory ran out")(_words("out of memory", "oom", "cannot allocate memory"))


@_add("first-seen", "errors", "Messages that are new on the last day")
def first_seen(t: Table, day: str = "1d") -> Table:
    rows = t.where(bad(), c("Timestamp").isNotNull()).summarize(by={"App": c("App"), "Template": template(c("Message"))}, First=agg["min"](c("Timestamp")), Count=agg["count"]())
    last = t.summarize(m=agg["max"](c("Timestamp"))).scalar()
    return rows.where(c("First") >= last - F.lit(v.span(day))).top(100, "First", ("Template", "asc"))


_add("failed-units", "errors", "Services that failed")(lambda t: newest(t.where(v.has(c("Message"), "failed") & v.has_any(c("Message"), "unit", "service"))))
AUTH = ("authentication failure", "failed password", "invalid user", "permission denied", "access denied")
_add("auth-failures", "security", "Failed logins")(_words(*AUTH))
_add("shell-pipelines", "security", "Downloads piped into a shell")(lambda t: newest(t.where(v.matches(c("Message"), r"(?i)(curl|wget)[^|]*\|\s*(ba|z|da)?sh\b"))))
_add("encoded-commands", "security", "Long encoded payloads")(lambda t: newest(t.where(v.matches(c("Message"), r"[A-Za-z0-9+/]{120,}={0,2}"))))
ADDRESS = r"\b((?:\d{1,3}\.){3}\d{1,3})\b"


@_add("network-addresses", "security", "Addresses outside private networks")
def addresses(t: Table) -> Table:
    rows = t.extend(Address=fn.extract(ADDRESS, 1, c("Message"))).where(v.yes(~fn.ipv4_is_private(c("Address"))))
    return rows.summarize(by="Address", Count=agg["count"](), Apps=agg["dcount"](c("App"))).top(200, "Count", ("Address", "asc"))


@_add("urls", "security", "Hosts of addresses in messages")
def urls(t: Table) -> Table:
    rows = t.extend(Host=fn.extract(r"https?://([^\s/:'\"<>]+)", 1, c("Message"))).where(c("Host").isNotNull())
    return rows.summarize(by="Host", Count=agg["count"]()).top(200, "Count", ("Host", "asc"))


_add("sudo-and-privilege", "security", "Use of privileges")(_words("sudo", "pkexec", "polkit", "setuid", "su"))


@_add("odd-hours", "security", "Applications at night")
def odd_hours(t: Table) -> Table:
    return t.extend(Hour=fn.hourofday(c("Timestamp"))).where(c("Hour").between(1, 4)).summarize(by="App", Events=agg["count"]()).top(50, "Events", ("App", "asc"))


@_add("new-sources", "security", "Logs that appeared on the last day")
def new_sources(t: Table, day: str = "1d") -> Table:
    last = t.summarize(m=agg["max"](c("Timestamp"))).scalar()
    return t.summarize(by="Source", First=agg["min"](c("Timestamp")), Events=agg["count"]()).where(c("First") >= last - F.lit(v.span(day))).sort_by("First", ("Source", "asc"))


@_add("gaps", "security", "Silences of a log")
def gaps(t: Table, least: str = "6h") -> Table:
    rows = t.where(c("Timestamp").isNotNull()).sort_by(("Timestamp", "asc"), ("EventId", "asc")).prev(by=["Source"], Before=(c("Timestamp"),))
    rows = rows.extend(Gap=F.unix_micros("Timestamp") - F.unix_micros("Before")).where(c("Gap") > v.span(least) // v.MICRO)
    return Table(rows.raw.select(*rows.columns)).summarize(by="Source", Gaps=agg["count"](), Longest=agg["max"](c("Gap"))).top(100, "Longest", ("Source", "asc"))




@_add("one-app", "applications", "Everything one application wrote")
def one_app(t: Table, app: str = "kernel", n: int = 300) -> Table:
    return t.where(c("App") == app).top(n, "Timestamp", "EventId").project("Timestamp", "Level", "Message")


_add("app-levels", "applications", "Levels by application")(lambda t: t.summarize(by=["App", "Level"], Count=agg["count"]()).sort_by(("App", "asc"), "Count", ("Level", "asc")))
_add("app-first-last", "applications", "Life of each application's log")(lambda t: t.where(c("Timestamp").isNotNull()).summarize(by="App", First=agg["min"](c("Timestamp")), Last=agg["max"](c("Timestamp")), Events=agg["count"]()).sort_by("Last", ("App", "asc")))
_add("chatty-files", "applications", "The largest logs")(lambda t: t.summarize(by=["Source", "App"], Events=agg["count"]()).top(50, "Events", ("Source", "asc")))
_add("extra-fields", "applications", "Names of extra fields")(lambda t: t.mv_expand(Field=fn.bag_keys(c("Extra"))).summarize(by=["App", "Field"], Count=agg["count"]()).sort_by("Count", ("App", "asc"), ("Field", "asc")).take(500))
_add("per-day", "volume", "Events by day")(lambda t: t.where(c("Timestamp").isNotNull()).summarize(by={"Day": fn.startofday(c("Timestamp"))}, Count=agg["count"]()).sort_by(("Day", "asc")).render("columnchart"))
_add("errors-over-time", "volume", "Errors by hour and application")(lambda t: t.where(bad(), c("Timestamp").isNotNull()).summarize(by={"Hour": fn.bin(c("Timestamp"), "1h"), "App": c("App")}, Count=agg["count"]()).sort_by(("Hour", "asc"), ("App", "asc")).render("timechart"))
_add("busiest-hours", "volume", "Hours of the day")(lambda t: t.where(c("Timestamp").isNotNull()).summarize(by={"Hour": fn.hourofday(c("Timestamp"))}, Count=agg["count"]()).sort_by(("Hour", "asc")).render("columnchart"))


@_add("spikes", "volume", "Hours with far more events than the one before")
def spikes(t: Table, times: float = 3.0, least: int = 20) -> Table:
    hours = t.where(c("Timestamp").isNotNull()).summarize(by={"App": c("App"), "Hour": fn.bin(c("Timestamp"), "1h")}, Count=agg["count"]())
    rows = hours.sort_by(("Hour", "asc")).prev(by=["App"], Before=(c("Count"),)).where(c("Count") >= least, c("Count") >= times * c("Before"))
    return Table(rows.raw.select(*rows.columns)).top(100, "Count", ("App", "asc"), ("Hour", "asc"))


_add("level-share", "volume", "Share of each level")(lambda t: t.summarize(by="Level", Count=agg["count"]()).sort_by("Count", ("Level", "asc")).render("piechart"))
_add("no-timestamps", "index", "Logs without times")(lambda t: t.summarize(by="Source", Events=agg["count"](), Untimed=agg["countif"](c("Timestamp").isNull())).where(c("Untimed") > 0).extend(Percent=fn.round(100.0 * c("Untimed") / c("Events"), 1)).top(100, "Untimed", ("Source", "asc")))
_add("format-breakdown", "index", "Events by format")(lambda t: t.summarize(by="Format", Events=agg["count"](), Logs=agg["dcount"](c("Source"))).sort_by("Events", ("Format", "asc")))
SESSIONS = ("session opened", "session closed", "incorrect password", "a password is required")
LOGIN_SERVICES = ("sshd", "sudo", "polkit", "systemd-logind", "login", "sddm", "gdm")
_journal = lambda t: t.where(c("Format") == "journal")
_add("journal-units", "journal", "Events by unit")(lambda t: _journal(t).summarize(by="App", Events=agg["count"](), Errors=agg["countif"](bad())).sort_by("Events", ("App", "asc")))
_add("journal-failures", "journal", "Errors of the journal")(lambda t: newest(_journal(t).where(bad())))
_add("journal-kernel", "journal", "The kernel's messages")(lambda t: newest(_journal(t).where(fn.member(c("Extra"), "transport") == "kernel")))
_add("journal-authentication", "journal", "Logins in the journal")(lambda t: newest(_journal(t).where(v.has_any(c("Message"), *SESSIONS, *AUTH) | v.has_any(c("App"), *LOGIN_SERVICES))))
_add("journal-vs-files", "journal", "Journal and files")(lambda t: t.summarize(by={"Kind": F.when(c("Format") == "journal", "journal").otherwise("files")}, Events=agg["count"]()).sort_by("Events").render("piechart"))
_add("journal-boot", "journal", "Events by boot")(lambda t: _journal(t).summarize(by={"Boot": fn.member(c("Extra"), "boot")}, Events=agg["count"](), First=agg["min"](c("Timestamp")), Last=agg["max"](c("Timestamp"))).sort_by("First"))

#: Lines that meet a moment as one run.
RUN = 128


def in_context(moments: Table, log: Table, time: str, around: str = "5m", keep: tuple[str, ...] = ("Timestamp", "App", "Message")) -> Table:
    """Log lines within ``around`` of the rows of ``moments``: an equality join on time buckets, then the exact distance."""
    step = v.span(around)
    n = F.lit(step // v.MICRO)
    bucket = lambda x: F.floor(F.unix_micros(x) / n)
    near = moments.raw.select(*moments.columns).withColumn("_b", F.explode(F.array(*(bucket(c(time)) + k for k in (-1, 0, 1)))))
    # a small file has many matches: both sides are dealt by bucket, so that not the few tasks of its scan make all rows
    lines = log.raw.select(*keep).where(c("Timestamp").isNotNull()).withColumn("_b", bucket(c("Timestamp"))).repartition("_b")
    lines = lines.join(near.select("_b").distinct(), "_b", "left_semi")
    # lines next to each other in time meet a moment as one run, which is listed again for the next moment: what is written repeats and so stays small
    at = F.unix_micros("Timestamp")
    runs = lines.withColumn("_run", F.floor((F.row_number().over(Window.partitionBy("_b").orderBy("Timestamp")) - 1) / RUN))
    runs = runs.groupBy("_b", "_run").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.collect_list(F.struct(*keep)).alias("_lines"))
    # a task's rows are far more than what it reads: partitions given by number are not merged, so tasks stay even and a file has few enough lines for a dictionary
    near = near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_b")
    pairs = runs.join(near, "_b").where((F.unix_micros(c(time)) + n >= c("_first")) & (F.unix_micros(c(time)) - n <= c("_last")))
    rows = pairs.select(*moments.columns, F.inline("_lines"))
    return Table(rows.where(F.abs(F.unix_micros(c(time)) - at) <= n))


SCANNERS = ("clamav", "clamd", "freshclam")


@_add("scanner-log", "scanner", "The virus scanner's own lines")
def scanner_log(t: Table) -> Table:
    own = v.has_any(c("App"), *SCANNERS) | F.contains(F.lower("Source"), F.lit("clam"))
    return t.where(own).sort_by("Timestamp", "EventId").project("Timestamp", "Level", "Source", "Message")


def _over(id_: str, category: str, title: str):
    def keep(f):
        OVER_TABLES[id_] = Query(category, title, f)
        return f

    return keep


_over("sources-list", "index", "Every log that was read")(lambda t: t["sources"].project("App", "Path", "Format", "Confidence", "Events").sort_by("Events", ("Path", "asc")))


@_over("low-confidence", "index", "Logs whose format was a guess")
def low_confidence(t: dict[str, Table], below: float = 0.8) -> Table:
    rows = t["sources"].where(c("Confidence") < below, c("Events") > 0)
    return rows.project("App", "Path", "Format", "Confidence", "Events").sort_by(("Confidence", "asc"), ("Path", "asc"))


_over("detections", "scanner", "Every threat found")(lambda t: t["detections"].sort_by("detected_at", "id").project("detected_at", "threat", "path", "action", "file_size"))


@_over("detections-in-context", "scanner", "Log lines around each detection")
def detections_in_context(t: dict[str, Table], around: str = "5m", n: int = 300) -> Table:
    rows = in_context(t["detections"].project("detected_at", "threat", "path"), t["logs"], "detected_at", around, (*SHOWN, "EventId"))
    return rows.top(n, ("Timestamp", "asc"), ("EventId", "asc"), ("path", "asc")).project(*SHOWN, "threat", "path")


_over("scan-history", "scanner", "Scans over time")(lambda t: t["scans"].where(c("started_at").isNotNull()).top(50, "started_at", "id").project("started_at", "kind", "status", "files_scanned", "threats_found", "duration"))


def events_as_log(t: Callable[[str], Table]) -> Table:
    """The test events with the columns of a log."""
    return t("events").project(Timestamp=c("ts"), Level=F.when(c("event_type") == "error", "error").otherwise("info"), Message=fn.strcat(c("event_type"), " value ", F.floor("value"), " of user ", c("user_id")), App=c("event_type"), Source=fn.strcat("user-", c("user_id") % 20), Format=F.lit("jsonl"), Extra=c("props"), EventId=c("event_id"))


_LOG = "(SELECT ts AS \"Timestamp\", CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS \"Level\", event_type || ' value ' || floor(value)::BIGINT || ' of user ' || user_id AS \"Message\", event_type AS \"App\", 'user-' || (user_id % 20) AS \"Source\", event_id AS \"EventId\" FROM events)"
#: Library questions over the test tables, each with its SQL.
OVER_TEST_TABLES = {
    "lib_error_rate": (lambda t: error_rate(events_as_log(t)), f"SELECT \"App\", count(*) AS \"Events\", count(*) FILTER (\"Level\" = 'error') AS \"Errors\", round_even(100.0 * count(*) FILTER (\"Level\" = 'error') / count(*), 1) AS \"Percent\" FROM {_LOG} GROUP BY 1 HAVING count(*) >= 10"),
    "lib_template_storm": (lambda t: error_storms(events_as_log(t)).project("App", "Template", "Count", "First", "Last"), f"SELECT \"App\", substr(regexp_replace(regexp_replace(\"Message\", '\\b[0-9a-fA-F]{{8,}}\\b', '#', 'g'), '\\d+', '#', 'g'), 1, 160) AS \"Template\", count(*) AS \"Count\", min(\"Timestamp\") AS \"First\", max(\"Timestamp\") AS \"Last\" FROM {_LOG} WHERE \"Level\" = 'error' GROUP BY 1, 2 HAVING count(*) >= 5"),
    "lib_busiest_hours": (lambda t: QUERIES["busiest-hours"].run(events_as_log(t)), f"SELECT hour(\"Timestamp\") AS \"Hour\", count(*) AS \"Count\" FROM {_LOG} GROUP BY 1"),
    "lib_level_share": (lambda t: QUERIES["level-share"].run(events_as_log(t)), f"SELECT \"Level\", count(*) AS \"Count\" FROM {_LOG} GROUP BY 1"),
    "lib_gaps": (lambda t: gaps(events_as_log(t)), f"SELECT \"Source\", count(*) AS \"Gaps\", max(g) AS \"Longest\" FROM (SELECT \"Source\", epoch_us(\"Timestamp\") - epoch_us(lag(\"Timestamp\") OVER (PARTITION BY \"Source\" ORDER BY \"Timestamp\", \"EventId\")) AS g FROM {_LOG}) WHERE g > 21600000000 GROUP BY 1 ORDER BY \"Longest\" DESC, \"Source\" LIMIT 100"),
    "lib_spikes": (lambda t: spikes(events_as_log(t), 2.0, 2), f"SELECT * FROM (SELECT *, lag(\"Count\") OVER (PARTITION BY \"App\" ORDER BY \"Hour\") AS \"Before\" FROM (SELECT \"App\", date_trunc('hour', \"Timestamp\") AS \"Hour\", count(*) AS \"Count\" FROM {_LOG} GROUP BY 1, 2)) WHERE \"Count\" >= 2 AND \"Count\" >= 2 * \"Before\" ORDER BY \"Count\" DESC, \"App\", \"Hour\" LIMIT 100"),
    "lib_context_join": (
        lambda t: in_context(t("events").where(c("event_type") == "error").project(error_id=c("event_id"), at=c("ts")), events_as_log(t), "at", "10m", ("Timestamp", "EventId")),
        f"SELECT e.event_id AS error_id, ts AS at, \"Timestamp\", \"EventId\" FROM events e JOIN {_LOG} ON abs(epoch_us(ts) - epoch_us(\"Timestamp\")) <= 600000000 WHERE event_type = 'error'",
    ),
    "lib_context_join_whole": (
        lambda t: in_context(t("events").where(c("event_type") == "error").project(error_id=c("event_id"), at=c("ts")), events_as_log(t), "at", "10m", ("Timestamp", "EventId")),
        f"SELECT e.event_id AS error_id, ts AS at, \"Timestamp\", \"EventId\" FROM events e JOIN {_LOG} ON \"Timestamp\" BETWEEN ts - INTERVAL 10 MINUTE AND ts + INTERVAL 10 MINUTE WHERE event_type = 'error'",
    ),
}
