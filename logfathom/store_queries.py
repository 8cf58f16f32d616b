"""Queries through the log store: the test events as log files of several formats, ingested, searched, forgotten, retained."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.aggregates import AGGREGATES as agg
from .operators import select
from .operators.shared import shared_dir
from .operators.table import Table
from .plans.saved import Scope
from .queries import query
from .sources.logstore import LogStore, journal_entries

c = F.col
#: Format and level of the log lines that each kind of event becomes.
SHAPES = {"error": ("python", "error"), "click": ("electron", "info"), "view": ("bracket-level", "warning"), "purchase": ("jsonl", "info"), "signup": ("logfmt", "debug")}
_SHAPE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, (f, _) in SHAPES.items()) + " END"
_LEVEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, (_, x) in SHAPES.items()) + " END"
_EVENTS = f"(SELECT *, {_SHAPE} AS shape, {_LEVEL} AS level, date_trunc('milliseconds', ts) AS stamp FROM events)"


def _line() -> Column:
    said = F.concat(F.lit("value "), F.floor("value").cast("string"), F.lit(" of user "), c("user_id").cast("string"))
    time = lambda p: F.date_format("ts", p)
    shapes = {
        "python": F.concat(time("yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [main] ERROR shop.cart: "), said),
        "electron": F.concat(time("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" [info] "), said),
        "bracket-level": F.concat(F.lit("["), time("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] [warn] "), said),
        "jsonl": F.to_json(F.struct(time("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), F.lit("info").alias("level"), said.alias("msg"), c("user_id").alias("user"))),
        "logfmt": F.concat(F.lit("time="), time("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(' level=debug msg="'), said, F.lit('"')),
    }
    out = F.lit(None).cast("string")
    for kind, (shape, _) in SHAPES.items():
        out = F.when(c("event_type") == kind, shapes[shape]).otherwise(out)
    return out


def write_logs(events: Table, folder: str) -> None:
    """Log files of the events below a folder, one folder a kind."""
    events.raw.select("event_type", _line().alias("value")).write.mode("append").partitionBy("event_type").text(folder)


def stored(t, *parts: Column) -> tuple[LogStore, str]:
    """A store that ingested the events, after each part of them was written."""
    spark, top = t("events").raw.sparkSession, shared_dir(t("events").raw.sparkSession)
    store = LogStore(spark, f"{top}/store")
    for part in parts or (F.lit(True),):
        write_logs(t("events").where(part), f"{top}/logs")
        store.ingest(f"{top}/logs")
    return store, top


@query(f"SELECT shape AS \"Format\", level AS \"Level\", count(*) AS n, min(stamp) AS first, max(stamp) AS last, count(DISTINCT floor(value)) AS kinds FROM {_EVENTS} GROUP BY 1, 2")
def store_formats(t):
    """Two runs: the second reads only the files that came since."""
    store, _ = stored(t, c("event_id") % 3 == 0, c("event_id") % 3 != 0)
    kinds = F.regexp_extract("Message", r"value (-?\d+) of", 1)
    return Table(store.events()).summarize(by=("Format", "Level"), n=agg["count"](), first=agg["min"](c("Timestamp")), last=agg["max"](c("Timestamp")), kinds=agg["dcount"](kinds))


@query(f"SELECT shape AS \"Format\", count(*) AS n FROM {_EVENTS} WHERE user_id = 7 AND event_type <> 'signup' GROUP BY 1")
def store_search(t):
    """A word through the term index, without the sources of one kind, which were forgotten."""
    store, _ = stored(t)
    gone = [r["Path"] for r in store.sources().where(c("Format") == "logfmt").select("Path").collect()]
    store.forget(*gone)
    return Table(store.search("user 7")).summarize(by="Format", n=agg["count"]())


@query("SELECT event_type || '.service' AS \"App\", count(*) AS \"Events\", min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def store_journal(t):
    """Journal entries in two batches, the second delivered twice: a source a unit."""
    spark = t("events").raw.sparkSession
    store = LogStore(spark, f"{shared_dir(spark)}/store")
    entry = F.to_json(F.struct(c("event_id").cast("string").alias("__CURSOR"), F.unix_micros("ts").cast("string").alias("__REALTIME_TIMESTAMP"), F.lit("6").alias("PRIORITY"), F.concat("event_type", F.lit(".service")).alias("_SYSTEMD_UNIT"), F.col("props").alias("MESSAGE")))
    for batch, part in ((0, c("event_id") % 2 == 0), (1, c("event_id") % 2 == 1), (1, c("event_id") % 2 == 1)):
        store.ingest_journal(journal_entries(t("events").where(part).raw.select(entry.alias("line"))), batch)
    return Table(store.sources()).project("App", "Events", first=c("FirstEvent"), last=c("LastEvent"))


@query(f"SELECT CAST(CAST(stamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM {_EVENTS} WHERE stamp >= TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1")
def store_retained(t):
    """Without the events before a moment: days are dropped whole, the first one is cut."""
    store, _ = stored(t)
    store.retain_age(dt.datetime(2024, 1, 15, 12, tzinfo=dt.timezone.utc), days=5)
    return Table(store.events()).summarize(by={"day": F.to_date("Timestamp").cast("string")}, n=agg["count"]())


@query(" UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS p, quantile_disc(l_extendedprice, {p / 100}) AS value FROM lineitem GROUP BY 1" for p in (1, 50, 99.9)))
def agg_percentile_selected(t):
    return Table(select.percentiles(t("lineitem").raw, ["l_returnflag"], c("l_extendedprice"), (1, 50, 99.9)))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3], ',') AS keys FROM orders GROUP BY 1")
def agg_first_values(t):
    return Table(select.first_values(t("orders").raw, ["o_custkey"], c("o_orderkey"), [(c("o_totalprice"), "desc"), c("o_orderkey")], 3)).project("o_custkey", keys=F.array_join(F.transform("values", lambda x: x.cast("string")), ","))


@query("""
WITH e AS (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12')
SELECT user_id, count(*) AS n FROM (SELECT a.user_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' UNION ALL SELECT user_id FROM e WHERE event_type = 'click') GROUP BY 1""")
def range_in_all_arms(t):
    """The range of the question holds in both sides of its join and in its union."""
    stamp = lambda s: dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc)
    s = Scope(t, stamp("2024-01-05"), stamp("2024-01-12"))
    kind = lambda k: s("events").where(c("event_type") == k).project("user_id")
    return kind("error").join(kind("purchase"), "user_id", "inner").project("user_id").union(kind("click")).summarize(by="user_id", n=agg["count"]())
