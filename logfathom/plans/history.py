"""Scan history, file baselines and scores: relational questions beside the logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def recent(scans: DataFrame, n: int = 100, kind: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """The latest scans, filtered by any of kind, status and a text in summary, targets or profile."""
    for name, want in (("kind", kind), ("status", status)):
        scans = scans if want is None else scans.where(c(name) == want)
    if text:
        test = F.lit(False)
        for name in ("summary", "targets", "profile"):
            test |= F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(text.lower()))
        scans = scans.where(test)
    return scans.orderBy(c("started_at").desc(), c("id").desc()).limit(n)


def totals(scans: DataFrame, detections: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """One row: scans, files, threats, and those of the last ``days``."""
    late = c("started_at") >= F.lit(now - dt.timedelta(days=days))
    zero = lambda x: F.coalesce(x, F.lit(0))
    one = scans.agg(F.count(F.lit(1)).alias("scans"), zero(F.sum("files_scanned")).alias("files"), zero(F.sum("threats_found")).alias("threats"), F.count_if(late).alias("scans_late"))
    return one.crossJoin(detections.agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("path").alias("paths")))  # one row by one row


def daily(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("scans"), F.coalesce(F.sum("threats_found"), F.lit(0)).alias("threats"))


def purge(scans: DataFrame, detections: DataFrame, now: dt.datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """Without scans older than ``days`` and without their detections."""
    kept = scans.where(c("started_at") >= F.lit(now - dt.timedelta(days=days)))
    return kept, detections.join(kept.select(c("id").alias("scan_id")), "scan_id", "left_semi")


def detections_of(detections: DataFrame, scan_id: int) -> DataFrame:
    """The detections of one scan, in the order they were made."""
    return detections.where(c("scan_id") == scan_id).orderBy("id")


def recent_detections(detections: DataFrame, n: int = 100) -> DataFrame:
    return detections.orderBy(c("detected_at").desc(), c("id").desc()).limit(n)


def search_detections(detections: DataFrame, text: str, n: int = 500) -> DataFrame:
    """The latest detections with a text, in either case, in path or threat."""
    has = lambda name: F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(text.lower()))
    return recent_detections(detections.where(has("path") | has("threat")), n)


def times_found(detections: DataFrame) -> DataFrame:
    """How often each path was found before."""
    return detections.groupBy("path").agg(F.count(F.lit(1)).alias("times"))


def unit_counts(units: DataFrame) -> DataFrame:
    """One row over service units (active_state, running, starts_itself, masked, packaged): how many are in each state; a null is no."""
    states = {"running": c("running"), "failed": c("active_state") == "failed", "enabled": c("starts_itself"), "masked": c("masked"), "unpackaged": ~c("packaged")}
    return units.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(test).alias(name) for name, test in states.items()))


def drift(before: DataFrame, after: DataFrame, watched: dict[str, str]) -> DataFrame:
    """(path, change) between two snapshots of files. ``watched``: the change that a difference in a column means."""
    a = before.select(c("path").alias("_a"), *(c(k).alias(f"_a_{k}") for k in watched))
    b = after.select(c("path").alias("_b"), *(c(k).alias(f"_b_{k}") for k in watched))
    both = a.join(b, c("_a") == c("_b"), "full")
    differs = [F.when(~c(f"_a_{k}").eqNullSafe(c(f"_b_{k}")), F.lit(change)) for k, change in watched.items()]
    changes = F.when(c("_a").isNull(), F.array(F.lit("added"))).when(c("_b").isNull(), F.array(F.lit("removed"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(F.coalesce("_a", "_b").alias("path"), F.explode(changes).alias("change"))


# What a finding of each severity costs.
WEIGHTS = {"critical": 40, "high": 20, "medium": 8, "low": 3, "info": 0}


def score(severity: str = "severity", weights: dict[str, int] = WEIGHTS) -> Column:
    """Aggregate: 100 less the weights of all findings, 0 at least."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.coalesce(severity, F.lit(""))), F.lit(0))
    return F.greatest(F.lit(0), 100 - F.coalesce(F.sum(weight), F.lit(0)))


def line_kind(line: Column) -> Column:
    """detection, error, warning or info."""
    low = F.lower(line)
    return F.when(low.rlike(r"\bfound\s*$"), "detection").when(low.rlike(r"\b(error|failed|fatal)"), "error").when(low.rlike(r"\bwarn"), "warning").otherwise("info")
