"""Keeping a log table: retention, removal of sources, statistics, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as v

c = F.col


def retain_age(log: DataFrame, now: dt.datetime, days: int = 120) -> DataFrame:
    """Without events older than ``days``; events without a time stay."""
    return log.where(c("Timestamp").isNull() | (c("Timestamp") >= F.lit(now - dt.timedelta(days=days))))


def retain_count(log: DataFrame, most: int = 5_000_000, by: str = "EventId") -> DataFrame:
    """The ``most`` newest events by ``by``, found by narrowing its range with counts; rows tied at the cut all stay."""
    n = log.count()
    if n <= most:
        return log
    low, high = log.agg(F.min(by), F.max(by)).first()
    keep, shards = most, 4096
    while low < high:  # the boundary's shard is split until it is one value
        step = max(1, -(-(high - low + 1) // shards))
        sums = log.where(c(by).between(low, high)).groupBy(F.floor((c(by) - low) / step).cast("long").alias("s")).count().orderBy(F.desc("s")).collect()  # at most ``shards`` rows
        for r in sums:
            if r["count"] >= keep:
                low, high = low + r["s"] * step, min(high, low + (r["s"] + 1) * step - 1)
                break
            keep -= r["count"]
        else:
            break
    return log.where(c(by) >= low)


def retain_share(log: DataFrame, bytes_now: int, most_bytes: int) -> DataFrame:
    """Without the oldest tenths of the events until the rest fits into ``most_bytes`` in proportion."""
    if bytes_now <= most_bytes or not bytes_now:
        return log
    n = log.count()
    share = -(-10 * (bytes_now - most_bytes) // bytes_now) / 10
    return retain_count(log, int(n * (1 - share)))


def forget(log: DataFrame, *sources: str) -> DataFrame:
    return log.where(~c("Source").isin(*sources))


def statistics(log: DataFrame) -> DataFrame:
    """One row: events, untimed ones, logs, applications, first and last time."""
    return log.agg(F.count(F.lit(1)).alias("Events"), F.count_if(c("Timestamp").isNull()).alias("Untimed"), F.count_distinct("Source").alias("Sources"), F.count_distinct("App").alias("Apps"), F.min("Timestamp").alias("First"), F.max("Timestamp").alias("Last"))


def append_partitioned(log: DataFrame, path: str) -> None:
    """Append to a Parquet table partitioned by day, so that time ranges prune folders and statistics."""
    log.withColumn("Day", F.to_date("Timestamp")).repartition("Day", F.pmod(F.hash("EventId"), F.lit(16))).write.mode("append").partitionBy("Day").parquet(path)


def safe_cells(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run as a formula gets a tab in front; nested values become JSON."""
    out = []
    for name, kind in df.dtypes:
        x = v.text(c(name)) if kind.startswith(("array", "map", "struct", "variant", "interval")) else c(name)
        out.append((F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("\t"), x)).otherwise(x) if kind == "string" else x).alias(name))
    return df.select(*out)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write CSV (formulas defused), TSV (line breaks shown) or JSON lines, in parallel."""
    if kind == "csv":
        safe_cells(df).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif kind == "tsv":
        flat = df.select(*(F.regexp_replace(F.replace(v.text(c(n)), F.lit("\t"), F.lit(" ")), r"\r?\n", " ⏎ ").alias(n) for n in df.columns))
        flat.write.options(header=True, sep="\t", quote="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif kind == "json":
        df.write.json(path)
    else:
        raise ValueError(f"no export format {kind!r}")


def markdown(df: DataFrame, most: int = 2000) -> str:
    """A table of at most ``most`` rows for a report."""
    rows = df.select(*(v.text(c(n)).alias(n) for n in df.columns)).limit(most).collect()
    cell = lambda s: s.replace("|", "\\|").replace("\n", " ⏎ ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
