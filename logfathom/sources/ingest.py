"""From log files to one event table: read, recognise the format of each file, join continuation lines.

Files are read in Spark's own splits. Order inside a file comes from the split's start and
the place in it; no file is gathered in one task: windows run within a split, and what
reaches across splits (line and event numbers) is carried by one summary row a split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import levels
from .formats import FORMATS, HEADER, MAX_LINE, Context, cells

SAMPLE, LEAST_SHARE = 80, 0.55
MAX_CONTINUATION = 200
c = F.col


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """(path, split, pos, line, year, month) of every line of text and gzip files below ``path``."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    rows = rows.select(c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("split"), c("_metadata.file_modification_time").alias("_t"), c("value"))
    return rows.select("path", "split", F.monotonically_increasing_id().alias("pos"), cut_line(c("value")).alias("line"), F.year("_t").alias("year"), F.month("_t").alias("month"))


def cut_line(value: F.Column) -> F.Column:
    """A line without its carriage return, and with a note where it is too long to keep."""
    line = F.regexp_replace(value, r"\r$", "")
    return F.when(F.length(line) > MAX_LINE, F.concat(F.substring(line, 1, MAX_LINE), F.lit(" …[truncated]"))).otherwise(line)


def _before(rows: DataFrame, count: F.Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``count`` over the earlier splits of the file."""
    sums = rows.groupBy("path", "split").agg(F.sum(count).alias("_n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(c("path").alias("_p"), c("split").alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(name))
    return rows.join(sums, (c("path") == c("_p")) & (c("split") == c("_s"))).drop("_p", "_s")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``number``, the place of each line in its file from 1; blank lines count and go."""
    rows = _before(lines, F.lit(1), "_lines")
    within = F.row_number().over(Window.partitionBy("path", "split").orderBy("pos"))
    return rows.withColumn("number", within + c("_lines")).drop("_lines").where(F.trim("line") != "")


def detect(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per file: format, confidence and CSV header, from the first lines that are not blank.

    ``known`` (path, header) has the CSV headers of files of which an earlier part was read.

    The format that fits the largest share wins, if that is ``LEAST_SHARE`` or more, the
    higher priority if shares are equal. Indented lines do not count against formats that
    join continuation lines.
    """
    first = lines.where(c("number") <= 4 * SAMPLE).withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("number"))).where(c("_k") <= SAMPLE)
    is_header = F.when((c("_k") == 1) & c("line").rlike(HEADER), cells(c("line")))
    heads = first.groupBy(c("path").alias("_p")).agg(F.max(is_header).alias("header"), F.count(F.lit(1)).alias("lines"), F.count_if((c("_k") > 1) & (c("_k") <= 6)).alias("rows"), F.collect_list(F.when((c("_k") > 1) & (c("_k") <= 6), F.size(cells(c("line"))))).alias("sizes"))
    fitting = F.size(F.filter("sizes", lambda n: n == F.size("header")))
    heads = heads.select("_p", F.when((F.col("rows") >= 2) & (fitting >= F.least(F.lit(3), c("rows"))), c("header")).alias("header")).withColumn("_sniffed", c("header").isNotNull())
    if known is not None:
        heads = heads.join(known.select(c("path").alias("_q"), c("header").alias("_known")), c("_p") == c("_q"), "left").withColumn("header", F.coalesce("header", "_known")).drop("_q", "_known")
    rows = first.join(heads, c("path") == c("_p")).drop("_p")
    context = Context(c("year"), c("month"), c("header"))
    inside = ~c("line").rlike(r"^\s")
    scores = []
    for f in FORMATS.values():
        fits = F.coalesce(f.fits(c("line"), context), F.lit(False))
        counted = (inside | fits) if f.joins else F.lit(True)
        if f.name == "csv":
            counted = (c("_k") > 1) | ~c("_sniffed")
        if f.name != "plain":
            scores.append(F.struct((F.count_if(fits & counted) / F.greatest(F.count_if(counted), F.lit(1))).alias("share"), F.lit(f.priority).alias("priority"), F.lit(f.name).alias("name")))
    best = F.array_max(F.filter(F.array(*scores), lambda s: s["share"] >= LEAST_SHARE))
    found = rows.groupBy("path").agg(best.alias("b"), F.first("header").alias("header"))
    return found.select("path", F.coalesce("b.name", F.lit("plain")).alias("format"), F.coalesce("b.share", F.lit(0.0)).alias("confidence"), "header")


def parse_lines(lines: DataFrame, formats: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Events of numbered lines, with the format of each file: a row an event.

    ``only`` names the formats that occur, where that is known: the plan has no others then.

    In formats that join lines, a line that does not fit continues the event before it, up to
    ``MAX_CONTINUATION`` lines and a note that there were more; without an event before it,
    and in other formats, it is a plain event of its own.
    """
    rows = lines.join(formats.select(c("path").alias("_p"), "format", "header"), c("path") == c("_p")).drop("_p")
    context = Context(c("year"), c("month"), c("header"))
    fits, event, joins = F.lit(False), None, F.lit(False)
    for f in FORMATS.values():
        if only is not None and f.name not in only and f.name != "plain":
            continue
        mine = c("format") == f.name
        fits = F.when(mine, F.coalesce(f.fits(c("line"), context), F.lit(False))).otherwise(fits)
        joins = joins | (mine & f.joins)
        event = F.when(mine, f.event(c("_raw"), context)) if event is None else event.when(mine, f.event(c("_raw"), context))
    rows = rows.where(~((c("format") == "csv") & F.coalesce(cells(c("line")) == c("header"), F.lit(False))))
    rows = rows.withColumns({"_fits": fits, "_joins": joins}).withColumn("_start", c("_fits") | ~c("_joins"))
    plain = FORMATS["plain"].event(c("_raw"), context)
    rows = _before(rows, c("_start").cast("long"), "_events")
    w = Window.partitionBy("path", "split").orderBy("pos")
    rows = rows.withColumns({"_n": F.sum(c("_start").cast("long")).over(w) + c("_events"), "_at": F.row_number().over(w)})
    rows = rows.withColumn("_since", c("_at") - F.coalesce(F.max(F.when(c("_start"), c("_at"))).over(w), F.lit(0)))
    alone = c("_n") == 0  # nothing before it that it could continue
    rows = rows.where(alone | c("_start") | (c("_since") <= MAX_CONTINUATION + 1))
    head = c("_start") | alone
    key = F.when(alone, -c("number")).otherwise(c("_n"))
    grouped = rows.groupBy("path", "format", "year", "month", "header", key.alias("_key")).agg(
        F.min("number").alias("line_number"), F.max(F.when(head, c("_fits"))).alias("_fits"), F.max(F.when(head, c("line"))).alias("_raw"), F.array_sort(F.collect_list(F.when(~head, F.struct("number", "line")))).alias("_more")
    )
    # a group has one head; it is parsed here, where events are dealt evenly, whatever the sizes of files
    grouped = grouped.withColumn("e", F.when(c("_fits"), event).otherwise(plain))
    lines_of = F.transform(F.slice("_more", 1, MAX_CONTINUATION), lambda s: s["line"])
    more = F.when(F.size("_more") > MAX_CONTINUATION, F.concat(lines_of, F.array(F.lit(f"…[{MAX_CONTINUATION}+ more lines]")))).otherwise(lines_of)
    tail = F.when(F.size("_more") > 0, F.concat(F.lit("\n"), F.array_join(more, "\n"))).otherwise("")
    raw = F.concat("_raw", tail)
    out = grouped.select("path", "format", "line_number", c("e.ts").alias("ts"), c("e.level").alias("level"), F.concat("e.message", tail).alias("message"), c("e.extra").alias("extra"), raw.alias("raw"))
    return out.withColumn("raw", F.when(c("raw") != c("message"), c("raw")))


# Folder names that say nothing about the application.
COMMON = ("log", "logs", "var", "cache", "config", "local", "share", "home", "root", "usr", "tmp", "opt", "lib", "state", "data", "crash", "reports", "session", "sessions")


def app_name(path: F.Column) -> F.Column:
    """The application that a log's path names: the folder nearest to the file that is not a common one, else the file."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^file:/*", "/"), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.filter(folders, lambda p: ~F.lower(F.regexp_replace(p, r"^\.", "")).isin(*COMMON) & ~p.rlike(r"^[\d._-]+$|^[0-9a-f-]{16,}$"))
    stem = F.regexp_extract(F.element_at(parts, -1), r"^([^.]+)", 1)
    return F.lower(F.regexp_replace(F.coalesce(F.try_element_at(named, F.lit(-1)), stem), r"^\.", ""))


def logs(spark: SparkSession, path: str | list[str], pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(log table, source table) of all files below ``path``; see ``plans.library`` for the columns."""
    lines = numbered_lines(read_lines(spark, path, pattern))
    found = detect(lines)
    events = parse_lines(lines, found)
    table = log_columns(events)
    return table, source_table(table, found)


def log_columns(events: DataFrame) -> DataFrame:
    """Parsed events as rows of the log table."""
    return events.select(
        c("ts").alias("Timestamp"), c("level").alias("Level"), c("message").alias("Message"), app_name(c("path")).alias("App"), c("path").alias("Source"), F.substring_index("path", "/", -1).alias("SourceName"), c("format").alias("Format"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("Location"), c("line_number").alias("LineNumber"), F.coalesce("raw", "message").alias("Raw"), c("extra").alias("Extra"), F.xxhash64("path", "line_number").alias("EventId"), levels.rank(c("level")).alias("LevelRank"),
    )


def source_table(table: DataFrame, found: DataFrame) -> DataFrame:
    sums = table.groupBy("Source").agg(F.count(F.lit(1)).alias("Events"), F.min("Timestamp").alias("FirstEvent"), F.max("Timestamp").alias("LastEvent"), F.count_if(c("Timestamp").isNull()).alias("Untimed"))
    rows = found.join(sums, c("path") == c("Source"), "left")
    return rows.select(c("path").alias("Path"), app_name(c("path")).alias("App"), c("format").alias("Format"), c("confidence").alias("Confidence"), F.coalesce("Events", F.lit(0)).alias("Events"), "FirstEvent", "LastEvent", F.coalesce("Untimed", F.lit(0)).alias("Untimed"), c("path").rlike(r"\.gz$").alias("Compressed"))
