"""A log table that is kept: ingestion that goes on where it stopped, sources, a term index, retention.

Below its folder a store has ``events`` (Parquet by run, day and bucket of the source),
``terms`` (which event files hold a term) and ``manifest`` (what is known of each source). A
commit writes the manifest rows that changed as a new version; the newest row of a path
counts, and every ``SNAPSHOT`` versions all rows are written. Events become visible with the version of
their run, so that a run that failed leaves nothing behind, and is written anew. One writer at a time.

Events are never updated in place. A rewritten or forgotten source tells from which run on its
events count; older ones are hidden at the scan and go when their partitions are next
rewritten, which leaves the files of all other partitions untouched.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators.shared import exists, names, removed, staged
from . import files
from .ingest import app_name, cut_line, detect, log_columns, numbered_lines, parse_lines

c = F.col
BUCKETS, SNAPSHOT = 16, 20
#: Sources that are hidden are broadcast up to so many, joined by shuffle beyond.
HIDDEN = 100_000
#: Event files that a search names one by one; beyond, it scans the table.
NAMED_FILES = 5_000
#: Most rows of an event file, so that a search can skip much of a day.
FILE_ROWS = 500_000
INDEXED = -(2**63)
EVENTS = "Timestamp timestamp, Level string, Message string, App string, Source string, SourceName string, Format string, Location string, LineNumber long, Raw string, Extra string, EventId long, LevelRank int"
PLACED = f"{EVENTS}, Run int, Day date, Bucket int"
MANIFEST = (
    "Path string, Kind string, App string, Identity string, Size long, Modified long, Mark string, Lines long, Format string, Confidence double, Header array<string>, Compressed boolean, "
    "Events long, Untimed long, FirstEvent timestamp, LastEvent timestamp, Enabled boolean, Since int, Batch long, Action string, Error string, ReadBytes long, Gone boolean"
)
PLANNED = "path string, size long, modified long, identity string, compressed boolean, action string, start long, stop long, mark string, error string"
LINES = "path string, split long, pos long, value string, error string"
WORDS = r"[0-9A-Za-z]+"


def _reason(error: Exception) -> str:
    return str(getattr(error, "strerror", None) or error or type(error).__name__)[:500]


def _decided(path: str, size: int, modified: int, identity: str | None, known: str | None, known_identity: str | None, known_size: int | None) -> tuple:
    """What is to be read of one file, from its mark and what was known of it."""
    compressed = path.endswith(".gz")
    row = (path, size, modified, identity, compressed)
    try:
        store, base, _ = files.opened(path)
        with store.open_input_file(base) as s:
            size = s.size()
            if compressed:  # no offset into it is of use: all or nothing
                mark = files.mark(s, min(size, files.HEAD))
                same = mark == known and size == known_size
                return *row, "unchanged" if same else "new" if known is None else "rotated", 0, 0 if same else size, mark, None
            old = files.offset(known)
            moved = known_identity is not None and identity is not None and known_identity != identity
            start = 0 if moved else files.resumes(s, size, known)
            stop = files.line_end(s, size, start)
            action = "new" if known is None else "rotated" if start < old else "appended" if stop > start else "unchanged"
            return *row, action, start, stop, files.mark(s, stop), None
    except (OSError, ValueError) as error:
        return *row, "failed", 0, 0, known, _reason(error)


def _planner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = [_decided(*r) for r in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in PLANNED.split(", ")])


def _unzipped(s) -> Iterator[tuple[int, bytes]]:
    at = 0
    with gzip.open(io.BufferedReader(s)) as text:
        for line in text:
            yield at, line.rstrip(b"\n")
            at += len(line)


def _lines(batches: Iterator[pa.RecordBatch], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    kinds, heads = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), [x.split()[0] for x in LINES.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], heads)

    for batch in batches:
        for path, compressed, start, end, stop in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            rows: list[tuple] = []
            try:
                store, base, _ = files.opened(path)
                with store.open_input_file(base) as s:
                    for at, line in _unzipped(s) if compressed else files.lines_of(s, start, end, stop):
                        rows.append((path, start, at, line.decode("utf-8", "replace"), None))
                        if len(rows) == size:
                            yield batch_of(rows)
                            rows = []
            except (OSError, EOFError, zlib.error) as error:  # its other lines are left out below
                rows.append((path, start, -1, None, _reason(error)))
            yield batch_of(rows)


def _with_file(events: DataFrame) -> DataFrame:
    """Rows of event files with the ``file`` that they lie in, below ``events``."""
    return events.withColumn("file", F.regexp_extract(c("_metadata.file_path"), r"/events/(Run=.*)$", 1))


def _sums(events: DataFrame) -> DataFrame:
    return events.groupBy(c("Source").alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(c("Timestamp").isNull()).alias("_untimed"), F.min("Timestamp").alias("_first"), F.max("Timestamp").alias("_last"))


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- manifest ----

    def _versions(self) -> list[tuple[int, str]]:
        """Committed versions in order, by number and folder; a snapshot comes after its version."""
        found = sorted((int(n.split("-")[0][2:]), n) for n in names(self.spark, f"{self.root}/manifest") if n.startswith("v="))
        return [(k, n) for k, n in found if exists(self.spark, f"{self.root}/manifest/{n}/_SUCCESS")]

    def version(self) -> int:
        return max((k for k, _ in self._versions()), default=0)

    def _state(self) -> DataFrame:
        """The newest row of each path, forgotten ones included."""
        known = self._versions()
        first = max((i for i, (_, n) in enumerate(known) if n.endswith("-all")), default=0)
        rows = None
        for k, n in known[first:]:
            part = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{n}").withColumn("_v", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], MANIFEST)
        return rows.groupBy("Path").agg(F.max_by(F.struct(*rows.columns), "_v").alias("r")).select("r.*").drop("_v")

    def _next(self) -> int:
        """The number of the next version, without what a failed attempt at it left."""
        n = self.version() + 1
        for part in (f"events/Run={n}", f"terms/Run={n}", f"manifest/v={n:08}"):
            removed(self.spark, f"{self.root}/{part}")
        return n

    def _commit(self, n: int, changed: DataFrame) -> None:
        names_ = [x.split()[0] for x in MANIFEST.split(", ")]
        changed.select(*names_).write.mode("overwrite").parquet(f"{self.root}/manifest/v={n:08}")
        if n % SNAPSHOT == 0:
            self._state().select(*names_).write.mode("overwrite").parquet(f"{self.root}/manifest/v={n:08}-all")

    def sources(self) -> DataFrame:
        """What is known of every source that is there."""
        return self._state().where(~c("Gone")).drop("Gone", "Batch")

    # ---- events ----

    def _raw(self) -> DataFrame:
        """All events of committed runs, hidden ones too, with Run, Day and Bucket."""
        if not exists(self.spark, f"{self.root}/events"):
            return self.spark.createDataFrame([], PLACED)
        return self.spark.read.schema(PLACED).option("basePath", f"{self.root}/events").parquet(f"{self.root}/events").where(c("Run") <= self.version())

    def _hidden(self) -> DataFrame:
        """(_path, _since): events of a path count from that run on."""
        state = self._state()
        never = ~c("Enabled") | c("Gone")
        return state.where(never | (c("Since") > 0)).select(c("Path").alias("_path"), F.when(never, 2**31 - 1).otherwise(c("Since")).alias("_since"))

    def _visible(self, events: DataFrame) -> DataFrame:
        hidden = staged(self._hidden())
        n = hidden.limit(HIDDEN + 1).count()
        if not n:
            return events
        return events.join(F.broadcast(hidden) if n <= HIDDEN else hidden, (c("Source") == c("_path")) & (c("Run") < c("_since")), "left_anti")

    def events(self) -> DataFrame:
        """The log table: all events but those of disabled, forgotten and rewritten sources; filters on ``Day`` prune folders."""
        return self._visible(self._raw())

    def _write(self, n: int, log: DataFrame) -> DataFrame:
        """Write a run's events and their terms; the rows as written."""
        path = f"{self.root}/events/Run={n}"
        placed = log.withColumns({"Day": F.to_date("Timestamp"), "Bucket": F.pmod(F.hash("Source"), F.lit(BUCKETS))})
        names_ = [x.split()[0] for x in EVENTS.split(", ")]
        # rebalanced, not repartitioned: a day or source with most rows becomes several files
        placed.select(*names_, "Day", "Bucket").hint("rebalance", c("Day"), c("Bucket")).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("Day", "Bucket").parquet(path)
        written = self.spark.read.schema(PLACED).option("basePath", f"{self.root}/events").parquet(path)
        self._index(n, _with_file(written))
        return written

    # ---- ingestion ----

    def ingest(self, path: str, pattern: str = "*") -> DataFrame:
        """Read what is new in the files below ``path``; per file: Path, Action, Events (added), ReadBytes, Format, Error.

        Actions: ``new``, ``appended`` (from the last line end that was read), ``rotated`` (rewritten: its
        earlier events go), ``unchanged``, ``disabled``, ``failed`` (nothing of it is taken; tried again
        next time). Unless their size, time or identity changed, files are not opened. A last
        line without its end waits; compressed files are read whole or not at all.
        """
        n = self._next()
        state = staged(self._state())
        there = files.listing(self.spark, path, pattern)
        was = state.select(*(c(x).alias(f"was_{x}") for x in state.columns))
        same = (c("size") == c("was_Size")) & (c("modified") == c("was_Modified")) & c("identity").eqNullSafe(c("was_Identity")) & c("was_Error").isNull() & ~c("was_Gone")
        todo = F.when(~c("was_Enabled"), "disabled").when(same, "unchanged").otherwise("open")
        known = staged(there.join(was, c("path") == c("was_Path"), "left").withColumn("todo", todo))
        mark = F.when(~c("was_Gone"), c("was_Mark"))
        open_ = known.where("todo = 'open'").select("path", "size", "modified", "identity", mark.alias("mark"), "was_Identity", "was_Size")
        rest = known.where("todo <> 'open'").select(c("path").alias("Path"), c("todo").alias("Action"), *(F.lit(x).cast(t).alias(k) for k, t, x in (("Events", "long", 0), ("ReadBytes", "long", 0), ("Format", "string", None), ("Error", "string", None))))
        if not exists(self.spark, path):
            return rest.unionByName(self.spark.createDataFrame([(path, "failed", 0, 0, None, "no such file or folder")], rest.schema))
        many = open_.count()
        if not many:
            return rest
        plan = staged(open_.repartition(min(many, files.TASKS), "path").mapInArrow(_planner, PLANNED))
        if plan.where("stop > start").isEmpty():  # nothing to read, but sizes, times or errors to note
            changed = staged(self._changed(n, was, plan, None, None, None))
        else:
            lines = staged(self._read(plan))
            broken = lines.where("error is not null").groupBy(c("path").alias("_b")).agg(F.max("error").alias("_error"))
            failed = c("_error").isNotNull()
            plan = staged(plan.join(broken, c("path") == c("_b"), "left").withColumns({"action": F.when(failed, "failed").otherwise(c("action")), "error": F.coalesce("error", "_error")}).drop("_b", "_error"))
            times = plan.where("error is null").select("path", F.timestamp_micros(F.expr("modified div 1000")).alias("_t"))
            good = lines.join(times, "path").select("path", "split", "pos", cut_line(c("value")).alias("line"), F.year("_t").alias("year"), F.month("_t").alias("month"))
            counted = good.groupBy("path").agg(F.count(F.lit(1)).alias("_lines"))
            numbered = staged(numbered_lines(good))
            going_on = plan.where("action = 'appended'").join(was, c("path") == c("was_Path")).select("path", c("was_Lines").alias("_before"), c("was_Header").alias("header"))
            found = staged(detect(numbered, going_on.select("path", "header")))
            shifted = numbered.join(going_on.select(c("path").alias("_p"), "_before"), c("path") == c("_p"), "left").withColumn("number", c("number") + F.coalesce("_before", F.lit(0))).drop("_p", "_before")
            only = {r["format"] for r in found.select("format").distinct().collect()}  # a row a format
            written = self._write(n, log_columns(parse_lines(shifted, found, only)))
            changed = staged(self._changed(n, was, plan, found, counted, written))
        self._commit(n, changed)
        return rest.unionByName(changed.select("Path", "Action", c("_added").alias("Events"), "ReadBytes", "Format", "Error"))

    def _read(self, plan: DataFrame) -> DataFrame:
        """The lines of all byte ranges of a plan, each range in a task of its own."""
        todo = plan.where("error is null and stop > start")
        starts = F.when(c("compressed"), F.array("start")).otherwise(F.sequence(c("start"), c("stop") - 1, F.lit(files.RANGE).cast("long")))
        ranges = todo.select("path", "compressed", F.explode(starts).alias("start"), "stop")
        ranges = ranges.select("path", "compressed", "start", F.least(c("start") + files.RANGE, c("stop")).alias("end"), "stop")
        return ranges.repartition(max(1, min(ranges.count(), 100 * files.TASKS)), "path", "start").mapInArrow(_lines, LINES)

    def _changed(self, n: int, was: DataFrame, plan: DataFrame, found: DataFrame | None, counted: DataFrame | None, written: DataFrame | None) -> DataFrame:
        """The manifest rows of the files that were opened, with ``_added``."""
        rows = plan.join(was, c("path") == c("was_Path"), "left")
        if written is None:
            none = {"_format": "string", "_confidence": "double", "_header": "array<string>", "_lines": "long", "_n": "long", "_untimed": "long", "_first": "timestamp", "_last": "timestamp"}
            rows = rows.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
        else:
            told = found.select(c("path").alias("_f"), c("format").alias("_format"), c("confidence").alias("_confidence"), c("header").alias("_header"))
            for other, key in ((told, "_f"), (counted.withColumnRenamed("path", "_c"), "_c"), (_sums(written), "_s")):
                rows = rows.join(other, c("path") == c(key), "left").drop(key)
        ok, onward = c("error").isNull(), c("action").isin("appended", "unchanged")
        zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
        kept = lambda x: F.when(onward, c(f"was_{x}"))  # noqa: E731  what is known of it, if that still counts
        since = F.when(onward | ~ok, c("was_Since")).when(c("action") == "rotated", n)
        added = zero(c("_n"))
        fresh = {
            "Size": c("size"), "Modified": c("modified"), "Identity": c("identity"), "Mark": c("mark"), "Lines": zero(kept("Lines")) + zero(c("_lines")), "Format": F.coalesce("_format", kept("Format"), F.lit("plain")), "Confidence": F.coalesce("_confidence", kept("Confidence"), F.lit(0.0)),
            "Header": F.coalesce("_header", kept("Header")), "Compressed": c("compressed"), "Events": zero(kept("Events")) + added, "Untimed": zero(kept("Untimed")) + zero(c("_untimed")), "FirstEvent": F.least(kept("FirstEvent"), c("_first")), "LastEvent": F.greatest(kept("LastEvent"), c("_last")),
        }
        missing = {"Lines": 0, "Events": 0, "Untimed": 0, "Format": "plain", "Confidence": 0.0, "Compressed": False}
        columns = {k: F.when(ok, x).otherwise(F.coalesce(f"was_{k}", F.lit(missing.get(k)))) for k, x in fresh.items()}
        gone = F.coalesce("was_Gone", F.lit(False))
        return rows.select(
            c("path").alias("Path"), F.lit("file").alias("Kind"), app_name(c("path")).alias("App"), *(x.alias(k) for k, x in columns.items()), F.coalesce("was_Enabled", F.lit(True)).alias("Enabled"),
            F.coalesce(F.when(gone & ok, n).otherwise(since), F.lit(0)).cast("int").alias("Since"), c("was_Batch").alias("Batch"), c("action").alias("Action"), c("error").alias("Error"), F.when(ok, c("stop") - c("start")).otherwise(0).cast("long").alias("ReadBytes"), (gone & ~ok).alias("Gone"), F.when(ok, added).otherwise(0).cast("long").alias("_added"),
        )

    # ---- sources ----

    def enable(self, path: str, on: bool = True) -> None:
        """Show or hide a source's events, and read or skip it from now on; no event file is touched."""
        n = self._next()
        self._commit(n, staged(self._state().where(c("Path") == path).withColumn("Enabled", F.lit(on))))

    def forget(self, *paths: str) -> int:
        """Remove sources and their events; returns how many of these there were. Only partitions that hold some are rewritten."""
        return self._forget(c("Path").isin(*paths), c("Source").isin(*paths))

    def forget_journal(self) -> int:
        """Remove all journal units and their events."""
        return self._forget(c("Kind") == "journal", c("Source").startswith(JOURNAL))

    def clear(self) -> None:
        """Empty the store; it keeps its folder."""
        for part in ("events", "terms", "manifest"):
            removed(self.spark, f"{self.root}/{part}")

    def _forget(self, which: Column, rows: Column) -> int:
        n = self._next()
        state = staged(self._state().where(which & ~c("Gone")))
        events = state.agg(F.sum("Events")).first()[0] or 0
        nothing = {k: F.lit(0).cast("long") for k in ("Events", "Untimed", "Lines")}
        self._commit(n, state.withColumns({**nothing, "Gone": F.lit(True), "Mark": F.lit(None).cast("string"), "Action": F.lit("forgotten")}))
        self._rewrite(rows, F.lit(False))
        return int(events)

    def _rewrite(self, which: Column, keep: Column) -> None:
        """Write the partitions that hold rows of ``which`` anew, without those of them that ``keep`` is not true for.

        Dynamic overwriting replaces these partitions only; those that become empty are removed.
        """
        raw = self._raw()
        keys = ["Run", "Day", "Bucket"]
        held = [tuple(r) for r in raw.where(which).select(*keys).distinct().collect()]  # a row a partition
        if not held:
            return
        mine = self.spark.createDataFrame(held, "_r int, _d date, _b int")
        inside = raw.join(F.broadcast(mine), (c("Run") == c("_r")) & c("Day").eqNullSafe(c("_d")) & (c("Bucket") == c("_b"))).drop("_r", "_d", "_b")
        kept = staged(inside.where(~which | F.coalesce(keep, F.lit(False))))
        full = {tuple(r) for r in kept.select(*keys).distinct().collect()}
        kept.hint("rebalance", *map(c, keys)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*keys).parquet(f"{self.root}/events")
        for run, day, bucket in held:
            if (run, day, bucket) not in full:
                removed(self.spark, f"{self.root}/events/Run={run}/Day={day or '__HIVE_DEFAULT_PARTITION__'}/Bucket={bucket}")
        if full:  # files of other names now: they are searched by a scan until they are indexed
            at = self.spark.createDataFrame(sorted(full, key=str), "_r int, _d date, _b int")
            new = _with_file(self._raw()).join(F.broadcast(at), (c("Run") == c("_r")) & c("Day").eqNullSafe(c("_d")) & (c("Bucket") == c("_b")), "left_semi")
            self._index(self.version(), new, mode="append")

    # ---- journal units ----

    def ingest_journal(self, entries: DataFrame, batch: int) -> DataFrame | None:
        """Take a batch of journal events (unit, ts, level, message, extra, raw, line_number), a source a unit.

        For ``foreachBatch``: a batch that was committed before changes nothing, so that a
        replay is harmless; entries of disabled units are skipped. Only the units met are
        merged: a partial sum a unit, joined to the newest manifest row of each.
        """
        n = self._next()
        state = staged(self._state())
        if state.where(c("Batch") >= batch).limit(1).count():
            return None
        unit = F.substring(F.when(F.coalesce(c("unit"), F.lit("")) == "", "journal").otherwise(c("unit")), 1, 200)
        rows = entries.withColumn("path", F.concat(F.lit(JOURNAL), unit))
        off = state.where(~c("Enabled") & (c("Kind") == "journal")).select(c("Path").alias("_off"))
        rows = rows.join(off, c("path") == c("_off"), "left_anti").withColumn("format", F.lit("journal"))
        log = log_columns(rows).withColumns({"App": F.substr("Source", F.lit(len(JOURNAL) + 1)), "EventId": F.xxhash64("Source", F.lit(batch), "LineNumber", "Timestamp", "Message")})
        sums = _sums(self._write(n, log))
        met = sums.join(state, c("_s") == c("Path"), "left")
        onward = F.coalesce(~c("Gone"), F.lit(False))
        zero = lambda x: F.coalesce(F.when(onward, c(x)), F.lit(0))
        changed = met.select(
            c("_s").alias("Path"), F.lit("journal").alias("Kind"), F.substr("_s", F.lit(len(JOURNAL) + 1)).alias("App"), *(F.lit(None).cast(t).alias(k) for k, t in (("Identity", "string"), ("Size", "long"), ("Modified", "long"), ("Mark", "string"), ("Header", "array<string>"))),
            F.lit(0).cast("long").alias("Lines"), F.lit("journal").alias("Format"), F.lit(1.0).alias("Confidence"), F.lit(False).alias("Compressed"), (zero("Events") + c("_n")).alias("Events"), (zero("Untimed") + c("_untimed")).alias("Untimed"),
            F.least(F.when(onward, c("FirstEvent")), c("_first")).alias("FirstEvent"), F.greatest(F.when(onward, c("LastEvent")), c("_last")).alias("LastEvent"), F.coalesce("Enabled", F.lit(True)).alias("Enabled"), F.when(c("Gone"), n).otherwise(F.coalesce("Since", F.lit(0))).cast("int").alias("Since"),
            F.lit(batch).cast("long").alias("Batch"), F.when(onward, "appended").otherwise("new").alias("Action"), F.lit(None).cast("string").alias("Error"), F.lit(0).cast("long").alias("ReadBytes"), F.lit(False).alias("Gone"), c("_n").alias("_added"),
        )
        changed = staged(changed)
        self._commit(n, changed)
        return changed.select("Path", "Action", c("_added").alias("Events"))

    # ---- term index ----

    def _index(self, n: int, events: DataFrame, mode: str = "overwrite") -> None:
        """Write which of these event files hold which terms, sorted by the term's hash, and that they are indexed."""
        found = F.transform(F.regexp_extract_all("Message", F.lit(f"({WORDS})")), F.lower)
        hits = events.select("file", F.explode_outer(F.array_distinct(found)).alias("term")).select("file", F.explode(F.array(F.xxhash64("term"), F.lit(INDEXED))).alias("h"))
        # a file's rows lie in few tasks: most repeated terms go before the shuffle
        pairs = hits.distinct().repartitionByRange("h").sortWithinPartitions("h", "file")
        pairs.write.mode(mode).option("parquet.block.size", 4 << 20).parquet(f"{self.root}/terms/Run={n}")

    def having(self, needle: str) -> DataFrame:
        """The visible events of those files that may hold all terms of ``needle``; all events if it has none, or if most files do.

        Files are looked up by the hashes of the terms, which the index is sorted by; files
        that are not indexed are read. Filter the result: the index tells files, not rows.
        """
        words = sorted({w.lower() for w in v.terms(needle)})
        if not words or not exists(self.spark, f"{self.root}/terms") or not exists(self.spark, f"{self.root}/events"):
            return self.events()
        hashes = [F.xxhash64(F.lit(w)) for w in words]
        index = self.spark.read.schema("file string, h long, Run int").option("basePath", f"{self.root}/terms").parquet(f"{self.root}/terms")
        hits = index.where(c("h").isin(*hashes, F.lit(INDEXED))).groupBy("file").agg(F.count_distinct(F.when(c("h") != INDEXED, c("h"))).alias("n"))
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/events").select("path", F.regexp_extract("path", r"/events/(Run=.*)$", 1).alias("_file"))
        may = there.join(hits, c("_file") == c("file"), "left").where(c("n").isNull() | (c("n") == len(words))).select("path")
        chosen = [r["path"] for r in may.limit(NAMED_FILES + 1).collect()]
        if len(chosen) > NAMED_FILES:
            return self.events()
        if not chosen:
            return self.spark.createDataFrame([], PLACED)
        rows = self.spark.read.schema(PLACED).option("basePath", f"{self.root}/events").parquet(*chosen)
        return self._visible(rows.where(c("Run") <= self.version()))

    def search(self, needle: str) -> DataFrame:
        """The events whose message has the terms of ``needle`` one after another."""
        return self.having(needle).where(v.has(c("Message"), needle))

    # ---- retention ----

    def _sizes(self) -> DataFrame:
        """(Run, Day, bytes) of the event files, from their names and lengths alone."""
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/events").select("path", "length")
        day = F.to_date(F.nullif(F.regexp_extract("path", r"/Day=([0-9-]+)/", 1), F.lit("")))
        rows = there.select(F.regexp_extract("path", r"/Run=(\d+)/", 1).cast("int").alias("Run"), day.alias("Day"), "length")
        return rows.groupBy("Run", "Day").agg(F.sum("length").alias("bytes"))

    def size(self) -> int:
        return (self._sizes().agg(F.sum("bytes")).first()[0] or 0) if exists(self.spark, f"{self.root}/events") else 0

    def retain_age(self, now: dt.datetime, days: int = 120) -> None:
        """Remove timed events older than ``days``: whole days at once, and the first day's older part."""
        cut = now - dt.timedelta(days=days)
        self._drop(c("Day") < F.to_date(F.lit(cut)))
        self._rewrite((c("Day") == F.to_date(F.lit(cut))) & (c("Timestamp") < F.lit(cut)), F.lit(False))
        self._recount()

    def retain_bytes(self, most: int) -> None:
        """Remove the oldest events until the event files have at most ``most`` bytes.

        Whole days go first, oldest first, untimed events last; of the day at the cut, the oldest rows
        go, by share of its bytes, and only its partitions are rewritten.
        """
        while (over := self.size() - most) > 0:
            days = self._sizes().groupBy("Day").agg(F.sum("bytes").alias("bytes")).orderBy(c("Day").asc_nulls_last()).collect()  # a row a day
            whole, cut = [], None
            for r in days:
                if r["bytes"] <= over:
                    whole.append(r["Day"])
                    over -= r["bytes"]
                else:
                    cut = r
                    break
            for day in whole:
                self._drop(c("Day").eqNullSafe(F.lit(day)))
            if cut is not None and over > 0:
                self._thin(cut["Day"], 1 - over / cut["bytes"])
        self._recount()

    def _thin(self, day: dt.date | None, share: float) -> None:
        """Keep about that share of a day's events, the newest; a second try of the caller takes what is still too much."""
        of_day = c("Day").eqNullSafe(F.lit(day))
        order = F.coalesce(F.unix_micros("Timestamp"), c("LineNumber"), F.lit(0))
        edge = self._raw().where(of_day).agg(F.percentile_approx(order, F.lit(max(0.0, min(1.0, 1.02 - share))), F.lit(10_000))).first()[0]
        self._rewrite(of_day & (order <= edge), F.lit(False))

    def _drop(self, which: Column) -> None:
        """Remove whole day partitions."""
        if exists(self.spark, f"{self.root}/events"):
            for r in self._sizes().where(which).collect():  # a row a run and day
                removed(self.spark, f"{self.root}/events/Run={r['Run']}/Day={r['Day'] or '__HIVE_DEFAULT_PARTITION__'}")

    def _recount(self) -> None:
        """Bring the sources' sums in step with their events."""
        n = self._next()
        sums = _sums(self.events())
        state = self._state().where(~c("Gone") & c("Enabled"))
        rows = state.join(sums, c("Path") == c("_s"), "left").where(~c("Events").eqNullSafe(F.coalesce("_n", F.lit(0))))
        fresh = {"Events": F.coalesce("_n", F.lit(0)), "Untimed": F.coalesce("_untimed", F.lit(0)), "FirstEvent": c("_first"), "LastEvent": c("_last")}
        self._commit(n, staged(rows.withColumns(fresh).drop("_s", "_n", "_untimed", "_first", "_last")))


JOURNAL = "journal:"


def journal_entries(lines: DataFrame) -> DataFrame:
    """Journal export lines (column ``line``; a stream or a table) as entries for ``ingest_journal``."""
    from .formats import FORMATS, Context

    f, none = FORMATS["journal"], F.lit(None)
    context = Context(none.cast("int"), none.cast("int"), none.cast("array<string>"))
    line = c("line")
    unit = F.coalesce(*(F.get_json_object(line, f"$.{k}") for k in ("_SYSTEMD_UNIT", "UNIT", "SYSLOG_IDENTIFIER")))
    rows = lines.where(F.coalesce(f.fits(line, context), F.lit(False))).select(unit.alias("unit"), f.event(line, context).alias("e"), line.alias("raw"))
    return rows.select("unit", "e.*", "raw", F.lit(0).cast("long").alias("line_number"))


def follow_journal(store: LogStore, lines: DataFrame, checkpoint: str):
    """A streaming query that takes journal export lines into the store, each batch once, and stops when all is read."""
    return journal_entries(lines).writeStream.foreachBatch(lambda df, k: store.ingest_journal(df, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
