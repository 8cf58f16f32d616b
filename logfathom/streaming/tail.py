"""Following growing logs with Structured Streaming.

``LogTail`` is a streaming source that reads what was appended to files since the last
offset, leaves a last line without its end for later, and begins anew when a file became
shorter or what was read of it changed. Files are known by their identity (device and inode; in stores
without one by path, and a new path by what was read of a lost one in its folder), so that a renamed
file goes on where it was and a new one under the old name is read from its start.

A trigger admits ``maxBytes`` at most, whole lines but for a single longer one. Where the query stands
after a restart is read from the newest entry of its own offset log (option ``checkpoint``),
since a Python stream reader is not told. Each trigger lists only those folders that changed, several at a
time, and opens only files whose size or time changed. Executors read the byte ranges.
Files are read as they are written; compressed ones are read by ``logstore``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import files
from ..sources.formats import FORMATS, Context

SCHEMA = "path string, at long, line string"
MAX_BYTES = 1 << 40
#: Folders listed and files opened at a time; triggers after which a lost file is forgotten.
THREADS, LOST = 16, 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, stop: int):
        self.path, self.start, self.end, self.stop = path, start, end, stop


class Folders:
    """The files below a folder, kept from trigger to trigger."""

    def __init__(self, path: str):
        self.store, self.base, self.front = files.opened(path)
        self.known: dict[str, tuple[int, float, list]] = {}  # folder: its time, when it was listed, what it holds

    def _listed(self, folder: str, modified: int) -> list:
        from pyarrow import fs

        was = self.known.get(folder)
        if was is None or was[0] != modified or modified / 1e9 > was[1] - 2:  # it may have changed within the same tick
            now = time.time()
            held = self.store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
            was = self.known[folder] = (modified, now, [(f.path, f.type == fs.FileType.Directory) for f in held if not f.base_name.startswith((".", "_"))])
        return was[2]

    def files(self) -> dict[str, tuple[str, int, int]]:
        """By identity (path, where there is none): path, size and time of each file."""
        from pyarrow import fs

        found, folders = {}, [self.base]
        with ThreadPoolExecutor(THREADS) as pool:
            while folders:
                there = [f for f in self.store.get_file_info(folders) if f.type == fs.FileType.Directory]
                held = [x for own in pool.map(lambda f: self._listed(f.path, f.mtime_ns or 0), there) for x in own]
                folders = [p for p, is_dir in held if is_dir]
                for f in self.store.get_file_info([p for p, is_dir in held if not is_dir]):
                    if f.type == fs.FileType.File:
                        try:
                            found[files.identity(f.path) if self.front == "file://" else f.path] = (f.path, f.size, f.mtime_ns)
                        except FileNotFoundError:  # gone meanwhile
                            continue
        return found


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, max_bytes: int = MAX_BYTES, checkpoint: str | None = None):
        self.path, self.max_bytes, self.checkpoint = path, max_bytes, checkpoint
        self.last: dict[str, str] | None = None  # marks of the offset given last, and the path after each
        self.seen: dict[str, tuple] = {}  # size and time of files read to their end
        self.lost: dict[str, int] = {}
        self.folders: Folders | None = None

    def initialOffset(self) -> dict:
        return {}

    def _stands(self) -> dict[str, str]:
        """The newest offset in the query's log: nothing for a new query."""
        if not self.checkpoint:
            return {}
        from pyarrow import fs

        store, base, _ = files.opened(self.checkpoint)
        entries = [f for f in store.get_file_info(fs.FileSelector(f"{base}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
        if not entries:
            return {}
        with store.open_input_file(max(entries, key=lambda f: int(f.base_name)).path) as s:
            return json.loads(s.read().decode().split("\n")[2])

    def _there(self) -> dict[str, tuple[str, int, int]]:
        if self.folders is None:
            self.folders = Folders(self.path)
        return self.folders.files()

    def latestOffset(self) -> dict:
        """For each file the mark of a line end, ``maxBytes`` beyond the offset before."""
        if self.last is None:
            self.last = self._stands()
        there, left = self._there(), self.max_bytes
        for key in [k for k in self.last if k not in there]:
            self.lost[key] = self.lost.get(key, 0) + 1
            if self.lost[key] > LOST:
                del self.last[key]
        for key, (path, size, modified) in sorted(there.items(), key=lambda x: x[1][0]):
            self.lost.pop(key, None)
            if self.seen.get(key) == (size, modified) and self.last.get(key, "").endswith(f":{path}"):
                continue
            if left <= 0:
                break
            with self.folders.store.open_input_file(path) as s:
                n = s.size()
                was = self._was(s, n, key, path)
                at = files.resumes(s, n, was)
                whole = files.line_end(s, n, at)
                end = whole if whole - at <= left else files.line_end(s, at + left, at) if left < n - at else whole
                if end == at < whole and left == self.max_bytes:  # one line is longer than a trigger takes
                    end = self._first_end(s, at + left, whole)
                left -= end - at
                self.last[key] = f"{files.mark(s, end)}:{path}"
            if end == whole:
                self.seen[key] = (size, modified)
            elif end == at:
                break  # the next line waits for the next trigger
        return dict(self.last)

    @staticmethod
    def _first_end(s, at: int, stop: int, step: int = 1 << 16) -> int:
        while at < stop:
            k = (block := s.read_at(min(step, stop - at), at)).find(b"\n")
            if k >= 0:
                return at + k + 1
            at += len(block)
        return stop

    def _was(self, s, n: int, key: str, path: str) -> str | None:
        """The mark known of a file; in stores without identities, also that of a lost file of the folder whose beginning it has."""
        if key in self.last:
            return _mark(self.last[key])
        if key == path:
            folder = path.rpartition("/")[0]
            for other in [k for k in self.lost if k in self.last and k.rpartition("/")[0] == folder]:
                known = _mark(self.last[other])
                if files.offset(known) and files.resumes(s, n, known):
                    self.lost.pop(other)
                    self.last.pop(other)
                    return known
        return None

    def partitions(self, start: dict, end: dict) -> list[Range]:
        there, out = self._there(), []
        marks = {_mark(m) for m in start.values()}
        for key, value in sorted(end.items(), key=lambda x: x[1].rpartition(":")[2]):
            mark, path = _mark(value), value.split(":", 2)[2]
            if mark == _mark(start.get(key, "0:")) or (key not in start and mark in marks):
                continue
            path = there.get(key, (path,))[0]  # where it is now
            try:
                with self.folders.store.open_input_file(path) as s:
                    n = files.offset(mark)
                    was = _mark(start[key]) if key in start else next((m for m in marks if key == path and files.offset(m) and files.resumes(s, n, m)), None)
                    at = files.resumes(s, n, was)
            except FileNotFoundError:  # removed before it was read
                continue
            out += [Range(path, a, min(a + files.RANGE, n), n) for a in range(at, n, files.RANGE)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        """The lines that begin in the range; the one at its start belongs to it only after a line end."""
        store, _, _ = files.opened(self.path)
        with store.open_input_file(part.path) as s:
            for at, line in files.lines_of(s, part.start, part.end, part.stop):
                yield part.path, at, line.rstrip(b"\r").decode("utf-8", "replace")


def _mark(value: str) -> str:
    """A mark without the path behind it."""
    return ":".join(value.split(":")[:2])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("maxBytes", MAX_BYTES)), self.options.get("checkpoint"))


def follow(spark: SparkSession, path: str, format_: str, max_bytes: int = MAX_BYTES, checkpoint: str | None = None) -> DataFrame:
    """A stream of (path, at, ts, level, message, extra) of lines that fit a format; others are plain events.

    With ``max_bytes``, a trigger takes no more; ``checkpoint`` is the query's own checkpoint folder then.
    """
    spark.dataSource.register(LogTail)
    options = {"path": path, "maxBytes": str(max_bytes), **({"checkpoint": checkpoint} if checkpoint else {})}
    return parsed(spark.readStream.format("logtail").options(**options).load(), format_)


def parsed(lines: DataFrame, format_: str) -> DataFrame:
    f, none = FORMATS[format_], F.lit(None)
    context = Context(F.year(F.current_date()), F.month(F.current_date()), none.cast("array<string>"))
    line = F.col("line")
    event = F.when(F.coalesce(f.fits(line, context), F.lit(False)), f.event(line, context)).otherwise(FORMATS["plain"].event(line, context))
    return lines.where(F.trim(line) != "").withColumn("_e", event).select("path", "at", "_e.*")


def append(stream: DataFrame, table: str, checkpoint: str):
    """Append a stream of events to a Parquet table, exactly once, and stop when all is read."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, table: str, checkpoint: str) -> int:
    """Append a bounded stream to a Parquet table trigger by trigger until all is read; the number of triggers with rows."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        return sum(p["numInputRows"] > 0 for p in query.recentProgress)
    finally:
        query.stop()


def counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and level; windows close when the watermark passes them."""
    timed = stream.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "level", "n")
