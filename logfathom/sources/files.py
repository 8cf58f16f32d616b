"""Files as Spark sees them: a listing by folders, byte ranges, and where to go on after an earlier read.

How far a file was read is told by a mark: the offset of the last line end, and a hash of the
bytes around both ends of what was read, which cannot change while a file only grows. Its
identity (device and inode, where the store has them) tells a renamed file from a new one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import staged

#: A task reads so many bytes at most; a mark's hash covers so many at either end of what was read.
RANGE, HEAD = 32 << 20, 256
#: Folders are listed, and files opened, in so many tasks at most.
TASKS = 1000
LISTED = "path string, is_dir boolean, size long, modified long, identity string"


def opened(path: str):
    """(file system, path inside it, what to put before such paths)."""
    from pyarrow import fs

    uri = path if "://" in path else f"file://{path}"
    store, base = fs.FileSystem.from_uri(uri)
    at = uri.rfind(base)
    return store, base, uri[:at] if at >= 0 else "file://"


def identity(path: str) -> str | None:
    """Device and inode of a local file; other stores have none."""
    if path.startswith("/"):
        s = os.stat(path)
        return f"{s.st_dev}:{s.st_ino}"
    return None


def _in_folder(folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    store, base, front = opened(folder)
    there = store.get_file_info(base)
    for f in [there] if there.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True)):
        if f.base_name.startswith((".", "_")):
            continue
        try:
            is_dir = f.type == fs.FileType.Directory
            yield front + f.path, is_dir, f.size, f.mtime_ns, None if is_dir or front != "file://" else identity(f.path)
        except FileNotFoundError:  # gone meanwhile
            continue


def _lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = list(_in_folder(folder))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in LISTED.split(", ")])


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, identity) of all files below ``path`` whose names fit ``pattern``.

    Folders are listed by tasks, level by level, so that no walk over a large tree runs on the
    driver. Names that begin with a dot or an underscore are left out.
    """
    levels, folders = [], spark.createDataFrame([(path,)], "path string")
    while n := folders.count():
        found = staged(folders.select("path").repartition(min(n, TASKS), "path").mapInArrow(_lister, LISTED))
        levels.append(found.where(~F.col("is_dir")))
        folders = found.where("is_dir")
    files = levels[0]
    for more in levels[1:]:
        files = files.unionByName(more)
    like = "".join({"*": ".*", "?": "."}.get(x, f"\\Q{x}\\E") for x in pattern)
    return files.where(F.substring_index("path", "/", -1).rlike(f"^{like}$")).select("path", "size", "modified", "identity")


def mark(s, end: int) -> str:
    """The end of what was read of a file, and a hash of the bytes at its beginning and before that end."""
    around = s.read_at(min(end, HEAD), 0) + s.read_at(min(end, HEAD), max(0, end - HEAD))
    return f"{end}:{hashlib.sha256(around).hexdigest()[:16]}"


def offset(mark_: str | None) -> int:
    return int((mark_ or "0:").split(":")[0])


def resumes(s, size: int, known: str | None) -> int:
    """Where reading goes on: after what the mark tells, or at the start of a new or rewritten file."""
    old = offset(known)
    return old if old <= size and (not old or mark(s, old) == known) else 0


def line_end(s, end: int, start: int = 0, step: int = 1 << 16) -> int:
    """The last line end at or before ``end``; ``start`` if there is none after it."""
    while end > start:
        block = s.read_at(min(step, end - start), max(start, end - step))
        k = block.rfind(b"\n")
        if k >= 0:
            return end - len(block) + k + 1
        end -= len(block)
    return start


def lines_of(s, start: int, end: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range of whole lines up to ``stop``; one at its start only after a line end."""
    at, data = start, s.read_at(end - start, start)
    if at and s.read_at(1, at - 1) != b"\n":
        k = data.find(b"\n")
        at, data = (at + k + 1, data[k + 1 :]) if k >= 0 else (end, b"")
    while data and not data.endswith(b"\n") and end < stop:
        more = s.read_at(min(1 << 16, stop - end), end)
        k = more.find(b"\n")
        data, end = (data + more[: k + 1], end + k + 1) if k >= 0 else (data + more, end + len(more))
    for line in data.split(b"\n")[:-1]:
        yield at, line
        at += len(line) + 1
