"""What the operators of this subpackage share: word rules, hashing, staging of tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.shared import shared_dir, staged  # noqa: F401

#: A word is a run of anything but these six ASCII characters; ``bytes.split()`` splits at exactly these.
WORD_GAP = r"[\x20\x09-\x0D]+"
LAST = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(f: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, size: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from a partition's rows to result rows, for ``mapInArrow``: both sides pass one at a time, only batches are held."""
    into = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = f(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        while rows := list(islice(found, size)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), into.types, strict=True)], schema=into)

    return run


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now: Spark removes them once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column | str) -> Column:
    """Number of words of a text, 0 for null, without building them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is an empty one."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; two different words meet with probability 2**-64."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all windows of ``n`` word hashes (none if there are fewer words)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base, out, m = 0x9E3779B97F4A7C15, h, 1
    for bit in bin(n)[3:]:  # windows of m words become those of 2 m, and of one more
        out, m = out[:-m] * np.uint64(pow(base, m, 2**64)) + out[m:], 2 * m
        if bit == "1":
            out, m = out[:-1] * np.uint64(base) + h[m:], m + 1
    return mixed(out)
