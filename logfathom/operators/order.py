"""Row order over whole tables without sending all rows to one task.

A window without partitions puts a table into one task. Here rows are range-partitioned by the
sort keys and a tie-breaker, so that rows with equal keys spread over several parts too, and
sorted inside each. That is the only shuffle: the parts are written to the shared folder, and
what reaches across them is small. Row numbers need the sizes of the parts before, running sums
their totals, and neighbours a few edge rows of each part; these go to all tasks, and each part
is then passed through in its order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = "_rn"
PART, AT = "_part", "_at"


def _checkpoints(df: DataFrame) -> None:
    """Make sure that checkpoints go to the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            top = "file://" + tempfile.mkdtemp(prefix="logfathom-")
        sc.setCheckpointDir(top)


def parted(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, dict[int, int]]:
    """``df`` in sorted parts, with the part of each row and its place there from 0; the sizes of the parts.

    Rows tied on all keys come in any order, told apart by where they were read. The parts are a
    checkpoint: sizes and rows come from the same ones, also after an executor is lost. The
    driver gets one number a part.
    """
    _checkpoints(df)
    keys = [*order, F.col("_tie")]
    rows = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id()
    parts = rows.withColumns({PART: F.shiftright(at, 33).cast("int"), AT: at.bitwiseAND(F.lit(2**33 - 1))}).checkpoint()
    return parts, {r[PART]: r["n"] for r in parts.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).orderBy(PART).collect()}


def _from_parts(df: DataFrame, values: dict[int, int], name: str) -> DataFrame:
    """``df`` with a number of its part; parts and their order stay, since a table of one row a part is broadcast."""
    told = df.sparkSession.createDataFrame(sorted(values.items()), f"_p int, {name} long")
    return df.join(F.broadcast(told), F.col(PART) == F.col("_p"), "left").drop("_p")


def _before(sizes: dict[int, int]) -> dict[int, int]:
    total, out = 0, {}
    for p, n in sorted(sizes.items()):
        out[p], total = total, total + n
    return out


def numbered(df: DataFrame, order: Sequence[Column], number: str = NUMBER) -> DataFrame:
    """``df`` with ``number``, from 1 in the order of ``order``; rows tied on all keys get theirs in any order."""
    parts, sizes = parted(df, order)
    return _from_parts(parts, _before(sizes), "_shift").withColumn(number, (F.col(AT) + F.col("_shift") + 1).cast("long")).drop("_shift", PART, AT)


def _shifted(names: dict[str, tuple[str, int, object]], back: int, ahead: int, edges: dict[int, tuple[list[dict], list[dict]]]):
    """Adds to each row of a part the values of rows before and after it; a part's edges bring those of its neighbours."""
    wanted = sorted({x for x, _, _ in names.values()})

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the first is next; the others give what comes after it
        past: pa.Table | None = None
        end: pa.Table | None = None

        def pick(batch: pa.RecordBatch) -> pa.Table:
            return pa.table({x: batch.column(batch.schema.names.index(x)) for x in wanted})

        def table(rows: list[dict], like: pa.RecordBatch) -> pa.Table:
            return pa.table({x: pa.array([r[x] for r in rows], like.column(like.schema.names.index(x)).type) for x in wanted})

        def done(batch: pa.RecordBatch, later: list[pa.Table]) -> pa.RecordBatch:
            nonlocal past
            own = pick(batch)
            around = pa.concat_tables([past, own, pa.concat_tables(later).slice(0, ahead)] if later else [past, own]).combine_chunks()
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for name, (x, k, default) in names.items():
                at = past.num_rows - k
                values = around.column(x)
                n = len(own)
                lead = min(n, max(0, -at))
                found = values.slice(max(0, at), max(0, min(n - lead, len(values) - max(0, at))))
                fill = lambda m, kind=values.type, default=default: pa.array([default] * m, kind) if default is not None else pa.nulls(m, kind)
                columns[name] = pa.concat_arrays([fill(lead), *found.chunks, fill(n - lead - len(found))])
            reached = past.num_rows + len(own)
            past = around.slice(max(0, reached - back), min(back, reached))
            return pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if k not in dropped})

        dropped = {PART, AT, *(x for x, _, _ in names.values())}
        for batch in batches:
            if not batch.num_rows:
                continue
            if past is None:
                past, end = (table(rows, batch) for rows in edges[batch.column(batch.schema.names.index(PART))[0].as_py()])
            held.append(batch)
            while len(held) > 1 and sum(b.num_rows for b in held[1:]) >= ahead:
                yield done(held[0], list(map(pick, held[1:])))
                held = held[1:]
        while held:
            yield done(held[0], [*map(pick, held[1:]), end])
            held = held[1:]

    return shift


def neighbours(df: DataFrame, order: Sequence[Column], shifted: dict[str, tuple[Column, int, object]]) -> DataFrame:
    """``df`` plus, by name, the value of an expression so many rows before (after, if negative), or a default."""
    back, ahead = max(0, *(k for _, k, _ in shifted.values())), max(0, *(-k for _, k, _ in shifted.values()))
    values = {f"_x{i}": x for i, (x, _, _) in enumerate(shifted.values())}
    parts, sizes = parted(df.withColumns(values), order)
    kinds = {n: parts.schema[f"_x{i}"].dataType for i, n in enumerate(shifted)}
    out = T.StructType([f for f in parts.schema if f.name not in (PART, AT, *values)] + [T.StructField(n, k) for n, k in kinds.items()])
    if not sizes:
        return df.sparkSession.createDataFrame([], out)
    edge = _from_parts(parts, sizes, "_size").where((F.col(AT) < ahead) | (F.col(AT) >= F.col("_size") - back)).select(PART, AT, *values)
    of: dict[int, list[dict]] = {p: [] for p in sizes}
    for r in edge.orderBy(PART, AT).collect():  # a few rows a part
        of[r[PART]].append(r.asDict())
    around, ordered = {}, sorted(sizes)

    def gathered(parts_: list[int], most: int, first: bool) -> list[dict]:
        """The ``most`` rows nearest to an edge; parts with fewer are passed over to those behind them."""
        found: list[dict] = []
        for p in parts_:
            mine, need = [r for r in of[p] if (r[AT] < ahead if first else r[AT] >= sizes[p] - back)], most - len(found)
            if need <= 0:
                break
            found = [*found, *mine[:need]] if first else [*mine[max(0, len(mine) - need) :], *found]
        return found

    for i, p in enumerate(ordered):
        around[p] = gathered(ordered[:i][::-1][: back + 1], back, False), gathered(ordered[i + 1 :][: ahead + 1], ahead, True)
    task = _shifted({n: (f"_x{i}", k, d) for i, (n, (_, k, d)) in enumerate(shifted.items())}, back, ahead, around)
    return parts.mapInArrow(task, out)


def running_sum(df: DataFrame, order: Sequence[Column], name: str, x: Column) -> DataFrame:
    """``df`` plus the sum of ``x`` over all rows up to each; nulls count as 0."""
    parts, sizes = parted(df.withColumn("_x", x), order)
    total, kind = 0, parts.schema["_x"].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType() if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DoubleType()
    parts = parts.withColumn("_x", F.coalesce(F.col("_x").cast(kind), F.lit(0).cast(kind)))
    before = {}
    for r in parts.groupBy(PART).agg(F.sum("_x").alias("t")).orderBy(PART).collect():  # a row a part
        before[r[PART]], total = total, total + r["t"]
    out = T.StructType([f for f in parts.schema if f.name not in (PART, AT, "_x")] + [T.StructField(name, kind)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            v = columns["_x"]
            start = before[columns[PART][0].as_py()] if reached is None else reached
            if pa.types.is_decimal(v.type):
                sums, at = [], start
                for n in v.to_pylist():
                    at += n
                    sums.append(at)
                done = pa.array(sums, v.type)
            else:
                done = pc.cumulative_sum(v, start=pa.scalar(start, v.type))
            reached = done[-1].as_py()
            yield pa.RecordBatch.from_pydict({k: c for k, c in columns.items() if k not in (PART, AT, "_x")} | {name: done})

    return parts.mapInArrow(add, out)
