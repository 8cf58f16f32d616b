"""``Table``: the tabular operators as methods over a DataFrame, one plan for Catalyst.

Every method returns a new ``Table``. A table remembers its sort order (hidden columns
that later projections keep), which ``row_number``, ``prev``, ``next_`` and
``row_cumsum`` use. Names are matched in any case. Expressions are columns; keyword
arguments name them.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.aggregates import ROW
from . import order as rows_in_order

HIDDEN = "_order_"


@dataclass(frozen=True)
class Capture:
    """A named part of a text for ``Table.parse``; ``kind`` is string, long, int, real, bool or datetime."""

    name: str
    kind: str = "string"


@dataclass(frozen=True)
class Table:
    raw: DataFrame
    order: tuple[tuple[str, bool, bool], ...] = ()  # hidden column, ascending, nulls first
    time_column: str | None = None
    name: str = ""
    view: dict | None = None

    # ---- construction and results ----

    @staticmethod
    def read(spark: SparkSession, path: str, time_column: str | None = None, name: str = "") -> Table:
        """A Parquet table; times without a zone are UTC."""
        df = spark.read.parquet(path)
        naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return Table(df.withColumns({c: F.col(c).cast("timestamp") for c in naive}), time_column=time_column, name=name or path.rstrip("/").rpartition("/")[2].removesuffix(".parquet"))

    @staticmethod
    def print(spark: SparkSession, **values: object) -> Table:
        """One row of constant expressions."""
        return Table(spark.range(1).select(*(v.col(x).alias(k) for k, x in values.items())))

    @property
    def df(self) -> DataFrame:
        """The visible columns, sorted if the table is."""
        out = self.raw.orderBy(*self._keys()) if self.order else self.raw
        return out.drop(*(h for h, _, _ in self.order))

    @property
    def columns(self) -> list[str]:
        hidden = {h for h, _, _ in self.order}
        return [c for c in self.raw.columns if c not in hidden]

    def scalar(self) -> Column:
        """The first cell as a scalar subquery."""
        one = self.df.select(self.columns[0]).limit(1)
        return one.scalar()

    def explain(self) -> None:
        self.df.explain("formatted")

    def getschema(self) -> Table:
        spark = self.raw.sparkSession
        rows = [(f.name, k, f.dataType.simpleString(), (f.metadata or {}).get("description", "")) for k, f in enumerate(self.raw.select(*self.columns).schema)]
        return Table(spark.createDataFrame(rows, "ColumnName string, ColumnOrdinal int, DataType string, Description string"))

    def _keys(self) -> list[Column]:
        kinds = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
        return [getattr(F.col(h), kinds[a, n])() for h, a, n in self.order]

    def _with(self, df: DataFrame) -> Table:
        return replace(self, raw=df, view=None)

    def _new(self, df: DataFrame, name: str = "") -> Table:
        return Table(df, name=name)

    def _real(self, name: str) -> str:
        """A column's own spelling; an error with a suggestion if there is none."""
        for c in self.columns:
            if c.lower() == name.lower():
                return c
        import difflib

        near = difflib.get_close_matches(name, self.columns, 1)
        raise KeyError(f"no column {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))

    # ---- rows ----

    def where(self, *predicates: Column) -> Table:
        """Rows for which all predicates are true; a null is not."""
        df = self.raw
        for p in v.specialised(list(predicates), df):
            df = df.where(p)
        return self._with(df)

    def between(self, start: object = None, end: object = None) -> Table:
        """Rows whose time column lies within the range, both ends included."""
        if self.time_column is None:
            return self
        t, df = F.col(self.time_column), self.raw
        df = df if start is None else df.where(t >= F.lit(start))
        return self._with(df if end is None else df.where(t <= F.lit(end)))

    def search(self, term: str, columns: Sequence[str] | None = None, case_sensitive: bool = False) -> Table:
        """Rows with the term, as a whole one, in any of the text columns."""
        kinds = dict(self.raw.dtypes)
        names = [self._real(c) for c in columns] if columns else [c for c in self.columns if kinds[c] in ("string", "variant") or kinds[c].startswith(("array", "map", "struct"))]
        test = F.lit(False)
        for c in names:
            test |= v.has(v.text(F.col(c)), term, fold=not case_sensitive)
        return self.where(test)

    def distinct(self, *columns: str) -> Table:
        names = [self._real(c) for c in columns] or self.columns
        return self._new(self.raw.select(*names).distinct(), self.name)

    def take(self, n: int) -> Table:
        if n < 0:
            raise ValueError("take needs a number that is not negative")
        return self._new(self.df.limit(n), self.name) if not self.order else self._with(self.raw.orderBy(*self._keys()).limit(n))

    def sample(self, n: int) -> Table:
        """``n`` random rows."""
        return self._new(self.raw.select(*self.columns).orderBy(F.rand()).limit(n), self.name)

    def count(self) -> Table:
        return self._new(self.raw.agg(F.count(F.lit(1)).alias("Count")))

    # ---- columns ----

    def extend(self, **columns: Column) -> Table:
        """All expressions see the input row; an existing name is replaced in place."""
        own = {c.lower(): c for c in self.columns}
        return self._with(self.raw.withColumns({own.get(k.lower(), k): x for k, x in self._typed(columns).items()}))

    def _typed(self, columns: dict[str, object]) -> dict[str, Column]:
        """Expressions by name, built for the types that they have in this table."""
        return dict(zip(columns, v.specialised([v.col(x) for x in columns.values()], self.raw), strict=True))

    def _select(self, *columns: Column | str) -> Table:
        return self._with(self.raw.select(*columns, *(h for h, _, _ in self.order)))

    def project(self, *names: str, **columns: Column) -> Table:
        return self._select(*(self._real(n) for n in names), *(x.alias(k) for k, x in self._typed(columns).items()))

    def _matching(self, patterns: Sequence[str]) -> list[str]:
        out = []
        for p in patterns:
            found = [c for c in self.columns if fnmatch.fnmatchcase(c.lower(), p.lower())]
            out += [c for c in found or [self._real(p)] if c not in out] if "*" not in p else [c for c in found if c not in out]
        return out

    def project_away(self, *patterns: str) -> Table:
        gone = set(self._matching(patterns))
        return self._select(*(c for c in self.columns if c not in gone))

    def project_keep(self, *patterns: str) -> Table:
        kept = set(self._matching(patterns))
        return self._select(*(c for c in self.columns if c in kept))

    def project_rename(self, **new: str) -> Table:
        old = {self._real(o): n for n, o in new.items()}
        return self._select(*(F.col(c).alias(old.get(c, c)) for c in self.columns))

    def project_reorder(self, *patterns: str) -> Table:
        first = self._matching(patterns)
        return self._select(*first, *(c for c in self.columns if c not in first))

    # ---- order ----

    def sort_by(self, *keys: Column | str | tuple, stable: bool = True) -> Table:
        """Keys are columns or (column, "asc" or "desc", optionally nulls "first" or "last"); descending unless said.

        Nulls come last when descending, first when ascending. An earlier order breaks ties.
        """
        df, new = self.raw, []
        for k, key in enumerate(keys):
            x, *rest = key if isinstance(key, tuple) else (key,)
            up = bool(rest) and rest[0] == "asc"
            first = rest[1] == "first" if len(rest) > 1 else up
            hidden = f"{HIDDEN}{len(self.order)}_{k}"
            df = df.withColumn(hidden, F.col(self._real(x)) if isinstance(x, str) else x)
            new.append((hidden, up, first))
        return replace(self, raw=df, order=(*new, *(self.order if stable else ())), view=None)

    def top(self, n: int, *keys: Column | str | tuple) -> Table:
        return self.sort_by(*keys).take(n)

    def serialize(self, **columns: Column) -> Table:
        """Marks the order as one that matters; a table needs one for window functions."""
        return self.extend(**columns) if columns else self

    def _sorted_by(self) -> list[Column]:
        if not self.order:
            raise ValueError("window functions need an order: use sort_by first")
        return self._keys()

    def row_number(self, name: str = "row_number", start: int = 1, by: Sequence[str] = ()) -> Table:
        """Number of each row in the order, within ``by`` if given."""
        if by:
            return self._with(self.raw.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*self._keys())) + start - 1))
        return self._with(rows_in_order.numbered(self.raw, self._sorted_by()).withColumn(name, F.col(rows_in_order.NUMBER) + start - 1).drop(rows_in_order.NUMBER))

    def prev(self, by: Sequence[str] = (), **shifted: tuple) -> Table:
        """``name=(expression, rows before, default)``; the last two may be left out. ``by`` keeps within equal keys."""
        full = {n: (x[0], x[1] if len(x) > 1 else 1, x[2] if len(x) > 2 else None) for n, x in ((n, x if isinstance(x, tuple) else (x,)) for n, x in shifted.items())}
        if by:
            w = Window.partitionBy(*by).orderBy(*self._keys())
            return self._with(self.raw.withColumns({n: (F.lag(x, k, d) if k >= 0 else F.lead(x, -k, d)).over(w) for n, (x, k, d) in full.items()}))
        return self._with(rows_in_order.neighbours(self.raw, self._sorted_by(), full))

    def next_(self, by: Sequence[str] = (), **shifted: tuple) -> Table:
        """Like ``prev``, rows after."""
        full = {n: x if isinstance(x, tuple) else (x,) for n, x in shifted.items()}
        return self.prev(by, **{n: (x[0], -(x[1] if len(x) > 1 else 1), *x[2:]) for n, x in full.items()})

    def row_cumsum(self, name: str, x: Column, by: Sequence[str] = ()) -> Table:
        """Running sum in the order; nulls are skipped."""
        if by:
            w = Window.partitionBy(*by).orderBy(*self._keys()).rowsBetween(Window.unboundedPreceding, 0)
            return self._with(self.raw.withColumn(name, F.coalesce(F.sum(x).over(w), F.lit(0))))
        return self._with(rows_in_order.running_sum(self.raw, self._sorted_by(), name, x))

    # ---- groups ----

    def summarize(self, *, by: Sequence[str] | dict[str, Column] | str = (), **aggregates: Column) -> Table:
        """Keys first, then aggregates. ``by``: names, or expressions by name. Struct results of ``arg_max`` and ``arg_min`` are spread."""
        by = [by] if isinstance(by, str) else by
        keys = [x.alias(k) for k, x in by.items()] if isinstance(by, dict) else [F.col(self._real(k)) for k in by]
        grouped = self.raw.groupBy(*keys)
        out = grouped.agg(*(x.alias(k) for k, x in self._typed(aggregates).items())) if aggregates else self.raw.select(*keys).distinct()
        rows = {f.name: f.dataType.fieldNames()[1:] for f in out.schema if f.dataType.typeName() == "struct" and f.dataType.fieldNames()[0] == ROW}
        spread = [c for k in out.columns for c in ([F.col(f"`{k}`.`{n}`") for n in rows[k]] if k in rows else [F.col(f"`{k}`")])]
        return self._new(out.select(*spread), self.name)

    # ---- several tables ----

    def join(self, other: Table, on: Sequence[str | tuple[str, str]] | str, kind: str = "innerunique", small: int | None = None) -> Table:
        """Equality join. ``on``: names, or (left, right) pairs; null keys meet null keys.

        Both key columns stay; a right column with a taken name gets 1, 2, … appended.
        ``small`` is a number of rows up to which the right side is broadcast after it was
        counted; without it Spark decides from the sizes that it knows.
        """
        pairs = [(p, p) if isinstance(p, str) else p for p in ([on] if isinstance(on, str) else on)]
        left, right = self.raw.select(*self.columns), other.raw.select(*other.columns)
        if kind in ("rightsemi", "rightanti"):
            return other.join(self, [(r, lf) for lf, r in pairs], "left" + kind[5:], small)
        keys = [(f"_l{k}", f"_r{k}") for k in range(len(pairs))]
        if kind == "innerunique":  # the first row of each key, by the order if there is one
            own = [F.col(self._real(a)) for a, _ in pairs]
            if self.order:
                w = Window.partitionBy(*own).orderBy(*self._keys())
                left = self.raw.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*self.columns)
            else:
                row = F.struct(*self.columns)
                ordered = not any("map<" in k or "variant" in k for _, k in left.dtypes)  # maps have no order: any row
                left = left.groupBy(*(x.alias(f"_g{k}") for k, x in enumerate(own))).agg((F.min(row) if ordered else F.any_value(row)).alias("_row")).select("_row.*")
        left = left.withColumns({k[0]: F.col(self._real(a)) for k, (a, _) in zip(keys, pairs, strict=True)})
        taken, renamed = {c.lower() for c in self.columns}, []
        for c in other.columns:
            new, n = c, 0
            while new.lower() in taken:
                n += 1
                new = f"{c}{n}"
            taken.add(new.lower())
            renamed.append(F.col(c).alias(new))
        right = right.select(*renamed, *(F.col(other._real(b)).alias(k[1]) for k, (_, b) in zip(keys, pairs, strict=True)))
        if small is not None and right.limit(small + 1).count() <= small:
            right = F.broadcast(right)
        test = None
        for a, b in keys:
            same = F.col(a).eqNullSafe(F.col(b))
            test = same if test is None else test & same
        how = {"inner": "inner", "innerunique": "inner", "leftouter": "left", "rightouter": "right", "fullouter": "full", "leftsemi": "left_semi", "semi": "left_semi", "leftanti": "left_anti", "anti": "left_anti"}
        if kind not in how:
            raise ValueError(f"no join kind {kind!r}")
        return self._new(left.join(right, test, how[kind]).drop(*(x for k in keys for x in k)), self.name)

    def union(self, *others: Table, kind: str = "outer", withsource: str | None = None) -> Table:
        """All rows of all tables, columns by name; ``kind="inner"`` keeps the common columns."""
        tables = (self, *others)
        frames = [t.raw.select(*([F.lit(t.name).alias(withsource)] if withsource else []), *t.columns) for t in tables]
        if kind == "inner":
            common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
            frames = [f.select(*common) for f in frames]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return self._new(out)

    # ---- values within values ----

    def mv_expand(self, **columns: Column) -> Table:
        """A row for each element; several columns go side by side, the shorter padded with nulls. Rows without elements go."""
        hidden = {f"_m{k}": x for k, x in enumerate(columns.values())}
        rows = self.raw.withColumns(hidden).withColumn("_z", F.explode(F.arrays_zip(*hidden)))
        own = {c.lower(): c for c in self.columns}
        return self._with(rows.withColumns({own.get(n.lower(), n): F.col(f"_z.{h}") for n, h in zip(columns, hidden, strict=True)}).drop("_z", *hidden))

    def parse(self, source: Column, *parts: str | Capture, regex: bool = False) -> Table:
        """Columns from the first match of literals, ``"*"`` and captures; rows without a match get nulls.

        Captures are lazy but for the last part; numbers match numeric text only.
        """
        kinds = {"long": r"[+-]?\d+", "int": r"[+-]?\d+", "real": r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"}
        pattern, captures = "", []
        for k, p in enumerate(parts):
            if isinstance(p, Capture):
                captures.append((p, re.compile(pattern).groups + 1))
                pattern += f"({kinds.get(p.kind, '.*' if k == len(parts) - 1 else '.*?')})"
            else:
                pattern += ".*?" if p == "*" else p if regex else re.sub(r"([\\^$.|?*+()\[\]{}\-&~#/])", r"\\\1", p)
        java = v.java_pattern(pattern.replace(r"\/", "/").replace(r"\&", "&").replace(r"\~", "~").replace(r"\#", "#"))
        s = v.text(source)
        read = {"long": v.whole, "int": v.whole, "real": v.real, "bool": v.flag, "datetime": v.moment}
        found = {c.name: F.when(s.rlike(java), F.regexp_extract(s, java, g)) for c, g in captures}
        return self.extend(**{c.name: read.get(c.kind, lambda x: x)(found[c.name]) for c, _ in captures})

    def render(self, chart: str, **properties: object) -> Table:
        """The rows with a note how to draw them."""
        return replace(self, view={"chart": chart, **properties})


def expand_json(x: Column) -> Column:
    """Elements of JSON text: of a list its values, of an object one-key objects, else the text itself."""
    s = F.trim(v.text(x))
    items = F.transform(F.from_json(s, "array<variant>"), lambda e: F.coalesce(e.try_cast("string"), F.to_json(e)))
    own = F.from_json(s, "map<string,variant>")
    bags = F.transform(F.json_object_keys(s), lambda k: F.to_json(F.map_filter(own, lambda name, _: name == k)))
    return F.when(s.startswith("["), items).when(s.startswith("{"), bags).when(s != "", F.array(s))


def chart_series(df: DataFrame, x: str, split: str, value: str, most: int = 12) -> DataFrame:
    """One column a series: the ``most`` largest by total (what a chart shows), one row an ``x``."""
    totals = df.groupBy(split).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), split).limit(most).collect()
    return df.groupBy(x).pivot(split, [r[split] for r in totals]).agg(F.sum(value)).orderBy(x)
