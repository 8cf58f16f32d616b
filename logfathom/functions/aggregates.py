"""The aggregate functions, by name (``AGGREGATES``); use them in ``Table.summarize``.

All are Spark's own aggregates, so they combine on the map side. Sums and averages skip
nulls, NaN and infinities; an empty sum is 0, an empty average null. What depends on row
order takes ``order``, a column to order by; without it any order may result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import by_type, col, finite, is_number, truthy

AGGREGATES: dict[str, Callable[..., Column]] = {}
#: Items that lists, sets and bags hold unless a limit is given, and at most.
LIST_LIMIT, MOST = 1024, 100_000
#: First field of the rows of ``arg_max`` and ``arg_min``: ``summarize`` spreads these, unlike other structs.
ROW = "_row_"


def aggregate(*names: str):
    def keep(f):
        AGGREGATES.update(dict.fromkeys(names, f))
        return f

    return keep


def _if(condition: object, x: object, kind: str | None = None) -> Column:
    return F.when(truthy(condition, kind), col(x))


def _numbers(x: Column, kind: str | None = None) -> Column:
    """The finite values of ``x`` in its own type."""
    return x if is_number(kind) and kind not in ("float", "double") else F.when(finite(x, kind).isNotNull(), x)


def _numeric(pick: Callable[[Column, str | None], Column], x: object) -> Column:
    """An aggregate of a column, by its type."""
    return by_type([col(x)], lambda args, kinds: pick(args[0], kinds[0]))


def _numeric_if(pick: Callable[[Column, str | None], Column], x: object, condition: object) -> Column:
    """The same of those rows for which the condition holds."""
    return by_type([col(x), col(condition)], lambda args, kinds: pick(_if(args[1], args[0], kinds[1]), kinds[0]))


def _sum(x: Column, kind: str | None) -> Column:
    return F.coalesce(F.sum(_numbers(x, kind)), F.lit(0))


def _avg(x: Column, kind: str | None) -> Column:
    return F.avg(finite(x, kind))


@aggregate("count")
def count() -> Column:
    return F.count(F.lit(1))


@aggregate("countif")
def countif(condition: object) -> Column:
    return by_type([col(condition)], lambda args, kinds: F.count_if(truthy(args[0], kinds[0])))


@aggregate("dcount", "count_distinct")
def dcount(x: object, *_: object) -> Column:
    """Exact; nulls do not count. See ``dcount_approx`` for very many distinct values."""
    return F.count_distinct(col(x))


@aggregate("dcountif")
def dcountif(x: object, condition: object) -> Column:
    return _numeric_if(lambda v, _: F.count_distinct(v), x, condition)


@aggregate("dcount_approx")
def dcount_approx(x: object, error: float = 0.01) -> Column:
    """HyperLogLog++; constant memory."""
    return F.approx_count_distinct(col(x), error)


@aggregate("sum")
def sum_(x: object) -> Column:
    return _numeric(_sum, x)


@aggregate("sumif")
def sumif(x: object, condition: object) -> Column:
    return _numeric_if(_sum, x, condition)


@aggregate("avg", "average")
def avg(x: object) -> Column:
    return _numeric(_avg, x)


@aggregate("avgif")
def avgif(x: object, condition: object) -> Column:
    return _numeric_if(_avg, x, condition)


@aggregate("min")
def min_(x: object) -> Column:
    return F.min(col(x))


@aggregate("max")
def max_(x: object) -> Column:
    return F.max(col(x))


@aggregate("minif")
def minif(x: object, condition: object) -> Column:
    return _numeric_if(lambda v, _: F.min(v), x, condition)


@aggregate("maxif")
def maxif(x: object, condition: object) -> Column:
    return _numeric_if(lambda v, _: F.max(v), x, condition)


@aggregate("any", "take_any")
def any_(x: object, order: Column | None = None) -> Column:
    """Some value that is not null: the first by ``order``."""
    x = col(x)
    return F.any_value(x, ignoreNulls=F.lit(True)) if order is None else F.min_by(x, F.when(x.isNotNull(), order))


@aggregate("anyif")
def anyif(x: object, condition: object, order: Column | None = None) -> Column:
    return any_(_if(condition, x), order)


def _limit(n: int | None) -> int:
    return min(n or LIST_LIMIT, MOST)


def _ordered(x: Column, order: Column | None) -> Column:
    if order is None:
        return F.collect_list(x)
    return F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x"))))), lambda s: s["x"])


@aggregate("make_list")
def make_list(x: object, limit: int | None = None, order: Column | None = None) -> Column:
    """Values that are not null, up to ``limit`` (a feature of the function)."""
    return F.slice(_ordered(col(x), order), 1, _limit(limit))


@aggregate("make_list_if")
def make_list_if(x: object, condition: object, limit: int | None = None, order: Column | None = None) -> Column:
    return make_list(_if(condition, x), limit, order)


@aggregate("make_set")
def make_set(x: object, limit: int | None = None, order: Column | None = None) -> Column:
    """Distinct values, first seen first; sorted without ``order``, and then combined before the shuffle."""
    found = F.sort_array(F.collect_set(col(x))) if order is None else F.array_distinct(_ordered(col(x), order))
    return F.slice(found, 1, _limit(limit))


@aggregate("make_set_if")
def make_set_if(x: object, condition: object, limit: int | None = None, order: Column | None = None) -> Column:
    return make_set(_if(condition, x), limit, order)


@aggregate("make_bag")
def make_bag(bag: Column, limit: int | None = None, order: Column | None = None) -> Column:
    """One map of all maps of a group, up to ``limit`` keys, in the order of their last values; the last value of a key wins."""
    entries = F.transform(F.flatten(_ordered(F.map_entries(bag), order)), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value")))
    # from the last entry to the first, the first of each key: by its place among the keys, in one pass of a sort
    back = F.reverse(entries)
    placed = F.transform(back, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value")))
    sorted_ = F.array_sort(placed)
    before = F.concat(F.array(F.lit(None)), sorted_)
    heads = F.zip_with(sorted_, before, lambda e, b: F.when(e.isNotNull() & (b.isNull() | (b["key"] != e["key"])), F.struct(e["i"].alias("i"), e["key"].alias("key"), e["value"].alias("value"))))
    heads = F.filter(heads, lambda e: e.isNotNull())
    last = F.transform(F.reverse(F.array_sort(heads)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.slice(last, 1, _limit(limit)))


def _rank(x: str, p: float) -> Column:
    value = f"if(isnan(cast({x} as double)) or abs(cast({x} as double)) = double('infinity'), null, {x})"
    return F.expr(f"percentile_disc({min(max(p, 0), 100) / 100}) within group (order by {value})")


@aggregate("percentile")
def percentile(x: str, p: float) -> Column:
    """Nearest rank of the named numeric column; exact."""
    return _rank(x, p)


@aggregate("percentiles")
def percentiles(x: str, *ps: float) -> Column:
    return F.array(*(_rank(x, p) for p in ps))


@aggregate("stdev")
def stdev(x: object) -> Column:
    """Of the sample; null below two values."""
    return _numeric(lambda v, kind: F.stddev_samp(finite(v, kind)), x)


@aggregate("variance")
def variance(x: object) -> Column:
    return _numeric(lambda v, kind: F.var_samp(finite(v, kind)), x)


def _arg(pick, key: Column, columns: tuple[Column, ...], order: Column | None) -> Column:
    by = key if order is None else F.when(key.isNotNull(), F.struct(key.alias("k"), order.alias("o")))
    return pick(F.struct(F.lit(True).alias(ROW), *columns), by)


@aggregate("arg_max")
def arg_max(key: object, *columns: Column, order: Column | None = None) -> Column:
    """The columns, as a struct, of the row with the largest key; of tied rows the largest ``order``."""
    return _arg(F.max_by, col(key), columns, order)


@aggregate("arg_min")
def arg_min(key: object, *columns: Column, order: Column | None = None) -> Column:
    """The columns, as a struct, of the row with the smallest key; of tied rows the smallest ``order``."""
    return _arg(F.min_by, col(key), columns, order)


