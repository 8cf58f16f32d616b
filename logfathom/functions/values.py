"""Value rules shared by all functions and operators: two-valued logic, conversions that never fail.

Comparisons are true or false, never null. In a filter a null already behaves as false, so
``where`` takes plain Spark predicates, which reach the Parquet scan; these helpers are for
output columns and for predicates under a negation.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = dt.timedelta(microseconds=1)
#: Patterns of timestamps that ``todatetime`` reads after ISO 8601; naive text is UTC.
PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z", "MM/dd/yyyy HH:mm:ss", "dd MMM yyyy HH:mm:ss")
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?$"
WORDS_TRUE, WORDS_FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off", "")


def col(x: object) -> Column:
    """A column as it is; a name or any other Python value as the column it names or the literal."""
    return x if isinstance(x, Column) else F.lit(x)


def typed(x: Column, *kinds: str) -> Column:
    """Whether the static type of ``x`` begins with one of ``kinds``; Catalyst folds it."""
    return F.lit(False) if not kinds else F.typeof(x).rlike("^(?:" + "|".join(kinds) + ")")


NUMBER = ("tinyint", "smallint", "int$", "bigint", "float", "double", "decimal")
NESTED = ("array", "map", "struct", "variant")


def json_text(x: Column) -> Column:
    """JSON of a value of any type; null for null."""
    return F.nullif(F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))


def text(x: object) -> Column:
    """A value as text; null is the empty text, whole reals have no fraction, lists and objects are JSON."""
    x = col(x)
    plain = x.cast("string")
    moment = F.date_format(plain.try_cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    real = F.regexp_replace(plain, r"\.0$", "")
    out = F.when(typed(x, "float", "double"), real).when(typed(x, "timestamp"), moment).when(typed(x, *NESTED), json_text(x))
    return F.coalesce(out.otherwise(plain), F.lit(""))


def is_number(kind: str | None) -> bool:
    """Whether a type, as ``simpleString`` names it, is numeric."""
    return kind is not None and kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")) and not kind.startswith("interval")


Build = Callable[[list[Column], list[str | None]], Column]


def by_type(args: list[Column], build: Build) -> Column:
    """An expression that depends on the types of ``args``: ``build(args, types)``.

    The result is the one for unknown types; the methods of ``Table``, which knows its
    columns, take ``specialised`` of it instead, without conversions by way of text.
    """
    out = build(args, [None] * len(args))
    out._by_type = (args, build)
    return out


def specialised(expressions: list[Column], df: DataFrame) -> list[Column]:
    """Those made by ``by_type``, built for the types that their arguments have in ``df``; the others as they are."""
    made = [(k, vars(x)["_by_type"]) for k, x in enumerate(expressions) if "_by_type" in vars(x)]  # a column has any other attribute as a field
    asked = [(k, specialised(args, df), build) for k, (args, build) in made]
    if not asked:
        return expressions
    kinds = iter([f.dataType.simpleString() for f in df.select(*(a.alias(f"_{k}_{i}") for k, args, _ in asked for i, a in enumerate(args))).schema])
    out = list(expressions)
    for k, args, build in asked:
        out[k] = build(args, [next(kinds) for _ in args])
    return out


def real(x: object, kind: str | None = None) -> Column:
    """A value as double, null where it is none; times are no numbers."""
    x = col(x)
    if is_number(kind):
        return x.cast("double")
    return F.when(~typed(x, "timestamp", "date", *NESTED), F.when(typed(x, "boolean"), F.when(x.cast("string") == "true", 1.0).otherwise(F.when(x.isNotNull(), 0.0))).otherwise(F.trim(x.cast("string")).try_cast("double")))


def finite(x: object, kind: str | None = None) -> Column:
    """A value as double, null unless finite."""
    r = real(x, kind)
    if is_number(kind) and kind not in ("float", "double"):
        return r
    return F.when(~F.isnan(r) & (F.abs(r) != float("inf")), r)


def whole(x: object) -> Column:
    """A value as long: text may be an integer, 0x or 0b digits, or a real to be cut off; a time is its microseconds."""
    x = col(x)
    s = F.trim(x.cast("string"))
    digits = lambda prefix, base: F.conv(F.regexp_extract(F.lower(s), rf"^[+-]?{prefix}([0-9a-f]+)$", 1), base, 10).try_cast("bigint")
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    based = F.when(s.rlike("^[+-]?0[xX][0-9a-fA-F]+$"), sign * digits("0x", 16)).when(s.rlike("^[+-]?0[bB][01]+$"), sign * digits("0b", 2))
    number = F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))
    moment = F.unix_micros(x.cast("string").try_cast("timestamp"))
    flag = F.when(s == "true", F.lit(1)).when(s == "false", F.lit(0)).cast("bigint")
    return F.when(typed(x, "timestamp"), moment).when(typed(x, "boolean"), flag).when(typed(x, *NESTED), F.lit(None)).otherwise(F.coalesce(based, number))


def flag(x: object) -> Column:
    """A value as boolean, null where it is none."""
    x = col(x)
    s = F.lower(F.trim(x.cast("string")))
    number = real(x)
    worded = F.when(s.isin(*WORDS_TRUE), True).when(s.isin(*WORDS_FALSE), False)
    return F.when(typed(x, "boolean"), s == "true").when(typed(x, *NUMBER), number != 0).otherwise(worded)


def moment(x: object) -> Column:
    """A value as timestamp: a number is epoch microseconds, text is ISO first, then ``PATTERNS``."""
    x = col(x)
    s = F.trim(x.cast("string"))
    iso = F.when(s.rlike(ISO), F.regexp_replace(F.regexp_replace(s, r"(\d),(\d)", "$1.$2"), r"\s+([Z+-])", "$1").try_cast("timestamp"))
    read = F.coalesce(iso, *(F.try_to_timestamp(s, F.lit(p)) for p in PATTERNS))
    return F.when(typed(x, *NUMBER), F.timestamp_micros(F.coalesce(real(x).try_cast("bigint"), F.lit(None)))).otherwise(read)


SPAN = re.compile(r"(\d+(?:\.\d+)?)(microseconds?|ticks?|ms|[dhms])")
UNITS = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "microsecond": 1, "tick": 0.1}


def span(x: str | dt.timedelta) -> dt.timedelta:
    """A literal such as ``5m`` or ``1.5h`` as timedelta."""
    if isinstance(x, dt.timedelta):
        return x
    m = SPAN.fullmatch(x.strip().lower())
    if not m:
        raise ValueError(f"not a timespan: {x!r}")
    return dt.timedelta(microseconds=round(float(m[1]) * UNITS[m[2].rstrip("s") if len(m[2]) > 2 else m[2]]))


def micros(interval: Column) -> Column:
    """Microseconds of an interval."""
    return F.unix_micros(F.timestamp_micros(F.lit(0).cast("bigint")) + interval)


def interval(us: Column) -> Column:
    """The interval of so many microseconds."""
    return F.timestamp_micros(us) - F.timestamp_micros(F.lit(0).cast("bigint"))


def truthy(x: object, kind: str | None = None) -> Column:
    """Null, zero, empty text and empty lists are false, everything else is true."""
    x = col(x)
    if kind == "boolean" or is_number(kind):
        return F.coalesce(x if kind == "boolean" else x != 0, F.lit(False))
    s = x.cast("string")
    empty = F.when(typed(x, "boolean"), s != "true").when(typed(x, *NUMBER), s.try_cast("double") == 0).when(typed(x, "array", "map"), json_text(x).isin("[]", "{}"))
    return F.coalesce(~empty.otherwise(s == ""), F.lit(False))


def yes(p: Column) -> Column:
    """A predicate as true or false."""
    return F.coalesce(p, F.lit(False))


def _kind(x: Column) -> Column:
    """What a value can be compared with: numbers with numbers, times with times, all else with its own type; Catalyst folds it."""
    return F.when(typed(x, *NUMBER), "number").when(typed(x, "timestamp", "date"), "time").otherwise(F.typeof(x))


def alike(a: object, b: object) -> Column:
    """Whether two values are of one kind; it is known from the types, so a comparison of unlike ones is never evaluated."""
    return _kind(col(a)) == _kind(col(b))


def eq(a: object, b: object) -> Column:
    """False where either side is null, and for values of unlike kinds: text is no number."""
    return yes(F.when(alike(a, b), col(a) == col(b)))


def ne(a: object, b: object) -> Column:
    """False where either side is null; true for values of unlike kinds."""
    return yes(F.when(alike(a, b), col(a) != col(b)).otherwise(col(a).isNotNull() & col(b).isNotNull()))


def lt(a: object, b: object) -> Column:
    """False where either side is null or the kinds are unlike, as are ``le``, ``gt`` and ``ge``."""
    return yes(F.when(alike(a, b), col(a) < col(b)))


def le(a: object, b: object) -> Column:
    return yes(F.when(alike(a, b), col(a) <= col(b)))


def gt(a: object, b: object) -> Column:
    return lt(b, a)


def ge(a: object, b: object) -> Column:
    return le(b, a)


def eq_fold(a: object, b: object) -> Column:
    return yes(F.lower(text(a)) == F.lower(text(b))) & col(a).isNotNull() & col(b).isNotNull()


def ne_fold(a: object, b: object) -> Column:
    return yes(F.lower(text(a)) != F.lower(text(b))) & col(a).isNotNull() & col(b).isNotNull()


def is_in(x: object, *items: object, fold: bool = False) -> Column:
    """Membership; a null is never a member."""
    if fold:
        return yes(F.lower(text(x)).isin(*(str(i).lower() for i in items))) & col(x).isNotNull()
    groups: dict[object, list] = {}
    for i in items:
        kind = "number" if isinstance(i, (int, float, decimal.Decimal)) and not isinstance(i, bool) else "time" if isinstance(i, dt.date) else type(i)
        if i is not None:
            groups.setdefault(kind, []).append(i)

    def among(x: Column, kind: object, own: list) -> Column:
        """By way of text, since no type may be compared with an unlike one, not even in a branch that is never taken."""
        plain = x.cast("string")
        if kind == "time":
            return plain.try_cast("timestamp").isin(*(F.lit(i).cast("timestamp") for i in own))
        if kind == "number":
            exact = [decimal.Decimal(str(i)) for i in own if decimal.Decimal(str(i)).is_finite() and abs(i) < 10**27]
            return F.when(typed(x, "float", "double"), plain.try_cast("double").isin(*map(float, own))).otherwise(plain.try_cast("decimal(38,10)").isin(*exact) if exact else F.lit(False))
        return plain.isin(*(str(i).lower() if isinstance(i, bool) else i for i in own))

    def build(args: list[Column], kinds: list[str | None]) -> Column:
        x, out = args[0], F.lit(False)
        for kind, own in groups.items():  # items of another kind than the value are never equal to it
            if kinds[0] is None:
                out |= F.when(alike(x, own[0]), among(x, kind, own)).otherwise(False)
            elif is_number(kinds[0]) == (kind == "number") and (kinds[0] in ("timestamp", "date")) == (kind == "time") and (kinds[0] == "string") == (kind is str) and (kinds[0] == "boolean") == (kind is bool):
                out |= x.isin(*own)
        return yes(out)

    return by_type([col(x)], build)


def not_in(x: object, *items: object, fold: bool = False) -> Column:
    """The negation of ``is_in``: a null is outside."""
    return ~is_in(x, *items, fold=fold)


def between(x: object, low: object, high: object) -> Column:
    """False for a null, and for ends of another kind."""
    return yes(F.when(alike(x, low) & alike(x, high), col(x).between(col(low), col(high))))


def not_between(x: object, low: object, high: object) -> Column:
    """False for a null, unlike a plain negation; true for ends of another kind."""
    return yes(F.when(alike(x, low) & alike(x, high), ~col(x).between(col(low), col(high))).otherwise(col(x).isNotNull()))


def terms(needle: str) -> list[str]:
    """The maximal runs of ASCII letters and digits."""
    return re.findall(r"[0-9A-Za-z]+", needle)


def term_pattern(needle: str, fold: bool = True) -> str | None:
    """A pattern that finds the needle's terms one after another; None if it has none."""
    if not (found := terms(needle)):
        return None
    return ("(?i)" if fold else "") + r"(?:^|[^0-9A-Za-z])" + r"[^0-9A-Za-z]+".join(found) + r"(?:$|[^0-9A-Za-z])"


def has(x: object, needle: str, fold: bool = True) -> Column:
    """Whole-term search."""
    p = term_pattern(needle, fold)
    return F.lit(False) if p is None else yes(text(x).rlike(p)) & col(x).isNotNull()


def has_any(x: object, *needles: str) -> Column:
    found = [p for n in needles if (p := term_pattern(n))]
    return yes(text(x).rlike("|".join(f"(?:{p})" for p in found))) if found else F.lit(False)


def has_all(x: object, *needles: str) -> Column:
    out = F.lit(bool(needles))
    for n in needles:
        p = term_pattern(n)
        out &= text(x).rlike(p) if p else F.lit(False)
    return yes(out)


def hasprefix(x: object, needle: str, fold: bool = True) -> Column:
    return yes(text(x).rlike(("(?i)" if fold else "") + f"(?:^|[^0-9A-Za-z]){needle}")) if re.fullmatch(r"[0-9A-Za-z]+", needle) else F.lit(False)


def hassuffix(x: object, needle: str, fold: bool = True) -> Column:
    return yes(text(x).rlike(("(?i)" if fold else "") + f"{needle}(?:$|[^0-9A-Za-z])")) if re.fullmatch(r"[0-9A-Za-z]+", needle) else F.lit(False)


def contains(x: object, needle: object, fold: bool = True) -> Column:
    low = F.lower if fold else (lambda c: c)
    return yes(F.contains(low(text(x)), low(text(needle)))) & col(x).isNotNull()


def startswith(x: object, needle: object, fold: bool = True) -> Column:
    low = F.lower if fold else (lambda c: c)
    return yes(F.startswith(low(text(x)), low(text(needle)))) & col(x).isNotNull()


def endswith(x: object, needle: object, fold: bool = True) -> Column:
    low = F.lower if fold else (lambda c: c)
    return yes(F.endswith(low(text(x)), low(text(needle)))) & col(x).isNotNull()


MAX_PATTERN = 2000


def java_pattern(pattern: str) -> str:
    """A Python pattern as Java reads it, with Unicode classes; ValueError if it is invalid or too long."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError("the pattern is too long")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from None
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\\k<{m[1].replace('_', '')}>", out)
    return "(?U)" + out.replace(r"\Z", r"\z")


def matches(x: object, pattern: str) -> Column:
    """Unanchored search with a regular expression."""
    return yes(text(x).rlike(java_pattern(pattern))) & col(x).isNotNull()


def add(a: object, b: object) -> Column:
    """Sum, null on overflow; where either side is text, a Python string or a column, the text of both.

    In a method of ``Table`` the types decide, and values that have no sum, such as a list and a
    number, give null; elsewhere two text columns need ``strcat``.
    """
    if isinstance(a, str) or isinstance(b, str):
        return F.concat(text(a), text(b))

    def build(args: list[Column], kinds: list[str | None]) -> Column:
        if "string" in kinds:
            return F.concat(*map(text, args))
        summed = all(k is None or k in ("timestamp", "date", "void") or k.startswith("interval") or is_number(k) for k in kinds)
        moments = [k for k in kinds if k in ("timestamp", "date")]
        return F.try_add(*args) if summed and (not moments or any((k or "interval").startswith("interval") for k in kinds)) else F.lit(None).cast("string")

    return by_type([col(a), col(b)], build)


def sub(a: object, b: object) -> Column:
    return F.try_subtract(col(a), col(b))


def mul(a: object, b: object) -> Column:
    return F.try_multiply(col(a), col(b))


def div(a: object, b: object) -> Column:
    """Quotient as a double: longs floor, division by zero is null. ``idiv`` has all 64 bits of a long."""
    a, b = col(a), col(b)
    integers = typed(a, "tinyint", "smallint", "int$", "bigint") & typed(b, "tinyint", "smallint", "int$", "bigint")
    q = F.try_divide(a.cast("double"), b.cast("double"))
    x, y = a.try_cast("bigint"), F.nullif(b.try_cast("bigint"), F.lit(0).cast("bigint"))
    floor = F.when(y == -1, F.try_multiply(x, F.lit(-1).cast("bigint"))).otherwise((x - F.pmod(F.pmod(x, y) + y, y)).try_cast("bigint") / y)
    return F.when(integers, F.floor(floor).cast("double")).otherwise(q)


def idiv(a: object, b: object) -> Column:
    """Floor quotient of two longs as a long; null for a zero divisor."""
    a, b = col(a).try_cast("bigint"), F.nullif(col(b).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", a - mod(a, b), b)


def mod(a: object, b: object) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    a, b = col(a), col(b)
    b = F.nullif(b, F.lit(0))
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)
