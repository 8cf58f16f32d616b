"""The scalar functions, by name, each a builder of one Spark column expression.

``fn.strcat(...)`` and ``SCALARS["strcat"](...)`` are the same. Arguments are columns or
Python values (literals). Failed conversions give null; nothing throws at run time.
Patterns, units, delimiters and steps are Python values, known when the plan is made.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from . import values as v
from .values import col, real, text, whole

SCALARS: dict[str, Callable[..., Column]] = {}


def scalar(*names: str):
    def keep(f):
        SCALARS.update(dict.fromkeys(names, f))
        return f

    return keep


class _Names:
    """The registered functions as attributes."""

    def __getattr__(self, name: str) -> Callable[..., Column]:
        try:
            return SCALARS[name]
        except KeyError:
            raise AttributeError(f"no function {name!r}") from None

    def __dir__(self) -> list[str]:
        return sorted(SCALARS)


fn = _Names()

# ---- text -------------------------------------------------------------------


@scalar("strcat")
def strcat(*parts: object) -> Column:
    return F.concat(*map(text, parts))


@scalar("strcat_delim")
def strcat_delim(delimiter: object, *parts: object) -> Column:
    return F.concat_ws(delimiter, *map(text, parts)) if isinstance(delimiter, str) else F.array_join(F.array(*map(text, parts)), delimiter)


@scalar("strlen")
def strlen(s: object) -> Column:
    return F.when(col(s).isNotNull(), F.length(text(s)).cast("long"))


@scalar("string_size")
def string_size(s: object) -> Column:
    return F.when(col(s).isNotNull(), F.octet_length(text(s)).cast("long"))


@scalar("substring")
def substring(s: object, start: object, length: object = None) -> Column:
    """From a 0-based start; a negative one counts from the end."""
    s, at = text(s), whole(start)
    at = F.when(at < 0, F.greatest(F.length(s) + at, F.lit(0))).otherwise(at)
    n = F.greatest(whole(length), F.lit(0)) if length is not None else F.length(s)
    return F.substr(s, (at + 1).cast("int"), n.cast("int"))


@scalar("toupper")
def toupper(s: object) -> Column:
    return F.upper(text(s))


@scalar("tolower")
def tolower(s: object) -> Column:
    return F.lower(text(s))


@scalar("trim")
def trim(pattern: str, s: object = None) -> Column:
    """Cut one match of a pattern off both ends; white space if only the text is given."""
    if s is None:
        return F.regexp_replace(text(pattern), r"(?U)^\s+|\s+$", "")
    return trim_end(pattern, trim_start(pattern, s))


@scalar("trim_start")
def trim_start(pattern: str, s: object) -> Column:
    return F.regexp_replace(text(s), f"^(?:{v.java_pattern(pattern)})", "")


@scalar("trim_end")
def trim_end(pattern: str, s: object) -> Column:
    return F.regexp_replace(text(s), rf"(?:{v.java_pattern(pattern)})\z", "")


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


@scalar("split")
def split(s: object, delimiter: str, index: int | None = None) -> Column:
    parts = F.split(text(s), _quoted(delimiter), -1)
    return parts if index is None else F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


@scalar("strrep")
def strrep(s: object, count: int, delimiter: str = "") -> Column:
    n = min(max(int(count), 0), 10_000)
    return F.array_join(F.array_repeat(text(s), n), delimiter)


@scalar("replace_string")
def replace_string(s: object, find: object, to: object) -> Column:
    return F.replace(text(s), text(find), text(to))


@scalar("replace_regex")
def replace_regex(s: object, pattern: str, to: str) -> Column:
    """``\\1`` in the replacement is the first group; an invalid pattern changes nothing."""
    import re

    try:
        p = v.java_pattern(pattern)
    except ValueError:
        return text(s)
    out = re.sub(r"\\(\d)", r"$\1", to.replace("$", r"\$"))
    return F.regexp_replace(text(s), p, out)


@scalar("indexof")
def indexof(s: object, find: object, start: int = 0, *_: object) -> Column:
    """0-based place of a text, -1 if absent."""
    s = text(s)
    at = F.lit(start + 1) if start >= 0 else F.greatest(F.length(s) + start, F.lit(0)) + 1
    return (F.call_function("locate", text(find), s, at.cast("int")) - 1).cast("long")


@scalar("countof")
def countof(s: object, find: str, kind: str = "normal") -> Column:
    if kind == "regex":
        return F.regexp_count(text(s), F.lit(v.java_pattern(find))).cast("long")
    return F.lit(0).cast("long") if not find else ((F.length(text(s)) - F.length(F.replace(text(s), F.lit(find), F.lit("")))) / len(find)).cast("long")


@scalar("extract")
def extract(pattern: str, group: int, s: object, *_: object) -> Column:
    """A group of the first match, null without one."""
    p = v.java_pattern(pattern)
    return F.when(text(s).rlike(p), F.regexp_extract(text(s), p, group))


@scalar("extract_all")
def extract_all(pattern: str, s: object, third: object = None) -> Column:
    """All matches: whole ones without groups, the group if there is one, else lists of groups."""
    import re

    s = text(s if third is None else third)
    p, groups = v.java_pattern(pattern), re.compile(pattern).groups
    if groups <= 1:
        return F.regexp_extract_all(s, F.lit(p), F.lit(groups))
    return F.arrays_zip(*(F.regexp_extract_all(s, F.lit(p), F.lit(g)).alias(str(g)) for g in range(1, groups + 1)))


@scalar("reverse")
def reverse(x: object) -> Column:
    return F.reverse(col(x))


@scalar("strcmp")
def strcmp(a: object, b: object) -> Column:
    return F.when(text(a) > text(b), 1).when(text(a) < text(b), -1).otherwise(0).cast("long")


@scalar("url_decode")
def url_decode(s: object) -> Column:
    """Plus signs stay; malformed text is returned unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(text(s), F.lit("+"), F.lit("%2B"))), text(s))


@scalar("url_encode")
def url_encode(s: object) -> Column:
    out = F.url_encode(text(s))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@scalar("base64_encode_tostring")
def base64_encode_tostring(s: object) -> Column:
    return F.replace(F.base64(F.encode(text(s), "UTF-8")), F.lit("\r\n"), F.lit(""))


@scalar("base64_decode_tostring")
def base64_decode_tostring(s: object) -> Column:
    """UTF-8 if valid, else UTF-16, null if it is no base64."""
    s = F.regexp_replace(text(s), r"\s", "")
    bare = F.regexp_replace(s, "=+$", "")
    full = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    raw = F.when(bare.rlike("^[A-Za-z0-9+/]*$") & (F.length(bare) % 4 != 1), F.unbase64(full))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.when(F.octet_length(raw) % 2 == 0, F.decode(raw, "UTF-16LE")))


@scalar("parse_url")
def parse_url(url: object) -> Column:
    """Scheme, Host, Port, Path, Username, Password, Query Parameters and Fragment."""
    u = text(url)
    part = lambda p, g=1: F.regexp_extract(u, p, g)
    authority = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    return F.struct(
        part(r"^([A-Za-z][A-Za-z0-9+.-]*):").alias("Scheme"),
        F.lower(part(authority + r"(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)")).alias("Host"),
        part(authority + r"(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)").alias("Port"),
        part(authority + r"[^/?#]*(/[^?#]*)").alias("Path"),
        part(authority + r"([^/?#@:]*)(?::[^/?#@]*)?@").alias("Username"),
        part(authority + r"[^/?#@:]*:([^/?#@]*)@").alias("Password"),
        _query_map(part(r"\?([^#]*)")).alias("Query Parameters"),
        part(r"#(.*)$").alias("Fragment"),
    )


def _query_map(q: Column) -> Column:
    pairs = F.filter(F.split(q, "&"), lambda p: F.contains(p, F.lit("=")))
    split_at = lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v"))
    own = F.filter(F.transform(pairs, split_at), lambda e: e["k"].isNotNull())
    last = F.filter(own, lambda e, i: ~F.exists(F.slice(own, i + 2, F.greatest(F.size(own), F.lit(1))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


@scalar("parse_urlquery")
def parse_urlquery(query: object) -> Column:
    return F.struct(_query_map(F.regexp_replace(text(query), r"^.*\?", "")).alias("Query Parameters"))


@scalar("parse_path")
def parse_path(path: object) -> Column:
    p = text(path)
    name = F.regexp_extract(p, r"([^/\\]*)$", 1)
    folder = F.regexp_extract(p, r"^(.*)[/\\][^/\\]*$", 1)
    return F.struct(
        F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9+.-]+)://", 1).alias("Scheme"), F.regexp_extract(p, r"^([A-Za-z]:|/)", 1).alias("RootPath"), folder.alias("DirectoryPath"),
        F.regexp_extract(folder, r"([^/\\]*)$", 1).alias("DirectoryName"), F.regexp_replace(name, ":.*$", "").alias("Filename"),
        F.regexp_extract(F.regexp_replace(name, ":.*$", ""), r"[^.]\.([^.]+)$", 1).alias("Extension"), F.regexp_extract(name, ":(.*)$", 1).alias("AlternateDataStreamName"),
    )


@scalar("basename")
def basename(path: object) -> Column:
    return F.substring_index(F.regexp_replace(text(path), "/+$", ""), "/", -1)


@scalar("dirname")
def dirname(path: object) -> Column:
    p = F.regexp_replace(text(path), "/+$", "")
    found = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(F.contains(p, F.lit("/")), F.when(found == "", "/").otherwise(found)).otherwise(F.lit("/"))


@scalar("entropy")
def entropy(s: object) -> Column:
    """Shannon entropy in bits a character."""
    s = text(s)
    n = F.length(s).cast("double")
    shares = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)))


# ---- numbers ----------------------------------------------------------------


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


for _name, _f in {"abs": F.abs, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "exp10": lambda x: F.pow(F.lit(10.0), x)}.items():
    SCALARS[_name] = lambda x, f=_f: _finite(f(real(x)))
for _name, _f in {"log": F.ln, "log2": F.log2, "log10": F.log10}.items():
    SCALARS[_name] = lambda x, f=_f: F.when(real(x) > 0, _finite(f(real(x))))
SCALARS["sqrt"] = lambda x: F.when(real(x) >= 0, F.sqrt(real(x)))
SCALARS["ceiling"] = lambda x: F.ceil(real(x)).cast("long")
SCALARS["sign"] = lambda x: F.signum(real(x)).try_cast("long")
SCALARS["pow"] = lambda a, b: _finite(F.pow(real(a), real(b)))


@scalar("floor")
def floor(x: object, step: object = None) -> Column:
    return F.floor(real(x)).cast("long") if step is None else bin_(x, step)


@scalar("round")
def round_(x: object, digits: int = 0) -> Column:
    """Half to even; a long without digits."""
    out = F.bround(real(x), digits)
    return out.try_cast("long") if digits <= 0 else out


def _steps(us: Column, step: dt.timedelta, at: Column | None = None) -> Column:
    n = F.lit(step // v.MICRO).cast("long")
    at = F.lit(0).cast("long") if at is None else at
    return us - F.pmod(us - at, n) if step else F.lit(None).cast("long")


@scalar("bin")
def bin_(x: object, step: object) -> Column:
    """The largest multiple of a step that is not above ``x``: a timestamp with a timespan step (``"1h"``), or a number."""
    if isinstance(step, (str, dt.timedelta)):
        return F.timestamp_micros(_steps(F.unix_micros(col(x).cast("timestamp")), v.span(step)))
    x = col(x)
    if isinstance(step, int) and not isinstance(step, bool):
        if step == 0:
            return F.lit(None).cast("double")
        return F.when(v.typed(x, "float", "double", "decimal", "string"), F.floor(real(x) / step) * float(step)).otherwise(x - v.mod(x, F.lit(step)))
    return F.floor(F.try_divide(real(x), real(step))) * real(step)


@scalar("bin_span")
def bin_span(x: Column, step: str | dt.timedelta) -> Column:
    """``bin`` of an interval."""
    return v.interval(_steps(v.micros(x), v.span(step)))


@scalar("bin_at")
def bin_at(x: object, step: object, at: object) -> Column:
    if isinstance(step, (str, dt.timedelta)):
        return F.timestamp_micros(_steps(F.unix_micros(col(x).cast("timestamp")), v.span(step), F.unix_micros(col(at).cast("timestamp"))))
    return F.floor(F.try_divide(real(x) - real(at), real(step))) * real(step) + real(at)


@scalar("rand")
def rand(n: int | None = None) -> Column:
    return F.rand() if not n else F.floor(F.rand() * n)


@scalar("max_of")
def max_of(*xs: object) -> Column:
    return F.greatest(*map(col, xs)) if len(xs) > 1 else col(xs[0])


@scalar("min_of")
def min_of(*xs: object) -> Column:
    return F.least(*map(col, xs)) if len(xs) > 1 else col(xs[0])


SCALARS["isnan"] = lambda x: v.yes(F.isnan(real(x)))
SCALARS["isinf"] = lambda x: v.yes(F.abs(real(x)) == float("inf"))
SCALARS["isfinite"] = lambda x: v.finite(x).isNotNull()
SCALARS["binary_and"] = lambda a, b: whole(a).bitwiseAND(whole(b))
SCALARS["binary_or"] = lambda a, b: whole(a).bitwiseOR(whole(b))
SCALARS["binary_xor"] = lambda a, b: whole(a).bitwiseXOR(whole(b))
SCALARS["binary_not"] = lambda a: F.bitwise_not(whole(a))
SCALARS["binary_shift_left"] = lambda a, n: F.call_function("shiftleft", whole(a), F.least(F.greatest(whole(n), F.lit(0)), F.lit(63)).cast("int"))
SCALARS["binary_shift_right"] = lambda a, n: F.call_function("shiftright", whole(a), F.least(F.greatest(whole(n), F.lit(0)), F.lit(63)).cast("int"))
SCALARS["bitset_count_ones"] = lambda a: F.bit_count(F.abs(whole(a))).cast("long")


@scalar("tohex")
def tohex(x: object, width: int = 0) -> Column:
    n = whole(x)
    digits = F.lower(F.hex(F.abs(n)))
    digits = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.when(n < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


# ---- times ------------------------------------------------------------------

_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond")


def _stamp(x: object) -> Column:
    return col(x).cast("timestamp")


@scalar("now")
def now(offset: str | dt.timedelta | None = None) -> Column:
    return F.current_timestamp() if offset is None else F.current_timestamp() + F.lit(v.span(offset))


@scalar("ago")
def ago(back: str | dt.timedelta) -> Column:
    return F.current_timestamp() - F.lit(v.span(back))


@scalar("datetime_add")
def datetime_add(part: str, amount: object, moment: object) -> Column:
    """Months and longer units stop at the end of the month; an unknown unit gives null."""
    part = part.lower()
    return F.timestamp_add(part.upper(), whole(amount).cast("int"), _stamp(moment)) if part in _UNITS else F.lit(None).cast("timestamp")


@scalar("datetime_diff")
def datetime_diff(part: str, later: object, earlier: object) -> Column:
    """Whole elapsed units up to weeks; calendar differences for months, quarters and years."""
    part, a, b = part.lower(), _stamp(later), _stamp(earlier)
    years, months = F.year(a) - F.year(b), (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    calendar = {"year": years, "month": months, "quarter": F.floor(months / 3)}
    if part in calendar:
        return calendar[part].cast("long")
    return F.timestamp_diff(part.upper(), b, a) if part in _UNITS else F.lit(None).cast("long")


@scalar("datetime_part")
def datetime_part(part: str, moment: object) -> Column:
    m, part = _stamp(moment), part.lower()
    us = F.pmod(F.unix_micros(m), F.lit(1_000_000))
    parts = {"year": F.year(m), "quarter": F.quarter(m), "month": F.month(m), "week_of_year": F.weekofyear(m), "weekofyear": F.weekofyear(m), "day": F.dayofmonth(m), "dayofyear": F.dayofyear(m), "hour": F.hour(m), "minute": F.minute(m), "second": F.second(m), "millisecond": F.floor(us / 1000), "microsecond": us, "nanosecond": us * 1000}
    return parts[part].cast("long") if part in parts else F.lit(None).cast("long")


def _start(unit: str, moment: object, offset: int = 0) -> Column:
    m = _stamp(moment)
    if unit == "week":  # weeks start on Sunday
        return F.timestamp_add("DAY", F.lit(7 * offset - 1), F.date_trunc("week", F.timestamp_add("DAY", F.lit(1), m)))
    return F.timestamp_add(unit.upper(), F.lit(offset), F.date_trunc(unit, m))


for _unit in ("day", "week", "month", "year"):
    SCALARS[f"startof{_unit}"] = lambda m, n=0, u=_unit: _start(u, m, n)
    SCALARS[f"endof{_unit}"] = lambda m, n=0, u=_unit: F.timestamp_add("MICROSECOND", F.lit(-1), _start(u, m, n + 1))
for _names, _f in {("getyear",): F.year, ("getmonth", "monthofyear"): F.month, ("dayofmonth",): F.dayofmonth, ("dayofyear",): F.dayofyear, ("hourofday",): F.hour, ("weekofyear",): F.weekofyear}.items():
    for _name in _names:
        SCALARS[_name] = lambda m, f=_f: f(_stamp(m)).cast("long")


@scalar("dayofweek")
def dayofweek(moment: object) -> Column:
    """Days since Sunday as an interval."""
    return F.make_dt_interval(F.dayofweek(_stamp(moment)) - 1)


@scalar("format_datetime")
def format_datetime(moment: object, pattern: str) -> Column:
    import re

    tokens = {"yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "HH": "HH", "hh": "hh", "mm": "mm", "ss": "ss", "tt": "a", "zzz": "xxx", "fffffff": "SSSSSS", "ffffff": "SSSSSS", "fff": "SSS"}
    out = re.sub("|".join(sorted(tokens, key=len, reverse=True)) + r"|[A-Za-z]+|'", lambda m: tokens.get(m[0]) or ("''" if m[0] == "'" else f"'{m[0]}'"), pattern)
    return F.date_format(_stamp(moment), out)


@scalar("format_timespan")
def format_timespan(x: Column, *_: object) -> Column:
    """``[-][d.]hh:mm:ss[.fffffff]`` of an interval."""
    us = v.micros(x)
    n = F.abs(us)
    days, rest = F.floor(n / 86_400_000_000), n % 1_000_000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(n / 3_600_000_000) % 24), two(F.floor(n / 60_000_000) % 60), two(F.floor(n / 1_000_000) % 60))
    fraction = F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"), F.lit("0"))).otherwise("")
    return F.concat(F.when(us < 0, "-").otherwise(""), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""), clock, fraction)


@scalar("make_datetime")
def make_datetime(year: object, month: object, day: object, hour: object = 0, minute: object = 0, second: object = 0) -> Column:
    n = lambda x: whole(x).cast("int")
    return F.try_make_timestamp(n(year), n(month), n(day), n(hour), n(minute), real(second).cast("decimal(8,6)"))


@scalar("make_timespan")
def make_timespan(hours: object, minutes: object, seconds: object = 0) -> Column:
    return v.interval(((real(hours) * 3600 + real(minutes) * 60 + real(seconds)) * 1_000_000).cast("long"))


for _unit, _scale in {"seconds": 1e6, "milliseconds": 1e3, "microseconds": 1.0, "nanoseconds": 1e-3}.items():
    SCALARS[f"unixtime_{_unit}_todatetime"] = lambda x, k=_scale: F.timestamp_micros((real(x) * k).try_cast("long"))

# ---- lists, objects, JSON ---------------------------------------------------


@scalar("array_length")
def array_length(x: Column) -> Column:
    return F.when(x.isNotNull(), F.size(x).cast("long"))


@scalar("array_index_of")
def array_index_of(x: Column, item: object) -> Column:
    return (F.array_position(x, col(item)) - 1).cast("long")


@scalar("array_slice")
def array_slice(x: Column, start: int, end: int) -> Column:
    """Both ends included; negative ones count from the back."""
    n = F.size(x)
    a, b = (F.lit(i) if i >= 0 else n + i for i in (start, end))
    a = F.greatest(a, F.lit(0))
    return F.when(x.isNotNull(), F.slice(x, a + 1, F.greatest(F.least(b, n - 1) - a + 1, F.lit(0))))


@scalar("array_concat")
def array_concat(*xs: Column) -> Column:
    return F.concat(*xs)


@scalar("array_sum")
def array_sum(x: Column) -> Column:
    return F.aggregate(F.filter(F.transform(x, lambda e: e.try_cast("double")), lambda e: e.isNotNull()), F.lit(0.0), lambda a, e: a + e)


SCALARS["array_sort_asc"] = lambda x: F.sort_array(x, True)
SCALARS["array_sort_desc"] = lambda x: F.sort_array(x, False)
SCALARS["array_reverse"] = lambda x: F.reverse(x)


@scalar("bag_keys")
def bag_keys(json: object) -> Column:
    """Keys of a JSON object, in its order."""
    return F.json_object_keys(text(json))


@scalar("bag_has_key")
def bag_has_key(json: object, key: str) -> Column:
    return v.yes(F.array_contains(F.json_object_keys(text(json)), key))


@scalar("pack")
def pack(*pairs: object) -> Column:
    """A JSON object from keys and values; the last value of a key wins."""
    own = {str(k): col(x) for k, x in zip(pairs[::2], pairs[1::2], strict=False)}
    return F.to_json(F.struct(*(x.alias(k) for k, x in own.items())), {"ignoreNullFields": "false"})


@scalar("pack_array")
def pack_array(*xs: object) -> Column:
    return F.array(*map(col, xs))


@scalar("set_has_element")
def set_has_element(x: Column, item: object) -> Column:
    return v.yes(F.array_contains(x, col(item)))


@scalar("set_union")
def set_union(*xs: Column) -> Column:
    return F.array_distinct(F.concat(*xs))


@scalar("set_intersect")
def set_intersect(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = F.array_intersect(first, x)
    return first


@scalar("set_difference")
def set_difference(first: Column, *rest: Column) -> Column:
    for x in rest:
        first = F.array_except(first, x)
    return first


@scalar("parse_json", "todynamic")
def parse_json(s: object) -> Column:
    """VARIANT of JSON text; other text becomes a VARIANT string, empty text null."""
    s = col(s).cast("string")
    return F.try_parse_json(F.when(F.try_parse_json(s).isNotNull(), s).when(F.trim(s) != "", v.json_text(s)))


@scalar("member")
def member(json: object, *path: str | int, kind: str = "string") -> Column:
    """``a.b[0]`` of JSON text; names match exactly first, then in any case; null where absent."""
    at = F.try_parse_json(text(json))
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.try_variant_get(at, "$" + steps, kind)


# ---- conditions and types ---------------------------------------------------


@scalar("iif", "iff")
def iif(condition: object, yes: object, no: object) -> Column:
    return F.when(v.truthy(condition), col(yes)).otherwise(col(no))


@scalar("case")
def case(*args: object) -> Column:
    """Condition and value in turn, then the default; null without one."""
    pairs, default = (args[:-1], col(args[-1])) if len(args) % 2 else (args, F.lit(None))
    out = None
    for condition, value in zip(pairs[::2], pairs[1::2], strict=True):
        test = v.truthy(condition)
        out = F.when(test, col(value)) if out is None else out.when(test, col(value))
    return default if out is None else out.otherwise(default)


@scalar("coalesce")
def coalesce(*xs: object) -> Column:
    """The first value that is neither null nor empty text."""
    return F.coalesce(*(F.when(col(x).cast("string") != "", col(x)) for x in xs))


SCALARS["isnull"] = lambda x: col(x).isNull()
SCALARS["isnotnull"] = SCALARS["notnull"] = lambda x: col(x).isNotNull()
SCALARS["isempty"] = lambda x: col(x).isNull() | v.yes(col(x).cast("string") == "")
SCALARS["isnotempty"] = SCALARS["notempty"] = lambda x: ~SCALARS["isempty"](x)


@scalar("gettype")
def gettype(x: object) -> Column:
    x = col(x)
    kinds = {"tinyint|smallint|int$|bigint": "long", "float|double|decimal": "real", "boolean": "bool", "timestamp|date": "datetime", "interval": "timespan", "array|map|struct|variant": "dynamic"}
    out = F.when(x.isNull(), "null")
    for pattern, name in kinds.items():
        out = out.when(v.typed(x, pattern), name)
    return out.otherwise("string")


SCALARS["tostring"] = text
SCALARS["tolong"] = SCALARS["toint"] = whole
SCALARS["todouble"] = SCALARS["toreal"] = real
SCALARS["tobool"] = SCALARS["toboolean"] = v.flag
SCALARS["todatetime"] = v.moment


@scalar("totimespan")
def totimespan(x: object) -> Column:
    """A number is 100 ns ticks; text is ``[d.]hh:mm[:ss[.f]]`` or a number with a unit."""
    s = F.trim(text(x))
    clock = r"^(-?)(?:(\d+)\.)?(\d+):(\d+)(?::(\d+(?:\.\d+)?))?$"
    part = lambda k: F.coalesce(F.regexp_extract(s, clock, k).try_cast("double"), F.lit(0.0))
    us = (part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)) * 1e6
    timed = F.when(s.startswith("-"), -us).otherwise(us)
    unit = F.regexp_extract(s, r"^-?\d+(?:\.\d+)?(ms|[dhms])$", 1)
    scale = F.element_at(F.create_map(*(F.lit(y) for k in ("d", "h", "m", "s", "ms") for y in (k, float(v.UNITS[k])))), F.nullif(unit, F.lit("")))
    glued = F.regexp_extract(s, r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double") * scale
    ticks = s.try_cast("double") / 10
    return v.interval(F.coalesce(F.when(s.rlike(clock), timed), glued, ticks).try_cast("long"))


# ---- hashes and addresses ---------------------------------------------------

SCALARS["hash_sha256"] = lambda x, *_: F.sha2(text(x), 256)
SCALARS["hash_sha1"] = lambda x, *_: F.sha1(text(x))
SCALARS["hash_md5"] = lambda x, *_: F.md5(text(x))


@F.arrow_udf(LongType())
def _blake(x: pa.Array) -> pa.Array:
    return pa.array([int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for s in x.to_pylist()], pa.int64())


@scalar("hash")
def hash_(x: object, mod: int | None = None) -> Column:
    """BLAKE2b of eight bytes, big-endian and signed; within 0 and ``mod`` if that is given."""
    return _blake(text(x)) if not mod else F.pmod(_blake(text(x)), F.lit(mod))


IPV4 = r"^\s*(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|(?=\s*$))){4}\s*$"
#: The IPv4 blocks that are not for public use.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32")


@scalar("parse_ipv4")
def parse_ipv4(address: object) -> Column:
    s = F.trim(text(address))
    parts = F.split(s, r"\.")
    return F.when(s.rlike(IPV4), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long")))


def _within(n: Column, block: str) -> Column:
    net = ipaddress.ip_network(block, strict=False)
    return n.between(int(net.network_address), int(net.broadcast_address))


@scalar("ipv4_is_private")
def ipv4_is_private(address: object) -> Column:
    n, out = parse_ipv4(address), F.lit(False)
    for block in PRIVATE:
        out |= _within(n, block)
    return F.when(n.isNotNull(), out)


@scalar("ipv4_is_in_range")
def ipv4_is_in_range(address: object, block: str) -> Column:
    try:
        return _within(parse_ipv4(address), block)
    except ValueError:
        return F.lit(None).cast("boolean")


@scalar("ipv4_is_match")
def ipv4_is_match(a: object, b: object, prefix: int = 32) -> Column:
    shift = 32 - prefix
    return F.shiftright(parse_ipv4(a), shift) == F.shiftright(parse_ipv4(b), shift)


@scalar("ipv4_compare")
def ipv4_compare(a: object, b: object, *_: object) -> Column:
    return F.signum((parse_ipv4(a) - parse_ipv4(b)).cast("double")).cast("long")


@F.arrow_udf(BooleanType())
def _same_ipv6(a: pa.Array, b: pa.Array) -> pa.Array:
    def same(x: str, y: str) -> bool | None:
        try:
            p, q = ipaddress.ip_address(x), ipaddress.ip_address(y)
        except ValueError:
            return None
        wide = [int(ipaddress.ip_address(f"::ffff:{i}")) if i.version == 4 else int(i) for i in (p, q)]
        return wide[0] == wide[1]

    return pa.array([same(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


@scalar("ipv6_is_match")
def ipv6_is_match(a: object, b: object) -> Column:
    return _same_ipv6(text(a), text(b))
