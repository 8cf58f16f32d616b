"""Twenty-one log formats: whether a line fits one, and the event that it holds, as columns.

An event is a struct (ts, level, message, extra): ``extra`` is a JSON object of the format's
own fields. Every format is a pattern and column expressions; no Python runs on lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as v
from . import levels

#: Longer lines are cut.
MAX_LINE = 65_536
# Field names that hold message, level and time, the first that is there counts.
MESSAGE_KEYS = ("message", "msg", "text", "log", "event", "description", "short_message", "body", "@message")
LEVEL_KEYS = ("level", "severity", "levelname", "loglevel", "lvl", "priority", "levelName", "log.level", "@level", "type")
TIME_KEYS = ("timestamp", "time", "@timestamp", "ts", "datetime", "date", "asctime", "eventTime", "created", "start_time", "logged_at")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b[@-_]"
# Markers of X servers and their levels; a line with any other marker is no line of theirs.
XORG = {"EE": "error", "WW": "warning", "II": "info", "NI": "notice", "--": "debug", "**": "notice", "++": "debug", "==": "debug", "!!": "critical"}
ISO_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s?(?:Z|[+-]\d{2}:?\d{2}))?"


@dataclass(frozen=True)
class Context:
    """What a line alone does not tell: year and month of the file, the CSV header, all as columns."""

    year: Column
    month: Column
    header: Column


@dataclass(frozen=True)
class Format:
    name: str
    priority: int
    joins: bool  # lines that do not fit continue the event before
    fits: Callable[[Column, Context], Column]
    event: Callable[[Column, Context], Column]


FORMATS: dict[str, Format] = {}


def _event(ts: Column | None, level: Column | None, message: Column, extra: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if ts is None else ts).cast("timestamp").alias("ts"), F.coalesce(none.cast("string") if level is None else level, F.lit("unknown")).alias("level"),
        message.alias("message"), (none if extra is None else extra).cast("string").alias("extra"),
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(x.alias(k) for k, x in fields.items())))


def _add(name: str, priority: int, joins: bool, pattern: str, build: Callable, also: Callable | None = None) -> None:
    """A format by one pattern; ``build`` gets the group getter and the context."""

    def fits(line: Column, context: Context) -> Column:
        test = line.rlike(pattern)
        return test if also is None else test & v.yes(also(lambda k: F.regexp_extract(line, pattern, k), context))

    FORMATS[name] = Format(name, priority, joins, fits, lambda line, context: build(lambda k: F.regexp_extract(line, pattern, k), context))


def _long(s: Column) -> Column:
    return F.trim(s).try_cast("bigint")


def _given(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), name)


def _made(year: Column, month: Column, day: Column, clock: Column, zone: Column | None = None) -> Column:
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.trim(day), 2, "0"), F.lit(" "), clock)
    return (text if zone is None else F.concat(text, zone)).try_cast("timestamp")


def _year(month: Column, context: Context) -> Column:
    """A month after the file's own belongs to the year before."""
    return F.when(month > context.month, context.year - 1).otherwise(context.year)


# ---- one object a line ----


def _object(line: Column) -> Column:
    return F.try_parse_json(F.when(line.rlike(r"^\s*\{.*\}\s*$"), line))


def _first(o: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_variant_get(o, f"$['{k}']", "string") for k in keys))


def by_magnitude(number: Column) -> Column:
    """Epoch seconds, milli-, micro- or nanoseconds, told apart by size."""

    def timed(n: Column) -> Column:
        digits = F.floor(F.log10(n)) + 1  # 9 to 11 for seconds of the years 1973 to 5138, three more for each finer unit
        unit = F.least(F.floor((digits - 9) / 3), F.lit(3))
        return F.timestamp_micros(F.when(unit >= 0, n * F.pow(F.lit(10.0), 6 - 3 * unit)).try_cast("bigint"))

    return bound(number, timed)


def _moment(text: Column) -> Column:
    return bound(text, v.moment)


def _time(text: Column) -> Column:
    return bound(text, lambda t: F.coalesce(by_magnitude(t.try_cast("double")), v.moment(t)))


def without(line: Column, keys: tuple[str, ...]) -> Column:
    """A JSON object without some of its keys; null if nothing is left."""
    own = F.map_filter(F.from_json(line, "map<string,variant>"), lambda k, _: ~k.isin(*keys))
    return _filled(own)


def _filled(own: Column) -> Column:
    """A map as JSON, null if it is empty."""
    return bound(own, lambda m: F.when(F.size(m) > 0, F.to_json(m)))


def _used(names: Column, keys: tuple[str, ...]) -> Column:
    """The name among ``keys`` that counts."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, keys)), lambda k: F.array_contains(names, k)), F.lit(1))


def _jsonl(line: Column, _: Context) -> Column:
    used = bound(F.json_object_keys(line), lambda names: F.array_compact(F.array(*(_used(names, k) for k in (MESSAGE_KEYS, LEVEL_KEYS, TIME_KEYS)))))
    rest = bound(used, lambda u: F.map_filter(F.from_json(line, "map<string,variant>"), lambda k, _: ~F.array_contains(u, k)))

    def told(o: Column) -> Column:
        level = bound(_first(o, LEVEL_KEYS), lambda w: F.coalesce(levels.level(w), levels.from_priority(w.try_cast("int"))))
        return _event(_time(_first(o, TIME_KEYS)), level, F.coalesce(_first(o, MESSAGE_KEYS), line), _filled(rest))

    return bound(_object(line), told)


FORMATS["jsonl"] = Format("jsonl", 100, False, lambda line, _: _object(line).isNotNull(), _jsonl)
JOURNAL = {"unit": "_SYSTEMD_UNIT", "user_unit": "_SYSTEMD_USER_UNIT", "identifier": "SYSLOG_IDENTIFIER", "comm": "_COMM", "pid": "_PID", "uid": "_UID", "gid": "_GID", "transport": "_TRANSPORT", "host": "_HOSTNAME", "boot": "_BOOT_ID", "code_file": "CODE_FILE", "code_line": "CODE_LINE", "code_func": "CODE_FUNC", "errno": "ERRNO", "about_unit": "UNIT", "job_type": "JOB_TYPE"}


def _journal(line: Column, _: Context) -> Column:
    return bound(_object(line), _journal_event)


def _journal_event(o: Column) -> Column:
    get = lambda k: F.try_variant_get(o, f"$['{k}']", "string")
    codes = F.try_variant_get(o, "$.MESSAGE", "array<int>")  # text that is not UTF-8 comes as a list of bytes
    typed = F.decode(F.unhex(F.array_join(F.transform(codes, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")
    message = F.regexp_replace(F.coalesce(F.when(codes.isNotNull(), typed), get("MESSAGE"), F.lit("")), ANSI, "")
    extra = _json(**{k: F.coalesce(F.when(F.lit(k in ("pid", "uid", "gid")), get(f).try_cast("bigint").cast("string")), get(f)) for k, f in JOURNAL.items()})
    return _event(F.timestamp_micros(get("__REALTIME_TIMESTAMP").try_cast("bigint")), levels.from_priority(get("PRIORITY").try_cast("int")), message, extra)


FORMATS["journal"] = Format("journal", 105, False, lambda line, _: F.try_variant_get(_object(line), "$.__CURSOR", "string").isNotNull(), _journal)

# ---- key=value ----

PAIR = r'([A-Za-z_][\w.@-]*)=("(?:[^"\\]|\\.)*"|\S*)'
LEADING = rf"^\s*((?:{PAIR.replace('(', '(?:', 1).replace('=(', '=(?:')}(?:\s+|$)){{2,}})(.*)$"


def pairs(text: Column) -> Column:
    """The pairs of a text as a map; the last value of a name counts."""
    keys, values = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(k)) for k in (1, 2))
    bare = F.transform(values, lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r"\\(.)", "$1")).otherwise(x))
    entries = F.transform(F.arrays_zip(keys.alias("k"), bare.alias("v")), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.greatest(F.size(es), F.lit(1))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(bound(entries, last))


def _of(own: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_element_at(own, F.lit(k)) for k in keys))


def _rest(own: Column) -> Column:
    return _filled(F.map_filter(own, lambda k, _: ~k.isin(*MESSAGE_KEYS, *LEVEL_KEYS, *TIME_KEYS)))


def _logfmt(g: Callable, _: Context) -> Column:
    told = lambda own: _event(_time(_of(own, TIME_KEYS)), levels.level(_of(own, LEVEL_KEYS)), F.coalesce(_of(own, MESSAGE_KEYS), _given(F.trim(g(2))), F.trim(g(1))), _rest(own))
    return bound(g(1), lambda text: bound(pairs(text), told))


_add("logfmt", 70, False, LEADING, _logfmt, lambda g, _: F.length(g(2)) <= F.length(g(1)))


def _level_logfmt(g: Callable, _: Context) -> Column:
    own = bound(g(4), pairs)
    message = F.trim(F.regexp_replace(g(4), PAIR, ""))
    extra = F.to_json(F.map_concat(F.map_filter(own, lambda k, _: k != "elapsed"), F.create_map(F.lit("elapsed"), g(3))))
    return _event(_moment(g(2)), levels.level(g(1)), message, extra)


_add("level-logfmt", 85, False, rf"^([A-Z]+)\s+({ISO_TIME})\s+(\+\S+)\s+(.*)$", _level_logfmt, lambda g, _: levels.level(g(1)).isNotNull())

# ---- time, level, message ----

_add("syslog5424", 95, True, r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|(?:\[[^\]]*\])+)\s?(.*)$", lambda g, _: _event(_moment(g(2)), levels.from_priority(_long(g(1))), g(7), _json(host=g(3), program=g(4), pid=g(5), facility=F.floor(_long(g(1)) / 8), msgid=g(6))))
_add("chromium", 92, True, r"^\[(\d+):(\d+):(\d{2})(\d{2})/(\d{2})(\d{2})(\d{2}(?:\.\d+)?):([A-Z]+\d*):([^\]]*)\]\s?(.*)$", lambda g, x: _event(_made(_year(_long(g(3)), x), g(3), g(4), F.concat_ws(":", g(5), g(6), g(7))), F.coalesce(levels.level(g(8)), F.when(g(8).startswith("VERBOSE"), "trace")), g(10), _json(pid=_long(g(1)), tid=_long(g(2)), origin=g(9))))
_add("pacman", 91, True, r"^\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{4})\] \[([A-Z0-9-]+)\] (.*)$", lambda g, _: _event(_moment(g(1)), F.when(F.lower(g(3)).startswith("error"), "error").when(F.lower(g(3)).startswith("warning"), "warning").otherwise("info"), g(3), _json(subsystem=g(2))))
_add("abseil", 90, True, r"^\[(\d{4})-([A-Z][a-z]{2})-(\d{2}) (\d{2}:\d{2}:\d{2}(?:\.\d+)?) ([+-]\d{2}:\d{2})\]\[\s*(\d+):\s*(\d+)\]\[(\w+)\s*\]\s?(.*)$", lambda g, _: _event(_made(g(1), _month(g(2)), g(3), g(4), g(5)), levels.level(g(8)), g(9), _json(pid=_long(g(6)), tid=_long(g(7)))))


def _access(g: Callable, _: Context) -> Column:
    status = _long(g(9))
    level = F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")
    ts = _made(g(5), _month(g(4)), g(3), g(6), F.concat(F.substring(g(7), 1, 3), F.lit(":"), F.substring(g(7), 4, 2)))
    request = r"^(\S+)\s+(\S+)(?:\s+(\S+))?$"
    part = lambda k: _given(F.regexp_extract(g(8), request, k))
    extra = _json(client=g(1), user=F.nullif(g(2), F.lit("-")), status=status, method=part(1), path=part(2), protocol=part(3), size=_long(g(10)), referer=F.nullif(_given(g(11)), F.lit("-")), agent=_given(g(12)))
    return _event(ts, level, F.concat(g(8), F.lit(" "), g(9)), extra)


_add("access-log", 89, False, r'^(\S+) \S+ (\S+) \[(\d{2})/([A-Z][a-z]{2})/(\d{4}):(\d{2}:\d{2}:\d{2}) ([+-]\d{4})\] "([^"]*)" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?.*$', _access)
_add("nginx-error", 88, True, r"^(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+): (.*)$", lambda g, _: _event(_made(g(1), g(2), g(3), g(4)), levels.level(g(5)), g(8), _json(pid=_long(g(6)), tid=_long(g(7)))))
_add("python", 83, True, rf"^({ISO_TIME}) (?:\[([^\]]*)\] )?([A-Z]+) ([\w.]+): (.*)$", lambda g, _: _event(_moment(g(1)), levels.level(g(3)), g(5), _json(thread=_given(g(2)), logger=g(4))), lambda g, _: levels.level(g(3)).isNotNull())
_known = lambda k: lambda g, _: levels.level(g(k)).isNotNull()
_plain_level = lambda g, _: _event(_moment(g(1)), levels.level(g(2)), g(3))
_add("bracket-level", 82, True, rf"^\[({ISO_TIME})\]\s*\[\s*(\w+)\s*\]\s*(.*)$", _plain_level, _known(2))
_add("bracket-colon", 81, True, rf"^\[({ISO_TIME})\]:\s*(\w+):\s*(.*)$", _plain_level, _known(2))
_add("electron", 80, True, rf"^({ISO_TIME})\s+\[\s*(\w+)\s*\]\s*(.*)$", _plain_level, _known(2))
_add("syslog", 75, True, r"^([A-Z][a-z]{2})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: ?(.*)$", lambda g, x: _event(_made(_year(_month(g(1)), x), _month(g(1)), g(2), g(3)), levels.from_words(g(7)), g(7), _json(host=g(4), program=g(5), pid=_long(g(6)))), lambda g, _: _month(g(1)) > 0)
_add("npm", 65, False, r"^(\d+) (silly|verbose|info|timing|http|notice|warn|error) (.*)$", lambda g, _: _event(None, F.coalesce(levels.level(g(2)), F.lit("info")), g(3)))
_add("xorg", 60, True, r"^\[\s*(\d+\.\d+)\]\s(?:\((EE|WW|II|NI|--|\*\*|\+\+|==|!!)\)\s?|(?!\(..\)))(.*)$", lambda g, _: _event(None, F.try_element_at(F.create_map(*(F.lit(x) for kv in XORG.items() for x in kv)), g(2)), g(3), _json(uptime=g(1).try_cast("double"), marker=_given(g(2)))))
_add("go", 55, True, r"^(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2}(?:\.\d+)?) (.*)$", lambda g, _: _event(_made(g(1), g(2), g(3), g(4)), levels.from_words(g(5)), g(5)))
_add("timestamped", 20, True, rf"^\[?({ISO_TIME})\]?[\s:|-]*(.*)$", lambda g, _: _event(_moment(g(1)), levels.from_words(g(2)), g(2)), lambda g, _: _moment(g(1)).isNotNull())

# ---- columns under a header, and everything else ----

COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
HEADER = r"^\s*[A-Za-z_@][\w .@-]*(?:,\s*[A-Za-z_@][\w .@-]*){2,}\s*$"


def cells(line: Column) -> Column:
    return F.transform(F.split(line, COMMA), lambda x: F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"')))


def _csv(line: Column, context: Context) -> Column:
    told = lambda own: _event(_time(_of(own, TIME_KEYS)), levels.level(_of(own, LEVEL_KEYS)), F.coalesce(_of(own, MESSAGE_KEYS), line), _rest(own))
    return bound(F.map_from_arrays(context.header, cells(line)), told)


FORMATS["csv"] = Format("csv", 50, False, lambda line, x: v.yes((F.size(cells(line)) == F.size(x.header)) & (cells(line) != x.header)), _csv)
FORMATS["plain"] = Format("plain", -100, False, lambda line, _: F.lit(True), lambda line, _: _event(None, levels.from_words(line), line))
