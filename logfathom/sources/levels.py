"""Severity: words and numbers that logs use for it, as one of seven labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank and words of each level, and the levels of syslog priorities 0 to 7.
RANKS = {"unknown": 0, "trace": 10, "debug": 20, "info": 30, "notice": 35, "warning": 40, "error": 50, "critical": 60}
WORDS = {
    "trace": "trace verbose vrb v trc finest finer silly",
    "debug": "debug dbg d fine diag diagnostic",
    "info": "info information informational inf i log message msg normal ok status",
    "notice": "notice note important success",
    "warning": "warning warn wrn w caution deprecated",
    "error": "error err e eror severe failure failed fail exception fatal_error",
    "critical": "critical crit c fatal ftl emerg emergency alert panic assert",
}
PRIORITIES = ("critical", "critical", "critical", "error", "warning", "notice", "info", "debug")
IN_TEXT = r"(?i)\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|CRITICAL|CRIT|FATAL|EMERG|ALERT|PANIC|EXCEPTION|FAILED|FAILURE)\b"


def level(word: Column) -> Column:
    """The label of a level word, null for other words."""
    known = F.create_map(*(F.lit(x) for label, words in WORDS.items() for w in words.split() for x in (w, label)))
    return F.try_element_at(known, F.lower(F.trim(F.coalesce(word, F.lit("")))))


def rank(label: Column) -> Column:
    """A number that sorts worse levels higher."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), F.coalesce(label, F.lit(""))), F.lit(0))


def from_priority(n: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, PRIORITIES)), (F.pmod(n, F.lit(8)) + 1).cast("int"))


def from_words(text: Column) -> Column:
    """The level of the first level word in the first 80 characters."""
    return F.coalesce(level(F.regexp_extract(F.substring(text, 1, 80), IN_TEXT, 1)), F.lit("unknown"))
