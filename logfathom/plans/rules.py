"""Detection rules: a question over a log table, fired if it gives enough rows.

Built-in rules use the query library. A user's rule, read from JSON, names a library
question or holds Spark SQL over the view ``logs``. One failing rule does not stop the rest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.aggregates import AGGREGATES as agg
from ..operators.table import Table
from . import library

RISKS = ("info", "low", "medium", "high")
c = F.col


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    risk: str
    run: Callable[[Table], Table]
    minimum_rows: int = 1
    count_column: str | None = None


@dataclass(frozen=True)
class Finding:
    rule: Rule
    rows: int = 0
    total: int | None = None
    table: Table | None = None
    error: str | None = None

    @property
    def headline(self) -> str:
        if self.error:
            return f"failed: {self.error}"
        if not self.rows:
            return "nothing matched"
        return f"{self.rows} row{'s' * (self.rows != 1)}" + (f", {self.total:,} {self.rule.count_column.lower()}" if self.total else "")


def _counted(*words: str) -> Callable[[Table], Table]:
    return lambda t: t.where(v.has_any(c("Message"), *words)).summarize(by="App", Count=agg["count"](), Last=agg["max"](c("Timestamp"))).sort_by("Count", ("App", "asc"))


def _library(id_: str) -> Callable[[Table], Table]:
    return lambda t: library.QUERIES[id_].run(t)


BUILT_IN = (
    Rule("shell-pipeline", "Downloads piped into a shell", "high", _library("shell-pipelines")),
    Rule("encoded-payload", "Long encoded payloads", "medium", _library("encoded-commands")),
    Rule("crash-cluster", "Crashes of one application", "medium", _counted("segfault", "core dumped", "panic", "crashed", "SIGSEGV", "SIGABRT"), count_column="Count"),
    Rule("auth-failures", "Failed logins", "medium", _counted(*library.AUTH), count_column="Count"),
    Rule("error-storm", "An error repeated many times", "low", lambda t: library.error_storms(t, 50), count_column="Count"),
    Rule("new-log-sources", "New logs", "info", _library("new-sources")),
    Rule("disk-and-memory", "Disk or memory ran out", "medium", _counted("no space left", "disk full", "out of memory", "read-only file system"), count_column="Count"),
    Rule("external-addresses", "Addresses outside private networks", "info", _library("network-addresses"), count_column="Count"),
    Rule("privilege-use", "Use of privileges", "low", _counted("sudo", "pkexec", "polkit", "setuid"), count_column="Count"),
    Rule("log-gap", "A log fell silent", "low", lambda t: library.gaps(t, "1d")),
    Rule("unreadable-growth", "Logs without times", "info", _library("no-timestamps"), count_column="Events"),
    Rule("virus-detections", "Detections of the virus scanner", "high", lambda t: t.where(v.matches(c("Message"), r"\bFOUND\s*$")).summarize(by="App", Count=agg["count"]()), count_column="Count"),
    Rule("odd-hours", "Activity at night", "info", _library("odd-hours"), count_column="Events"),
    Rule("certificate-and-tls", "Certificate trouble", "medium", _counted("certificate", "x509", "tls handshake", "ssl error"), count_column="Count"),
    Rule("persistence-words", "Ways to start again at boot", "low", _counted("crontab", "autostart", "ld preload", "systemctl enable", "authorized keys"), count_column="Count"),
    Rule("mass-file-errors", "Many file errors", "low", lambda t: t.where(v.has_any(c("Message"), "no such file", "input/output error", "too many open files")).summarize(by="App", Count=agg["count"]()).where(c("Count") >= 20), count_column="Count"),
)


def from_json(text: str) -> tuple[list[Rule], list[str]]:
    """Rules of a JSON object, list or ``{"rules": [...]}``; and what is wrong with the others."""
    rules, wrong = [], []
    try:
        data = json.loads(text)
    except ValueError as e:
        return [], [f"not JSON: {e}"]
    items = data.get("rules", [data]) if isinstance(data, dict) else data if isinstance(data, list) else []
    for x in items:
        id_ = str(x.get("id", "")) if isinstance(x, dict) else ""
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", id_) or not x.get("title") or not (x.get("sql") or x.get("library") in library.QUERIES):
            wrong.append(f"rule {id_ or x!r}: id, title and sql or a library question are needed")
            continue
        run = _library(x["library"]) if not x.get("sql") else lambda t, sql=x["sql"]: _sql(t, sql)
        risk = x.get("risk", "low")
        rules.append(Rule(id_, str(x["title"]), risk if risk in RISKS else "low", run, int(x.get("minimum_rows", x.get("threshold", 1))), x.get("count_column")))
    return rules, wrong


def _sql(t: Table, sql: str) -> Table:
    return Table(t.raw.sparkSession.sql(sql.replace("{logs}", "{log}") if "{logs}" in sql else re.sub(r"\blogs\b", "{log}", sql), log=t.raw.select(*t.columns)))


def catalogue(own: Iterable[Rule] = ()) -> list[Rule]:
    """Built-in rules, those with an id of the user's own replaced by it."""
    return list(({r.id: r for r in BUILT_IN} | {r.id: r for r in own}).values())


def evaluate(log: Table, rules: Iterable[Rule] = BUILT_IN) -> list[Finding]:
    """Run each rule; what fired first, by risk, then by rows. Only counts come to the driver."""
    found = []
    for rule in rules:
        try:
            t = rule.run(log)
            has = rule.count_column is not None and rule.count_column in t.columns
            got = t.df.agg(F.count(F.lit(1)).alias("n"), *([F.sum(rule.count_column).alias("s")] if has else [])).first()
            n = got["n"] if got["n"] >= rule.minimum_rows else 0
            found.append(Finding(rule, n, int(got["s"] or 0) if has and n else None, t))
        except Exception as e:  # noqa: BLE001 - reported as the rule's finding
            found.append(Finding(rule, error=str(e).splitlines()[0]))
    return sorted(found, key=lambda f: (bool(f.error), -RISKS.index(f.rule.risk) if f.rows else 9, -f.rows, f.rule.id))


def review(log: Table, rules: Iterable[Rule] = BUILT_IN) -> DataFrame:
    """A row a rule: id, risk, rows, total, headline."""
    rows = [(f.rule.id, f.rule.risk, f.rows, f.total, f.headline) for f in evaluate(log, rules)]
    return log.raw.sparkSession.createDataFrame(rows, "rule string, risk string, rows long, total long, headline string")
