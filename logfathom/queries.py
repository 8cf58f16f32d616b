"""One query for each operator family over the test tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as v
from .functions.aggregates import AGGREGATES as agg
from .functions.scalar import fn
from .operators.table import Capture, Table
from .plans import library

c = F.col
TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], Table]:
    return lambda name: Table.read(spark, f"{sf_dir}/{name}.parquet", TIMES.get(name), name)


def query(sql: str | None = None):
    """Register a function of (table getter) under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir)).df
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- flagship: errors and purchases by hour ----


@query("""
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total, count(DISTINCT user_id) AS users
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2 HAVING count(*) >= 2
ORDER BY n DESC, event_type, hour LIMIT 100""")
def events_by_hour(t):
    rows = t("events").where(c("event_type").isin("error", "purchase")).summarize(by={"event_type": c("event_type"), "hour": fn.bin(c("ts"), "1h")}, n=agg["count"](), total=F.round(agg["sum"](c("value")), 4), users=agg["dcount"](c("user_id")))
    return rows.where(c("n") >= 2).top(100, "n", ("event_type", "asc"), ("hour", "asc"))


# ---- filters ----


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'")
def filter_cmp(t):
    return t("orders").where(c("o_totalprice") >= 100000, c("o_orderstatus") != "F").project("o_orderkey", "o_totalprice")


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) IN ('en', 'fr') AND source NOT IN ('web') OR source IS NULL AND lower(lang) IN ('en', 'fr')")
def filter_in(t):
    return t("documents").where(v.is_in(c("lang"), "EN", "fr", fold=True), v.not_in(c("source"), "web")).project("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND NOT (l_discount BETWEEN 0.02 AND 0.08)")
def filter_between(t):
    return t("lineitem").where(c("l_quantity").between(10, 20), v.not_between(c("l_discount"), 0.02, 0.08)).project("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND NOT starts_with(lower(p_type), 'std') AND ends_with(p_brand, '3')")
def filter_text(t):
    return t("part").where(v.contains(c("p_name"), "A"), ~v.startswith(c("p_type"), "STD"), v.endswith(c("p_brand"), "3", fold=False)).project("p_partkey", "p_name")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9A-Za-z])(?i:the)([^0-9A-Za-z]|$)')")
def filter_has(t):
    return t("documents").where(v.has(c("text"), "the")).project("doc_id")


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '://[^/]*[0-9]+') OR regexp_matches(url, '/de/')")
def filter_regex(t):
    return t("pages").where(v.matches(c("url"), r"://[^/]*[0-9]+") | v.matches(c("url"), "/de/")).project("page_id")


@query("SELECT event_id, event_type IS NOT NULL AND event_type = 'error' AS is_error, NOT (coalesce(event_type = 'error', false) AND coalesce(value > 50, false)) AS calm FROM events")
def filter_not_null_logic(t):
    return t("events").project("event_id", is_error=v.eq(c("event_type"), "error"), calm=~(v.eq(c("event_type"), "error") & v.yes(c("value") > 50)))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9A-Za-z])(?i:and)([^0-9A-Za-z]|$)') OR regexp_matches(lang, '(^|[^0-9A-Za-z])(?i:and)([^0-9A-Za-z]|$)') OR regexp_matches(source, '(^|[^0-9A-Za-z])(?i:and)([^0-9A-Za-z]|$)')")
def search_rows(t):
    return t("documents").search("and").project("doc_id")


# ---- projections, limits ----


@query("SELECT o_totalprice AS price, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def project_variants(t):
    return t("orders").project_away("o_custkey").project_rename(price="o_totalprice").project_reorder("price", "o_order*")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal, s_acctbal AS old FROM supplier")
def extend_replace(t):
    return t("supplier").extend(S_AcctBal=c("s_acctbal") * 2, old=c("s_acctbal"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_cols(t):
    return t("lineitem").distinct("l_returnflag", "l_linestatus")


@query("SELECT count(*) AS \"Count\" FROM lineitem WHERE l_quantity < 25")
def count_rows(t):
    return t("lineitem").where(c("l_quantity") < 25).count()


@query("SELECT * FROM (VALUES ('n_nationkey', 0, 'int', ''), ('n_name', 1, 'string', ''), ('n_regionkey', 2, 'int', '')) x(\"ColumnName\", \"ColumnOrdinal\", \"DataType\", \"Description\")")
def getschema_rows(t):
    return t("nation").getschema()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(t):
    return t("orders").top(20, "o_totalprice", ("o_orderkey", "asc")).project("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, k, row_number() OVER (ORDER BY k NULLS FIRST, c_custkey DESC) AS place FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS k FROM customer)")
def sort_nulls(t):
    return t("customer").project("c_custkey", k=F.when(c("c_acctbal") > 0, c("c_nationkey"))).sort_by(("k", "asc"), "c_custkey").row_number("place").project("c_custkey", "k", "place")


@query("SELECT c_custkey, k FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS k FROM customer) ORDER BY k NULLS FIRST, c_custkey DESC")
def sort_nulls_whole(t):
    return t("customer").project("c_custkey", k=F.when(c("c_acctbal") > 0, c("c_nationkey"))).sort_by(("k", "asc"), "c_custkey")


@query("SELECT event_id, user_id FROM events ORDER BY user_id, event_id LIMIT 50")
def take_sorted(t):
    return t("events").sort_by(("event_id", "asc")).sort_by(("user_id", "asc")).take(50).project("event_id", "user_id")


@query("SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 10)")
def sample_rows(t):
    return t("events").sample(10).summarize(n=agg["count"]())


# ---- joins ----

_LEFT = "(SELECT c_custkey, c_mktsegment FROM customer)"
_RIGHT = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"


def _sides(t):
    return t("customer").project("c_custkey", "c_mktsegment"), t("orders").project("o_orderkey", "o_custkey", "o_totalprice")


def _join(kind: str, sql: str) -> None:
    def run(t):
        left, right = _sides(t)
        return left.join(right, [("c_custkey", "o_custkey")], kind)

    run.__name__ = f"join_{kind}"
    query(sql.format(l=_LEFT, r=_RIGHT))(run)


_JOINS = {
    "inner": "SELECT * FROM {l} JOIN {r} ON c_custkey = o_custkey", "leftouter": "SELECT * FROM {l} LEFT JOIN {r} ON c_custkey = o_custkey", "rightouter": "SELECT * FROM {l} RIGHT JOIN {r} ON c_custkey = o_custkey", "fullouter": "SELECT * FROM {l} FULL JOIN {r} ON c_custkey = o_custkey",
    "leftsemi": "SELECT * FROM {l} WHERE c_custkey IN (SELECT o_custkey FROM {r})", "leftanti": "SELECT * FROM {l} WHERE c_custkey NOT IN (SELECT o_custkey FROM {r})", "rightsemi": "SELECT * FROM {r} WHERE o_custkey IN (SELECT c_custkey FROM {l})", "rightanti": "SELECT * FROM {r} WHERE o_custkey NOT IN (SELECT c_custkey FROM {l})",
}
for _kind, _sql in _JOINS.items():
    _join(_kind, _sql)


@query("SELECT n.n_nationkey, n.n_name, s.s_suppkey, s.s_nationkey FROM (SELECT n_nationkey, n_name FROM nation) n JOIN supplier s ON n.n_nationkey = s.s_nationkey")
def join_small_side(t):
    return t("supplier").project("s_suppkey", "s_nationkey").join(t("nation").project("n_nationkey", "n_name"), [("s_nationkey", "n_nationkey")], "inner", small=10_000)


@query("SELECT l.user_id, l.first_id, u.c_custkey FROM (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY 1) l JOIN customer u ON l.user_id = u.c_custkey")
def join_innerunique(t):
    first = t("events").sort_by(("event_id", "asc")).project("user_id", first_id=c("event_id"))
    return first.join(t("customer").project("c_custkey"), [("user_id", "c_custkey")])


@query("SELECT a.k, a.c_custkey, b.k AS k1, b.n FROM (SELECT nullif(c_nationkey % 5, 0) AS k, c_custkey FROM customer) a JOIN (SELECT nullif(s_nationkey % 5, 0) AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys(t):
    a = t("customer").project(k=F.nullif(c("c_nationkey") % 5, F.lit(0)), c_custkey=c("c_custkey"))
    b = t("supplier").summarize(by={"k": F.nullif(c("s_nationkey") % 5, F.lit(0))}, n=agg["count"]())
    return a.join(b, "k", "inner")


# Sides without a partner, by segment and order status; one null key a side.

_WHOLE_LEFT = "(SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')"
_WHOLE_RIGHT = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F')"


def _join_whole(kind: str, sql: str) -> None:
    def run(t):
        left = t("customer").where(c("c_mktsegment") != "BUILDING").project("c_custkey", "c_mktsegment")
        right = t("orders").where(c("o_orderstatus") != "F").project("o_orderkey", "o_custkey", "o_totalprice")
        return left.join(right, [("c_custkey", "o_custkey")], kind)

    run.__name__ = f"join_{kind}_whole"
    query(sql.format(l=_WHOLE_LEFT, r=_WHOLE_RIGHT))(run)


for _kind, _sql in _JOINS.items():
    _join_whole(_kind, _sql)


@query("SELECT a.k, a.o_orderkey, b.k AS k1, b.c_name FROM (SELECT nullif(o_custkey, 7) AS k, o_orderkey FROM orders) a JOIN (SELECT nullif(c_custkey, 7) AS k, c_name FROM customer) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_keys_whole(t):
    a = t("orders").project(k=F.nullif(c("o_custkey"), F.lit(7)), o_orderkey=c("o_orderkey"))
    b = t("customer").project(k=F.nullif(c("c_custkey"), F.lit(7)), c_name=c("c_name"))
    return a.join(b, "k", "inner")


# ---- unions ----


@query("SELECT c_name AS name, c_acctbal, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_outer(t):
    return t("customer").project("c_acctbal", name=c("c_name")).union(t("supplier").project("s_acctbal", name=c("s_name")))


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def union_inner(t):
    return t("customer").project("c_acctbal", name=c("c_name")).union(t("supplier").project("s_acctbal", name=c("s_name")), kind="inner")


@query("SELECT 'nation' AS T, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def union_withsource(t):
    return t("nation").project(name=c("n_name")).union(t("region").project(name=c("r_name")), withsource="T")


# ---- aggregates ----


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1")
def agg_basic(t):
    return t("lineitem").summarize(by="l_returnflag", n=agg["count"](), qty=F.round(agg["sum"](c("l_quantity")), 2), price=F.round(agg["avg"](c("l_extendedprice")), 4), lo=agg["min"](c("l_tax")), hi=agg["max"](c("l_tax")))


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS r, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 2) AS qa, round(avg(l_tax) FILTER (l_returnflag = 'A'), 6) AS ta, min(l_tax) FILTER (l_quantity > 10) AS lo, max(l_tax) FILTER (l_quantity > 10) AS hi, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS sr FROM lineitem GROUP BY 1")
def agg_conditional(t):
    is_r, is_a = c("l_returnflag") == "R", c("l_returnflag") == "A"
    return t("lineitem").summarize(by="l_linestatus", r=agg["countif"](is_r), qa=F.round(agg["sumif"](c("l_quantity"), is_a), 2), ta=F.round(agg["avgif"](c("l_tax"), is_a), 6), lo=agg["minif"](c("l_tax"), c("l_quantity") > 10), hi=agg["maxif"](c("l_tax"), c("l_quantity") > 10), sr=agg["dcountif"](c("l_suppkey"), is_r))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_distinct(t):
    return t("events").summarize(by="event_type", users=agg["dcount"](c("user_id")))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def agg_percentile(t):
    return t("events").summarize(by="event_type", p50=agg["percentile"]("value", 50), p95=agg["percentiles"]("value", 95)[0])


@query("SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS va FROM events GROUP BY 1")
def agg_stats(t):
    return t("events").summarize(by="event_type", sd=F.round(agg["stdev"](c("value")), 6), va=F.round(agg["variance"](c("value")), 4))


@query("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, max(o_totalprice) AS price, arg_min(o_custkey, (o_totalprice, o_orderkey)) AS least FROM orders GROUP BY 1")
def agg_argmax(t):
    return t("orders").summarize(by="o_orderpriority", top=agg["arg_max"](c("o_totalprice"), c("o_orderkey").alias("best"), c("o_totalprice").alias("price"), order=-c("o_orderkey")), low=agg["arg_min"](c("o_totalprice"), c("o_custkey").alias("least"), order=c("o_orderkey")))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY event_id)[1:5], ',') AS types FROM events GROUP BY 1")
def agg_list(t):
    return t("events").summarize(by="user_id", types=F.array_join(agg["make_list"](c("event_type"), 5, order=c("event_id")), ","))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1")
def agg_set(t):
    return t("events").summarize(by="user_id", types=F.array_join(agg["make_set"](c("event_type")), ","))


@query("SELECT event_type, count(DISTINCT cast(user_id % 7 AS VARCHAR)) AS keys FROM events GROUP BY 1")
def agg_bag(t):
    bag = F.create_map((c("user_id") % 7).cast("string"), c("event_type"))
    return t("events").summarize(by="event_type", keys=fn.array_length(F.map_keys(agg["make_bag"](bag))))


@query("SELECT l_linestatus, round_even(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 1) AS r FROM lineitem GROUP BY 1")
def agg_arithmetic(t):
    return t("lineitem").summarize(by="l_linestatus", r=fn.round(100.0 * agg["countif"](c("l_returnflag") == "R") / agg["count"](), 1))


@query("SELECT role, arg_min(text, (conv_id, turn)) AS first_text FROM conversations GROUP BY 1")
def agg_any(t):
    return t("conversations").summarize(by="role", first_text=agg["any"](c("text"), order=F.struct("conv_id", "turn")))


# ---- row order ----


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events")
def win_row_number(t):
    return t("events").sort_by(("ts", "asc"), ("event_id", "asc")).row_number("rn").project("event_id", "rn")


@query("SELECT event_id, lag(user_id) OVER w AS before, lag(user_id, 3, -1) OVER w AS third, lead(event_type, 2) OVER w AS after FROM events WINDOW w AS (ORDER BY ts, event_id)")
def win_prev_next(t):
    return t("events").sort_by(("ts", "asc"), ("event_id", "asc")).prev(before=(c("user_id"),), third=(c("user_id"), 3, -1), after=(c("event_type"), -2)).project("event_id", "before", "third", "after")


@query("SELECT event_id, lead(value) OVER (ORDER BY ts, event_id) AS after FROM events")
def win_next(t):
    return t("events").sort_by(("ts", "asc"), ("event_id", "asc")).next_(after=(c("value"),)).project("event_id", "after")


@query("SELECT event_id, sum(user_id) OVER (ORDER BY ts, event_id) AS so_far FROM events")
def win_cumsum(t):
    return t("events").sort_by(("ts", "asc"), ("event_id", "asc")).row_cumsum("so_far", c("user_id")).project("event_id", "so_far")


@query("SELECT user_id, count(*) AS gaps, max(gap) AS longest FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap > 86400000000 GROUP BY 1")
def win_gap(t):
    rows = t("events").sort_by(("ts", "asc"), ("event_id", "asc")).prev(by=["user_id"], before=(c("ts"),))
    return rows.project("user_id", gap=F.unix_micros("ts") - F.unix_micros("before")).where(c("gap") > 86_400_000_000).summarize(by="user_id", gaps=agg["count"](), longest=agg["max"](c("gap")))


# ---- values within values ----


@query("SELECT doc_id, unnest(string_split(source, '-')) AS part FROM documents")
def mv_expand(t):
    return t("documents").project("doc_id", "source").mv_expand(part=fn.split(c("source"), "-")).project("doc_id", "part")


@query("SELECT event_id, unnest(json_keys(props)) AS k FROM events")
def mv_expand_keys(t):
    return t("events").mv_expand(k=fn.bag_keys(c("props"))).project("event_id", "k")


@query("SELECT event_id, try_cast(props ->> 'k' AS BIGINT) AS k FROM events")
def dynamic_member(t):
    return t("events").project("event_id", k=fn.member(c("props"), "k", kind="bigint"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '(.*?)://(.*?)/(.*)') THEN regexp_extract(url, '(.*?)://(.*?)/(.*)', 1) END AS scheme, CASE WHEN regexp_matches(url, '(.*?)://(.*?)/(.*)') THEN regexp_extract(url, '(.*?)://(.*?)/(.*)', 2) END AS host, CASE WHEN regexp_matches(url, '(.*?)://(.*?)/(.*)') THEN regexp_extract(url, '(.*?)://(.*?)/(.*)', 3) END AS rest FROM pages")
def parse_simple(t):
    return t("pages").parse(c("url"), Capture("scheme"), "://", Capture("host"), "/", Capture("rest")).project("page_id", "scheme", "host", "rest")


@query(r"""SELECT event_id, try_cast(nullif(regexp_extract(props, '"k": ([+-]?\d+)', 1), '') AS BIGINT) AS k FROM events""")
def parse_typed(t):
    return t("events").parse(c("props"), "*", '"k": ', Capture("k", "long"), "*").project("event_id", "k")


@query(r"SELECT c_custkey, nullif(regexp_extract(c_name, '[#]0*(.*)', 1), '') AS n FROM customer")
def parse_regex(t):
    return t("customer").parse(c("c_name"), "[#]0*", Capture("n"), regex=True).project("c_custkey", n=F.nullif(c("n"), F.lit("")))


# ---- functions, one projection a category ----


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS a, length(c_name) AS n, substr(c_name, 3, 4) AS s, upper(c_mktsegment) AS u, instr(c_name, '0') - 1 AS i, length(c_name) - length(replace(c_name, '0', '')) AS z, reverse(c_name) AS r FROM customer")
def fn_string(t):
    x = c("c_name")
    return t("customer").project("c_custkey", a=fn.strcat(x, "/", c("c_mktsegment")), n=fn.strlen(x), s=fn.substring(x, 2, 4), u=fn.toupper(c("c_mktsegment")), i=fn.indexof(x, "0"), z=fn.countof(x, "0"), r=fn.reverse(x))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '\d+') THEN regexp_extract(url, '(\d+)', 1) END AS d, regexp_replace(url, '[0-9]+', '#', 'g') AS w, length(regexp_extract_all(url, '/')) AS slashes FROM pages")
def fn_regex(t):
    return t("pages").project("page_id", d=fn.extract(r"(\d+)", 1, c("url")), w=fn.replace_regex(c("url"), "[0-9]+", "#"), slashes=fn.array_length(fn.extract_all("/", c("url"))))


@query("SELECT page_id, md5(url) AS m, sha256(url) AS h, to_base64(encode(url)) AS b FROM pages")
def fn_hash(t):
    return t("pages").project("page_id", m=fn.hash_md5(c("url")), h=fn.hash_sha256(c("url")), b=fn.base64_encode_tostring(c("url")))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, round_even(s_acctbal, 1) AS r, floor(s_acctbal)::BIGINT AS f, ceil(s_acctbal)::BIGINT AS ce, sign(s_acctbal)::BIGINT AS sg, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 9) END AS q, s_suppkey - (s_suppkey % 7) AS b, floor(s_acctbal / 2.5) * 2.5 AS bf FROM supplier")
def fn_numeric(t):
    x = c("s_acctbal")
    return t("supplier").project("s_suppkey", a=fn.abs(x), r=fn.round(x, 1), f=fn.floor(x), ce=fn.ceiling(x), sg=fn.sign(x), q=F.round(fn.sqrt(x), 9), b=fn.bin(c("s_suppkey"), 7), bf=fn.bin(x, 2.5))


@query("SELECT event_id, date_trunc('day', ts) AS d, date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS w, date_trunc('month', ts) AS m, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS b, hour(ts) AS h, dayofyear(ts) AS y, strftime(ts, '%Y/%m/%d %H:%M') AS f, date_diff('month', TIMESTAMP '2023-11-15', ts) AS dm FROM events")
def fn_datetime(t):
    x = c("ts")
    return t("events").project("event_id", d=fn.startofday(x), w=fn.startofweek(x), m=fn.startofmonth(x), b=fn.bin(x, "6h"), h=fn.hourofday(x), y=fn.dayofyear(x), f=fn.format_datetime(x, "yyyy/MM/dd HH:mm"), dm=fn.datetime_diff("month", x, F.lit("2023-11-15").cast("timestamp")))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 3) + 0.0 AS s, list_contains(embedding, 0.0) AS z FROM embeddings")
def fn_dynamic(t):
    return t("embeddings").project("vec_id", n=fn.array_length(c("embedding")), s=F.round(fn.array_sum(c("embedding")), 3) + 0.0, z=fn.set_has_element(c("embedding"), F.lit(0.0).cast("float")))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS k, CASE WHEN c_nationkey <> 0 THEN 1 ELSE 2 END AS i, coalesce(nullif(c_mktsegment, ''), 'none') AS s FROM customer")
def fn_conditional(t):
    return t("customer").project("c_custkey", k=fn.case(c("c_acctbal") < 0, "debt", c("c_acctbal") < 1000, "low", "high"), i=fn.iif(c("c_nationkey"), 1, 2), s=fn.coalesce(c("c_mktsegment"), "none"))


@query("SELECT o_orderkey, cast(o_orderkey AS VARCHAR) AS s, try_cast(o_orderpriority AS BIGINT) AS n, epoch_us(o_orderdate) AS us, cast(trunc(o_totalprice) AS BIGINT) AS l FROM orders")
def fn_type(t):
    return t("orders").project("o_orderkey", s=fn.tostring(c("o_orderkey")), n=fn.tolong(c("o_orderpriority")), us=fn.tolong(c("o_orderdate")), l=fn.tolong(c("o_totalprice")))


@query("SELECT c_custkey, (10 * 16777216 + c_custkey % 16777216)::BIGINT AS n, true AS p FROM customer")
def fn_ipv4(t):
    x = c("c_custkey")
    octet = lambda k: F.shiftright(x, k).bitwiseAND(F.lit(255))
    address = fn.strcat("10.", octet(16), ".", octet(8), ".", octet(0))
    return t("customer").project("c_custkey", n=fn.parse_ipv4(address), p=fn.ipv4_is_private(address))


@query("SELECT o_orderkey, n, n >> 24 IN (0, 10, 127) OR n >> 28 = 15 OR n >> 20 = 2753 OR n >> 16 IN (43518, 49320) OR n >> 17 = 25353 OR n >> 8 IN (12582914, 12989284, 13303921) OR n >> 3 = 402653184 OR n >> 1 = 1610612821 AS p FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders)")
def fn_ipv4_whole(t):
    x = (c("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    octet = lambda k: F.shiftright(x, k).bitwiseAND(F.lit(255))
    address = fn.strcat(octet(24), ".", octet(16), ".", octet(8), ".", octet(0))
    return t("orders").project("o_orderkey", n=fn.parse_ipv4(address), p=fn.ipv4_is_private(address))


# ---- lets, subqueries, time range ----


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5")
def toscalar_sub(t):
    mean = t("orders").summarize(m=agg["avg"](c("o_totalprice"))).scalar()
    return t("orders").where(c("o_totalprice") > mean * 1.5).project("o_orderkey")


@query("SELECT e.event_type, count(*) AS n FROM events e JOIN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 10) b USING (user_id) GROUP BY 1")
def let_table(t):
    busy = t("events").summarize(by="user_id", k=agg["count"]()).where(c("k") > 10)
    return t("events").join(busy, "user_id", "leftsemi").summarize(by="event_type", n=agg["count"]())


@query("SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1")
def time_range(t):
    stamp = lambda s: F.lit(s).cast("timestamp")
    return t("events").between(stamp("2024-01-05"), stamp("2024-01-12")).summarize(by="event_type", n=agg["count"]())


def print_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.print(spark, a=1, b="x", s=fn.strcat("a", 1)).df


QUERIES["print_row"] = print_row
ORACLES["print_row"] = "SELECT 1 AS a, 'x' AS b, 'a1' AS s"

# ---- the query library ----

for _name, (_build, _sql) in library.OVER_TEST_TABLES.items():
    QUERIES[_name] = lambda spark, sf_dir, f=_build: f(tables(spark, sf_dir)).df
    if _sql:
        ORACLES[_name] = _sql

from . import scalar_queries, store_queries  # noqa: E402, F401
