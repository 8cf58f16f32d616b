"""Wide projections over the test tables: one query for a group of functions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import values as v
from .functions.aggregates import AGGREGATES as agg
from .functions.scalar import fn
from .queries import query

c = F.col


@query(r"""SELECT c_custkey, concat_ws('-', c_name, c_mktsegment) AS sd, strlen(c_name) AS sz, lower(c_name) AS lo, regexp_replace(regexp_replace(c_name, '^[C0]+', ''), '[C0]+$', '') AS tr, regexp_replace(c_name, '^Cust', '') AS ts, regexp_replace(c_name, '0+$', '') AS te,
c_mktsegment || '|' || c_mktsegment AS rp, replace(c_name, 'Customer', 'c') AS rs, CASE WHEN c_name > c_mktsegment THEN 1 WHEN c_name < c_mktsegment THEN -1 ELSE 0 END::BIGINT AS sc, url_encode(c_name || ' ' || c_mktsegment) AS ue, c_name || ' %' AS ud, c_name AS b64, round(list_entropy(string_split(c_name, '')), 6) AS en FROM customer""")
def fn_text(t):
    n, m = c("c_name"), c("c_mktsegment")
    return t("customer").project("c_custkey", sd=fn.strcat_delim("-", n, m), sz=fn.string_size(n), lo=fn.tolower(n), tr=fn.trim("[C0]+", n), ts=fn.trim_start("Cust", n), te=fn.trim_end("0+", n), rp=fn.strrep(m, 2, "|"), rs=fn.replace_string(n, "Customer", "c"), sc=fn.strcmp(n, m), ue=fn.url_encode(fn.strcat(n, " ", m)), ud=fn.url_decode(fn.url_encode(fn.strcat(n, " %"))), b64=fn.base64_decode_tostring(fn.base64_encode_tostring(n)), en=F.round(fn.entropy(n), 6))


@query(r"""SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS b, regexp_extract(regexp_replace(url, '/+$', ''), '^(.*)/[^/]*$', 1) AS d, regexp_extract(url, '^([A-Za-z]+):', 1) AS sc, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1) AS p, regexp_extract(url, '#(.*)$', 1) AS f,
nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&]*)', 1), '') AS ref, 'n' || page_id || '.tar' AS file, 'tar' AS ext, '/var/log' AS folder, 'log' AS last FROM pages""")
def fn_paths(t):
    u = fn.parse_url(c("url"))
    own = fn.parse_path(fn.strcat("/var/log/n", c("page_id"), ".tar"))
    return t("pages").project("page_id", b=fn.basename(c("url")), d=fn.dirname(c("url")), sc=u["Scheme"], h=u["Host"], p=u["Path"], f=u["Fragment"], page=u["Query Parameters"]["page"], ref=fn.parse_urlquery(c("url"))["Query Parameters"]["ref"], file=own["Filename"], ext=own["Extension"], folder=own["DirectoryPath"], last=own["DirectoryName"])


@query("""SELECT s_suppkey, round(exp(s_acctbal / 10000), 9) AS e, round(pow(2, s_acctbal / 10000), 9) AS e2, round(pow(10, s_acctbal / 10000), 9) AS e10, CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal), 9) END AS l, CASE WHEN s_acctbal > 0 THEN round(log2(s_acctbal), 9) END AS l2, CASE WHEN s_acctbal > 0 THEN round(log10(s_acctbal), 9) END AS l10, round(pow(s_acctbal / 100, 2), 6) AS p,
false AS nan, false AS inf, true AS fin, greatest(s_acctbal, 500.0) AS hi, least(s_acctbal, 500.0) AS lo, floor((s_acctbal - 30) / 100) * 100 + 30 AS ba FROM supplier""")
def fn_math(t):
    x = c("s_acctbal")
    y, r = x / 10000, lambda e: F.round(e, 9)
    return t("supplier").project("s_suppkey", e=r(fn.exp(y)), e2=r(fn.exp2(y)), e10=r(fn.exp10(y)), l=r(fn.log(x)), l2=r(fn.log2(x)), l10=r(fn.log10(x)), p=F.round(fn.pow(x / 100, 2), 6), nan=fn.isnan(x), inf=fn.isinf(x), fin=fn.isfinite(x), hi=fn.max_of(x, 500.0), lo=fn.min_of(x, 500.0), ba=fn.bin_at(x, 100, 30))


@query("""SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 12 AS o, xor(o_orderkey, 12) AS x, ~o_orderkey AS n, o_orderkey << 3 AS l, o_orderkey >> 1 AS r, bit_count(o_orderkey)::BIGINT AS b, lower(to_hex(o_orderkey)) AS h, lpad(lower(to_hex(o_orderkey)), 9, '0') AS h9 FROM orders""")
def fn_bits(t):
    x = c("o_orderkey")
    return t("orders").project("o_orderkey", a=fn.binary_and(x, 12), o=fn.binary_or(x, 12), x=fn.binary_xor(x, 12), n=fn.binary_not(x), l=fn.binary_shift_left(x, 3), r=fn.binary_shift_right(x, 1), b=fn.bitset_count_ones(x), h=fn.tohex(x), h9=fn.tohex(x, 9))


@query("""SELECT event_id, ts + INTERVAL 2 MONTH AS a, minute(ts) AS mi, date_trunc('year', ts) AS sy, date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS ed, date_trunc('week', ts + INTERVAL 1 DAY) + INTERVAL 6 DAY - INTERVAL 1 MICROSECOND AS ew, date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS em, date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND AS ey,
year(ts) AS y, month(ts) AS m, day(ts) AS d, month(ts) AS m2, week(ts) AS w, dayofweek(ts) * 86400000000 AS dw, make_timestamp(2024, month(ts), 1, 0, 0, 0.0) AS md, make_timestamp(event_id * 1000000000) AS us, make_timestamp(event_id * 1000) AS um, make_timestamp(event_id) AS uu, make_timestamp(event_id) AS un, ts AS back, true AS later, true AS ago FROM events""")
def fn_times(t):
    x, k = c("ts"), c("event_id")
    return t("events").project(
        "event_id", a=fn.datetime_add("month", 2, x), mi=fn.datetime_part("minute", x), sy=fn.startofyear(x), ed=fn.endofday(x), ew=fn.endofweek(x), em=fn.endofmonth(x), ey=fn.endofyear(x), y=fn.getyear(x), m=fn.getmonth(x), d=fn.dayofmonth(x), m2=fn.monthofyear(x), w=fn.weekofyear(x), dw=v.micros(fn.dayofweek(x)),
        md=fn.make_datetime(2024, fn.getmonth(x), 1), us=fn.unixtime_seconds_todatetime(k * 1000), um=fn.unixtime_milliseconds_todatetime(k), uu=fn.unixtime_microseconds_todatetime(k), un=fn.unixtime_nanoseconds_todatetime(k * 1000 + 500), back=fn.todatetime(fn.tostring(x)), later=fn.now() > x, ago=fn.ago("1d") < fn.now(),
    )


@query("""SELECT event_id, CASE WHEN event_id % 50 >= 24 THEN (event_id % 50 // 24) || '.' ELSE '' END || lpad((event_id % 50 % 24)::VARCHAR, 2, '0') || ':30:00' AS s, (event_id % 50) * 3600000000 + 1800000000 AS us, (event_id % 24) * 3600000000 + 900000000 AS back FROM events""")
def fn_spans(t):
    k = c("event_id")
    span = fn.make_timespan(k % 50, 30)
    return t("events").project("event_id", s=fn.format_timespan(span), us=v.micros(span), back=v.micros(fn.totimespan(fn.strcat(k % 24, ":15"))))


@query("""SELECT event_id, list_position([user_id, event_id % 5, 3], 3) - 1 AS ix, array_to_string([user_id, event_id % 5], ',') AS sl, array_to_string([user_id, event_id % 5, 3, 7, 3], ',') AS co, array_to_string(list_sort([user_id, event_id % 5, 3]), ',') AS up, array_to_string(list_reverse_sort([user_id, event_id % 5, 3]), ',') AS down, array_to_string([3, event_id % 5, user_id], ',') AS rv,
array_to_string(list_sort(list_distinct([user_id, event_id % 5, 3, 7, 3])), ',') AS un, array_to_string(list_sort(list_distinct(list_filter([user_id, event_id % 5, 3], lambda x: x IN (7, 3)))), ',') AS ic, array_to_string(list_sort(list_distinct(list_filter([user_id, event_id % 5, 3], lambda x: x NOT IN (7, 3)))), ',') AS df FROM events""")
def fn_lists(t):
    a, b = fn.pack_array(c("user_id"), c("event_id") % 5, F.lit(3).cast("bigint")), fn.pack_array(F.lit(7).cast("bigint"), F.lit(3).cast("bigint"))
    line = lambda x: F.array_join(x.cast("array<string>"), ",")
    return t("events").project("event_id", ix=fn.array_index_of(a, F.lit(3).cast("bigint")), sl=line(fn.array_slice(a, 0, 1)), co=line(fn.array_concat(a, b)), up=line(fn.array_sort_asc(a)), down=line(fn.array_sort_desc(a)), rv=line(fn.array_reverse(a)), un=line(F.sort_array(fn.set_union(a, b))), ic=line(F.sort_array(fn.set_intersect(a, b))), df=line(F.sort_array(fn.set_difference(a, b))))


@query("""SELECT event_id, json_exists(props, '$.k') AS h, '{"a":' || user_id || ',"b":"' || event_type || '"}' AS p, try_cast(props ->> 'k' AS BIGINT) AS k, try_cast(props ->> 'k' AS BIGINT) AS k2 FROM events""")
def fn_objects(t):
    return t("events").project("event_id", h=fn.bag_has_key(c("props"), "k"), p=fn.pack("a", c("user_id"), "b", c("event_type")), k=F.try_variant_get(fn.parse_json(c("props")), "$.k", "bigint"), k2=F.try_variant_get(fn.todynamic(c("props")), "$.k", "bigint"))


@query("""SELECT o_orderkey, s IS NULL AS a, s IS NOT NULL AS b, s IS NOT NULL AS b2, s IS NULL AS e, s IS NOT NULL AS n, s IS NOT NULL AS n2, 'long' AS g1, 'real' AS g2, coalesce('string', s) AS g3, 'datetime' AS g4, o_orderkey AS i, o_orderkey + 0.5 AS d, o_orderkey + 0.5 AS r, o_orderstatus = 'F' AS f, o_orderstatus = 'F' AS f2, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE 'y' END AS w FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders)""")
def fn_types(t):
    s, k = F.nullif(c("o_orderstatus"), F.lit("F")), fn.tostring(c("o_orderkey"))
    word = F.when(c("o_orderstatus") == "F", "yes").otherwise("off")
    return t("orders").project("o_orderkey", a=fn.isnull(s), b=fn.isnotnull(s), b2=fn.notnull(s), e=fn.isempty(s), n=fn.isnotempty(s), n2=fn.notempty(s), g1=fn.gettype(c("o_orderkey")), g2=fn.gettype(c("o_totalprice")), g3=fn.gettype(c("o_orderpriority")), g4=fn.gettype(c("o_orderdate")), i=fn.toint(fn.strcat("0x", fn.tohex(c("o_orderkey")))), d=fn.todouble(fn.strcat(k, ".5")), r=fn.toreal(fn.strcat(k, ".5")), f=fn.tobool(word), f2=fn.toboolean(word), w=fn.iff(word == "yes", "x", "y"))


@query("""SELECT o_orderkey, n >> 20 = 2753 AS r, n >> 16 = m >> 16 AS m16, sign(n - m)::BIGINT AS cmp, true AS v6 FROM (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n, (o_orderkey * 2654435761 + o_orderkey) % 4294967296 AS m FROM orders)""")
def fn_addresses(t):
    octet = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(255))
    address = lambda x: fn.strcat(*(y for k in (24, 16, 8, 0) for y in (octet(x, k), "."))).substr(F.lit(1), F.length(fn.strcat(*(y for k in (24, 16, 8, 0) for y in (octet(x, k), ".")))) - 1)
    own = c("o_orderkey") * F.lit(2654435761)
    a, b = address(own % F.lit(4294967296)), address((own + c("o_orderkey")) % F.lit(4294967296))
    return t("orders").project("o_orderkey", r=fn.ipv4_is_in_range(a, "172.16.0.0/12"), m16=fn.ipv4_is_match(a, b, 16), cmp=fn.ipv4_compare(a, b), v6=fn.ipv6_is_match(a, fn.strcat("::ffff:", a)))


@query("SELECT page_id, sha1(url) AS s, true AS small, true AS same FROM pages")
def fn_hashes(t):
    h = fn.hash(c("url"), 100)
    return t("pages").project("page_id", s=fn.hash_sha1(c("url")), small=h.between(0, 99), same=fn.hash(c("url")) == fn.hash(fn.strcat(c("url"), "")))


@query("SELECT count(*) AS n FROM events")
def fn_rand(t):
    return t("events").where(fn.rand() < 1.0, fn.rand() >= 0.0, fn.rand(5).between(0, 4)).summarize(n=agg["count"]())


# ---- comparisons, text search, arithmetic ----


@query("""SELECT event_id, false AS eq, true AS ne, event_id IN (3, 5) AS mem, true AS no, false AS btw, true AS nb, false AS lt, value >= user_id AS ge, value = 2 AS same, event_type IN ('error', 'click') AS txt FROM events""")
def cmp_mixed_types(t):
    x, s = c("event_id"), c("event_type")
    return t("events").project("event_id", eq=v.eq(s, 1), ne=v.ne(s, 1), mem=v.is_in(x, 3, 5, "7"), no=v.not_in(s, 1, 2), btw=v.between(s, 1, 2), nb=v.not_between(s, 1, 2), lt=v.lt(s, 5), ge=v.ge(c("value"), c("user_id")), same=v.eq(c("value"), 2), txt=v.is_in(s, "error", "click", 4))


@query("SELECT event_id, event_type || ':' AS a, 'n' || event_id AS b, event_id + 1 AS d, event_id - 3 AS e, event_id * 2 AS f FROM events")
def add_text(t):
    x = c("event_id")
    return t("events").project("event_id", a=v.add(c("event_type"), ":"), b=v.add("n", x), d=v.add(x, 1), e=v.sub(x, 3), f=v.mul(x, 2))


@query("SELECT event_id, ((event_id - 500) - (((event_id - 500) % 7) + 7) % 7) // 7 AS q, (((event_id - 500) % 7) + 7) % 7 AS m, 1152921504606846977 + event_id AS one, value / 4 AS r, floor((event_id - 500) / 7)::DOUBLE AS d FROM events")
def div_long(t):
    x = c("event_id") - 500
    return t("events").project("event_id", q=v.idiv(x, 7), m=v.mod(x, F.lit(7)), one=v.idiv(F.lit(2**60 + 1) + c("event_id"), 1), r=v.div(c("value"), F.lit(4.0)), d=v.div(x, F.lit(7).cast("bigint")))


@query(r"""SELECT doc_id, regexp_matches(text, '(^|[^0-9A-Za-z])(?i:th)') AS p, regexp_matches(text, '(?i:ing)([^0-9A-Za-z]|$)') AS s, regexp_matches(text, '(^|[^0-9A-Za-z])(?i:and|der)([^0-9A-Za-z]|$)') AS a, regexp_matches(text, '(^|[^0-9A-Za-z])(?i:the)([^0-9A-Za-z]|$)') AND regexp_matches(text, '(^|[^0-9A-Za-z])(?i:of)([^0-9A-Za-z]|$)') AS l, lower(lang) = 'en' AS f, lower(lang) <> 'en' AS nf, lower(lang) IN ('en', 'de') AS i FROM documents""")
def search_terms(t):
    x = c("text")
    return t("documents").project("doc_id", p=v.hasprefix(x, "TH"), s=v.hassuffix(x, "ING"), a=v.has_any(x, "and", "DER"), l=v.has_all(x, "the", "OF"), f=v.eq_fold(c("lang"), "EN"), nf=v.ne_fold(c("lang"), "EN"), i=v.is_in(c("lang"), "EN", "De", fold=True))


# ---- tables and aggregates ----


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def project_keep(t):
    return t("orders").project_keep("o_order*").project_away("o_orderdate").render("table", title="orders")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS rn, value * 2 AS twice FROM events")
def serialize_rows(t):
    return t("events").sort_by("event_id").serialize(twice=c("value") * 2).row_number("rn").project("event_id", "rn", "twice")


@query("SELECT name, n FROM (SELECT n_name AS name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) GROUP BY 1) WHERE n >= 1")
def union_midway(t):
    return t("nation").project(name=c("n_name")).union(t("region").project(name=c("r_name"))).summarize(by="name", n=agg["count"]()).where(c("n") >= 1)


@query("""SELECT event_type, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, min(event_id) AS one, min(event_id) FILTER (value > 50) AS late, array_to_string(list(event_id ORDER BY event_id) FILTER (value > 50)[1:4], ',') AS items, array_to_string(list_sort(list(DISTINCT user_id % 5) FILTER (value > 50)), ',') AS kinds, any_value(event_type) AS kept FROM events GROUP BY 1""")
def agg_more(t):
    x, k, late = c("value"), c("event_id"), c("value") > 50
    line = lambda a: F.array_join(a.cast("array<string>"), ",")
    return t("events").summarize(by="event_type", users=agg["count_distinct"](c("user_id")), mean=F.round(agg["average"](x), 6), one=agg["take_any"](k, order=k), late=agg["anyif"](k, late, order=k), items=line(agg["make_list_if"](k, late, 4, order=k)), kinds=line(agg["make_set_if"](c("user_id") % 5, late)), kept=agg["any"](c("event_type")))


@query("SELECT event_type, arg_max(user_id, event_id) AS user_id, arg_max(value, event_id) AS value, max(event_id) AS id FROM events GROUP BY 1")
def agg_struct_stays(t):
    rows = t("events").summarize(by="event_type", last=agg["arg_max"](c("event_id"), c("user_id"), c("value")), pair=agg["any"](F.struct(c("event_id").alias("id"), c("user_id").alias("u")), order=-c("event_id")))
    return rows.project("event_type", "user_id", "value", id=c("pair")["id"])
