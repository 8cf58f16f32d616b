"""Scalar functions and value rules, one behaviour each; all expressions run as two queries."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logfathom.functions import values as v
from logfathom.functions.aggregates import AGGREGATES
from logfathom.functions.scalar import SCALARS, fn
from logfathom.operators.table import Table

def ts(s):
    return dt.datetime.fromisoformat(s)


def cases():
    N = F.lit(None)
    T = F.lit("2026-03-15 13:45:10.123456").cast("timestamp")
    NS, NL, ND = N.cast("string"), N.cast("long"), N.cast("double")
    A, B = F.array(*map(F.lit, (3, 1, 2))), F.array(*map(F.lit, (2, 5)))
    return [
        (fn.strcat("a", NS, 1, 2.0, True), "a12true"),
        (fn.strcat_delim("-", "a", NS, "c"), "a--c"),
        (fn.strlen("héß"), 3), (fn.strlen(NS), None), (fn.string_size("hé"), 3),
        (fn.substring("abcdef", 1, 3), "bcd"), (fn.substring("abcdef", -2), "ef"), (fn.substring("abc", 0, -1), ""),
        (fn.toupper("aé"), "AÉ"), (fn.tolower("AÉ"), "aé"),
        (fn.trim("  x "), "x"), (fn.trim("-+", "--x--"), "x"), (fn.trim_start("a", "aab"), "ab"), (fn.trim_end("b+", "abb"), "a"),
        (fn.split("a,b,,c", ","), ["a", "b", "", "c"]), (fn.split("a,b", ",", 5), None), (fn.split("a,b", ",", -1), "b"),
        (fn.strrep("ab", 3), "ababab"), (fn.strrep("ab", 2, "-"), "ab-ab"), (fn.strrep("ab", -1), ""),
        (fn.replace_string("a.b", ".", "$"), "a$b"), (fn.replace_regex("2026-03", r"(\d+)-(\d+)", r"\2/\1"), "03/2026"), (fn.replace_regex("a", "(", "b"), "a"),
        (fn.indexof("abcabc", "c"), 2), (fn.indexof("abcabc", "c", 3), 5), (fn.indexof("abc", "z"), -1),
        (fn.countof("aaa", "a"), 3), (fn.countof("a1b22", r"\d+", "regex"), 2),
        (fn.extract(r"(\d+)", 1, "ab12"), "12"), (fn.extract(r"(\d+)", 1, "ab"), None), (fn.extract_all(r"\d", "1a2"), ["1", "2"]), (fn.extract_all(r"(?P<k>\w)=", "a=1 b=2"), ["a", "b"]),
        (fn.reverse("abc"), "cba"), (fn.strcmp("a", "b"), -1), (fn.strcmp("b", "b"), 0),
        (fn.url_decode("a%20b+c"), "a b+c"), (fn.url_decode("%zz"), "%zz"), (fn.url_encode("a b*~"), "a%20b%2A~"),
        (fn.base64_encode_tostring("hé"), "aMOp"), (fn.base64_decode_tostring("aMOp"), "hé"), (fn.base64_decode_tostring("!!"), None), (fn.base64_decode_tostring("YQ"), "a"),
        (fn.parse_url("https://u:p@H.org:81/a/b?x=1&y=%20#f")["Host"], "h.org"), (fn.parse_url("https://u:p@h.org:81/a")["Port"], "81"), (fn.parse_url("https://h/a?x=1&x=2#f")["Query Parameters"], {"x": "2"}),
        (fn.parse_urlquery("a=1&b=%41")["Query Parameters"], {"a": "1", "b": "A"}),
        (fn.parse_path("/var/log/sys.log.1")["Filename"], "sys.log.1"), (fn.parse_path("/var/log/sys.log")["Extension"], "log"), (fn.parse_path("/var/log/x")["DirectoryName"], "log"),
        (fn.basename("/a/b/"), "b"), (fn.dirname("/a/b"), "/a"), (fn.dirname("/a"), "/"),
        (fn.entropy("aabb"), 1.0), (fn.entropy(""), 0.0),
        (fn.abs(-2), 2.0), (fn.exp(F.lit(1e9)), None), (fn.exp2(3), 8.0), (fn.exp10(2), 100.0), (fn.log(0), None), (fn.log10(100), 2.0), (fn.log2(8), 3.0), (fn.sqrt(-1), None), (fn.sqrt(9), 3.0),
        (fn.ceiling(1.2), 2), (fn.floor(-1.2), -2), (fn.floor(7, 5), 5), (fn.round(2.5), 2), (fn.round(2.345, 2), 2.34), (fn.sign(-3.5), -1), (fn.pow(2, 10), 1024.0), (fn.pow(-8, 0.5), None),
        (fn.bin(-7, 5), -10), (fn.bin(7.5, 2), 6.0), (fn.bin(T, "1h"), ts("2026-03-15T13:00:00")), (fn.bin(T, "1d"), ts("2026-03-15")), (fn.bin_at(7, 5, 1), 6.0),
        (fn.max_of(1, NL, 3), 3), (fn.min_of(4, 2), 2), (fn.isnan(F.lit(math.nan)), True), (fn.isnan(ND), False), (fn.isinf(F.lit(math.inf)), True), (fn.isfinite(1.0), True), (fn.isfinite(ND), False),
        (fn.binary_and(12, 10), 8), (fn.binary_or(12, 10), 14), (fn.binary_xor(12, 10), 6), (fn.binary_not(0), -1), (fn.binary_shift_left(1, 4), 16), (fn.binary_shift_right(16, 3), 2), (fn.bitset_count_ones(-7), 3),
        (fn.tohex(255), "ff"), (fn.tohex(-255, 4), "-00ff"),
        (fn.datetime_add("month", 1, F.lit("2026-01-31").cast("timestamp")), ts("2026-02-28")), (fn.datetime_add("eon", 1, T), None),
        (fn.datetime_diff("day", T, F.lit("2026-03-13 14:00:00").cast("timestamp")), 1), (fn.datetime_diff("month", T, F.lit("2026-02-28").cast("timestamp")), 1), (fn.datetime_diff("year", T, F.lit("2025-12-31").cast("timestamp")), 1),
        (fn.datetime_part("quarter", T), 1), (fn.datetime_part("millisecond", T), 123), (fn.datetime_part("microsecond", T), 123456), (fn.datetime_part("x", T), None),
        (fn.startofday(T), ts("2026-03-15")), (fn.startofweek(T), ts("2026-03-15")), (fn.startofmonth(T, 1), ts("2026-04-01")), (fn.startofyear(T), ts("2026-01-01")),
        (fn.endofday(T), ts("2026-03-15T23:59:59.999999")), (fn.endofweek(T), ts("2026-03-21T23:59:59.999999")), (fn.endofmonth(T), ts("2026-03-31T23:59:59.999999")), (fn.endofyear(T, -1), ts("2025-12-31T23:59:59.999999")),
        (fn.getyear(T), 2026), (fn.getmonth(T), 3), (fn.monthofyear(T), 3), (fn.dayofmonth(T), 15), (fn.dayofyear(T), 74), (fn.hourofday(T), 13), (fn.weekofyear(T), 11), (v.micros(fn.dayofweek(T)), 0),
        (fn.format_datetime(T, "yyyy-MM-dd HH:mm:ss.fff dddd x"), "2026-03-15 13:45:10.123 Sunday x"), (fn.format_timespan(fn.make_timespan(25, 1, 2.5)), "1.01:01:02.5000000"), (fn.format_timespan(fn.make_timespan(-1, 0)), "-01:00:00"),
        (fn.make_datetime(2026, 2, 30), None), (fn.make_datetime(2026, 2, 3, 4, 5, 6.5), ts("2026-02-03T04:05:06.5")),
        (fn.unixtime_seconds_todatetime(1.5), ts("1970-01-01T00:00:01.5")), (fn.unixtime_milliseconds_todatetime(1500), ts("1970-01-01T00:00:01.5")), (fn.unixtime_nanoseconds_todatetime(1_500_000_000), ts("1970-01-01T00:00:01.5")), (fn.unixtime_microseconds_todatetime(5), ts("1970-01-01T00:00:00.000005")),
        (fn.array_length(A), 3), (fn.array_length(N.cast("array<int>")), None), (fn.array_index_of(A, 1), 1), (fn.array_index_of(A, 9), -1), (fn.array_slice(A, 1, -1), [1, 2]), (fn.array_slice(A, -2, -2), [1]), (fn.array_concat(A, B), [3, 1, 2, 2, 5]),
        (fn.array_sum(A), 6.0), (fn.array_sort_asc(A), [1, 2, 3]), (fn.array_sort_desc(A), [3, 2, 1]), (fn.array_reverse(A), [2, 1, 3]),
        (fn.bag_keys('{"b": 1, "a": 2}'), ["b", "a"]), (fn.bag_has_key('{"b": 1}', "b"), True), (fn.bag_has_key("x", "b"), False), (fn.pack("a", 1, "b", "x"), '{"a":1,"b":"x"}'), (fn.pack_array(1, 2), [1, 2]),
        (fn.set_has_element(A, 3), True), (fn.set_has_element(N.cast("array<int>"), 3), False), (fn.set_union(A, B), [3, 1, 2, 5]), (fn.set_intersect(A, B), [2]), (fn.set_difference(A, B), [3, 1]),
        (F.to_json(fn.parse_json('{"b":1,"a":[2]}')), '{"a":[2],"b":1}'), (F.to_json(fn.parse_json("x y")), '"x y"'), (fn.member('{"a":{"b":[1,2]}}', "a", "b", 1, kind="bigint"), 2), (fn.member("nope", "a"), None),
        (fn.iif(0, "a", "b"), "b"), (fn.iff("x", 1, 2), 1), (fn.case(False, 1, "t", 2, 3), 2), (fn.case(False, 1), None), (fn.coalesce(NS, "", "x"), "x"),
        (fn.isnull(NS), True), (fn.isnotnull(1), True), (fn.notnull(NS), False), (fn.isempty(""), True), (fn.isnotempty("a"), True), (fn.notempty(NS), False),
        (fn.gettype(1), "long"), (fn.gettype(1.5), "real"), (fn.gettype("a"), "string"), (fn.gettype(T), "datetime"), (fn.gettype(A), "dynamic"), (fn.gettype(NS), "null"), (fn.gettype(True), "bool"),
        (fn.tostring(2.0), "2"), (fn.tostring(2.5), "2.5"), (fn.tostring(NS), ""), (fn.tostring(T), "2026-03-15 13:45:10.123456"), (fn.tostring(A), "[3,1,2]"), (fn.tostring("2.0"), "2.0"),
        (fn.tolong("0x1F"), 31), (fn.tolong("12.9"), 12), (fn.tolong("x"), None), (fn.tolong(T), 1773582310123456), (fn.toint(True), 1), (fn.tolong("0b101"), 5),
        (fn.todouble("1.5"), 1.5), (fn.toreal("x"), None), (fn.toreal(T), None), (fn.tobool("yes"), True), (fn.tobool(0), False), (fn.toboolean("q"), None),
        (fn.todatetime("2026-03-15T13:45:10Z"), ts("2026-03-15T13:45:10")), (fn.todatetime("2026-03-15 13:45:10,5 +01:00"), ts("2026-03-15T12:45:10.5")), (fn.todatetime("15/Mar/2026:13:45:10 +0000"), ts("2026-03-15T13:45:10")), (fn.todatetime("x"), None), (fn.todatetime(5), ts("1970-01-01T00:00:00.000005")),
        (v.micros(fn.totimespan("1.02:03:04")), 93784000000), (v.micros(fn.totimespan("90m")), 5400000000), (v.micros(fn.totimespan(10)), 1), (fn.totimespan("x"), None),
        (fn.hash_md5("a"), "0cc175b9c0f1b6a831c399e269772661"), (fn.hash_sha1("a"), "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"), (F.substring(fn.hash_sha256("a"), 1, 8), "ca978112"), (fn.hash("a", 10).between(0, 9), True),
        (fn.parse_ipv4("10.0.0.1"), 167772161), (fn.parse_ipv4("10.0.0.01"), None), (fn.ipv4_is_private("192.168.1.1"), True), (fn.ipv4_is_private("8.8.8.8"), False), (fn.ipv4_is_private("x"), None),
        (fn.ipv4_is_in_range("10.1.2.3", "10.0.0.0/8"), True), (fn.ipv4_is_match("10.0.0.1", "10.0.0.9", 24), True), (fn.ipv4_compare("1.1.1.1", "1.1.1.2"), -1), (fn.ipv6_is_match("::ffff:1.2.3.4", "1.2.3.4"), True),
        # value rules
        (v.eq(NL, 1), False), (v.ne(NL, 1), False), (v.eq_fold("É", "é"), True), (v.not_in(NL, 1), True), (v.is_in("A", "a", fold=True), True), (v.between(NL, 1, 2), False), (v.not_between(NL, 1, 2), False), (v.not_between(3, 1, 2), True),
        (v.has("an error_code: 5", "error"), True), (v.has("errors", "error"), False), (v.has("a-b c", "b c"), True), (v.has("x", "--"), False), (v.has_any("one two", "x", "two"), True), (v.has_all("one two", "two", "one"), True), (v.has_all(NS, "two"), False),
        (v.hasprefix("my error", "err"), True), (v.hasprefix("my error", "err-"), False), (v.hassuffix("my error", "ror"), True), (v.contains("ABC", "b"), True), (v.contains("ABC", "b", fold=False), False), (v.startswith("ABC", "ab"), True), (v.endswith("ABC", "bc"), True), (v.contains(NS, ""), False),
        (v.matches("aé1", r"\w{3}"), True), (v.idiv(-7, 2), -4), (v.mod(-7, 3), 2), (v.mod(7, -3), -2), (v.idiv(1, 0), None), (v.div(7.0, 2), 3.5), (v.add(F.lit(2**62), F.lit(2**62)), None),
        (v.truthy(0), False), (v.truthy("a"), True), (v.truthy(""), False), (v.truthy(NS), False), (v.truthy(T), True), (v.truthy(F.array()), False),
    ]


def test_functions(spark):
    found, own = [], cases()
    for k in range(0, len(own), 60):
        found += list(spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(own[k : k + 60]))).first())
    same = [got == (pytest.approx(want) if isinstance(want, float) else want) for got, (_, want) in zip(found, own, strict=True)]
    assert not [(str(c), got, want) for ok, got, (c, want) in zip(same, found, own, strict=True) if not ok]


def test_every_function_is_there():
    assert len(SCALARS) >= 130
    assert len(AGGREGATES) >= 28


def test_bad_patterns_are_refused():
    with pytest.raises(ValueError):
        v.java_pattern("(")
    with pytest.raises(ValueError):
        v.java_pattern("a" * 3000)


def test_aggregates_of_known_types_have_no_text(spark):
    """Numbers are summed as they are; text, where a column has it, is still read."""
    df = spark.createDataFrame([(1, 2.5, Decimal("1.5"), "3", True), (2, float("nan"), None, "x", False), (None, float("inf"), Decimal("2"), None, None)], "n long, d double, m decimal(10,2), s string, b boolean")
    agg = AGGREGATES
    sums = {f"{f}_{c}": agg[f](F.col(c)) for f in ("sum", "avg", "stdev", "variance") for c in ("n", "d", "m")} | {f"{f}_{c}": agg[f](F.col(c), F.col("b")) for f in ("sumif", "avgif", "minif", "maxif", "dcountif") for c in ("n", "d", "m")} | {"countif_b": agg["countif"](F.col("b")), "countif_n": agg["countif"](F.col("n"))}
    known = Table(df).summarize(**sums).df
    assert "as string" not in known._jdf.queryExecution().optimizedPlan().toString().lower()
    general = df.agg(*(x.alias(k) for k, x in sums.items()))
    assert known.first().asDict() == general.first().asDict()
    assert Table(df).summarize(s=agg["sum"](F.col("s")), a=agg["avg"](F.col("s"))).df.first()[:] == (3.0, 3.0)


def test_sums_and_membership_by_type(spark):
    t = Table(spark.createDataFrame([("a", 2, [1], dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 3), Decimal("1"))], "s string, n int, l array<int>, d date, t timestamp, m decimal(5,1)"))
    got = t.project(a=v.add(F.col("s"), F.col("s")), b=v.add(F.col("s"), F.col("n")), c=v.add(F.col("n"), F.col("m")), d=v.add(F.col("l"), F.col("n")), e=v.add(v.add(F.col("s"), F.col("s")), F.col("n")), f=v.add(F.col("t"), F.lit(dt.timedelta(hours=1))), g=v.add(F.col("d"), F.col("t"))).df.first()
    assert got[:] == ("aa", "a2", 3, None, "aa2", dt.datetime(2024, 1, 1, 4), None)
    ins = t.df.select(v.is_in(F.col("d"), None, dt.date(2024, 1, 1)), v.is_in(F.col("n"), Decimal(2), dt.date(2024, 1, 1), "x", None), v.is_in(F.col("t"), dt.date(2023, 1, 1), dt.datetime(2024, 1, 1, 3)), v.is_in(F.col("s"), None), v.is_in(F.col("d"), 1, "2024", dt.datetime(2024, 1, 1))).first()
    assert ins[:] == (True, True, True, False, True)


def test_bags_keep_the_last_value(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"b": "3", "c": None}), (3, {"a": "9"}), (4, None)], "k int, m map<string,string>")
    bag = lambda *a: df.agg(F.map_entries(AGGREGATES["make_bag"](F.col("m"), *a, order=F.col("k"))).alias("x")).first()[0]
    assert [tuple(x) for x in bag()] == [("b", "3"), ("c", None), ("a", "9")] and [tuple(x) for x in bag(2)] == [("b", "3"), ("c", None)]
    many = spark.range(20_000).select((F.col("id") % 9000).cast("string").alias("k"), F.col("id").alias("i")).agg(F.size(AGGREGATES["make_bag"](F.create_map("k", F.col("i").cast("string")), 100_000, order=F.col("i"))).alias("n"))
    assert many.first()[0] == 9000
