"""Builder, expressions, rewrites and plans on the cases that the standard tables lack."""

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest

from tessera.errors import EngineError
from tessera.functions.aggregates import Avg, Count, DistinctCount, Max, Min, Sum
from tessera.functions.expressions import (
    AddConst, CaseWhen, Cast, Col, ExtractMinute, Length, Literal, RegexpReplace, Round, TimeTrunc,
)
from tessera.functions.patterns import java_pattern, java_replacement
from tessera.functions.predicates import And, Eq, Greater, GreaterEq, In, Less, LessEq, Like, NotEq, NotLike, Or
from tessera.operators.frame import Frame
from tessera.session import prepare


@pytest.fixture(scope="module")
def hits(spark):
    prepare(spark)
    rows = [
        (1, 30_000, 2**62, "", "2013-07-01", "2013-07-01 23:59:59.5", 1.5),
        (2, 30_000, 2**62, "abc", "1969-12-31", "1969-12-31 23:59:58", -0.0),
        (3, -5, 2**62, "b_d", "2012-02-29", "2012-02-29 12:34:56", 0.0),
        (4, 7, -(2**62), "Привет", "2013-12-31", "2013-12-31 00:00:00", float("nan")),
    ]
    rows = [(a, b, c, d, dt.date.fromisoformat(e), dt.datetime.fromisoformat(f), g) for a, b, c, d, e, f, g in rows]
    return Frame(spark.createDataFrame(rows, "id int, small smallint, big bigint, s string, day date, ts timestamp_ntz, x double"))


def ids(frame):
    return sorted(frame.result("id"))


def test_predicates(hits):
    assert ids(hits.filter(NotEq("s", ""))) == [2, 3, 4]
    assert ids(hits.filter(Eq("s", ""))) == [1]
    assert ids(hits.filter(And(Greater("id", 1), Less("id", 4)))) == [2, 3]
    assert ids(hits.filter(GreaterEq("id", 3) | LessEq("id", 1))) == [1, 3, 4]
    assert ids(hits.filter(In("id", [1, 4, 9]))) == [1, 4]
    assert ids(hits.filter(GreaterEq("day", "2013-01-01") & LessEq("day", dt.date(2013, 7, 31)))) == [1]
    assert ids(hits.filter(Less("ts", "1970-01-01"))) == [2]
    assert ids(hits.filter(Like("s", "%b%"))) == [2, 3] and ids(hits.filter(NotLike("s", "%b%"))) == [1, 4]
    assert ids(hits.filter(Like("s", "ab%"))) == [2] and ids(hits.filter(Like("s", "b_d"))) == [3]
    assert ids(hits.filter(Or(Eq("id", 1), Eq("id", 2)))) == [1, 2]
    with pytest.raises(EngineError):
        hits.filter(Eq("nothing", 1))
    with pytest.raises(EngineError):
        hits.filter(Like("id", "%1%"))


def test_like_reaches_the_scan(spark):
    plan = Frame.scan(spark, "/root/testdata/sf0.001/pages.parquet").filter(Like("url", "%www.%")).aggregate([], [Count()]).df
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(url,www.)" in text and "html" not in text.split("ReadSchema")[1]


def test_sums_are_exact_and_empty_input_gives_null(hits):
    row = hits.aggregate([], [Sum("small"), Sum("big"), Avg("big"), Count(), DistinctCount("small"), Min("s"), Max("s"), Max("ts")]).collect()[0]
    assert row["sum_small"] == 60_002 and int(row["sum_big"]) == 2**63 and row["avg_big"] == 2.0**61
    assert row["count"] == 4 and row["distinct_count_small"] == 3 and row["min_s"] == "" and row["max_s"] == "Привет"
    none = hits.filter(Greater("id", 9)).aggregate([], [Sum("small"), Avg("big"), Min("s"), Count(), DistinctCount("s")]).collect()[0]
    assert tuple(none) == (None, None, None, 0, 0)
    assert hits.filter(Greater("id", 9)).aggregate(["s"], [Count()]).collect() == []


def test_grouping_joins_zeros_and_nans(hits):
    assert len(hits.aggregate(["x"], [Count()]).collect()) == 3  # -0.0 and 0.0 are one key


def test_scalars(hits):
    out = hits.project(
        Length("s"), ExtractMinute("ts"), AddConst("id", -1, "less"), Literal("one", 1, "bigint"), RegexpReplace("s", "([a-z])_", r"<\1>", "r"),
        CaseWhen("c", Greater("id", 2), Col("s"), Literal("", "")),
    )
    rows = {r["id"]: r for r in out.collect()}
    assert rows[4]["length_s"] == 12 and rows[1]["minutes_ts"] == 59 and rows[1]["less"] == 0 and rows[3]["r"] == "<b>d"
    assert rows[2]["c"] == "" and rows[3]["c"] == "b_d" and dict(out.df.dtypes)["one"] == "bigint" and dict(out.df.dtypes)["less"] == "int"
    with pytest.raises(Exception, match="OVERFLOW"):
        hits.project(AddConst("small", 2**15, "more")).collect()
    for bad in (Length("id"), ExtractMinute("s"), AddConst("s", 1), TimeTrunc("ts", "week"), TimeTrunc("s", "day"), RegexpReplace("s", "a", r"\1")):
        with pytest.raises(EngineError):
            hits.project(bad)


@pytest.mark.parametrize(("unit", "first", "leap", "old"), [
    ("year", "2013-01-01 00:00:00", "2012-01-01 00:00:00", "1969-01-01 00:00:00"),
    ("month", "2013-07-01 00:00:00", "2012-02-01 00:00:00", "1969-12-01 00:00:00"),
    ("day", "2013-07-01 00:00:00", "2012-02-29 00:00:00", "1969-12-31 00:00:00"),
    ("hour", "2013-07-01 23:00:00", "2012-02-29 12:00:00", "1969-12-31 23:00:00"),
    ("minute", "2013-07-01 23:59:00", "2012-02-29 12:34:00", "1969-12-31 23:59:00"),
    ("second", "2013-07-01 23:59:59", "2012-02-29 12:34:56", "1969-12-31 23:59:58"),
])
def test_truncation(hits, unit, first, leap, old):
    rows = {r["id"]: r for r in hits.project(TimeTrunc("ts", unit, "t"), TimeTrunc("day", unit, "d")).collect()}
    assert [str(rows[i]["t"]) for i in (1, 3, 2)] == [first, leap, old]
    assert [str(rows[i]["d"]) for i in (1, 3)] == [first[:10], leap[:10]]


def test_pattern_dialect(spark):
    frame = Frame(spark.createDataFrame([("http://a.b/c\n",), ("https://www.x.y/z?q",), ("none",)], "u string"))
    got = frame.project(RegexpReplace("u", r"^https?://(?:www\.)?([^/]+)/.*$", r"\1", "k")).result("k")
    assert got == ["http://a.b/c\n", "x.y", "none"]
    assert java_replacement(r"\1-$\\-\0", 1) == r"$1-\$\\-$0" and java_replacement(r"\12", 1) == r"$1\2"
    for bad in (r"(?=a)", r"(?<!a)b", r"(a)\1", r"(?P<n", r"a**", r"a*+", r"(?>a)", r"[[:nope:]]", r"(a", r"a)", r"[a", r"[z-a]", r"*a", "a|*", r"\C", r"\Z", r"\h", "(?U)a*", "a{2000}", "a\\", r"\xZZ"):
        with pytest.raises(EngineError):
            java_pattern(bad)
    for bad in ("\\", r"\x", r"\2"):
        with pytest.raises(EngineError):
            java_replacement(bad, 1)


PATTERNS = [
    "[[:alpha:]]+", "[^[:alpha:][:digit:]]+", "[[:^digit:]]", "[a&&b]+", "[]$]", "[^]a]", "[a-c-]", r"[\d\s]+", r"[\S]", r"[^\S]", r"[\W_]", r"(?P<n>a)(?P<m_1>b)?", "(?i)É", "(?i:A)b",
    "a$", "(?m)^.", "(?m).$", "(?m)$", r"\bb", r"\B.", r"\s+", r"\S+", r"\v", r"\x61", r"\x{e9}", r"\141", r"\0", r"\pL+", r"\p{Greek}", r"\p{^Lu}", r"\P{Lu}+", "x*", "a*?", "(a|)", "a{,2}", "a{2}", "{",
    "}", "]", "a|b|", "(?s)a.", "a.", r"\Qa.b\E+", r"\Aa", r"a\z", "[.]", r"\.", "#", " ", "(?i-s:A.)", r"(b+)(c)?", "é", "[é-ü]", "(?:)", "(^a|b$)", r"[\x41-\x43]", r"\_", "😀+", r"[[a]", r"[\]\[-]",
]


def test_patterns_mean_what_they_mean_in_the_linear_time_dialect(spark):
    import duckdb

    texts = ["abc 1 :&", "", "aaa", "baac", "a\nb\n", "a\n", "[]$&-", "ÉéaB b_c", "a.b a{,2} {a}", "x\x0by z\t", "ΑβΓ Lu", "A#C é😀😀ü", "\n\na", "aab\x00\r\nb"]
    frame = Frame(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"))
    got = frame.project(*[RegexpReplace("t", p, r"<\0>", f"p{k}") for k, p in enumerate(PATTERNS)]).order_by("i").collect()
    for row, text in zip(got, texts):
        for k, p in enumerate(PATTERNS):
            want = duckdb.execute("SELECT regexp_replace(?, ?, '<\\0>', 'g')", [text, p]).fetchone()[0]
            assert row[f"p{k}"] == want, (p, text)


def test_casts_and_rounding(hits):
    out = hits.project(Cast("ts", "date", "d"), Cast("small", "bigint"), Round("x", 0, "r")).order_by("id", limit=1).collect()[0]
    assert (out["d"], out["r"]) == (dt.date(2013, 7, 1), 2.0) and dict(hits.project(Cast("small", "bigint")).df.dtypes)["small"] == "bigint"
    with pytest.raises(Exception, match="CAST"):
        hits.project(Cast("s", "int")).collect()
    for bad in (Cast("nothing", "int"), Round("s", 1)):
        with pytest.raises(EngineError):
            hits.project(bad)


def test_orders_ties_offsets_and_limits(hits):
    assert hits.order_by(("small", True), "id", limit=2).result("id") == [1, 2]
    assert hits.order_by("s", limit=2, offset=1).result("s") == ["abc", "b_d"]
    assert hits.order_by("id", limit=5, offset=50).collect() == [] and len(hits.limit(3).collect()) == 3 and hits.limit(0).collect() == []
    with pytest.raises(EngineError):
        hits.limit(-1)
    with pytest.raises(EngineError):
        hits.order_by("nothing")
    plan = hits.order_by(("small", True), limit=2, offset=1).df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_select_drop_reorder(hits):
    assert hits.drop("s", "x").df.columns == ["id", "small", "big", "day", "ts"]
    assert hits.reorder("s", "id", "s").df.columns == ["s", "id", "s"]
    for bad in (hits.drop, hits.reorder, hits.select):
        with pytest.raises(EngineError):
            bad("nothing")


def test_rewrites_change_plans_not_results(hits):
    sums = [Sum(AddConst("id", k), f"s{k}") for k in range(5)]
    keys = ["small", AddConst("small", -1, "k1"), Literal("one", 1)]
    for frame in (hits, hits.filter(Greater("id", 9))):
        for group in ([], keys):
            plain, rewritten = (frame.aggregate(group, sums, rewrite=r) for r in (False, True))
            assert plain.df.columns == rewritten.df.columns and plain.df.dtypes == rewritten.df.dtypes
            assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rewritten.collect()))
    plan = hits.aggregate(keys, sums).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") == 1 and "Aggregate [small" in plan
    with pytest.raises(EngineError):
        hits.aggregate(["id"], [Count(name="id")])
    with pytest.raises(EngineError):
        hits.aggregate(["id"], [])


def test_display(hits):
    from tessera.sources.display import display_lines

    out = io.StringIO()
    with redirect_stdout(out):
        for line in display_lines(hits.order_by("id", limit=1).reorder("id", "s", "day", "ts", "x").df, names=True):
            print(line)
    assert out.getvalue() == "id,s,day,ts,x,\n1,,2013-07-01,2013-07-01 23:59:59,1.500000,\n"
