"""The query catalog: every query shape of the engine over the standard tables, each with the SQL
it must match. Top-k queries order by all their keys, so ties cannot change a result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from tessera.functions.aggregates import Avg, Count, DistinctCount, Max, Min, Sum
from tessera.functions.expressions import AddConst, CaseWhen, Cast, Col, ExtractMinute, Length, Literal, RegexpReplace, Round, TimeTrunc
from tessera.functions.predicates import And, Eq, Greater, GreaterEq, In, LessEq, Like, NotEq, NotLike, Or
from tessera.operators.frame import Frame
from tessera.session import prepare
from tessera.sources import ingest, scratch


class Tables:
    """The tables of a folder, and the same by way of delimited text."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, table: str) -> Frame:
        return Frame.scan(self.spark, f"{self.sf_dir}/{table}.parquet")

    def converted(self, table: str, columns: dict[str, str], header: bool = False) -> Frame:
        """The declared columns of a table, written as delimited text and converted into a table again.
        With ``header`` the text declares them itself, else a schema file does."""
        path = scratch.new_path(self.spark, "text")
        out = self(table).df.select(*columns)
        if header:
            out = out.withColumnsRenamed({name: f"{kind}:{name}" for name, kind in columns.items()})
        written = {"header": header, "quote": '"', "escape": '"', "quoteAll": True, "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        out.write.options(**written).csv(f"{path}/text")
        lines = [Row(value=f"{name},{kind}") for name, kind in columns.items()]
        self.spark.createDataFrame(lines).coalesce(1).write.text(f"{path}/schema")
        ingest.convert(self.spark, f"{path}/text", f"{path}/table", None if header else f"{path}/schema")
        return Frame.scan(self.spark, f"{path}/table")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], Frame]
    sql: str

    def frame(self, spark: SparkSession, sf_dir: str) -> Frame:
        prepare(spark)
        return self.build(Tables(spark, sf_dir))

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.frame(spark, sf_dir).df


QUERIES: dict[str, Query] = {}


def query(sql: str):
    def register(build):
        QUERIES[build.__name__] = Query(build, " ".join(sql.split()))
        return build

    return register


def rounded(frame: Frame, digits: int, *columns: str) -> Frame:
    """Doubles that depend on the order of addition, rounded for comparison."""
    return frame.project(*[Round(c, digits) for c in columns])


def bigints(frame: Frame, *columns: str) -> Frame:
    """Exact decimal sums as bigint; a sum out of range raises."""
    return frame.project(*[Cast(c, "bigint") for c in columns])


# --- whole-table aggregates


@query("SELECT count(*) AS c FROM lineitem")
def count_star(t):
    return t("lineitem").aggregate([], [Count(name="c")])


@query("SELECT count(*) AS c FROM lineitem WHERE l_linenumber <> 1")
def count_ne_filter(t):
    return t("lineitem").filter(NotEq("l_linenumber", 1)).aggregate([], [Count(name="c")])


@query("SELECT cast(sum(l_linenumber) AS bigint) AS s, count(*) AS c, round(avg(l_quantity), 4) AS a FROM lineitem")
def sum_count_avg(t):
    return rounded(t("lineitem").aggregate([], [Sum("l_linenumber", "s"), Count(name="c"), Avg("l_quantity", "a")]), 4, "a")


@query("SELECT round(avg(user_id), 6) AS a FROM events")
def avg_bigint(t):
    return rounded(t("events").aggregate([], [Avg("user_id", "a")]), 6, "a")


@query("SELECT cast(sum(user_id) AS bigint) AS s FROM events")
def sum_bigint(t):
    return bigints(t("events").aggregate([], [Sum("user_id", "s")]), "s")


@query("SELECT count(DISTINCT user_id) AS u FROM events")
def distinct_bigint(t):
    return t("events").aggregate([], [DistinctCount("user_id", "u")])


@query("SELECT count(DISTINCT source) AS u FROM documents")
def distinct_string(t):
    return t("documents").aggregate([], [DistinctCount("source", "u")])


@query("SELECT cast(min(l_shipdate) AS date) AS low, cast(max(l_shipdate) AS date) AS high FROM lineitem")
def min_max_date(t):
    days = t("lineitem").project(Cast("l_shipdate", "date", "day"))
    return days.aggregate([], [Min("day", "low"), Max("day", "high")])


@query("SELECT min(ts) AS low, max(ts) AS high FROM events")
def min_max_ts(t):
    return t("events").aggregate([], [Min("ts", "low"), Max("ts", "high")])


@query("SELECT min(p_name) AS low, max(p_name) AS high FROM part")
def max_string(t):
    return t("part").aggregate([], [Min("p_name", "low"), Max("p_name", "high")])


@query("SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem")
def sum_double(t):
    return rounded(t("lineitem").aggregate([], [Sum("l_extendedprice", "s")]), 2, "s")


@query("SELECT l_returnflag, round(avg(l_discount), 4) AS a, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag")
def avg_double(t):
    return rounded(rounded(t("lineitem").aggregate(["l_returnflag"], [Avg("l_discount", "a"), Sum("l_quantity", "s")]), 4, "a"), 2, "s")


@query("SELECT count(*) AS c, cast(sum(l_linenumber) AS bigint) AS s, max(l_shipdate) AS high FROM lineitem WHERE l_quantity > 1000000")
def aggregate_no_rows(t):
    return t("lineitem").filter(Greater("l_quantity", 1000000)).aggregate([], [Count(name="c"), Sum("l_linenumber", "s"), Max("l_shipdate", "high")])


_PLUS = 90


@query("SELECT " + ", ".join(f"cast(sum(l_linenumber + {k}) AS bigint) AS s{k}" for k in range(_PLUS)) + " FROM lineitem")
def sum_plus_k_90(t):
    return t("lineitem").aggregate([], [Sum(AddConst("l_linenumber", k), f"s{k}") for k in range(_PLUS)])


# --- groups and top-k


@query("SELECT l_linenumber, count(*) AS c FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_linenumber ORDER BY c DESC, l_linenumber")
def group_count_filtered(t):
    return t("lineitem").filter(NotEq("l_linenumber", 1)).aggregate(["l_linenumber"], [Count(name="c")]).order_by(("c", True), "l_linenumber")


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS u FROM lineitem GROUP BY l_suppkey ORDER BY u DESC, l_suppkey LIMIT 10")
def group_distinct_topk(t):
    return t("lineitem").aggregate(["l_suppkey"], [DistinctCount("l_orderkey", "u")]).order_by(("u", True), "l_suppkey", limit=10)


@query("""SELECT l_suppkey, cast(sum(l_linenumber) AS bigint) AS s, count(*) AS c, round(avg(l_quantity), 4) AS a,
count(DISTINCT l_partkey) AS u FROM lineitem GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10""")
def group_multi_agg_topk(t):
    out = t("lineitem").aggregate(["l_suppkey"], [Sum("l_linenumber", "s"), Count(name="c"), Avg("l_quantity", "a"), DistinctCount("l_partkey", "u")])
    return rounded(out.order_by(("c", True), "l_suppkey", limit=10), 4, "a")


@query("""SELECT event_type, count(DISTINCT user_id) AS u FROM events WHERE event_type <> '' GROUP BY event_type
ORDER BY u DESC, event_type LIMIT 10""")
def group_str_distinct(t):
    return t("events").filter(NotEq("event_type", "")).aggregate(["event_type"], [DistinctCount("user_id", "u")]).order_by(("u", True), "event_type", limit=10)


@query("""SELECT p_brand, p_type, count(DISTINCT p_size) AS u FROM part WHERE p_type <> '' GROUP BY p_brand, p_type
ORDER BY u DESC, p_brand, p_type LIMIT 10""")
def group_2key_distinct(t):
    out = t("part").filter(NotEq("p_type", "")).aggregate(["p_brand", "p_type"], [DistinctCount("p_size", "u")])
    return out.order_by(("u", True), "p_brand", "p_type", limit=10)


@query("SELECT source, count(*) AS c FROM documents WHERE source <> '' GROUP BY source ORDER BY c DESC, source LIMIT 10")
def group_str_count(t):
    return t("documents").filter(NotEq("source", "")).aggregate(["source"], [Count(name="c")]).order_by(("c", True), "source", limit=10)


@query("SELECT props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10")
def group_str_distinct_users(t):
    return t("events").filter(NotEq("props", "")).aggregate(["props"], [DistinctCount("user_id", "u")]).order_by(("u", True), "props", limit=10)


@query("""SELECT event_type, props, count(*) AS c FROM events WHERE props <> '' GROUP BY event_type, props
ORDER BY c DESC, event_type, props LIMIT 10""")
def group_2key_count(t):
    return t("events").filter(NotEq("props", "")).aggregate(["event_type", "props"], [Count(name="c")]).order_by(("c", True), "event_type", "props", limit=10)


@query("SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10")
def group_bigint_topk(t):
    return t("events").aggregate(["user_id"], [Count(name="c")]).order_by(("c", True), "user_id", limit=10)


@query("SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10")
def group_mixed_topk(t):
    return t("events").aggregate(["user_id", "event_type"], [Count(name="c")]).order_by(("c", True), "user_id", "event_type", limit=10)


@query("SELECT count(*) AS n FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type LIMIT 10)")
def group_limit_unordered(t):
    # which rows come is open, so the query counts them
    return t("events").aggregate(["user_id", "event_type"], [Count(name="c")]).limit(10).aggregate([], [Count(name="n")])


@query("""SELECT user_id, cast(extract(minute FROM ts) AS integer) AS m, event_type, count(*) AS c FROM events
GROUP BY 1, 2, 3 ORDER BY c DESC, user_id, m, event_type LIMIT 10""")
def group_minute(t):
    out = t("events").aggregate(["user_id", ExtractMinute("ts", "m"), "event_type"], [Count(name="c")])
    return out.order_by(("c", True), "user_id", "m", "event_type", limit=10)


@query("""SELECT l_suppkey, l_linenumber, count(*) AS c, cast(sum(l_linenumber) AS bigint) AS s, round(avg(l_quantity), 4) AS a
FROM lineitem WHERE l_returnflag <> '' GROUP BY l_suppkey, l_linenumber ORDER BY c DESC, l_suppkey, l_linenumber LIMIT 10""")
def group_2key_sum_avg(t):
    out = t("lineitem").filter(NotEq("l_returnflag", "")).aggregate(["l_suppkey", "l_linenumber"], [Count(name="c"), Sum("l_linenumber", "s"), Avg("l_quantity", "a")])
    return rounded(out.order_by(("c", True), "l_suppkey", "l_linenumber", limit=10), 4, "a")


@query("""SELECT l_orderkey, l_partkey, count(*) AS c, cast(sum(l_linenumber) AS bigint) AS s, round(avg(l_quantity), 4) AS a
FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey, l_partkey ORDER BY c DESC, l_orderkey, l_partkey LIMIT 10""")
def group_2key_high_filtered(t):
    out = t("lineitem").filter(NotEq("l_returnflag", "A")).aggregate(["l_orderkey", "l_partkey"], [Count(name="c"), Sum("l_linenumber", "s"), Avg("l_quantity", "a")])
    return rounded(out.order_by(("c", True), "l_orderkey", "l_partkey", limit=10), 4, "a")


@query("""SELECT l_orderkey, l_partkey, count(*) AS c, cast(sum(l_linenumber) AS bigint) AS s, round(avg(l_quantity), 4) AS a
FROM lineitem GROUP BY l_orderkey, l_partkey ORDER BY c DESC, l_orderkey, l_partkey LIMIT 10""")
def group_2key_high(t):
    out = t("lineitem").aggregate(["l_orderkey", "l_partkey"], [Count(name="c"), Sum("l_linenumber", "s"), Avg("l_quantity", "a")])
    return rounded(out.order_by(("c", True), "l_orderkey", "l_partkey", limit=10), 4, "a")


@query("SELECT url, count(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10")
def group_url(t):
    return t("pages").aggregate(["url"], [Count(name="c")]).order_by(("c", True), "url", limit=10)


@query("SELECT 1 AS one, url, count(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10")
def group_literal(t):
    return t("pages").aggregate([Literal("one", 1), "url"], [Count(name="c")]).order_by(("c", True), "url", limit=10)


@query("""SELECT o_custkey, o_custkey - 1 AS k1, o_custkey - 2 AS k2, o_custkey - 3 AS k3, count(*) AS c FROM orders
GROUP BY 1, 2, 3, 4 ORDER BY c DESC, o_custkey LIMIT 10""")
def group_derived(t):
    keys = ["o_custkey", *(AddConst("o_custkey", -k, f"k{k}") for k in (1, 2, 3))]
    return t("orders").aggregate(keys, [Count(name="c")]).order_by(("c", True), "o_custkey", limit=10)


# --- selections and orders


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 899")
def point_lookup(t):
    return t("orders").filter(Eq("o_custkey", 899)).select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS c FROM pages WHERE url LIKE '%www.%'")
def like_count(t):
    return t("pages").filter(Like("url", "%www.%")).aggregate([], [Count(name="c")])


@query("""SELECT lang, min(text) AS low, count(*) AS c FROM documents WHERE text LIKE '%the%' AND source <> '' GROUP BY lang
ORDER BY c DESC, lang LIMIT 10""")
def like_min(t):
    out = t("documents").filter(And(Like("text", "%the%"), NotEq("source", ""))).aggregate(["lang"], [Min("text", "low"), Count(name="c")])
    return out.order_by(("c", True), "lang", limit=10)


@query("""SELECT source, min(text) AS low, min(lang) AS low_lang, count(*) AS c, count(DISTINCT lang) AS u FROM documents
WHERE text LIKE '%and%' AND text NOT LIKE '%License%' AND source <> '' GROUP BY source ORDER BY c DESC, source LIMIT 10""")
def like_notlike_multi(t):
    out = t("documents").filter(Like("text", "%and%")).filter(NotLike("text", "%License%")).filter(NotEq("source", ""))
    out = out.aggregate(["source"], [Min("text", "low"), Min("lang", "low_lang"), Count(name="c"), DistinctCount("lang", "u")])
    return out.order_by(("c", True), "source", limit=10)


@query("SELECT page_id, url, html FROM pages WHERE url LIKE '%example%' ORDER BY page_id LIMIT 10")
def select_star_topk(t):
    return t("pages").filter(Like("url", "%example%")).order_by("page_id", limit=10)


@query("SELECT event_type FROM (SELECT event_type, ts, event_id FROM events WHERE event_type <> '' ORDER BY ts, event_id LIMIT 10)")
def order_hidden_col(t):
    return t("events").filter(NotEq("event_type", "")).order_by("ts", "event_id", limit=10).select("event_type")


@query("SELECT props FROM events WHERE props <> '' ORDER BY props LIMIT 10")
def order_string(t):
    return t("events").filter(NotEq("props", "")).order_by("props", limit=10).select("props")


@query("SELECT event_type, event_id FROM events WHERE event_type <> '' ORDER BY ts, event_type, event_id LIMIT 10")
def order_two(t):
    return t("events").filter(NotEq("event_type", "")).order_by("ts", "event_type", "event_id", limit=10).select("event_type", "event_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
def full_sort(t):
    return t("customer").select("c_custkey", "c_name").order_by("c_custkey")


@query("""SELECT lang, round(avg(strlen(text)), 4) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY lang
HAVING count(*) > 20 ORDER BY l DESC, lang LIMIT 25""")
def having_avg_len(t):
    out = t("documents").filter(NotEq("text", "")).project(Length("text", "bytes")).aggregate(["lang"], [Avg("bytes", "l"), Count(name="c")])
    return rounded(out.filter(Greater("c", 20)).order_by(("l", True), "lang", limit=25), 4, "l")


_DOMAIN = r"^https?://(?:www\.)?([^/]+)/.*$"


@query(rf"""SELECT regexp_replace(url, '{_DOMAIN}', '\1', 'g') AS k, round(avg(strlen(url)), 4) AS l, count(*) AS c, min(url) AS low
FROM pages WHERE url <> '' GROUP BY k HAVING count(*) > 1 ORDER BY l DESC, k LIMIT 25""")
def regex_domain_having(t):
    out = t("pages").filter(NotEq("url", "")).project(RegexpReplace("url", _DOMAIN, r"\1", "k"), Length("url", "bytes"))
    out = out.aggregate(["k"], [Avg("bytes", "l"), Count(name="c"), Min("url", "low")])
    return rounded(out.filter(Greater("c", 1)).order_by(("l", True), "k", limit=25), 4, "l")


_IN_RANGE = And(GreaterEq("o_orderdate", "1997-07-01"), LessEq("o_orderdate", "1998-07-31"))
_IN_RANGE_SQL = "o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate <= TIMESTAMP '1998-07-31'"


@query(f"""SELECT o_custkey, count(*) AS c FROM orders WHERE o_orderstatus = 'F' AND {_IN_RANGE_SQL} AND o_orderpriority <> ''
AND o_totalprice >= 1000 AND o_custkey > 0 GROUP BY o_custkey ORDER BY c DESC, o_custkey LIMIT 10""")
def conj_date_range(t):
    out = t("orders").filter(Eq("o_orderstatus", "F")).filter(_IN_RANGE).filter(NotEq("o_orderpriority", ""))
    out = out.filter(GreaterEq("o_totalprice", 1000)).filter(Greater("o_custkey", 0))
    return out.aggregate(["o_custkey"], [Count(name="c")]).order_by(("c", True), "o_custkey", limit=10)


@query(f"""SELECT o_orderpriority, count(*) AS c FROM orders WHERE o_orderstatus = 'F' AND {_IN_RANGE_SQL} AND o_orderpriority <> ''
GROUP BY o_orderpriority ORDER BY c DESC, o_orderpriority LIMIT 10""")
def conj_date_range_str(t):
    out = t("orders").filter(Eq("o_orderstatus", "F")).filter(_IN_RANGE).filter(NotEq("o_orderpriority", ""))
    return out.aggregate(["o_orderpriority"], [Count(name="c")]).order_by(("c", True), "o_orderpriority", limit=10)


@query(f"""SELECT o_custkey, count(*) AS c FROM orders WHERE {_IN_RANGE_SQL} AND o_orderstatus <> 'P' GROUP BY o_custkey
ORDER BY c DESC, o_custkey LIMIT 10 OFFSET 100""")
def conj_offset(t):
    out = t("orders").filter(_IN_RANGE).filter(NotEq("o_orderstatus", "P")).aggregate(["o_custkey"], [Count(name="c")])
    return out.order_by(("c", True), "o_custkey", limit=10, offset=100)


@query("""SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 100000 THEN o_orderpriority ELSE '' END AS src,
count(*) AS c FROM orders GROUP BY 1, 2 ORDER BY c DESC, o_orderstatus, src LIMIT 10 OFFSET 1""")
def case_when_group(t):
    big = And(Eq("o_orderstatus", "F"), GreaterEq("o_totalprice", 100000))
    src = CaseWhen("src", big, Col("o_orderpriority"), Literal("", ""))
    return t("orders").aggregate(["o_orderstatus", src], [Count(name="c")]).order_by(("c", True), "o_orderstatus", "src", limit=10, offset=1)


@query(f"""SELECT o_custkey, cast(o_orderdate AS date) AS day, count(*) AS c FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
AND {_IN_RANGE_SQL} GROUP BY 1, 2 ORDER BY c DESC, o_custkey, day LIMIT 10 OFFSET 100""")
def in_list_group(t):
    out = t("orders").filter(In("o_orderpriority", ["1-URGENT", "5-LOW"])).filter(_IN_RANGE)
    out = out.project(Cast("o_orderdate", "date", "day")).aggregate(["o_custkey", "day"], [Count(name="c")])
    return out.order_by(("c", True), "o_custkey", "day", limit=10, offset=100)


@query("""SELECT count(*) AS c FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW') AND o_totalprice <= 200000""")
def or_pred(t):
    either = Or(Eq("o_orderpriority", "1-URGENT"), Eq("o_orderpriority", "5-LOW"))
    return t("orders").filter(And(either, LessEq("o_totalprice", 200000))).aggregate([], [Count(name="c")])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2 ORDER BY c DESC, 1, 2 LIMIT 10 OFFSET 10000")
def deep_offset_empty(t):
    out = t("orders").aggregate(["o_orderstatus", "o_orderpriority"], [Count(name="c")])
    return out.order_by(("c", True), "o_orderstatus", "o_orderpriority", limit=10, offset=10000)


@query("""SELECT date_trunc('minute', ts) AS m, count(*) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-15'
GROUP BY m ORDER BY m LIMIT 10 OFFSET 100""")
def trunc_minute_group(t):
    out = t("events").filter(And(GreaterEq("ts", "2024-01-14"), LessEq("ts", "2024-01-15")))
    return out.aggregate([TimeTrunc("ts", "minute", "m")], [Count(name="c")]).order_by("m", limit=10, offset=100)


def _trunc(unit: str, table: str, column: str) -> None:
    def build(t):
        return t(table).aggregate([TimeTrunc(column, unit, "start")], [Count(name="c")])

    build.__name__ = f"trunc_{unit}"
    query(f"SELECT date_trunc('{unit}', {column}) AS start, count(*) AS c FROM {table} GROUP BY start")(build)


for _unit, _table, _column in (("year", "orders", "o_orderdate"), ("month", "orders", "o_orderdate"), ("day", "events", "ts"), ("hour", "events", "ts"), ("second", "events", "ts")):
    _trunc(_unit, _table, _column)


@query("SELECT DISTINCT cast(date_trunc('month', o_orderdate) AS date) AS month FROM orders")
def trunc_date(t):
    days = t("orders").project(Cast("o_orderdate", "date", "day"))
    return days.aggregate([TimeTrunc("day", "month", "month")], [Count(name="c")]).drop("c")


@query("SELECT n_nationkey, n_name FROM nation")
def drop_cols(t):
    return t("nation").drop("n_regionkey")


@query("SELECT r_name, r_regionkey FROM region")
def reorder_cols(t):
    return t("region").reorder("r_name", "r_regionkey")


@query("SELECT p_partkey, p_size, p_size + 7 AS later, p_partkey - 1 AS before, 'x' AS tag FROM part")
def project_scalars(t):
    return t("part").project(AddConst("p_size", 7, "later"), AddConst("p_partkey", -1, "before"), Literal("tag", "x")).reorder("p_partkey", "p_size", "later", "before", "tag")


@query("SELECT conv_id, turn, cast(strlen(text) AS bigint) AS bytes FROM conversations")
def byte_length(t):
    return t("conversations").project(Length("text", "bytes")).reorder("conv_id", "turn", "bytes")


# --- tables that came in as delimited text


@query(r"""SELECT conv_id, turn, role, rtrim(replace(text, chr(13), ''), ' ' || chr(9)) AS text FROM conversations""")
def convert_text(t):
    return t.converted("conversations", {"conv_id": "INT64", "turn": "INT32", "role": "STRING", "text": "STRING"}, header=True).project(Cast("turn", "bigint")).reorder("conv_id", "turn", "role", "text")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, date_trunc('second', o_orderdate) AS o_orderdate FROM orders""")
def convert_types(t):
    kinds = {"o_orderkey": "INT64", "o_custkey": "INT32", "o_orderstatus": "CHAR", "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP"}
    return t.converted("orders", kinds).project(Cast("o_custkey", "bigint"), Round("o_totalprice", 2)).reorder(*kinds)


@query("""SELECT l_returnflag, count(*) AS c, cast(sum(l_linenumber) AS bigint) AS s FROM lineitem WHERE l_quantity <= 10 GROUP BY l_returnflag""")
def convert_then_group(t):
    lines = t.converted("lineitem", {"l_linenumber": "INT16", "l_quantity": "FLOAT", "l_returnflag": "CHAR"})
    return bigints(lines.filter(LessEq("l_quantity", 10)).aggregate(["l_returnflag"], [Count(name="c"), Sum("l_linenumber", "s")]), "s")
