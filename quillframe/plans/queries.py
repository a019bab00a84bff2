"""Registered queries over the test tables and their SQL oracles.

Every query is a few words of the library's own interface over whole tables.
Sort order shows in a ``row_number`` column, since results are compared as sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import cluster, combine, infer, stats, verify
from quillframe.operators.transform import parse_sort, process
from quillframe.plans.registry import ORACLES, on, register, table
from quillframe.schema import ColumnMeta, Mapping, Schema
from quillframe.storage import shared_dir
from quillframe.types import CURRENCY, DATE, DATETIME, FLOAT, INTEGER, STRING, ColumnType

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process(
        table(spark, sf_dir, "orders"), filters=["o_orderstatus = F"], derive=["total_with_tax=o_totalprice * 1.0825"],
        columns=["o_orderkey,o_custkey,o_totalprice"], sort=["o_orderdate:desc,o_orderkey:asc"], limit=20, row_numbers=True, stable=False,
    )


register(
    "flagship", flagship,
    """SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS row_number, o_orderkey, o_custkey, o_totalprice, o_totalprice * 1.0825::DOUBLE AS total_with_tax
       FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20)""",
)

# Projection
register("scan_project", on("orders", columns=["o_orderkey,o_orderstatus", "o_totalprice"]), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
register("exclude_columns", on("customer", exclude=["c_acctbal,c_mktsegment"]), "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
RENAMED = Schema([ColumnMeta("c_custkey", INTEGER, "id"), ColumnMeta("c_name", STRING, "name")])
register("rename_columns", lambda s, d: process(table(s, d, "customer").select("c_custkey", "c_name"), RENAMED, as_text=False), "SELECT c_custkey AS id, c_name AS name FROM customer")

# Filters
for _name, _table, _key, _filter, _where in (
    ("filter_eq", "orders", "o_orderkey", "o_orderstatus = F", "o_orderstatus = 'F'"),
    ("filter_ne", "orders", "o_orderkey", "o_orderstatus != F", "o_orderstatus <> 'F'"),
    ("filter_gt", "lineitem", "l_orderkey,l_linenumber,l_quantity", "l_quantity > 45", "l_quantity > 45"),
    ("filter_ge", "lineitem", "l_orderkey,l_linenumber,l_quantity", "l_quantity >= 45", "l_quantity >= 45"),
    ("filter_lt", "orders", "o_orderkey", "o_orderdate < 1995-06-01 00:00:00", "o_orderdate < TIMESTAMP '1995-06-01'"),
    ("filter_le", "orders", "o_orderkey,o_totalprice", "o_totalprice <= 150000.5", "o_totalprice <= 150000.5"),
    ("filter_contains", "part", "p_partkey,p_name", "p_name contains ring", "contains(p_name, 'ring')"),
    ("filter_startswith", "customer", "c_custkey,c_mktsegment", 'c_mktsegment startswith "HOUSE"', "starts_with(c_mktsegment, 'HOUSE')"),
    ("filter_endswith", "customer", "c_custkey,c_mktsegment", "c_mktsegment ENDSWITH ERY", "suffix(c_mktsegment, 'ERY')"),
):
    _cols = _key.split(",")
    _shown = ", ".join("CAST(l_linenumber AS BIGINT) AS l_linenumber" if c == "l_linenumber" else c for c in _cols)
    register(_name, on(_table, columns=[_key], filters=[_filter]), f"SELECT {_shown} FROM {_table} WHERE {_where}")
register(
    "filter_and_multi", on("orders", columns=["o_orderkey"], filters=["o_orderstatus = O", "o_totalprice > 250000", "o_orderpriority startswith 1-"]),
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000 AND starts_with(o_orderpriority, '1-')",
)
register(
    "filter_expr_or_nested_if",
    on("orders", columns=["o_orderkey"], filter_exprs=['o_orderstatus == "F" || o_totalprice > 400000.0', 'if(o_custkey % 2 == 0, o_totalprice < 450000.0, o_orderpriority != "5-LOW")']),
    """SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000)
       AND CASE WHEN o_custkey % 2 = 0 THEN o_totalprice < 450000 ELSE o_orderpriority <> '5-LOW' END""",
)


def _with_gaps(spark, d):
    """Customers with and without orders above a price: a column with NULLs."""
    big = table(spark, d, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "first_order")


GAPS = "(SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS first_order FROM customer)"


def _null_table(spark, d):
    out = None
    for op in ("=", "!=", ">", ">=", "<", "<="):
        for value in ("", "5000"):
            n = process(_with_gaps(spark, d), filters=[f"first_order {op} {value}"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), F.lit(value).alias("value"), "n")
            out = n if out is None else out.unionByName(n)
    return out


_v = "first_order"
_truth = {"=": (f"{_v} IS NULL", f"{_v} = 5000"), "!=": (f"{_v} IS NOT NULL", f"{_v} IS NULL OR {_v} <> 5000"), ">": ("FALSE", f"{_v} > 5000"), ">=": (f"{_v} IS NULL", f"{_v} >= 5000"), "<": ("FALSE", f"{_v} < 5000"), "<=": (f"{_v} IS NULL", f"{_v} <= 5000")}
register("filter_null_table", _null_table, " UNION ALL ".join(f"SELECT '{op}' AS op, '{val}' AS value, count(*) AS n FROM {GAPS} WHERE {cond}" for op, both in _truth.items() for val, cond in zip(("", "5000"), both)))

# Derivation
register("derive_arith", on("orders", columns=["o_orderkey"], derive=["taxed=o_totalprice * 1.0825 - 10", "neg=-o_custkey", "rest=o_orderkey % 7", "power=2 ^ 3"]), "SELECT o_orderkey, o_totalprice * 1.0825::DOUBLE - 10 AS taxed, -o_custkey AS neg, o_orderkey % 7 AS rest, CAST(8 AS DOUBLE) AS power FROM orders")
register("derive_if_bucket", on("orders", columns=["o_orderkey"], derive=['bucket=if(o_totalprice > 300000.0, "high", if(o_totalprice > 100000.0, "mid", "low"))']), "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS bucket FROM orders")
register("derive_concat", on("customer", columns=["c_custkey"], derive=['tag=concat(c_mktsegment, "-", c_nationkey, "/", c_custkey > 10)']), "SELECT c_custkey, c_mktsegment || '-' || c_nationkey || '/' || CASE WHEN c_custkey > 10 THEN 'true' ELSE 'false' END AS tag FROM customer")
register("derive_positional", on("customer", columns=["c_custkey"], derive=["twice=c0 * 2", "len=len(c1)"]), "SELECT c_custkey, c_custkey * 2 AS twice, CAST(length(c_name) AS BIGINT) AS len FROM customer")
register("derive_int_division", on("orders", columns=["o_orderkey"], derive=["q=o_custkey / 7", "f=o_custkey / 7.0", "n=-o_custkey / 7"]), "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey / 7.0::DOUBLE AS f, -(o_custkey // 7) AS n FROM orders")
register(
    "derive_builtins",
    on("part", columns=["p_partkey"], derive=["lo=min(p_size, 10)", "hi=max(p_size, 10.5)", "up=str::to_uppercase(p_name)", 'has=contains(p_name, "red")', "sub=str::substring(p_name, 1, 4)", "fl=floor(p_retailprice)", "bits=bitand(p_size, 12)", "kind=typeof(p_size)", "root=math::sqrt(4.0)"]),
    "SELECT p_partkey, CAST(least(p_size, 10) AS BIGINT) AS lo, greatest(p_size, 10.5::DOUBLE)::DOUBLE AS hi, upper(p_name) AS up, contains(p_name, 'red') AS has, substr(p_name, 2, 3) AS sub, floor(p_retailprice) AS fl, CAST(p_size & 12 AS BIGINT) AS bits, 'int' AS kind, 2.0::DOUBLE AS root FROM part",
)

# Temporal functions; their arguments are text, as in the language
DAY = "CAST(o_orderdate AS DATE)"
for _name, _expr, _sql in (
    ("date_add", "date_add(datetime_to_date(o_orderdate), 10)", f"strftime({DAY} + 10, '%Y-%m-%d')"),
    ("date_sub", "date_sub(datetime_to_date(o_orderdate), 45)", f"strftime({DAY} - 45, '%Y-%m-%d')"),
    ("date_diff_days", 'date_diff_days(datetime_to_date(o_orderdate), "1995-01-01")', f"date_diff('day', DATE '1995-01-01', {DAY})"),
    ("date_format", 'date_format(datetime_to_date(o_orderdate), "%d/%m/%Y")', f"strftime({DAY}, '%d/%m/%Y')"),
):
    register(_name, on("orders", columns=["o_orderkey"], derive=[f"v={_expr}"]), f"SELECT o_orderkey, {_sql} AS v FROM orders")
SEC = "date_trunc('second', ts)"
CLOCK = f"(epoch({SEC})::BIGINT % 86400)"
for _name, _expr, _sql in (
    ("datetime_add_seconds", "datetime_add_seconds(ts, 3600)", f"strftime({SEC} + INTERVAL 3600 SECOND, '%Y-%m-%d %H:%M:%S')"),
    ("datetime_diff_seconds", 'datetime_diff_seconds(ts, "2024-01-01 00:00:00")', f"date_diff('second', TIMESTAMP '2024-01-01', {SEC})"),
    ("datetime_to_date", "datetime_to_date(ts)", "strftime(ts, '%Y-%m-%d')"),
    ("datetime_to_time", "datetime_to_time(ts)", "strftime(ts, '%H:%M:%S')"),
    ("datetime_format", 'datetime_format(ts, "%Y/%m/%d %H-%M")', "strftime(ts, '%Y/%m/%d %H-%M')"),
    ("time_add_seconds", "if(time_diff_seconds(datetime_to_time(ts), \"12:00:00\") < 0, time_add_seconds(datetime_to_time(ts), 60), \"-\")", f"CASE WHEN {CLOCK} < 43200 THEN strftime({SEC} + INTERVAL 60 SECOND, '%H:%M:%S') ELSE '-' END"),
    ("time_diff_seconds", 'time_diff_seconds(datetime_to_time(ts), "06:30:00")', f"{CLOCK} - 23400"),
):
    register(_name, on("events", columns=["event_id"], derive=[f"v={_expr}"]), f"SELECT event_id, {_sql} AS v FROM events")

# Sort, limit, row numbers
register("row_numbers", on("orders", columns=["o_orderkey"], sort=["o_orderdate,o_orderkey:desc"], row_numbers=True), "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey DESC) AS row_number, o_orderkey FROM orders")
MIXED = ["l_shipdate:desc,l_quantity,l_orderkey,l_partkey,l_suppkey,l_linenumber"]
MIXED_SQL = "ORDER BY l_shipdate DESC, l_quantity, l_orderkey, l_partkey, l_suppkey, l_linenumber"
register("sort_multi_mixed", on("lineitem", columns=["l_orderkey,l_quantity"], sort=MIXED, row_numbers=True), f"SELECT row_number() OVER ({MIXED_SQL}) AS row_number, l_orderkey, l_quantity FROM lineitem")
register("sort_nulls", lambda s, d: process(_with_gaps(s, d), sort=["first_order,c_custkey"], row_numbers=True, stable=False), f"SELECT row_number() OVER (ORDER BY first_order NULLS FIRST, c_custkey) AS row_number, * FROM {GAPS}")
register("topk", on("lineitem", columns=["l_orderkey,l_extendedprice"], sort=["l_extendedprice:desc,l_orderkey,l_partkey,l_suppkey,l_linenumber"], limit=100), "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 100")
register("limit_after_sort", on("orders", columns=["o_orderkey,o_totalprice"], filters=["o_orderstatus = P"], sort=["o_totalprice,o_orderkey"], limit=50), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 50")


def _flags(s, d):
    return table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))


for _name, _style, _yes, _no in (("boolean_format_true_false", "true-false", "true", "false"), ("boolean_format_one_zero", "one-zero", "1", "0")):
    register(_name, lambda s, d, style=_style: process(_flags(s, d), boolean_format=style), f"SELECT doc_id, CASE WHEN quality = 1 THEN '{_yes}' WHEN quality IS NOT NULL THEN '{_no}' ELSE '' END AS good FROM labels")


# Statistics
def _rounded(found: DataFrame) -> DataFrame:
    return found.select("column", "count", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std_dev")])


def stat_sql(column: str, metric: str, source: str) -> str:
    parts = ", ".join(f"round({f}(m), 4) AS {n}" for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median"), ("stddev_samp", "std_dev")))
    return f"SELECT '{column}' AS \"column\", count(m) AS count, {parts} FROM (SELECT CAST({metric} AS DOUBLE) AS m FROM {source})"


def _with_types(s, d):
    """Orders with a decimal, a date and a time column."""
    o = table(s, d, "orders")
    seconds = F.col("o_orderkey") % 86400
    return o.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderdate").cast("date").alias("day"), seconds.cast("int").alias("clock"))


TYPED = Schema([ColumnMeta("o_orderkey", INTEGER), ColumnMeta("price", ColumnType("decimal", 12, 2)), ColumnMeta("day", DATE), ColumnMeta("clock", ColumnType("time"))])
register("stats_integer", lambda s, d: _rounded(stats.summarize(table(s, d, "lineitem"), columns=["l_linenumber"])), stat_sql("l_linenumber", "l_linenumber", "lineitem"))
register("stats_float", lambda s, d: _rounded(stats.summarize(table(s, d, "lineitem"), columns=["l_quantity,l_discount"])), stat_sql("l_quantity", "l_quantity", "lineitem") + " UNION ALL " + stat_sql("l_discount", "l_discount", "lineitem"))
register("stats_datetime", lambda s, d: _rounded(stats.summarize(table(s, d, "orders"), columns=["o_orderdate"])), stat_sql("o_orderdate", "epoch(o_orderdate)", "orders"))
for _name, _column, _metric in (("stats_decimal", "price", "CAST(o_totalprice AS DECIMAL(12,2))"), ("stats_date", "day", f"date_diff('day', DATE '1970-01-01', {DAY})"), ("stats_time", "clock", "o_orderkey % 86400")):
    register(_name, lambda s, d, c=_column: _rounded(stats.summarize(_with_types(s, d), TYPED, columns=[c])), stat_sql(_column, _metric, "orders"))
register("stats_filtered", lambda s, d: _rounded(stats.summarize(table(s, d, "orders"), columns=["o_totalprice"], filters=["o_orderstatus = F"], filter_exprs=["o_custkey > 100"])), stat_sql("o_totalprice", "o_totalprice", "(SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 100)"))
register("stats_scan_limit", lambda s, d: _rounded(stats.summarize(table(s, d, "orders"), columns=["o_totalprice"], limit=500)), stat_sql("o_totalprice", "o_totalprice", "(SELECT * FROM orders LIMIT 500)"))


# Frequencies
def freq_sql(column: str, value: str, source: str, top: int = 0) -> str:
    ranked = f"SELECT '{column}' AS \"column\", v AS value, n AS count, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS percent, row_number() OVER (ORDER BY n DESC, v) AS rank FROM (SELECT coalesce({value}, '<empty>') AS v, count(*) AS n FROM {source} GROUP BY 1)"
    return f"SELECT * FROM ({ranked})" + (f" WHERE rank <= {top}" if top else "")


QTY = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"
register("frequency_single", lambda s, d: stats.frequency(table(s, d, "orders"), columns=["o_orderpriority"]), freq_sql("o_orderpriority", "o_orderpriority", "orders"))
register("frequency_multi", lambda s, d: stats.frequency(table(s, d, "lineitem"), columns=["l_returnflag,l_linestatus"]), freq_sql("l_returnflag", "l_returnflag", "lineitem") + " UNION ALL " + freq_sql("l_linestatus", "l_linestatus", "lineitem"))
register("frequency_top_n", lambda s, d: stats.frequency(table(s, d, "lineitem"), columns=["l_quantity"], top=5), freq_sql("l_quantity", QTY, "lineitem", 5))
register("frequency_filtered", lambda s, d: stats.frequency(table(s, d, "events"), columns=["event_type"], filters=["value > 10"]), freq_sql("event_type", "event_type", "(SELECT * FROM events WHERE value > 10)"))
register("frequency_empty", lambda s, d: stats.frequency(_with_gaps(s, d), columns=["first_order"], top=3), freq_sql("first_order", "CAST(first_order AS VARCHAR)", GAPS, 3))

# Append and joins
register("append_union_all", lambda s, d: combine.append([table(s, d, "orders"), table(s, d, "orders")]), "SELECT * FROM orders UNION ALL SELECT * FROM orders")
CUSTOMER_TEXT = Schema([ColumnMeta("c_custkey", INTEGER, "id"), ColumnMeta("c_name", STRING, "name", [("Customer#000000001", "first")])])
register(
    "append_with_schema", lambda s, d: combine.append([table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")] * 2, CUSTOMER_TEXT),
    "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_name = 'Customer#000000001' THEN 'first' ELSE c_name END AS name FROM customer) SELECT * FROM c UNION ALL SELECT * FROM c",
)
register("join_inner", lambda s, d: combine.join(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey"), "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")


for _how in ("left", "right", "full"):  # customers of orders against suppliers by number: rows of both sides are left over
    register(
        f"join_{_how}", lambda s, d, how=_how: combine.join(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "supplier").select("s_suppkey", "s_name"), "o_custkey", "s_suppkey", how),
        f"SELECT o_orderkey, {'o_custkey' if _how == 'left' else 'coalesce(o_custkey, s_suppkey) AS o_custkey'}, s_name FROM orders {_how} JOIN supplier ON o_custkey = s_suppkey",
    )
register(
    "join_multikey", lambda s, d: combine.join(table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_partkey,l_suppkey", "l_partkey,l_suppkey"),
    "SELECT a.l_partkey, a.l_suppkey, a.l_orderkey, n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey",
)
register(  # every customer, most without such an order, to the number of customers that share the value: one row a key, null included
    "join_null_safe", lambda s, d: combine.join(_with_gaps(s, d), _with_gaps(s, d).groupBy(F.col("first_order").alias("k")).agg(F.count(F.lit(1)).alias("sharing")), "first_order", "k"),
    f"SELECT a.c_custkey, a.first_order, b.sharing FROM {GAPS} a JOIN (SELECT first_order AS k, count(*) AS sharing FROM {GAPS} GROUP BY 1) b ON a.first_order IS NOT DISTINCT FROM b.k",
)
register(
    "join_collision", lambda s, d: combine.join(table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("name")), table(s, d, "customer").select("c_nationkey", F.col("c_name").alias("name")), "n_nationkey", "c_nationkey"),
    "SELECT n_nationkey, n_name AS name, c_name AS right_name_1 FROM nation JOIN customer ON n_nationkey = c_nationkey",
)


# Mapping chains over text
def mapped(source: str, key: str, text: str, meta: ColumnMeta):
    """A key as it is and one text column through ``process``."""

    def run(s, d):
        rows = table(s, d, source).selectExpr(f"CAST({key} AS STRING) AS k", f"{text} AS v")
        return process(rows, Schema([ColumnMeta("k", STRING), meta]), columns=["k", "v"])

    return run


def chain(target: ColumnType, *steps: Mapping) -> ColumnMeta:
    return ColumnMeta("v", target, mappings=list(steps))


PRICE = "CAST(CAST(l_extendedprice * 1.0 + l_tax AS DECIMAL(14,3)) AS STRING)"
PRICE_SQL = "CAST(l_extendedprice * 1.0::DOUBLE + l_tax AS DECIMAL(14,3))"
LINE = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
D2 = ColumnType("decimal", 14, 2)
for _name, _source, _key, _text, _meta, _sql in (
    ("map_round", "lineitem", LINE, PRICE, chain(D2, Mapping(STRING, D2, "round")), f"CAST(round({PRICE_SQL}, 2) AS DECIMAL(14,2))::VARCHAR"),
    ("map_truncate", "lineitem", LINE, PRICE, chain(D2, Mapping(STRING, D2, "truncate")), f"CAST(trunc({PRICE_SQL} * 100) / 100 AS DECIMAL(14,2))::VARCHAR"),
    ("map_trim", "part", "p_partkey", "concat('  ', p_name, ' ')", chain(STRING, Mapping(STRING, STRING, "trim")), "p_name"),
    ("map_lower", "part", "p_partkey", "p_type", chain(STRING, Mapping(STRING, STRING, "lowercase")), "lower(p_type)"),
    ("map_upper", "part", "p_partkey", "p_name", chain(STRING, Mapping(STRING, STRING, "uppercase")), "upper(p_name)"),
    ("map_float_to_int", "part", "p_partkey", "CAST(p_retailprice AS STRING)", chain(INTEGER, Mapping(STRING, FLOAT), Mapping(FLOAT, INTEGER, "truncate")), "CAST(trunc(p_retailprice) AS BIGINT)::VARCHAR"),
    ("map_datetime_to_date", "orders", "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')", chain(DATE, Mapping(STRING, DATETIME, None, {"format": "%Y-%m-%d %H:%M:%S"}), Mapping(DATETIME, DATE)), "strftime(o_orderdate, '%Y-%m-%d')"),
    ("map_currency", "orders", "o_orderkey", "concat('$', CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING))", chain(CURRENCY, Mapping(STRING, CURRENCY, "round", {"scale": 2})), "CAST(o_totalprice AS DECIMAL(14,2))::VARCHAR"),
    ("map_decimal", "orders", "o_orderkey", "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING)", chain(ColumnType("decimal", 16, 4), Mapping(STRING, ColumnType("decimal", 16, 4))), "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DECIMAL(16,4))::VARCHAR"),
    ("map_date_to_text", "orders", "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd')", chain(STRING, Mapping(STRING, DATE), Mapping(DATE, STRING, None, {"format": "%d.%m.%Y"})), "strftime(o_orderdate, '%d.%m.%Y')"),
    ("replace_values", "orders", "o_orderkey", "o_orderstatus", ColumnMeta("v", STRING, replace=[("F", "finished"), ("O", "open")]), "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END"),
):
    _sql_key = _key if _source == "lineitem" else f"CAST({_key} AS VARCHAR)"
    register(_name, mapped(_source, _key, _text, _meta), f"SELECT {_sql_key} AS k, {_sql} AS v FROM {_source}")


# Parsing of rendered text
def parsed(source: str, key: str, text: str, kind: ColumnType, show: str):
    def run(s, d):
        rows = table(s, d, source).selectExpr(f"CAST({key} AS STRING) AS k", f"{text} AS v")
        return process(rows, Schema([ColumnMeta("k", STRING), ColumnMeta("v", kind)]), as_text=False).select("k", F.expr(show).alias("v"))

    return run


PICK = "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy/M/d') WHEN 2 THEN date_format(o_orderdate, 'dd-MM-yyyy') ELSE 'soon' END"
register("parse_date_formats", parsed("orders", "o_orderkey", PICK, DATE, "date_format(v, 'yyyy-MM-dd')"), "SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS v FROM orders")
register("parse_boolean", parsed("part", "p_partkey", "element_at(array('Yes','n','TRUE','0','maybe'), CAST(p_partkey % 5 + 1 AS INT))", ColumnType("boolean"), "v"), "SELECT CAST(p_partkey AS VARCHAR) AS k, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS v FROM part")
register("parse_currency", parsed("orders", "o_orderkey", "concat(CASE WHEN o_orderkey % 2 = 0 THEN '($' ELSE '€' END, format_number(CAST(o_totalprice AS DECIMAL(14,2)), 2), CASE WHEN o_orderkey % 2 = 0 THEN ')' ELSE '' END)", CURRENCY, "CAST(CAST(v AS DECIMAL(14,2)) AS STRING)"), "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -CAST(o_totalprice AS DECIMAL(14,2)) ELSE CAST(o_totalprice AS DECIMAL(14,2)) END AS DECIMAL(14,2))::VARCHAR AS v FROM orders")
register("parse_decimal", parsed("lineitem", LINE, "CASE WHEN l_linenumber = 1 THEN '1.500' ELSE CAST(CAST(l_quantity AS DECIMAL(10,2)) AS STRING) END", ColumnType("decimal", 10, 2), "CAST(v AS STRING)"), f"SELECT {LINE} AS k, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS DECIMAL(10,2))::VARCHAR END AS v FROM lineitem")


# Verification
WRONG = Schema([ColumnMeta("p_partkey", INTEGER), ColumnMeta("p_name", INTEGER, "name"), ColumnMeta("p_size", ColumnType("decimal", 1, 0), "size")])


def _part_text(s, d):
    return table(s, d, "part").selectExpr("CAST(p_partkey AS STRING) AS p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN '12' ELSE p_name END AS p_name", "CAST(p_size AS STRING) AS p_size")


register("verify_summary", lambda s, d: verify.summary(verify.violations(_part_text(s, d), WRONG, with_rows=False)), "SELECT 'name' AS \"column\", count(*) AS errors FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'size', count(*) FROM part WHERE p_size > 9")
register(
    "verify_detail", lambda s, d: verify.violations(_part_text(s, d), WRONG, with_rows=False).select("column", "raw", "normalized", "datatype", "reason"),
    """SELECT 'name' AS "column", p_name AS raw, p_name AS normalized, 'integer' AS datatype, 'cannot be read as integer' AS reason FROM part WHERE p_partkey % 3 <> 0
       UNION ALL SELECT 'size', p_size::VARCHAR, p_size::VARCHAR, 'decimal(1,0)', 'cannot be read as decimal(1,0)' FROM part WHERE p_size > 9""",
)


# Discovery
def _order_text(s, d):
    return table(s, d, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS id", "o_orderstatus AS status", "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) AS total",
        "concat('$', CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING)) AS cost", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS stamp",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'N/A' END AS flag",
    )


def _inferred(s, d):
    rows = _order_text(s, d)
    return s.createDataFrame([(c, str(t)) for c, t in zip(rows.columns, infer.infer_types(rows, 0))], "name string, datatype string")


register(
    "infer_types", _inferred,
    """SELECT * FROM (VALUES ('id', 'integer'), ('status', 'string'), ('cost', 'currency'), ('day', 'date'), ('stamp', 'datetime'), ('flag', 'boolean')) AS t(name, datatype)
       UNION ALL SELECT 'total', 'decimal(' || (max(length(CAST(floor(o_totalprice) AS BIGINT)::VARCHAR)) + 2) || ',2)' FROM orders""",
)
register("placeholder_tally", lambda s, d: infer.placeholder_tally(_order_text(s, d)), "SELECT 'flag' AS \"column\", 'N/A' AS token, count(*) AS count FROM orders WHERE o_orderkey % 2 <> 0")


# Index variants
def _covering(s, d):
    found = cluster.expand_covering("geo=day:asc|desc,total")
    sort = parse_sort(["day:desc,total,id"])
    best = cluster.best_variant(found, sort)
    return s.createDataFrame([(v.name, v.describe(), v.matches(sort), v is best) for v in found], "name string, keys string, matches boolean, best boolean")


register(
    "index_variant_match", _covering,
    """SELECT name, name || ' -> ' || keys AS keys, m AS matches, b AS best FROM (VALUES ('geo_day-asc', 'day:asc', false, false), ('geo_day-desc', 'day:desc', true, false),
       ('geo_day-asc_total-asc', 'day:asc, total:asc', false, false), ('geo_day-desc_total-asc', 'day:desc, total:asc', true, true)) AS t(name, keys, m, b)""",
)


def _index_root(s: SparkSession) -> str:
    return f"{shared_dir(s)}/{uuid.uuid4().hex}"


def _clustered(s, d):
    lines = table(s, d, "lineitem")
    index = cluster.build(lines, _index_root(s), [cluster.parse_variant("recent=l_shipdate:desc,l_quantity")])
    variant = index.pick(parse_sort(MIXED))
    return index.process(variant, columns=["l_orderkey,l_quantity"], sort=MIXED, row_numbers=True, stable=False)


register("clustered_sort", _clustered, ORACLES["sort_multi_mixed"])


def _clustered_top(s, d):
    """The first rows of a variant, with and without a filter: only the files that hold them are read."""
    index = cluster.build(table(s, d, "lineitem"), _index_root(s), [cluster.parse_variant("recent=l_shipdate:desc,l_quantity")], partitions=16)
    variant = index.pick(parse_sort(MIXED))
    plain = index.process(variant, columns=["l_orderkey,l_quantity"], sort=MIXED, limit=300, row_numbers=True, stable=False)
    some = index.process(variant, columns=["l_orderkey,l_quantity"], sort=MIXED, filters=["l_quantity < 3"], limit=300, row_numbers=True, stable=False)
    return plain.select(F.lit("all").alias("of"), "*").unionByName(some.select(F.lit("few").alias("of"), "*"))


register(
    "clustered_top", _clustered_top,
    " UNION ALL ".join(f"SELECT '{n}' AS of, * FROM (SELECT row_number() OVER ({MIXED_SQL}) AS row_number, l_orderkey, l_quantity FROM lineitem WHERE {w} QUALIFY row_number <= 300)" for n, w in (("all", "TRUE"), ("few", "l_quantity < 3"))),
)
