"""Registered queries for sources, sinks, discovery, mappings, built-in functions and streams.

Files are written to the shared folder and read back, so that both ends are
compared with the table they came from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import combine, infer, stats, verify
from quillframe.operators.transform import process
from quillframe.plans.registry import on, register, table
from quillframe.schema import ColumnMeta, Mapping, Schema, manual_schema
from quillframe.sources import delimited as D
from quillframe.storage import shared_dir
from quillframe.streaming.rowlocal import process_stream
from quillframe.types import BOOLEAN, CURRENCY, DATE, DATETIME, FLOAT, GUID, INTEGER, STRING, TIME, ColumnType


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, **how) -> str:
    """The folder of delimited parts that ``df`` was written to."""
    path = folder(spark)
    D.write_delimited(df, path, single=False, **how)
    return path


# Delimited sources and sinks
NOTE = "concat('say \"', c_mktsegment, '\", ', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '\nnext line' WHEN c_custkey % 3 = 1 THEN '' ELSE ' é' END)"
NOTE_SQL = "'say \"' || c_mktsegment || '\", ' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN chr(10) || 'next line' WHEN 1 THEN '' ELSE ' é' END"


def _csv(s, d, sep=",", code=None, header=True, **how):
    rows = table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS name", f"{NOTE} AS note", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment")
    return D.read_delimited(s, written(s, rows, sep=sep, code=code, header=header), sep=sep, code=code, **how)


CSV_SQL = f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, {NOTE_SQL} AS note, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer"
register("csv_scan", lambda s, d: _csv(s, d), CSV_SQL)
register("csv_tab_delimited", lambda s, d: _csv(s, d, sep="\t"), CSV_SQL)
register("csv_latin1", lambda s, d: _csv(s, d, sep=";", code="latin-1"), CSV_SQL)
register("csv_without_header", lambda s, d: _csv(s, d, sep="|", header=False), f"SELECT id AS field_0, name AS field_1, note AS field_2, segment AS field_3 FROM ({CSV_SQL})")
register(
    "csv_single_lines", lambda s, d: D.read_delimited(s, written(s, table(s, d, "part").selectExpr("CAST(p_partkey AS STRING) AS id", "p_name")), multiline=False),
    "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name FROM part",
)
ORDER_FILE = Schema([ColumnMeta("o_orderkey", INTEGER, "id"), ColumnMeta("o_totalprice", FLOAT), ColumnMeta("o_orderdate", DATETIME, "at")])


def _order_file(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    return D.read_delimited(s, written(s, rows), schema=ORDER_FILE)


register(
    "csv_process_with_schema", lambda s, d: process(_order_file(s, d), ORDER_FILE, filters=["o_totalprice > 100000", "at >= 1995-01-01 00:00:00"], columns=["id,at"], strict=True),
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders WHERE o_totalprice > 100000 AND o_orderdate >= TIMESTAMP '1995-01-01'",
)


def _undecodable(s, d):
    """Customers whose names hold a lone Latin-1 byte in every seventh row, read as UTF-8."""
    rows = table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "CASE WHEN c_custkey % 7 = 0 THEN concat('é', c_name) ELSE c_name END AS name")
    read = D.read_delimited(s, written(s, rows, code="latin-1"), undecoded="skip")
    return read.select("id", "name", F.col(infer.UNDECODED).cast("bigint").alias("skipped"))


register("csv_undecodable_cells", _undecodable, "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS skipped FROM customer")


def _layouts(s, d):
    """Whether a header is found in files that have one and in files that have none."""
    found = []
    for name in ("nation", "customer", "part", "orders"):
        for header in (True, False):
            columns, seen = D.layout(s, written(s, table(s, d, name).limit(200), header=header), ",")
            found.append((name, header, seen, columns[0]))
    return s.createDataFrame(found, "name string, written boolean, seen boolean, first_column string")


register(
    "header_detection", _layouts,
    " UNION ALL ".join(f"SELECT '{n}' AS name, {h} AS written, {h} AS seen, '{c if h else 'field_0'}' AS first_column" for n, c in (("nation", "n_nationkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey")) for h in (True, False)),
)

# Order of the input: stable sorts, input ordinals
IN_ORDER = "(SELECT *, row_number() OVER () AS place FROM orders)"
register("sort_stable_ties", lambda s, d: process(table(s, d, "orders"), columns=["o_orderkey"], sort=["o_orderpriority:desc"], row_numbers=True), f"SELECT row_number() OVER (ORDER BY o_orderpriority DESC, place) AS row_number, o_orderkey FROM {IN_ORDER}")
register("filter_row_number", lambda s, d: process(table(s, d, "orders"), columns=["o_orderkey"], filter_exprs=["row_number % 3 == 1 && o_orderstatus != \"P\""]), f"SELECT o_orderkey FROM {IN_ORDER} WHERE place % 3 = 1 AND o_orderstatus <> 'P'")
register("row_numbers_of_input", lambda s, d: process(table(s, d, "orders"), columns=["o_orderkey"], row_numbers=True), f"SELECT place AS row_number, o_orderkey FROM {IN_ORDER}")
register("derive_row_number", lambda s, d: process(table(s, d, "orders"), columns=["o_orderkey"], derive=["twice=row_number * 2"], sort=["o_totalprice:desc,o_orderkey"], stable=False), "SELECT o_orderkey, 2 * row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS twice FROM orders")
VALUES = "CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -0.0E0 ELSE value END"
VALUES_SQL = "CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 0.0::DOUBLE ELSE value END"
WITH_NAN = f"(SELECT event_id, {VALUES_SQL} AS v FROM events)"


def _floats(s, d):
    return table(s, d, "events").selectExpr("event_id", f"{VALUES} AS v")


register("sort_floats", lambda s, d: process(_floats(s, d), columns=["event_id"], sort=["v:desc,event_id"], row_numbers=True, stable=False), f"SELECT row_number() OVER (ORDER BY v IS NULL, v DESC, event_id) AS row_number, event_id FROM {WITH_NAN}")
register("filter_float_equal", lambda s, d: process(_floats(s, d), columns=["event_id"], filters=["v = 0"]), f"SELECT event_id FROM {WITH_NAN} WHERE v = 0")
register("filter_float_not_equal", lambda s, d: process(_floats(s, d), columns=["event_id"], filters=["v != nan"]), f"SELECT event_id FROM {WITH_NAN}")

# Discovery
TEXTS = "CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 4 = 0 THEN '#N/A' WHEN o_orderkey % 4 = 1 THEN '--' WHEN o_orderkey % 4 = 2 THEN 'unknown' ELSE CAST(CAST(o_totalprice AS INT) AS STRING) END AS amount"


def _placeholders(s, d, behavior):
    rows = table(s, d, "orders").selectExpr(*TEXTS.split(", ", 1))
    schema = infer.placeholder_replacements(infer.infer(rows, sample_rows=0), behavior, "0")
    return process(rows, schema, as_text=False)


for _behavior, _fill in (("empty", "NULL"), ("fill", "0")):
    register(f"placeholders_{_behavior}", lambda s, d, b=_behavior: _placeholders(s, d, b), f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN CAST(trunc(o_totalprice) AS BIGINT) ELSE {_fill} END AS amount FROM orders")


def _sampled_types(s, d):
    """The last of many rows turns a column to text; a sample does not see it."""
    rows = table(s, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id")
    rows = rows.unionByName(s.createDataFrame([("text",)], "id string")).coalesce(1)
    return s.createDataFrame([(n, str(infer.infer_types(rows, n)[0])) for n in (50, 0)], "rows int, datatype string")


register("infer_sampling", _sampled_types, "SELECT 50 AS rows, 'integer' AS datatype UNION ALL SELECT 0, 'string'")


def _header_rows(s, d):
    """Repeated header rows among the data are no data."""
    rows = table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS name", "c_mktsegment AS segment", "CAST(c_acctbal AS STRING) AS balance")
    rows = rows.unionByName(s.createDataFrame([("id", "name", "segment", "balance")] * 5, rows.schema))
    schema = Schema([ColumnMeta("id", INTEGER), ColumnMeta("name"), ColumnMeta("segment"), ColumnMeta("balance", FLOAT)])
    return stats.summarize(rows, schema, columns=["id"]).select("column", "count", "min", "max")


register("header_rows_skipped", _header_rows, "SELECT 'id' AS \"column\", count(*) AS count, min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max FROM customer")
MANUAL = manual_schema(["c_custkey:integer->id,c_name:string->name", "c_mktsegment:string"], ["c_mktsegment=BUILDING->B", "c_mktsegment=MACHINERY->M"])
register(
    "manual_schema", lambda s, d: process(table(s, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS c_custkey", "c_name", "c_mktsegment"), MANUAL),
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
register("schema_listing", lambda s, d: s.createDataFrame(MANUAL.listing(), "place string, name string, type string, output string"), "SELECT * FROM (VALUES ('1', 'c_custkey', 'integer', 'id'), ('2', 'c_name', 'string', 'name'), ('3', 'c_mktsegment', 'string', 'c_mktsegment')) AS t(place, name, type, output)")

# Verification by row
WRONG = Schema([ColumnMeta("o_orderkey", INTEGER), ColumnMeta("mark", BOOLEAN, "flag")])
MARK = "CASE WHEN o_orderkey % 5 = 0 THEN 'perhaps' WHEN o_orderkey % 5 = 1 THEN '' ELSE 'yes' END"
for _name, _headers, _first in (("verify_rows", True, 2), ("verify_rows_without_header", False, 1)):
    register(
        _name, lambda s, d, h=_headers: verify.violations(table(s, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS o_orderkey", f"{MARK} AS mark"), Schema(WRONG.columns, h)).select("row", "column", "raw"),
        f"SELECT place + {_first - 1} AS row, 'flag' AS \"column\", 'perhaps' AS raw FROM {IN_ORDER} WHERE o_orderkey % 5 = 0",
    )
BROKEN = Schema([ColumnMeta("id", INTEGER), ColumnMeta("v", CURRENCY, mappings=[Mapping(STRING, CURRENCY, "round", {"scale": 4})])])
DIGITS = "CAST(o_orderkey AS STRING) AS id, concat(o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.25' WHEN 3 THEN '.125' ELSE '.06255' END) AS v"
register(
    "verify_failed_mapping", lambda s, d: verify.violations(table(s, d, "orders").selectExpr(*DIGITS.split(", ", 1)), BROKEN, with_rows=False).select("raw", "reason"),
    "SELECT o_orderkey || CASE o_orderkey % 5 WHEN 1 THEN '.5' ELSE '.125' END AS raw, 'datatype mapping failed' AS reason FROM orders WHERE o_orderkey % 5 IN (1, 3)",
)

# The remaining mappings
D2, D4 = ColumnType("decimal", 16, 2), ColumnType("decimal", 18, 4)
CENTS = "CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING)"
CENTS_SQL = "CAST(o_totalprice AS DECIMAL(14,2))"
S = lambda target, how=None, **options: Mapping(STRING, target, how, options)
for _name, _text, _steps, _sql in (
    ("map_integer_to_float", "CAST(o_orderkey AS STRING)", [S(INTEGER), Mapping(INTEGER, FLOAT)], "printf('%.4f', o_orderkey::DOUBLE)"),
    ("map_integer_to_currency", "CAST(o_orderkey AS STRING)", [S(INTEGER), Mapping(INTEGER, CURRENCY)], "o_orderkey || '.00'"),
    ("map_integer_to_decimal", "CAST(o_orderkey AS STRING)", [S(INTEGER), Mapping(INTEGER, D4)], "o_orderkey || '.0000'"),
    ("map_float_to_float", CENTS, [S(FLOAT), Mapping(FLOAT, FLOAT, "round", {"scale": 1})], f"CAST(round({CENTS_SQL}, 1) AS DECIMAL(14,1))::VARCHAR"),
    ("map_float_to_integer", CENTS, [S(FLOAT), Mapping(FLOAT, INTEGER)], f"round({CENTS_SQL}, 0)::BIGINT::VARCHAR"),
    ("map_float_to_decimal", CENTS, [S(FLOAT), Mapping(FLOAT, D2, "round")], f"{CENTS_SQL}::VARCHAR"),
    ("map_float_to_text", CENTS, [S(FLOAT), Mapping(FLOAT, STRING, None, {"scale": 2})], f"{CENTS_SQL}::VARCHAR"),
    ("map_currency_to_integer", CENTS, [S(CURRENCY, "round", scale=2), Mapping(CURRENCY, INTEGER, "truncate")], "trunc(CAST(o_totalprice AS DECIMAL(14,2)))::BIGINT::VARCHAR"),
    ("map_currency_to_decimal", CENTS, [S(CURRENCY), Mapping(CURRENCY, D4)], f"CAST({CENTS_SQL} AS DECIMAL(18,4))::VARCHAR"),
    ("map_currency_to_text", CENTS, [S(CURRENCY), Mapping(CURRENCY, STRING)], f"{CENTS_SQL}::VARCHAR"),
    ("map_decimal_to_integer", CENTS, [S(D2), Mapping(D2, INTEGER, "truncate")], "trunc(CAST(o_totalprice AS DECIMAL(14,2)))::BIGINT::VARCHAR"),
    ("map_decimal_to_currency", CENTS, [S(D2), Mapping(D2, CURRENCY)], f"{CENTS_SQL}::VARCHAR"),
    ("map_decimal_to_decimal", CENTS, [S(D2), Mapping(D2, D4)], f"CAST({CENTS_SQL} AS DECIMAL(18,4))::VARCHAR"),
    ("map_boolean", "CASE WHEN o_orderkey % 2 = 0 THEN ' YES' ELSE 'f' END", [S(BOOLEAN)], "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END"),
    ("map_time", "date_format(o_orderdate, 'HH-mm')", [S(TIME, format="%H-%M")], "strftime(o_orderdate, '%H:%M:00')"),
    ("map_datetime_to_time", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm')", [S(DATETIME), Mapping(DATETIME, TIME)], "strftime(o_orderdate, '%H:%M:00')"),
    ("map_datetime_to_text", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm')", [S(DATETIME), Mapping(DATETIME, STRING, None, {"format": "%I %p, %d %b %y"})], "strftime(o_orderdate, '%I %p, %d %b %y')"),
    ("map_guid", "concat('{', upper(md5(CAST(o_orderkey AS STRING))), '}')", [S(GUID)], "CAST(md5(CAST(o_orderkey AS VARCHAR)) AS UUID)::VARCHAR"),
):
    _meta = ColumnMeta("v", _steps[-1].target, mappings=_steps)
    register(
        _name, lambda s, d, t=_text, m=_meta: process(table(s, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS k", f"{t} AS v"), Schema([ColumnMeta("k", STRING), m]).check()),
        f"SELECT CAST(o_orderkey AS VARCHAR) AS k, {_sql} AS v FROM orders",
    )
register(
    "map_currency_digits", lambda s, d: process(table(s, d, "orders").selectExpr(*DIGITS.split(", ", 1)), Schema([ColumnMeta("id", STRING), BROKEN.columns[1]]), as_text=True).where("v IS NOT NULL"),
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN '.00' WHEN 2 THEN '.25' ELSE '.0626' END AS v FROM orders WHERE o_orderkey % 5 IN (0, 2, 4)",
)
register(
    "mappings_skipped", lambda s, d: process(table(s, d, "part").selectExpr("CAST(p_partkey AS STRING) AS k", "p_name AS v"), Schema([ColumnMeta("k"), ColumnMeta("v", mappings=[Mapping(STRING, STRING, "uppercase")])]), skip_mappings=True),
    "SELECT CAST(p_partkey AS VARCHAR) AS k, p_name AS v FROM part",
)

# Built-in functions
MATH = {"abs": "abs", "sqrt": "sqrt", "cbrt": "cbrt", "exp": "exp", "ln": "ln", "log2": "log2", "log10": "log10", "sin": "sin", "cos": "cos", "tan": "tan", "atan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "asinh": "asinh"}
register(
    "builtins_math", lambda s, d: on("part", columns=["p_partkey"], derive=[f"f_{n}=math::{n}(p_size / 10.0)" for n in MATH])(s, d).select("p_partkey", *[F.round(f"f_{n}", 8).alias(f"f_{n}") for n in MATH]),
    "SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 10.0::DOUBLE), 8) AS f_{n}" for n, f in MATH.items()) + " FROM part",
)
REST = {
    "f_pow": ("math::pow(p_size, 1.5)", "pow(p_size, 1.5::DOUBLE)"), "f_log": ("math::log(p_size + 1, 3)", "ln(p_size + 1) / ln(3)"), "f_atan2": ("math::atan2(p_size, 7)", "atan2(p_size, 7)"),
    "f_hypot": ("math::hypot(p_size, 4)", "sqrt(p_size * p_size + 16.0::DOUBLE)"), "f_exp2": ("math::exp2(p_size / 10.0)", "pow(2, p_size / 10.0::DOUBLE)"), "f_asin": ("math::asin(p_size / 100.0)", "asin(p_size / 100.0::DOUBLE)"),
    "f_acos": ("math::acos(p_size / 100.0)", "acos(p_size / 100.0::DOUBLE)"), "f_acosh": ("math::acosh(p_size + 1.0)", "acosh(p_size + 1.0::DOUBLE)"), "f_atanh": ("math::atanh(p_size / 100.0)", "atanh(p_size / 100.0::DOUBLE)"),
    "f_ceil": ("ceil(p_retailprice)", "ceil(p_retailprice)"), "f_round": ("round(p_retailprice)", "round(p_retailprice)"),
}
register(
    "builtins_more_math", lambda s, d: on("part", columns=["p_partkey"], derive=[f"{n}={e}" for n, (e, _) in REST.items()])(s, d).select("p_partkey", *[F.round(n, 8).alias(n) for n in REST]),
    "SELECT p_partkey, " + ", ".join(f"round(({q})::DOUBLE, 8) AS {n}" for n, (_, q) in REST.items()) + " FROM part",
)
register(
    "builtins_text_and_bits",
    on("part", columns=["p_partkey"], derive=['low=str::to_lowercase(p_type)', 'cut=str::trim(concat("  ", p_name, " "))', "from=str::from(p_size)", "tail=str::substring(p_name, 2)", "n=len(p_name)", 'any=contains_any(p_name, ("red", "blue"))', "o=bitor(p_size, 8)", "x=bitxor(p_size, 5)", "no=bitnot(p_size)", "l=shl(p_size, 2)", "r=shr(p_size, 1)", "nan=math::is_nan(p_retailprice)"]),
    """SELECT p_partkey, lower(p_type) AS low, p_name AS cut, CAST(p_size AS VARCHAR) AS "from", substr(p_name, 3) AS tail, CAST(length(p_name) AS BIGINT) AS n, contains(p_name, 'red') OR contains(p_name, 'blue') AS "any",
       CAST(p_size | 8 AS BIGINT) AS o, CAST(xor(p_size, 5) AS BIGINT) AS x, CAST(~p_size AS BIGINT) AS no, CAST(p_size * 4 AS BIGINT) AS l, CAST(p_size // 2 AS BIGINT) AS r, isnan(p_retailprice) AS nan FROM part""",
)

# Joins, statistics and frequencies by shown value
register("join_integer_and_float_keys", lambda s, d: combine.join(table(s, d, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS DOUBLE) AS k"), table(s, d, "customer").select("c_custkey", "c_name"), "k", "c_custkey"), "SELECT o_orderkey, o_custkey::DOUBLE AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
MONEY = Schema([ColumnMeta("k", CURRENCY), ColumnMeta("v", STRING)])
register(
    "join_currency_keys", lambda s, d: combine.join(table(s, d, "part").selectExpr("concat('$', p_size, '.00') AS k", "CAST(p_partkey AS STRING) AS v"), table(s, d, "nation").selectExpr("concat(n_nationkey, '.00') AS k", "n_name AS v"), "k", "k", "inner", MONEY, MONEY),
    "SELECT '$' || p_size || '.00' AS k, CAST(p_partkey AS VARCHAR) AS v, n_name AS right_v_1 FROM part JOIN nation ON p_size = n_nationkey",
)
register(
    "frequency_all_columns", lambda s, d: stats.frequency(table(s, d, "customer").select("c_mktsegment", "c_nationkey")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", v AS value, n AS count, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS percent, row_number() OVER (ORDER BY n DESC, v) AS rank FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer GROUP BY 1)" for c in ("c_mktsegment", "c_nationkey")),
)
register(
    "stats_rendered", lambda s, d: s.createDataFrame([tuple(r) for r in stats.summary_table(stats.summarize(table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), columns=["day"]), {"day": DATE})[1]], "column string, count string, min string, max string, mean string, median string, std_dev string").select("column", "count", "min", "max"),
    "SELECT 'day' AS \"column\", count(*)::VARCHAR AS count, strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max FROM orders",
)


# Streams
def _stream(s, d):
    """The row-local part of ``process`` on a stream of event files, written and read back."""
    source, out = folder(s), folder(s)
    events = table(s, d, "events")
    events.write.parquet(source)
    stream = process_stream(s.readStream.schema(events.schema).parquet(source), columns=["event_id"], filters=["value > 10"], derive=["double=value * 2"])
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(s)).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


register("stream_row_local", _stream, 'SELECT event_id, value * 2 AS "double" FROM events WHERE value > 10')
