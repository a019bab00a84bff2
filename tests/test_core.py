import datetime as dt
import glob
import os
import statistics
import uuid
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe import storage
from quillframe.errors import UserError
from quillframe.functions.cells import literal, parse_cell, render_cell
from quillframe.functions.expressions import normalize_name, tokenize
from quillframe.functions.strftime import spark_pattern
from quillframe.operators import cluster, combine, infer, stats, verify
from quillframe.operators.binding import ORDINAL, with_ordinal
from quillframe.operators.filters import parse_condition
from quillframe.operators.transform import parse_sort, process
from quillframe.plans.render import render_table
from quillframe.schema import ColumnMeta, Mapping, Schema, manual_schema
from quillframe.types import BOOLEAN, CURRENCY, DATE, DATETIME, FLOAT, GUID, INTEGER, STRING, TIME, ColumnType

D = ColumnType.parse


def cells(spark, values, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.v for r in rows.select("i", parse_cell(F.col("v"), kind).alias("v")).orderBy("i").collect()]


def test_types():
    assert D("decimal(10, 2)") == ColumnType("decimal", 10, 2) == D("decimal(precision=10, scale=2)") == D({"decimal": {"precision": 10, "scale": 2}})
    assert D("UUID") == GUID and D("timestamp") == DATETIME and str(D("decimal(5,1)")) == "decimal(5,1)"
    for bad in ("decimal(29,2)", "decimal(4,5)", "money", "decimal(4)"):
        with pytest.raises(UserError):
            D(bad)


def test_parsing(spark):
    assert cells(spark, ["5", "+7", " 5", "", "1.0", "9223372036854775808"], INTEGER) == [5, 7, None, None, None, None]
    assert cells(spark, ["1.5", "1e3", ".5", "1.5d", " 2 ", "inf"], FLOAT) == [1.5, 1000.0, 0.5, None, None, float("inf")]
    assert cells(spark, ["YES", "n", "1", " y ", "maybe"], BOOLEAN) == [True, False, True, None, None]
    day = dt.date(2024, 5, 6)
    assert cells(spark, ["2024-05-06", "06/05/2024", "2024/05/06", "06-05-2024", "12/31/2024", "2024-02-30", "06.05.2024"], DATE) == [day, day, day, day, dt.date(2024, 12, 31), None, None]
    stamp = dt.datetime(2024, 5, 6, 7, 8, 9)
    assert cells(spark, ["2024-05-06 07:08:09", "2024-05-06T07:08:09", "06/05/2024 07:08:09", "2024-05-06 07:08", "2024-05-06"], DATETIME) == [stamp, stamp, stamp, stamp.replace(second=0), None]
    assert cells(spark, ["06:00:00", "23:59", "24:00", "x"], TIME) == [21600, 86340, None, None]
    g = str(uuid.UUID(int=7))
    assert cells(spark, [f"{{{g.upper()}}}", g.replace("-", ""), "abc"], GUID) == [g, g, None]
    assert cells(spark, ["$1,234.50", "(€2.00)", "5.678", "7", "-1.2345", "1.2.3", "$"], CURRENCY) == [Decimal("1234.5"), Decimal(-2), None, Decimal(7), Decimal("-1.2345"), None, None]
    assert cells(spark, ["1.50", "1.500", "123456789.1", "12345678.1", "(5)"], D("decimal(10,2)")) == [Decimal("1.50"), None, None, Decimal("12345678.10"), Decimal("-5.00")]


@given(st.integers(-(2**63), 2**63 - 1))
def test_integer_literals(n):
    assert literal(str(n), INTEGER) == n


@given(st.text(max_size=20))
def test_names_normalise_to_identifiers(name):
    made = normalize_name(name)
    assert made and not made[0].isdigit() and all(c == "_" or (c.isascii() and c.isalnum()) for c in made)


def test_rendering(spark):
    row = spark.range(1).select(
        render_cell(F.lit(5.0), FLOAT).alias("a"), render_cell(F.lit(1e-5), FLOAT).alias("b"), render_cell(F.lit(1e12), FLOAT).alias("c"), render_cell(F.lit(3661), TIME).alias("d"),
        render_cell(F.lit("1.5").cast("decimal(28,4)"), CURRENCY).alias("e"), render_cell(F.lit("1.2345").cast("decimal(28,4)"), CURRENCY).alias("f"),
    ).first()
    assert list(row) == ["5", "0.00001", "1000000000000", "01:01:01", "1.50", "1.2345"]


ORDERS = [
    ("1", "2024-01-01", "2024-01-01 06:00:00", "2024-01-04", "2024-01-04 10:15:00", "06:00:00", "shipped"),
    ("2", "2024-01-03", "2024-01-03 23:30:00", "2024-01-05", "2024-01-06 01:45:00", "12:30:00", "open"),
    ("3", "", "", "", "", "", "open"),
]
ORDER_SCHEMA = Schema([ColumnMeta(n, t) for n, t in zip(("id", "ordered_at", "ordered_at_ts", "shipped_at", "shipped_at_ts", "ship_time", "status"), (INTEGER, DATE, DATETIME, DATE, DATETIME, TIME, STRING))])


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(ORDERS, [c.name for c in ORDER_SCHEMA.columns])


def derived(orders, expression, row=0):
    return process(orders, ORDER_SCHEMA, derive=[f"x={expression}"], columns=["id"], sort=["id"]).collect()[row].x


def test_temporal_functions(orders):
    assert derived(orders, "date_add(ordered_at, 2)") == "2024-01-03"
    assert derived(orders, "date_sub(ordered_at, 1)") == "2023-12-31"
    assert derived(orders, "date_diff_days(shipped_at, ordered_at)") == "3"
    assert derived(orders, "datetime_add_seconds(ordered_at_ts, 90)") == "2024-01-01 06:01:30"
    assert derived(orders, "datetime_diff_seconds(shipped_at_ts, ordered_at_ts)") == "274500"
    assert derived(orders, "datetime_to_date(ordered_at_ts)") == "2024-01-01"
    assert derived(orders, "datetime_to_time(shipped_at_ts)") == "10:15:00"
    assert derived(orders, "time_add_seconds(ship_time, 90)") == "06:01:30"
    assert derived(orders, 'time_diff_seconds(ship_time, "05:00:00")') == "3600"
    assert derived(orders, 'date_format(ordered_at, "%d/%m/%Y")') == "01/01/2024"
    assert derived(orders, 'datetime_format(ordered_at_ts, "%Y-%m-%dT%H:%M")') == "2024-01-01T06:00"
    assert derived(orders, "date_add(ordered_at, 2)", 2) == ""
    with pytest.raises(Exception, match="midnight"):
        derived(orders, "time_add_seconds(ship_time, 80000)")
    with pytest.raises(Exception, match="cannot read date"):
        derived(orders, "date_add(ordered_at_ts, 1)") and derived(orders, "date_add(status, 1)")


def test_expressions(orders):
    assert derived(orders, 'if(id > 1, "many", if(status == "shipped", "sent", "?"))') == "sent"
    assert derived(orders, "concat(id, \"-\", 2.0, true, (1, 2))") == "1-2true1|2"
    assert derived(orders, "7 / 2") == "3" and derived(orders, "-7 / 2") == "-3" and derived(orders, "7 / 2.0") == "3.5"
    assert derived(orders, "2 + 3 * 2 ^ 2") == "14" and derived(orders, "(id, status)") == "1|shipped"
    assert derived(orders, "c0 + row_number") == "2" and derived(orders, '!(id == 1) || status != "x"') == "true"
    assert derived(orders, "max(1, 2.5, id)") == "2.5" and derived(orders, 'str::to_uppercase(str::trim("  a "))') == "A"
    for bad in ("1 +", "nope(1)", "unknown_col", "date_add(1, 2)", "1 < \"a\"", "concat(1", "date_add(ordered_at)"):
        with pytest.raises(UserError):
            derived(orders, bad)
    assert [t for _, t in tokenize('a>=1.5&&"x y"')] == ["a", ">=", "1.5", "&&", '"x y"']
    with pytest.raises(UserError):
        spark_pattern("%Q")


def test_filters(orders):
    ids = lambda **how: [r.id for r in process(orders, ORDER_SCHEMA, columns=["id"], sort=["id"], **how).collect()]
    assert ids(filters=["ordered_at >= 2024-01-02"]) == ["2"] and ids(filters=["ordered_at ="]) == ["3"] and ids(filters=["ordered_at != 2024-01-01"]) == ["2", "3"]
    assert ids(filters=["ordered_at >= "]) == ["3"] and ids(filters=["ordered_at > "]) == [] and ids(filters=["status STARTSWITH 'sh'"]) == ["1"]
    assert ids(filter_exprs=["row_number >= 2"]) == ["2", "3"] and ids(filters=["id > 1", "status contains pe"], filter_exprs=["id < 3"]) == ["2"]
    assert parse_condition("a >= 1").op == ">=" and parse_condition("a!=b").op == "!=" and parse_condition('n = "x y"').value == "x y"
    for bad in ("id", "id > x", "nope = 1"):
        with pytest.raises(UserError):
            ids(filters=[bad])


def test_transform(orders, spark):
    out = process(orders, ORDER_SCHEMA, columns=["status,id", "id"][:1], exclude=["nothing"], sort=["status:desc,id:desc"], row_numbers=True)
    assert out.columns == ["row_number", "status", "id"]
    assert [tuple(r) for r in out.collect()] == [("1", "shipped", "1"), ("2", "open", "3"), ("3", "open", "2")]
    nulls = process(orders, ORDER_SCHEMA, columns=["id"], sort=["ordered_at:desc"], limit=2)
    assert [r.id for r in nulls.collect()] == ["2", "1"]
    ties = process(orders, ORDER_SCHEMA, columns=["id"], sort=["status"])
    assert [r.id for r in ties.collect()] == ["2", "3", "1"]
    with pytest.raises(UserError):
        parse_sort(["a:up"])
    with pytest.raises(Exception, match="cannot read"):
        process(spark.createDataFrame([("x",)], ["a"]), Schema([ColumnMeta("a", INTEGER)]), strict=True).collect()
    flags = process(spark.createDataFrame([("Yes",), ("",), ("0",)], ["b"]), Schema([ColumnMeta("b", BOOLEAN)]), boolean_format="one-zero").collect()
    assert [r.b for r in flags] == ["1", "", "0"]


def test_mappings(spark):
    rows = spark.createDataFrame([("12.345", "-87.6549", " Ab ", "2024-01-02T03:04:05Z", "7.9", "")], ["cur", "dec", "txt", "day", "num", "none"])
    dec = D("decimal(10,3)")
    schema = Schema([
        ColumnMeta("cur", CURRENCY, mappings=[Mapping(STRING, CURRENCY, "round", {"scale": 2})]),
        ColumnMeta("dec", dec, mappings=[Mapping(STRING, dec, "truncate")]),
        ColumnMeta("txt", STRING, replace=[("ab", "x"), ("x", "y")], mappings=[Mapping(STRING, STRING, "trim"), Mapping(STRING, STRING, "lowercase")]),
        ColumnMeta("day", DATE, mappings=[Mapping(STRING, DATETIME, None, {"format": "%Y-%m-%dT%H:%M:%SZ"}), Mapping(DATETIME, DATE)]),
        ColumnMeta("num", INTEGER, mappings=[Mapping(STRING, FLOAT), Mapping(FLOAT, INTEGER)]),
        ColumnMeta("none", INTEGER, mappings=[Mapping(STRING, INTEGER)]),
    ]).check()
    assert list(process(rows, schema).first()) == ["12.35", "-87.654", "x", "2024-01-02", "8", ""]
    # the emitted text is replaced once, the value behind it twice
    assert process(rows, schema, columns=["txt"], filters=["txt = y", "txt contains x"]).count() == 1
    assert list(process(rows, schema, skip_mappings=True, columns=["day"]).first()) == ["2024-01-02T03:04:05Z"]
    for step, kind in ((Mapping(STRING, FLOAT, "truncate"), FLOAT), (Mapping(STRING, dec, None, {"scale": 2}), dec), (Mapping(DATE, INTEGER), INTEGER), (Mapping(INTEGER, FLOAT, "trim"), FLOAT)):
        with pytest.raises(UserError):
            Schema([ColumnMeta("a", kind, mappings=[step])]).check()


def test_currency_digits(spark):
    """Quantising cuts digits and never adds them; what has 1 or 3 then is no currency."""
    rows = spark.createDataFrame([(v,) for v in ("12.3", "1.23", "1.234", "1.23456", "7", "1.2345", "(0.125)")], ["a"])

    def shown(scale=None, how="round", then=()):
        options = {"scale": scale} if scale else {}
        return [r.a for r in process(rows, Schema([ColumnMeta("a", then[-1].target if then else CURRENCY, mappings=[Mapping(STRING, CURRENCY, how, options), *then])])).collect()]

    assert shown(4) == [None, "1.23", None, "1.2346", "7.00", "1.2345", None]
    assert shown(2) == [None, "1.23", "1.23", "1.23", "7.00", "1.23", "-0.13"]
    assert shown() == [None, "1.23", "1.23", "1.2346", "7.00", "1.2345", "-0.13"]
    assert shown(how="truncate") == [None, "1.23", "1.23", "1.2345", "7.00", "1.2345", "-0.12"]
    assert shown(then=[Mapping(CURRENCY, CURRENCY, "round", {"scale": 2})]) == [None, "1.23", "1.23", "1.23", "7.00", "1.23", "-0.13"]
    assert shown(then=[Mapping(CURRENCY, STRING)])[3:5] == ["1.2346", "7.00"]
    found = verify.violations(rows, Schema([ColumnMeta("a", CURRENCY, mappings=[Mapping(STRING, CURRENCY, "round", {"scale": 4})])]))
    assert sorted((r.row, r.raw) for r in found.collect()) == [(2, "12.3"), (4, "1.234"), (8, "(0.125)")]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "UTC"])
def test_no_zone_moves_a_datetime(spark, zone):
    """Hours that a zone skips or repeats stay as they are written."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-03-10 02:30:00", "2024-03-31 02:30:00", "2024-11-03 01:30:00", "1969-07-20 20:17:40", "0099-01-02 03:04:05"]
        rows = spark.createDataFrame([(t, t.replace(" ", "T") + "Z") for t in texts], ["at", "other"])
        schema = Schema([ColumnMeta("at", DATETIME), ColumnMeta("other", DATETIME, mappings=[Mapping(STRING, DATETIME, None, {"format": "%Y-%m-%dT%H:%M:%SZ"})])])
        derive = ["later=datetime_add_seconds(at, 60)", 'form=datetime_format(at, "%H:%M on %d/%m/%Y (%I %p)")', "day=datetime_to_date(at)", "time=datetime_to_time(at)"]
        got = process(rows, schema, derive=derive).collect()
        for t, r in zip(texts, got):
            at = dt.datetime.fromisoformat(t)
            form = at.strftime(f"%H:%M on %d/%m/{at.year:04} (%I %p)")
            assert tuple(r) == (t, t, (at + dt.timedelta(seconds=60)).isoformat(sep=" "), form, t[:10], t[11:])
        assert process(rows, schema, filters=["at >= 2024-03-10 02:30:00"]).count() == 3
        typed = process(rows, schema, columns=["at"], as_text=False).collect()
        assert [r.at for r in typed] == [dt.datetime.fromisoformat(t) for t in texts]
        chain = Schema([ColumnMeta("at", STRING, mappings=[Mapping(STRING, DATETIME), Mapping(DATETIME, STRING, None, {"format": "%d.%m.%Y %H:%M"})]), ColumnMeta("other")])
        assert process(rows, chain).first().at == "10.03.2024 02:30"
        times = Schema([ColumnMeta("at", TIME, mappings=[Mapping(STRING, DATETIME), Mapping(DATETIME, TIME)]), ColumnMeta("other")])
        assert process(rows, times).first().at == "02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ordinals_of_shuffled_rows(spark):
    """Rows of a plan that may partition otherwise the next time are written before they are numbered."""
    rows = spark.range(1000).selectExpr("id % 37 AS k", "id").repartition(7, "k").join(spark.range(37).withColumnRenamed("id", "k"), "k")
    got = with_ordinal(rows).collect()
    assert sorted(r[ORDINAL] for r in got) == list(range(1, 1001))
    again = process(rows, columns=["id"], sort=["k"], row_numbers=True).collect()
    assert sorted(r.row_number for r in again) == list(range(1, 1001))


def test_ordinals_of_parquet_files(spark, tmp_path):
    """Rows of Parquet files are numbered where they lie, however the scan is split; a file read twice counts twice."""
    for i in range(3):
        spark.range(i * 100, i * 100 + 100, numPartitions=1).write.parquet(f"{tmp_path}/in/k={i}")
    before, size = set(storage._left), spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = with_ordinal(spark.read.parquet(f"{tmp_path}/in").select("id", (F.col("k") + 1).alias("next")))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((r.id, r.next, r[ORDINAL]) for r in got) == [(i, i // 100 + 1, i + 1) for i in range(300)]
    assert storage._left == before  # nothing was written
    twice = with_ordinal(spark.read.parquet(f"{tmp_path}/in/k=1", f"{tmp_path}/in/k=1")).collect()
    assert sorted(r[ORDINAL] for r in twice) == list(range(1, len(twice) + 1))
    named = spark.read.parquet(f"{tmp_path}/in/k=2").withColumnRenamed("id", "_metadata")
    assert sorted(tuple(r) for r in with_ordinal(named).collect()) == [(200 + i, i + 1) for i in range(100)]


@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6)), max_size=40))
@settings(max_examples=12, deadline=None)
def test_medians(spark, values):
    found = stats.summarize(spark.createDataFrame([(v,) for v in values], "v double").repartition(3)).first()
    known = [v for v in values if v is not None]
    assert found["count"] == len(known) and found.median == (statistics.median(known) if known else None)


def test_median_beside_its_bracket(spark, monkeypatch):
    """A bracket that misses the middle is widened; values outside are only counted."""
    rows = spark.range(100_001).selectExpr("CAST(id % 10007 AS DOUBLE) AS m0", "CAST('NaN' AS DOUBLE) AS m1")
    want = statistics.median(i % 10007 for i in range(100_001))
    for low, high in ((4990.0, 5020.0), (0.0, 10.0), (9000.0, 9001.0)):
        assert stats._medians(rows, [(100_001, low, high), (0, None, None)])[0] == want


def test_first_distinct_values(spark):
    rows = spark.createDataFrame([(v,) for v in ["b", "a", " b ", "NA", "", "c", "d", "e", "f", "f", "a"]], ["x"]).coalesce(1)
    found = infer.infer(rows)
    assert found.observations == ["b (2), a (2), c (1), d (1), e (1), other (2)"] and found.samples == ["b"]


def test_schema_files(tmp_path):
    schema = manual_schema(["id:integer->key,name:string"], ["name=a->b"])
    schema.columns[0].mappings = [Mapping(STRING, INTEGER)]
    schema.save(tmp_path / "s.yml")
    again = Schema.load(tmp_path / "s.yml")
    assert again == schema and again.find("key").name == "id"
    with pytest.raises(UserError):
        again.check_headers(["id"])
    again.check_headers(["key", "name"])
    for bad in (["id"], ["id:what"], ["a:int,a:int"]):
        with pytest.raises(UserError):
            manual_schema(bad)


def test_stats(orders):
    found = {r[0]: r for r in stats.summary_table(stats.summarize(orders, ORDER_SCHEMA), {c.name: c.type for c in ORDER_SCHEMA.columns})[1]}
    assert found["id"] == ["id", "3", "1", "3", "2", "2", "1"]
    assert found["ordered_at"] == ["ordered_at", "2", "2024-01-01", "2024-01-03", "2024-01-02", "2024-01-02", "1.4142 days"]
    assert found["ship_time"][2:6] == ["06:00:00", "12:30:00", "09:15:00", "09:15:00"]
    freq = [tuple(r) for r in stats.frequency(orders, ORDER_SCHEMA, columns=["status", "ordered_at"], top=1).orderBy("column").collect()]
    assert freq == [("ordered_at", "2024-01-01", 1, 33.33, 1), ("status", "open", 2, 66.67, 1)]
    with pytest.raises(UserError):
        stats.summarize(orders, ORDER_SCHEMA, columns=["status"])


def test_append_and_join(spark):
    a, b = spark.createDataFrame([("1", "x"), ("", "y")], ["k", "v"]), spark.createDataFrame([("1", "p"), ("", "q"), ("3", "r")], ["k", "v"])
    assert combine.append([a, b]).count() == 5
    with pytest.raises(UserError):
        combine.append([a, b.toDF("k", "w")])
    with pytest.raises(Exception, match="cannot read"):
        combine.append([a], Schema([ColumnMeta("k", INTEGER), ColumnMeta("v", INTEGER)])).collect()
    full = combine.join(a, b, "k", "k", "full")
    assert full.columns == ["k", "v", "right_v_1"]
    assert sorted(map(tuple, full.collect()), key=str) == [("", "y", "q"), ("1", "x", "p"), ("3", None, "r")]
    with pytest.raises(UserError):
        combine.join(a, b, "k", "k", "inner", Schema([ColumnMeta("k", DATE), ColumnMeta("v")]), None)


def test_verify(spark):
    schema = Schema([ColumnMeta("id", INTEGER), ColumnMeta("amount", FLOAT, "total")])
    rows = spark.createDataFrame([("1", "2.5"), ("x", "oops"), ("3", "")], ["id", "amount"])
    found = verify.violations(rows, schema)
    assert [(r.row, r.column, r.raw) for r in verify.details(found).collect()] == [(3, "id", "x"), (3, "total", "oops")]
    assert [tuple(r) for r in verify.summary(found).collect()] == [("id", 1), ("total", 1)]
    with pytest.raises(UserError, match="row 3"):
        verify.assert_valid(rows, schema)
    assert verify.Report.parse([]) == verify.Report(summary=True) and verify.Report.parse(["5"]) == verify.Report(detail=True, limit=5)
    assert verify.Report.parse(["detail:summary:3"]) == verify.Report(True, True, 3)


def test_infer(spark):
    rows = spark.createDataFrame(
        [("1", "1.50", "$2.00", "yes", "2024-01-02", "NA", "007", "06:00", "1e3"), ("2", "10.255", "($3.00)", "no", "2024-02-03", "x", "8", "07:30", "2"), ("300", "unknown", "€1", "t", "03/02/2024", "#n/a", "9", "", "-")],
        ["i", "d", "c", "b", "day", "s", "z", "t", "e"],
    )
    assert [str(t) for t in infer.infer_types(rows, 0)] == ["integer", "decimal(5,3)", "currency", "boolean", "date", "string", "string", "time", "decimal(4,0)"]
    found = infer.infer(rows, overrides=["i:string"], mapping=False)
    assert found.schema.columns[0].type == STRING and found.placeholders == {"d": [("unknown", 1)], "s": [("#n/a", 1), ("NA", 1)], "e": [("-", 1)]}
    assert "Signature: sha256:" in infer.probe_report(found, 2000)
    assert infer.placeholder_replacements(found, "fill", "0").columns[1].replace == [("unknown", "0")]
    assert infer.has_header([["id", "name"], ["1", "Ann"]]) and not infer.has_header([["1", "2"], ["3", "4"]])
    repeated = spark.createDataFrame([("id", "name", "city", "state"), ("1", "a", "b", "c")], ["id", "name", "city", "state"])
    assert str(infer.infer_types(repeated)[0]) == "integer"
    empty = spark.createDataFrame([], "a string")
    assert infer.infer_types(empty) == [STRING]


def test_cluster(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 7), str(i)) for i in range(50)], ["a", "b"])
    schema = Schema([ColumnMeta("a", INTEGER), ColumnMeta("b", INTEGER)])
    index = cluster.build(rows, str(tmp_path / "ix"), cluster.expand_covering("v=a:asc|desc,b"), schema)
    assert [v.name for v in index.variants] == ["v_a-asc", "v_a-desc", "v_a-asc_b-asc", "v_a-desc_b-asc"]
    sort = parse_sort(["a:desc,b"])
    best = index.pick(sort)
    assert best.name == "v_a-desc_b-asc" and index.pick(parse_sort(["b"])) is None
    plain, fast = (process(x, schema, sort=["a:desc,b"], limit=10).collect() for x in (rows, index.read(best)))
    assert plain == fast
    for how in (dict(limit=3), dict(limit=12, filters=["b > 20"]), dict(limit=0), dict(limit=500, filter_exprs=["row_number % 2 == 0"]), dict(), dict(limit=2, filters=["b > 1000"])):
        assert index.process(best, schema, sort=["a:desc,b"], **how).collect() == process(rows, schema, sort=["a:desc,b"], **how).collect()
    many = cluster.build(rows, str(tmp_path / "many"), [cluster.parse_variant("a:desc")], schema, partitions=7, source="v1")
    top = many.process(many.variants[0], schema, sort=["a:desc,b"], limit=4)
    assert len(top.inputFiles()) == 1 and [r.b for r in top.collect()] == ["6", "13", "20", "27"]
    with pytest.raises(UserError, match="changed"):
        cluster.load(spark, str(tmp_path / "many")).check("v2")
    with pytest.raises(UserError):
        index.pick(sort, "v_a-asc")
    part = cluster.build(rows, str(tmp_path / "part"), [cluster.parse_variant("a")], schema, limit=5)
    with pytest.raises(UserError):
        part.read(part.variants[0])


def test_index_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """A larger input has more files than were asked for, not larger ones; their rows stand in the table beside them."""
    monkeypatch.setattr(cluster, "ROWS_A_FILE", 100, raising=False)
    rows = spark.range(2000).selectExpr("id * 7919 % 2000 AS a", "id")
    for partitions in (2, None):
        index = cluster.build(rows, f"{tmp_path}/{partitions}", [cluster.parse_variant("v=a:desc")], partitions=partitions)
        files = {r.file: r.rows for r in spark.read.parquet(f"{tmp_path}/{partitions}/v.files").collect()}
        kept = {os.path.basename(p): spark.read.parquet(p).count() for p in glob.glob(f"{tmp_path}/{partitions}/v/*.parquet")}
        assert files == {f: n for f, n in kept.items() if n} and len(files) >= 20 and max(files.values()) < 400
        top = index.process(index.variants[0], sort=["a:desc"], limit=30, filters=["a < 1900"])
        assert [r.a for r in top.collect()] == list(range(1899, 1869, -1)) and len(top.inputFiles()) < len(files)
    small = cluster.build(rows.limit(50), f"{tmp_path}/small", [cluster.parse_variant("v=a")], partitions=3)
    assert spark.read.parquet(f"{tmp_path}/small/v.files").count() == 3 and small.rows == 50


def test_table_rendering():
    assert render_table(["a", "long"], [["1", "x\ny"], ["\x1b[31mred\x1b[0m", ""]]).splitlines()[0] == "a    long"
    assert render_table(["a"], [["é"]]) == "a\n---\né\n"
