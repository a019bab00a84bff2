import io
from types import SimpleNamespace

import pytest

from quillframe.errors import UserError
from quillframe.plans.cli import main, normalize_argv
from quillframe.schema import Schema
from quillframe.sources import delimited as D
from quillframe.streaming.rowlocal import process_stream

CSV = 'id,name,amount,day\n1,"Ann, ""A""",2.50,2024-01-02\n2,Bob,oops,2024-02-03\n3,"two\nlines",,\n'


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in.csv").write_text(CSV, encoding="utf-8")
    (tmp_path / "good.csv").write_text(CSV.replace("oops", "7"), encoding="utf-8")
    return SimpleNamespace(dir=tmp_path, bad=str(tmp_path / "in.csv"), good=str(tmp_path / "good.csv"), schema=str(tmp_path / "s.yml"), out=str(tmp_path / "out.csv"))


def run(spark, capsys, *argv):
    code = main([str(a) for a in argv], spark)
    caught = capsys.readouterr()
    return code, caught.out, caught.err


def test_infer_process_verify(spark, files, capsys):
    assert run(spark, capsys, "schema", "infer", "-i", files.good, "-o", files.schema)[0] == 0
    assert [str(c.type) for c in Schema.load(files.schema).columns] == ["integer", "string", "decimal(3,2)", "date"]
    code, out, _ = run(spark, capsys, "process", "-i", files.good, "-m", files.schema, "-C", "name,id", "--derive", "twice=amount * 2", "--sort", "id:desc", "--row-numbers")
    assert code == 0 and out == '"row_number","name","id","twice"\n"1","two\nlines","3",""\n"2","Bob","2","14"\n"3","Ann, ""A""","1","5"\n'
    assert run(spark, capsys, "process", "-i", files.good, "-m", files.schema, "-o", files.out, "--output-delimiter", "pipe", "--filter", "id = 2")[0] == 0
    assert open(files.out).read() == '"id"|"name"|"amount"|"day"\n"2"|"Bob"|"7"|"2024-02-03"\n'
    code, _, err = run(spark, capsys, "process", "-i", files.bad, "-m", files.schema, "-C", "id")
    assert code == 1 and "error" in err  # any bad cell fails the run
    code, out, err = run(spark, capsys, "schema", "verify", "-m", files.schema, "-i", files.bad, "--report-invalid:detail:summary")
    assert code == 1 and "Found 1 invalid value(s)" in err and "oops" in out and "amount" in out
    assert run(spark, capsys, "schema", "verify", "-m", files.schema, "-i", files.good)[0] == 0
    code, out, _ = run(spark, capsys, "process", "-i", files.good, "--preview")
    assert code == 0 and out.startswith("id  name")
    assert run(spark, capsys, "process", "-i", files.good, "--preview", "-o", files.out)[0] == 1


def test_index_stats_append_join(spark, files, capsys):
    run(spark, capsys, "schema", "infer", "-i", files.good, "-o", files.schema)
    index = str(files.dir / "ix")
    assert run(spark, capsys, "index", "-i", files.good, "-o", index, "--spec", "big=id:desc", "-m", files.schema)[0] == 0
    code, out, _ = run(spark, capsys, "process", "-i", files.good, "-m", files.schema, "-x", index, "--index-variant", "big", "--sort", "id:desc", "-C", "id", "--limit", "2")
    assert code == 0 and out == '"id"\n"3"\n"2"\n'
    assert run(spark, capsys, "process", "-i", files.good, "-x", index, "--index-variant", "no", "--sort", "id:desc")[0] == 1
    code, out, _ = run(spark, capsys, "process", "-i", files.bad, "-m", files.schema, "-x", index, "--sort", "id:desc", "-C", "id")
    assert code == 1  # the index is of another input
    flat = files.dir / "flat.csv"
    flat.write_text("id,v\n1,a\n2,b\n")
    code, out, _ = run(spark, capsys, "process", "-i", flat, "--no-multiline", "--sort", "id:desc")
    assert code == 0 and out == '"id","v"\n"2","b"\n"1","a"\n'
    code, out, _ = run(spark, capsys, "stats", "-i", files.good, "-m", files.schema, "-C", "amount,id")
    assert code == 0 and out.splitlines()[2].split() == ["amount", "2", "2.50", "7.00", "4.75", "4.75", "3.18"]
    code, out, _ = run(spark, capsys, "stats", "-i", files.good, "-m", files.schema, "--frequency", "-C", "day", "--top", "3")
    assert code == 0 and "33.33%" in out and "<empty>" in out
    code, out, _ = run(spark, capsys, "append", "-i", files.good, "-i", files.good)
    assert code == 0 and out.count("Bob") == 2 and out.count('"id"') == 1
    code, out, _ = run(spark, capsys, "join", "--left", files.good, "--right", files.good, "--left-key", "id", "--right-key", "id", "--type", "left")
    assert code == 0 and "right_name_1" in out and out.count("Bob") == 2


def test_probe_snapshot_manual(spark, files, capsys):
    snap = str(files.dir / "snap.txt")
    assert run(spark, capsys, "schema", "probe", "-i", files.good, "--snapshot", snap)[0] == 0
    assert run(spark, capsys, "schema", "probe", "-i", files.good, "--snapshot", snap)[0] == 0
    assert run(spark, capsys, "schema", "probe", "-i", files.bad, "--snapshot", snap)[0] == 1
    assert run(spark, capsys, "schema", "-o", files.schema, "-c", "id:integer->key,name:string")[0] == 0
    code, out, _ = run(spark, capsys, "schema", "columns", "-m", files.schema)
    assert code == 0 and "key" in out
    code, out, _ = run(spark, capsys, "schema", "infer", "-i", files.good, "--diff", files.schema, "--preview")
    assert code == 0 and "+- name: amount" in out


def test_sources(spark, tmp_path, monkeypatch):
    ragged = tmp_path / "r.csv"
    ragged.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        D.read_delimited(spark, str(ragged)).collect()
    bare = tmp_path / "b.tsv"
    bare.write_text("1\t2.5\n3\t4\n")
    assert D.read_delimited(spark, str(bare)).columns == ["field_0", "field_1"]
    coded = tmp_path / "c.csv"
    coded.write_bytes("näme\nö\n".encode("cp1252"))
    assert D.read_delimited(spark, str(coded), code="windows-1252").first()[0] == "ö"
    out = tmp_path / "o.csv"
    for code in ("latin-1", "ascii", "cp1252"):
        with pytest.raises(UserError):
            D.write_delimited(spark.createDataFrame([("日",)], ["a"]), str(out), code=code)
    D.write_delimited(spark.createDataFrame([("é \"x\"", None), ("", "y")], "a string, b string").coalesce(1), str(out), code="latin-1", sep=";")
    assert out.read_bytes() == '"a";"b"\n"é ""x""";""\n"";"y"\n'.encode("latin-1") and not list(tmp_path.glob("*.parts-*")) and not list(tmp_path.glob(".*crc"))
    D.write_delimited(spark.range(1000).repartition(5).sort("id"), str(out))
    assert out.read_text().splitlines() == ['"id"'] + [f'"{i}"' for i in range(1000)]
    D.write_delimited(spark.range(0), str(out))
    assert out.read_text() == '"id"\n'


def test_undecodable_input(spark, tmp_path, capsys):
    """A wrong byte fails the job; inference skips and counts such cells; U+FFFD itself is text."""
    bad = tmp_path / "bad.csv"
    bad.write_bytes(b"\xef\xbb\xbfname,qty\ncaf\xe9,1\n\xef\xbf\xbd ok,2\n\xc3\xa9,3\n")
    with pytest.raises(Exception, match="cannot be decoded"):
        D.read_delimited(spark, str(bad)).collect()
    assert [tuple(r) for r in D.read_delimited(spark, str(bad), undecoded="skip").collect()] == [("", "1", 1), ("\ufffd ok", "2", 0), ("é", "3", 0)]
    code, out, _ = run(spark, capsys, "schema", "probe", "-i", str(bad))
    assert code == 0 and "could not be decoded: 1" in out
    assert run(spark, capsys, "process", "-i", str(bad))[0] == 1
    wide = tmp_path / "wide.csv"
    wide.write_bytes("a\nx\n".encode("utf-16"))
    assert D.read_delimited(spark, str(wide), code="utf-16", header=True).first()[0] == "x"
    with pytest.raises(UserError):
        D.delimiter("ab")
    assert D.delimiter("pipe") == "|" and D.output_delimiter("x.tsv", None, ",") == "\t" and D.output_delimiter(None, None, ";") == ";"
    assert open(D.spool_stdin(spark, io.BytesIO(b"a\n1\n"))).read() == "a\n1\n"
    assert normalize_argv(["--report-invalid:detail:5"]) == ["--report-invalid", "detail", "5"]


def test_stream(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 AS g").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id long, g long").parquet(str(tmp_path / "s"))
    query = process_stream(stream, filters=["g = 1"], derive=["twice=id * 2"]).writeStream.format("memory").queryName("rowlocal").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.twice for r in spark.sql("SELECT twice FROM rowlocal").collect()) == [2 * i for i in range(20) if i % 3 == 1]
    with pytest.raises(UserError):
        process_stream(stream, filter_exprs=["row_number > 1"])
