"""Command line, HTTP, streams and other formats."""

import json
import urllib.request

import pyarrow as pa

from lithic import open_database
from lithic.cli import run
from lithic.server import serve
from lithic.sources.formats import read_arrow, to_csv_text, write_ready_parquet
from lithic.streaming.append import append_stream, changes


def test_command_line(spark, tmp_path):
    db, said = str(tmp_path / "db"), []
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f:
        t = pa.table({"k": pa.array([1, 2, 3], pa.int64()), "s": ["x", None, "z"]})
        with pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t)
    go = lambda *a: run(spark, [db, *a], said.append)
    go("create", "t", "k bigint, s string")
    go("insert", "t", str(tmp_path / "a.arrow"))
    go("index", "t", "pk", "k", "--unique")
    go("mutate", "delete from t where k = 2")
    go("query", "select k, s from t order by k", "--format", "csv")
    assert said == [3, 1, "k,s\n1,x\n3,z\n"]
    go("export-tsv", "t", str(tmp_path / "t.tsv"))
    go("import-tsv", "u", str(tmp_path / "t.tsv"))
    go("create-view", "v", "select count(*) n from t")
    go("refresh-view", "v")
    go("compact", "t")
    go("optimize", "t")
    assert go("check", "t") == 0 and go("doctor", "t") == 0 and go("gc", "t") == 0
    go("query", "select n from v")
    assert said[-1] == '{"n":2}'
    go("drop", "u")
    go("tables")
    assert said[-1].split() == ["t", "v"]


def test_http(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "db"))
    db.create_table("t", "k bigint, s string")
    server = serve(db)

    def post(path, **body):
        req = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", json.dumps(body).encode())
        try:
            return json.load(urllib.request.urlopen(req, timeout=60))
        except urllib.error.HTTPError as e:
            return json.load(e)

    tx = post("/tx/begin")["tx"]
    post("/tx/insert", tx=tx, table="t", rows=[[1, "a"], [2, None]])
    assert post("/sql", sql="select count(*) n from t") == {"rows": [{"n": 0}]}
    assert post("/tx/commit", tx=tx) == {"rows": 2}
    assert post("/mutate", sql="update t set s = 'q' where k = 2") == {"rows": 1}
    assert post("/sql", sql="select k, s from t order by k") == {"rows": [{"k": 1, "s": "a"}, {"k": 2, "s": "q"}]}
    assert post("/sql", sql="select count(*) n from t", snapshot=0) == {"rows": [{"n": 0}]}
    assert post("/tables") == {"tables": ["t"]} and post("/sql", sql="drop table t")["error"] == "Unsupported"
    server.shutdown()


def test_stream_and_changes(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "db"))
    t = db.create_table("t", "k bigint, v bigint")
    src = str(tmp_path / "in")
    spark.range(5).selectExpr("id as k", "id * 2 as v").write.parquet(src)
    for n in (5, 8):
        stream = spark.readStream.schema("k bigint, v bigint").parquet(src)
        append_stream(stream, t, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
        assert db.sql("select count(*) n from t").first().n == n
        spark.range(10, 13).selectExpr("id as k", "id as v").write.mode("append").parquet(src)
    seq = t.sequence
    db.mutate("update t set v = 100 where k = 1")
    db.mutate("delete from t where k = 2")
    got = sorted((r._change, r.k, r.v) for r in changes(t, seq).collect())
    assert got == [("delete", 1, 2), ("delete", 2, 4), ("insert", 1, 100)]


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(2, [1]), (1, None)], "a int, b array<int>")
    assert to_csv_text(df.orderBy("a")) == "a,b\n1,\n2,[1]\n"
    write_ready_parquet(df, str(tmp_path / "p"), ["a"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as f:
        t = pa.table({"x": [1.5, 2.5]})
        with pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
    assert read_arrow(spark, str(tmp_path / "s.arrow")).agg({"x": "sum"}).first()[0] == 4.0
