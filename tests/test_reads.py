"""Which files reads touch, answers with all kinds of literals, and mutations whose conditions move."""

import random
import threading

import pytest

from lithic import open_database
from lithic.errors import CommitConflict, Unsupported
from lithic.operators import unique
from lithic.sources import maintenance
from lithic.sources.table import Table
from lithic.sources.tsv import read_tsv
from lithic.streaming.append import append_stream

ROWS = "id as k, cast(id as double) / 4 as x, cast(id as decimal(12,2)) / 4 as d, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) as ts, concat('s''', id % 7) as s, cast(id % 5 as int) as p"


@pytest.fixture()
def db(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "db"))
    t = db.create_table("t", "k bigint, x double, d decimal(12,2), ts timestamp_ntz, s string, p int", group_keys=["p"])
    for lo in range(0, 40, 10):
        t.insert(spark.sql(f"select {ROWS} from range({lo}, {lo + 10})").coalesce(1))
    yield db
    db.close()


CONDITIONS = [
    ("x > 1.5", lambda k: k / 4 > 1.5), ("x < 4.25", lambda k: k / 4 < 4.25), ("10.25 > t.x", lambda k: k / 4 < 10.25), ("x = 2.75", lambda k: k == 11),
    ("d >= 2.75", lambda k: k >= 11), ("d < 2.750001", lambda k: k <= 11), ("x > 1e0", lambda k: k > 4), ("k > 12.5", lambda k: k > 12), ("k < 2.0", lambda k: k < 2), ("x > -0.5", lambda k: True),
    ("ts < timestamp_ntz'2024-01-05 00:00:00'", lambda k: k < 4), ("ts >= timestamp_ntz'2024-01-20 12:00:00'", lambda k: k >= 20), ("`t`.`k` between 5 and 14", lambda k: 5 <= k <= 14),
    ("s = 's''3'", lambda k: k % 7 == 3), ("s > 's''5'", lambda k: k % 7 > 5), ("k in (3, 17, 99)", lambda k: k in (3, 17)), ("k in (3.0, 17.5)", lambda k: k == 3), ("not (x <= 2.5)", lambda k: k > 10), ("x > 1.5 and s <> 's''1'", lambda k: k > 6 and k % 7 != 1),
    ("x > 9.0 or k < 2", lambda k: k > 36 or k < 2), ("d is null", lambda k: False), ("d is not null and x <= 0.25", lambda k: k <= 1), ("k <=> 7", lambda k: k == 7), ("cast(x as int) = 3", lambda k: k // 4 == 3), ("k + 1 > 20.5", lambda k: k >= 20),
]


@pytest.mark.parametrize("dirty", [False, True])
def test_conditions_on_stored_tables(db, dirty):
    live = set(range(40))
    if dirty:
        db.mutate("delete from t where k in (0, 11, 12, 39)")
        live -= {0, 11, 12, 39}
    for cond, holds in CONDITIONS:
        want = sorted(k for k in live if holds(k))
        assert sorted(r.k for r in db.sql(f"select k from t where {cond}").collect()) == want, cond
        n, s, lo, f = db.sql(f"select count(*) n, sum(k) s, min(k) lo, sum(x) f from t where {cond}").first()
        assert (n, s or 0, lo) == (len(want), sum(want), min(want, default=None)) and abs((f or 0) - sum(want) / 4) < 1e-9, cond


@pytest.mark.parametrize("part", range(3))
def test_mutations_with_decimal_conditions(db, part):
    live = {k: k / 4 for k in range(40)}
    for cond, holds in CONDITIONS[part::3]:
        hit = [k for k, x in live.items() if holds(k)]
        if part == 1:
            assert db.mutate(f"update t set p = 77 where {cond}") == len(hit), cond
            assert sorted(r.k for r in db.sql("select k from t where p = 77").collect()) == hit, cond
            db.mutate("update t set p = 1 where p = 77")
        else:
            assert db.mutate(f"delete from t where {cond}") == len(hit), cond
            live = {k: x for k, x in live.items() if k not in hit}
            assert sorted(r.k for r in db.sql("select k from t").collect()) == sorted(live), cond
            if len(live) < 20:
                break
    assert maintenance.check(db.table("t")) == []


def files(df):
    return len([f for f in df.inputFiles() if "/data/" in f])


def test_reads_touch_only_fragments_that_matter(db, spark, tmp_path):
    assert files(db.sql("select * from t")) == 4
    assert files(db.sql("select * from t where k = 18")) == 1
    assert files(db.sql("select * from t where x > 1.5 and x < 2.0")) == 1
    assert files(db.sql("select s from t where k < 12 and d > 1")) == 2
    assert files(db.sql("select a.k from t a join t b on a.k = b.k where a.k = 5 and b.k > 25")) <= 3
    assert files(db.sql("select k from t where k > 1000")) == 0
    assert files(db.sql("select * from t where k = 18 or s = 'x'")) == 4
    db.mutate("delete from t where k = 3")
    assert files(db.sql("select * from t where k = 18")) == 1 and db.sql("select * from t where k < 5").count() == 4
    assert db.sql("select * from t").count() == 39  # the views are whole again
    parted = db.create_table("parted", "k bigint, b string", partition_by=["b"])
    parted.insert(spark.sql("select id as k, concat('b', id % 4) as b from range(40)"))
    assert files(db.sql("select * from parted where b = 'b2'")) == 1 and db.sql("select * from parted where b = 'b2'").count() == 10


def test_index_is_used_by_sql_and_kept_up(db, spark):
    t = db.table("t")
    t.insert(spark.sql(f"select {ROWS} from (select id * 1000 as id from range(1, 9))").coalesce(1))
    unique.create_index(t, "ik", "k")
    assert files(db.sql("select * from t where k = 3000")) == 1
    t.insert(spark.sql(f"select {ROWS} from (select id * 900 as id from range(1, 9))").coalesce(1))
    assert all(set(i["covers"]) == {f["id"] for f in t.manifest()["fragments"]} for i in t.manifest()["indexes"])
    assert files(db.sql("select * from t where k = 3000")) == 1 and db.sql("select * from t where k in (3000, 2700)").count() == 2
    db.mutate("update t set k = 2701 where k = 2700")
    assert db.sql("select * from t where k = 2701").count() == 1 and db.sql("select * from t where k = 2700").count() == 0


def test_warm_groups_after_a_mutation(db):
    db.mutate("delete from t where k = 3")
    df = db.sql("select p, sum(k) s, count(x) n, avg(x) a from t group by p")
    assert files(df) == 1  # only the touched fragment is scanned
    want = {p: [k for k in range(40) if k % 5 == p and k != 3] for p in range(5)}
    assert {r.p: (r.s, r.n, r.a) for r in df.collect()} == {p: (sum(ks), len(ks), sum(ks) / 4 / len(ks)) for p, ks in want.items()}


def test_conditions_that_move(spark, tmp_path):
    """Rows that a clock condition patches are those that it marks."""
    db = open_database(spark, str(tmp_path / "c"))
    t = db.create_table("c", "k bigint, s string")
    now = spark.sql("select unix_millis(current_timestamp()) as n").first().n
    t.insert(spark.range(600).selectExpr(f"{now} + id * 10 as k", "'a' as s").repartition(3))
    n = db.mutate("update c set s = 'z' where k < unix_millis(current_timestamp())")
    assert db.sql("select * from c").count() == 600 and db.sql("select * from c where s = 'z'").count() == n
    n = db.mutate("update c set s = 'r' where rand() < 0.5")
    assert db.sql("select * from c").count() == 600 and db.sql("select * from c where s = 'r'").count() == n
    left = 600 - db.mutate("delete from c where rand() < 0.3")
    assert db.sql("select * from c").count() == left and maintenance.check(t) == []


def test_bulk_mutations_beyond_held_rows(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "b"))
    t = db.create_table("b", "k bigint, v double")
    t.insert(spark.range(12_000).selectExpr("id as k", "id / 2 as v").repartition(3))
    assert db.mutate("update b set v = -v where k % 2 = 0") == 6000 and db.mutate("delete from b where k % 3 = 0") == 4000
    want = [(k, -k / 2 if k % 2 == 0 else k / 2) for k in range(12_000) if k % 3]
    assert sorted((r.k, r.v) for r in db.sql("select * from b").collect()) == want and maintenance.check(t) == []
    assert tuple(db.sql("select count(*) n, min(k) lo, max(k) hi from b").first()) == (8000, 1, 11999)


def test_merge_arms(db, spark):
    unique.create_index(db.table("t"), "pk", "k", unique=True)
    spark.createDataFrame([(1, 10), (2, 20), (3, 30), (100, 1), (101, -1)], "k long, v int").createOrReplaceTempView("src")
    n = db.mutate("merge into t using src s on t.k = s.k when matched and s.v = 10 then delete when matched and s.v > 25 then update set p = s.v when not matched and s.v > 0 then insert (k, p) values (s.k, s.v)")
    assert n == 3
    assert {r.k: r.p for r in db.sql("select k, p from t where k < 4 or k > 50").collect()} == {0: 0, 2: 2, 3: 30, 100: 1}
    with pytest.raises(Unsupported):
        db.mutate("merge into t using src s on t.k = s.k when not matched by source then delete")


def test_cached_results_never_outlive_a_view(db, spark):
    held = open_database(spark, db.path, cache_mb=16)
    spark.range(3).createOrReplaceTempView("moving")
    assert held.sql("select count(*) n from moving m join t on m.id = t.k").first().n == 3
    spark.range(7).createOrReplaceTempView("moving")
    assert held.sql("select count(*) n from moving m join t on m.id = t.k").first().n == 7
    q = "select s, count(*) n from t group by s order by s"
    assert held.sql(q).collect() == held.sql(q).collect() and len(held.cache.held) == 1


def test_tsv_rows_that_equal_the_header(spark, tmp_path):
    for n, text in enumerate(("s\ns\nx\n\ns\n", "s\ny\n")):
        (tmp_path / f"{n}.tsv").write_text(text)
    assert sorted(str(r.s) for r in read_tsv(spark, str(tmp_path)).collect()) == ["None", "s", "s", "x", "y"]


def test_streams_store_a_batch_once(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "s"))
    t = db.create_table("s", "k bigint")
    spark.range(5).selectExpr("id as k").write.parquet(str(tmp_path / "in"))
    stream = lambda c: append_stream(spark.readStream.schema("k bigint").parquet(str(tmp_path / "in")), t, c, availableNow=True).awaitTermination()
    stream(str(tmp_path / "cp"))
    assert t.manifest()["streams"] == {str(tmp_path / "cp"): 0} and t.sequence == 1
    t.insert(spark.range(5).selectExpr("id as k"), {str(tmp_path / "cp"): 1})
    stream(str(tmp_path / "cp"))
    spark.range(5, 9).selectExpr("id as k").write.mode("append").parquet(str(tmp_path / "in"))
    stream(str(tmp_path / "cp"))  # batch 1, which the table names already
    assert t.live().count() == 10 and t.sequence == 2


def test_writers_at_the_same_time(spark, tmp_path):
    """One of two writers of a snapshot wins, no catalog entry is lost, and a failed commit leaves no trace."""
    a, b = open_database(spark, str(tmp_path / "w")), open_database(spark, str(tmp_path / "w"))
    made = [threading.Thread(target=d.create_table, args=(f"{n}{i}", "k bigint")) for n, d in (("a", a), ("b", b)) for i in range(3)]
    for m in made:
        m.start()
    for m in made:
        m.join()
    assert sorted(a.tables()) == [f"{n}{i}" for n in "ab" for i in range(3)]
    t, u = a.table("a0"), Table(spark, a.table("a0").path)
    base = t.manifest()
    t.insert(spark.range(3).selectExpr("id as k"))
    with pytest.raises(CommitConflict):
        u.commit(base, fragments=[])
    assert a.sql("select count(*) n from a0").first().n == 3


def test_random_conditions_against_plain_spark(db, spark):
    """Pruned reads give what Spark gives over all rows."""
    rng = random.Random(9)
    db.mutate("update t set x = x + 0.125 where k % 6 = 1")
    db.table("t").live().createOrReplaceTempView("plain")
    term = lambda: rng.choice([f"k {rng.choice(['<', '>', '=', '<>', '<=', '>='])} {rng.choice([rng.randrange(45), rng.random() * 45])}", f"x {rng.choice('<>=')} {rng.randrange(40) / 8}", f"d {rng.choice('<>')} {rng.randrange(40) / 8}", f"s in ('s''{rng.randrange(7)}', 'q')", f"p = {rng.randrange(6)}"])
    for _ in range(12):
        cond = f"{term()} {rng.choice(['and', 'or'])} {term()} and not ({term()})"
        assert sorted(map(str, db.sql(f"select * from t where {cond}").collect())) == sorted(map(str, spark.sql(f"select * from plain where {cond}").collect())), cond


def test_transactions_over_tables(spark, tmp_path):
    """Changes of several tables become visible together, are seen inside before, and leave no trace when rolled back."""
    db, other = open_database(spark, str(tmp_path / "x")), open_database(spark, str(tmp_path / "x"))
    for n in ("a", "b"):
        db.create_table(n, "k bigint, v bigint").insert(spark.range(10).selectExpr("id as k", "id * 10 as v"))
    tx = db.transaction()
    assert tx.mutate("delete from a where k < 3") == 3 and tx.mutate("update b set v = 0 where k = 5") == 1
    assert tx.mutate("insert into a (k, v) values (100, 1)") == 1 and tx.mutate("update a set v = 2 where k = 100") == 1
    assert tx.sql("select count(*) n from a").first().n == 8
    for d in (db, other):
        assert d.sql("select count(*) n from a").first().n == 10 and d.sql("select sum(v) s from b").first().s == 450
    with pytest.raises(CommitConflict):
        other.mutate("delete from a where k = 9")
    assert tx.commit() == 6
    for d in (db, other):
        assert d.sql("select count(*) n from a").first().n == 8 and d.sql("select sum(v) s from b").first().s == 400
    assert db.sql("select v from a where k = 100").first().v == 2 and db.table("a").verify_history() == []
    before = db.table("a").sequence
    with pytest.raises(ValueError), db.transaction() as tx:
        tx.mutate("delete from a")
        raise ValueError
    assert db.table("a").sequence == before and db.sql("select count(*) n from a").first().n == 8
    dead = db.transaction()  # its writer dies
    dead.mutate("delete from b")
    assert other.sql("select count(*) n from b").first().n == 10 and len(maintenance.doctor(other.table("b"), repair=True)) > 0
    assert other.mutate("delete from b where k = 0") == 1 and other.sql("select count(*) n from b").first().n == 9
    with pytest.raises(Unsupported):
        tx.mutate("delete from a")


def test_databases_with_tables_of_one_name(spark, tmp_path):
    a, b = (open_database(spark, str(tmp_path / n), tiny_rows=t) for n, t in (("a", 0), ("b", 100)))
    for n, d in enumerate((a, b), 1):
        d.create_table("t", "k bigint").insert(spark.range(10 * n).selectExpr("id as k"))
    for _ in range(2):
        assert a.sql("select k from t").count() == 10 and b.sql("select k from t").count() == 20
    assert files(b.sql("select k from t where k > 3")) == 0  # held in memory
    b.mutate("delete from t where k < 5")
    assert b.sql("select k from t").count() == 15 and a.sql("select k from t").count() == 10


def test_statistics_and_row_ids(db):
    s = {r.column: r for r in db.statistics("t").collect()}
    assert (s["k"].rows, s["k"].nulls, s["k"].lo, s["k"].hi, s["k"].exact) == (40, 0, "0", "39", True)
    ids = {r.k: r._rowid for r in db.sql("select k, _rowid from t__rows where k in (5, 25)").collect()}
    db.mutate("update t set s = 'new' where k = 25")
    found = db.rows_by_id("t", list(ids.values()))
    assert {(r.k, r._rowid) for r in found.collect()} == set(ids.items()) and files(found) <= 3
    db.mutate("delete from t where k = 39")
    s = {r.column: r for r in db.statistics("t").collect()}["k"]
    assert (s.rows, s.hi, s.exact) == (39, "38", True)  # a tenth of the fragment is gone, so it was counted anew


def test_broken_chain_and_broken_manifest(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "h"))
    t = db.create_table("h", "k bigint")
    for n in range(3):
        t.insert(spark.range(n, n + 2).selectExpr("id as k"))
    t.files.create("manifests/000000002.json", t.files.read("manifests/000000002.json") + " ", overwrite=True)
    fresh = Table(spark, t.path)
    assert fresh.verify_history() == ["snapshot 3 doesn't name the hash of 2"] and maintenance.check(fresh) != []
    t.files.create("manifests/000000003.json", "{", overwrite=True)
    fresh = Table(spark, t.path)
    assert maintenance.doctor(fresh) == ["manifest 3 can't be read"]
    maintenance.doctor(fresh, repair=True)
    assert Table(spark, t.path).sequence == 2


def test_joins_read_only_fragments_of_the_other_side(db, spark):
    """The keys of a small build side, or their range, narrow the probe side; results stay those of plain Spark."""
    dim = db.create_table("dim", "id bigint, name string")
    dim.insert(spark.sql("select id, concat('n', id) as name from range(40)").coalesce(1))
    db.table("t").live().createOrReplaceTempView("plain_t")
    dim.live().createOrReplaceTempView("plain_dim")
    for q, n in (
        ("select t.k, d.name from t join dim d on t.k = d.id where d.name in ('n5', 'n33')", 2), ("select count(*) n from t, dim d where t.k = d.id and d.id < 12", 2),
        ("select t.k from t where t.k in (select id from dim where name = 'n17')", 1), ("select d.name, t.k from dim d left join t on t.k = d.id where d.id < 3", 4),
        ("select t.k from t left join dim d on t.k = d.id and d.id < 3", 4), ("select t.k from t join dim d on t.k + 1 = d.id where d.id < 3", 4), ("select t.k from t join (select max(id) as m from dim) d on t.k = d.m", 1),
    ):
        df = db.sql(q)
        assert files(df) - len([f for f in df.inputFiles() if "/dim/data/" in f]) <= n, q
        plain = q.replace(" t ", " plain_t t ").replace(" t,", " plain_t t,").replace("dim d", "plain_dim d").replace("from dim", "from plain_dim").replace("join plain_t t on", "join plain_t t on")
        assert sorted(map(str, df.collect())) == sorted(map(str, spark.sql(plain).collect())), q
    from lithic import database

    database.JOIN_KEYS, usual = 3, database.JOIN_KEYS
    try:
        df = db.sql("select t.k from t join dim d on t.k = d.id where d.id between 21 and 28")
        assert df.count() == 8 and len([f for f in df.inputFiles() if "/t/data/" in f]) == 1
    finally:
        database.JOIN_KEYS = usual


def test_many_mutations_share_a_delete_set(db):
    for k in range(20):
        db.mutate(f"delete from t where k = {k}")
    t = db.table("t")
    assert len(t.manifest()["deletes"]) <= 17 and db.sql("select count(*) n, min(k) lo from t").first() == (20, 20) and db.sql("select * from t").count() == 20
    assert maintenance.check(t) == [] and db.to_arrow("t", ["k"]).num_rows == 20


def test_iceberg_export(db, spark, tmp_path):
    """The metadata name files and deleted positions that give the live rows."""
    import json
    from pathlib import Path

    from lithic.sources import avro

    db.mutate("delete from t where k in (3, 4, 17)")
    name = db.export_iceberg("t", str(tmp_path / "ice"))
    meta = json.loads(Path(name).read_text())
    snap = meta["snapshots"][0]
    assert meta["format-version"] == 2 and meta["current-snapshot-id"] == snap["snapshot-id"] == meta["refs"]["main"]["snapshot-id"]
    names = {f["id"]: f["name"] for f in meta["schemas"][0]["fields"]}
    assert {n["field-id"]: n["names"][0] for n in json.loads(meta["properties"]["schema.name-mapping.default"])} == names
    read = lambda uri: avro.read(Path(uri.removeprefix("file:").replace("//", "/")).read_bytes())
    live, gone = [], []
    for m in read(snap["manifest-list"])[1]:
        head, entries = read(m["manifest_path"])
        assert head["format-version"] == "2" and m["added_files_count"] == len(entries) and json.loads(head["schema"])["fields"] == meta["schemas"][0]["fields"]
        for e in entries:
            f = e["data_file"]
            assert Path(f["file_path"].removeprefix("file:").replace("//", "/")).stat().st_size == f["file_size_in_bytes"]
            (gone if m["content"] else live).append(f)
    assert len(live) == 4 and sum(f["record_count"] for f in live) == 40 and sum(f["record_count"] for f in gone) == 3
    k = next(i for i, n in names.items() if n == "k")
    clean = [f for f in live if f["lower_bounds"]]
    assert {int.from_bytes(next(b["value"] for b in f["lower_bounds"] if b["key"] == k), "little", signed=True) for f in clean} == {20, 30}
    dead = {(r.file_path.rsplit("/", 1)[-1], r.pos) for f in gone for r in spark.read.parquet(f["file_path"]).collect()}
    rows = spark.read.parquet(*[f["file_path"] for f in live]).selectExpr("k", "_metadata.file_name as f", "_metadata.row_index as p").collect()
    assert sorted(r.k for r in rows if (r.f, r.p) not in dead) == sorted(r.k for r in db.sql("select k from t").collect())


def test_rows_are_sorted_when_written(spark, tmp_path, monkeypatch):
    from lithic.sources import table

    monkeypatch.setattr(table, "TARGET_ROWS", 600)
    db = open_database(spark, str(tmp_path / "o"))
    t = db.create_table("o", "k bigint, v bigint", sort_by=["k"])
    t.insert(spark.range(2000).selectExpr("(id * 7919) % 2000 as k", "id as v").repartition(4))
    spans = sorted((f["stats"]["k"]["lo"], f["stats"]["k"]["hi"]) for f in t.manifest()["fragments"])
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    for f in t.manifest()["fragments"]:
        rows = spark.read.parquet(t.files.uri(f["path"])).select("k", "_metadata.row_index").collect()
        assert [r.k for r in sorted(rows, key=lambda r: r.row_index)] == sorted(r.k for r in rows)
    assert files(db.sql("select * from o where k = 77")) == 1


def test_values_that_are_not_finite(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "n"))
    t = db.create_table("n", "k int, x double")
    t.insert(spark.createDataFrame([(1, float("nan")), (2, 1.5), (3, float("inf")), (4, None), (5, -2.0)], "k int, x double").coalesce(1))
    t.insert(spark.createDataFrame([(6, 7.0), (7, 8.0)], "k int, x double").coalesce(1))
    t.live().createOrReplaceTempView("plain_n")
    for q in ("select min(x) a, max(x) b, count(x) c from {}", "select sum(x) a, avg(x) b from {}", "select min(x) a, sum(x) b from {} where k > 5", "select count(*) a, max(k) b from {} where x > 2.5", "select max(x) a from {} where x < 100"):
        assert repr(db.sql(q.format("n")).collect()) == repr(spark.sql(q.format("plain_n")).collect()), q


def test_sketches_stand_apart_from_distinct_values(db, spark):
    df = db.sql("SELECT approx_count_distinct(k, 0.01) AS a, COUNT(DISTINCT k) AS n FROM t")
    steps = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "approx_count_distinct" in line and "Aggregate" in line]
    assert steps and all("keys=[]" in line for line in steps)
    db.table("t").insert(spark.sql("select cast(null as bigint) k, 1.5D x, cast(null as decimal(12,2)) d, cast(null as timestamp_ntz) ts, cast(null as string) s, cast(null as int) p"))
    db.mutate("DELETE FROM t WHERE k % 4 = 0")
    db.table("t").live().createOrReplaceTempView("plain_t")
    for q in [
        "SELECT ABS(approx_count_distinct(k, 0.01) - COUNT(DISTINCT k)) <= 0.05 * COUNT(DISTINCT k) AS near, SUM(k) + 1 AS s FROM {}",
        "SELECT s, p + 1 AS q, approx_count_distinct(k) AS a, COUNT(DISTINCT k) AS n, COUNT(DISTINCT x) AS m, MAX(d) AS d FROM {} GROUP BY s, p",
        "SELECT p, approx_count_distinct(k) FILTER (WHERE k > 10) AS a, COUNT(DISTINCT s) AS n FROM {} WHERE k > 20 GROUP BY p HAVING COUNT(DISTINCT s) > 1",
        "SELECT SUM(n) AS n, SUM(a) AS a FROM (SELECT p, approx_count_distinct(k) AS a, COUNT(DISTINCT s) AS n FROM {} GROUP BY p) AS g",
        "SELECT approx_count_distinct(k) AS a, COUNT(DISTINCT k) AS n FROM {} WHERE k > 1000",
        "SELECT lower(s) AS l, approx_count_distinct(k) AS a, COUNT(DISTINCT k) AS n FROM {} GROUP BY lower(s)",
    ]:
        got, want = db.sql(q.format("t")), spark.sql(q.format("plain_t"))
        assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_statistics_of_files_need_no_sort(db, spark, monkeypatch):
    plans, collect = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    db.table("t").insert(spark.sql(f"select {ROWS} from range(40, 3000)"))
    db.mutate("DELETE FROM t WHERE k BETWEEN 100 AND 2600")
    assert maintenance.check(db.table("t")) == []
    aggregates = [p for p in plans if "__file" in p and "Aggregate(" in p and "min(s" in p]
    assert len(aggregates) >= 4 and not any("SortAggregate" in p for p in aggregates)
    stats = db.table("t").manifest()["fragments"][-1]["stats"]["s"]
    assert (stats["lo"], stats["hi"]) == ("s'0", "s'6")
