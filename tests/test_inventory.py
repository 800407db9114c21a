"""Every query of the inventory against DuckDB on the same files."""

import math

import duckdb
import pytest

from lithic.plans import inventory

SF = "/root/testdata/sf0.001"
ORACLES = inventory.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in inventory.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", list(inventory.queries()))
def test_query(spark, duck, name):
    df = inventory.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())


def test_range_join_of_all_spans(spark, tmp_path):
    prices = {k: 900.0 + 7.25 * k for k in range(1, 200)} | {k: k - 20.5 for k in range(900, 1400, 3)}
    spark.createDataFrame(list(prices.items()), "p_partkey bigint, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in inventory.queries()["j11_range_join_whole"](spark, str(tmp_path)).collect())
    want = sorted((p, float(s)) for p, price in prices.items() for s in prices if s <= price < s + 40)
    assert got == want and len({lo for _, lo in got if lo % 50}) > 100


def test_merge_of_keys_beyond_a_million(spark, tmp_path):
    spark.range(999_900, 1_000_100).unionByName(spark.range(0, 100)).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    for name in ("m05_merge", "m05_merge_arms"):
        got = sorted(tuple(r) for r in inventory.queries()[name](spark, str(tmp_path)).select("p_partkey", "p_size").collect())
        assert got == sorted(duck.execute(f"select p_partkey, p_size from ({ORACLES[name]})").fetchall())
        assert len({k for k, _ in got}) < len(got)


def test_tables_are_stored_in_equal_shares(spark, tmp_path):
    spark.range(0, 3_000_000, 1, 2).selectExpr("id as l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    fragments = inventory.common(spark, str(tmp_path), "lineitem").table("lineitem").manifest()["fragments"]
    assert sum(f["rows"] for f in fragments) == 3_000_000
    assert max(f["rows"] for f in fragments) <= 1.2 * 500_000


def test_shares_grow_before_there_are_too_many_for_a_plain_shuffle(spark, monkeypatch):
    monkeypatch.setattr(inventory, "SHARE_ROWS", 10)
    assert [inventory.shares(spark.range(n)) for n in (0, 30, 1_000, 2_000, 2_010, 8_000, 10_000)] == [4, 4, 100, 200, 200, 200, 250]
