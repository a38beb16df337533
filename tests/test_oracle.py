"""Every registered query against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.operators import rank
from tessera.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(value):
    if value is None or value != value:
        return "null"
    return repr(round(float(value), 6)) if isinstance(value, float) else str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(oracle.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_runs_or_has_an_oracle():
    assert set(oracle.SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(oracle.SQL) == {"reanchor_greedy", "python_structure", "edit_batch"}


def test_architecture_of_many_odd_pages(spark, tmp_path):
    """More pages than a map for reading shows; empty segments, null urls."""
    shape = "CASE WHEN id % 1000 = 0 THEN NULL WHEN id % 7 = 0 THEN concat('http://h', id % 9, '.org/a//b', id % 30, '/p.html') ELSE concat('https://h', id % 9, '.org/d', id % 50, '/p', id, '.', id % 4, '?q=1') END"
    spark.range(20_500).selectExpr("id AS page_id", f"{shape} AS url", "'' AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(oracle.SQL["architecture"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["architecture"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def shuffled(spark, since=0):
    """The records that stages from number ``since`` on gave to shuffles, and the next number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [stages.apply(k) for k in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() >= since), max(x.stageId() for x in stages) + 1


def test_copies_of_names_meet_copies_of_queries_once(spark, tmp_path):
    """Many parts of few names: all pairs, but they are no rows of a shuffle."""
    names = "element_at(array('large ring', 'oldBolt', 'old', 'x-y', 'the large', 'öl ring', '_old', 'ÖÖÖ'), cast(id % 8 + 1 as int))"
    spark.range(3000).selectExpr("id AS p_partkey", f"{names} AS p_name", "'b' AS p_brand", "if(id % 3 = 0, 'LARGE', 'Bolt x-y ÖL ring ööö') AS p_type", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(oracle.SQL["symbol_match"])
    names = [d[0] for d in want.description]
    spark.range(1).count()
    _, since = shuffled(spark)
    got = queries.QUERIES["symbol_match"](spark, str(tmp_path))
    all_rows = got.collect()
    assert rows(got.columns, all_rows) == rows(names, want.fetchall())
    assert shuffled(spark, since)[0] < 20_000 < len(all_rows)


def test_files_are_not_moved_with_each_pair(spark, tmp_path, monkeypatch):
    """Two names of many files, many different queries, few lots: all pairs, but
    no list of files goes through a shuffle for each of them."""
    monkeypatch.setattr(rank, "LOTS", 1, raising=False)
    spark.range(4000).selectExpr("id AS p_partkey", "if(id % 2 = 0, 'large ring', 'old ring') AS p_name", "'b' AS p_brand", "concat('ring ', id) AS p_type", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    _, since = shuffled(spark)
    assert queries.QUERIES["symbol_match"](spark, str(tmp_path)).selectExpr("count(file)", "count(DISTINCT file)").first() == (200 * 4000, 4000)
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [stages.apply(k) for k in range(stages.size())]
    moved = sum(x.shuffleWriteBytes() for x in stages if x.stageId() >= since)
    assert moved < 1_500_000
