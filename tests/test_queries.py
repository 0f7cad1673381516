"""Every query that has SQL gives the SQL's rows at the small size; the others give rows."""

import duckdb
import pytest

from gridloom.plans import codec

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def text(v):
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, list | tuple) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(codec.QUERIES))
def test_query(spark, small, sql, name):
    df = codec.QUERIES[name](spark, small)
    rows = df.collect()
    if name not in codec.ORACLES:
        assert rows
        return
    got = sql.execute(codec.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(text(r[c]) for c in sorted(columns)) for r in rows) == sorted(tuple(text(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())


def test_filter_evaluation_moves_both_images_at_once(spark, small):
    """Two levels at two places are four joins; decoded and target image are moved by one more, not by one each."""
    plan = codec.QUERIES["evaluate_filter"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 5


def join_rows(df):
    """Rows out of each join of a query that has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        elif name.startswith("Reused"):
            todo.append(node.child())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_filter_evaluation_moves_rows_not_pixels(spark, small):
    """each row of the image meets the rows that it reads once for each height of an offset; pixels with their offsets are no rows."""
    df = codec.QUERIES["evaluate_filter"](spark, small)
    df.collect()
    height = spark.read.parquet(f"{small}/embeddings.parquet").count()
    rows = join_rows(df)
    assert len(rows) == 5 and max(rows) == 3 * height


ODD = {
    "gaps": "SELECT vec_id * 3 AS vec_id, embedding FROM e",
    "no first rows": "SELECT vec_id + 7 AS vec_id, embedding FROM e",
    "null elements": "SELECT vec_id, if(vec_id % 5 = 0, transform(embedding, (v, i) -> if(i = vec_id % 64, null, v)), embedding) AS embedding FROM e",
    "null and empty vectors": "SELECT vec_id, if(vec_id % 11 = 0, null, if(vec_id % 7 = 0, slice(embedding, 1, 0), embedding)) AS embedding FROM e",
    "short and long vectors": "SELECT vec_id, if(vec_id % 9 = 0, slice(embedding, 1, 40), if(vec_id % 8 = 0, concat(embedding, slice(embedding, 1, 9)), embedding)) AS embedding FROM e",
    "nine rows": "SELECT vec_id, embedding FROM e WHERE vec_id < 9",
    "no row": "SELECT vec_id, embedding FROM e WHERE vec_id < 0",
}


@pytest.mark.parametrize("odd", list(ODD))
def test_filter_evaluation_of_odd_tables(spark, small, tmp_path, odd):
    """a missing tap takes a pixel's errors out, not the pixel, as in SQL."""
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 120").createOrReplaceTempView("e")
    spark.sql(ODD[odd]).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = con.execute(codec.ORACLES["evaluate_filter"])
    columns = [c[0] for c in got.description]
    want = sorted(tuple(map(text, r)) for r in got.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in codec.QUERIES["evaluate_filter"](spark, str(tmp_path)).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
