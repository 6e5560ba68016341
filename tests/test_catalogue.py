"""Every query of the catalogue against its SQL on the smallest tables."""

import datetime
import os

import pytest

import __spark_entry__
from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name not in catalogue.SQL:
        return
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    key = sorted(names)
    assert sorted((tuple(plain(r[c]) for c in key) for r in rows), key=str) == sorted((tuple(plain(r[c]) for c in key) for r in want), key=str)


def test_text_export_half_way(spark, tmp_path):
    """Values half way between two shortest texts: whole lines as the SQL has them."""
    duckdb = pytest.importorskip("duckdb")
    half = [0.00244140625, -0.00244140625, 0.0185546875, 0.4394530951976776, -0.138671875, 0.000244140625]
    rows = [(i, [v] * 64, i % 4) for i, v in enumerate(half)] + [(6, [-0.00244140625 + 0.001 * k for k in range(64)], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(catalogue.SQL["text_export"]).fetchall()
    assert " 70.000000    0.000000 -0.138671875" in {text for _, _, text in want}
    assert sorted(tuple(r) for r in catalogue.QUERIES["text_export"](spark, str(tmp_path)).select("vec_id", "pt", "text").collect()) == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
