"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quaver import catalog
from quaver.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v + 0.0, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    made = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    cur = db.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})")
    assert made == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)
    assert made


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _derived(df) -> int:
    """How often a plan sorts lineitem into frames."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("lag(l_orderkey")


def test_frames_are_derived_twice_at_most(spark):
    """Beats and tempo take the songs' ends from counts; only the notes and the second estimate need frames."""
    for name in ("map_notes_full", "song_summary", "song_summary_merged"):
        assert _derived(catalog.queries()[name](spark, SF)) == 2


def test_frame_ends(spark, tmp_path):
    """The last frames' times, also where an order is alone in its song, has repeated rows, or no key."""
    lines = spark.createDataFrame([(o, n) for o, many in ((0, 2), (3, 1), (4, 3), (6, 2), (152, 1), (153, 4), (300, 1), (450, 1), (451, 1), (None, 3)) for n in range(many)] + [(6, 0)], "l_orderkey long, l_linenumber int")
    more = {"l_partkey": "long", "l_suppkey": "long", "l_quantity": "double", "l_extendedprice": "double", "l_shipdate": "date", "l_tax": "double", "l_discount": "double", "l_returnflag": "string", "l_linestatus": "string"}
    lines.withColumns({c: F.lit(None).cast(t) for c, t in more.items()}).write.parquet(f"{tmp_path}/lineitem.parquet")
    for folder in (str(tmp_path), SF):
        ends = A.frames(spark, folder).groupBy("song_id").agg(F.max("time").alias("end"))
        assert sorted(map(str, A.frame_ends(spark, folder).collect())) == sorted(map(str, ends.collect()))
