import os
import random
from collections import Counter

import pytest
from test_operators import brute_near, frame, prose
from pyspark.sql import functions as F

import corpus_pipeline
from quaver.llm import queries

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    clean = [prose(rng, rng.randint(60, 90), 10**6) for _ in range(40)]
    item = prose(rng, 30, 10**6)
    copies = [clean[i] + " more" for i in range(5)]
    leaks = [f"{prose(rng, 50, 10**6)} {item} {prose(rng, 50, 10**6)}" for _ in range(3)]
    private = [f"{prose(rng, 50, 10**6)} ann{i}@mail.example.com" for i in range(3)]
    texts = ["short", None, *clean, *copies, *leaks, *private]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append({r.doc_id for r in docs.collect()})
    _, comp = brute_near(texts, 5)
    good = {i for i, t in enumerate(texts) if t and len(t.split()) >= 20}
    assert counts[0] == good and counts[1] == {i for i in good if comp[i] == i}
    assert counts[2] == counts[3] == counts[1] - set(range(47, 50))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not any("ann" in r.text and "@mail.example" in r.text for r in out) and all(r.n_chars == len(r.text) for r in out)
    times = Counter(r.doc_id for r in out)
    assert set(times) <= counts[3] and max(times.values()) <= 2
    words = sum(len(texts[i].split()) for i in counts[3])
    assert abs(sum(len(r.text.split()) for r in out) - 1.5 * words) < 3 * 100


def test_pipeline_on_an_empty_table(spark, tmp_path):
    frame(spark, ["x"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "an item")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql())))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    made = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    assert made == sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_queries_read_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name in ("op4_katz_backoff", "op5_toxicity", "op7_mixing", "op8_minhash_near_dedup", "op10_pii_surrogates"):
        out = queries.queries()[name](spark, SF)
        assert out.count() == n and out.select(F.countDistinct("doc_id")).first()[0] == n
