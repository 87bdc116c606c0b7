"""Tokenizer alignment against whole texts encoded and cut one by one, and its edge cases."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quaver.llm import align_tokens as L
from quaver.llm.queries import TOKENIZERS
from quaver.llm.workspace import OPEN_BUCKETS, bucketed

PATHS = (f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(PATHS[0]), reason="no tokenizers")


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    names, letters = {i: t for t, i in a.get_vocab().items()}, L.byte_letters()
    a_bytes = lambda i: bytes(letters[c] for c in names[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, a_bytes(i)) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, b_bytes(i)) for i in b.encode(t)]


def ends(tokens):
    out, n = {}, 0
    for k, (_, x) in enumerate(tokens):
        n += len(x)
        out[n] = k
    return out


def brute(texts, sides):
    per, counts = [], Counter()
    for t in texts:
        x, y = (side(t) if t else [] for side in sides)
        want = (" " + (t or "")).encode()
        if not t or b"".join(b for _, b in x) != want or b"".join(b for _, b in y) != want:
            per.append(None)
            continue
        ex, ey, at, links, shown = ends(x), ends(y), (0, 0), [], []
        for e in sorted(ex.keys() & ey.keys()):
            i, j = ex[e] + 1, ey[e] + 1
            shown.append(",".join(str(t) for t, _ in x[at[0] : i]) + "|" + ",".join(str(t) for t, _ in y[at[1] : j]))
            links.append((x[i - 1][0], y[j - 1][0]))
            at = (i, j)
        counts.update(links)
        per.append((len(x), len(y), len(shown), links, ";".join(shown)))
    most = {}
    for (_, b), c in counts.items():
        most[b] = max(most.get(b, 0), c)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (*p[:3], len(p[3]), sum(counts[x] == most[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), p[4]) for p in per]


ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  ", "a\n", "a\n b", "a\n  b\t c \n", "\n", "<|endoftext|> <s>x</s><unk>", "▁", "fine ▁ not", "it's we'll 'tis '", "x" * 5000, "word " * 6000,
    "é😀 ﬁ  b  c\x1c d\x85 e　 f", "漢字かな交じり文 漢字", "\x00 \x00", "1234567 12,5 %$#@", "a\r\nb  \r\n  c", "́ á", "tab\t tab \tx",
]


def test_against_brute_force(spark, sides, monkeypatch):
    rng = random.Random(3)
    letters = ["a", "b", "é", " ", " ", "  ", "\n", "'s", ".", "the", "ing", "\t", "😀", " ", "1", "-", "漢"]
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(150)), "the same text", "the same text"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, unit int").repartition(3).withColumns({c: F.lit("x") for c in ("blk", "rid", "units", "a", "n_a")})
    want = {i: r for i, r in enumerate(brute(texts, sides))}
    got = {r[0]: tuple(r)[1:] for r in L.alignment(df, *PATHS).collect()}
    assert got == want
    assert sum(r[0] > 0 for r in want.values()) > 150 and want[texts.index("▁")][0] == 0
    monkeypatch.setattr(L, "BROADCAST_PAIRS", 0)
    assert {r[0]: tuple(r)[1:] for r in L.alignment(df, *PATHS).collect()} == want


def test_blocks(sides, monkeypatch):
    """Whatever a block holds, the texts come out the same."""
    monkeypatch.setattr(L, "UNITS", 5)
    monkeypatch.setattr(L, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 7)}))}))
    texts = ["one two one", None, "two three", "four", "five six seven eight", "one"]
    batches = [pa.RecordBatch.from_pydict({"id": [i], "text": [t]}, schema=pa.schema([("id", pa.int64()), ("text", pa.string())])) for i, t in enumerate(texts)]
    rows = pa.Table.from_batches(list(L._encoded(iter(batches), *PATHS))).to_pylist()
    assert len({r["blk"] for r in rows}) == 2 and sorted(r["id"] for r in rows if r["rid"] is not None) == list(range(6))
    tokens = {(r["blk"], r["unit"]): r["a"] for r in rows if r["rid"] is None}
    for r in rows:
        if r["rid"] is not None and texts[r["id"]]:
            assert [i for u in r["units"] for i in tokens[r["blk"], u]] == [i for i, _ in sides[0](texts[r["id"]])]


def test_lists_of_whole_texts(spark, sides):
    """Cuts and groups of any lists, and the links of all that share a group."""
    texts = ["some words, and unusualities", "a longer example of antidisestablishmentarianism"]
    rows = [(k, *([v for v, _ in s], [len(b) for _, b in s]), *([v for v, _ in t], [len(b) for _, b in t])) for k, (s, t) in enumerate((sides[0](x), sides[1](x)) for x in texts)]
    lists = spark.createDataFrame(rows, "key long, a array<int>, al array<int>, b array<int>, bl array<int>")
    found = L.groups(L.cuts(lists, ("key",)), lists, ("key",))
    shown = {}
    for r in found.orderBy("key", "g").collect():
        shown.setdefault(r.key, []).append(",".join(map(str, r.a)) + "|" + ",".join(map(str, r.b)))
    assert [";".join(shown[k]) for k in range(2)] == [r[6] for r in brute(texts, sides)]
    pairs = Counter((r.key, r.g, r.a, r.b) for r in L.group_links(found, ("key",)).collect())
    assert sum(pairs.values()) == sum(len(r.a) * len(r.b) for r in found.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    out = L.alignment(df, *PATHS)
    assert out.count() == 0 and out.columns == ["id", *L.FIGURES, "groups_text"]


def test_units_join_to_the_text():
    for t in ODD:
        if t is not None:
            assert "".join(" " + u for u in L.units_of(t)) == " " + t
    assert L.units_of("a b\n c  d") == ["a", "b\n c", " d"] and np.all([u == u.strip() for u in L.units_of("x y z")])


def test_encoding_takes_small_batches(spark, monkeypatch):
    """However many rows a task has, a batch that the tokenizers get is small, and the session's own batches are as before."""
    real, name = L._encoded, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def watched(batches, *paths):
        def small():
            for batch in batches:
                assert batch.num_rows <= 256 and batch.nbytes < 4 << 20, batch.num_rows
                yield batch

        return real(small(), *paths)

    monkeypatch.setattr(L, "_encoded", watched)
    before = spark.conf.get(name)
    made = L.encode(spark.range(1000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 2000) AS text"), *PATHS)
    assert made.where("rid is not null").count() == 1000 and spark.conf.get(name) == before


def test_tokens_meet_by_ends_without_windows(spark, sides):
    """Ends come with the tokens, so each side is sorted for the join and for nothing else; the cuts are those that windows find."""
    texts = ["some words, and unusualities", "é a longer example of antidisestablishmentarianism"]
    made = L.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *PATHS).where("rid is null")
    with L._settings(spark, L.BY_FIRST_KEY):
        met = L.meetings(made, ("blk", "unit"), ("uses",))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 2 and "Window" not in plan and "Exchange" not in plan
    sizes = lambda ends: F.transform(ends, lambda x, i: x - F.when(i > 0, F.col(ends)[i - 1]).otherwise(0)).alias(f"{ends[0]}l")
    want = L.cuts(made.select("blk", "unit", "a", "b", sizes("ae"), sizes("be")), ("blk", "unit"))
    got = sorted(tuple(r)[:2] + tuple(r)[3:7] for r in met.orderBy("blk", "unit", "end").collect())
    assert got == sorted((r.blk, r.unit, r.pa, r.pb, r.a, r.b) for r in want.collect()) and got


def test_tables_take_little_disk(spark, monkeypatch):
    """What is written between the steps: no column that another gives, units as differences, and all of it packed."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(100)]
    written, real = [], L.bucketed
    monkeypatch.setattr(L, "bucketed", lambda df, *more, **options: written.append(real(df, *more, **options)) or written[-1])
    out = L.alignment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), *PATHS)
    assert out.count() == 100
    files = [[pq.ParquetFile(f.removeprefix("file://")).metadata for f in t.inputFiles()] for t in written]
    chunks = [[m.row_group(g).column(c) for m in made for g in range(m.num_row_groups) for c in range(m.num_columns)] for made in files]
    assert all(c.compression == "ZSTD" for made in chunks for c in made)
    assert all("DELTA_BINARY_PACKED" in c.encodings for made in chunks for c in made if c.path_in_schema == "unit")
    assert written[1].columns == ["blk", "unit", "pa", "pb", "a", "b", "uses"]
    assert sum(c.total_compressed_size for made in chunks for c in made) < 1.1 * sum(map(len, texts))


def test_gather_in_any_order(spark, sides):
    """Units and links of a block may come in any order."""
    texts = ["some words, and unusualities", None, "a longer example of antidisestablishmentarianism", "some some"]
    made = L.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), *PATHS)
    met = L.meetings(made.where("rid is null"), ("blk", "unit"), ("uses",))
    links = met.join(L.pair_counts(met), ["a", "b"]).select("blk", "unit", "pa", "pb", "count", "best")
    left, right = (t.orderBy("blk", "unit").toArrow() for t in (made.select("blk", "rid", "id", "units", "unit", "a", "b"), links))
    want = brute(texts, sides)
    rng = np.random.default_rng(1)
    for _ in range(3):
        mixed = [t.take(pa.array(rng.permutation(len(t)))) for t in (left, right)]
        got = {r["id"]: tuple(r.values())[1:] for r in L._gather(*mixed).to_pylist()}
        assert got == dict(enumerate(want))


def test_more_buckets_than_open_files(spark):
    """A task that fills more buckets than it may have files open loses no row, one that fills few keeps their order, and the session's setting is as before."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    many = bucketed(spark.range(1000, numPartitions=1).selectExpr("id", "999 - id AS down"), "id", spread=4)
    assert len(many.inputFiles()) > OPEN_BUCKETS and sorted(map(tuple, many.collect())) == [(i, 999 - i) for i in range(1000)]
    few = bucketed(spark.range(1000, numPartitions=1).selectExpr("id % 2 AS id", "id AS n"), "id", rising="n")
    assert [[r.n for r in few.where(F.col("id") == k).collect()] for k in (0, 1)] == [list(range(k, 1000, 2)) for k in (0, 1)]
    assert spark.conf.get(name) == before
