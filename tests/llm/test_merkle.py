"""The manifest against a tree built level by level, and its edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quaver.llm import merkle

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(nodes, fanout):
    """The last node, and each leaf's siblings from left to right, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            low = p - p % fanout
            proofs[i] += [(j < p, nodes[j]) for j in range(low, min(low + fanout, len(nodes))) if j != p]
        at = [p // fanout for p in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows, fanout):
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    per = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups]
    low = [tree([leaf(r) for r in part], fanout) for part in per]
    root, high = tree([t[0] for t in low], fanout)
    return sorted(
        (str(r[0]), str(r[2]), leaf(r), i, low[g][0], root, h(*(x for _, x in low[g][1][i] + high[g])))
        for g, part in enumerate(per)
        for i, r in enumerate(part)
    )


def made_rows(rng, n, langs):
    rows = [(rng.randint(-5, 3 * n), f"text {rng.random()}", rng.choice(langs), rng.choice(["a", None]), rng.choice([None, 7])) for _ in range(n)]
    return [*rows, rows[0], rows[0], (None, None, None, None, None), (None, "", "", "", 0), (1, "é\x00" * 40_000, "en", "s", 1)]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (2, 10), (3, 1)])
def test_against_brute_force(spark, fanout, levels):
    rows = made_rows(random.Random(fanout), 120, ["en", "de", "z", "Z", "é", None, "en", "en"])
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("idx", "leaf", "root", "grp", "m", "lefts", "payload")})
    out = merkle.verified(merkle.manifest(df, fanout=fanout, levels=levels))
    got = out.select("order_value", "group_value", "leaf", "idx", "subroot", "root", merkle.proof_hash(F.col("lefts"), F.col("rights")), "verified").collect()
    assert all(r.verified for r in got)
    assert sorted((str(r[0]), str(r[1]), *r[2:7]) for r in got) == brute(rows, fanout)


def test_tampered_rows_fail(spark):
    rows = made_rows(random.Random(5), 40, ["en", "de", None])
    told = merkle.leaf_hash(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS))
    out = merkle.verified(merkle.manifest(spark.createDataFrame(rows, DOCS), claim=F.when(F.col("doc_id") % 3 == 0, told), levels=3)).collect()
    lied = {leaf(r) for r in rows if r[0] is not None and r[0] % 3 == 0 and r[4] is not None}
    assert lied and {r.leaf for r in out if not r.verified} == lied
    assert all((r.folded_root == r.root) == r.verified for r in out)


def test_one_row_and_none(spark):
    row = (3, "a", None, None, 1)
    (one,) = merkle.verified(merkle.manifest(spark.createDataFrame([row], DOCS))).collect()
    assert one.root == one.subroot == one.leaf == one.folded_root == leaf(row) and one.lefts == [] and one.verified
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_order_and_group_of_other_types(spark):
    rows = [(f"k{i % 7}", i % 3, f"t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "key string, part int, body string")
    out = merkle.verified(merkle.manifest(df, group="part", order="key", fields=("key", "body"), levels=2)).collect()
    assert sorted((r.order_value, r.group_value) for r in out) == sorted((k, p) for k, p, _ in rows) and all(r.verified for r in out)
