"""The set join against all pairs, its parts against plain versions, and its edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import set_join as J
from test_operators import ODD, empty, frame, odd, prose, roots  # noqa: F401


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(texts, share=90, k=3):
    sets, holders, common = sets_of(texts, k), defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for g in s:
            for j in holders[g]:
                common[j, i] += 1
            holders[g].append(i)
    links = [p for p, c in common.items() if 100 * c >= share * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    return {i: (len(s), c) for (i, c), s in zip(sorted(roots(links, range(len(texts))).items()), sets, strict=True)}


def texts_of_many_kinds(rng):
    """Near copies of all degrees, exact copies, templates just below the threshold, passages that many share, chains."""
    base, passage, template = prose(rng, 120, 10**6).split(), prose(rng, 60, 10**6).split(), prose(rng, 100, 10**6).split()
    texts = [prose(rng, rng.randint(1, 60), 10**6) for _ in range(40)]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words[: len(words) - i % 7]))
    texts += [" ".join([*template, *(f"own{i}x{j}" for j in range(i % 9 + 2))]) for i in range(60)]
    texts += [" ".join([*prose(rng, 150, 10**6).split(), *passage]) for _ in range(60)]
    chain = prose(rng, 200, 10**6).split()
    for i in range(12):
        chain = [*chain[4:], *(f"c{i}x{j}" for j in range(4))]
        texts.append(" ".join(chain))
    texts += [texts[3].upper(), texts[3], "a b c d", "A B C D", "a b c d e", "one", "one", "one two"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("block", "ids"), [(256, 500_000), (8, 0)])
def test_against_brute_force(spark, monkeypatch, block, ids):
    from quaver.llm import near_dedup

    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", ids)
    texts = texts_of_many_kinds(random.Random(4))
    want = brute(texts)
    got = {r.id: (r.n_shingles, r.component) for r in J.joined(frame(spark, texts).repartition(3)).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 100


def test_other_thresholds(spark):
    texts = texts_of_many_kinds(random.Random(9))
    got = {r.id: (r.n_shingles, r.component) for r in J.joined(frame(spark, texts), share=75, k=2).collect()}
    assert got == brute(texts, 75, 2)


def test_passages_alone_are_not_posted(spark):
    """Texts with enough members of their own stand in no list, whatever they share."""
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(20)
    texts = [f"{words(240)} {passage}" for _ in range(80)]
    each = J.profiles(frame(spark, texts))
    classes = each.withColumn("cls", F.col("id"))
    assert J.posts(classes, 90).groupBy("token").count().where("count > 1").count() == 0


def test_answers_are_intersections_and_cost_less():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 500, replace=False)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 500 - d], rng.choice(10**6, d)])) for d in rng.integers(0, 30, 40)]
    sets.append(np.array([1, 2, 3]))
    a = J.Answers(sets)
    for i in rng.permutation(len(sets)):
        assert a.of(int(i)).tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]
    assert a.looked_up < 0.2 * sum(map(len, sets))


def test_may_meet_skips_only_what_cannot_be_similar():
    rng = np.random.default_rng(5)
    n = np.concatenate([rng.integers(1, 30, 150), rng.integers(400, 700, 150)])
    pos = (n * rng.random(300) * 0.11).astype(int)
    for share in (80, 90):
        room = np.minimum((n - pos)[:, None], (n - pos)[None, :])
        p, q = n[:, None], n[None, :]
        want = (100 * np.minimum(p, q) >= share * np.maximum(p, q)) & ((100 + share) * room >= share * (p + q))
        assert (J.may_meet(n, pos, share) == want).all()


def test_odd_texts(odd, empty):  # noqa: F811
    rows = J.joined(odd).collect()
    want = brute(ODD)
    assert sorted((r.id, r.n_shingles, r.component) for r in rows if r.id is not None) == sorted((i, *want[i]) for i in [*range(len(ODD)), 3])
    assert [(r.n_shingles, r.component) for r in rows if r.id is None] in ([(3, None), (0, None)], [(0, None), (3, None)], [(2, None), (0, None)], [(0, None), (2, None)])
    out = J.joined(empty)
    assert out.count() == 0 and out.columns == ["id", "n_shingles", "component"]


def test_members_are_dealt_without_sizes(spark):
    """What is shuffled for each counted member is its class, place and hash; sizes come to those that are left."""
    rows = [(c, 20, 3, [1, 2, 3 + c % 2, 100 + c]) for c in range(6)]
    classes = spark.createDataFrame(rows, "cls long, n long, sampled long, low array<long>")
    made = J.posts(classes, 90)
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Generate posexplode" in line]
    assert len(below) == 1 and "Project [cls#" in below[0] and "sampled#" not in below[0]
    # 3 and 4 are the rarest of the sampled that another class has, and all sampled ones are shared: places 0, 1, 2
    assert sorted(map(tuple, made.collect())) == sorted((t, c, 20, p) for c in range(6) for p, t in enumerate([3 + c % 2, 1, 2]))


def test_members_are_shuffled_once_to_be_counted(spark, monkeypatch):
    """However many counts there are: they come with the members and are not joined to them by a second shuffle."""
    from quaver.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    classes = spark.createDataFrame([(c, 20, 3, [1, 2, 3 + c % 2, 100 + c]) for c in range(6)], "cls long, n long, sampled long, low array<long>")
    plan = J.posts(classes, 90)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(token#") == 1


@pytest.mark.parametrize("some", [1, 2])
def test_frequent_members_are_dealt_out(spark, monkeypatch, some):
    """Members that many classes have are counted in some classes, and the components are those of all pairs."""
    monkeypatch.setattr(J, "SOME", some)
    monkeypatch.setattr(J, "OFTEN", 8)
    texts = texts_of_many_kinds(random.Random(6))
    classes = J.profiles(frame(spark, texts)).where("n > 0").withColumn("cls", F.col("id"))
    plan = J.posts(classes, 90)._jdf.queryExecution().optimizedPlan().toString()
    assert "deal#" in plan
    assert {r.id: (r.n_shingles, r.component) for r in J.joined(frame(spark, texts)).collect()} == brute(texts)
