import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quaver.llm import katz, kernels, near_dedup, quality
from quaver.llm.url_filter import RULES  # noqa: F401  the module imports without a session

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBzZ \t\n\r\v\f\u00a0éß.,\U0001f600", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    w = kernels.words_of(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        assert w.counts[i] == len(own)
        for word, h in zip(own, w.hashes[w.doc_start[i] : w.doc_start[i + 1]], strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_slices(texts, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = list(kernels.slices(batch, "text", limit))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows for p in parts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_repeated_windows(ids):
    n = len(ids) - 7
    runs = [tuple(ids[i : i + 8]) for i in range(max(n, 0))]
    want = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + 8)}
    assert quality._repeated(np.array(ids, np.int64), 8) == len(want)


def test_shingles_of_few_words():
    h = kernels.words_of(pa.array(["a b c", "a b c d e", ""])).hashes
    assert len(kernels.shingle_hashes(h[:3], 4)) == 1 and len(kernels.shingle_hashes(h[3:], 4)) == 2 and len(kernels.shingle_hashes(h[:0], 4)) == 0
    assert kernels.shingle_hashes(h[:3], 3) == kernels.shingle_hashes(h[:3], 4)


def test_prefix_sizes():
    sizes = near_dedup.prefix_sizes()
    assert len(sizes) == near_dedup.COORDS + 1 and all(0 < s <= near_dedup.COORDS for s in sizes)
    assert sizes[near_dedup.COORDS] == 11  # 0.2 ** 11 < 1e-7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=6, max_size=6))
def test_discounts(n):
    d = katz.discounts(n)
    assert len(d) == katz.K + 1 and all(0 < x < 1 for x in d)


def test_packing():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.int64), np.array([1.5]), np.array([1, 2], np.uint8)]
    for a, b in zip(arrays, katz._unpack(katz._pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_katz_hot_candidates(monkeypatch):
    """Each flush names few n-grams however many it holds, and no frequent one is lost; the exact count is a row a task for each."""
    monkeypatch.setattr(katz, "HOT", 16)
    monkeypatch.setattr(katz, "FLUSH", 1000)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 50)) + " often so" * int(rng.integers(0, 12)) for _ in range(300)]
    teach = pa.array(rng.random(300) < 0.8)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 10]), teach[a : a + 10]], names=["text", "teach"]) for a in range(0, 300, 10)]
    out = pa.Table.from_batches(katz._count(iter(batches), 2)).to_pydict()
    rows = list(zip(*out.values(), strict=True))
    words = [r for r in rows if r[0] == 1 and r[1] != katz.ALL]
    flushes = sum(r[0] == 1 and r[1] == katz.ALL for r in rows)
    total = sum(r[-1] for r in words)
    assert total == sum(len(t.split()) + 1 for t, use in zip(texts, teach.to_pylist(), strict=True) if use)
    pairs = [r for r in rows if r[0] == 2]
    assert flushes > 5 and 0 < len(pairs) <= 2 * katz.HOT * flushes < len(set(" ".join(texts).split())) ** 2
    found = {}
    for _, v, u, c in pairs:
        found[v, u] = found.get((v, u), 0) + c
    hash_of = dict(zip(("often", "so"), (int(x) for x in katz._tokens(batches[0].set_column(0, "text", pa.array(["often so"] * 10)), "text", 1)[0][0][:2].view(np.int64)), strict=True))
    exact = sum(t.count("often so") for t, use in zip(texts, teach.to_pylist(), strict=True) if use)
    assert exact > total / katz.HOT and exact / 2 < found[hash_of["so"], hash_of["often"]] <= exact
