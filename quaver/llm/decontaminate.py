"""Benchmark decontamination with SimHash windows.

1. Benchmark items and documents are cut into words (lower case) and shingles of five
   words. Every item-sized window of a document is a candidate, wherever it starts,
   unless fewer of its shingles than the threshold needs occur in items of its size: a
   similarity of share % of two windows of m shingles takes 2 m share / (100 + share)
   common ones, so no window that reaches the threshold is left out, in whatever order
   it holds the item's parts.
2. Equal windows, whatever documents they stand in, are one from here on: a passage that
   very many documents hold costs one window. Each window and each item gets a 64-bit
   SimHash of its weighted shingles.
3. Multi-index Hamming: the fingerprints are cut into ``RADIUS + 1`` blocks, so two that
   differ in at most ``RADIUS`` bits agree in a whole block, and the join on (window
   length, anchor, block, block value) finds every pair within the radius. Two texts of
   similarity 0.8 differ in 15 % of the bits, give or take 4.5, so a radius that loses
   none is 36 % of them, and blocks alone would let most unrelated pairs meet at any
   fingerprint length. The index is therefore filed under anchors: of the shingles in
   the order of how many items hold them, rarest first, the first few of either side.
   Two sets of the threshold's similarity have one of these in common (prefix rule), so
   anchors lose nothing, and shingles that very many items share are not among them.
4. Candidates are verified exactly: the weighted Jaccard similarity of the shingles
   (weight: how often one occurs) must reach the threshold.

Everything is DataFrame operations. Broadcast sides are counted first; beyond
``BROADCAST_ROWS`` the same joins are shuffled.

Edge cases: null, empty and wordless texts on either side match nothing. An item with
fewer words than a shingle is one shingle, and so are the windows of its size. A
document shorter than an item is one window. A very long text is read whole. Rows that
repeat, or share an id, count as that document once, items likewise. Of equally similar
windows the first one is reported. Rows without an id are compared as well and come out
with a null id. Ids may be of any type. Empty tables give an empty result. Extra columns
are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import named, numbered, place
from .workspace import materialize

SHINGLE = 5
SHARE = 80
RADIUS = 23
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingles(ws: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, in order; none if there are fewer words."""
    return F.when(F.size(ws) >= size, F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(size))))).otherwise(F.array().cast("array<bigint>"))


def window_shingles(ws: Column) -> Column:
    """Shingles of a window or item: of five words, or of all of them."""
    out = shingles(ws, SHINGLE)
    for n in range(SHINGLE - 1, 0, -1):
        out = F.when(F.size(ws) == n, shingles(ws, n)).otherwise(out)
    return out


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of a list of 64-bit hashes, each weighing as often as it occurs."""
    bit = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int") * 2 - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(bit(b) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))


def window_starts(at: Column, reach: Column, last: Column, need: Column) -> Column:
    """Starts, from 0 to ``last``, of all windows of ``reach`` shingles that hold at least ``need`` of the sorted positions ``at``.

    Each start is made once, from the first position that its window holds.
    """
    low = lambda i: F.greatest(F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.get(at, i + need - 1) - reach + 1, F.lit(0))
    high = lambda i: F.least(F.get(at, i), last)
    some = lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(at) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), some))).otherwise(F.array().cast("array<int>"))


def hamming_candidates(left: DataFrame, right: DataFrame, key: str, fingerprint: str, radius: int = RADIUS) -> DataFrame:
    """Pairs of rows with equal ``key`` whose fingerprints differ in at most ``radius`` bits, and ``hamming``. The right side's columns get the prefix r_."""
    joined = block_join(left, right, key, fingerprint, radius)
    xor = F.col(fingerprint).bitwiseXOR(F.col(f"r_{fingerprint}"))
    # of the blocks in which a pair agrees, only the first stays
    agrees = F.transform(F.lit(_cuts(radius)), lambda c: _block(xor, c) == 0)
    first = F.array_position(agrees, F.lit(True)) == F.col("__b") + 1
    return joined.withColumn("hamming", F.bit_count(xor)).where((F.col("hamming") <= radius) & first).drop("__b", "__v", "__rb", "__rv")


def _cuts(radius: int) -> list[list[int]]:
    """(first bit, number of bits) of each of radius + 1 blocks."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [[a, b - a] for a, b in zip(edges, edges[1:], strict=False)]


def _block(fingerprint: Column, cut: Column) -> Column:
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), cut[1]) - 1
    return F.call_function("shiftrightunsigned", fingerprint, cut[0]).bitwiseAND(mask)


def block_join(left: DataFrame, right: DataFrame, key: str, fingerprint: str, radius: int = RADIUS) -> DataFrame:
    """Pairs of rows with equal ``key``, once for each of radius + 1 blocks in which their fingerprints agree."""
    blocks = lambda f: F.transform(F.lit(_cuts(radius)), lambda c, i: F.struct(i.alias("b"), _block(F.col(f), c).alias("v")))
    a = left.withColumn("__x", F.explode(blocks(fingerprint))).select(*left.columns, F.col("__x.b").alias("__b"), F.col("__x.v").alias("__v"))
    b = right.withColumn("__x", F.explode(blocks(fingerprint)))
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.col("__x.b").alias("__rb"), F.col("__x.v").alias("__rv"))
    return a.join(b, (F.col(key) == F.col(f"r_{key}")) & (F.col("__b") == F.col("__rb")) & (F.col("__v") == F.col("__rv")))


def _elements(lists: DataFrame, *ids: str) -> DataFrame:
    """(ids, e): the multiset of hashes ``h`` of each row as a set; each repetition of a hash is an element of its own."""
    counted = lists.select(*ids, F.explode("h").alias("x")).groupBy(*ids, "x").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return counted.select(*ids, "x", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).select(*ids, F.xxhash64("x", "k").alias("e"))


def _ranked(elements: DataFrame, frequencies: DataFrame, *ids: str) -> DataFrame:
    """(ids, ce): each set as (frequency, element), rarest first."""
    known = elements.join(_small(frequencies), ["len", "e"], "left")
    return known.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "e"))).alias("ce"))


def _filed(sets: DataFrame, allowed: Column, *ids: str) -> DataFrame:
    """(ids, sim, anchor): a row for each anchor, the first ``allowed`` elements that any item has."""
    anchors = F.filter(F.slice("ce", F.lit(1), allowed), lambda x: x["c"] > 0)
    return sets.select(*ids, "sim", F.explode(F.transform(anchors, lambda x: F.xxhash64("len", x["e"]))).alias("anchor"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: int = SHARE,
) -> DataFrame:
    """(doc_id, item_id, start, hamming, similarity): the best window of each document for each item it leaks."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("ws")).where(F.size("ws") > 0)
    items = items.select("item_id", F.size("ws").alias("len"), window_shingles(F.col("ws")).alias("h"))
    items = materialize(items.withColumn("key", F.xxhash64(F.sort_array("h"))).dropDuplicates(["item_id", "key", "len"]), "items")
    marks = materialize(items.select("len", F.explode("h").alias("mark")).withColumn("size", F.least("len", F.lit(SHINGLE))).distinct(), "marks")
    sizes = [r[0] for r in marks.select("size").distinct().collect()] or [SHINGLE]  # five at most
    cut = materialize(windows(docs, marks, sizes, doc_id, text, share), "cut")

    elements = materialize(_elements(items, "item_id", "key", "len"), "elements")
    frequencies = materialize(elements.groupBy("len", "e").agg(F.count(F.lit(1)).alias("c")), "frequencies")
    sims = items.select("item_id", "key", "len", simhash(F.col("h")).alias("sim"))
    same_item = [F.col("item_id").eqNullSafe(F.col("i")), F.col("key") == F.col("k"), F.col("len") == F.col("l")]
    known = _ranked(elements, frequencies, "item_id", "key", "len").join(sims.select(F.col("item_id").alias("i"), F.col("key").alias("k"), F.col("len").alias("l"), "sim"), same_item)
    known = materialize(known.select("item_id", "len", "sim", "ce").withColumn("iid", F.monotonically_increasing_id()), "known")

    distinct = cut.groupBy("w1", "w2").agg(F.first("len").alias("len"), F.first("h").alias("h"))
    distinct = materialize(distinct.select("w1", "w2", "len", "h", simhash(F.col("h")).alias("sim")), "windows")
    tried = _ranked(_elements(distinct, "w1", "w2", "len"), frequencies, "w1", "w2", "len")
    tried = materialize(tried.join(distinct.select("w1", "w2", "sim"), ["w1", "w2"]), "tried")

    # two sets of n and m elements have at least share (n + m) / (100 + share) in common; a window knows its items' m, an item only that n >= m share / 100
    n = F.size("ce")
    whole = F.col("len") - F.least("len", F.lit(SHINGLE)) + 1
    near = hamming_candidates(
        _filed(tried, n - F.ceil(F.lit(share) * (n + whole) / F.lit(100 + share)).cast("int") + 1, "w1", "w2"),
        _filed(known, n - F.ceil(F.lit(share) * n / F.lit(100)).cast("int") + 1, "iid"),
        "anchor", "sim",
    ).select("w1", "w2", F.col("r_iid").alias("iid"), "hamming").distinct()
    bare = lambda c: F.transform(c, lambda x: x["e"])
    met = near.join(_small(known.select("iid", "item_id", bare("ce").alias("b"))), "iid").join(tried.select("w1", "w2", bare("ce").alias("a")), ["w1", "w2"])
    met = met.withColumn("both", F.size(F.array_intersect("a", "b"))).withColumn("either", F.size("a") + F.size("b") - F.col("both"))
    leaks = met.where(F.lit(100) * F.col("both") >= F.lit(share) * F.col("either"))
    leaks = materialize(leaks.select("w1", "w2", "item_id", "hamming", (F.col("both") / F.col("either")).alias("similarity")), "leaks")

    found = cut.select("doc_id", "start", "w1", "w2").join(_small(leaks), ["w1", "w2"])
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "hamming")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").alias("start"), F.col("best.hamming").alias("hamming"), (-F.col("best.s")).alias("similarity"))


def windows(docs: DataFrame, marks: DataFrame, sizes: list[int], doc_id: str, text: str, share: int) -> DataFrame:
    """(doc_id, start, len, h, w1, w2): every item-sized window that holds enough of the shingles of items of its size; w1 and w2 are equal for equal windows."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    read = read.select("doc_id", F.xxhash64("t").alias("key"), words(F.col("t")).alias("ws"))
    shared = None
    for size in sizes:
        found = read.select("doc_id", "key", F.size("ws").alias("n"), F.posexplode(shingles(F.col("ws"), size)).alias("p", "mark"))
        own = marks.where(F.col("size") == size).select("mark", "len", "size")
        at = found.join(_small(own), "mark").select("doc_id", "key", "n", "len", "size", "p")
        shared = at if shared is None else shared.union(at)
    held = shared.groupBy("doc_id", "key", "n", "len", "size").agg(F.sort_array(F.collect_set("p")).alias("at"))
    reach, seen = F.col("len") - F.col("size") + 1, F.least("len", "n") - F.col("size") + 1
    need = F.greatest(F.ceil(F.lit(share) * (reach + seen) / F.lit(100 + share)).cast("int"), F.lit(1))
    held = held.withColumn("need", need).where(F.size("at") >= F.col("need"))
    held = held.withColumn("starts", window_starts(F.col("at"), reach, F.greatest(F.col("n") - F.col("len"), F.lit(0)), F.col("need")))
    held = materialize(held.select("doc_id", "key", F.struct("len", "size", "starts").alias("of")), "starts").where(F.size("of.starts") > 0)
    by_text = held.groupBy("doc_id", "key").agg(F.collect_list("of").alias("of"))
    by_text = materialize(by_text, "texts").withColumnsRenamed({"doc_id": "w_id", "key": "w_key"})
    texts = read.join(_small(by_text), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))).select("doc_id", "ws", F.explode("of").alias("of"))
    # a window's shingles are a run of the document's; those are bound to a variable and hashed once
    run = lambda of, hashes, s: F.slice(hashes, s + 1, of["len"] - of["size"] + 1)
    runs = lambda of, hashes: F.transform(of["starts"], lambda s: F.struct(of["len"].alias("len"), s.alias("start"), run(of, hashes, s).alias("h")))
    cut = None
    for size in sizes:
        all_ = F.transform(F.array(shingles(F.col("ws"), size)), lambda hashes: runs(F.col("of"), hashes))
        own = texts.where(F.col("of.size") == size).select("doc_id", F.explode(F.flatten(all_)).alias("w"))
        cut = own if cut is None else cut.union(own)
    ordered = F.sort_array("h")
    cut = cut.select("doc_id", "w.start", "w.len", "w.h").withColumn("w1", F.xxhash64(F.lit(1), "len", ordered)).withColumn("w2", F.xxhash64(F.lit(2), "len", ordered))
    return cut.select("doc_id", "start", "len", "h", "w1", "w2")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that leak an item; only their ids are joined."""
    gone = materialize(contaminated(docs, benchmark, doc_id, text, **how).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return named(numbered(docs).join(_small(gone), F.col(place(docs, doc_id)).eqNullSafe(F.col("gone")), "left_anti"), docs)
