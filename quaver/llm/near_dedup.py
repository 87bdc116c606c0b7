"""Near-duplicate detection by a signature-coordinate inverted join.

1. Every text gets the hash of its set of word shingles and a MinHash signature of
   ``COORDS`` coordinates. Texts with equal sets become one class (a combined
   aggregation, so a copy group of any size is one row after the map side).
2. Each class is posted under (coordinate, value) pairs. Prefix rule: pairs on very
   long lists go last, then coordinates in order, and only so many first ones are
   posted that two sets of similarity 0.8 share none of them with probability
   ``MISS`` at most for either set. Passages that very many documents share are so
   skipped, while real copies still meet.
3. Inside a list the collisions of two signatures are counted, and pairs of ``MATCHES``
   or more are retained, each only in the first list that holds both. The classes of
   retained pairs get their texts, and links are confirmed on the full sets; pairs that
   confirmed links already connect are skipped, so a list yields fewer links than it has
   members, while every component comes out as with all pairs.
4. Lists are merged in two rounds, the first coordinates and then the others, and links
   are contracted to components after each. A list is cut into blocks of ``BLOCK``
   classes by a hash and compared inside them; a list that lies in one component is
   done; in the second round ``SAMPLE`` members stand for a component. So a group of n
   near copies costs n rows a list and each text about as often as the first round has
   coordinates, and not every pair of blocks.
5. What this leaves out is made up for exactly: in lists of several components that were
   not compared as a whole, all members of different components meet, block by block;
   blocks of one and the same component do not.
6. Each document gets its class's component.

Edge cases: null, empty and wordless texts have an empty set and are linked with
nothing. Fewer words than a shingle: the whole sequence is one shingle. A very long text
is read whole. Repeated rows are one class. Rows with the same id and different texts are
judged each by its own. A row without an id keeps its row, has no component, is linked
with nothing and is kept. Ids may be of any orderable type; the smallest in its order
names a component. An empty table gives an empty one. Extra columns do not matter,
whatever they are called; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .components import connected_components
from .kernels import mix64, shingle_hashes, slices, stream64, words_of
from .rows import named, numbered, place
from .workspace import materialize

COORDS = 64
#: Coordinates that must collide. Two sets of similarity 0.8 have fewer with probability 3.2e-7.
MATCHES = 34
#: Chance that of two sets of similarity 0.8 all posted pairs of one are among those that differ.
MISS = 1e-7
#: Counters of the list-length sketch: fixed, so its size does not grow with the data.
SKETCH = 1 << 16
#: Lists are long from this count on, or from LONG_X times the mean counter.
LONG, LONG_X = 400, 4
BLOCK = 256
#: Coordinates of each round of merging, and how many members stand for a component after the first.
ROUNDS = ((0, 2), (2, COORDS))
SAMPLE = 8
#: Tables of at most this many ids are broadcast.
BROADCAST_IDS = 500_000

_A = stream64(COORDS, 21) | np.uint64(1)
_B = stream64(COORDS, 22)
_SIG = np.dtype("<u4")


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash signature (32-bit values) of a set of shingle hashes."""
    low = np.full(COORDS, np.uint64((1 << 64) - 1))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            part = shingles[i : i + 4096, None] * _A
            part += _B
            low = np.minimum(low, part.min(axis=0))
    return (low >> np.uint64(32)).astype(_SIG)


def _profiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words_of(batch.column(1))
            n, a, b, sig = [], [], [], []
            for i in range(batch.num_rows):
                s = np.unique(shingle_hashes(w.hashes[w.doc_start[i] : w.doc_start[i + 1]], k))
                n.append(len(s))
                with np.errstate(over="ignore"):
                    a.append(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                    b.append((mix64(s + np.uint64(0x14057B7EF767814F)) * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                sig.append(signature(s).tobytes() if len(s) else None)
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (a, b))
            made = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["id", "th", "n", "fa", "fb", "sig"])


def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(id, th, n, fa, fb, sig) of each row: hash of the text, size and 128-bit hash of its shingle set, MinHash signature (null if empty)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    return rows.mapInArrow(lambda b: _profiles(b, k), f"id {rows.schema['id'].dataType.simpleString()}, th long, n long, fa long, fb long, sig binary")


def _buckets(sig: np.ndarray) -> np.ndarray:
    """Sketch counter of each coordinate's value."""
    return (mix64(sig.astype(np.uint64) + (np.arange(COORDS, dtype=np.uint64) << np.uint64(32))) & np.uint64(SKETCH - 1)).astype(np.int64)


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_SIG).reshape(-1, COORDS)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        total += np.bincount(_buckets(_sig_matrix(batch.column(0))).ravel(), minlength=SKETCH)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["b", "c"])


def prefix_sizes(similarity: float = 0.8, miss: float = MISS) -> list[int]:
    """For each number of coordinates off the long lists: how many to post.

    The number of coordinates that differ is binomial. At worst all of them are off the long lists, and the first ones
    posted are any of those; what is posted must hold one that agrees but for a chance of ``miss``. Where even all of them
    cannot promise that, the first ones on long lists are posted as well.
    """
    differ = [math.comb(COORDS, m) * (1 - similarity) ** m * similarity ** (COORDS - m) for m in range(COORDS + 1)]
    hot = math.ceil(math.log(miss) / math.log(1 - similarity))
    out = []
    for free in range(COORDS + 1):
        lost, own = list(differ), 0  # lost[m]: m differ, and all of the first ``own`` are among them
        while own < free and sum(lost) > miss:
            lost = [x * max(min(m, free) - own, 0) / (free - own) for m, x in enumerate(lost)]
            own += 1
        out.append(own if own and sum(lost) <= miss else min(COORDS, free + hot))
    return out


def _posts(batches: Iterator[pa.RecordBatch], long_lists: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _sig_matrix(batch.column(1))
        hot = long_lists[_buckets(sig)]
        order = np.argsort(hot, axis=1, kind="stable")
        take = np.arange(COORDS)[None, :] < sizes[(~hot).sum(axis=1)][:, None]
        row, at = np.nonzero(take)
        coord = order[row, at]
        token = (coord.astype(np.int64) << 32) | sig[row, coord].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(batch.column(0).to_numpy()[row])], names=["token", "cls"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by its first ``keys`` columns."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        table = pa.Table.from_batches(rest)
        cols = [table.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(len(table), dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1]).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


class Group:
    """Classes of a list that meet in one pair of blocks: (token, bi, bj, blk, cls, comp, n, sig), and perhaps their texts."""

    def __init__(self, g: pa.Table, long_lists: np.ndarray, sizes: np.ndarray, share: int) -> None:
        self.cls, self.comp = g.column(4).to_numpy(), g.column(5).to_numpy()
        blk, n, sig = g.column(3).to_numpy(), g.column(6).to_numpy(), _sig_matrix(g.column(7))
        coord, m = g.column(0)[0].as_py() >> 32, len(g)
        hot = long_lists[_buckets(sig)]
        # place of each coordinate in the posting order of each row; lists that hold both: posted by both and equal
        order = np.argsort(hot, axis=1, kind="stable")
        at = np.empty_like(order)
        np.put_along_axis(at, order, np.arange(COORDS)[None, :], axis=1)
        posted = at < sizes[(~hot).sum(axis=1)][:, None]
        count, earlier = np.zeros((m, m), dtype=np.uint8), np.zeros((m, m), dtype=bool)
        for c in range(COORDS):
            same = sig[:, c][:, None] == sig[:, c][None, :]
            count += same
            if c < coord:
                earlier |= same & posted[:, c][:, None] & posted[:, c][None, :]
        good = (count >= MATCHES) & ~earlier & (self.comp[:, None] != self.comp[None, :])
        good &= 100 * np.minimum(n[:, None], n[None, :]) >= share * np.maximum(n[:, None], n[None, :])
        if g.column(1)[0].as_py() != g.column(2)[0].as_py():
            good &= blk[:, None] != blk[None, :]
        #: pairs (both ways) that collide often enough, may be similar by size, are not connected, and meet here first
        self.good = good


def _candidates(batches: Iterator[pa.RecordBatch], long_lists: np.ndarray, sizes: np.ndarray, share: int) -> Iterator[pa.RecordBatch]:
    """Rows of each group (token, bi, bj) that take part in a retained pair."""
    for g in _runs(batches, 3):
        if len(g) > 1:
            use = Group(g, long_lists, sizes, share).good.any(axis=0)
            if use.any():
                yield from g.filter(pa.array(use)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch], long_lists: np.ndarray, sizes: np.ndarray, share: int, k: int) -> Iterator[pa.RecordBatch]:
    """Components between which a confirmed link of the group is, where no earlier link of the group connects them."""
    for g in _runs(batches, 3):
        if len(g) < 2:
            continue
        group = Group(g, long_lists, sizes, share)
        good, label = group.good, group.comp.copy()
        w = words_of(g.column(8).combine_chunks())
        sets = [np.unique(shingle_hashes(w.hashes[w.doc_start[i] : w.doc_start[i + 1]], k)) for i in range(len(g))]
        size = np.array([len(s) for s in sets])
        left, right = [], []
        for i in np.argsort(-good.sum(axis=1), kind="stable"):
            near = np.flatnonzero(good[i] & (label != label[i]))
            good[:, i] = False
            if not len(near) or not size[i]:
                continue
            for part in np.array_split(near, -(-len(near) // 64)):
                many = np.concatenate([sets[j] for j in part])
                at = np.minimum(np.searchsorted(sets[i], many), size[i] - 1)
                ends = np.cumsum(size[part])
                hits = np.concatenate([[0], np.cumsum(sets[i][at] == many)])
                common = hits[ends] - hits[ends - size[part]]
                for j in part[100 * common >= share * (size[i] + size[part] - common)]:
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        left.append(group.comp[i])
                        right.append(group.comp[j])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src", "dst"])


_GROUP = "token long, bi long, bj long, blk long, cls long, comp long, n long, sig binary"


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


class Merger:
    """The lists of a table of classes (cls, rep, th, n, sig) and the components that confirmed links have made so far."""

    def __init__(self, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, share: int, k: int) -> None:
        self.classes, self.share, self.k = classes, share, k
        self.texts = docs.select(F.col(doc_id).alias("rep"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = np.zeros(SKETCH, np.int64)
        for b, c in classes.select("sig").mapInArrow(_sketch, "b long, c long").groupBy("b").agg(F.sum("c")).collect():  # SKETCH rows at most
            counts[b] = c
        self.long_lists = counts >= max(LONG, LONG_X * counts.mean())
        self.sizes = np.array(prefix_sizes(share / 100))
        long_lists, sizes = self.long_lists, self.sizes
        posts = classes.select("cls", "sig").mapInArrow(lambda b: _posts(b, long_lists, sizes), "token long, cls long")
        self.posts = materialize(posts, "posts")
        self.components: DataFrame | None = None
        self.whole: list[DataFrame] = []

    def members(self, low: int = 0, high: int = COORDS) -> DataFrame:
        """(token, cls, comp) of the lists of these coordinates that lie in more than one component."""
        coord = F.shiftright("token", 32)
        own = self.posts.where((coord >= low) & (coord < high))
        if self.components is None:
            own = own.withColumn("comp", F.col("cls"))
            lists = own.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        else:
            own = own.join(self.components, F.col("cls") == F.col("node"), "left").select("token", "cls", F.coalesce("component", "cls").alias("comp"))
            lists = own.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
        return own.join(broadcast_if_small(materialize(lists.select("token", "c"), "lists")), "token")

    def merge(self, groups: DataFrame) -> None:
        """Confirm the links of the groups (token, bi, bj, blk, cls, comp) and contract them."""
        long_lists, sizes, share, k, parts = self.long_lists, self.sizes, self.share, self.k, self.parts
        keys = ("token", "bi", "bj")
        rows = groups.join(self.classes.select("cls", "n", "sig"), "cls").select(*keys, "blk", "cls", "comp", "n", "sig")
        rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "cls")
        found = materialize(rows.mapInArrow(lambda b: _candidates(b, long_lists, sizes, share), _GROUP), "candidates")
        wanted = self.classes.select("cls", "rep", "th").join(found.select("cls").distinct(), "cls", "left_semi")
        # one text for each class, however often its row is repeated; if the wanted are many, all texts are shuffled
        texts = self.texts.join(broadcast_if_small(wanted), ["rep", "th"]).groupBy("cls").agg(F.first("text").alias("text"))
        full = found.join(texts, "cls").select(*keys, "blk", "cls", "comp", "n", "sig", "text").repartition(parts, *keys).sortWithinPartitions(*keys, "cls")
        links = materialize(full.mapInArrow(lambda b: _links(b, long_lists, sizes, share, k), "src long, dst long"), "links")
        merged = connected_components(links)
        if self.components is not None:  # links are between components: those that go on go on with all their members
            onto = merged.select(F.col("node").alias("component"), F.col("component").alias("onto"))
            old = self.components.join(broadcast_if_small(onto), "component", "left").select("node", F.coalesce("onto", "component").alias("component"))
            merged = old.union(merged.join(self.components.select("node"), "node", "left_anti"))
        self.components = materialize(merged, "components")

    def round(self, low: int, high: int) -> None:
        """Compare members inside blocks of their lists; from the second round on, a few for each component."""
        own = self.members(low, high)
        if self.components is not None:
            some = W.Window.partitionBy("token", "comp").orderBy(F.xxhash64("cls", "token"), "cls")
            own = own.withColumn("place", F.row_number().over(some)).where(F.col("place") <= SAMPLE).drop("place")
        own = materialize(own, "members")
        lists = materialize(own.groupBy("token").agg(F.count(F.lit(1)).alias("taken"), F.first("c").alias("of")), "lists")
        self.whole.append(lists.where((F.col("taken") == F.col("of")) & (F.col("taken") <= BLOCK)).select("token"))
        blk = F.pmod(F.xxhash64("cls", "token"), F.ceil(F.col("taken") / F.lit(BLOCK)))  # other neighbours in every list
        cut = own.join(broadcast_if_small(lists), "token").withColumn("blk", blk)  # few lists: a long one stays spread
        self.merge(cut.select("token", F.col("blk").alias("bi"), F.col("blk").alias("bj"), "blk", "cls", "comp"))

    def rest(self) -> None:
        """Compare all that is in one list and in different components, where the list was not compared as a whole."""
        own = self.members()
        for done in self.whole:
            own = own.join(broadcast_if_small(done), "token", "left_anti")
        own = materialize(own, "members")
        if own.isEmpty():
            return
        # a component with many members in a list has blocks of its own; the others share some
        large = BLOCK // 4
        sizes = own.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
        few = sizes.where(F.col("m") <= large).groupBy("token").agg(F.sum("m").alias("few"))
        sizes = sizes.join(few, "token", "left").select("token", "comp", F.when(F.col("m") > large, F.col("comp")).alias("pure"), "m", "few")
        pieces = F.ceil(F.when(F.col("pure").isNotNull(), F.col("m")).otherwise(F.col("few")) / F.lit(BLOCK))
        piece = F.pmod(F.when(F.col("pure").isNotNull(), F.xxhash64("cls")).otherwise(F.xxhash64("comp")), pieces)
        sizes = materialize(sizes, "sizes")
        own = materialize(own.join(broadcast_if_small(sizes), ["token", "comp"]).select("token", "cls", "comp", "pure", F.xxhash64("pure", piece).alias("blk")), "blocks")
        blocks = materialize(own.select("token", F.col("blk").alias("o"), F.col("pure").alias("other")).distinct(), "pairs")
        met = own.join(broadcast_if_small(blocks), "token").where(F.coalesce(F.col("pure") != F.col("other"), F.lit(True)))
        self.merge(met.select("token", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), "blk", "cls", "comp"))


def similar_components(classes: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 80, k: int = 4) -> DataFrame:
    """(node, component): the classes that links of ``share`` % connect."""
    merger = Merger(classes, docs, doc_id, text, share, k)
    for low, high in ROUNDS:
        merger.round(low, high)
    merger.rest()
    return merger.components


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 80, k: int = 4) -> DataFrame:
    """(id, n_shingles, component, kept) for every row: the smallest id that links of ``share`` % reach, and whether it is the row's own."""
    each = materialize(profiles(docs, doc_id, text, k), "profiles")
    full = each.where((F.col("n") > 0) & F.col("id").isNotNull())
    one = full.groupBy("fa", "fb").agg(F.min(F.struct("id", "th")).alias("m"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    number = F.monotonically_increasing_id()  # written with the class, so it stays
    classes = materialize(one.select(number.alias("cls"), "fa", "fb", F.col("m.id").alias("rep"), F.col("m.th").alias("th"), "n", "sig"), "classes")
    comps = similar_components(classes, docs, doc_id, text, share, k)
    joined = classes.select("cls", "fa", "fb", "rep").join(comps, F.col("cls") == F.col("node"), "left")
    joined = materialize(joined.select("fa", "fb", "rep", "component"), "joined")
    smallest = joined.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    reps = joined.join(broadcast_if_small(smallest), "component", "left").select("fa", "fb", F.coalesce("least", "rep").alias("component"))
    same = (each.fa == reps.fa) & (each.fb == reps.fb) & (each.n > 0) & each.id.isNotNull()
    out = each.join(reps, same, "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies: rows whose id is not their component's smallest go.

    Of rows with the same id all stay or all go; rows without an id stay. Only ids that go are joined.
    """
    judged = near_duplicates(docs, doc_id, text, share, k)
    gone = materialize(judged.where(~F.col("kept")).select(F.col("id").alias("gone")).distinct(), "gone")
    return named(numbered(docs).join(gone, F.col(place(docs, doc_id)) == F.col("gone"), "left_anti"), docs)
