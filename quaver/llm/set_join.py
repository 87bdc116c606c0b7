"""Exact Jaccard join of texts on sets of word n-grams, with skipping by the relations of sets.

1. ``profiles``: the hash of each text's set, and the smallest hashes of its members (``SAMPLE`` of all
   hashes, or as many as its prefix needs). Texts with equal sets become one class.
2. ``posts``: members are counted over all classes (shuffled once, for their counts and to keep those of
   several classes) and put in one order: sampled ones by how many classes have them, then the others. Two sets similar enough share one of the first members of
   both (prefix rule), so each class is posted under these. A member of one class only meets nobody, and is
   counted as a place but not posted: a text with enough members of its own is posted nowhere, whatever
   passages it shares with others.
3. Index lists are cut into blocks by component and size, with bounds on size and place. Blocks
   whose bounds leave too little room for an intersection never meet (index-level skipping),
   nor do members whose own sizes and places do.
4. In a group of blocks, a set's intersections with all others are derived from those of a highly similar
   set that has been computed: only members in one of the two are looked up (answer-level skipping).
   Links are confirmed on the full sets; pairs that confirmed links already connect are passed over.
5. Lists are merged in rounds: first each class's two posts of smallest hash, inside blocks; then, exactly, all
   that is left in different components: in short lists the pairs, each once, and in long ones every pair of blocks. Links become
   components after each.

A list of n near copies so costs n rows, as they are one component after the first round. Nothing is
capped: a list of any length is blocks of ``BLOCK`` classes. Broadcast tables are counted first.

Edge cases: null, empty and wordless texts have an empty set and are linked with nothing. Fewer
words than an n-gram: the whole sequence is one. A very long text is read whole. Repeated
rows, and other texts with the same set, are one class. A row without an id has no component and is linked with nothing.
Ids may be of any orderable type; the smallest names a component. An empty table gives an empty one. Only id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .components import connected_components
from .kernels import mix64, shingle_hashes, slices, words_of
from .near_dedup import _runs, broadcast_if_small
from .workspace import materialize

#: Share of all hashes whose members are counted. The prefix of a similarity of 0.9 is a tenth of a set.
SAMPLE = 0.15
BLOCK = 256
#: Lists of at most this many classes give pairs, so that a pair that shares many lists is confirmed once.
SHORT = 16
#: Lists of a class that are known where pairs are met, so that a pair is confirmed in the first it shares.
FIRST_LISTS = 64
#: One class in ``SOME`` tells which members about ``OFTEN`` classes or more have.
SOME, OFTEN = 64, 2048
_LIMIT = np.uint64(int(SAMPLE * (1 << 64)))


def least_common(n: Column | np.ndarray, m: Column | np.ndarray, share: int) -> Column | np.ndarray:
    """100 + share times the intersection that sets of n and m members need, before rounding up."""
    return share * (n + m)


def prefix(n: int, share: int) -> int:
    """How many first members hold one that a similar set has: all but the smallest possible intersection, and one more."""
    return n - -(-share * n // 100) + 1


def set_of(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, k))


def _profiles(batches: Iterator[pa.RecordBatch], share: int, k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words_of(batch.column(1))
            n, sampled, a, b, low = [], [], [], [], []
            for i in range(batch.num_rows):
                s = set_of(w.hashes[w.doc_start[i] : w.doc_start[i + 1]], k)
                n.append(len(s))
                sampled.append(int(np.searchsorted(s, _LIMIT)))
                low.append(s[: max(sampled[-1], prefix(len(s), share))] if len(s) else s)
                with np.errstate(over="ignore"):
                    a.append(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    b.append((mix64(s + np.uint64(0x14057B7EF767814F)) * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (a, b))
            members = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, low)]), pa.int32()), pa.array(np.concatenate(low).view(np.int64)))
            made = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sampled, pa.int64()), pa.array(a), pa.array(b), members]
            yield pa.RecordBatch.from_arrays(made, names=["id", "th", "n", "sampled", "fa", "fb", "low"])


def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 90, k: int = 3) -> DataFrame:
    """(id, th, n, sampled, fa, fb, low) of each row: hash of the text, size of its set and of the sampled part, 128-bit hash of the set, its smallest hashes in order."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, th long, n long, sampled long, fa long, fb long, low array<long>"
    return rows.mapInArrow(lambda b: _profiles(b, share, k), schema)


def posts(classes: DataFrame, share: int) -> DataFrame:
    """(token, cls, n, pos): the index lists. pos: the member's place in the order of all members, counted from 0."""
    members = classes.select("cls", F.posexplode("low").alias("at", "token"))
    # any figure that is the same wherever a member stands gives an order: those that would fill a task are counted in some classes, and dealt out
    some = members.where(F.pmod(F.xxhash64("cls"), F.lit(SOME)) == 0).groupBy("token").agg((F.count(F.lit(1)) * SOME).alias("about")).where(F.col("about") >= OFTEN)
    often = materialize(some, "often")
    if often.isEmpty():
        counted = members.withColumn("c", F.count(F.lit(1)).over(W.Window.partitionBy("token")))
    else:
        dealt = members.join(broadcast_if_small(often), "token", "left").withColumn("deal", F.when(F.col("about").isNotNull(), F.col("cls")))
        counted = dealt.withColumn("c", F.coalesce("about", F.count(F.lit(1)).over(W.Window.partitionBy("token", "deal")))).drop("about", "deal")
    shared = counted.where("c > 1")
    # sizes come to the members that are left, where these are dealt by class in any case; most have gone by then
    shared = shared.join(classes.select("cls", "n", "sampled"), "cls")
    own, order = W.Window.partitionBy("cls"), W.Window.partitionBy("cls", "inside").orderBy("c", "token")
    inside = F.col("at") < F.col("sampled")
    alone = F.col("sampled") - F.sum(inside.cast("long")).over(own)  # sampled members that no other class has come first
    placed = shared.withColumn("inside", inside).withColumn("pos", F.when(inside, alone + F.row_number().over(order) - 1).otherwise(F.col("at")).cast("long"))
    last = F.col("n") - F.ceil(F.lit(share) * F.col("n") / F.lit(100))  # of the prefix
    return placed.where(F.col("pos") <= last).select("token", "cls", "n", "pos")


def may_meet(n: np.ndarray, pos: np.ndarray, share: int, width: int = 64) -> np.ndarray:
    """Which members of a list can be similar by size and place, as a matrix; whole blocks of members are skipped by their bounds."""
    order = np.lexsort((pos, n))
    n, pos, m = n[order], pos[order], len(n)
    out = np.zeros((m, m), bool)
    lows = range(0, m, width)
    bound = [(n[a : a + width].min(), n[a : a + width].max(), (n - pos)[a : a + width].max()) for a in lows]
    for x, a in enumerate(lows):
        for y, b in enumerate(lows[: x + 1]):
            if 100 * bound[y][1] < share * bound[x][0] or (100 + share) * min(bound[x][2], bound[y][2]) < share * (bound[x][0] + bound[y][0]):
                continue
            i, j = (slice(a, a + width), slice(b, b + width))
            p, q = n[i, None], n[None, j]
            room = np.minimum((n - pos)[i, None], (n - pos)[None, j])
            fit = (100 * np.minimum(p, q) >= share * np.maximum(p, q)) & ((100 + share) * room >= least_common(p, q, share))
            out[i, j] |= fit
            out[j, i] |= fit.T
    back = np.empty((m, m), bool)
    back[np.ix_(order, order)] = out
    return back


def _open(g: pa.Table, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of the rows of a group (token, bi, bj, blk, cls, comp, n, pos), and the pairs of different ones that may be similar."""
    blk, comp, n, pos = (g.column(i).to_numpy() for i in (3, 5, 6, 7))
    good = may_meet(n, pos, share) & (comp[:, None] != comp[None, :])
    if g.column(1)[0].as_py() != g.column(2)[0].as_py():
        good &= blk[:, None] != blk[None, :]
    return comp, good


def _candidates(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Rows of each group that may be similar to another. With (sampled, low, lists: places in low) as well, pairs of an earlier list are left to it, and the sampled members two sets share bound their intersection."""
    for g in _runs(batches, 3):
        if len(g) < 2:
            continue
        good = _open(g, share)[1]
        if g.num_columns > 8 and good.any():
            # pairs that stand together in an earlier list are compared there
            token, low = g.column(0)[0].as_py(), g.column(9).combine_chunks()
            flat, ends = low.flatten().to_numpy(), low.offsets.to_numpy() - low.offsets[0].as_py()
            before = []
            for at, places in zip(ends, g.column(10).to_pylist(), strict=False):
                own = flat[at + np.array(places, np.int64)]
                here = np.flatnonzero(own == token)
                before.append(np.unique(own[: here[0]] if len(here) else own))
            met = Answers(before)
            for i in np.flatnonzero(good.any(axis=1)):
                good[i] &= met.of(int(i)) == 0
        if g.num_columns > 8 and good.any():
            n, sampled = g.column(6).to_numpy(), g.column(8).to_numpy()
            lists = g.column(9).combine_chunks()
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            answers = Answers([flat[a - ends[0] : a - ends[0] + k] for a, k in zip(ends, sampled, strict=False)])
            for i in np.flatnonzero(good.any(axis=1)):
                most = answers.of(int(i)) + np.minimum(n[i] - sampled[i], n - sampled)
                good[i] &= (100 + share) * most >= least_common(n[i], n, share)
        use = good.any(axis=1)
        if use.any():
            yield from g.select(range(8)).filter(pa.array(use)).combine_chunks().to_batches()


class Answers:
    """Intersections of the sets of a group, computed set by set from those of similar sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.names, ids = np.unique(flat, return_inverse=True)
        self.ids = np.split(ids, np.cumsum(self.size)[:-1])
        order = np.argsort(ids, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), self.size)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(self.names)))])
        self.known: list[int] = []
        self.common = np.zeros((len(sets), len(sets)), np.int64)
        self.looked_up = 0

    def _hits(self, ids: np.ndarray) -> np.ndarray:
        """How many of these members each set holds."""
        self.looked_up += len(ids)
        sizes = self.first[ids + 1] - self.first[ids]
        at = np.repeat(self.first[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.holders[at], minlength=len(self.sets))

    def of(self, i: int) -> np.ndarray:
        """|set i and set j| for every j."""
        if self.known:
            j = max(self.known, key=lambda x: 2 * self.common[x, i] - self.size[x])  # least differs from i
            if self.size[i] + self.size[j] - 2 * self.common[j, i] < self.size[i]:
                gone, new = np.setdiff1d(self.ids[j], self.ids[i], True), np.setdiff1d(self.ids[i], self.ids[j], True)
                self.common[i] = self.common[j] - self._hits(gone) + self._hits(new)
                self.known.append(i)
                return self.common[i]
        self.common[i] = self._hits(self.ids[i])
        self.known.append(i)
        return self.common[i]


def _links(batches: Iterator[pa.RecordBatch], share: int, k: int) -> Iterator[pa.RecordBatch]:
    """Components between which a confirmed link of the group is, where no earlier link of the group connects them."""
    for g in _runs(batches, 3):
        if len(g) < 2:
            continue
        comp, good = _open(g, share)
        label = comp.copy()
        w = words_of(g.column(8).combine_chunks())
        answers = Answers([set_of(w.hashes[w.doc_start[i] : w.doc_start[i + 1]], k) for i in range(len(g))])
        left, right = [], []
        for i in np.argsort(-good.sum(axis=1), kind="stable"):
            near = np.flatnonzero(good[i] & (label != label[i]))
            good[:, i] = False
            if not len(near):
                continue
            common = answers.of(int(i))[near]
            for j in near[(100 + share) * common >= least_common(answers.size[i], answers.size[near], share)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    left.append(comp[i])
                    right.append(comp[j])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["src", "dst"])


def _pairs(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a short list (token, cls, comp, n, pos) in different components that may be similar, the smaller class first."""
    for g in _runs(batches, 1):
        cls, comp, n, pos = (g.column(i).to_numpy() for i in range(1, 5))
        i, j = np.nonzero(may_meet(n, pos, share) & (comp[:, None] != comp[None, :]) & (cls[:, None] < cls[None, :]))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[i], comp[i], n[i], cls[j], comp[j], n[j])], names=["x", "xc", "xn", "y", "yc", "yn"])


_GROUP = "token long, bi long, bj long, blk long, cls long, comp long, n long, pos long"


class Lists:
    """The index lists of a table of classes (cls, rep, th, n, sampled, low), and the components that confirmed links have made so far."""

    def __init__(self, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, share: int, k: int) -> None:
        self.classes, self.share, self.k = classes, share, k
        self.texts = docs.select(F.col(doc_id).alias("rep"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.posts = materialize(posts(classes, share), "posts")
        self.components: DataFrame | None = None
        self.whole: DataFrame | None = None

    def _with_components(self, rows: DataFrame) -> DataFrame:
        """(token, cls, n, pos, comp) of the lists that hold more than one component."""
        if self.components is None:
            rows = rows.withColumn("comp", F.col("cls"))
        else:
            rows = rows.join(broadcast_if_small(self.components), F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component")
        several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("length"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token", "length")
        return rows.join(broadcast_if_small(materialize(several, "lists")), "token")

    def merge(self, groups: DataFrame, lists: DataFrame | None = None) -> None:
        """Confirm the links of the groups and contract them. ``lists`` (cls, lists): leave out what an earlier list or the sampled members rule out, before texts are fetched."""
        share, k, keys = self.share, self.k, ("token", "bi", "bj")
        rows = groups.select(*keys, "blk", "cls", "comp", "n", "pos")
        if lists is not None:
            rows = materialize(rows, "groups")
            some = self.classes.select("cls", "sampled", "low").join(broadcast_if_small(rows.select("cls").distinct()), "cls", "left_semi")
            # a list stands as its member's place in low, which is smaller than the member
            places = F.transform("lists", lambda t: (F.array_position("low", t) - 1).cast("int")).alias("lists")
            some = some.join(lists, "cls").select("cls", "sampled", "low", places)
            rows = rows.join(some, "cls").select(*keys, "blk", "cls", "comp", "n", "pos", "sampled", "low", "lists")
        rows = rows.repartition(self.parts, *keys).sortWithinPartitions(*keys, "cls")
        found = materialize(rows.mapInArrow(lambda b: _candidates(b, share), _GROUP), "candidates")
        wanted = self.classes.select("cls", "rep", "th").join(found.select("cls").distinct(), "cls", "left_semi")
        # one text for each class, however often its row is repeated
        texts = self.texts.join(broadcast_if_small(wanted), ["rep", "th"]).groupBy("cls").agg(F.first("text").alias("text"))
        full = texts.join(broadcast_if_small(found), "cls").select(*keys, "blk", "cls", "comp", "n", "pos", "text").repartition(self.parts, *keys).sortWithinPartitions(*keys, "cls")
        merged = connected_components(materialize(full.mapInArrow(lambda b: _links(b, share, k), "src long, dst long"), "links"))
        if self.components is not None:  # links are between components: those that go on go on with all their members
            onto = merged.select(F.col("node").alias("component"), F.col("component").alias("onto"))
            old = self.components.join(broadcast_if_small(onto), "component", "left").select("node", F.coalesce("onto", "component").alias("component"))
            merged = old.union(merged.join(self.components.select("node"), "node", "left_anti"))
        self.components = materialize(merged, "components")

    def first_round(self) -> None:
        """Each class in two of its lists, compared inside blocks."""
        place = F.row_number().over(W.Window.partitionBy("cls").orderBy(F.xxhash64("token"), "token"))
        shared = self.posts.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "c")
        own = self.posts.join(broadcast_if_small(materialize(shared, "lists")), "token").withColumn("place", place).where("place <= 2")
        own = materialize(self._with_components(materialize(own.drop("place"), "own")), "members")
        blk = F.pmod(F.xxhash64("cls", "token"), F.ceil(F.col("length") / F.lit(BLOCK)))  # other neighbours in every list
        # lists of which every member was compared with every other
        self.whole = materialize(own.where((F.col("length") == F.col("c")) & (F.col("length") <= BLOCK)).select("token").distinct(), "whole")
        self.merge(own.withColumn("blk", blk).withColumn("bi", F.col("blk")).withColumn("bj", F.col("blk")))

    def _left(self) -> DataFrame:
        """Members of the lists that were not compared as a whole and hold more than one component now."""
        own = self._with_components(self.posts)
        return own if self.whole is None else own.join(broadcast_if_small(self.whole), "token", "left_anti")

    def short_lists(self) -> None:
        """Every pair of short lists, once however many lists it shares."""
        share = self.share
        short = self._left().where(F.col("length") <= SHORT).select("token", "cls", "comp", "n", "pos").repartition(self.parts, "token").sortWithinPartitions("token", "cls")
        met = materialize(short.mapInArrow(lambda b: _pairs(b, share), "x long, xc long, xn long, y long, yc long, yn long").distinct(), "pairs")
        # a class and those that may be similar to it, some at a time
        piece = F.pmod(F.xxhash64("y"), F.ceil(F.count(F.lit(1)).over(W.Window.partitionBy("x")) / F.lit(BLOCK)))
        star = met.withColumn("bi", 2 * piece).withColumn("bj", F.col("bi") + 1)
        row = lambda blk, c: (F.col("x").alias("token"), "bi", "bj", F.col(blk).alias("blk"), F.col(c).alias("cls"), F.col(f"{c}c").alias("comp"), F.col(f"{c}n").alias("n"), F.lit(0).cast("long").alias("pos"))
        self.merge(star.select(*row("bi", "x")).distinct().union(star.select(*row("bj", "y"))))

    def long_lists(self) -> None:
        """Every pair of a long list's blocks in which different components are left and whose bounds leave room for a link."""
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / self.share)))).cast("long")
        own = materialize(self._left().where(F.col("length") > SHORT).withColumn("band", band), "members")
        if own.isEmpty():
            return
        # of a class's first lists, in the order of all members; a pair whose first common list is beyond them is compared in each it shares
        lists = own.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, FIRST_LISTS)["token"].alias("lists"))
        lists = materialize(lists, "own-lists")
        # a component with many members in a list and band has blocks of its own, the others share some
        large = BLOCK // 4
        sizes = own.groupBy("token", "band", "comp").agg(F.count(F.lit(1)).alias("m"))
        few = sizes.where(F.col("m") <= large).groupBy("token", "band").agg(F.sum("m").alias("few"))
        sizes = sizes.join(few, ["token", "band"], "left").select("token", "band", "comp", F.when(F.col("m") > large, F.col("comp")).alias("pure"), "m", "few")
        pieces = F.ceil(F.when(F.col("pure").isNotNull(), F.col("m")).otherwise(F.col("few")) / F.lit(BLOCK))
        piece = F.pmod(F.when(F.col("pure").isNotNull(), F.xxhash64("cls")).otherwise(F.xxhash64("comp")), pieces)
        own = own.join(broadcast_if_small(materialize(sizes, "sizes")), ["token", "band", "comp"])
        own = materialize(own.select("token", "cls", "comp", "n", "pos", "pure", F.xxhash64("pure", "band", piece).alias("blk")), "blocks")
        room = F.max(F.col("n") - F.col("pos")).alias("room")
        blocks = own.groupBy("token", F.col("blk").alias("o"), F.col("pure").alias("other")).agg(F.min("n").alias("n0"), F.max("n").alias("n1"), room)
        met = own.join(broadcast_if_small(materialize(blocks, "bounds")), "token").where(F.coalesce(F.col("pure") != F.col("other"), F.lit(True)))
        fits = (F.lit(100) * F.least("n", "n1") >= F.lit(self.share) * F.greatest("n", "n0")) & (F.lit(100 + self.share) * F.least(F.col("n") - F.col("pos"), F.col("room")) >= least_common(F.col("n"), F.col("n0"), self.share))
        self.merge(met.where(fits).withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")), lists)


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 90, k: int = 3) -> DataFrame:
    """(id, n_shingles, component) for every row: size of its set, and the smallest id that links of ``share`` % reach."""
    each = materialize(profiles(docs, doc_id, text, share, k), "profiles")
    full = each.where((F.col("n") > 0) & F.col("id").isNotNull())
    one = full.groupBy("fa", "fb").agg(F.min(F.struct("id", "th")).alias("m"), *(F.first(c).alias(c) for c in ("n", "sampled", "low")))
    classes = materialize(one.select(F.monotonically_increasing_id().alias("cls"), "fa", "fb", F.col("m.id").alias("rep"), F.col("m.th").alias("th"), "n", "sampled", "low"), "classes")
    lists = Lists(classes, docs, doc_id, text, share, k)
    lists.first_round()
    lists.short_lists()
    lists.long_lists()
    met = classes.select("cls", "fa", "fb", "rep").join(lists.components, F.col("cls") == F.col("node"), "left").select("fa", "fb", "rep", "component")
    met = materialize(met, "joined")
    smallest = met.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    reps = met.join(broadcast_if_small(smallest), "component", "left").select("fa", "fb", F.coalesce("least", "rep").alias("component"))
    same = (each.fa == reps.fa) & (each.fb == reps.fb) & (each.n > 0) & each.id.isNotNull()
    return each.join(reps, same, "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
