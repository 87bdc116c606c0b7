"""Mixing sources to target weights, with exact budgets.

Every document gets a hash-random key. Within each source the keys are cut into ranges,
each range is sorted, and the ranges' sums give distributed prefix sums of the words.
A source takes whole epochs of its documents and then, in key order, the documents up to
its exact budget; the one that the budget ends in is taken in part.

No task holds a whole source: a range has about ``RANGE_ROWS`` rows however large its
source is, ``RANGE_ROWS`` ranges make a range of the second level, and the prefix sums
are taken at each level. Only ids, sizes and keys are shuffled, never texts.

Edge cases: null and empty texts have size 0, take nothing, and still get a row. A very
long text is counted whole, and cut only where its source's budget ends. A null
source is a source of its own, ordered last. Equal rows have equal keys; the prefix sums
run over them one by one, so what they take together is the same in every run. Sources
of size 0 have target 0. Ids may be of any type. An empty table gives an empty one.
Extra columns do not matter, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .rows import named, numbered, place
from .workspace import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20_240_613
RANGE_ROWS = 1000
#: Source tables of at most this many rows are broadcast.
BROADCAST_ROWS = 100_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, text)


def _ranked(sources: DataFrame) -> DataFrame:
    """The sources with their rank by code point (null last), counted by ranges and not in one task."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "sources").withColumn("__part", F.shiftright("__id", 33))
    sums = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__id") - F.shiftleft("__part", 33)).drop("__part", "__id", "__before")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    The share of all sizes is dealt by weight; a target above cap times its source's size stops there, and the
    excess is dealt by weight among the others until none is above. Each round but the last fills some source for
    good, so the rounds end, mostly after a few. Only two sums reach the driver in each.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(_ranked(sources).withColumn("weight", weight), "ranked")
    most = F.lit(cap) * F.col("source_size")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0
    while True:
        full = most < F.col("weight") * F.lit(unit)
        fixed, rest = ranked.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (budget - (fixed or 0.0)) / rest if rest else unit
        if now <= unit:
            break
        unit = now
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(unit), most)).drop("rank")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken) for every row."""
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _key(F.col(doc_id), F.col(text)).alias("key"), word_count(F.col(text)).alias("size")), "sizes")
    sums = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sums")
    known = targets(sums.select("source", "source_size", "docs"), **how)
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = rows.withColumnRenamed("source", "__s").join(known, F.col("__s").eqNullSafe(F.col("source")))
    # the range of a key: its place among as many equal parts of the key space as the source needs
    ranges = F.ceil(F.col("docs") / F.lit(float(RANGE_ROWS)))
    rows = rows.withColumn("part", F.floor((F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53))) * ranges))
    offsets = rows.groupBy("source", "part").agg(F.sum("size").alias("__sum")).withColumn("__whole", F.floor(F.col("part") / F.lit(RANGE_ROWS)))
    before = lambda *by: F.coalesce(F.sum("__sum").over(W.Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    wholes = offsets.groupBy("source", "__whole").agg(F.sum("__sum").alias("__sum"))
    wholes = wholes.select(F.col("source").alias("__ws"), F.col("__whole").alias("__w"), before("source", "__whole").alias("__far"))
    offsets = offsets.withColumn("__near", before("source", "__whole", "part"))
    offsets = offsets.join(wholes, F.col("source").eqNullSafe(F.col("__ws")) & (F.col("__whole") == F.col("__w")))
    offsets = offsets.select(F.col("source").alias("__o"), F.col("part").alias("__p"), (F.col("__far") + F.col("__near")).alias("__before"))
    within = F.sum("size").over(W.Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - F.col("size")
    placed = rows.withColumn("__within", within).join(offsets, F.col("source").eqNullSafe(F.col("__o")) & (F.col("part") == F.col("__p")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.floor(F.col("target") - epochs * F.col("source_size"))
    partly = F.least(F.greatest(left - (F.col("__before") + F.col("__within")), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", (epochs * F.col("size") + partly).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; whole texts only.

    The document that a source's budget ends in is taken whole or left, whichever is nearer. Each source's cut is a key,
    so texts are not shuffled: the rows meet the table of sources only.
    """
    planned = materialize(plan(docs, doc_id, text, source, **how), "plan")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    over = planned.withColumn("e", epochs).withColumn("more", F.col("taken") - F.col("e") * F.col("size"))
    cut = F.max(F.when(F.lit(2) * F.col("more") >= F.greatest("size", F.lit(1)), F.col("key"))).alias("cut")
    cuts = over.groupBy(F.col("source").alias("of")).agg(F.first("e").alias("epochs"), cut)
    if cuts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    own, i, t, s = numbered(docs), place(docs, doc_id), place(docs, text), place(docs, source)
    copies = (F.col("epochs") + F.when(_key(F.col(i), F.col(t)) <= F.col("cut"), 1).otherwise(0)).cast("int")
    out = own.join(cuts, F.col(s).eqNullSafe(F.col("of"))).where(word_count(F.col(t)) > 0).withColumn("copies", copies).where("copies > 0")
    return named(out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)
