"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each written as its length in bytes, a colon and
its value, or ``-`` if null. The leaves of a group stand in order; while several nodes
remain, every ``fanout`` consecutive ones (at the end perhaps fewer, even one) become the
hash of their hex digests. The group's last node is its subroot; the subroots, in order of
their groups, become the root in the same way.

Superblock reduction: nodes are numbered, numbers are dealt to buckets of ``fanout ** levels``,
``applyInPandas`` collapses that many levels inside each bucket, and the buckets' roots are
reduced by the same function, until a group has one bucket. The proof of a node is its proof
inside the bucket followed by its bucket's proof above. No task holds more than a bucket
(1024 nodes), so a group with a third of all rows is spread like any other. Numbers come of
ranges: rows are sorted by ranges of (group, order, leaf), and each range begins where the
ranges before it end. Only digests and keys are shuffled, never the fields.

A proof is a pair of arrays with one entry for each level, from the leaf up: the digests left
and right of the node in its run, joined. So ``folded`` needs neither numbers nor the fanout.

Edge cases: nulls are ``-`` in a leaf, an empty text is ``0:``. A null order value comes first in its
group, the null group first of all groups. Equal orders are sorted by leaf, so that reruns
agree; repeated rows are leaves each, with the same leaf and proofs of their own. A group of
one row has its leaf as subroot; one group's subroot is the root. A very long text is hashed
whole. An empty table gives an empty one. Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .workspace import materialize

FANOUT = 2
#: Levels that one bucket collapses: 1024 nodes of a binary tree.
LEVELS = 10
#: Tables of at most this many rows (groups, range ends, bucket proofs) are broadcast.
BROADCAST_ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(field: Column) -> Column:
    """A field as the leaf holds it."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered_by(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (of a written table) with ``idx``, their place in the group (never null) by the order; counted by ranges of all rows, not in a task for each group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("part", F.shiftright("at", 33))
    # a range begins and ends few groups: these are as many rows as there are ranges and groups
    ends = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.Window.partitionBy(group).orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    ends = materialize(ends.select(group, "part", (before - F.col("first")).alias("shift")), "ends")
    return ranged.join(_small(ends), [group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _collapse(nodes: list[str], fanout: int, levels: int | None) -> tuple[str, list[list[str]], list[list[str]]]:
    """Root of consecutive nodes after so many levels (None: until one is left); each node's left and right digests by level."""
    lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
    now, level, width = nodes, 0, 1
    while level != levels and (levels is not None or len(now) > 1):
        runs = [now[i : i + fanout] for i in range(0, len(now), fanout)]
        beside = [("".join(run[:j]), "".join(run[j + 1 :])) for run in runs for j in range(len(run))]
        for i in range(len(nodes)):
            left, right = beside[i // width]
            lefts[i].append(left)
            rights[i].append(right)
        now, level, width = [_h(run) for run in runs], level + 1, width * fanout
    return now[0], lefts, rights


def _reducer(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        whole = int(rows["m"].iloc[0]) <= fanout**levels
        top, lefts, rights = _collapse(rows["node"].tolist(), fanout, None if whole else levels)
        return rows.assign(top=top, lefts=lefts, rights=rights)

    return bucket


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(gid, idx, node, m, payload) with ``root``, ``lefts``, ``rights``: each group of m numbered nodes reduced to one, with a proof for each node."""
    size = fanout**levels
    bucket = F.floor(F.col("idx") / F.lit(size)).alias("bucket")
    schema = "gid long, idx long, node string, m long, payload string, top string, lefts array<string>, rights array<string>"
    made = nodes.select("gid", "idx", "node", "m", "payload").groupBy("gid", bucket).applyInPandas(_reducer(fanout, levels), schema)
    made = materialize(made, "buckets").withColumn("bucket", F.floor(F.col("idx") / F.lit(size)))
    done = made.where(F.col("m") <= size).select("gid", "idx", "node", "m", "payload", F.col("top").alias("root"), "lefts", "rights")
    more = made.where((F.col("m") > size) & (F.col("idx") % size == 0))
    if more.isEmpty():
        return done
    roots = more.select("gid", F.col("bucket").alias("idx"), F.col("top").alias("node"), F.ceil(F.col("m") / F.lit(size)).alias("m"), F.lit(None).cast("string").alias("payload"))
    above = reduced(roots, fanout, levels).select("gid", F.col("idx").alias("bucket"), "root", F.col("lefts").alias("ul"), F.col("rights").alias("ur"))
    low = made.where(F.col("m") > size).join(_small(above), ["gid", "bucket"])
    return done.union(low.select("gid", "idx", "node", "m", "payload", "root", F.concat("lefts", "ul"), F.concat("rights", "ur")))


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda now, s: F.sha2(F.concat(s["l"], now, s["r"]), 256))


def proof_hash(lefts: Column, rights: Column) -> Column:
    """Hash of all digests of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)


def manifest(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple = FIELDS, claim: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """(order, group, leaf, idx, subroot, root, lefts, rights, claim) for every row, the first two under the names ``order_value`` and ``group_value``.

    ``claim``: another leaf for each row (null: none), computed beside its own and carried along, to be checked against the proof.
    """
    claim = F.lit(None).cast("string") if claim is None else claim
    leaves = docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), leaf_hash(*map(F.col, fields)).alias("leaf"), claim.alias("claim"), F.monotonically_increasing_id().alias("uid"))
    leaves = materialize(leaves, "leaves")
    groups = materialize(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).withColumn("one", F.lit(0)), "groups")
    groups = materialize(numbered_by(groups, "one", "grp").select("grp", "m", F.col("idx").alias("gid")), "groups")
    known = groups.select(F.col("grp").alias("g"), "m", "gid")
    rows = numbered_by(leaves.join(_small(known), F.col("grp").eqNullSafe(F.col("g"))), "gid", "ord", "leaf", "uid")
    kept = F.struct("grp", "ord", "claim")
    payload = F.to_json(kept)
    kind = f"grp {leaves.schema['grp'].dataType.simpleString()}, ord {leaves.schema['ord'].dataType.simpleString()}, claim string"
    trees = reduced(rows.select("gid", "idx", F.col("leaf").alias("node"), "m", payload.alias("payload")), fanout, levels)
    # only the first node of each group goes on
    subroots = materialize(trees.where("idx = 0").select("gid", "root"), "subroots")
    count = subroots.count()
    nodes = subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.col("root").alias("node"), F.lit(count).cast("long").alias("m"), F.lit(None).cast("string").alias("payload"))
    tops = reduced(nodes, fanout, levels).select(F.col("idx").alias("gid"), F.col("root").alias("whole"), F.col("lefts").alias("ul"), F.col("rights").alias("ur"))
    out = trees.join(_small(tops), "gid").withColumn("kept", F.from_json("payload", kind))
    return out.select(
        F.col("kept.ord").alias("order_value"), F.col("kept.grp").alias("group_value"), F.col("node").alias("leaf"), "idx",
        F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("lefts", "ul").alias("lefts"), F.concat("rights", "ur").alias("rights"), F.col("kept.claim").alias("claim"),
    )


def verified(made: DataFrame) -> DataFrame:
    """A manifest with ``folded_root``, from the claim where there is one, and whether it is the root."""
    leaf = F.coalesce("claim", "leaf")
    return made.withColumn("folded_root", folded(leaf, F.col("lefts"), F.col("rights"))).withColumn("verified", F.col("folded_root") == F.col("root"))
