"""Leadsheets: notes in groups by lyric (or by long gaps), spaced by how far they stand apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import music as M

LONG_GAP = 2.0


def grouped(events: DataFrame) -> DataFrame:
    """Events with ``grp``: runs of one lyric in songs that have lyrics, else runs without a gap above ``LONG_GAP``."""
    events = events if "lyric" in events.columns else events.withColumn("lyric", F.lit(None).cast("string"))
    w = W.partitionBy("song_id").orderBy("event_idx")
    sung = F.max(F.coalesce(F.col("lyric") != "", F.lit(False))).over(W.partitionBy("song_id"))
    first = F.lag("event_idx").over(w).isNull()
    other = ~F.col("lyric").eqNullSafe(F.lag("lyric").over(w))
    far = F.col("start_time") - F.lag("start_time").over(w) > F.lit(LONG_GAP)
    new = F.when(first, False).when(F.col("__sung"), other).otherwise(far)
    marked = events.withColumn("__sung", sung).withColumn("__new", new.cast("long"))
    grp = F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn("grp", grp).drop("__new").withColumnRenamed("__sung", "sung")


def group_lines(events: DataFrame) -> DataFrame:
    """(song_id, grp, sung, lyric, n_notes, notes): each group's notes in a line."""
    w = W.partitionBy("song_id", "grp").orderBy("event_idx")
    gap = F.lead("start_time").over(w) - F.col("start_time")
    spaced = grouped(events).withColumn("__s", F.concat("note", F.when(gap.isNotNull(), M.gap_mark(gap)).otherwise("")))
    line = F.array_join(F.sort_array(F.collect_list(F.struct("event_idx", "__s")))["__s"], "")
    return spaced.groupBy("song_id", "grp").agg(F.first("sung").alias("sung"), F.first("lyric").alias("lyric"), F.count(F.lit(1)).alias("n_notes"), line.alias("notes"))


def sheets(events: DataFrame) -> DataFrame:
    """(song_id, text): a song's groups one below the other; with lyrics above them and blank lines between, if it has any."""
    lines = group_lines(events)
    block = F.concat(F.when(F.col("sung") & (F.coalesce("lyric", F.lit("")) != ""), F.concat("lyric", F.lit("\n"))).otherwise(""), F.col("notes"))
    blocks = F.sort_array(F.collect_list(F.struct("grp", block.alias("b"))))["b"]
    both = lines.groupBy("song_id").agg(F.array_join(blocks, "\n\n").alias("__a"), F.array_join(blocks, "\n").alias("__b"), F.first("sung").alias("__s"))
    return both.select("song_id", F.when(F.col("__s"), F.col("__a")).otherwise(F.col("__b")).alias("text"))
