"""Summaries that can be added to: a state for each song, a row of counts, extremes and a histogram of pitch classes.

States of parts of a song's events make the state of all of them, in any order and any grouping; so new
events are summed up alone and never the old ones again. A stored state is a table with a folder
for each batch (``batch=<id>``): a batch that is written again replaces itself, so a job that is repeated after
a failure counts nothing twice. A song's key and scores are derived from its state only when they are read.

States have a fixed number of columns and are grouped on the song, with partial sums before the
shuffle; a song of any length is a row a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music as M
from ..operators import keys

FLAGS = ("pyin_agrees", "chord_fit", "beat_aligned")
BATCH = "batch"


def state(events: DataFrame, *more_keys: str) -> DataFrame:
    """The state of the events of each song (and of each of further keys): counts that the events have columns for, ends, and pitch classes (``__0`` to ``__11``, ``__n``). Events without pitch are counted, but in no class."""
    flags = [F.count_if(F.col(c)).alias(f"n_{c}") for c in FLAGS if c in events.columns]
    flags += [F.count("lyric").alias("n_lyric")] if "lyric" in events.columns else []
    ends = [F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end")]
    return events.groupBy("song_id", *more_keys).agg(F.count(F.lit(1)).alias("n_notes"), *flags, *ends, *keys.histogram())


def _sum_up(name: str) -> Column:
    return {"first_start": F.min, "last_end": F.max}.get(name, F.sum)(name).alias(name)


def merged(*states: DataFrame) -> DataFrame:
    """The state of all that the states hold. A count that a state does not have adds nothing; further keys are gone."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), states)
    held = [c for c in every.columns if c.startswith(("n_", "__")) or c in ("first_start", "last_end")]
    return every.groupBy("song_id").agg(*map(_sum_up, held))


def finished(held: DataFrame, songs: DataFrame | None = None, tempo: DataFrame | None = None) -> DataFrame:
    """A row for each song from its state: counts, ends, key and its score. ``songs`` and ``tempo`` as in ``transcribe.song_summary``."""
    shown = [c for c in held.columns if not c.startswith("__")]
    out = held.select(*shown, *keys.best_keys()).select(*shown, "key", F.concat(M.rounded_text(F.col("score") * 100, 0), F.lit("%")).alias("key_score"))
    if songs is not None:
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in out.columns if c.startswith("n_")}
        out = songs.distinct().join(out, "song_id", "left").withColumns(zero | {"key": F.coalesce("key", F.lit(keys.UNKNOWN)), "key_score": F.coalesce("key_score", F.lit("0%"))})
    return out if tempo is None else out.join(tempo, "song_id", "left")


def add(events: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of events to the stored states; the same batch again replaces what it had added. Made for ``foreachBatch`` as well: ``lambda df, i: add(df, path, i)``."""
    state(events).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={int(batch)}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The states of all batches, merged. ValueError where none is stored."""
    try:
        return merged(spark.read.option("mergeSchema", True).option("basePath", path).parquet(path).drop(BATCH))
    except AnalysisException as e:
        raise ValueError(f"no summaries in {path}") from e


def compacted(spark: SparkSession, path: str, target: str, batch: int = 0) -> None:
    """Writes the states of all batches as one batch of another folder, to which later batches are added."""
    stored(spark, path).write.mode("error").parquet(f"{target.rstrip('/')}/{BATCH}={int(batch)}")
