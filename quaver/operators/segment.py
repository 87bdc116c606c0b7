"""From pitch frames to notes: filter, segmentation, outlier removal, merging, transposition.

Every step is windows and one aggregation on ``song_id``, so the chain needs one
exchange and one sort. A song is minutes long and fits a task; songs are the
unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import music as M


def in_song(order: str) -> W:
    return W.partitionBy("song_id").orderBy(order)


def _so_far(order: str) -> W:
    return in_song(order).rowsBetween(W.unboundedPreceding, W.currentRow)


def check_threshold(threshold: float) -> float:
    if not 0 <= threshold <= 1:
        raise ValueError(f"confidence threshold must lie between 0 and 1: {threshold}")
    return threshold


def filter_by_confidence(frames: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Frames of at least this confidence; NaN is no confidence."""
    return frames.where(confident(threshold))


def confident(threshold: float) -> Column:
    return (F.col("confidence") >= F.lit(check_threshold(threshold))) & ~F.isnan("confidence")


def valid_frames(frames: DataFrame) -> DataFrame:
    """Frames with a positive, finite frequency, and their MIDI number. (A frame without a time is in no event, see ``segment_notes``.)"""
    return frames.where(M.valid_frequency(F.col("frequency"))).withColumn("midi", M.nearest_midi(F.col("frequency")))


def voiced_frames(frames: DataFrame) -> DataFrame:
    """Second-estimator frames that are voiced and have a frequency."""
    return frames.where(F.col("voiced") & F.col("frequency").isNotNull() & ~F.isnan("frequency")).drop("voiced")


def segment_notes(frames: DataFrame, max_gap: float = 0.1) -> DataFrame:
    """Events: runs of frames of one note, broken where two frames stand more than ``max_gap`` apart. Frames without a finite time are left out."""
    w = in_song("seq")
    gap = F.col("time") - F.lag("time").over(w) > F.lit(max_gap)
    new = F.coalesce((F.col("midi") != F.lag("midi").over(w)) | gap, F.lit(True))
    runs = valid_frames(frames.where(M.valid_time(F.col("time")))).withColumn("__new", new.cast("long")).withColumn("event_idx", F.sum("__new").over(_so_far("seq")) - 1)
    ends = F.min_by("time", "seq").alias("start_time"), F.max_by("time", "seq").alias("end_time")
    events = runs.groupBy("song_id", "event_idx").agg(F.min("midi").alias("midi"), *ends, F.avg("confidence").alias("confidence"))
    return with_note(events)


def with_note(events: DataFrame) -> DataFrame:
    first = ["song_id", "event_idx", "midi"]
    return events.select(*first, M.note_name(F.col("midi")).alias("note"), *(c for c in events.columns if c not in (*first, "note")))


def remove_octave_outliers(events: DataFrame, max_duration: float = 0.15) -> DataFrame:
    """Drop short events more than an octave away from both neighbours; the first and the last stay."""
    w = in_song("event_idx")
    far = (F.abs(F.col("midi") - F.lag("midi").over(w)) > 12) & (F.abs(F.col("midi") - F.lead("midi").over(w)) > 12)
    out = (F.col("end_time") - F.col("start_time") < F.lit(max_duration)) & far
    return events.withColumn("__out", F.coalesce(out, F.lit(False))).where("not __out").drop("__out")


def flicker_runs(events: DataFrame, max_gap: float = 0.08) -> DataFrame:
    """Events with ``__new``: 1 where one begins a run of events of one note at most ``max_gap`` apart, else 0."""
    w = in_song("event_idx")
    gap = F.col("start_time") - F.lag("end_time").over(w)
    joined = (F.col("midi") == F.lag("midi").over(w)) & (gap >= 0) & (gap <= F.lit(max_gap))
    return events.withColumn("__new", (~F.coalesce(joined, F.lit(False))).cast("long"))


def merge_flickers(events: DataFrame, max_gap: float = 0.08) -> DataFrame:
    """Join consecutive events of one note at most ``max_gap`` apart; confidence is halved step by step towards the later one."""
    runs = flicker_runs(events, max_gap).withColumn("__run", F.sum("__new").over(_so_far("event_idx")) - 1)
    in_order = F.sort_array(F.collect_list(F.struct("event_idx", "confidence")))["confidence"]
    ends = F.min_by("start_time", "event_idx").alias("start_time"), F.max_by("end_time", "event_idx").alias("end_time")
    merged = runs.groupBy("song_id", F.col("__run").alias("event_idx")).agg(F.min("midi").alias("midi"), *ends, in_order.alias("__c"))
    folded = F.aggregate(F.slice("__c", F.lit(2), F.size("__c")), F.get("__c", F.lit(0)), lambda a, c: (a + c) / 2)
    return with_note(merged.withColumn("confidence", folded).drop("__c"))


def transpose(events: DataFrame, semitones: int) -> DataFrame:
    """Shift all notes; 0 changes nothing."""
    return with_note(events.withColumn("midi", F.col("midi") + F.lit(semitones))) if semitones else events
