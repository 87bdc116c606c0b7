"""The note chain for songs larger than a task: a two-level scan over slices of a song.

A slice is a range of ``slice_rows`` order numbers, so rows are dealt by (song, slice) and no window or group holds a whole
song. Within a slice, runs are numbered from 0. A slice then gives one row, its first and last run and how many it has; a
window over these few rows tells which first runs go on from the slice before, and where a slice's numbers begin. Pieces
of one run, which may lie in any number of slices, are put together by (song, number).

What a step reads twice, for the slices' rows and for its own, is computed once and kept on the executors' disks until
nothing refers to it (``localCheckpoint``): without that, each step would double the work of all before it.

The results are those of ``segment`` and ``keys``, but for the last bits of confidences, whose sums are taken in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import music as M
from . import keys, segment

SLICE_ROWS = 1 << 18
KEY = ["song_id", "__slice"]


def _slices(df: DataFrame, order: str, slice_rows: int) -> DataFrame:
    if slice_rows < 1:
        raise ValueError(f"a slice has one row at least: {slice_rows}")
    return df.withColumn("__slice", F.floor(F.col(order) / F.lit(slice_rows)))


def _once(df: DataFrame) -> DataFrame:
    return df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)


def _in_slice(order: str) -> W:
    return W.partitionBy(*KEY).orderBy(order)


def _runs(df: DataFrame, new: Column, order: str) -> DataFrame:
    """``__run``: how many rows of the slice up to this one begin a run; the first row's run is 0, whatever stands before the slice."""
    begins = F.coalesce(new, F.lit(False)).cast("long")
    return df.withColumn("__new", begins).withColumn("__run", F.sum("__new").over(_in_slice(order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def _numbered(pieces: DataFrame, goes_on: Callable[[Column, Column], Column]) -> DataFrame:
    """``event_idx`` of each piece: slices in order, and the first run of a slice with the last of the one before where it goes on."""
    pieces = _once(pieces)
    ends = F.struct("midi", "start_time", "end_time")
    slices = pieces.groupBy(*KEY).agg(F.min_by(ends, "__run").alias("first"), F.max_by(ends, "__run").alias("last"), F.count(F.lit(1)).alias("n"))
    along = W.partitionBy("song_id").orderBy("__slice")
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    on = F.coalesce(goes_on(F.lag("last").over(along), F.col("first")), F.lit(False)).cast("long")
    slices = slices.withColumn("on", on).select(*KEY, (F.sum(F.col("n") - F.col("on")).over(so_far) - F.col("n")).alias("__at"))
    return pieces.join(slices, KEY).withColumn("event_idx", F.col("__at") + F.col("__run"))


def segment_notes(frames: DataFrame, max_gap: float = 0.1, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``segment.segment_notes`` in slices of ``seq``."""
    rows = _slices(segment.valid_frames(frames.where(M.valid_time(F.col("time")))), "seq", slice_rows)
    w = _in_slice("seq")
    apart = lambda before, now: now - before > F.lit(max_gap)
    rows = _runs(rows, (F.col("midi") != F.lag("midi").over(w)) | apart(F.lag("time").over(w), F.col("time")), "seq")
    ends = F.min_by("time", "seq").alias("start_time"), F.max_by("time", "seq").alias("end_time")
    sums = F.sum("confidence").alias("__sum"), F.count("confidence").alias("__n")
    pieces = rows.groupBy(*KEY, "__run").agg(F.min("midi").alias("midi"), *ends, *sums)
    pieces = _numbered(pieces, lambda last, first: (last["midi"] == first["midi"]) & ~apart(last["end_time"], first["start_time"]))
    ends = F.min_by("start_time", "__slice").alias("start_time"), F.max_by("end_time", "__slice").alias("end_time")
    confidence = (F.sum("__sum") / F.nullif(F.sum("__n"), F.lit(0))).alias("confidence")
    return segment.with_note(pieces.groupBy("song_id", "event_idx").agg(F.min("midi").alias("midi"), *ends, confidence))


def filter_by_key(events: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``keys.filter_by_key``: each song's key from sums, joined back by slice, so that the events of a song stay in many tasks."""
    rows = _once(_slices(events, "event_idx", slice_rows))
    found = rows.select(*KEY).distinct().join(keys.detect_key(rows), "song_id")
    # song and slice in place of the song
    of_slice = lambda df: df.withColumn("song_id", F.struct(*KEY))
    kept = keys.filter_by_key(of_slice(rows), of_slice(found))
    return kept.withColumn("song_id", F.col("song_id.song_id")).select(*events.columns)


def remove_octave_outliers(events: DataFrame, max_duration: float = 0.15, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``segment.remove_octave_outliers`` in slices: the neighbours of a slice's first and last event come from the slices beside it."""
    rows = _once(_slices(events, "event_idx", slice_rows))
    ends = rows.groupBy(*KEY).agg(F.min_by("midi", "event_idx").alias("first"), F.max_by("midi", "event_idx").alias("last"))
    along, w = W.partitionBy("song_id").orderBy("__slice"), _in_slice("event_idx")
    beside = ends.select(*KEY, F.lag("last").over(along).alias("__before"), F.lead("first").over(along).alias("__after"))
    rows = rows.withColumn("__lag", F.lag("midi").over(w)).withColumn("__lead", F.lead("midi").over(w)).join(beside, KEY)
    far = [F.abs(F.col("midi") - F.coalesce(own, other)) > 12 for own, other in (("__lag", "__before"), ("__lead", "__after"))]
    out = (F.col("end_time") - F.col("start_time") < F.lit(max_duration)) & far[0] & far[1]
    return rows.where(~F.coalesce(out, F.lit(False))).select(*events.columns)


def merge_flickers(events: DataFrame, max_gap: float = 0.08, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``segment.merge_flickers`` in slices. A piece of n events takes the confidence before it, c, to c / 2^n + b, with b from its own alone."""
    w = _in_slice("event_idx")

    def joined(midi: Column, end: Column, next_midi: Column, start: Column) -> Column:
        return (midi == next_midi) & (start - end >= 0) & (start - end <= F.lit(max_gap))

    own = joined(F.lag("midi").over(w), F.lag("end_time").over(w), F.col("midi"), F.col("start_time"))
    rows = _slices(events, "event_idx", slice_rows)
    rows = _runs(rows, F.lag("event_idx").over(w).isNotNull() & ~F.coalesce(own, F.lit(False)), "event_idx")
    in_order = F.sort_array(F.collect_list(F.struct("event_idx", "confidence")))["confidence"].alias("__c")
    ends = F.min_by("start_time", "event_idx").alias("start_time"), F.max_by("end_time", "event_idx").alias("end_time")
    pieces = rows.groupBy(*KEY, "__run").agg(F.min("midi").alias("midi"), *ends, in_order)
    halved = lambda c, first: F.aggregate(c, first, lambda a, x: (a + x) / 2)
    alone = halved(F.slice("__c", F.lit(2), F.size("__c")), F.get("__c", F.lit(0)))
    pieces = pieces.select(*KEY, "__run", "midi", "start_time", "end_time", alone.alias("__alone"), halved(F.col("__c"), F.lit(0.0)).alias("__b"), F.size("__c").alias("__n"))
    pieces = _numbered(pieces, lambda last, first: joined(last["midi"], last["end_time"], first["midi"], first["start_time"]))
    ends = F.min_by("start_time", "__slice").alias("start_time"), F.max_by("end_time", "__slice").alias("end_time")
    parts = F.sort_array(F.collect_list(F.struct("__slice", "__alone", "__b", "__n"))).alias("__p")
    merged = pieces.groupBy("song_id", "event_idx").agg(F.min("midi").alias("midi"), *ends, parts)
    later = F.slice("__p", F.lit(2), F.size("__p"))
    folded = F.aggregate(later, F.get("__p", F.lit(0))["__alone"], lambda c, p: c / F.pow(F.lit(2.0), p["__n"]) + p["__b"])
    return segment.with_note(merged.withColumn("confidence", folded).drop("__p"))


def map_notes(frames: DataFrame, *, confidence_threshold: float = 0.85, transpose: int = 0, apply_key_filter: bool = True, smooth: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The chain of ``plans.transcribe.map_notes``, without second estimates and chords, for songs of any length."""
    events = segment_notes(segment.filter_by_confidence(frames, confidence_threshold), slice_rows=slice_rows)
    if apply_key_filter:
        events = filter_by_key(events, slice_rows)
    if smooth:
        events = merge_flickers(remove_octave_outliers(events, slice_rows=slice_rows), slice_rows=slice_rows)
    return segment.transpose(events, transpose)
