"""The composite plans: frames to annotated notes, and the summary of a song."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import align, keys, segment
from . import summaries


def map_notes(
    frames: DataFrame,
    *,
    confidence_threshold: float = 0.85,
    transpose: int = 0,
    apply_key_filter: bool = True,
    smooth: bool = True,
    second_frames: DataFrame | None = None,
    chords: DataFrame | None = None,
) -> DataFrame:
    """Filter, segment, keep to the key, smooth, annotate, transpose: in this order, as the results depend on it.

    The key filter works on concert pitch, before transposition.
    """
    events = frames.transform(segment.filter_by_confidence, confidence_threshold).transform(segment.segment_notes)
    if apply_key_filter:
        events = keys.filter_by_key(events)
    if smooth:
        events = events.transform(segment.remove_octave_outliers).transform(segment.merge_flickers)
    events = align.annotate_second_estimate(events, second_frames)
    events = align.annotate_chord_fit(events, chords)
    return segment.transpose(events, transpose)


def transcribe(
    frames: DataFrame,
    *,
    chords: DataFrame | None = None,
    grid: DataFrame | None = None,
    lyrics: DataFrame | None = None,
    transpose: int = 0,
    **how,
) -> DataFrame:
    """``map_notes``, beats and lyrics. Chords, beats and lyrics are aligned in one pass, before transposition, which chords precede."""
    events = align.annotate(map_notes(frames, **how), chords, grid, lyrics)
    if lyrics is None:
        events = align.without_lyrics(events)
    return segment.transpose(events, transpose)


def song_summary(events: DataFrame, songs: DataFrame | None = None, tempo: DataFrame | None = None) -> DataFrame:
    """A row for each song: counts, the key of the events as they are, and time and confidence ranges.

    ``songs``: songs without events get a row as well, with counts of 0 and key Unknown; further columns of it (a song's
    name, say) stay. ``tempo``: (song_id, bpm).
    """
    return summaries.finished(summaries.state(events), songs, tempo)


def frame_ranges(frames: DataFrame) -> DataFrame:
    """A row for each song: how many frames, and the ranges of their values."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("time", "frequency", "confidence") for n, f in (("min", F.min), ("max", F.max))]
    return frames.groupBy("song_id").agg(F.count(F.lit(1)).alias("n_frames"), *ends)


STAGES = ("frames", "confident", "segments", "in key", "no outliers", "merged")


def stage_counts(frames: DataFrame, confidence_threshold: float = 0.85) -> DataFrame:
    """(song_id, stage, n): how many rows each step leaves; the differences are what it removed or merged.

    The chain runs once: each step writes its count beside the events that it leaves, by a window on the song, and no step
    leaves none of some. Frames are counted by an aggregation of their own, as a song may have no events.
    """
    song = W.partitionBy("song_id")
    counted = lambda events, stage: events.withColumn(f"__{stage}", F.count(F.lit(1)).over(song))
    events = counted(frames.transform(segment.filter_by_confidence, confidence_threshold).transform(segment.segment_notes), "segments")
    events = counted(keys.filter_by_key(events), "in key")
    events = counted(segment.remove_octave_outliers(events), "no outliers")
    kept = [F.max(f"__{stage}").alias(stage) for stage in STAGES[2:5]]
    notes = segment.flicker_runs(events).groupBy("song_id").agg(*kept, F.sum("__new").alias("merged"))
    given = frames.groupBy("song_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(segment.confident(confidence_threshold)).alias("confident"))
    # a union and not a join: null is a song of its own
    long = [df.unpivot("song_id", [F.col(f"`{s}`") for s in of], "stage", "n") for df, of in ((given, STAGES[:2]), (notes, STAGES[2:]))]
    return long[0].union(long[1]).where("n > 0")


def preview(events: DataFrame, n: int = 5) -> DataFrame:
    """The first events of each song."""
    w = W.partitionBy("song_id").orderBy("event_idx")
    return events.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def display(events: DataFrame) -> DataFrame:
    """Events for a screen: times and confidence to three places, halves to even."""
    return events.withColumns({c: F.bround(c, 3) for c in ("start_time", "end_time", "confidence")})
