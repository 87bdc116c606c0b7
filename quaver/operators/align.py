"""Aligning notes with other timelines: second estimates, chords, beats and lyrics.

As-of and nearest joins put the events and the points of all timelines in one sorted
pass by song (a union and windows), so that all of them together cost one exchange and
are linear. So does the interval join with a second estimator, in a pass of its own.
Points and frames whose time is null or NaN are on no timeline and are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import music as M

CENTS = 50.0
PENALTY = 0.85
BEAT_TOLERANCE = 0.08


class Timeline(NamedTuple):
    """Points to align events with. Of points of one time, the last by ``tie`` is the previous and the first by it the next."""

    points: DataFrame
    time: str
    payload: str | None = None
    tie: str | None = None
    #: whether the next point is wanted as well as the previous one
    both: bool = True


def neighbours(events: DataFrame, **timelines: Timeline) -> DataFrame:
    """Events with ``__prev_<name>`` and, if wanted, ``__next_<name>`` for each timeline.

    These are structs (t, v), time and payload, of the last point not after and the first not before an event's start;
    null where there is none. One exchange and two sorts, however many timelines there are.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in events.columns))
    all_ = events.select("song_id", F.col("start_time").alias("__t"), F.lit(0).cast("long").alias("__tie"), row.alias("__e"))
    for name, line in timelines.items():
        tie = F.col(line.tie).cast("long") if line.tie else F.lit(0).cast("long")
        point = F.struct(F.col(line.time).alias("t"), (F.col(line.payload) if line.payload else F.lit(True)).alias("v"))
        points = line.points.where(M.valid_time(F.col(line.time))).select("song_id", F.col(line.time).alias("__t"), tie.alias("__tie"), point.alias(f"__{name}"))
        all_ = all_.unionByName(points, allowMissingColumns=True)
    w = W.partitionBy("song_id")
    event = F.col("__e").isNotNull()  # points before events of the same time
    before = w.orderBy("__t", event, "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = w.orderBy(F.col("__t").desc(), event, F.col("__tie").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = {f"__prev_{name}": F.last(f"__{name}", ignorenulls=True).over(before) for name in timelines}
    found |= {f"__next_{name}": F.last(f"__{name}", ignorenulls=True).over(after) for name, line in timelines.items() if line.both}
    return all_.withColumns(found).where(event).select("__e.*", *found)


def annotate(events: DataFrame, chords: DataFrame | None = None, grid: DataFrame | None = None, lyrics: DataFrame | None = None, tolerance: float = BEAT_TOLERANCE) -> DataFrame:
    """``chord_fit``, ``beat_aligned`` and ``lyric`` of the events, each where its timeline is given, in one pass.

    chord_fit: whether the note is in the nearest chord (of two equally near, the earlier). beat_aligned: whether a point
    of the grid is at most ``tolerance`` from the start. lyric: the line that is sung when the note starts.
    """
    lines, made = {}, {}
    start = F.col("start_time")
    if chords is not None:
        # of chords of one time the first counts
        first = chords.groupBy("song_id", "time").agg(F.min(F.struct("chord_idx", "chord_notes")).alias("c")).select("song_id", "time", "c.chord_idx", "c.chord_notes")
        lines["chord"] = Timeline(first, "time", "chord_notes", "chord_idx")
        before, after = start - F.col("__prev_chord.t"), F.col("__next_chord.t") - start
        chord = F.when(F.coalesce(after < before, F.col("__prev_chord").isNull()), F.col("__next_chord.v")).otherwise(F.col("__prev_chord.v"))
        made["chord_fit"] = F.coalesce(F.array_contains(chord, M.pitch_class_name(F.col("midi"))), F.lit(False))
    if grid is not None:
        lines["beat"] = Timeline(grid, "time")
        off = F.least(F.abs(F.col("__prev_beat.t") - start), F.abs(F.col("__next_beat.t") - start))
        made["beat_aligned"] = F.coalesce(off <= F.lit(tolerance), F.lit(False))
    if lyrics is not None:
        lines["lyric"] = Timeline(lyrics, "ts", "text", "line_no", both=False)
        made["lyric"] = F.col("__prev_lyric.v")
    if not lines:
        return events
    near = neighbours(events.drop(*made), **lines)
    return near.withColumns(made).drop(*(c for c in near.columns if c.startswith(("__prev_", "__next_"))))


def annotate_second_estimate(events: DataFrame, frames: DataFrame | None, cents: float = CENTS) -> DataFrame:
    """``pyin_agrees``: whether a second-estimator frame within the event is at most ``cents`` off.

    An event with frames, none of which agrees, loses confidence; one without frames does not.

    An event has a frame within it where the last frame not after its end is not before its start; and one that agrees where
    this holds for the last frame that is near its pitch. So frames and events' ends need one sorted pass by song, and one by song
    and pitch: one exchange, linear in both, however long an event is. A frame is filed under each whole pitch that it is near,
    one at 50 cents but for ties. An event without start, end or pitch agrees with nothing.
    """
    if frames is None:
        return events
    valid = M.valid_frequency(F.col("frequency")) & M.valid_time(F.col("time"))
    midi = M.hz_to_midi(F.col("frequency"))
    around = F.sequence(F.floor(midi - F.lit(cents / 100)), F.ceil(midi + F.lit(cents / 100)))
    near = F.explode_outer(F.filter(around, lambda m: M.cents_apart(m, midi) <= F.lit(cents))).alias("__m")
    points = frames.where(valid).select("song_id", F.col("time").alias("__t"), near, F.col("time").alias("__frame"))
    kept = [c for c in events.columns if c != "pyin_agrees"]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__e")
    ends = events.select("song_id", F.col("end_time").alias("__t"), F.col("midi").cast("long").alias("__m"), row)
    order = ("__t", F.col("__e").isNotNull())  # frames before events that end then
    last = lambda *keys: F.last("__frame", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    met = ends.unionByName(points, allowMissingColumns=True).withColumns({"__any": last("song_id"), "__near": last("song_id", "__m")})
    inside = lambda c: F.coalesce(F.col(c) >= F.col("__e.start_time"), F.lit(False))
    found = met.where("__e is not null").select("__e.*", inside("__any").alias("__n"), inside("__near").alias("pyin_agrees"))
    confidence = F.when(F.col("__n") & ~F.col("pyin_agrees"), F.col("confidence") * F.lit(PENALTY)).otherwise(F.col("confidence"))
    return found.withColumn("confidence", confidence).select(*(F.col(f"`{c}`") for c in kept), "pyin_agrees")


def annotate_chord_fit(events: DataFrame, chords: DataFrame | None) -> DataFrame:
    """``chord_fit``; without chords no column."""
    return annotate(events, chords=chords)


def beat_subdivisions(beats: DataFrame, subdivisions: int = 4) -> DataFrame:
    """(song_id, time): each beat interval in equal parts, and the last beat."""
    w = W.partitionBy("song_id").orderBy("beat_idx")
    step = F.when(F.col("__end").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(subdivisions - 1)))
    parts = beats.withColumn("__end", F.lead("time").over(w)).withColumn("__i", F.explode(step))
    return parts.select("song_id", F.coalesce(F.col("time") + (F.col("__end") - F.col("time")) * F.col("__i") / F.lit(subdivisions), F.col("time")).alias("time"))


def annotate_beats(events: DataFrame, grid: DataFrame, tolerance: float = BEAT_TOLERANCE) -> DataFrame:
    """``beat_aligned``."""
    return annotate(events, grid=grid, tolerance=tolerance)


def tempo(beats: DataFrame) -> DataFrame:
    """(song_id, bpm): the tempo that came with the beats, or else 60 s by the median beat interval; null below two beats."""
    if "bpm" in beats.columns:
        return beats.groupBy("song_id").agg(F.max("bpm").alias("bpm"))
    step = F.col("time") - F.lag("time").over(W.partitionBy("song_id").orderBy("beat_idx"))
    return beats.withColumn("__step", step).groupBy("song_id").agg((F.lit(60.0) / F.nullif(F.median("__step"), F.lit(0.0))).alias("bpm"))


def chord_timeline(chroma: DataFrame, beats: DataFrame, sample_rate: int = 22050) -> DataFrame:
    """Chords: the three strongest pitch classes between one beat and the next (ties: the higher class)."""
    w = W.partitionBy("song_id").orderBy("beat_idx")
    size = chroma.groupBy("song_id").agg((F.max("frame") + 1).alias("__n"))
    last = F.coalesce(F.col("time") - F.lag("time").over(w), F.lit(0.5))
    spans = beats.withColumn("__end", F.coalesce(F.lead("time").over(w), F.col("time") + last)).join(size, "song_id")
    start = F.greatest(F.lit(0), F.least(M.frame_at(F.col("time"), sample_rate), F.col("__n") - 1))
    spans = spans.withColumn("__a", start).withColumn("__b", F.greatest(F.col("__a") + 1, F.least(M.frame_at(F.col("__end"), sample_rate), F.col("__n"))))
    spans = spans.select("song_id", "beat_idx", "time", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1)).alias("frame"))
    energy = spans.join(chroma, ["song_id", "frame"]).groupBy("song_id", "beat_idx", "time", "pc").agg(F.avg("energy").alias("e"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("e", "pc")), asc=False), 1, 3)
    names = F.array(*map(F.lit, M.PITCH_CLASSES))
    return energy.groupBy("song_id", F.col("beat_idx").alias("chord_idx"), "time").agg(F.transform(top, lambda x: F.element_at(names, x["pc"] + 1)).alias("chord_notes"))


def align_lyrics(events: DataFrame, lyrics: DataFrame | None) -> DataFrame:
    """``lyric``; null before the first line, and for all without lyrics."""
    return without_lyrics(events) if lyrics is None else annotate(events, lyrics=lyrics)


def without_lyrics(events: DataFrame) -> DataFrame:
    return events.drop("lyric").withColumn("lyric", F.lit(None).cast("string"))
