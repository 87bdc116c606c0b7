import math
import random
import re

import model
import pytest
from pyspark.sql import functions as F

from quaver import schemas
from quaver.functions import music as M
from quaver.operators import align, keys, leadsheet, segment, sliced
from quaver.plans import transcribe as T

G1 = [(0.00, 261.63, 0.90), (0.05, 262.0, 0.88), (0.10, 260.5, 0.92), (0.15, 261.0, 0.70), (0.20, 329.63, 0.95), (0.25, 330.0, 0.93), (0.30, 392.0, 0.96), (0.45, 262.0, 0.91), (0.50, 261.5, 0.89)]


def frames(spark, *songs):
    rows = [(s, i, t, f, c) for s, song in enumerate(songs) for i, (t, f, c) in enumerate(song)]
    return spark.createDataFrame([(s, i, float(t), float(f), float(c)) for s, i, t, f, c in rows], schemas.FRAMES)


def events(spark, *songs):
    """songs of (midi, start, end, confidence)"""
    rows = [(s, i, m, None, float(a), float(b), float(c)) for s, song in enumerate(songs) for i, (m, a, b, c) in enumerate(song)]
    return segment.with_note(spark.createDataFrame(rows, schemas.EVENTS))


def got(df, *cols):
    return [tuple(r) for r in df.orderBy("song_id", "event_idx").select(*cols).collect()]


def test_segmentation(spark):
    out = got(segment.segment_notes(segment.filter_by_confidence(frames(spark, G1))), "note", "start_time", "end_time", F.round("confidence", 3))
    assert out == [("C4", 0.0, 0.1, 0.9), ("E4", 0.2, 0.25, 0.94), ("G4", 0.3, 0.3, 0.96), ("C4", 0.45, 0.5, 0.9)]
    assert len(got(T.map_notes(frames(spark, G1)), "note")) == 4
    assert len(got(T.map_notes(frames(spark, G1), confidence_threshold=0.7), "note")) == 4


def test_segmentation_edges(spark):
    nan = math.nan
    songs = [[(0, 440, 0.9)], [(0, -1, 0.9), (0.05, 0, 0.9), (0.1, 440, 0.9)], [(0, 440, 0.5)], [(t, 262, 0.9) for t in (0, 0.05, 0.2, 0.25)], [(0, 440, nan), (0.05, nan, 0.9), (0.1, math.inf, 0.9)], [(0.3, 262, 0.9), (0.4, 262, 0.9)]]
    out = segment.segment_notes(segment.filter_by_confidence(frames(spark, *songs)))
    assert {r.song_id: r["count"] for r in out.groupBy("song_id").count().collect()} == {0: 1, 1: 1, 3: 2, 5: 2}  # 0.4 - 0.3 exceeds 0.1 in doubles
    assert segment.filter_by_confidence(frames(spark, [(0, 440, 0.0), (0, 440, 1.0)]), 0.0).count() == 2
    assert segment.filter_by_confidence(frames(spark, [(0, 440, 0.99), (0, 440, 1.0)]), 1.0).count() == 1
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            segment.filter_by_confidence(frames(spark, G1), bad)


def test_pitch_functions(spark):
    df = spark.createDataFrame([(60.5,), (61.5,), (60.0,)], "m double").select(F.rint("m").cast("int").alias("r"))
    assert [r.r for r in df.collect()] == [60, 62, 60]
    names = spark.createDataFrame([(69,), (0,), (11,), (12,), (70,)], "m int").select(M.note_name(F.col("m")).alias("n"), M.pitch_class(F.col("m")).alias("p"), M.pitch_class_name(F.col("m")).alias("c"))
    assert [tuple(r) for r in names.collect()] == [("A4", 9, "A"), ("C-1", -1, "C-"), ("B-1", -1, "B-"), ("C0", 0, "C"), ("A#4", 10, "A#")]
    back = spark.createDataFrame([("A4",), ("Bb3",), ("C-1",), ("x",), (None,)], "n string").select(M.note_to_midi(F.col("n")).alias("m"))
    assert [r.m for r in back.collect()] == [69, 58, 0, None, None]
    text = spark.createDataFrame([(0.9275,), (0.5,), (1234.5,)], "x double").select(M.three(F.col("x")).alias("t"))
    assert [r.t for r in text.collect()] == [f"{x:.3f}" for x in (0.9275, 0.5, 1234.5)]


def test_octave_outliers(spark):
    fs3, fs7, a3, a4, b3, c8 = 54, 102, 57, 69, 59, 108
    songs = [[(fs3, 0, 0.3, 1), (fs7, 0.3, 0.4, 1), (fs3, 0.4, 0.7, 1)], [(a3, 0, 0.3, 1), (c8, 0.3, 0.38, 1), (b3, 0.38, 0.6, 1)], [(fs3, 0, 0.3, 1), (fs7, 0.3, 0.5, 1), (fs3, 0.5, 0.8, 1)], [(a3, 0, 0.3, 1), (a4, 0.3, 0.38, 1), (a3, 0.38, 0.6, 1)], [(c8, 0, 0.05, 1), (a3, 0.05, 0.3, 1), (c8, 0.3, 0.35, 1)], [(a3, 0, 0.1, 1), (b3, 0.1, 0.2, 1)]]
    out = segment.remove_octave_outliers(events(spark, *songs))
    assert {r.song_id: r["count"] for r in out.groupBy("song_id").count().collect()} == {0: 2, 1: 2, 2: 3, 3: 3, 4: 3, 5: 2}


def test_merge(spark):
    songs = [[(69, 0, 0.2, 0.9), (69, 0.24, 0.5, 0.88)], [(67, 0, 0.1, 0.9), (67, 0.14, 0.25, 0.8), (67, 0.29, 0.4, 0.7)], [(69, 0, 0.2, 0.9), (69, 0.5, 0.8, 0.9)], [(69, 0, 0.2, 0.9), (71, 0.22, 0.4, 0.9)], [(69, 0, 0.2, 0.9), (57, 0.22, 0.4, 0.9)]]
    out = got(segment.merge_flickers(events(spark, *songs)), "song_id", "start_time", "end_time", F.round("confidence", 6))
    assert out[:2] == [(0, 0.0, 0.5, 0.89), (1, 0.0, 0.4, 0.775)] and len(out) == 8


def test_merge_after_outlier(spark):
    song = [(69, 0, 0.2, 0.9), (108, 0.21, 0.25, 0.9), (69, 0.26, 0.5, 0.9)]
    assert len(got(segment.merge_flickers(segment.remove_octave_outliers(events(spark, song))), "note")) == 1


def test_keys(spark):
    minor, chromatic = [(m, 0, 0, 1) for m in (57, 59, 60, 62, 64, 65, 67)], [(60 + i, 0, 0, 1) for i in range(12)]
    df = events(spark, minor, chromatic)
    found = {r.song_id: r for r in keys.detect_key(df, spark.createDataFrame([(0,), (1,), (2,)], "song_id bigint")).collect()}
    assert found[0].key == "C major" and [c.key for c in found[0].candidates] == ["C major", "A minor", "G major"]
    assert round(found[0].candidates[2].score, 6) == round(6 / 7, 6)
    assert found[1].key == "C major" and found[1].score == 7 / 12
    assert (found[2].key, found[2].score, found[2].candidates) == ("Unknown", 0.0, [])
    assert keys.filter_by_key(df).count() == 19  # the chromatic song is too weak a key to filter


def test_given_keys(spark):
    df = events(spark, [(60, 0, 0, 1), (61, 0, 0, 1), (67, 0, 0, 1), (70, 0, 0, 1)])
    given = lambda k, s: spark.createDataFrame([(0, k, s)], "song_id bigint, key string, score double")
    assert got(keys.filter_by_key(df, given("C major", 0.9)), "note") == [("C4",), ("G4",)]
    for k, s in (("C major", 0.55), ("Unknown", 0.9), ("H major", 0.9)):
        assert keys.filter_by_key(df, given(k, s)).count() == 4


def test_scale_table():
    scales = dict(M.scales())
    assert len(scales) == 24 and list(scales)[:3] == ["C major", "G major", "D major"]
    assert [M.PITCH_CLASSES[p] for p in scales["Bb major"]] == ["A#", "C", "D", "D#", "F", "G", "A"]
    assert [M.PITCH_CLASSES[p] for p in scales["Eb minor"]] == ["D#", "F", "F#", "G#", "A#", "B", "C#"]


def test_transpose(spark):
    df = events(spark, [(60, 0, 0, 1)])
    assert got(segment.transpose(df, 9), "note", "midi") == [("A4", 69)]
    assert segment.transpose(df, 0) is df


def test_second_estimate(spark):
    df = events(spark, [(69, 0, 1, 0.9)], [(69, 0, 1, 0.9)], [(69, 0, 1, 0.9)], [(69, 0, 1, 0.9)], [(69, 0.5, 0.5, 0.9)])
    second = spark.createDataFrame([(0, 0, 0.5, 440.0, 1.0), (1, 0, 0.5, 466.16, 1.0), (2, 0, 2.0, 440.0, 1.0), (3, 0, 1.0, 440.0, 1.0)], schemas.FRAMES)
    assert got(align.annotate_second_estimate(df, second), "pyin_agrees", F.round("confidence", 6)) == [(True, 0.9), (False, 0.765), (False, 0.9), (True, 0.9), (False, 0.9)]
    assert got(align.annotate_second_estimate(df, second.limit(0)), "pyin_agrees") == [(False,)] * 5
    assert "pyin_agrees" not in align.annotate_second_estimate(df, None).columns


@pytest.mark.parametrize("cents", [50.0, 130.0, -1.0])
def test_second_estimate_by_brute_force(spark, cents):
    """Random events, overlapping, short and long, against every frame within each; one exchange and no rows for the seconds of an event."""
    rng = random.Random(21)
    hz = lambda m: 440.0 * 2 ** ((m - 69) / 12)
    songs = [[(rng.randint(60, 63), a := rng.uniform(0, 30), a + rng.choice((0.0, 0.1, 1.0, 9.0, -0.5)), 0.8) for _ in range(25)] for _ in range(3)]
    second = [(s, i, rng.choice((songs[s][i % 25][1], songs[s][i % 25][2], rng.uniform(0, 30))), hz(rng.uniform(59, 64)), 1.0) for s in (0, 1) for i in range(40)]
    second += [(0, 90, 5.0, hz(61.5), 1.0), (0, 91, math.nan, 440.0, 1.0), (1, 92, 5.0, 0.0, 1.0), (1, 93, None, 440.0, 1.0)]
    df = events(spark, *songs).withColumn("extra", F.lit("x"))
    out = align.annotate_second_estimate(df, spark.createDataFrame(second, schemas.FRAMES), cents)
    expected = []
    for s, song in enumerate(songs):
        for m, a, b, c in song:
            within = [f for q, _, t, f, _ in second if q == s and t is not None and a <= t <= b and f > 0]
            agrees = any(abs(m - (12 * (math.log2(f) - math.log2(440.0)) + 69)) * 100 <= cents for f in within)
            expected.append((agrees, round(c * 0.85 if within and not agrees else c, 9)))
    assert got(out, "pyin_agrees", F.round("confidence", 9)) == expected
    assert out.columns == [*df.columns, "pyin_agrees"] and {x for x, _ in expected} == ({True, False} if cents > 0 else {False})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    hour = events(spark, [(69, 0.0, 3.6e9, 0.8)])
    assert got(align.annotate_second_estimate(hour, frames(spark, [(3.5e9, 440, 1)])), "pyin_agrees") == [(True,)]
    again = align.annotate_second_estimate(out, spark.createDataFrame(second, schemas.FRAMES), cents)
    assert again.columns == out.columns


def test_chords(spark):
    chroma = spark.createDataFrame([(0, f, p, 1.0 if p in (0, 4, 7) else 0.05) for f in range(20) for p in range(12)], schemas.CHROMA)
    beats = spark.createDataFrame([(0, i, t, 120.0) for i, t in enumerate((0.0, 0.5, 1.0, 1.5))], schemas.BEATS)
    out = align.chord_timeline(chroma, beats).orderBy("chord_idx").collect()
    assert len(out) == 4 and {n for r in out for n in r.chord_notes} == {"C", "E", "G"}
    assert align.chord_timeline(chroma, beats.limit(0)).count() == 0
    assert align.chord_timeline(chroma, beats.limit(1)).count() == 1
    chords = spark.createDataFrame([(s, i, t, list(n)) for s in range(5) for i, (t, n) in enumerate(((0.5, ["C", "E", "G"]), (1.0, ["D", "F#", "A"])))], schemas.CHORDS)
    df = events(spark, [(60, 0.6, 1, 1)], [(60, 0.8, 1, 1)], [(60, 0.75, 1, 1)], [(60, 0.1, 1, 1)], [(62, 3, 4, 1)], [(60, 0, 1, 1)])
    assert got(align.annotate_chord_fit(df, chords), "chord_fit") == [(True,), (False,), (True,), (True,), (True,), (False,)]
    assert "chord_fit" not in align.annotate_chord_fit(df, None).columns


def test_beats(spark):
    beats = spark.createDataFrame([(0, 0, 0.0, 119.7), (0, 1, 0.5, 119.7), (0, 2, 1.0, 119.7), (0, 3, 1.5, 119.7), (1, 0, 0.5, None)], schemas.BEATS)
    assert {r.song_id: r.bpm for r in align.tempo(beats).collect()} == {0: 119.7, 1: None}
    assert {r.song_id: r.bpm for r in align.tempo(beats.drop("bpm")).collect()} == {0: 120.0, 1: None}
    subs = align.beat_subdivisions(beats)
    assert {r.song_id: r["count"] for r in subs.groupBy("song_id").count().collect()} == {0: 13, 1: 1}
    grid = spark.createDataFrame([(0, i * 0.125) for i in range(17)], schemas.SUBDIVISIONS)
    df = events(spark, [(60, 0.0, 1, 1), (60, 0.06, 1, 1), (60, 0.3, 1, 1)], [(60, 0, 1, 1)])
    assert got(align.annotate_beats(df, grid), "beat_aligned") == [(True,), (True,), (True,), (False,)]
    assert got(align.annotate_beats(df, grid, 0.04), "beat_aligned") == [(True,), (False,), (False,), (False,)]
    assert got(align.annotate_beats(df, grid.limit(0)), "beat_aligned") == [(False,)] * 4


def test_leadsheet(spark):
    df = events(spark, [(60, 0, 0.5, 0.9), (64, 1, 1.5, 0.95), (67, 2.5, 3, 0.92)])
    words = df.withColumn("lyric", F.when(F.col("midi") == 60, "Hello").when(F.col("midi") == 64, "world"))
    assert leadsheet.sheets(words).first().text == "Hello\nC4\n\nworld\nE4\n\nG4"
    assert leadsheet.sheets(df).first().text == "C4 -- E4 -- G4"
    gaps = events(spark, [(60, 0, 0, 1), (60, 0.2, 0, 1), (60, 0.7, 0, 1), (60, 2.7, 0, 1), (60, 4.8, 0, 1)])
    assert leadsheet.sheets(gaps).first().text == "C4 C4 - C4 --- C4\nC4"


def test_random_songs(spark):
    rng, songs = random.Random(7), []
    for _ in range(12):
        t, song, m = 0.0, [], 60
        for _ in range(rng.randint(0, 120)):
            t += rng.choice((0.02, 0.04, 0.05, 0.11, 0.3))
            m = rng.choice((m, m, m, m + 14, m - 14, rng.randint(55, 75)))
            song.append((t, 440 * 2 ** ((m - 69 + rng.uniform(-0.3, 0.3)) / 12), rng.choice((0.8, 0.85, 0.9, 1.0))))
        songs.append(song)
    out: dict[int, list] = {}
    for r in T.map_notes(frames(spark, *songs)).orderBy("song_id", "event_idx").collect():
        out.setdefault(r.song_id, []).append((r.midi, r.start_time, r.end_time, round(r.confidence, 9)))
    for i, song in enumerate(songs):
        want = model.merged(model.no_outliers(model.in_key(model.segments(song), M.scales())))
        assert out.get(i, []) == [(m, a, b, round(c, 9)) for m, a, b, c in want]


def random_songs(seed, n=8):
    rng, songs = random.Random(seed), []
    for _ in range(n):
        t, song, m = 0.0, [], 60
        for _ in range(rng.randint(0, 150)):
            t += rng.choice((0.02, 0.04, 0.04, 0.09, 0.11, 0.3))
            m = rng.choice((m, m, m, m, m + 14, m - 14, 60, rng.randint(55, 75)))
            song.append((t, 440 * 2 ** ((m - 69 + rng.uniform(-0.3, 0.3)) / 12), rng.choice((0.8, 0.85, 0.9, 1.0))))
        songs.append(song)
    return [*songs, [(i * 0.04, 440, 0.9) for i in range(60)], [(0.0, 440, 0.9)]]  # one run over many slices, one frame


@pytest.mark.parametrize("slice_rows", [1, 7, sliced.SLICE_ROWS])
def test_sliced_songs(spark, slice_rows):
    """Wherever songs are cut, the results are those of whole songs."""
    cols = ("song_id", "event_idx", "midi", "note", "start_time", "end_time", F.round("confidence", 12))
    rng = random.Random(slice_rows)
    df = frames(spark, *random_songs(slice_rows)).withColumn("seq", F.col("seq") * 3 - 50)  # numbers need not be dense or positive
    sure = segment.filter_by_confidence(df)
    assert got(sliced.segment_notes(sure, slice_rows=slice_rows), *cols) == got(segment.segment_notes(sure), *cols)
    flicker = [[(rng.choice((60, 60, 62, 80)), i * 0.1, i * 0.1 + rng.choice((0.02, 0.05, 0.1, 0.12)), rng.random()) for i in range(rng.randint(1, 90))] for _ in range(6)]
    notes = events(spark, *flicker, [(60, i * 0.1, i * 0.1 + 0.05, rng.random()) for i in range(50)])
    assert got(sliced.merge_flickers(notes, slice_rows=slice_rows), *cols) == got(segment.merge_flickers(notes), *cols)
    assert got(sliced.remove_octave_outliers(notes, slice_rows=slice_rows), *cols) == got(segment.remove_octave_outliers(notes), *cols)
    assert got(sliced.filter_by_key(notes, slice_rows), *cols) == got(keys.filter_by_key(notes), *cols)
    if slice_rows == 7:
        assert got(sliced.map_notes(df, slice_rows=slice_rows), *cols) == got(T.map_notes(df), *cols)


def test_no_task_holds_a_song(spark):
    """Windows on the song alone run over slices, and nothing else is dealt by the song alone but its key."""
    df = segment.filter_by_confidence(frames(spark, G1))
    given = events(spark, [(60, 0, 0.1, 0.9)])
    for made in (sliced.segment_notes(df), sliced.merge_flickers(given), sliced.remove_octave_outliers(given)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        specs = set(re.findall(r"windowspecdefinition\(song_id#\d+L?, (\w+)#\d+L?( ASC)?", plan))
        assert specs and all(name == "__slice" for name, _ in specs)  # ordered by slice, or dealt by song and slice
    with pytest.raises(ValueError):
        sliced.segment_notes(df, slice_rows=0)
    assert sliced.map_notes(frames(spark, G1).limit(0)).count() == 0


def test_stage_counts(spark):
    """Counts of each step on its own, for songs with and without events; the chain is planned once."""
    df = frames(spark, *random_songs(5), [(0.0, 440, 0.1)], [(0.0, -1, 0.9)])
    steps = [df, segment.filter_by_confidence(df)]
    steps.append(segment.segment_notes(steps[-1]))
    steps.append(keys.filter_by_key(steps[-1]))
    steps.append(segment.remove_octave_outliers(steps[-1]))
    steps.append(segment.merge_flickers(steps[-1]))
    want = {(r.song_id, stage): r["count"] for stage, step in zip(T.STAGES, steps, strict=True) for r in step.groupBy("song_id").count().collect()}
    made = T.stage_counts(df)
    assert {(r.song_id, r.stage): r.n for r in made.collect()} == want and made.columns == ["song_id", "stage", "n"]
    plan = T.stage_counts(df)._jdf.queryExecution().executedPlan().toString()  # not run yet: one plan
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Scan") == 2


def test_one_exchange(spark):
    plan = T.map_notes(frames(spark, G1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_one_pass_alignment(spark):
    """All timelines at once give what each gives alone, in one exchange of the union."""
    rng = random.Random(8)
    df = events(spark, *[[(rng.randint(55, 75), t, t + 0.1, 0.9) for t in sorted(rng.uniform(0, 20) for _ in range(30))] for _ in range(3)])
    chords = spark.createDataFrame([(s, i, rng.choice((0.5, 1.0)) * i, rng.sample(list(M.PITCH_CLASSES), 3)) for s in range(2) for i in range(12)], schemas.CHORDS)
    grid = spark.createDataFrame([(s, i * 0.25) for s in range(3) for i in range(70)] + [(0, math.nan), (1, None)], schemas.SUBDIVISIONS)
    lyrics = spark.createDataFrame([(s, i, rng.choice((1.0, 2.0)) * i, f"l{i}") for s in range(1, 3) for i in range(9)] + [(1, 99, math.nan, "no")], schemas.LYRICS)
    cols = ("song_id", "event_idx", "chord_fit", "beat_aligned", "lyric")
    alone = align.align_lyrics(align.annotate_beats(align.annotate_chord_fit(df, chords), grid), lyrics)
    together = align.annotate(df, chords, grid, lyrics)
    assert got(together, *cols) == got(alone, *cols) and together.columns == alone.columns
    assert any(r[2] for r in got(together, *cols)) and any(r[3] for r in got(together, *cols)) and any(r[4] for r in got(together, *cols))
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2


def test_times_that_are_none(spark):
    song = [(0.0, 440, 0.9), (math.nan, 440, 0.9), (0.05, 440, 0.9), (math.inf, 440, 0.9)]
    df = segment.segment_notes(segment.filter_by_confidence(frames(spark, song)))
    assert got(df, "note", "start_time", "end_time") == [("A4", 0.0, 0.05)]
    assert got(align.annotate_second_estimate(df, frames(spark, song)), "pyin_agrees") == [(True,)]


def test_sliced_chain_reads_its_input_once(spark):
    """The rows of slices do not repeat the steps before them: each frame is segmented once for all later steps."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = frames(spark, [(0.04 * i, 440.0 * 2 ** (i // 9 % 5 / 12), 0.95) for i in range(300)])
    passed = df.mapInArrow(counted, df.schema)
    assert sliced.map_notes(passed, slice_rows=50).count() > 0
    assert read.value == df.count()
