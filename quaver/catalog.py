"""The engine's queries by name, each over whole tables, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import music as M
from .operators import align, keys, leadsheet, segment, sliced
from .plans import summaries
from .plans import transcribe as T
from .sources import adapters as A
from .sources import readers, sinks

#: Frames or events of a slice in the queries: less than the test songs have, so that all of them are cut.
SLICE_ROWS = 100

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _six(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


# -- the same steps as common table expressions --------------------------------------------------------------------

D = "CAST({} AS DOUBLE)".format
NAME = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST({0} % 12 AS INT) + 1] || CAST({0} // 12 - 1 AS VARCHAR)".format
VALID = "frequency > 0 AND NOT isnan(frequency) AND NOT isinf(frequency)"
MIDI = f"CAST(round_even({D(12)} * (log2(frequency) - log2({D(440)})) + {D(69)}, 0) AS INT)"
SURE = f"""
sure AS (SELECT * FROM frames WHERE confidence >= {D(0.85)} AND NOT isnan(confidence))"""
SEGMENTS = f"""
tuned AS (SELECT *, {MIDI} AS midi FROM sure WHERE {VALID}),
breaks AS (SELECT *, CASE WHEN lag(midi) OVER w IS NULL OR midi <> lag(midi) OVER w OR time - lag(time) OVER w > {D(0.1)} THEN 1 ELSE 0 END AS nb FROM tuned WINDOW w AS (PARTITION BY song_id ORDER BY seq)),
runs AS (SELECT *, CAST(sum(nb) OVER (PARTITION BY song_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS event_idx FROM breaks),
segments AS (SELECT song_id, event_idx, min(midi) AS midi, arg_min(time, seq) AS start_time, arg_max(time, seq) AS end_time, avg(confidence) AS confidence FROM runs GROUP BY song_id, event_idx)"""
SCALES = "scales(rank, key, pcs) AS (VALUES " + ", ".join(f"({i}, '{k}', {list(p)})" for i, (k, p) in enumerate(M.scales())) + ")"


def keyed(events: str, out: str) -> str:
    return f"""
{out}_pc AS (SELECT *, CASE WHEN midi >= 12 THEN midi % 12 ELSE -1 END AS pc FROM {events}),
{out}_hits AS (SELECT song_id, rank, key, pcs, sum(CASE WHEN list_contains(pcs, pc) THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM {out}_pc, scales GROUP BY song_id, rank, key, pcs),
{out} AS (SELECT song_id, rank, key, pcs, CAST(hits AS DOUBLE) / n AS score, row_number() OVER (PARTITION BY song_id ORDER BY hits DESC, rank) AS place FROM {out}_hits)"""


FILTERED = f"""
{SCALES},{keyed("segments", "ranked")},
in_key AS (SELECT p.* EXCLUDE (pc) FROM ranked_pc p JOIN ranked k ON k.song_id = p.song_id AND k.place = 1 WHERE k.score < {D(0.6)} OR list_contains(k.pcs, p.pc))"""
SMOOTHED = f"""
beside AS (SELECT *, lag(midi) OVER w AS pm, lead(midi) OVER w AS nm FROM in_key WINDOW w AS (PARTITION BY song_id ORDER BY event_idx)),
tame AS (SELECT * EXCLUDE (pm, nm) FROM beside WHERE NOT coalesce(end_time - start_time < {D(0.15)} AND abs(midi - pm) > 12 AND abs(midi - nm) > 12, false))"""
MERGED = f"""
joins AS (SELECT *, CASE WHEN coalesce(midi = lag(midi) OVER w AND start_time - lag(end_time) OVER w >= 0 AND start_time - lag(end_time) OVER w <= {D(0.08)}, false) THEN 0 ELSE 1 END AS nb FROM tame WINDOW w AS (PARTITION BY song_id ORDER BY event_idx)),
joined AS (SELECT *, CAST(sum(nb) OVER (PARTITION BY song_id ORDER BY event_idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM joins),
merged AS (SELECT song_id, run AS event_idx, min(midi) AS midi, arg_min(start_time, event_idx) AS start_time, arg_max(end_time, event_idx) AS end_time, list_reduce(list(confidence ORDER BY event_idx), lambda x, y: (x + y) / 2) AS confidence FROM joined GROUP BY song_id, run)"""
EVENTS = A.FRAMES_SQL + "," + SURE + "," + SEGMENTS
NOTES = EVENTS + "," + FILTERED + "," + SMOOTHED + "," + MERGED
CHORDS = f"""{A.CHROMA_SQL},
spans AS (SELECT song_id, beat_idx, time, coalesce(lead(time) OVER w, time + coalesce(time - lag(time) OVER w, {D(0.5)})) AS e FROM cbeats WINDOW w AS (PARTITION BY song_id ORDER BY beat_idx)),
slots AS (SELECT s.*, greatest(0, least(floor(floor(time * 22050) / 512), n - 1)) AS a, least(floor(floor(e * 22050) / 512), n) AS b FROM spans s JOIN sizes USING (song_id)),
energy AS (SELECT s.song_id, beat_idx, s.time, pc, avg(energy) AS e FROM slots s JOIN chroma c ON c.song_id = s.song_id AND frame >= a AND frame < greatest(a + 1, b) GROUP BY ALL),
chords AS (SELECT song_id, beat_idx AS chord_idx, time, list_transform(list(pc ORDER BY e DESC, pc DESC)[1 : 3], lambda p: ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(p AS INT) + 1]) AS chord_notes FROM energy GROUP BY song_id, beat_idx, time)"""
SUBS = """
steps AS (SELECT song_id, beat_idx, time, lead(time) OVER (PARTITION BY song_id ORDER BY beat_idx) AS e FROM beats),
subs AS (SELECT song_id, time + (e - time) * i / 4 AS time FROM steps, (SELECT unnest(range(0, 4)) AS i) WHERE e IS NOT NULL UNION ALL SELECT song_id, time FROM steps WHERE e IS NULL)"""
LYRICS = A.LYRIC_LINES_SQL + """,
parts AS (SELECT song_id, line_no, regexp_extract(l, '^\\[(\\d{2}):(\\d{2})(?:\\.(\\d{2}))?\\](.*)', ['mm', 'ss', 'xx', 't']) AS p FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS l FROM lyric_lines)),
lyrics AS (SELECT song_id, line_no, CAST(p.mm AS DOUBLE) * 60 + CAST(p.ss AS DOUBLE) + coalesce(CAST(nullif(p.xx, '') AS DOUBLE), 0) / 100 AS ts, regexp_replace(p.t, '^\\s+|\\s+$', '', 'g') AS text FROM parts WHERE p.mm <> '' AND regexp_replace(p.t, '^\\s+|\\s+$', '', 'g') <> '')"""
SUNG = f"""{LYRICS},
last_line AS (SELECT song_id, ts, arg_max(text, line_no) AS text FROM lyrics GROUP BY song_id, ts),
sung AS (SELECT m.*, l.text AS lyric FROM merged m ASOF LEFT JOIN last_line l ON l.song_id = m.song_id AND l.ts <= m.start_time)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.map_notes(A.frames(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frames(spark, sf_dir).transform(segment.filter_by_confidence).transform(segment.segment_notes)


def _lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_lrc(A.lyric_lines(spark, sf_dir))


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.beats(A.frames(spark, sf_dir), A.frame_ends(spark, sf_dir))


def _sung(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_lyrics(_notes(spark, sf_dir), _lyrics(spark, sf_dir))


EVENT_COLS = f"song_id, event_idx, midi, {NAME('midi')} AS note, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(confidence, 6) AS confidence"


def _events(df: DataFrame, *more: str) -> DataFrame:
    return df.select("song_id", "event_idx", "midi", "note", *_six("start_time", "end_time", "confidence"), *more)


# -- queries ---------------------------------------------------------------------------------------------------------


@query(with_(A.FRAMES_SQL + "," + SURE, "SELECT song_id, seq, round(time, 6) AS time, round(confidence, 6) AS confidence FROM sure"))
def confidence_filter(spark, sf_dir):
    return segment.filter_by_confidence(A.frames(spark, sf_dir)).select("song_id", "seq", *_six("time", "confidence"))


@query(with_(A.FRAMES_SQL, f"SELECT song_id, seq, midi, {NAME('midi')} AS note, CASE WHEN midi >= 12 THEN midi % 12 ELSE -1 END AS pc FROM (SELECT *, {MIDI} AS midi FROM frames WHERE {VALID})"))
def hz_to_note(spark, sf_dir):
    midi = F.col("midi")
    return segment.valid_frames(A.frames(spark, sf_dir)).select("song_id", "seq", "midi", M.note_name(midi).alias("note"), M.pitch_class(midi).alias("pc"))


@query(f"SELECT DISTINCT CAST(p_size AS INT) AS midi, round({D(440)} * pow({D(2)}, (p_size - {D(69)}) / {D(12)}), 6) AS hz FROM part")
def midi_to_hz(spark, sf_dir):
    midi = F.col("p_size").cast("int")
    return A.table(spark, sf_dir, "part").select(midi.alias("midi"), F.round(M.midi_to_hz(midi), 6).alias("hz")).distinct()


@query(with_(A.FRAMES_SQL + "," + A.SECOND_SQL, f"SELECT song_id, count(*) AS n FROM second WHERE {VALID} AND time > 0 GROUP BY song_id"))
def voiced_filter(spark, sf_dir):
    voiced = A.second_frames(A.frames(spark, sf_dir)).withColumn("voiced", F.col("time") > 0)
    return segment.voiced_frames(voiced).groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_(EVENTS, f"SELECT {EVENT_COLS} FROM segments"))
def segment_notes(spark, sf_dir):
    return _events(_segments(spark, sf_dir))


@query(with_(EVENTS, f"SELECT {EVENT_COLS} FROM segments"))
def segment_notes_sliced(spark, sf_dir):
    return _events(sliced.segment_notes(segment.filter_by_confidence(A.frames(spark, sf_dir)), slice_rows=SLICE_ROWS))


@query(with_(NOTES, f"SELECT {EVENT_COLS} FROM merged"))
def map_notes_sliced(spark, sf_dir):
    return _events(sliced.map_notes(A.frames(spark, sf_dir), slice_rows=SLICE_ROWS))


@query(with_(EVENTS, f"SELECT song_id, event_idx, midi + 9 AS midi, {NAME('(midi + 9)')} AS note FROM segments"))
def transpose_notes(spark, sf_dir):
    return segment.transpose(_segments(spark, sf_dir), 9).select("song_id", "event_idx", "midi", "note")


@query(with_(EVENTS + "," + SCALES + "," + keyed("segments", "ranked"), "SELECT song_id, key, round(score, 6) AS score FROM ranked WHERE place = 1"))
def detect_key(spark, sf_dir):
    return keys.detect_key(_segments(spark, sf_dir)).select("song_id", "key", *_six("score"))


@query(with_(EVENTS + "," + SCALES + "," + keyed("segments", "ranked"), "SELECT song_id, CAST(place AS INT) AS place, key, round(score, 6) AS score FROM ranked WHERE place <= 3"))
def key_candidates_top3(spark, sf_dir):
    found = keys.detect_key(_segments(spark, sf_dir)).select("song_id", F.posexplode("candidates").alias("p", "c"))
    return found.select("song_id", (F.col("p") + 1).alias("place"), "c.key", F.round("c.score", 6).alias("score"))


@query(with_(EVENTS + "," + FILTERED, f"SELECT {EVENT_COLS} FROM in_key"))
def key_filter(spark, sf_dir):
    return _events(keys.filter_by_key(_segments(spark, sf_dir)))


@query(with_(EVENTS + "," + FILTERED, f"SELECT {EVENT_COLS} FROM in_key"))
def key_filter_given(spark, sf_dir):
    events = _segments(spark, sf_dir)
    return _events(keys.filter_by_key(events, keys.detect_key(events)))


@query(with_(EVENTS + "," + FILTERED + "," + SMOOTHED, f"SELECT {EVENT_COLS} FROM tame"))
def octave_outliers(spark, sf_dir):
    return _events(segment.remove_octave_outliers(keys.filter_by_key(_segments(spark, sf_dir))))


@query(with_(NOTES, f"SELECT {EVENT_COLS} FROM merged"))
def merge_flickers(spark, sf_dir):
    return _events(_notes(spark, sf_dir))


AGREE = f"""
met AS (SELECT m.song_id, m.event_idx, count(s.time) AS n, bool_or(coalesce(abs(m.midi - ({D(12)} * (log2(s.frequency) - log2({D(440)})) + {D(69)})) * 100 <= 50, false)) AS ok FROM merged m LEFT JOIN second s ON s.song_id = m.song_id AND s.time BETWEEN m.start_time AND m.end_time GROUP BY ALL),
agreed AS (SELECT m.* EXCLUDE (confidence), CASE WHEN n > 0 AND NOT ok THEN confidence * {D(0.85)} ELSE confidence END AS confidence, ok AS pyin_agrees FROM merged m JOIN met USING (song_id, event_idx))"""
FIT = """
near AS (SELECT a.song_id, a.event_idx, arg_min(c.chord_notes, struct_pack(d := abs(c.time - a.start_time), i := c.chord_idx)) AS chord FROM agreed a JOIN chords c ON c.song_id = a.song_id GROUP BY ALL),
fitted AS (SELECT a.*, coalesce(list_contains(chord, CASE WHEN midi >= 12 THEN ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(midi % 12 AS INT) + 1] END), false) AS chord_fit FROM agreed a LEFT JOIN near USING (song_id, event_idx))"""
ALIGNED = f"""
before AS (SELECT f.*, s.time AS p FROM fitted f ASOF LEFT JOIN subs s ON s.song_id = f.song_id AND s.time <= f.start_time),
around AS (SELECT b.*, s.time AS q FROM before b ASOF LEFT JOIN subs s ON s.song_id = b.song_id AND s.time >= b.start_time),
timed AS (SELECT * EXCLUDE (p, q), coalesce(least(abs(p - start_time), abs(q - start_time)) <= {D(0.08)}, false) AS beat_aligned FROM around)"""


@query(with_(NOTES + "," + A.SECOND_SQL + "," + AGREE, f"SELECT {EVENT_COLS}, pyin_agrees FROM agreed"))
def pyin_agreement(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    return _events(align.annotate_second_estimate(T.map_notes(frames), A.second_frames(frames)), "pyin_agrees")


@query(with_(A.FRAMES_SQL + "," + A.BEATS_SQL + "," + SUBS, "SELECT song_id, round(time, 6) AS time FROM subs"))
def beat_subdivisions(spark, sf_dir):
    return align.beat_subdivisions(_beats(spark, sf_dir)).select("song_id", *_six("time"))


@query(with_(CHORDS, "SELECT song_id, chord_idx, round(time, 6) AS time, array_to_string(chord_notes, ' ') AS chord_notes FROM chords"))
def chord_timeline(spark, sf_dir):
    chroma = A.chroma(spark, sf_dir)
    found = align.chord_timeline(chroma, A.chroma_beats(chroma))
    return found.select("song_id", "chord_idx", *_six("time"), F.array_join("chord_notes", " ").alias("chord_notes"))


@query(with_(NOTES + ", agreed AS (SELECT * FROM merged)," + CHORDS + "," + FIT, "SELECT song_id, event_idx, midi, chord_fit FROM fitted"))
def chord_fit(spark, sf_dir):
    chroma = A.chroma(spark, sf_dir)
    chords = align.chord_timeline(chroma, A.chroma_beats(chroma))
    return align.annotate_chord_fit(_notes(spark, sf_dir), chords).select("song_id", "event_idx", "midi", "chord_fit")


@query(with_(NOTES + ", fitted AS (SELECT * FROM merged)," + A.BEATS_SQL + "," + SUBS + "," + ALIGNED, "SELECT song_id, event_idx, round(start_time, 6) AS start_time, beat_aligned FROM timed"))
def beat_alignment(spark, sf_dir):
    return align.annotate_beats(_notes(spark, sf_dir), align.beat_subdivisions(_beats(spark, sf_dir))).select("song_id", "event_idx", *_six("start_time"), "beat_aligned")


@query(with_(LYRICS, "SELECT song_id, line_no, round(ts, 6) AS ts, text FROM lyrics"))
def lrc_parse(spark, sf_dir):
    return _lyrics(spark, sf_dir).select("song_id", "line_no", *_six("ts"), "text")


@query(with_(NOTES + "," + SUNG, f"SELECT {EVENT_COLS}, lyric FROM sung"))
def lyric_align(spark, sf_dir):
    return _events(_sung(spark, sf_dir), "lyric")


FULL = NOTES + "," + A.SECOND_SQL + "," + AGREE + "," + CHORDS + "," + FIT + "," + A.BEATS_SQL + "," + SUBS + "," + ALIGNED
FULL_SUNG = FULL + "," + LYRICS + ", last_line AS (SELECT song_id, ts, arg_max(text, line_no) AS text FROM lyrics GROUP BY song_id, ts), done AS (SELECT m.* EXCLUDE (midi), m.midi + 9 AS midi, l.text AS lyric FROM timed m ASOF LEFT JOIN last_line l ON l.song_id = m.song_id AND l.ts <= m.start_time)"


def _transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, chroma = A.frames(spark, sf_dir), A.chroma(spark, sf_dir)
    chords = align.chord_timeline(chroma, A.chroma_beats(chroma))
    return T.transcribe(frames, transpose=9, second_frames=A.second_frames(frames), chords=chords, grid=align.beat_subdivisions(_beats(spark, sf_dir)), lyrics=_lyrics(spark, sf_dir))


@query(with_(FULL_SUNG, f"SELECT {EVENT_COLS}, pyin_agrees, chord_fit, beat_aligned, lyric FROM done"))
def map_notes_full(spark, sf_dir):
    return _events(_transcribed(spark, sf_dir), "pyin_agrees", "chord_fit", "beat_aligned", "lyric")


SUMMED = """
tempo AS (SELECT song_id, max(bpm) AS bpm FROM beats GROUP BY song_id),
summed AS (SELECT song_id, count(*) AS n_notes, CAST(count_if(pyin_agrees) AS BIGINT) AS n_pyin_agrees, CAST(count_if(chord_fit) AS BIGINT) AS n_chord_fit, CAST(count_if(beat_aligned) AS BIGINT) AS n_beat_aligned,
  count(lyric) AS n_lyric, round(min(start_time), 6) AS first_start, round(max(end_time), 6) AS last_end FROM done GROUP BY song_id),
all_songs AS (SELECT DISTINCT song_id FROM frames UNION SELECT -1 - i FROM range(3) AS r(i))"""
SUMMARY = """
SELECT a.song_id, coalesce(n_notes, 0) AS n_notes, coalesce(n_pyin_agrees, 0) AS n_pyin_agrees, coalesce(n_chord_fit, 0) AS n_chord_fit, coalesce(n_beat_aligned, 0) AS n_beat_aligned, coalesce(n_lyric, 0) AS n_lyric,
  first_start, last_end, coalesce(b.key, 'Unknown') AS key, coalesce(format('{:.0f}%', b.score * 100), '0%') AS key_score, round(bpm, 6) AS bpm
FROM all_songs a LEFT JOIN summed USING (song_id) LEFT JOIN best b ON b.song_id = a.song_id AND b.place = 1 LEFT JOIN tempo t ON t.song_id = a.song_id"""


@query(with_(FULL_SUNG + "," + keyed("done", "best") + "," + SUMMED, SUMMARY))
def song_summary(spark, sf_dir):
    """The summary of all songs, and of three that have no frames at all."""
    frames = A.frames(spark, sf_dir)
    songs = frames.select("song_id").union(spark.range(3).select((-1 - F.col("id")).alias("song_id")))
    found = T.song_summary(_transcribed(spark, sf_dir), songs, align.tempo(_beats(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 6) for c in ("first_start", "last_end", "bpm")})


@query(SQL["song_summary"])
def song_summary_merged(spark, sf_dir):
    """The same from states of 20 neighbouring events each, merged."""
    frames = A.frames(spark, sf_dir)
    songs = frames.select("song_id").union(spark.range(3).select((-1 - F.col("id")).alias("song_id")))
    parts = summaries.state(_transcribed(spark, sf_dir).withColumn("part", F.floor(F.col("event_idx") / 20)), "part")
    found = summaries.finished(summaries.merged(parts), songs, align.tempo(_beats(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 6) for c in ("first_start", "last_end", "bpm")})


@query(with_(A.FRAMES_SQL, "SELECT song_id, count(*) AS n_frames, round(min(time), 6) AS min_time, round(max(time), 6) AS max_time, round(min(frequency), 6) AS min_frequency, round(max(frequency), 6) AS max_frequency, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence FROM frames GROUP BY song_id"))
def frame_ranges(spark, sf_dir):
    found = T.frame_ranges(A.frames(spark, sf_dir))
    return found.select("song_id", "n_frames", *_six(*(f"{n}_{c}" for c in ("time", "frequency", "confidence") for n in ("min", "max"))))


@query(with_(NOTES, " UNION ALL ".join(f"SELECT song_id, '{stage}' AS stage, count(*) AS n FROM {t} GROUP BY song_id" for stage, t in (("frames", "frames"), ("confident", "sure"), ("segments", "segments"), ("in key", "in_key"), ("no outliers", "tame"), ("merged", "merged")))))
def stage_counts(spark, sf_dir):
    return T.stage_counts(A.frames(spark, sf_dir))


@query(with_(EVENTS, f"SELECT {EVENT_COLS} FROM segments QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY event_idx) <= 5"))
def first_events(spark, sf_dir):
    return _events(T.preview(_segments(spark, sf_dir)))


@query(with_(EVENTS, f"SELECT song_id, event_idx, {NAME('midi')} AS note, round_even(start_time, 3) AS start_time, round_even(end_time, 3) AS end_time, round_even(avg_c, 3) AS confidence FROM (SELECT *, round(confidence, 6) AS avg_c FROM segments)"))
def display_rows(spark, sf_dir):
    return T.display(_segments(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))).select("song_id", "event_idx", "note", "start_time", "end_time", "confidence")


GAPS = "gaps AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 21600 OR event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS nb, event_id, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), ev AS (SELECT *, sum(nb) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)"


@query(with_(GAPS, "SELECT user_id AS song_id, CAST(run - 1 AS BIGINT) AS event_idx, any_value(event_type) AS event_type, count(*) AS n, round(avg(value), 6) AS confidence FROM ev GROUP BY user_id, run"))
def event_runs(spark, sf_dir):
    """The run logic of segmentation on another table: runs of one event type without a pause above six hours."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > 21_600_000_000
    new = F.coalesce((F.col("event_type") != F.lag("event_type").over(w)) | pause, F.lit(True))
    runs = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("__new", new.cast("long")).withColumn("event_idx", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1)
    return runs.groupBy(F.col("user_id").alias("song_id"), "event_idx").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("confidence"))


MARK = "CASE WHEN {0} < 0.3::DOUBLE THEN ' ' WHEN {0} < 0.8::DOUBLE THEN ' - ' WHEN {0} < 2.0::DOUBLE THEN ' -- ' ELSE ' --- ' END".format


def sheet(events: str) -> str:
    return f"""
has AS (SELECT *, max(CASE WHEN coalesce(lyric, '') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY song_id) = 1 AS sung FROM {events}),
cuts AS (SELECT *, CASE WHEN lag(event_idx) OVER w IS NULL THEN 0 WHEN sung THEN CASE WHEN lyric IS DISTINCT FROM lag(lyric) OVER w THEN 1 ELSE 0 END ELSE CASE WHEN start_time - lag(start_time) OVER w > 2.0::DOUBLE THEN 1 ELSE 0 END END AS nb FROM has WINDOW w AS (PARTITION BY song_id ORDER BY event_idx)),
grps AS (SELECT *, CAST(sum(nb) OVER (PARTITION BY song_id ORDER BY event_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM cuts),
spaced AS (SELECT *, {NAME('midi')} || CASE WHEN lead(start_time) OVER w IS NULL THEN '' ELSE {MARK('(lead(start_time) OVER w - start_time)')} END AS s FROM grps WINDOW w AS (PARTITION BY song_id, grp ORDER BY event_idx)),
lines_ AS (SELECT song_id, grp, any_value(sung) AS sung, any_value(lyric) AS lyric, count(*) AS n_notes, string_agg(s, '' ORDER BY event_idx) AS notes FROM spaced GROUP BY song_id, grp)"""


@query(with_(NOTES + "," + SUNG + "," + sheet("sung"), "SELECT song_id, grp, lyric, n_notes, notes FROM lines_"))
def leadsheet_groups(spark, sf_dir):
    return leadsheet.group_lines(_sung(spark, sf_dir)).drop("sung")


@query(with_(NOTES + ", plain AS (SELECT *, CAST(NULL AS VARCHAR) AS lyric FROM merged)," + sheet("plain"), "SELECT song_id, grp, n_notes, notes FROM lines_"))
def leadsheet_gap_groups(spark, sf_dir):
    return leadsheet.group_lines(_notes(spark, sf_dir)).drop("sung", "lyric")


@query(with_(NOTES + "," + SUNG + "," + sheet("sung"), "SELECT song_id, CASE WHEN bool_and(sung) THEN string_agg(CASE WHEN coalesce(lyric, '') <> '' THEN lyric || chr(10) ELSE '' END || notes, chr(10) || chr(10) ORDER BY grp) ELSE string_agg(notes, chr(10) ORDER BY grp) END AS text FROM lines_ GROUP BY song_id"))
def leadsheet_text(spark, sf_dir):
    return leadsheet.sheets(_sung(spark, sf_dir))


@query(with_(NOTES + ", plain AS (SELECT *, CAST(NULL AS VARCHAR) AS lyric FROM merged)," + sheet("plain"), "SELECT song_id, string_agg(notes, chr(10) ORDER BY grp) AS text FROM lines_ GROUP BY song_id"))
def leadsheet_gap_text(spark, sf_dir):
    return leadsheet.sheets(_notes(spark, sf_dir))


def _thousandths(df: DataFrame) -> DataFrame:
    return df.withColumns({c: M.three(F.col(c)) for c in ("start_time", "end_time", "confidence")})


SHOWN = f"shown AS (SELECT song_id, event_idx, {NAME('midi')} AS note, format('{{:.3f}}', start_time) AS start_time, format('{{:.3f}}', end_time) AS end_time, format('{{:.3f}}', confidence) AS confidence, lyric FROM sung)"
QUOTED = "CASE WHEN regexp_matches(coalesce(lyric, ''), '[\",\\r\\n]') THEN '\"' || replace(lyric, '\"', '\"\"') || '\"' ELSE coalesce(lyric, '') END"


@query(with_(NOTES + "," + SUNG + "," + SHOWN, f"SELECT song_id, event_idx, note || ',' || start_time || ',' || end_time || ',' || confidence || ',' || {QUOTED} AS row FROM shown"))
def events_csv_rows(spark, sf_dir):
    return sinks.csv_rows(_thousandths(_sung(spark, sf_dir)))


@query(with_(NOTES + "," + SUNG + "," + SHOWN, "SELECT song_id, event_idx, CAST(json_object('note', note, 'start_time', start_time, 'end_time', end_time, 'confidence', confidence, 'lyric', lyric) AS VARCHAR) AS row FROM shown"))
def events_json_rows(spark, sf_dir):
    return sinks.json_rows(_thousandths(_sung(spark, sf_dir)))


@query(with_(NOTES + "," + SUNG + "," + SHOWN, "SELECT song_id, event_idx, note || ' | ' || start_time || ' | ' || end_time || ' | ' || confidence || ' | ' || coalesce(lyric, '') AS row FROM shown"))
def events_table_rows(spark, sf_dir):
    return sinks.table_rows(_sung(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
