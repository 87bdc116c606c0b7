"""Tables of the engine. A song is one ``song_id``; order is a column (seq, event_idx, line_no, chord_idx), never row order."""

FRAMES = "song_id bigint, seq bigint, time double, frequency double, confidence double"
EVENTS = "song_id bigint, event_idx bigint, midi int, note string, start_time double, end_time double, confidence double"
BEATS = "song_id bigint, beat_idx bigint, time double, bpm double"
SUBDIVISIONS = "song_id bigint, time double"
CHROMA = "song_id bigint, frame int, pc int, energy double"
CHORDS = "song_id bigint, chord_idx bigint, time double, chord_notes array<string>"
LYRIC_LINES = "song_id bigint, line_no bigint, line string"
LYRICS = "song_id bigint, line_no bigint, ts double, text string"
KEYS = "song_id bigint, key string, score double, candidates array<struct<key: string, score: double>>"
