import csv
import io
import json

import pytest
from pyspark.sql import functions as F
from test_notes import events

from quaver import __main__ as cli
from quaver import schemas
from quaver.functions import music as M
from quaver.operators import align
from quaver.sources import readers, sinks

LRC = "[ti:T]\n[ar:A]\n[al:B]\n[by:C]\n\n[00:00.00]Hello\n[00:01.00]world\n[00:02.50]this\n[00:03.50]is\n[00:05.00]a test\nno tag\n[00:06.00]\n[00:07.234]late"


def lyrics(spark, text):
    return readers.parse_lrc_content(spark.createDataFrame([(0, text)], "song_id bigint, content string"))


def sung(spark, text, *starts):
    df = events(spark, [(60, s, s, 1) for s in starts])
    return [r.lyric for r in align.align_lyrics(df, lyrics(spark, text)).orderBy("event_idx").collect()]


def test_lrc(spark):
    assert [tuple(r) for r in lyrics(spark, LRC).orderBy("line_no").select("ts", "text").collect()] == [(0.0, "Hello"), (1.0, "world"), (2.5, "this"), (3.5, "is"), (5.0, "a test")]
    assert [r.ts for r in lyrics(spark, "[02:45]x\n[01:30.25]y\n[99:99.99]z").orderBy("line_no").collect()] == [165.0, 90.25, 99 * 60 + 99.99]
    assert lyrics(spark, "").count() == 0


def test_lyric_alignment(spark):
    assert sung(spark, LRC, 0.0, 1.0, 2.5, 3.5, 5.0) == ["Hello", "world", "this", "is", "a test"]
    assert sung(spark, LRC, -1.0, -0.5, 1.5) == [None, None, "world"]
    assert sung(spark, "[00:01.00]First\n[00:02.00]Second", 1.0, 1.0, 2.0) == ["First", "First", "Second"]
    assert sung(spark, "[00:01.00]a\n[00:01.00]b", 1.0, 9.0) == ["b", "b"]
    assert sung(spark, "", 1.0) == [None]
    assert [r.lyric for r in align.align_lyrics(events(spark, [(60, 0, 0, 1)]), None).collect()] == [None]


def test_lrc_files(spark, tmp_path):
    (tmp_path / "a.lrc").write_bytes(LRC.replace("\n", "\r\n").encode())
    assert readers.read_lrc(spark, str(tmp_path)).count() == 5
    assert readers.read_lrc(spark, str(tmp_path / "a.lrc")).count() == 5
    (tmp_path / "e").mkdir()
    (tmp_path / "e/b.lrc").write_text("[ti:x]\n")
    with pytest.raises(ValueError):
        readers.read_lrc(spark, str(tmp_path / "e/b.lrc"))
    with pytest.raises(ValueError):
        readers.read_lrc(spark, str(tmp_path / "a.txt"))


def named(spark):
    df = events(spark, [(60, 0, 0.5, 0.9), (64, 1, 1.5, 0.95), (67, 2.5, 3, 0.92)])
    return df.withColumn("lyric", F.when(F.col("midi") == 60, "Hello").when(F.col("midi") == 64, 'wör"ld, x')).withColumn("chord_fit", F.lit(True))


def test_csv(spark):
    rows = list(csv.reader(io.StringIO(sinks.format_csv(named(spark)))))
    assert rows[0] == ["note", "start_time", "end_time", "confidence", "lyric", "chord_fit"]
    assert rows[2][0] == "E4" and rows[2][4] == 'wör"ld, x' and rows[3][4] == ""
    assert sinks.format_csv(named(spark).limit(0)) == ""
    lines = [r.row for r in sinks.csv_rows(named(spark)).orderBy("event_idx").collect()]
    assert [next(csv.reader([x]))[4] for x in lines] == ["Hello", 'wör"ld, x', ""]


def test_json(spark):
    out = json.loads(sinks.format_json(named(spark)))
    assert out[2]["lyric"] is None and out[1]["lyric"] == 'wör"ld, x' and "midi" not in out[0]
    assert "\n" not in sinks.format_json(named(spark), indent=None) and "ö" in sinks.format_json(named(spark))
    assert sinks.format_json(named(spark).limit(0)) == "[]"
    assert json.loads(sinks.json_rows(named(spark)).orderBy("event_idx").collect()[2].row)["lyric"] is None


def test_table_and_dispatch(spark, tmp_path):
    assert "E4" in sinks.output(named(spark), "TABLE") and "0.950" in sinks.output(named(spark), "table")
    assert sinks.format_table(named(spark).limit(0)) == "No note events to display."
    assert sinks.format_leadsheet(named(spark).limit(0)) == "No note events."
    with pytest.raises(ValueError):
        sinks.output(named(spark), "xml")
    assert sinks.output(named(spark), "csv", str(tmp_path / "a/b.csv")) is None
    assert (tmp_path / "a/b.csv").read_bytes().startswith(b"note,start_time")


def test_files(spark, tmp_path):
    for kind in ("parquet", "json", "csv", "leadsheet"):
        sinks.write(named(spark), str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        sinks.write(named(spark), str(tmp_path / "x"), "xml")


def test_json_frames(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"time": 0.1, "frequency": 440.0, "confidence": 0.9}, {"time": 0.0, "frequency": 220.0, "confidence": 0.9}]))
    assert [r.seq for r in readers.read_frames(spark, str(tmp_path / "f.json"), "json").orderBy("time").collect()] == [0, 1]
    (tmp_path / "e.json").write_text(json.dumps([{"note": "A4", "start_time": 0.1, "end_time": 0.2, "confidence": 0.9}]))
    assert readers.read_events(spark, str(tmp_path / "e.json"), "json").first().midi == 69


def test_config(tmp_path):
    assert readers.load_config(str(tmp_path / "no.toml")) == {}
    (tmp_path / "a.toml").write_text("[quaver]\nconfidence = 0.5\n")
    assert readers.load_config(str(tmp_path / "a.toml")) == {"confidence": 0.5}
    (tmp_path / "b.toml").write_text("[other]\nx = 1\n")
    assert readers.load_config(str(tmp_path / "b.toml")) == {}
    (tmp_path / "c.toml").write_text("[quaver\n")
    with pytest.raises(ValueError):
        readers.load_config(str(tmp_path / "c.toml"))


def test_stems(tmp_path):
    with pytest.raises(FileNotFoundError, match="vocals"):
        readers.stem_paths("song.mp3", str(tmp_path))
    (tmp_path / "song").mkdir()
    for n in ("vocals", "other"):
        (tmp_path / f"song/{n}.wav").touch()
    assert readers.stem_paths("song.mp3", str(tmp_path)) == readers.stem_paths(str(tmp_path / "song/vocals.wav"))


def test_command_line(spark, tmp_path):
    frames = [(0, i, i * 0.05, 440.0, 0.9) for i in range(5)]
    spark.createDataFrame(frames, "song_id bigint, seq bigint, time double, frequency double, confidence double").write.parquet(str(tmp_path / "f"))
    (tmp_path / "a.lrc").write_text("[00:00.00]la")
    args = ["--frames", str(tmp_path / "f"), "--lyrics", str(tmp_path / "a.lrc"), "--format", "leadsheet", "--output", str(tmp_path / "o.txt"), "--transpose", "0"]
    assert cli.main(args, spark) == 0 and (tmp_path / "o.txt").read_text() == "la\nA4"
    assert cli.main([*args, "--confidence", "2"], spark) == 1
    assert cli.main(["--frames", str(tmp_path / "none")], spark) == 1


def test_command_line_stages(spark, tmp_path, capsys):
    """Chroma, beats with a tempo, lyrics that cannot be read (a warning only), and several songs in a folder."""
    frames = [(s, i, i * 0.05, 440.0, 0.9 if s < 2 else 0.1) for s in range(3) for i in range(12)]
    spark.createDataFrame(frames, schemas.FRAMES).write.parquet(str(tmp_path / "f"))
    spark.createDataFrame([(s, i, i * 0.3, 100.0 + s) for s in range(3) for i in range(4)], schemas.BEATS).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(0, f, p, 1.0 if p in (9, 1, 4) else 0.0) for f in range(60) for p in range(12)], schemas.CHROMA).write.parquet(str(tmp_path / "c"))
    more = ["--beats", str(tmp_path / "b"), "--chroma", str(tmp_path / "c"), "--lyrics", str(tmp_path / "no.txt"), "--transpose", "0"]
    args = ["--frames", str(tmp_path / "f"), "--format", "csv", "--output", str(tmp_path / "o"), *more]
    assert cli.main(args, spark) == 0 and "warning: lyrics" in capsys.readouterr().err
    made = {r.song_id: r for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect()}
    assert {i: (r.note, r.chord_fit, r.beat_aligned, r.lyric) for i, r in made.items()} == {"0": ("A4", "true", "true", None), "1": ("A4", "false", "true", None)}
    rows = {r.song_id: r for r in spark.read.json(str(tmp_path / "o-summary")).collect()}
    assert {i: (r.n_notes, r.key, r.bpm) for i, r in rows.items()} == {0: (1, "C major", 100.0), 1: (1, "C major", 101.0), 2: (0, "Unknown", 102.0)}
    assert cli.main(["--frames", str(tmp_path / "f"), *more], spark) == 0
    shown = capsys.readouterr()
    assert shown.out.splitlines() == ["# 0", "A4 | 0.000 | 0.550 | 0.900 | ", "# 1", "A4 | 0.000 | 0.550 | 0.900 | "] and "key: Unknown, key_score: 0%, bpm: 102.0" in shown.err
    with pytest.raises(ValueError):
        sinks.output(spark.read.parquet(str(tmp_path / "f")), "json")


def test_names_and_json_beats(spark, tmp_path):
    (tmp_path / "My Song.json").write_text(json.dumps([{"time": 0.0, "frequency": 440.0, "confidence": 0.9}]))
    assert [r.source for r in readers.songs_of(readers.read_frames(spark, str(tmp_path / "My Song.json"), "json")).collect()] == ["My Song.json"]
    (tmp_path / "x.lrc").write_text("[00:00.00]la")
    assert readers.read_lrc(spark, str(tmp_path / "x.lrc")).first().source == "x.lrc"
    (tmp_path / "b.json").write_text(json.dumps({"bpm": 120.0, "beat_times": [0.0, 0.5, 1.0]}))
    assert [(r.beat_idx, r.time, r.bpm) for r in readers.read_beats(spark, str(tmp_path / "b.json"), "json").orderBy("beat_idx").collect()] == [(0, 0.0, 120.0), (1, 0.5, 120.0), (2, 1.0, 120.0)]
    names = spark.createDataFrame([("/a/b.mp3",), ("c.wav",), ("C:\\d\\e.mp3",), ("x/",)], "p string").select(M.base_name(F.col("p")).alias("n"))
    assert [r.n for r in names.collect()] == ["b.mp3", "c.wav", "e.mp3", ""]


def song_files(root, names):
    """Two kinds of notes a song: frames at 440 Hz, second frames, beats and lyrics in folders of their own."""
    for i, name in enumerate(names):
        for kind, suffix in (("frames", ".json"), ("second", ".json"), ("beats", ".beats.json"), ("lyrics", ".lrc")):
            (root / kind / name).parent.mkdir(parents=True, exist_ok=True)
        rows = [{"time": k * 0.05, "frequency": 440.0 * 2 ** (i / 12), "confidence": 0.9} for k in range(8)]
        (root / f"frames/{name}.json").write_text(json.dumps(rows))
        (root / f"second/{name}.json").write_text(json.dumps(rows))
        (root / f"beats/{name}.beats.json").write_text(json.dumps({"bpm": 100.0 + i, "beat_times": [0.0, 0.5, 1.0]}))
        (root / f"lyrics/{name}.lrc").write_text(f"[00:00.00]line of {name}")


def args_of(root, *more):
    return ["--frames", str(root / "frames"), "--json", "--second-frames", str(root / "second"), "--beats", str(root / "beats"), "--lyrics", str(root / "lyrics"), "--transpose", "0", *more]


def test_songs_of_several_files(spark, tmp_path, capsys):
    """Frames, second frames, beats and lyrics of one name meet; what has no partner is reported."""
    names = ["One Song", "live/10%+1", "live/b.c"]
    song_files(tmp_path, names)
    (tmp_path / "lyrics/stray.lrc").write_text("[00:00.00]nobody's")
    (tmp_path / "beats/live/b.c.beats.json").unlink()
    (tmp_path / "lyrics/live/b.c.lrc").write_text("no time at all")
    assert cli.main(args_of(tmp_path, "--format", "json", "--output", str(tmp_path / "o")), spark) == 0
    said = capsys.readouterr().err
    assert "stray.lrc" in said and "no beats for song live/b.c" in said and "no timed lines" in said and "One Song" not in said
    rows = {r.source: r for r in spark.read.json(str(tmp_path / "o-summary")).collect()}
    assert {n: (r.n_notes, r.n_lyric, r.n_beat_aligned, r.n_pyin_agrees, r.bpm) for n, r in rows.items()} == {"One Song": (1, 1, 1, 1, 100.0), "live/10%+1": (1, 1, 1, 1, 101.0), "live/b.c": (1, 0, 0, 1, None)}
    made = {(r.note, r.lyric) for r in spark.read.json(str(tmp_path / "o")).collect()}
    assert made == {("A4", "line of One Song"), ("A#4", "line of live/10%+1"), ("B4", None)}


def test_songs_given_by_the_user(spark, tmp_path):
    song_files(tmp_path, ["a", "b"])
    rows = ["kind,path,song_id", *(f"{k},{n}{x},{i}" for i, (n, m) in enumerate((("a", "b"), ("b", "a"))) for k, n, x in (("frames", n, ".json"), ("second", m, ".json"), ("beats", m, ".beats.json")))]
    rows += [f",{tmp_path}/lyrics/b.lrc,0", "beats,a.lrc,1"]
    (tmp_path / "songs.csv").write_text("\n".join(rows))
    assert cli.main(args_of(tmp_path, "--songs", str(tmp_path / "songs.csv"), "--output", str(tmp_path / "o"), "--format", "json"), spark) == 0
    got = {r.song_id: (r.note, r.lyric, r.pyin_agrees) for r in spark.read.json(str(tmp_path / "o")).collect()}
    assert got == {0: ("A4", "line of b", False), 1: ("A#4", None, False)}
    assert {r.song_id: r.bpm for r in spark.read.json(str(tmp_path / "o-summary")).collect()} == {0: 101.0, 1: 100.0}


def test_lyrics_of_songs_with_ids(spark, tmp_path, capsys):
    """Parquet frames bring ids: an LRC file of that number belongs to the song."""
    spark.createDataFrame([(s, i, i * 0.05, 440.0, 0.9) for s in (7, 8) for i in range(5)], schemas.FRAMES).write.parquet(str(tmp_path / "f"))
    (tmp_path / "l").mkdir()
    for s in (7, 9):
        (tmp_path / f"l/{s}.lrc").write_text(f"[00:00.00]la {s}")
    assert cli.main(["--frames", str(tmp_path / "f"), "--lyrics", str(tmp_path / "l"), "--transpose", "0"], spark) == 0
    shown = capsys.readouterr()
    assert shown.out.splitlines() == ["# 7", "A4 | 0.000 | 0.200 | 0.900 | la 7", "# 8", "A4 | 0.000 | 0.200 | 0.900 | "]
    assert "9.lrc" in shown.err and "no lyrics for song 8" in shown.err


def test_manifest_ties_and_nulls(spark, tmp_path):
    from quaver.sources import songs as S

    listed = spark.createDataFrame([("beats", "/r/a.json", "a.json", "a"), ("beats", "/r/5.json", "5.json", "5"), ("beats", "/r/x.json", "x.json", "x")], "kind string, path string, relative string, song string")
    known = spark.createDataFrame([(3, "a"), (2, "a"), (5, None), (6, "5")], "song_id bigint, song string")
    assert {r.path: r.song_id for r in S.manifest(listed, known).collect()} == {"/r/a.json": 2, "/r/5.json": 6, "/r/x.json": None}
    assert {r.song_id for r in S.without(known, S.manifest(listed, known)).collect()} == {3, 5}
    assert S.manifest(listed.limit(0), known).count() == 0 and S.manifest(listed, known.limit(0)).where("song_id is not null").count() == 0
    given = spark.createDataFrame([("beats", "file:///r/a.json", 9), (None, "a.json", 4), ("frames", "x.json", 1), (None, None, None)], "kind string, path string, song_id int")
    assert {r.path: r.song_id for r in S.manifest(listed, known, given).collect()} == {"/r/a.json": 4, "/r/5.json": None, "/r/x.json": None}
