"""Readers: frames and events as JSON or Parquet, lyrics as LRC files or text, stem paths, options as TOML."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schemas
from ..functions import music as M
from . import songs as S


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet", songs: DataFrame | None = None) -> DataFrame:
    """Pitch frames. JSON: one array of {time, frequency, confidence} a file; ``songs``: the manifest of the files; without it, and without song_id, each file is a song. ``source``: the song's or the file's name."""
    if fmt == "parquet":
        return spark.read.schema(schemas.FRAMES).parquet(path)
    raw = S.placed(_json(spark, path, "song_id bigint, seq bigint, time double, frequency double, confidence double"), songs).withColumn("__at", F.monotonically_increasing_id())
    order = W.partitionBy("song_id").orderBy("time", "__at")  # stable by time
    return raw.withColumn("seq", F.coalesce("seq", F.row_number().over(order).cast("long") - 1)).drop("__at")


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", songs: DataFrame | None = None) -> DataFrame:
    """Note events. JSON: one array of {note, start_time, end_time, confidence, ...} a file, in order."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    flags = "pyin_agrees boolean, chord_fit boolean, beat_aligned boolean"
    raw = _json(spark, path, f"song_id bigint, event_idx bigint, note string, start_time double, end_time double, confidence double, lyric string, {flags}")
    raw = S.placed(raw, songs).drop("source").withColumn("__at", F.monotonically_increasing_id())
    raw = raw.withColumn("event_idx", F.coalesce("event_idx", F.row_number().over(W.partitionBy("song_id").orderBy("__at")).cast("long") - 1)).drop("__at")
    return raw.withColumn("midi", M.note_to_midi(F.col("note")).cast("int"))


def read_beats(spark: SparkSession, path: str, fmt: str = "parquet", songs: DataFrame | None = None) -> DataFrame:
    """Beats (song_id, beat_idx, time, and bpm if known). JSON: one {bpm, beat_times} a file, whose song the manifest names."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = S.placed(_json(spark, path, "song_id bigint, bpm double, beat_times array<double>"), songs)
    return raw.select("song_id", "bpm", F.posexplode("beat_times").alias("i", "time")).select("song_id", F.col("i").cast("long").alias("beat_idx"), "time", "bpm")


def songs_of(frames: DataFrame) -> DataFrame:
    """(song_id, and source if the frames have one): the songs of a table of frames, by which other files find them."""
    return frames.groupBy("song_id").agg(F.min("source").alias("source")) if "source" in frames.columns else frames.select("song_id").distinct()


def notes_as_frames(notes: DataFrame) -> DataFrame:
    """Frames from a pitch model's notes (song_id, start_time, midi, amplitude): the start, the pitch in Hz, the amplitude, in order of time."""
    w = W.partitionBy("song_id").orderBy("start_time", "midi", "amplitude")
    seq = (F.row_number().over(w).cast("long") - 1).alias("seq")
    return notes.select("song_id", seq, F.col("start_time").alias("time"), M.midi_to_hz(F.col("midi")).alias("frequency"), F.col("amplitude").alias("confidence"))


def parse_lrc(lines: DataFrame) -> DataFrame:
    """(song_id, line_no, ts, text) from (song_id, line_no, line): timed lines with words; tags and all else are left out."""
    line = M.stripped(F.col("line"))
    tag = F.lit(False)
    for t in M.LRC_TAGS:
        tag = tag | line.startswith(t)
    named = ["source"] if "source" in lines.columns else []
    found = lines.where((line != "") & ~tag).select("song_id", "line_no", M.lrc_timestamp(line).alias("ts"), M.lrc_text(line).alias("text"), *named)
    return found.where("ts is not null and text <> ''")


def parse_lrc_content(contents: DataFrame, column: str = "content") -> DataFrame:
    """The same from (song_id, content) with whole files as strings; empty content gives no rows."""
    named = ["source"] if "source" in contents.columns else []
    return parse_lrc(contents.select("song_id", *named, F.posexplode(F.split(column, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long")))


def lrc_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): LRC files with their texts. ValueError for another suffix."""
    if not path.lower().rstrip("/*").endswith(".lrc") and "*" not in path and not _is_folder(spark, path):
        raise ValueError(f"lyrics must be .lrc files: {path}")
    found = spark.read.option("wholetext", True).option("pathGlobFilter", "*.lrc").option("recursiveFileLookup", True).text(path)
    return found.select(S.file_path().alias("path"), "value")


def read_lrc(spark: SparkSession, path: str, require: bool = True, songs: DataFrame | None = None) -> DataFrame:
    """Lyrics of LRC files of the songs that the manifest names; without one each file is a song (``source``: the file's name). ValueError for another suffix or if no line is left."""
    files = S.placed(lrc_files(spark, path), songs, F.col("path"))
    found = parse_lrc_content(files.select("song_id", "source", F.regexp_replace("value", "\r\n?", "\n").alias("content")))
    if require and found.isEmpty():
        raise ValueError(f"no timed lyrics in {path}")
    return found


def lrc_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error): LRC files in which there is no timed line, so that their songs stay without lyrics."""
    files = lrc_files(spark, path)
    good = parse_lrc_content(files.select(F.col("path").alias("song_id"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))).select(F.col("song_id").alias("path")).distinct()
    error = F.when(F.trim("value") == "", "the file is empty").otherwise("no timed lines")
    return files.join(good, "path", "left_anti").select("path", error.alias("error"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def read_audio(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """(path, modificationTime, length, content) of audio files, for a model that turns them into frames elsewhere."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def stem_paths(song: str, root: str = "separated/htdemucs") -> dict[str, str]:
    """Paths of the separated vocals and of the rest, from a song's path or its vocals'. FileNotFoundError names all that are missing."""
    p = Path(song)
    folder = p.parent if p.stem == "vocals" else Path(root) / p.stem
    found = {"vocals": folder / "vocals.wav", "other": folder / "other.wav"}
    if missing := [str(x) for x in found.values() if not x.exists()]:
        raise FileNotFoundError("missing stems: " + ", ".join(missing))
    return {k: str(v) for k, v in found.items()}


def load_config(path: str = "quaver.toml", table: str = "quaver") -> dict:
    """Options of one TOML table; none if file or table is missing, ValueError if the syntax is wrong."""
    file = Path(path)
    if not file.exists():
        return {}
    try:
        return tomllib.loads(file.read_text(encoding="utf-8")).get(table, {})
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path} is not valid TOML: {e}") from e
