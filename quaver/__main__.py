"""Command line: transcribe tables of pitch frames.

    python -m quaver --frames frames.parquet --lyrics songs/ --format leadsheet --output notes.txt

One song gives one text or file, as its format says. Of several songs, ``--output`` names
a folder, which all tasks write, with the summaries beside it; without it their lines
are printed song by song. With ``--file-per-song`` the folder has a file for each song, the same
as for that song alone. Files of one name (frames, second frames, beats, lyrics) are
one song, or ``--songs`` says which are; a file without a song, and a song without a file, are warnings. Options that are not given come from the [quaver] table of
quaver.toml.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .operators import align
from .plans import transcribe as T
from .sources import readers, sinks, song_files
from .sources import songs as S


def parser(config: dict) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quaver", description="Notes from pitch frames.")
    p.add_argument("--frames", required=True, help="Parquet or JSON of (song_id, seq, time, frequency, confidence)")
    p.add_argument("--json", action="store_true", help="frames and beats are JSON files, one for each song")
    p.add_argument("--songs", help="CSV with a header, or Parquet, of (kind, path, song_id): the songs of files of frames, second, beats and lyrics; by default files of one name are one song")
    p.add_argument("--second-frames", help="frames of a second estimator")
    p.add_argument("--dual-pitch", action="store_true", default=config.get("dual_pitch", False), help="compare with the second estimator (implied by --second-frames)")
    p.add_argument("--chords", help="Parquet of (song_id, chord_idx, time, chord_notes)")
    p.add_argument("--chroma", help="Parquet of (song_id, frame, pc, energy): chords between the beats are found in it")
    p.add_argument("--chord-context", action="store_true", default=config.get("chord_context", False), help="compare with the chords (implied by --chords and --chroma)")
    p.add_argument("--beats", help="Parquet or JSON of (song_id, beat_idx, time, bpm)")
    p.add_argument("--lyrics", help="LRC file or folder")
    p.add_argument("--confidence", type=float, default=config.get("confidence", 0.85))
    p.add_argument("--transpose", type=int, default=config.get("transpose", 9))
    p.add_argument("--output", default=config.get("output"))
    p.add_argument("--file-per-song", action="store_true", default=config.get("file_per_song", False), help="--output is a folder with a file for each song")
    p.add_argument("--format", choices=sinks.FORMATS, default=config.get("format", "table"))
    p.add_argument("--no-key-filter", dest="key_filter", action="store_false", default=config.get("key_filter", True))
    p.add_argument("--no-smooth", dest="smooth", action="store_false", default=config.get("smooth", True))
    return p


def _warn(text: str) -> None:
    print(f"warning: {text}", file=sys.stderr)


#: How many files or songs a warning names.
NAMED = 10


def _name_some(df: DataFrame, text: str) -> None:
    """A warning for each of the first rows, and the number of all."""
    some = df.orderBy(df.columns[-1]).limit(NAMED).collect()
    for row in some:
        _warn(text.format(*row))
    if len(some) == NAMED and (n := df.count()) > NAMED:
        _warn(f"... {n} in all")


class Songs:
    """The songs of the frames, and the manifests of the files that go with them."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace) -> None:
        self.spark, self.json = spark, args.json
        self.given = None
        if args.songs:
            self.given = spark.read.parquet(args.songs) if args.songs.endswith(".parquet") else spark.read.option("header", True).csv(args.songs)
        own = None
        if args.json:
            listed = S.files(spark, "frames", args.frames)
            own = S.by_manifest(listed, self.given) if self.given is not None else S.own_songs(listed)
            _name_some(S.strays(own), "no song for {0}: {1}")
        self.frames = readers.read_frames(spark, args.frames, "json" if args.json else "parquet", own)
        self.all = readers.songs_of(self.frames)
        self.known = self.all.withColumnRenamed("source", "song")
        self.one = self.all.limit(2).count() == 1

    def of(self, kind: str, path: str) -> DataFrame:
        """The manifest of these files; what has no partner is a warning."""
        found = S.manifest(S.files(self.spark, kind, path), self.known, self.given)
        _name_some(S.strays(found), "no song for {0}: {1}")
        _name_some(S.without(self.known, found), f"no {kind} for song {{{len(self.known.columns) - 1}}}")
        return found


def _second(spark: SparkSession, args: argparse.Namespace, songs: Songs) -> DataFrame | None:
    if args.second_frames:
        return readers.read_frames(spark, args.second_frames, "json", songs.of("second", args.second_frames)) if args.json else readers.read_frames(spark, args.second_frames)
    if args.dual_pitch:
        _warn("no --second-frames to compare with")
    return None


def _beats(spark: SparkSession, args: argparse.Namespace, songs: Songs) -> DataFrame | None:
    if not args.beats:
        return None
    return readers.read_beats(spark, args.beats, "json", songs.of("beats", args.beats)) if args.json else readers.read_beats(spark, args.beats)


def _chords(spark: SparkSession, args: argparse.Namespace, beats: DataFrame | None) -> DataFrame | None:
    if args.chords:
        return spark.read.parquet(args.chords)
    if args.chroma and beats is not None:
        return align.chord_timeline(spark.read.parquet(args.chroma), beats)
    if args.chroma or args.chord_context:
        _warn("chords need --chords, or --chroma with --beats")
    return None


def _lyrics(spark: SparkSession, path: str | None, songs: Songs) -> DataFrame | None:
    """The lyrics; what cannot be read is a warning, and the notes stay without them."""
    if not path:
        return None
    try:
        readers.lrc_files(spark, path)
        lyrics = readers.read_lrc(spark, path, songs=songs.of("lyrics", path))
        _name_some(readers.lrc_errors(spark, path).select("error", "path"), "lyrics could not be read: {0}: {1}")
    except (ValueError, AnalysisException) as e:
        _warn(f"lyrics could not be read: {e}")
        return None
    return lyrics.drop("source")


def _summary(row) -> str:
    shown = {k: v for k, v in row.asDict().items() if v is not None}
    if "bpm" in shown:
        shown["bpm"] = f"{shown['bpm']:.1f}"
    return ", ".join(f"{k}: {v}" for k, v in shown.items())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser(readers.load_config()).parse_args(argv)
    if not 0 <= args.confidence <= 1:
        print(f"confidence must lie between 0 and 1: {args.confidence}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("quaver").getOrCreate()
    try:
        songs = Songs(spark, args)
        one, beats = songs.one, _beats(spark, args, songs)
        events = T.transcribe(
            songs.frames, confidence_threshold=args.confidence, transpose=args.transpose, apply_key_filter=args.key_filter, smooth=args.smooth,
            second_frames=_second(spark, args, songs), chords=_chords(spark, args, beats),
            grid=align.beat_subdivisions(beats) if beats is not None else None, lyrics=_lyrics(spark, args.lyrics, songs),
        )
        summary = T.song_summary(events, songs.all, align.tempo(beats) if beats is not None else None)
        if args.output and (args.file_per_song or not one):
            if args.file_per_song:
                song_files.write(events, args.output, args.format, songs.all)
            else:
                sinks.write(events, args.output, args.format)
            summary.write.json(f"{args.output.rstrip('/')}-summary")
            return 0
        if one:
            text = sinks.output(events, args.format, args.output)
            if text is not None:
                print(text)
        else:
            for line in sinks.lines(events, args.format):
                print(line)
        for row in summary.orderBy("song_id").toLocalIterator():
            print(_summary(row), file=sys.stderr)
    except (ValueError, FileNotFoundError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
