"""A file for each song, in the exact format of one song's text, written by all tasks.

``write`` deals the events by song and sorts them, and a Python data source writes them: each
task holds a song's row at a time, whatever the song's length. Files are first written in a
staging folder of the attempt (``_staging-<id>/<attempt>``); only when all tasks are done does the driver move
those of the attempts that count into place, as Spark's own file committer does. A failed or
repeated task leaves no part of a file, a failed job leaves the folder as it was.

Paths are those that pyarrow opens (local, hdfs, s3, gs): executors and driver must share the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, groupby

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..operators import leadsheet
from . import sinks

SUFFIX = {"csv": ".csv", "json": ".json", "table": ".txt", "leadsheet": ".txt"}
DONE = "_SUCCESS"
NAME, WIDTHS = "__name", "__widths"
#: Files that the driver moves at a time.
MOVERS = 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class SongFilesWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.kind, self.columns, self.overwrite = path.rstrip("/"), kind, columns, overwrite
        self.stage = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        attempt = str(TaskContext.get().taskAttemptId())
        where, stage = opened(self.stage)
        n = 0
        for name, rows in groupby(iterator, key=lambda r: r[NAME]):
            target = f"{stage}/{attempt}/{name}{SUFFIX[self.kind]}"
            where.create_dir(target.rpartition("/")[0], recursive=True)
            with where.open_output_stream(target, compression=None) as out:
                for piece in self.pieces(rows):
                    out.write(piece.encode())
            n += 1
        return Written(attempt, n)

    def pieces(self, rows: Iterator) -> Iterator[str]:
        if self.kind == "leadsheet":
            return (r["text"] for r in rows)
        first = next(rows)
        shown = ({c: v for c, v in r.asDict(recursive=True).items() if c in self.columns} for r in chain((first,), rows))
        if self.kind == "table":
            return sinks.table_pieces(shown, first[WIDTHS])
        return sinks.csv_pieces(shown) if self.kind == "csv" else sinks.json_pieces(shown)

    def commit(self, messages: list) -> None:
        where, root = opened(self.path)
        stage = opened(self.stage)[1]
        where.create_dir(root, recursive=True)
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(root)):
                if old.path.rstrip("/") != stage:
                    where.delete_dir(old.path) if old.type == fs.FileType.Directory else where.delete_file(old.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if m is not None and m.files:
                    base = f"{stage}/{m.attempt}"
                    found = where.get_file_info(fs.FileSelector(base, recursive=True))
                    list(pool.map(lambda f, base=base: self._move(where, f, base, root), (f for f in found if f.type == fs.FileType.File)))
        self._unstage()
        with where.open_output_stream(f"{root}/{DONE}"):
            pass

    @staticmethod
    def _move(where: fs.FileSystem, file: fs.FileInfo, base: str, root: str) -> None:
        target = root + file.path[file.path.index(base) + len(base) :]
        where.create_dir(target.rpartition("/")[0], recursive=True)
        where.move(file.path, target)

    def abort(self, messages: list) -> None:
        self._unstage()

    def _unstage(self) -> None:
        where, stage = opened(self.stage)
        if where.get_file_info(stage).type == fs.FileType.Directory:
            where.delete_dir(stage)


class SongFiles(DataSource):
    """``df.write.format("songfiles")`` of rows that ``write`` prepares."""

    @classmethod
    def name(cls) -> str:
        return "songfiles"

    def schema(self) -> str:
        return f"{NAME} string"

    def writer(self, schema: StructType, overwrite: bool) -> SongFilesWriter:
        columns = [c for c in schema.names if c not in (NAME, WIDTHS)]
        return SongFilesWriter(self.options["path"], self.options["kind"], columns, overwrite)


def file_names(songs: DataFrame) -> DataFrame:
    """(song_id, __name): the song's name, folders and all; ``name=id`` for songs that share one, upper and lower case alike, and ``song=id`` for those without.

    No part of a name is empty, hidden or leads elsewhere, and characters that file systems refuse, and ``=``, become ``_``.
    """
    ids = F.coalesce(F.col("song_id").cast("string"), F.lit("null"))
    parts = F.split(F.regexp_replace(F.min("source"), r'[\\:*?"<>|=\x00-\x1F\x7F]', "_"), "/")
    clean = F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.regexp_replace(p, "^[._]+", "-")), "/")
    named = songs.groupBy("song_id").agg(F.nullif(clean, F.lit("")).alias("source"))
    same = F.count("song_id").over(W.partitionBy(F.lower("source"))) > 1
    shared = F.concat(F.coalesce("source", F.lit("song")), F.lit("="), ids)
    return named.select("song_id", F.when(F.col("source").isNull() | same, shared).otherwise(F.col("source")).alias(NAME))


def prepared(events: DataFrame, kind: str, songs: DataFrame | None = None) -> DataFrame:
    """The rows that the source writes: a song's in one partition, in order."""
    if kind == "leadsheet":
        rows = leadsheet.sheets(events)
        shown, order = ["text"], []
    else:
        shown, order, rows = sinks.public_columns(events), ["event_idx"], events
        if kind == "table":
            rows = rows.withColumn(WIDTHS, sinks.table_widths(events))
            shown = [*shown, WIDTHS]
    ids = F.coalesce(F.col("song_id").cast("string"), F.lit("null"))
    if songs is not None and "source" in songs.columns:
        rows = rows.join(file_names(songs), "song_id", "left").withColumn(NAME, F.coalesce(NAME, F.concat(F.lit("song="), ids)))
    else:
        rows = rows.withColumn(NAME, ids)
    return rows.repartition(NAME).sortWithinPartitions(NAME, *order).select(NAME, *shown)


def write(events: DataFrame, path: str, format_type: str = "csv", songs: DataFrame | None = None, mode: str = "error") -> None:
    """``<path>/<song>.csv`` (json; txt for tables and leadsheets), each byte for byte what ``sinks.output`` writes for that song alone.

    songs: (song_id, source), as ``readers.songs_of`` gives it, for names; without it files are named by id. Songs without events
    have no file. mode: ``error`` if the folder has files, ``append`` (a song's older file is replaced) or ``overwrite``.
    """
    kind = format_type.lower()
    if kind not in SUFFIX:
        raise ValueError(f"format {format_type!r} is none of {', '.join(SUFFIX)}")
    if mode not in ("error", "append", "overwrite"):
        raise ValueError(f"mode {mode!r} is none of error, append, overwrite")
    where, root = opened(path)
    if mode == "error" and where.get_file_info(root).type == fs.FileType.Directory and where.get_file_info(fs.FileSelector(root)):
        raise ValueError(f"{path} has files already")
    events.sparkSession.dataSource.register(SongFiles)
    prepared(events, kind, songs).write.format("songfiles").option("path", path).option("kind", kind).mode("overwrite" if mode == "overwrite" else "append").save()
