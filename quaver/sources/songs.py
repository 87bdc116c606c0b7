"""The song manifest: which files belong to which song.

A song's frames, second frames, beats and lyrics lie in files of their own. A manifest is a
table (kind, path, song_id, song): by default a file belongs to the song of the same name,
which is its path below the folder that was given, without extensions (``live/01.json``,
``live/01.lrc`` and ``live/01.beats.json`` are one song), or that song's id as a number. A user may give
(kind, path, song_id) instead. Every reader of such files meets it on the file's path by an equi join,
so it may be as long as there are files. A null song_id marks a file without a song.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music as M

KINDS = ("frames", "second", "beats", "lyrics", "chords", "chroma")
GLOBS = {"lyrics": "*.lrc"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as files of it are named; no other file is looked at."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.removeprefix("file:").rstrip("/")


def file_path() -> Column:
    """The path of the file a row comes from, without escapes."""
    return F.regexp_replace(M.unescaped(F.col("_metadata.file_path")), "^file:/*/", "/")


def song_name(relative: Column) -> Column:
    """A path below the folder without extension, and without one that names a kind before it."""
    return F.regexp_replace(F.regexp_replace(relative, r"\.[^./\\]+$", ""), rf"(?i)\.(?:{'|'.join(KINDS)})$", "")


def below(path: Column, root: str) -> Column:
    """The part of a path below a folder; a file's name where the root is the file or a pattern."""
    inside = F.when(path.startswith(F.lit(root + "/")), F.substr(path, F.lit(len(root) + 2)))
    return F.coalesce(inside, M.base_name(path))


def files(spark: SparkSession, kind: str, path: str, glob: str | None = None) -> DataFrame:
    """(kind, path, relative, song) of the files of a folder, a pattern or a file; contents are not read."""
    glob = glob or GLOBS.get(kind, "*")
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    named = found.select(F.lit(kind).alias("kind"), file_path().alias("path"))
    return named.withColumn("relative", below(F.col("path"), qualified(spark, path))).withColumn("song", song_name(F.col("relative")))


def own_songs(listed: DataFrame) -> DataFrame:
    """The manifest of frames: each file is a song of its own, with an id that its name gives."""
    return listed.select("kind", "path", F.xxhash64("song").alias("song_id"), "song")


def by_manifest(listed: DataFrame, given: DataFrame) -> DataFrame:
    """The manifest that a user's (kind, path, song_id) gives; its paths are whole, or below the folder. A null kind is any. Of several rows for one file the smallest id counts."""
    rows = given.select(F.col("kind").alias("gk"), F.regexp_replace("path", "^file:/*/", "/").alias("key"), F.col("song_id").cast("long").alias("gid"))
    keys = listed.withColumn("key", F.explode(F.array_distinct(F.array("path", "relative"))))
    met = keys.join(rows.where("key is not null and gid is not null"), "key", "left").where(F.col("gk").isNull() | (F.col("gk") == F.col("kind")))
    found = met.groupBy("kind", "path").agg(F.min("gid").alias("song_id"))
    return listed.join(found, ["kind", "path"], "left").select("kind", "path", "song_id", "song")


def by_name(listed: DataFrame, known: DataFrame) -> DataFrame:
    """The manifest of files that have the name, or as name the id, of a known song (song_id, and song where it has a name). Names come before ids; of several songs of one name the smallest id counts."""
    name = F.col("song") if "song" in known.columns else F.lit(None).cast("string")
    keys = known.select("song_id", F.explode(F.array(F.struct(name.alias("song"), F.lit(0).alias("o")), F.struct(F.col("song_id").cast("string").alias("song"), F.lit(1).alias("o")))).alias("k"))
    keys = keys.where("k.song is not null").groupBy(F.col("k.song").alias("song")).agg(F.min(F.struct("k.o", "song_id")).alias("m"))
    return listed.join(keys, "song", "left").select("kind", "path", F.col("m.song_id").alias("song_id"), "song")


def manifest(listed: DataFrame, known: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(kind, path, song_id, song) of the files of one kind. A single file and a single song belong together, whatever they are called."""
    if given is not None:
        return by_manifest(listed, given)
    found = by_name(listed, known)
    if known.limit(2).count() == 1 and listed.limit(2).count() == 1:
        found = found.withColumn("song_id", F.lit(known.first()["song_id"]))
    return found


def placed(rows: DataFrame, songs: DataFrame | None, path: Column | None = None) -> DataFrame:
    """Rows of files with their song's id (``song_id``, where the rows do not bring their own) and name (``source``); without a manifest each file is a song of its own. Rows without a song go."""
    at = rows.withColumn("__path", file_path() if path is None else path)
    own = F.col("song_id") if "song_id" in rows.columns else F.lit(None).cast("long")
    if songs is None:
        return at.withColumn("source", M.base_name(F.col("__path"))).withColumn("song_id", F.coalesce(own, F.xxhash64("__path"))).drop("__path")
    by = songs.select(F.col("path").alias("__path"), F.col("song_id").alias("__song"), F.col("song").alias("source"))
    met = at.join(by, "__path", "left").withColumn("song_id", F.coalesce(own, "__song"))
    return met.where(F.col("song_id").isNotNull()).drop("__path", "__song")


def strays(songs: DataFrame) -> DataFrame:
    """(kind, path) of files that belong to no song."""
    return songs.where(F.col("song_id").isNull()).select("kind", "path")


def without(known: DataFrame, songs: DataFrame) -> DataFrame:
    """The songs that have no file in a manifest."""
    return known.join(songs.where(F.col("song_id").isNotNull()).select("song_id").distinct(), "song_id", "left_anti")
