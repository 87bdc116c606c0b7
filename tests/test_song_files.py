"""A file for each song: the bytes of the one-song text, and nothing of what failed."""

import random

import pytest
from pyspark.sql import functions as F
from test_notes import events
from test_sources import args_of, song_files

from quaver import __main__ as cli
from quaver.sources import sinks
from quaver.sources import song_files as SF

WORDS = ["", "la", 'wör"ld, x', "two\nlines", "a b", "日本 語", None, "x\\y"]


def many(spark):
    rng = random.Random(4)
    songs = [[(rng.randint(40, 80), t, t + rng.choice((0.0, 0.00001, 1e7)), rng.random()) for t in sorted(rng.uniform(0, 9) for _ in range(rng.choice((1, 2, 40))))] for _ in range(12)]
    df = events(spark, *songs)
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_idx") % len(WORDS) + 1).cast("int"))
    return df.withColumn("lyric", word).withColumn("chord_fit", F.col("event_idx") % 2 == 0).withColumn("n", F.when(F.col("event_idx") > 0, F.col("midi"))).repartition(5)


def found(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.mark.parametrize("kind", ["csv", "json", "table", "leadsheet"])
def test_bytes(spark, tmp_path, kind):
    df = many(spark).cache()
    SF.write(df, str(tmp_path / "o"), kind.upper())
    made = found(tmp_path / "o")
    assert made.pop("_SUCCESS") == b""
    assert made == {f"{s}{SF.SUFFIX[kind]}": sinks.output(df, kind, song_id=s).encode() for s in range(12)}


def test_modes(spark, tmp_path):
    df, root = many(spark).cache(), tmp_path / "o"
    SF.write(df.where("song_id < 3"), str(root), "csv")
    with pytest.raises(ValueError):
        SF.write(df, str(root), "csv")
    with pytest.raises(ValueError):
        SF.write(df, str(root), "xml")
    with pytest.raises(ValueError):
        SF.write(df, str(root), "csv", mode="ignore")
    SF.write(df.where("song_id in (2, 5) and event_idx = 0"), f"file://{root}", "csv", mode="append")
    assert set(found(root)) == {"0.csv", "1.csv", "2.csv", "5.csv", "_SUCCESS"} and found(root)["2.csv"].count(b"\r\n") == 2
    SF.write(df.where("song_id = 7"), str(root), "json", mode="overwrite")
    assert set(found(root)) == {"7.json", "_SUCCESS"}
    SF.write(df.limit(0), str(tmp_path / "none"), "table")
    assert set(found(tmp_path / "none")) == {"_SUCCESS"}


def test_failed_task(spark, tmp_path):
    """A task that fails after others have written leaves the folder as it was."""
    root = tmp_path / "o"
    df = many(spark)
    SF.write(df.where("song_id = 1"), str(root), "csv")
    before = found(root)
    broken = df.withColumn("n", F.when((F.col("song_id") == 9) & (F.col("event_idx") >= 0), F.raise_error(F.lit("broken row")).cast("int")).otherwise(F.col("n")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken row"):
            SF.write(broken, str(root), "csv", mode=mode)
        assert found(root) == before and [p.name for p in root.iterdir() if p.is_dir()] == []


def test_names(spark):
    names = [(1, "a/b"), (2, "A/B"), (3, None), (4, "../../etc/x"), (5, "/.hid//_s/q?:=1"), (6, "///"), (7, "song"), (8, "one"), (8, "two"), (None, "n")]
    made = {r.song_id: r[SF.NAME] for r in SF.file_names(spark.createDataFrame(names, "song_id bigint, source string")).collect()}
    assert made == {1: "a/b=1", 2: "A/B=2", 3: "song=3", 4: "-/-/etc/x", 5: "-hid/-s/q___1", 6: "song=6", 7: "song", 8: "one", None: "n"}


def test_command_line(spark, tmp_path):
    song_files(tmp_path, ["One Song", "live/b.c"])
    for names, out in ((None, "o"), (["--songs", str(tmp_path / "songs.csv")], "p")):
        if names:
            (tmp_path / "songs.csv").write_text("kind,path,song_id\nframes,One Song.json,4\nframes,live/b.c.json,5\n")
        assert cli.main(args_of(tmp_path, "--format", "leadsheet", "--file-per-song", "--output", str(tmp_path / out), *(names or [])), spark) == 0
    made = found(tmp_path / "o")
    assert made == {"One Song.txt": b"line of One Song\nA4", "live/b.c.txt": b"line of live/b.c\nA#4", "_SUCCESS": b""}
    assert len(found(tmp_path / "p")) == 3
