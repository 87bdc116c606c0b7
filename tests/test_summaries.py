"""Summary states: parts merged are the whole, and a batch counts once."""

import random

import pytest
from pyspark.sql import functions as F
from test_notes import events

from quaver.plans import summaries
from quaver.plans import transcribe as T


def many(spark):
    rng = random.Random(6)
    songs = [[(rng.randint(0, 90), t, t + 0.1, 0.9) for t in sorted(rng.uniform(0, 50) for _ in range(rng.choice((1, 7, 60))))] for _ in range(9)]
    df = events(spark, *songs)
    flags = {c: F.pmod(F.hash("song_id", "event_idx", F.lit(i)), F.lit(2)) == 0 for i, c in enumerate(summaries.FLAGS)}
    return df.withColumns(flags | {"lyric": F.when(F.col("event_idx") % 3 == 0, "la"), "midi": F.when(F.col("event_idx") % 11 != 5, F.col("midi"))}).cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_parts(spark):
    df = many(spark)
    whole, parts = rows(T.song_summary(df)), [df.where(F.pmod(F.hash("event_idx"), F.lit(3)) == i) for i in range(3)]
    a, b, c = map(summaries.state, parts)
    assert rows(summaries.finished(summaries.merged(a, b, c))) == whole
    assert rows(summaries.finished(summaries.merged(summaries.merged(c, a), b))) == whole
    assert rows(summaries.finished(summaries.merged(summaries.state(df), a.limit(0)))) == whole
    assert rows(summaries.finished(summaries.merged(summaries.state(df, "note")))) == whole
    plan = summaries.merged(summaries.state(df, "note"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan


def test_states_of_different_columns(spark):
    df = many(spark)
    both = summaries.merged(summaries.state(df.drop("lyric", *summaries.FLAGS)), summaries.state(df))
    made = {r.song_id: r for r in summaries.finished(both).collect()}
    for r in T.song_summary(df).collect():
        assert (made[r.song_id].n_notes, made[r.song_id].n_lyric, made[r.song_id].key) == (2 * r.n_notes, r.n_lyric, r.key)
    assert summaries.finished(summaries.state(df.limit(0)), df.select("song_id").limit(1)).select("n_notes", "key").first()[:] == (0, "Unknown")


def test_stored_batches(spark, tmp_path):
    df, path = many(spark), str(tmp_path / "s")
    with pytest.raises(ValueError):
        summaries.stored(spark, path)
    summaries.add(df.where("song_id < 4 or event_idx % 2 = 0").drop("lyric"), path, 0)
    summaries.add(df.where("song_id < 4 or event_idx % 2 = 0"), path, 0)  # the repeated batch replaces itself
    summaries.add(df.where("song_id >= 4 and event_idx % 2 = 1"), path, 1)
    summaries.add(df.limit(0), path, 2)
    whole = rows(T.song_summary(df))
    assert rows(summaries.finished(summaries.stored(spark, path))) == whole
    summaries.compacted(spark, path, str(tmp_path / "t"))
    assert rows(summaries.finished(summaries.stored(spark, str(tmp_path / "t")))) == whole
