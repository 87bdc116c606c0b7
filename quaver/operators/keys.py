"""Musical keys: how many events of a song lie in each scale, the three best, and the filter by the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import music as M

UNKNOWN = "Unknown"
#: Below this share of events in the best key, the key filter lets everything through.
MIN_SCORE = 0.6


def _ranked(counts: list[Column], total: Column) -> Column:
    """The three best keys (misses, rank, key, score, scale) from the counts of the twelve pitch classes; ties by rank."""
    keys = []
    for rank, (key, pcs) in enumerate(M.scales()):
        hits = sum((counts[p] for p in pcs[1:]), counts[pcs[0]])
        keys.append(F.struct((total - hits).alias("misses"), F.lit(rank).alias("rank"), F.lit(key).alias("key"), (hits / total).alias("score"), F.array(*map(F.lit, pcs)).alias("scale")))
    return F.slice(F.array_sort(F.array(*keys)), 1, 3)


def histogram() -> list[Column]:
    """Aggregates: how many events there are, and how many of each pitch class."""
    pc = M.pitch_class(F.col("midi"))
    return [F.count("midi").alias("__n"), *(F.count_if(pc == i).alias(f"__{i}") for i in range(12))]


def best_keys() -> list[Column]:
    """key, score and candidates from ``histogram``."""
    ranked = _ranked([F.col(f"__{i}") for i in range(12)], F.col("__n"))
    best = F.get(ranked, F.lit(0))
    slim = F.transform(ranked, lambda k: F.struct(k["key"].alias("key"), k["score"].alias("score")))
    return [best["key"].alias("key"), best["score"].alias("score"), slim.alias("candidates")]


def detect_key(events: DataFrame, songs: DataFrame | None = None) -> DataFrame:
    """(song_id, key, score, candidates): one aggregation by song. ``songs``: songs without events get key Unknown."""
    found = events.where(F.col("midi").isNotNull()).groupBy("song_id").agg(*histogram()).select("song_id", *best_keys())
    if songs is None:
        return found
    none = F.array().cast("array<struct<key: string, score: double>>")
    every = songs.select("song_id").distinct().join(found, "song_id", "left")
    filled = {"key": F.lit(UNKNOWN), "score": F.lit(0.0), "candidates": none}
    return every.select("song_id", *(F.coalesce(c, other).alias(c) for c, other in filled.items()))


def scale_of(key: Column) -> Column:
    """Pitch classes of a key; null for a name that is none."""
    table = F.create_map(*(x for k, pcs in M.scales() for x in (F.lit(k), F.array(*map(F.lit, pcs)))))
    return F.try_element_at(table, key)


def filter_by_key(events: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Events of the song's key. A weak or unknown key lets all through.

    Without ``keys`` the key comes from the events themselves, by windows on the song: no
    exchange beyond the one that segmentation made.
    """
    pc = M.pitch_class(F.col("midi"))
    if keys is None:
        w = W.partitionBy("song_id")
        counted = events.withColumns({"__n": F.count("midi").over(w)} | {f"__{i}": F.count_if(pc == i).over(w) for i in range(12)})
        masks = list(dict.fromkeys((pcs, sum(1 << p for p in pcs)) for pcs in (tuple(sorted(pcs)) for _, pcs in M.scales())))  # a minor key has its major's notes
        hits = F.array(*(sum((F.col(f"__{p}") for p in pcs[1:]), F.col(f"__{pcs[0]}")) for pcs, _ in masks))
        best = F.array_max(hits)
        mask = F.element_at(F.array(*(F.lit(m) for _, m in masks)), F.array_position(hits, best).cast("int"))
        bit = F.when(pc >= 0, F.call_function("shiftright", mask, pc).bitwiseAND(F.lit(1)) == 1).otherwise(F.lit(False))
        return counted.where((best / F.col("__n") < F.lit(MIN_SCORE)) | bit).select(*events.columns)
    judged = events.join(keys.select("song_id", F.col("score").alias("__score"), scale_of(F.col("key")).alias("__scale")), "song_id", "left")
    free = F.col("__scale").isNull() | (F.col("__score") < F.lit(MIN_SCORE))
    return judged.where(free | F.array_contains("__scale", pc)).select(*events.columns)
