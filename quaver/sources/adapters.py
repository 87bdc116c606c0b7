"""Music tables derived from the relational test tables, by arithmetic that any SQL engine repeats exactly.

``*_SQL`` are the same tables as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import music as M

#: Orders and conversations of a song: songs keep their size, and their number grows with the tables.
ORDERS, CONVERSATIONS = 150, 2
STEPS = (0, 2, 4, 5, 7, 9, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch frames from lineitem: neighbouring orders are a song, each a run of frames 40 ms apart."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    w = W.partitionBy("song_id").orderBy(*key)
    rows = table(spark, sf_dir, "lineitem").withColumn("song_id", F.floor(F.col("l_orderkey") / F.lit(ORDERS)))
    before = F.lag("l_orderkey").over(w)
    order = F.col("l_orderkey") % ORDERS
    rows = rows.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("step", F.when((before != F.col("l_orderkey")) & (order % 3 == 0), 750).otherwise(40))
    ms = F.sum("step").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    jump = F.when(F.col("l_quantity") >= 49, 24).when(F.col("l_quantity") <= 2, 1).otherwise(0)
    midi = F.lit(60) + F.col("song_id") % 12 + F.element_at(F.array(*map(F.lit, STEPS)), (order % 7 + 1).cast("int")) + jump
    tuned = midi + (F.col("l_tax") * 5 - 0.2)
    return rows.select("song_id", "seq", (ms.cast("double") / 1000.0).alias("time"), M.midi_to_hz(tuned).alias("frequency"), (F.lit(1.0) - F.col("l_discount") * 2).alias("confidence"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))


FRAMES_SQL = """
lines AS (SELECT l_orderkey // 150 AS song_id, row_number() OVER w AS seq, CASE WHEN lag(l_orderkey) OVER w <> l_orderkey AND (l_orderkey % 150) % 3 = 0 THEN 750 ELSE 40 END AS step, * FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey // 150 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)),
frames AS (SELECT song_id, seq, CAST(sum(step) OVER (PARTITION BY song_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(1000 AS DOUBLE) AS time,
  CAST(440 AS DOUBLE) * pow(CAST(2 AS DOUBLE), (60 + song_id % 12 + [0, 2, 4, 5, 7, 9, 11][CAST((l_orderkey % 150) % 7 + 1 AS INT)] + CASE WHEN l_quantity >= 49 THEN 24 WHEN l_quantity <= 2 THEN 1 ELSE 0 END + (l_tax * 5 - CAST(0.2 AS DOUBLE)) - CAST(69 AS DOUBLE)) / CAST(12 AS DOUBLE)) AS frequency,
  CAST(1 AS DOUBLE) - l_discount * 2 AS confidence, l_returnflag AS returnflag, l_linestatus AS linestatus FROM lines)"""


def second_frames(frames: DataFrame) -> DataFrame:
    """A second estimator's frames: some of the first's, in or out of tune."""
    shift = F.when(F.col("returnflag") == "N", 0.2).otherwise(1.0)
    return frames.where("linestatus = 'O'").select("song_id", "seq", "time", (F.col("frequency") * F.pow(F.lit(2.0), shift / 12.0)).alias("frequency"), "confidence")


SECOND_SQL = """
second AS (SELECT song_id, time, frequency * pow(CAST(2 AS DOUBLE), CASE WHEN returnflag = 'N' THEN CAST(0.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END / CAST(12 AS DOUBLE)) AS frequency FROM frames WHERE linestatus = 'O')"""


def frame_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song_id, end): the last frame's time of each song in ``frames``. Steps add up in any order, so these are counts by order, without the sort by song."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = orders.withColumn("song_id", F.floor(F.col("l_orderkey") / F.lit(ORDERS)))
    long = F.col("l_orderkey") % ORDERS % 3 == 0
    # a long step leads to each such order but the song's first
    steps = F.count_if(long) - F.coalesce(F.min(F.struct("l_orderkey", long.alias("long")))["long"].cast("long"), F.lit(0))
    return orders.groupBy("song_id").agg(((F.sum("n") * 40 + steps * 710).cast("double") / 1000.0).alias("end"))


def beats(frames: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """A beat every 700 to 790 ms, by song, up to the last frame, with the tempo. ``ends`` (song_id, end): the last frames' times, where they are known."""
    ends = frames.groupBy("song_id").agg(F.max("time").alias("end")) if ends is None else ends
    ends = ends.withColumn("step", F.lit(700) + F.lit(10) * (F.col("song_id") % 10))
    count = F.floor(F.col("end") * 1000.0 / F.col("step")).cast("int")
    return ends.select("song_id", "step", F.explode(F.sequence(F.lit(0), count)).alias("i")).select("song_id", F.col("i").cast("long").alias("beat_idx"), ((F.col("i") * F.col("step")).cast("double") / 1000.0).alias("time"), (F.lit(60_000.0) / F.col("step")).alias("bpm"))


BEATS_SQL = """
beats AS (SELECT song_id, i AS beat_idx, CAST(i * step AS DOUBLE) / CAST(1000 AS DOUBLE) AS time, CAST(60000 AS DOUBLE) / step AS bpm FROM (SELECT song_id, step, unnest(range(0, CAST(floor(e * 1000 / step) AS BIGINT) + 1)) AS i FROM (SELECT song_id, 700 + 10 * (song_id % 10) AS step, max(time) AS e FROM frames GROUP BY song_id)))"""


def lyric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LRC lines from conversations: each line of each turn, 1.3 s apart. The format has two digits for minutes, so lines after 100 minutes have no stamp."""
    turns = table(spark, sf_dir, "conversations").withColumn("song_id", F.floor(F.col("conv_id") / F.lit(CONVERSATIONS)))
    turns = turns.select("song_id", "conv_id", "turn", "role", "text", F.posexplode(F.split("text", "\n")).alias("pos", "words"))
    w = W.partitionBy("song_id").orderBy("conv_id", "turn", "role", "text", "pos")
    turns = turns.withColumn("line_no", F.row_number().over(w).cast("long")).withColumn("cs", F.col("line_no") * 130)
    stamp = F.format_string("[%02d:%02d.%02d]", F.floor(F.col("cs") / 6000), F.floor(F.col("cs") / 100) % 60, F.col("cs") % 100)
    return turns.select("song_id", "line_no", F.concat(stamp, F.col("words")).alias("line"))


LYRIC_LINES_SQL = """
split_turns AS (SELECT *, unnest(ws) AS words, unnest(range(len(ws))) AS pos FROM (SELECT *, string_split(text, chr(10)) AS ws FROM conversations)),
turns AS (SELECT conv_id // 2 AS song_id, row_number() OVER (PARTITION BY conv_id // 2 ORDER BY conv_id, turn, role, text, pos) AS line_no, words FROM split_turns),
lyric_lines AS (SELECT song_id, line_no, '[' || printf('%02d', line_no * 130 // 6000) || ':' || lpad(CAST((line_no * 130 // 100) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(line_no * 130 % 100 AS VARCHAR), 2, '0') || ']' || words AS line FROM turns)"""


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma frames from embeddings: a label is a song, each twelve numbers of a vector are a frame (what is left over, a shorter one)."""
    w = W.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("song_id"), (F.row_number().over(w) - 1).alias("n"), F.col("embedding").alias("e"))
    rows = rows.select("song_id", "n", F.ceil(F.size("e") / F.lit(12)).cast("int").alias("each"), F.posexplode("e").alias("p", "energy"))
    frame = F.col("n") * F.col("each") + F.floor(F.col("p") / F.lit(12)).cast("int")
    return rows.select("song_id", frame.alias("frame"), (F.col("p") % 12).alias("pc"), F.col("energy").cast("double").alias("energy"))


def chroma_beats(chroma: DataFrame, sample_rate: int = 22050) -> DataFrame:
    """A beat every quarter of a second over the chroma frames."""
    n = chroma.groupBy("song_id").agg((F.max("frame") + 1).alias("n"))
    count = F.floor(F.col("n") * 512.0 / sample_rate / 0.25).cast("int")
    return n.select("song_id", F.explode(F.sequence(F.lit(0), count)).alias("i")).select("song_id", F.col("i").cast("long").alias("beat_idx"), (F.col("i") * F.lit(0.25)).alias("time"))


CHROMA_SQL = """
vectors AS (SELECT CAST(label AS BIGINT) AS song_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
chroma AS (SELECT song_id, frame * ((len(embedding) + 11) // 12) + p // 12 AS frame, p % 12 AS pc, CAST(embedding[p + 1] AS DOUBLE) AS energy FROM (SELECT *, unnest(range(len(embedding))) AS p FROM vectors)),
sizes AS (SELECT song_id, max(frame) + 1 AS n FROM chroma GROUP BY song_id),
cbeats AS (SELECT song_id, i AS beat_idx, CAST(i AS DOUBLE) * CAST(0.25 AS DOUBLE) AS time FROM (SELECT song_id, unnest(range(0, CAST(floor(n * CAST(512 AS DOUBLE) / 22050 / CAST(0.25 AS DOUBLE)) AS BIGINT) + 1)) AS i FROM sizes))"""
