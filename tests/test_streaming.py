from test_notes import G1, frames

from quaver.operators import segment
from quaver.streaming.segmentation import segment_stream


def test_stream_gives_the_batch_events(spark, tmp_path):
    df = frames(spark, [*G1, (9.0, 440, 0.9)], [*G1[:5], (9.0, 440, 0.9)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = segment_stream(stream, idle_ms=10_000_000).writeStream.format("memory").queryName("notes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    assert q.awaitTermination(60)
    seen = {(r.song_id, r.event_idx, r.note, r.start_time, r.end_time, round(r.confidence, 9)) for r in spark.table("notes").collect()}
    batch = {(r.song_id, r.event_idx, r.note, r.start_time, r.end_time, round(r.confidence, 9)) for r in segment.segment_notes(segment.filter_by_confidence(df)).collect()}
    assert seen == {b for b in batch if b[3] < 9.0}  # the last run of each song is still open
