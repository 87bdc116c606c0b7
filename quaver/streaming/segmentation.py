"""Segmentation of a stream of pitch frames (an extension: the batch engine needs no streaming).

Frames of a song come in order. A run is open until a frame of another note, a gap or a
time-out ends it; the state of a song is its open run only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import music as M
from ..operators import segment

STATE = "midi int, event_idx bigint, first double, last double, total double, n bigint"
OUTPUT = "song_id bigint, event_idx bigint, midi int, start_time double, end_time double, confidence double"


def segment_stream(frames: DataFrame, threshold: float = 0.85, max_gap: float = 0.1, idle_ms: int = 10_000) -> DataFrame:
    """Events of a streaming DataFrame of frames, each emitted when its run ends; append mode."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        done = []

        def close() -> None:
            midi, at, first, last, total, n = run
            done.append((int(key[0]), int(at), int(midi), float(first), float(last), float(total / n)))

        if state.hasTimedOut:
            close()
            run = [-1, run[1], 0.0, 0.0, 0.0, 0]  # keeps the count of events
        else:
            for midi, time, confidence in pd.concat(parts).sort_values("seq")[["midi", "time", "confidence"]].itertuples(index=False):
                if run is not None and run[5] and run[0] == midi and not time - run[3] > max_gap:
                    run[3], run[4], run[5] = time, run[4] + confidence, run[5] + 1
                    continue
                if run is not None and run[5]:
                    close()
                run = [midi, run[1] + 1 if run is not None else 0, time, time, confidence, 1]
        if run is not None:
            state.update((int(run[0]), int(run[1]), float(run[2]), float(run[3]), float(run[4]), int(run[5])))
            if run[5]:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(done, columns=["song_id", "event_idx", "midi", "start_time", "end_time", "confidence"])

    tuned = frames.transform(segment.filter_by_confidence, threshold).transform(segment.valid_frames).select("song_id", "seq", "midi", "time", "confidence")
    events = tuned.groupBy("song_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "ProcessingTimeTimeout")
    return events.withColumn("note", M.note_name(events.midi))
