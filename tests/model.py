"""A small row-by-row model of the note operators, for comparison with the engine."""

import math

NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def midi(f):
    x = 12 * (math.log2(f) - math.log2(440.0)) + 69
    return round(x)  # halves to even


def segments(frames, threshold=0.85):
    """frames: (time, frequency, confidence) in order; gives [midi, start, end, confidences]."""
    out, before = [], None
    for t, f, c in frames:
        if c is None or math.isnan(c) or c < threshold or math.isnan(f) or f <= 0 or math.isinf(f):
            continue
        m = midi(f)
        if out and out[-1][0] == m and not t - before > 0.1:
            out[-1][2] = t
            out[-1][3].append(c)
        else:
            out.append([m, t, t, [c]])
        before = t
    return [(m, a, b, sum(c) / len(c)) for m, a, b, c in out]


def in_key(events, scales):
    pcs = [m % 12 if m >= 12 else -1 for m, *_ in events]
    if not events:
        return events
    hits = [sum(p in s for p in pcs) for _, s in scales]
    best = hits.index(max(hits))
    if max(hits) / len(events) < 0.6:
        return events
    return [e for e, p in zip(events, pcs, strict=True) if p in scales[best][1]]


def no_outliers(events, short=0.15):
    keep = []
    for i, e in enumerate(events):
        edge = i in (0, len(events) - 1)
        if not edge and e[2] - e[1] < short and abs(e[0] - events[i - 1][0]) > 12 and abs(e[0] - events[i + 1][0]) > 12:
            continue
        keep.append(e)
    return keep


def merged(events, gap=0.08):
    out = []
    for e in events:
        if out and out[-1][0] == e[0] and 0 <= e[1] - out[-1][2] <= gap:
            p = out[-1]
            out[-1] = (p[0], p[1], e[2], (p[3] + e[3]) / 2)
        else:
            out.append(e)
    return out
