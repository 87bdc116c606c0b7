"""Quality rules with host-level verdicts.

Each document is judged by rules on its own text. The failures are then added up by
host, each host's failure rate is shrunk towards the other hosts' with an empirical
beta prior, and the verdict on the host is joined back to its documents.

Edge cases: a null or empty text has no words and fails the length rule. A very long
text is read whole; a task holds a slice of its batch, or that one text. Documents
without a host get no host verdict. Repeated rows are judged each on its own and all
count; a rate that equals the limit rejects. An empty table gives an empty one. Further
columns pass through whatever they are called; in a report, an input column named like
one of the results is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import _WS, slices, text_bytes, words_of
from .rows import named, numbered, place
from .workspace import materialize

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: A host whose shrunk failure rate reaches this is rejected with all its documents.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength, in documents.
PRIOR_STRENGTH = (1.0, 1000.0)
#: Verdict tables of at most this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(ids: np.ndarray, window: int) -> int:
    """Words inside windows of ``window`` words that are found twice or more. ids: equal for equal words only."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, width = ids, 1
    while width < window:  # exact ranks of ever longer runs
        step = min(width, window - width)
        pair = rank[: len(rank) - step] * np.int64(len(ids) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        width += step
        if width == 2 and int(rank.max()) + 1 == len(rank):
            return 0
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _metrics(batches: Iterator[pa.RecordBatch], text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, text):
            column = batch.column(batch.schema.get_field_index(text))
            w = words_of(column, lower=False)
            data, offsets = text_bytes(column)
            visible = np.cumsum(np.concatenate([[0], ~_WS[data] & ((data & 0xC0) != 0x80)]))
            symbols = np.cumsum(np.concatenate([[0], _SYMBOL[data]]))
            _, ids = np.unique(w.hashes, return_inverse=True)
            repeat, lines = [], []
            raw = data.tobytes()
            for i in range(batch.num_rows):
                own = ids[w.doc_start[i] : w.doc_start[i + 1]]
                if len(own) > WINDOW:
                    _, own = np.unique(own, return_inverse=True)
                repeat.append(_repeated(own.astype(np.int64), WINDOW))
                lines.append(_dup_lines(raw[offsets[i] : offsets[i + 1]]))
            found = [w.counts, visible[offsets[1:]] - visible[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], lines, repeat]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in schema if f.name not in METRICS]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.asarray(x, dtype=np.int64)) for x in found)], schema=pa.schema([*(pa.field(f.name, c.type) for f, c in zip(schema, kept, strict=False)), *(pa.field(m, pa.int64()) for m in METRICS)]))


def text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the word, symbol, line and repetition counts of each text (``METRICS``)."""
    docs = docs.select(*(c for c in docs.columns if c not in METRICS))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in METRICS)])
    names = pa.schema([pa.field(f.name, pa.null()) for f in schema])
    return docs.mapInArrow(lambda batches: _metrics(batches, text, names), schema)


def base_failed() -> F.Column:
    """Too short, or too much of the text in repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def rule_failed() -> F.Column:
    """What counts against the host: the base rules, or symbols or repeated lines for every third word."""
    return base_failed() | (F.lit(3) * (F.col("n_symbols") + F.col("n_dup_lines")) > F.col("n_words"))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength of the beta prior of (host_docs, host_failed), by the moments of the beta-binomial.

    The mean is the overall failure rate p. A host of n documents has a rate of variance
    p (1 - p) (1 + (n - 1) r) / n with r = 1 / (1 + strength): the part that does not
    depend on r is chance within the host and says nothing about the hosts, so it is
    subtracted. Hosts of one document are all chance and count for the mean only. The
    strength stays within ``PRIOR_STRENGTH``; without any spread beyond chance it is the
    larger bound. Six sums reach the driver.
    """
    n, k, several = F.col("host_docs").cast("double"), F.col("host_failed").cast("double"), F.col("host_docs") > 1
    sums = (F.sum(n), F.sum(k), *(F.sum(F.when(several, x)) for x in (F.lit(1.0), n, n * n, k, k * k / n)))
    total, failed, hosts_, docs, squares, bad, rates = (x or 0.0 for x in hosts.agg(*sums).first())
    low, high = PRIOR_STRENGTH
    mean = failed / total if total else 0.0
    spread = rates - 2 * mean * bad + mean * mean * docs
    chance, slope = hosts_ - docs / max(total, 1.0), docs - hosts_ - (squares - docs) / max(total, 1.0)
    if not 0 < mean < 1 or slope <= 0:
        return mean, high
    likeness = (spread / (mean * (1 - mean)) - chance) / slope
    return mean, min(max(1 / likeness - 1, low), high) if likeness > 0 else high


def host_verdicts(metrics: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_rejected): failures by host, shrunk with ``prior``. One row per host that is not null."""
    failures = F.sum(rule_failed().cast("long")).alias("host_failed")
    hosts = metrics.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), failures)
    hosts = materialize(hosts, "hosts")
    mean, strength = prior(hosts)
    rate = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") >= F.lit(limit))


def judge(metrics: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """``metrics`` with base_failed, host_rate and kept. Few verdicts are broadcast; many are shuffled, and Spark splits the hot hosts."""
    small = verdicts.select(F.col("host").alias("__host"), "host_rate", "host_rejected")
    if verdicts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    failed = base_failed()
    judged = metrics.join(small, F.col(host) == F.col("__host"), "left").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~failed & ~F.coalesce("host_rejected", F.lit(False))).drop("__host", "host_rejected")


def quality_report(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Every row of ``docs``, without its text, with metrics, base_failed, host_rate and kept."""
    t, results = place(docs, text), (*METRICS, "base_failed", "host_rate", "kept")
    metrics = materialize(text_metrics(numbered(docs), t).drop(t), "metrics")
    h = place(docs, host)
    judged = judge(metrics, host_verdicts(metrics, h), h)
    return judged.select(*(F.col(place(docs, c)).alias(c) for c in docs.columns if c != text and c not in results), *results)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules and their host's verdict keep, with their own columns.

    The texts are judged twice, once for the hosts and once on the way through: no text is shuffled or stored.
    """
    own, t, h = numbered(docs), place(docs, text), place(docs, host)
    verdicts = host_verdicts(text_metrics(own.select(h, t), t).drop(t), h)
    return named(judge(text_metrics(own, t), verdicts, h).where("kept"), docs)
