"""Katz backoff language model over words, of any order, learnt and evaluated on partitioned tables.

P(v | h) = d(r) r / c(h) where the n-gram (h, v) was seen r times, else alpha(h) P(v | h')
with h' the history without its oldest word, down to P(v) = d(r) r / N; what discounting
leaves there belongs to the one unknown word. The discounts are Good-Turing's (Katz, 1987),
for each order its own, for counts up to ``K`` and a small constant beyond, so some mass
is always left; alpha(h) is computed from exactly what the seen words of h leave, so each
history's probabilities add up to 1. A text's history begins with marks, and an end token
follows its last word. ``ORDER`` is the longest n, if no other is asked for: with 3 almost
every training token adds a row to the context table, and the tables written and shuffled
on the way take 7 times the input instead of less than 4.

1. Words are counted (combined before the shuffle): the word table.
2. The ``DICT`` most frequent words, a fixed number, are broadcast with their counts.
3. Tokens with their histories are routed once, packed and sorted, to the partition that
   holds all with the same last two words, and so all their longer n-grams: by the word
   before; by both words, where the one before is so frequent that it alone would fill a
   turn of a partition; by the word itself, where that is not in the dictionary. N-grams
   with more than one in ``HOT`` of all tokens are counted before: those of full length are never
   routed, and the tokens of shorter ones are spread by their longer n-grams. Those are found with
   the words: each flush of the tokens names what it holds at more than half that share, 2 x ``HOT`` at
   most however large the table is, and what is more frequent in all is named for more than half of its count. A partition counts
   its n-grams in turns of about ``TURN_TOKENS`` and writes, by row, what is decided there,
   and by history what its seen words take. The numbers of partitions and turns follow
   from the number of tokens, so memory does not depend on the session's settings.
4. A training row's n-grams are all seen, and the count of a history is that of an n-gram
   which ends one token earlier, so it is divided by where that n-gram is counted: training
   rows are decided in their partitions. Only held-out rows leave something open: the
   counts and alphas of their histories.
5. Histories are added up to the context tables (count, alpha), order by order, which meet
   what is open. Frequent contexts, a fixed number, are broadcast, so they are no hot keys.

Rows are numbered where they are read, so no two share a key; the input has to be
repeatable row by row, as a table is. Words outside the dictionary, and histories of two
words and more, are 64-bit hashes.

Edge cases: null and empty texts are the end token only; a very long text is scored
whole. Repeated rows each count and each get the same score. Rows without an id are
trained on like others; ids may be of any type. With no training rows everything is
unknown and each token has probability 1. An empty table gives an empty one. Extra
columns are not read, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import mix64, slices, words_of
from .workspace import materialize

ORDER = 2
K = 5
DICT = 1 << 17
FLUSH = 1 << 20
#: Tokens that a partition takes at most, about, and that it counts in one turn.
PART_TOKENS, TURN_TOKENS = 1 << 24, 1 << 19
#: An n-gram is hot if more than one token in so many ends it.
HOT = 1 << 14
#: Key under which the words' table counts the tokens of all rows.
ALL = 0
END, BEGIN = 1, 2
_RARE = np.uint64(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd", compression_level=1)


def discounts(n: list[int]) -> list[float]:
    """d(1) ... d(K) and the one beyond, from how many n-grams occur 1 ... K + 1 times."""
    for k in range(K, 0, -1):
        if all(n[: k + 1]):
            cut = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if cut < 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                tail = [1 - (1 - d[-1]) * k / r for r in range(k + 1, K + 1)]
                return [*d, *tail, 1 - (1 - d[-1]) * k / K / 10]
    return [*(1 - 0.5 / r for r in range(1, K + 1)), 1 - 0.05 / K]


def _tokens(batch: pa.RecordBatch, text: str, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The tokens of a slice, the tokens 1 ... order - 1 before each, and the row of each; words are hashes, BEGIN or END."""
    w = words_of(batch.column(batch.schema.get_field_index(text)))
    n = w.counts
    hashes = np.where(w.hashes <= 2, np.uint64(3), w.hashes) & ~_RARE
    rows = np.repeat(np.arange(len(n)), n + 1)
    ends = np.cumsum(n + 1) - 1
    v = np.empty(len(rows), np.uint64)
    mask = np.ones(len(rows), bool)
    mask[ends] = False
    v[mask], v[ends] = hashes, END
    at = np.arange(len(rows)) - np.repeat(ends - n, n + 1)
    gram = [v]
    for k in range(1, order):
        before = np.full_like(v, BEGIN)
        before[k:] = v[:-k]
        before[at < k] = BEGIN
        gram.append(before)
    return gram, rows


def _gram_names(order: int) -> list[str]:
    return [f"w{i}" for i in range(order)]


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """By flush of training rows: counts of words (n = 1), the number of all tokens, and counts of the n-grams that are frequent in it."""
    held: list[list[np.ndarray]] = []
    size = tokens = 0

    def rows(n: int, gram: list[np.ndarray], c: np.ndarray) -> pa.RecordBatch:
        words = [pa.array(g.view(np.int64)) for g in gram] + [pa.nulls(len(c), pa.int64())] * (order - n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n, np.int32)), *words, pa.array(c.astype(np.int64))], names=["n", *_gram_names(order), "c"])

    def out() -> Iterator[pa.RecordBatch]:
        gram = [np.concatenate(g) for g in zip(*held, strict=True)]
        h, c = np.unique(gram[0], return_counts=True)
        yield rows(1, [np.append(h, np.uint64(ALL))], np.append(c, tokens))
        least = size / (2 * HOT)
        key = gram[0]
        for n in range(2, order + 1):
            key = mix64(key * _ODD ^ gram[n - 1])
            _, first, c = np.unique(key, return_index=True, return_counts=True)
            first, c = first[c > least], c[c > least]
            own = [g[first] for g in gram[:n]]
            within = own[-1] != BEGIN
            yield rows(n, [g[within] for g in own], c[within])

    for whole in batches:
        for batch in slices(whole, "text"):
            gram, of = _tokens(batch, "text", order)
            use = batch.column(1).to_numpy(zero_copy_only=False)[of]
            held.append([g[use] for g in gram])
            size, tokens = size + int(use.sum()), tokens + len(of)
            if size >= FLUSH:
                yield from out()
                held, size, tokens = [], 0, 0
    if tokens:
        yield from out()


class Model:
    """What every task knows: the frequent words and n-grams with their counts, how words become probabilities, and where tokens go."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, histogram: list[int], texts: int, places: list[int], turns: int, size: int, least: int, order: int) -> None:
        by = np.argsort(words)
        self.words, self.counts = words[by], counts[by]
        self.total, self.distinct, self.texts, self.size, self.order = total, distinct, texts, size, order
        self.places, self.turns = np.array(places, np.int32), turns
        #: a word with more occurrences would fill a quarter of a turn
        turn = max(1, total // (len(places) * turns))
        self.heavy, self.hot_from = self.counts > max(least, K, turn // 4), max(least, K, total // HOT)
        self.d = np.array([0.0, *discounts(histogram)])
        taken = sum(self.d[r] * r * histogram[r - 1] for r in range(1, K + 1)) + self.d[K + 1] * (total - sum(r * histogram[r - 1] for r in range(1, K + 1)))
        self.unknown = 1 - taken / total if total else 1.0
        #: by n: keys of the hot n-grams, sorted, and their counts
        self.hot: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the dictionary, its size for BEGIN, or the hash with the top bit set."""
        out = hashes | _RARE
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            out = np.where(self.words[at] == hashes, at.astype(np.uint64), out)
        return np.where(hashes == BEGIN, np.uint64(self.size), out)

    def known(self, ids: np.ndarray) -> np.ndarray:
        return ids < self.size

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Counts of dictionary words and of BEGIN; 0 for others."""
        out = np.zeros(len(ids), np.int64)
        out[ids < self.size] = self.counts[ids[ids < self.size].astype(np.int64)]
        out[ids == self.size] = self.texts
        return out

    def key(self, gram: list[np.ndarray]) -> np.ndarray:
        """Key of n-grams of dictionary words: exact for two and three words."""
        key = gram[0].copy()
        for n, w in enumerate(gram[1:], 2):
            key = key * np.uint64(self.size) + w if n <= 3 else mix64(key * _ODD ^ w)
        return key

    def hot_counts(self, gram: list[np.ndarray]) -> list[np.ndarray]:
        """For n = 2 ... as long as the gram is: counts of hot n-grams, 0 for all others."""
        out, ok = [], self.known(gram[0])
        for n in range(2, len(gram) + 1):
            c = np.zeros(len(gram[0]), np.int64)
            ok = ok & self.known(gram[n - 1])
            if n in self.hot and ok.any():
                keys, counts = self.hot[n]
                own = self.key([g[ok] for g in gram[:n]])
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                c[ok] = np.where(keys[at] == own, counts[at], 0)
                ok = c > 0
            else:
                ok = np.zeros(len(ok), bool)
            out.append(c)
        return out

    def part(self, gram: list[np.ndarray]) -> np.ndarray:
        """Where a token goes: the place of its partition, and the turn there."""
        v, u = gram[:2]
        heavy = u == self.size
        heavy[u < self.size] = self.heavy[u[u < self.size].astype(np.int64)]
        key = np.where(self.known(v), np.where(heavy, mix64(u * _ODD ^ v), mix64(u)), mix64(v))
        for n, c in enumerate(self.hot_counts(gram[:-1]), 2):  # all that is longer meets by its own n-grams
            key[c > 0] = mix64(key[c > 0] * _ODD ^ gram[n][c > 0])
        n, turns = np.uint64(len(self.places)), np.uint64(self.turns)
        key = mix64(key + np.uint64(1))
        return self.places[(key % n).astype(np.int64)].astype(np.int64) * self.turns + (key // n % turns).astype(np.int64)

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.zeros(len(counts))
        p = self.d[np.minimum(counts, K + 1)] * counts / self.total
        return np.log10(np.where(counts > 0, p, self.unknown))

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _history(gram: list[np.ndarray]) -> np.ndarray:
    """Id of an n-gram's history: of one word that word's, of several a hash."""
    out = gram[1]
    for w in gram[2:]:
        out = mix64(out * _ODD ^ w) | _RARE
    return out


def _count_hot(batches: Iterator[pa.RecordBatch], sent, keys: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Counts in training rows of the n-grams with these sorted keys, each once a task."""
    model: Model = sent.value
    found = np.zeros(len(keys), np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            gram, rows = _tokens(batch, "text", n)
            use = batch.column(1).to_numpy(zero_copy_only=False)[rows]
            gram = [model.ids(g)[use] for g in gram]
            ok = np.logical_and.reduce([model.known(g) for g in gram])
            own = model.key([g[ok] for g in gram])
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found += np.bincount(at[keys[at] == own], minlength=len(keys))
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["i", "c"])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, their bytes by significance."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
        body = _CODEC.compress(raw, asbytes=True) if raw else b""
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 2
    for _ in range(int.from_bytes(data[:2], "little")):
        kind, n, size = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 20], "little")
        at += 20
        raw = _CODEC.decompress(data[at : at + size], n * kind.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += size
    return out


_ROUTED = ["part", "blob", "rid", "tokens", "known", "base", "seen", "beyond", "held", "id"]


def _route(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Packed tokens by partition; and by row what needs no routing (part -1 - x)."""
    model: Model = sent.value
    number = TaskContext.get().partitionId() << 40
    held: list[tuple] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        *gram, rid, teach = (np.concatenate(x) for x in zip(*held, strict=True))
        part = model.part(gram)
        order = np.lexsort((gram[0], gram[1], part))
        *gram, rid, teach, part = (x[order] for x in (*gram, rid, teach, part))
        v, u, *more = gram
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        parts, blobs = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            docs, doc = np.unique(rid[a:b], return_inverse=True)
            taught = np.zeros(len(docs), np.uint8)
            taught[doc] = teach[a:b]
            first = np.flatnonzero(np.concatenate([[True], u[a + 1 : b] != u[a : b - 1]]))
            runs = np.diff(np.concatenate([first, [b - a]]))
            small = np.uint16 if len(docs) < 65536 else np.uint32
            parts.append(int(part[a]))
            blobs.append(_pack(u[a:b][first], runs.astype(np.uint32), v[a:b], *(w[a:b] for w in more), doc.astype(small), docs, taught))
        none = [pa.nulls(len(parts), t) for t in (*[pa.int64()] * 3, *[pa.float64()] * 2, pa.int64(), pa.bool_(), kind)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.large_binary()).cast(pa.binary()), *none], names=_ROUTED)

    for whole in batches:
        for batch in slices(whole, "text"):
            gram, rows = _tokens(batch, "text", model.order)
            gram = [model.ids(g) for g in gram]
            v = gram[0]
            teach, kind, m = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).type, batch.num_rows
            rid = np.arange(number, number + m)
            number += m
            # what is known here: the base score of dictionary words, and n-grams of full length that are counted already
            kv = model.known(v)
            c = model.count(v)
            base, known = np.bincount(rows[kv], model.log_base(c[kv]), m), np.bincount(rows[kv], minlength=m)
            counts = model.hot_counts(gram)
            hot = counts[-1] > 0
            own, taught = [g[hot] for g in gram], teach[rows[hot]]
            shorter = counts[-2] if len(counts) > 1 else c  # of the history that these are to the next token
            history = model.hot_counts(own[1:])[-1] if len(own) > 2 else model.count(own[1])
            divisor = np.where(taught, np.where(own[0] == model.end, 1, shorter[hot]), history)
            seen, beyond = np.bincount(rows[hot], np.log10(counts[-1][hot] / divisor), m), np.bincount(rows[hot], minlength=m)
            spread = int(model.places[int(mix64(rid[:1].view(np.uint64))[0] % np.uint64(len(model.places)))]) * model.turns
            whole_, real = np.int64, np.float64  # sums of nothing would come out as whole numbers
            made = zip((np.full(m, -1 - spread), rid, np.bincount(rows, minlength=m), known, base, seen, beyond), (*[whole_] * 4, real, real, whole_), strict=True)
            part, *made = (pa.array(x.astype(t)) for x, t in made)
            yield pa.RecordBatch.from_arrays([part, pa.nulls(m, pa.binary()), *made, pa.array(~teach), batch.column(2)], names=_ROUTED)
            held.append(tuple(x[~hot] for x in (*gram, rid[rows], teach[rows])))
            size += int((~hot).sum())
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
    if size:
        yield from out()


DOCUMENT, CONTEXT, OPEN = 0, 1, 2


def _classes(order: int) -> list[str]:
    """Columns of counts 1 ... K and beyond: by order in rows of documents; the first K + 1 a context's own, the next those of its words' shorter n-grams."""
    return [f"r{i}" for i in range((K + 1) * (order - 1))]


def _columns(order: int) -> list[str]:
    return ["kind", "n", "rid", "u", "low", "tokens", "known", *_classes(order), "x", "y", "held", "id"]


def _schema(order: int, id_type: str) -> str:
    types = {"kind": "int", "x": "double", "y": "double", "held": "boolean", "id": id_type}
    return ", ".join(f"{c} {types.get(c, 'long')}" for c in _columns(order))


def _rows(kind: int, rows: int, order: int, id_type: pa.DataType, **cols: np.ndarray | pa.Array) -> pa.RecordBatch:
    types = {"x": pa.float64(), "y": pa.float64(), "held": pa.bool_(), "id": id_type}
    made = [pa.array(np.full(rows, kind, np.int32))]
    for c in _columns(order)[1:]:
        x, to = cols.get(c), types.get(c, pa.int64())
        if isinstance(x, np.ndarray):
            x = pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(to.to_pandas_dtype()))
        made.append(pa.nulls(rows, to) if x is None else x)
    return pa.RecordBatch.from_arrays(made, names=_columns(order))


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row, and one row of each group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _settle(blobs: list[bytes], model: Model, documents: list[list[np.ndarray]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Some of a partition's tokens, with all of each of their n-grams.

    By row what is decided (x: score, y: base; seen n-grams by count), by history what its seen words take (own and
    shorter n-grams by count, of those seen K + 1 times y; after one word x: their probability without history), and what
    is open (x: n-grams not seen, y: seen, whose history's count is wanted).
    """
    order, columns, held = model.order, _classes(model.order), []
    for blob in blobs:
        first, runs, v, *more, doc, docs, taught = _unpack(blob)
        held.append((v, np.repeat(first, runs), *more, docs[doc], taught[doc]))
    *gram, rid, teach = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    by = np.lexsort((*gram[:1:-1], gram[0], gram[1]))
    *gram, rid, teach = (x[by] for x in (*gram, rid, teach))
    v, u = gram[:2]
    m = len(v)
    taught = teach > 0

    # n-grams are runs of the sorted tokens; those of n words lie within those of n - 1
    new = np.ones(m, bool)
    new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
    starts, of, counts, hot = {}, {}, {}, model.hot_counts(gram[:-1])
    for n in range(2, order + 1):
        if n > 2:
            new = new.copy()
            new[1:] |= gram[n - 1][1:] != gram[n - 1][:-1]
        starts[n], of[n] = np.flatnonzero(new), np.cumsum(new) - 1
        counts[n] = np.bincount(of[n], teach).astype(np.int64)
        if n < order:
            known = hot[n - 2][starts[n]]
            counts[n] = np.where(known > 0, known, counts[n])
    rare = v >= _RARE
    word = model.count(v)
    if rare.any():  # all tokens of such a word are here
        number, _ = _group(v[rare])
        word[rare] = np.bincount(number, teach[rare])[number].astype(np.int64)
    log_p = model.log_p(word)

    # histories; what is hot has been counted for them elsewhere
    for n in range(2, order + 1):
        at, c = starts[n], counts[n]
        some = c > 0
        if n < order:
            some &= hot[n - 2][at] == 0
        at, c = at[some], c[some]
        if not len(at):
            continue
        own = [g[at] for g in gram[:n]]
        h, one = _group(_history(own))
        found = {"n": np.full(len(one), n), "u": _history(own)[one], "y": np.bincount(h, c == K + 1)}
        found |= {columns[r - 1]: np.bincount(h, c == r) for r in range(1, K + 1)} | {columns[K]: np.bincount(h, np.where(c > K, c, 0))}
        if n == 2:
            found["x"] = np.bincount(h, 10 ** log_p[at])
        else:
            c = counts[n - 1][of[n - 1][at]]
            found["low"] = _history(own[:-1])[one]
            found |= {columns[K + r]: np.bincount(h, np.where(np.minimum(c, K + 1) == r, c, 0)) for r in range(1, K + 2)}
        yield _rows(CONTEXT, len(one), order, id_type, **found)

    # rows: the longest n-gram that is seen
    longest, count = np.ones(m, np.int64), np.zeros(m, np.int64)
    for n in range(2, order + 1):
        c = counts[n][of[n]]
        longest, count = np.where(c > 0, n, longest), np.where(c > 0, c, count)
    seen = longest > 1
    score = np.where(seen, np.log10(np.maximum(count, 1)), log_p)
    shorter = counts[order - 1][of[order - 1]] if order > 2 else word
    divides = taught & (v != model.end)
    score[divides] -= np.log10(shorter[divides])
    score[taught & (u == model.size)] -= math.log10(max(model.texts, 1))
    near = ~taught & (longest == 2) & (u <= model.size)
    score[near] -= np.log10(model.count(u[near]))
    d, own = _group(rid)
    size = len(own)
    base = np.bincount(d, np.where(rare, model.log_base(word), 0.0), size)
    known = np.bincount(d, rare & (word > 0), size).astype(np.int32)
    classes = [np.bincount(d, (longest == n) & (np.minimum(count, K + 1) == r), size).astype(np.int32) for n in range(2, order + 1) for r in range(1, K + 2)]
    documents.append([rid[own], np.bincount(d, score, size), base, known, *classes])
    del d, own, score, base, classes

    # open in held-out rows: alpha of the histories after which a word was not seen, and counts of those after which it was
    for n in range(2, order + 1):
        left = ~taught & (longest <= n)
        if n == 2:
            left &= (longest < 2) | (u > model.size)
        if left.any():
            h = _history([g[left] for g in gram[:n]])
            g, own = _group(rid[left], h)
            yield _rows(OPEN, len(own), order, id_type, n=np.full(len(own), n), rid=rid[left][own], u=h[own], x=np.bincount(g, longest[left] < n), y=np.bincount(g, longest[left] == n))


def _reduce(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model = sent.value
    columns = _classes(model.order)
    held: list[bytes] = []
    documents: list[list[np.ndarray]] = []
    now, id_type = None, pa.null()

    def decided() -> pa.RecordBatch:
        rid, score, base, known, *counts = (np.concatenate(x) for x in zip(*documents, strict=True))
        d, own = _group(rid)
        m = len(own)
        r = {c: np.bincount(d, x, m) for c, x in zip(columns, counts, strict=True)}
        return _rows(DOCUMENT, m, model.order, id_type, rid=rid[own], known=np.bincount(d, known, m), x=np.bincount(d, score, m), y=np.bincount(d, base, m), **r)

    for batch in batches:
        id_type = batch.column(9).type
        part = batch.column(0).to_numpy()
        own = batch.filter(pa.array(part < 0))
        if own.num_rows:
            _, _, rid, tokens, known, base, seen, beyond, out, ids = own.columns
            yield _rows(DOCUMENT, own.num_rows, model.order, id_type, rid=rid, tokens=tokens, known=known, x=seen, y=base, held=out, id=ids, **{columns[-1]: beyond})
        for p, blob in zip(part[part >= 0].tolist(), batch.column(1).filter(pa.array(part >= 0)).to_pylist(), strict=True):
            if p != now and held:
                yield from _settle(held, model, documents, id_type)
                held = []
                if sum(len(x[0]) for x in documents) > TURN_TOKENS:
                    yield decided()
                    documents = []
            now = p
            held.append(blob)
    if held:
        yield from _settle(held, model, documents, id_type)
    if documents:
        yield decided()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _from_count(table: DataFrame, size: int) -> int:
    """The least count of the rows of a table (c) so that at most ``size`` rows have it: from a histogram of the counts' logarithms."""
    step = F.floor(F.log2("c") * 8)
    total, least = 0, 1 << 62
    for b, n, low in sorted(table.groupBy(step.alias("b")).agg(F.count(F.lit(1)), F.min("c")).collect(), reverse=True):  # a row for each eighth of a power of two
        if total + n > size:
            break
        total, least = total + n, low
    return least


def _places(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that Spark's hash partitioning puts there, so that each gets one part."""
    found = spark.range(parts * 24 + 100).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k")).collect()
    return [dict(found).get(p, p) for p in range(parts)]


def score(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    out: Column | None = None,
    order: int = ORDER,
    dictionary: int = DICT,
    least: int = 1000,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; rows with ``out`` teach nothing.

    ``order``: words of the longest n-grams, 2 at least; ``dictionary``: how many words, and how many contexts, are
    broadcast; ``least``: words and n-grams with fewer occurrences are never heavy.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    out = held_out(F.col(doc_id)) if out is None else out
    read = docs.select(F.col(text).alias("text"), (~out).alias("teach"), F.col(doc_id).alias("id"))
    names = _gram_names(order)
    counted = read.select("text", "teach").mapInArrow(lambda b: _count(b, order), f"n int, {', '.join(f'{w} long' for w in names)}, c long")
    grams = materialize(counted.groupBy("n", *names).agg(F.sum("c").alias("c")), "words")
    words = grams.where("n = 1").select(F.col("w0").alias("h"), "c")
    known = words.where(F.col("h") != ALL)
    found = known.agg(F.sum("c"), F.count(F.lit(1)), *(F.count_if(F.col("c") == r) for r in range(1, K + 2)), F.sum(F.when(F.col("h") == END, F.col("c")))).first()
    tokens = words.where(F.col("h") == ALL).agg(F.sum("c")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))
    turns = max(1, -(-tokens // (parts * TURN_TOKENS)))
    top = known.where(F.col("c") >= _from_count(known, dictionary)).select("h", "c").collect()  # ``dictionary`` at most
    frequent = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    model = Model(*frequent, found[0] or 0, found[1], list(found[2 : K + 3]), found[K + 3] or 0, _places(spark, parts), turns, dictionary, least, order)
    model.end = model.ids(np.array([END], np.uint64))[0]
    extra = _hot_contexts(read, grams, model)
    sent = sc.broadcast(model)
    id_type, classes = read.schema["id"].dataType.simpleString(), _classes(order)
    routed = f"part long, blob binary, rid long, tokens long, known long, base double, seen double, beyond long, held boolean, id {id_type}"
    place = F.floor(F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.col("part")) / F.lit(turns)).cast("int")
    packed = read.mapInArrow(lambda b: _route(b, sent), routed).withColumn("place", place).repartition(parts, "place").sortWithinPartitions("part").drop("place")
    made = materialize(packed.mapInArrow(lambda b: _reduce(b, sent), _schema(order, id_type)), "pairs", by="kind")
    contexts, d = _contexts(made, extra, order, dictionary)

    opened = made.where(F.col("kind") == OPEN).select("n", "rid", "u", "x", "y")
    few, least_c = contexts.where("often"), contexts.where("not often")
    met = opened.join(F.broadcast(few), ["n", "u"], "left")
    late = lambda df: df.select("rid", (F.col("x") * F.coalesce("log_alpha", F.lit(0.0)) - F.col("y") * F.coalesce("log_c", F.lit(0.0))).alias("s"))
    others = met.where(F.col("often").isNull()).select("n", "rid", "u", "x", "y").join(least_c, ["n", "u"])  # histories never seen add nothing
    logs = [math.log10(x) for n in range(2, order + 1) for x in d[n]]
    soon = (F.col("x") + sum((F.coalesce(r, F.lit(0)) * F.lit(x) for r, x in zip(classes, logs, strict=True)), F.lit(0.0))).alias("s")
    rows = made.where(F.col("kind") == DOCUMENT).select("rid", "tokens", "known", F.col("y").alias("base"), soon, "held", "id")
    for more in (late(met.where("often")), late(others)):
        rows = rows.unionByName(more, allowMissingColumns=True)
    each = rows.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("tokens", "known", "base", "s")), F.first("held", True).alias("held"), F.first("id", True).alias("id"))
    train = F.lit(model.total).cast("long").alias("train_tokens")
    return each.select("id", F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), train, F.col("base").alias("base_score"), F.col("s").alias("score"))


def _contexts(made: DataFrame, extra: DataFrame | None, order: int, most: int) -> tuple[DataFrame, dict[int, list[float]]]:
    """(n, u, log_c, log_alpha, often) of every history, and the discounts of each order. often: one of ``most`` that are broadcast."""
    classes = _classes(order)
    own, shorter = classes[: K + 1], classes[K + 1 : 2 * K + 2]
    rows = made.where(F.col("kind") == CONTEXT).select("n", "u", "low", "x", "y", *own, *shorter)
    rows = rows if extra is None else rows.unionByName(extra, allowMissingColumns=True)
    table = rows.groupBy("n", "u").agg(F.max("low").alias("low"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("x", "y", *own, *shorter)))
    n_of = sum((F.col(r) * F.lit(i) for i, r in enumerate(own[:-1], 1)), F.lit(0)) + F.col(own[-1])
    table = materialize(table.withColumn("c", n_of), "contexts")
    found = {r[0]: r[1:] for r in table.groupBy("n").agg(*(F.sum(r) for r in own[:-1]), F.sum("y")).collect()}
    d = {n: discounts([int(x or 0) for x in found.get(n, [0] * (K + 1))]) for n in range(2, order + 1)}
    often = F.col("c") >= F.lit(_from_count(table, most))
    out, below = None, None
    for n in range(2, order + 1):
        level = table.where(F.col("n") == n)
        taken = sum((F.col(r) * F.lit(i * x) for i, (r, x) in enumerate(zip(own[:-1], d[n], strict=False), 1)), F.lit(0.0)) + F.col(own[-1]) * F.lit(d[n][-1])
        left = F.lit(1.0) - F.col("x")
        if n > 2:  # what the seen words have after the shorter history
            level = level.join(F.broadcast(below.where("often")), "low", "left")
            rest = level.where("low_c is null").drop("low_c", "often").join(below.where("not often"), "low")
            level = level.where("low_c is not null").drop("often").unionByName(rest.drop("often"))
            left = F.lit(1.0) - sum((F.col(r) * F.lit(x) for r, x in zip(shorter, d[n - 1], strict=True)), F.lit(0.0)) / F.col("low_c")
        alpha = F.log10((F.lit(1.0) - taken / F.col("c")) / F.greatest(left, F.lit(1e-12)))
        one = level.select("n", "u", F.log10("c").alias("log_c"), alpha.alias("log_alpha"), often.alias("often"))
        out = one if out is None else out.union(one)
        below = table.where(F.col("n") == n).select(F.col("u").alias("low"), F.col("c").alias("low_c"), often.alias("often"))
    return materialize(out, "alphas"), d


def _hot_contexts(read: DataFrame, grams: DataFrame, model: Model) -> DataFrame | None:
    """Hot n-grams: given to ``model`` with their counts, and returned as rows of the context tables. ``grams``: from ``_count``."""
    spark = read.sparkSession
    classes, rows = _classes(model.order), []
    for n in range(2, model.order + 1):
        # flushes that do not name an n-gram have half of ``hot_from`` of it at most; the others together, more than that of 2 x HOT n-grams at most
        found = grams.where((F.col("n") == n) & (2 * F.col("c") > model.hot_from)).select(_gram_names(n)).collect()
        gram = [model.ids(g.view(np.uint64)) for g in np.array(found, np.int64).reshape(-1, n).T.copy()]
        ok = np.logical_and.reduce([model.known(g) for g in gram])
        if n > 2:
            gram = [np.where(ok, g, 0).astype(np.uint64) for g in gram]
            ok &= (model.hot_counts(gram[:-1])[-1] > 0) & (model.hot_counts(gram[1:])[-1] > 0)
        gram = [g[ok] for g in gram]
        if not len(gram[0]):
            break
        keys, first = np.unique(model.key(gram), return_index=True)
        gram = [g[first] for g in gram]
        sent = spark.sparkContext.broadcast(model)
        counted = read.select("text", "teach").mapInArrow(lambda b, n=n, sent=sent, keys=keys: _count_hot(b, sent, keys, n), "i long, c long").groupBy("i").agg(F.sum("c").alias("c"))
        found = counted.where(F.col("c") > model.hot_from).collect()
        if not found:
            break
        at, c = np.array(found, np.int64).T
        gram = [g[at] for g in gram]
        key = model.key(gram)
        by = np.argsort(key)
        model.hot[n] = (key[by], c[by])
        own = {"n": np.full(len(c), n), "u": _history(gram), classes[K]: c, "y": (c == K + 1).astype(float)}
        if n == 2:
            own["x"] = 10 ** model.log_p(model.count(gram[0]))
        else:
            own |= {"low": _history(gram[:-1]), classes[2 * K + 1]: model.hot_counts(gram[:-1])[-1]}
        names = ["n", "u", "low", "x", "y", classes[K], classes[2 * K + 1]] if model.order > 2 else ["n", "u", "x", "y", classes[K]]
        cols = [(own[k].view(np.int64) if own[k].dtype == np.uint64 else own[k]).tolist() if k in own else [None] * len(c) for k in names]
        rows += zip(*cols, strict=True)
    if not rows:
        return None
    types = {"x": "double", "y": "double"}
    return spark.createDataFrame(rows, ", ".join(f"{k} {types.get(k, 'long')}" for k in names))
