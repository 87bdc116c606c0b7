"""Alignment of two tokenizers over the same texts: where both end a token, groups between such cuts, and links.

Method:

1. ``encode``: every text is cut into units that both tokenizers keep apart (a unit begins with a
   space that follows what is no space; this is checked against the vocabulary), and each
   distinct unit of a block of texts is encoded once. A text becomes the numbers of its
   units. A block ends with the slice of texts that fills its dictionary, so a task holds one dictionary
   however many rows it reads. Texts and units are written in buckets of their block.
2. ``meetings``: tokens of every unit are exploded with their place and end, and both sides meet by an
   equi-join on (unit, end): a cut. The tokens that end together are a link. A unit's cuts stand in the order
   of their ends. (``cuts`` has lists with lengths: windows sum them to ends, and number the cuts.)
3. ``pair_counts``: links, weighted by how often their unit is used, are counted by id pair (combined
   before the shuffle), with the highest count of each B id.
4. ``alignment``: links meet their counts, and blocks their texts: a text's figures are the sums of
   its units', its groups theirs in order.

The unit is the document of steps 2 and 3; ``cuts`` takes lists of whole texts as well. Nothing but pair
counts is shuffled: joins and groups use the buckets. A block is bounded (``UNITS``, ``UNIT_CHARS``, ``USES``, and a slice more).

Edge cases: null and empty texts have no tokens, nor have texts whose tokens, joined, are not
the space and the text again (one with U+2581 in it): figures are 0, groups none. Special tokens'
strings are plain text. A very long text is one row, encoded whole; one without spaces is one unit. Repeated
rows count each time. Rows without an id are rows like others. An empty table gives an
empty one. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .kernels import slices
from .workspace import bucketed, materialize
from .workspace import settings as _settings

#: A block is full with so many distinct units, characters of them, or units in its texts.
UNITS, UNIT_CHARS, USES = 1 << 17, 1 << 21, 1 << 20
#: Buckets for each shuffle partition: few blocks meet in a task, so that its sorts are small.
SPREAD = 4
#: Pair tables of at most this many rows are broadcast.
BROADCAST_PAIRS = 500_000
#: Rows and bytes that a batch brings to the tokenizers, and bytes of text that are encoded at once: a worker and its
#: executor's buffers hold as much beside the dictionary of a block.
BATCH_ROWS, BATCH_BYTES, SLICE = 256, 1 << 20, 1 << 19
#: Units whose strings are gathered at once.
GATHER = 1 << 17
SPACE = "\u2581"

_BEFORE_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: How byte-level tokenizers cut text into what they encode apart (a fixed value of theirs).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def units_of(text: str) -> list[str]:
    """Space and text, cut where a space follows what is no space; each unit without the space it begins with."""
    return [u[1:] for u in _CUT.split(" " + text)] if _BEFORE_SPACE.search(" " + text) else text.split(" ")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, and the bytes of each id.

    A: vocabulary and merges of a byte-level tokenizer's JSON, run by the faster library as ranks, which asks that merges stand in the order of ids.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        added, letters = {t["content"] for t in spec["added_tokens"]}, byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"not a byte-level tokenizer with merges in the order of ids: {a_path}")
        self.a = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"pieces that go on after a space cannot be encoded apart: {b_path}")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lone = [self.b.piece_to_id(SPACE)]
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))

    def _a(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units (of so many bytes with their space), one after the other, and where each unit's end; one call for all, but for those that end in a space or are empty."""
        odd = [i for i, u in enumerate(units) if not u or u[-1].isspace()]
        ids, ends, low = [], [], 0
        for i in [*odd, len(units)]:
            if plain := units[low:i]:
                made = np.array(self.a.encode_ordinary(" " + " ".join(plain)), np.int64)
                want = np.cumsum(sizes[low:i])
                ids.append(made)
                ends.append(np.searchsorted(np.cumsum(self.a_size[made]), want) + 1)
            if i < len(units):
                ids.append(np.array(self.a.encode_ordinary(" " + units[i]), np.int64))
                ends.append(np.array([len(ids[-1])]))
            low = i + 1
        before = np.cumsum([0, *map(len, ids)])
        return np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([np.zeros(1, np.int64), *(e + n for e, n in zip(ends, before, strict=False))])

    def _b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [ids or self.lone for ids in self.b.encode(units, num_threads=1)]  # the model adds the space
        return np.fromiter(itertools.chain.from_iterable(made), np.int64), np.cumsum([0, *map(len, made)])

    def encode(self, units: list[str]) -> tuple[list[bool], tuple, tuple]:
        """Whether the tokens of space and unit have its bytes on both sides, and the ids and their ends on both."""
        want = "".join([" " + u for u in units]).encode()
        size = np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)) + 1
        cut = np.concatenate([[0], np.cumsum(size)])
        good, sides = np.ones(len(units), bool), []
        for (ids, ends), names, sizes in ((self._a(units, size), self.a_bytes, self.a_size), (self._b(units), self.b_bytes, self.b_size)):
            at = np.concatenate([[0], np.cumsum(sizes[ids])])[ends]
            have = b"".join([names[i] for i in ids.tolist()])
            if have != want or (at != cut).any():  # rare: look at each
                good &= [have[at[i] : at[i + 1]] == want[cut[i] : cut[i + 1]] for i in range(len(units))]
            sides.append((ids, ends))
        return good.tolist(), *sides


class _Block:
    """Numbers of the distinct units of a block of texts, their tokens, and how often texts with tokens use them."""

    def __init__(self, number: int) -> None:
        self.number, self.chars, self.used = number, 0, 0
        self.numbers: dict[str, int] = {}
        self.ids, self.sizes = ([], []), ([], [])
        self.uses = np.zeros(0, np.int64)

    def add(self, texts: list[str | None], pair: Pair) -> list[np.ndarray]:
        """The numbers of each text's units; none where some unit has no tokens."""
        split = [units_of(t) if t else [] for t in texts]
        new = list(set().union(*split) - self.numbers.keys())
        good, *sides = pair.encode(new)
        bad = {u for u, ok in zip(new, good, strict=True) if not ok}
        new = [u for u, ok in zip(new, good, strict=True) if ok] if bad else new
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        for (ids, ends), all_ids, all_sizes in zip(sides, self.ids, self.sizes, strict=True):
            size = np.diff(ends)
            if bad:
                ids, size = ids[np.repeat(good, size)], size[good]
            all_ids.append(ids.astype(np.int32))
            all_sizes.append(size.astype(np.int32))
        rows = [np.fromiter(map(self.numbers.__getitem__, units), np.int32, len(units)) if not bad or bad.isdisjoint(units) else np.zeros(0, np.int32) for units in split]
        uses = np.bincount(np.concatenate(rows), minlength=len(self.numbers)) if rows else np.zeros(len(self.numbers), np.int64)
        uses[: len(self.uses)] += self.uses
        self.uses, self.used = uses, self.used + sum(map(len, rows))
        return rows

    @property
    def full(self) -> bool:
        return len(self.numbers) >= UNITS or self.chars >= UNIT_CHARS or self.used >= USES

    def rows(self, pair: Pair, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        """All units with their tokens, in the order of their numbers."""
        if not self.numbers:
            return
        sides = [(np.concatenate(i), np.concatenate([[0], np.cumsum(np.concatenate(n))])) for i, n in zip(self.ids, self.sizes, strict=True)]
        for low in range(0, len(self.numbers), 10_000):
            high = min(low + 10_000, len(self.numbers))
            cols = {"blk": pa.array(np.full(high - low, self.number)), "unit": pa.array(np.arange(low, high, dtype=np.int32)), "uses": pa.array(self.uses[low:high])}
            for side, sizes, (ids, ends) in zip("ab", (pair.a_size, pair.b_size), sides, strict=True):
                at = ends[low : high + 1] - ends[low]
                values = ids[ends[low] : ends[high]]
                so_far = np.concatenate([[0], np.cumsum(sizes[values])])
                cols[side] = _lists(at, values)
                cols[f"{side}e"] = _lists(at, so_far[1:] - np.repeat(so_far[at[:-1]], np.diff(at)))
            yield _batch(cols, high - low, kinds)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32)))


def _batch(cols: dict, n: int, kinds: pa.Schema) -> pa.RecordBatch:
    """Rows of one kind; lists of the other are empty (Spark is slow to pass on null lists), its other columns null."""
    none = _lists(np.zeros(n + 1, np.int32), np.zeros(0, np.int32))
    missing = lambda f: none if pa.types.is_list(f.type) else pa.nulls(n, f.type)
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else missing(f) for f in kinds], schema=kinds)


def _encoded(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 33
    pair, block, n = None, _Block(first), first
    for whole in batches:
        ints = pa.list_(pa.int32())
        kinds = pa.schema([("blk", pa.int64()), ("rid", pa.int64()), ("id", whole.schema.field(0).type), ("units", ints), ("unit", pa.int32()), ("uses", pa.int64()), ("a", ints), ("ae", ints), ("b", ints), ("be", ints)])
        pair = pair or Pair(a_path, b_path)
        for batch in slices(whole, "text", SLICE):
            rows = block.add(batch.column(1).to_pylist(), pair)
            cols = {"blk": pa.array(np.full(len(rows), block.number)), "rid": pa.array(np.arange(n, n + len(rows))), "id": batch.column(0)}
            cols["units"] = _lists(np.cumsum([0, *map(len, rows)]), np.concatenate(rows))
            yield _batch(cols, len(rows), kinds)
            n += len(rows)
            if block.full:
                yield from block.rows(pair, kinds)
                block = _Block(block.number + 1)
    if pair:
        yield from block.rows(pair, kinds)
    del block, pair  # the worker lives on and serves other stages
    pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A bucketed table of two kinds of rows: (blk, rid, id, units) for every row of ``docs``, and with null rid (blk, unit, uses, a, ae, b, be) for every distinct unit of a block.

    ``units``: the units of a text by number; a, b: token ids; ae, be: where the tokens end in the unit, in bytes. The paths name files that every executor has.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"blk long, rid long, id {kind}, units array<int>, unit int, uses long, a array<int>, ae array<int>, b array<int>, be array<int>"
    batches = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    with _settings(docs.sparkSession, batches):
        return bucketed(rows.mapInArrow(lambda b: _encoded(b, a_path, b_path), schema), "blk", "encoded", SPREAD, rising="unit")


#: Joins on (blk, unit, end) may use rows dealt out by blk: tokens, far more than texts, are then not shuffled.
BY_FIRST_KEY = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def meetings(lists: DataFrame, by: tuple, carry: tuple = ()) -> DataFrame:
    """(by, end, pa, pb, a, b, carry): one row for each place where both sides of a text end a token, as ``cuts`` has them but not numbered.

    ``lists`` has a, ae, b, be: the ids of each text's tokens, and where they end. Buckets of the first column are used, where ``lists`` has them.
    """

    def tokens(ids: str, ends: str, at: str, *more: str) -> DataFrame:
        return lists.select(*by, *more, ids, F.posexplode(ends).alias(at, "end")).withColumn(ids, F.col(ids)[F.col(at)])

    keys = [*by[1:], "end", by[0]]  # a sort then tells most rows apart by its first key
    both = tokens("a", "ae", "pa", *carry).hint("merge").join(tokens("b", "be", "pb"), keys)
    return both.select(*by, "end", "pa", "pb", "a", "b", *carry)


def cuts(lists: DataFrame, by: tuple, carry: tuple = ()) -> DataFrame:
    """(by, g, pa, pb, a, b, carry): one row for each place where both sides of a text end a token.

    ``lists`` has a, al, b, bl for each text, which the columns ``by`` name. g: the cut's number, that of the group it ends; pa, pb: the places of the tokens
    that end there; a, b: their ids. The group's tokens are those after the last cut's up to these. Buckets of the first column are used, where ``lists`` has them.
    """
    keys = [F.col(c) for c in by]

    def ends(ids: str, sizes: str, at: str, *more: str) -> DataFrame:
        so_far = W.Window.partitionBy(*keys).orderBy(at).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        tokens = lists.select(*keys, *more, F.posexplode(F.arrays_zip(F.col(ids).alias("i"), F.col(sizes).alias("n"))).alias(at, "t"))
        return tokens.select(*keys, *more, at, F.col("t.i").alias(ids), F.sum("t.n").over(so_far).alias("end"))

    both = ends("a", "al", "pa", *carry).hint("merge").join(ends("b", "bl", "pb"), [*by, "end"])
    number = F.row_number().over(W.Window.partitionBy(*keys).orderBy("end")).alias("g")
    return both.select(*keys, number, "pa", "pb", "a", "b", *carry)


def groups(cut: DataFrame, lists: DataFrame, by: tuple) -> DataFrame:
    """(by, g, a, b): the token ids of both sides between two cuts."""
    order = W.Window.partitionBy(*by).orderBy("g")
    spans = cut.select(*by, "g", *((F.lag(p, 1, -1).over(order) + 2).alias(f"from_{p}") for p in ("pa", "pb")), "pa", "pb")
    piece = lambda ids, p: F.slice(ids, F.col(f"from_{p}"), F.col(p) - F.col(f"from_{p}") + 2).alias(ids)
    return spans.join(lists.select(*by, "a", "b"), list(by)).select(*by, "g", piece("a", "pa"), piece("b", "pb"))


def group_links(found: DataFrame, by: tuple) -> DataFrame:
    """(by, g, a, b): every token of a group's one side with every one of the other, for those who want more than tokens that end together."""
    return found.select(*by, "g", F.explode("a").alias("a"), "b").select(*by, "g", "a", F.explode("b").alias("b"))


def pair_counts(links: DataFrame, uses: str = "uses") -> DataFrame:
    """(a, b, count, best): how many links hold an id pair, and whether no pair with this b has more."""
    counts = materialize(links.groupBy("a", "b").agg(F.sum(uses).alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return materialize(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _ordered(rows: pa.Table, *by: str) -> pa.Table:
    """Rows by one or two columns of small numbers; they mostly are in that order, as they were written so."""
    key = rows[by[0]].to_numpy().astype(np.int64)
    for c in by[1:]:
        key = (key << 32) + rows[c].to_numpy()
    return rows if (key[1:] >= key[:-1]).all() else rows.take(pa.array(np.argsort(key, kind="stable")))


def _gather(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block (blk, rid, id, units, unit, a, b) from its links (blk, unit, pa, pb, count, best), which come in any order."""
    texts, units = left.filter(pc.is_valid(left["rid"])), _ordered(left.filter(pc.is_null(left["rid"])), "unit")
    right = _ordered(right, "unit", "pa")
    unit, best, count = (right[c].to_numpy() for c in ("unit", "best", "count"))
    first = np.searchsorted(unit, np.arange(len(units) + 1))  # each unit has a cut, its end
    shown, sizes = [], []
    for side, at in (("a", "pa"), ("b", "pb")):
        ids = units[side].combine_chunks()
        ends = ids.offsets.to_numpy()
        sizes.append(np.diff(ends))
        cut = np.concatenate([[0], ends[unit] - ends[0] + right[at].to_numpy() + 1])
        shown.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), ids.flatten().cast(pa.string())), ","))
    t = pc.binary_join_element_wise(*shown, "|").cast(pa.large_string())
    semicolon = pa.scalar(";", pa.large_string())
    t = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), t), semicolon)
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    per = [*sizes, np.diff(first), np.diff(first), np.diff(before(best)[first]), np.diff(before(count)[first])]
    lists = texts["units"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    ends = ends - ends[0]
    cols = {c: pa.array(np.diff(before(x[flat])[ends]).astype(np.int64)) for c, x in zip(FIGURES, per, strict=True)}
    parts, low = [], 0
    while low < len(texts):  # some texts at a time
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + GATHER, side="right")) - 1)
        own = t.take(pa.array(flat[ends[low] : ends[high]]))
        parts.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends[low : high + 1] - ends[low], pa.int64()), own), semicolon))
        low = high
    return pa.table({"id": texts["id"], **cols, "groups_text": pa.chunked_array(parts, pa.large_string()).cast(pa.string())})


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_text) of every row; groups: ``a1,a2|b1;a3|b2,b3``."""
    both = encode(docs, a_path, b_path, doc_id, text)
    with _settings(docs.sparkSession, BY_FIRST_KEY):
        links = bucketed(meetings(both.where("rid is null"), ("blk", "unit"), ("uses",)).drop("end"), "blk", "links", SPREAD, rising="unit")
    pairs = pair_counts(links)
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    counted = links.join(F.broadcast(pairs) if few else pairs, ["a", "b"]).select("blk", "unit", "pa", "pb", "count", "best")
    sides = both.select("blk", "rid", "id", "units", "unit", "a", "b").groupBy("blk").cogroup(counted.groupBy("blk"))
    kind = both.schema["id"].dataType.simpleString()
    return sides.applyInArrow(_gather, f"id {kind}, " + ", ".join(f"{c} long" for c in FIGURES) + ", groups_text string")
