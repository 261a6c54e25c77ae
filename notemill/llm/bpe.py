"""Byte-level BPE encoding and decoding.

Texts are split into words by the vocabulary's pattern. Words that are tokens themselves need no merge; every
other word is folded: as an array of byte ids, one ranked merge a step, by a Spark ``aggregate`` against a
literal rank map of token pairs. Of the words of the whole table those that several packs of
documents have are folded once, into a dictionary of bounded size (the most frequent first), which
every task gets; what else a pack has is folded in the pack's own row, by the same expression, after the packs
are written. Then each pack puts its documents together from its words. Documents are never shuffled, words only
to be counted.

``fold`` chooses: "table" (default) as above, "functions" without the dictionary, "arrays" the same steps in numpy
for all words of a pack at once. Words over FOLD_BYTES are merged with a heap.

Defined results: a null or empty text has no ids and decodes to no bytes; equal
texts and repeated rows give equal ids; very long texts are packs of their own. Further columns stay as they
are, one with the name of the result is replaced. Ids outside the vocabulary, and null ids, raise an error
when decoded; a null list decodes to no bytes. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import map_batches, spare, stored, table
from notemill.llm.pretokenize import bytes_of, cuts, offsets_of, packs

PACK = 3 << 20           # text bytes of a pack, unless one text alone has more
DICTIONARY_WORDS = 1_500_000   # words that every task gets folded, at most
TASK_WORDS = 200_000     # words that a task counts before it hands them on
FOLD_BYTES = 256         # longer words are merged with a heap: a fold step copies the whole word
SLICE = 1 << 15          # words that are hashed at once
EDGE = 65_535            # stands before and after each word; is in no pair; ranks are below it


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[bytes, ...]:
    """The pieces of a rank file (base64 piece, rank), by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    pieces: list[bytes] = [b""] * len(pairs)
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    if len(pieces) >= EDGE:
        raise ValueError("the rank map packs ids into 16 bits")
    return tuple(pieces)


@lru_cache(maxsize=4)
def _rank_map(pieces: tuple[bytes, ...]) -> tuple[str, str]:
    """Shifts of the left ids and table of the rows of pairs, as JSON: each way to cut a piece in two pieces.

    The pairs of a left id are a row, with each right id at a place of its own. Rows lie over each other in one table, shifted
    so that no two pairs meet: the pair (left, right) is at shift[left] + right, as left * 65,536 + rank.
    """
    ranks = {p: i for i, p in enumerate(pieces)}
    found = np.array([(ranks[p[:c]], ranks[p[c:]], r) for p, r in ranks.items()
                      for c in range(1, len(p)) if p[:c] in ranks and p[c:] in ranks], np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    first = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
    sizes = np.diff(np.append(first, len(found)))
    place, used = np.zeros(len(found), np.int64), 0   # used: the places taken, as bits of one number
    for k in np.argsort(-sizes, kind="stable")[:int((sizes > 1).sum())].tolist():   # long rows first, each where it fits first
        rights = (found[first[k]:first[k] + sizes[k], 1] - found[first[k], 1]).tolist()
        taken = 0
        for r in rights:
            taken |= used >> r
        at = (~taken & (taken + 1)).bit_length() - 1
        used |= sum(1 << r for r in rights) << at
        place[first[k]:first[k] + sizes[k]] = at + np.array(rights)
    single = first[sizes == 1]   # these fill what is free
    bits = np.frombuffer(used.to_bytes(used.bit_length() // 8 + len(single) // 8 + 1, "little"), np.uint8)
    place[single] = np.flatnonzero(np.unpackbits(bits, bitorder="little") == 0)[:len(single)]
    shift, table = np.zeros(len(pieces), np.int64), np.zeros(int(place.max(initial=-1)) + 1, np.int64)
    shift[found[:, 0]] = place - found[:, 1]
    table[place] = found[:, 0] * (EDGE + 1) + found[:, 2]
    # no entry is 0: a piece is no pair of itself and another one
    return tuple(json.dumps(x, separators=(",", ":")) for x in (shift.tolist(), [x or None for x in table.tolist()]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(words: Column, pieces: tuple[bytes, ...]) -> Column:
    """Array of words (arrays of byte ids) to array of words as token ids.

    A step merges the leftmost pair of the lowest rank. ``ranks[i]`` belongs to
    the pair (ids[i], ids[i + 1]): up to EDGE it can merge, else not; a merge
    changes two of them, so that a step looks up two pairs only.
    """
    # from_json of a literal is folded into one literal; bound once, it stands once in the plan. Two flat arrays: nested ones
    # are several objects a slot, which the driver writes and each task reads again
    shifts, pairs = (F.from_json(F.lit(x), "array<bigint>") for x in _rank_map(pieces))

    def one(shift: Column, table: Column, word: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            # the entry of another left id differs from this one's in the upper bits
            entry = F.get(table, (F.get(shift, left.cast("int")) + right).cast("int"))
            return entry.bitwiseXOR(left * (EDGE + 1))

        def merge(state: Column) -> Column:
            ids, ranks = state["ids"], state["ranks"]

            def at(p: Column) -> Column:
                new = state["lowest"]
                kept = F.struct(
                    F.concat(F.slice(ids, F.lit(1), p - 1), F.array(new),
                             F.slice(ids, p + 2, F.lit(FOLD_BYTES + 2))).alias("ids"),
                    F.concat(F.slice(ranks, F.lit(1), p - 2),
                             F.array(rank(F.get(ids, p - 2), new), rank(new, F.get(ids, p + 1))),
                             F.slice(ranks, p + 2, F.lit(FOLD_BYTES + 2))).alias("ranks"))
                return _let(kept, lambda s: F.struct(s["ids"].alias("ids"), s["ranks"].alias("ranks"),
                                                     F.array_min(s["ranks"]).alias("lowest")))

            return F.when(state["lowest"] < EDGE, _let(F.array_position(ranks, state["lowest"]).cast("int"), at)
                          ).otherwise(state)

        edge = F.array(F.lit(EDGE).cast("bigint"))
        start = _let(F.concat(edge, word, edge), lambda ids: _let(
            F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: rank(F.get(ids, i), F.get(ids, i + 1))),
            lambda ranks: F.struct(ids.alias("ids"), ranks.alias("ranks"), F.array_min(ranks).alias("lowest"))))
        folded = F.aggregate(F.sequence(F.lit(1), F.size(word)), start, lambda state, _: merge(state),
                             lambda state: state["ids"])
        return _let(folded, lambda ids: F.slice(ids, F.lit(2), F.size(ids) - 2).cast("array<int>"))

    return _let(shifts, lambda shift: _let(pairs, lambda table: F.transform(words, lambda w: one(shift, table, w))))


_RANKS: dict[int, dict[bytes, int]] = {}


def _ranks_of(pieces: tuple[bytes, ...]) -> dict[bytes, int]:
    """Piece to rank, made once in a Python worker for a vocabulary."""
    key = hash(pieces)
    if key not in _RANKS:
        _RANKS.clear()
        _RANKS[key] = {p: i for i, p in enumerate(pieces)}
    return _RANKS[key]


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word in O(n log n): a heap of pairs over linked parts."""
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n

    def entry(i: int) -> tuple[int, int, int] | None:
        if i < 0 or end[i] >= n:
            return None
        r = ranks.get(word[i:end[end[i]]])
        return None if r is None else (r, i, end[end[i]])

    heap = [e for i in range(n) if (e := entry(i))]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != stop:
            continue
        live[end[i]] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
        for e in (entry(left[i]), entry(i)):
            if e:
                heapq.heappush(heap, e)
    return [ranks[word[i:end[i]]] for i in range(n) if live[i]]


_PAIRS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pair_arrays(pieces: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The rank map as sorted pair keys and their ranks, made once in a Python worker."""
    key = hash(pieces)
    if key not in _PAIRS:
        ranks = _ranks_of(pieces)
        found = sorted(((ranks[p[:c]] << 16) + ranks[p[c:]], r) for p, r in ranks.items()
                       for c in range(1, len(p)) if p[:c] in ranks and p[c:] in ranks)
        _PAIRS.clear()
        _PAIRS[key] = (np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int32))
    return _PAIRS[key]


def fold_arrays(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, ranks: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
    """``fold_merges`` for words given as byte ids ``raw`` cut at ``offsets``; gives ids and offsets.

    Words of about the same length form a matrix; each step merges the leftmost
    lowest pair of every row that still has one.
    """
    none = np.int32(EDGE)

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left.astype(np.int64) << 16) + right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, ranks[at], none).astype(np.int32)

    sizes = np.diff(offsets)
    counts, parts = np.zeros(len(sizes), np.int64), []
    low = 0
    for high in (4, 6, 8, 10, 12, 16, 24, 48, 96, FOLD_BYTES):
        group = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        if not len(group):
            continue
        width = np.arange(high)
        # an edge on both sides, so that every pair has two neighbours
        ids = np.full((len(group), high + 2), EDGE, np.int32)
        inside = width[None, :] < sizes[group][:, None]
        ids[:, 1:-1][inside] = raw[np.repeat(offsets[:-1][group], sizes[group]) + _runs(sizes[group])]
        pair_ranks = rank(ids[:, :-1], ids[:, 1:])
        todo, done = np.arange(len(group)), np.empty_like(ids)
        while len(todo):
            at = pair_ranks.argmin(1)
            row = np.arange(len(at))
            lowest = pair_ranks[row, at]
            ended = lowest == none
            if ended.any():
                done[todo[ended], :ids.shape[1]] = ids[ended]
                done[todo[ended], ids.shape[1]:] = EDGE
                todo, ids, pair_ranks, at, lowest = (x[~ended] for x in (todo, ids, pair_ranks, at, lowest))
                row = np.arange(len(at))
                if not len(todo):
                    break
            shift = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, shift + (shift > at[:, None]), 1)
            ids[row, at] = lowest
            shift = shift[:, :-1]
            pair_ranks = np.take_along_axis(pair_ranks, shift + (shift >= at[:, None]), 1)
            pair_ranks[row, at - 1] = rank(ids[row, at - 1], lowest)
            pair_ranks[row, at] = rank(lowest, ids[row, at + 1])
        real = done != EDGE
        counts[group] = real.sum(1)
        parts.append((group, done[real]))
    ends = offsets_of(counts)
    out = np.empty(int(ends[-1]), np.int32)
    for group, flat in parts:
        out[np.repeat(ends[:-1][group], counts[group]) + _runs(counts[group])] = flat
    return out, ends


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def take_lists(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``index`` of (flat, offsets) one after another, and their offsets."""
    sizes = np.diff(offsets)[index]
    ends = offsets_of(sizes)
    at = np.repeat((offsets[:-1][index] - ends[:-1]).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], ends


class Dictionary:
    """Folded words, with the ids of each, in any order. What finds a word is made where one is looked up first."""

    def __init__(self, data: bytes = b"", word_sizes=(), flat=(), id_sizes=()):
        """From words and ids one after another."""
        self.data, self.word_sizes = data, np.asarray(word_sizes, np.uint16)
        self.flat, self.id_sizes = np.asarray(flat, np.uint16), np.asarray(id_sizes, np.uint16)

    @classmethod
    def of(cls, rows: Iterable) -> Dictionary:
        """From rows of (word_sizes, id_sizes, words, ids), one row held beside the result."""
        parts = [bytearray() for _ in range(4)]
        for row in rows:
            for part, piece in zip(parts, row, strict=True):
                part += piece
        word_sizes, id_sizes, data, flat = parts
        return cls(data, *(np.frombuffer(x, np.uint16) for x in (word_sizes, flat, id_sizes)))

    def __len__(self) -> int:
        return len(self.word_sizes)

    def word(self, k: int) -> bytes:
        return bytes(self.data[self.word_ends[k]:self.word_ends[k + 1]])

    @cached_property
    def word_ends(self) -> np.ndarray:
        return offsets_of(self.word_sizes).astype(np.int32)

    @cached_property
    def id_ends(self) -> np.ndarray:
        return offsets_of(self.id_sizes).astype(np.int32)

    @cached_property
    def by_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, ascending, and the place of each."""
        hashes = np.empty(len(self), np.uint64)
        for a in range(0, len(hashes), SLICE):
            ends = self.word_ends[a:a + SLICE + 1].tolist()
            hashes[a:a + SLICE] = [xxhash.xxh3_64_intdigest(self.data[x:y]) for x, y in zip(ends, ends[1:])]
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        return hashes[order], order

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1; words with one hash are told apart by their bytes."""
        if not len(self):
            return np.full(len(words), -1)
        ordered, places = self.by_hash
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
        place = np.where(ordered[at] == hashes, places[at], -1)
        known = np.flatnonzero(place >= 0)
        starts, ends = self.word_ends[place[known]].tolist(), self.word_ends[place[known] + 1].tolist()
        for k, a, b in zip(known.tolist(), starts, ends):
            if self.data[a:b] != words[k]:
                place[k] = -1
        return place


def fold_dictionary(docs: DataFrame, pieces: tuple[bytes, ...], pattern: str, text: str, pack_bytes: int = PACK,
                    max_words: int = DICTIONARY_WORDS) -> Dictionary:
    """Words of several packs, folded once, at most about ``max_words``, those of most packs first.

    Only these bounded rows reach the driver.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)

    def counted(batches: Iterator[pa.RecordBatch]):
        """Words to fold and the number of packs that have them, of TASK_WORDS words or a few more at once."""
        ranks, found = _ranks_of(vocabulary.value), Counter()

        def flush():
            words = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return words

        for batch in batches:
            for _, _, flat, _ in packs(batch.column(0), pattern, pack_bytes):
                found.update([w for w in bytes_of(flat.dictionary_encode().dictionary) if w not in ranks and len(w) <= FOLD_BYTES])
                if len(found) >= TASK_WORDS:
                    yield flush()
        yield flush()

    def to_bytes(batch: pa.RecordBatch):
        byte_ids = np.array([_ranks_of(vocabulary.value)[bytes([b])] for b in range(256)], np.int64)
        words = batch.column("word").to_pylist()
        ends = offsets_of(np.array([len(w) for w in words], np.int64))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), pa.array(byte_ids[np.frombuffer(b"".join(words), np.uint8)])), batch.column("n")], ["raw", "n"])

    words = docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(counted, T.StructType.fromDDL("word binary, n bigint"))
    several = stored(map_batches(words.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").sortWithinPartitions("word"), to_bytes,
                                 T.StructType.fromDDL("raw array<bigint>, n bigint")), "words")
    # rows by powers of two of their packs; the least power with which the words still fit
    steps = sorted(((r["b"], r["c"]) for r in several.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    least, total = 64, 0
    for power, n in steps:
        if total + n > max_words:
            break
        least, total = power, total + n
    folded = several.filter(F.col("n") >= float(2 ** least)).select("raw", F.get(fold_merges(F.array("raw"), pieces), F.lit(0)).alias("ids"))
    back = np.zeros(len(pieces), np.uint8)
    for i, piece in enumerate(pieces):
        if len(piece) == 1:
            back[i] = piece[0]

    def compact(batch: pa.RecordBatch):
        sizes = [pc.list_value_length(batch.column(c)).to_numpy().astype(np.uint16).tobytes() for c in ("raw", "ids")]
        values = [batch.column("raw").flatten().to_numpy(), batch.column("ids").flatten().to_numpy().astype(np.uint16)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*sizes, back[values[0]].tobytes(), values[1].tobytes())],
                                         ["word_sizes", "id_sizes", "words", "ids"])

    # folded by all tasks first; then the driver takes the few rows of one partition after another
    rows = map_batches(folded, compact, T.StructType.fromDDL("word_sizes binary, id_sizes binary, words binary, ids binary")).rdd.persist(StorageLevel.DISK_ONLY)
    rows.count()
    found = Dictionary.of(rows.toLocalIterator())
    rows.unpersist()
    return found


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
           drop_text: bool = False, pack_bytes: int = PACK, fold: str = "table", max_words: int = DICTIONARY_WORDS,
           then: Callable[[T.StructType], tuple[Callable, T.StructType]] | None = None) -> DataFrame:
    """Adds the column ``ids`` (array of int): each match of ``pattern`` encoded by itself.

    ``drop_text`` leaves the text out of the result. ``fold``: see the module; "table" counts words at once.
    ``then`` gives, for the schema of the result, a function of its batches and the schema of what that makes of
    them: it runs in the tasks that put documents together, so that ids need not be written for it.
    """
    if fold not in ("table", "arrays", "functions"):
        raise ValueError("fold is 'table', 'arrays' or 'functions'")
    pieces = load_ranks(ranks_path)
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(pieces)  # bounded by the 16-bit ids
    folded = fold_dictionary(docs, pieces, pattern, text, pack_bytes, max_words) if fold == "table" else Dictionary()
    # bounded by max_words; those who look words up need no ids, those who put documents together no words
    dictionary = context.broadcast(Dictionary(folded.data, folded.word_sizes))
    word_ids = context.broadcast(Dictionary(flat=folded.flat, id_sizes=folded.id_sizes))
    del folded
    keep = [c for c in docs.columns if not (drop_text and c == text) and c.lower() != ids.lower()]
    copy = spare(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(copy))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    step, made = then(schema) if then else (lambda batch: [batch], schema)

    def cut(batch: pa.RecordBatch):
        """Of each pack: its rows, ends of the rows, word index, tokens of the words, places in the dictionary, and the words to fold."""
        ranks, known = _ranks_of(vocabulary.value), dictionary.value
        byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        rest = batch.select(keep)
        for a, b, flat, offsets in packs(batch.column(copy), pattern, pack_bytes):
            coded = flat.dictionary_encode()
            words = coded.dictionary
            values, length = bytes_of(words), pc.binary_length(words).to_numpy()
            # of a word: its token, or -1 if it is to be folded, -2 if it is too long for that, -3 if it is in the dictionary
            token = np.array([ranks.get(w, -1) for w in values], np.int32)
            token[(token < 0) & (length > FOLD_BYTES)] = -2
            open_ = np.flatnonzero(token == -1)
            place = known.places([values[i] for i in open_])
            token[open_[place >= 0]] = -3
            folded = open_[place < 0]
            raw = byte_ids[np.frombuffer(b"".join([values[i] for i in folded]), np.uint8)]
            yield (rest.slice(a, b - a), offsets, coded.indices.to_numpy(), token, place[place >= 0].astype(np.int32),
                   raw, offsets_of(length[folded]), [values[i] for i in np.flatnonzero(token == -2)])

    def joined(rest, ends, index, token, places, flat, offsets, long_words):
        """The rows of a pack with their ids, from the ids of its words."""
        long_ids = [np.array(heap_merges(w, _ranks_of(vocabulary.value)), np.int32) for w in long_words]
        looked, at = take_lists(word_ids.value.flat, word_ids.value.id_ends, places)
        pool = np.concatenate([token[token >= 0], flat, *long_ids, looked]).astype(np.int32)
        sizes = np.concatenate([np.ones(int((token >= 0).sum()), np.int64), np.diff(offsets),
                                np.array([len(x) for x in long_ids], np.int64), np.diff(at)])
        place = np.empty(len(token), np.int64)  # of each word in the pool: tokens, folded, long, looked up
        place[np.concatenate([np.flatnonzero(token >= 0), *[np.flatnonzero(token == k) for k in (-1, -2, -3)]])] = np.arange(len(token))
        out, at = take_lists(pool, offsets_of(sizes), place[index])
        lists = pa.ListArray.from_arrays(pa.array(at[ends].astype(np.int32)), pa.array(out))
        return pa.RecordBatch.from_arrays([*rest.columns, lists], [*keep, ids])

    if fold == "arrays":
        def run(batch: pa.RecordBatch):
            keys, values = _pair_arrays(vocabulary.value)
            for rest, ends, index, token, places, raw, offsets, long_words in cut(batch):
                yield from step(joined(rest, ends, index, token, places, *fold_arrays(raw, offsets, keys, values), long_words))

        return map_batches(source, run, made)

    def pack(batch: pa.RecordBatch):
        for rest, ends, index, token, places, raw, offsets, long_words in cut(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_batch(rest)
            words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(raw))
            yield pa.RecordBatch.from_arrays([
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (ends, index, token, places)],
                pa.array([long_words], pa.list_(pa.binary())),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
            ], ["rest", *_NUMBERS, "long", "words"])

    def unpack(batch: pa.RecordBatch):
        for k in range(batch.num_rows):
            rest = pa.ipc.open_stream(batch.column("rest")[k].as_py()).read_next_batch()
            ends, index, token, places = (np.frombuffer(batch.column(c)[k].as_py(), np.int32) for c in _NUMBERS)
            words = batch.column("words")[k].values
            sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
            yield from step(joined(rest, ends, index, token, places, words.flatten().to_numpy(), offsets_of(sizes), batch.column("long")[k].as_py()))

    packed = map_batches(source, pack, T.StructType.fromDDL(
        f"rest binary, {', '.join(f'{c} binary' for c in _NUMBERS)}, long array<binary>, words array<array<bigint>>"))
    # written before the fold, so that a task has one Python worker beside it, not one on either side
    packed = stored(packed, "packs", compression="zstd")
    dictionary.destroy()   # nothing looks words up any more
    return map_batches(packed.withColumn("words", fold_merges(F.col("words"), pieces)), unpack, made)


_NUMBERS = ("ends", "position", "token", "places")


def _byte_pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), offsets_of(np.array([len(v) for v in values], np.int64))


_POOLS: dict[int, tuple] = {}


def _pools(pieces: tuple[bytes, ...]) -> tuple:
    """The pools of pieces and of decimal numbers, made once in a Python worker for a vocabulary."""
    key = hash(pieces)
    if key not in _POOLS:
        _POOLS.clear()
        _POOLS[key] = (_byte_pool(pieces), _byte_pool([b"%d " % i for i in range(EDGE)]))
    return _POOLS[key]


def row_bytes(lists: pa.ListArray, pool: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> list[bytes]:
    """Of each row the pool's entries at its ids, joined; in steps of about ``step`` ids."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    if len(flat) and (lists.flatten().null_count or flat.min() < 0 or flat.max() >= len(offsets) - 1):
        raise ValueError("an id is null or outside the vocabulary")
    ends, out = ends - ends[0], []
    for a, b in cuts(np.diff(ends), step):
        data, at = take_lists(pool, offsets, flat[ends[a]:ends[b]])
        data, at = data.tobytes(), at[ends[a:b + 1] - ends[a]].tolist()
        out += [data[x:y] for x, y in zip(at, at[1:], strict=False)]
    return out


def decode(frame: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the column ``into`` (binary): the pieces of ``ids`` one after another."""
    vocabulary = frame.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    keep = [c for c in frame.columns if c.lower() != into.lower()]

    def run(batch: pa.RecordBatch):
        pool = _byte_pool(vocabulary.value)
        sizes = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy()
        for a, b in cuts(sizes, 1 << 18):
            part = batch.slice(a, b - a)
            texts = pa.array(row_bytes(part.column(ids), *pool), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.select(keep).columns, texts], [*keep, into])

    return map_batches(frame, run, T.StructType([*[frame.schema[c] for c in keep], T.StructField(into, T.BinaryType())]))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, with digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, public_tokenizers.PATTERN, drop_text=True, then=digests(spark, path))


def round_trip(coded: DataFrame, ranks_path: str, keep: tuple[str, ...] = (), ids: str = "ids") -> DataFrame:
    """doc_id, the columns ``keep``, number of ids, sha256 of the ids as decimal text and of the bytes they decode to."""
    source = coded if ids in keep else coded.select("doc_id", *keep, ids)
    return map_batches(source, *digests(coded.sparkSession, ranks_path, keep, ids)(coded.schema))


def digests(spark, ranks_path: str, keep: tuple[str, ...] = (), ids: str = "ids") -> Callable[[T.StructType], tuple[Callable, T.StructType]]:
    """``round_trip`` as a step on batches, for ``encode``: from a schema the function and the schema of its results.

    Decoding and digests in one pass, of about a megabyte of ids at a time.
    """
    vocabulary = spark.sparkContext.broadcast(load_ranks(ranks_path))
    first = ["doc_id", *keep]

    def run(batch: pa.RecordBatch):
        pieces, numbers = _pools(vocabulary.value)
        lists = batch.column(ids)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        for a, b in cuts(np.diff(ends), 1 << 18):
            part = lists.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).slice(a, b - a) for c in first], pc.fill_null(pc.list_value_length(part), 0).cast(pa.int64()),
                pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in row_bytes(part, *numbers)]),
                pa.array([hashlib.sha256(x).hexdigest() for x in row_bytes(part, *pieces)])],
                [*first, "n_tokens", "ids_sha256", "decoded_sha256"])

    made = T.StructType.fromDDL("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return lambda schema: (run, T.StructType([*[schema[c] for c in first], *made.fields]))
