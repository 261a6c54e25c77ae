"""Token ids in directly addressable codes.

A file holds the ids of a run of documents. An id is cut into chunks of 8 bits;
level 0 has the lowest chunk of every id, level 1 the next chunk of the ids that
have one, and so on. A bitmap at each level says which ids go on; a directory
counts its ones up to every 512th bit. Id number i is found by following its
place through the levels: place at the next level = rank of the bit, one count
from the directory and a popcount. No block is decoded for it.

Files are rows of a table in the shared folder (payload and where it starts), so
that any store Spark can write to will do. Documents are dealt to parts by ranges of their ids and
sorted in them; a file knows how many tokens its part has before it, and where a part starts is
a sum over the parts before, of which there is one number each.

Layout of a payload, little-endian: magic "DAC1", levels u32, documents u32,
then for each level its length u64; then the document ends (u64 each), and for
each level the chunks, the bitmap in whole u64 words and the directory (u64 each).

Defined results: a null text counts as empty and has the end id only; rows with
a null id come first, equal ids in the order of their text's hash; an empty table
gives no file and no rows. A very long text is a file of its own. Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import fits, map_batches, stored, table
from notemill.llm.pretokenize import PATTERN, bytes_of, offsets_of, packs

FILE_TOKENS = 1 << 20    # ids of a file, about
STRIDE = 512             # bits between two counts of a directory
LINES = 2_048            # words that the library encodes at once
CACHE_WORDS = 2_000_000  # encoded words that a Python worker keeps, in some thirty bytes each
PACK = 4 << 20           # text bytes that are encoded at once
PART_BYTES = 32 << 20    # text bytes of a part, about: the files that one task writes
MAX_PARTS = 100_000
PROBES = 4_096           # ids of a file that are read by random access as well
BROADCAST_PARTS = 1_000_000


def encode_ids(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The payload for ``ids`` of documents that end at ``ends``."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // 64) * 8, np.uint8)
        words[:len(bits)] = bits
        words = words.view(np.uint64)
        ones = offsets_of(np.bitwise_count(words))
        levels.append(((rest & 0xFF).astype(np.uint8), words, ones[:-1:STRIDE // 64].astype(np.uint64)))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = struct.pack("<4sII", b"DAC1", len(levels), len(ends)) + np.array([len(c) for c, _, _ in levels], "<u8").tobytes()
    return b"".join([head, ends.astype("<u8").tobytes(), *[x.tobytes() for level in levels for x in level]])


class TokenFile:
    """Reads single ids, runs of ids and documents from a payload."""

    def __init__(self, payload: bytes):
        magic, n_levels, n_docs = struct.unpack_from("<4sII", payload)
        if magic != b"DAC1":
            raise ValueError("not a token file")
        at = 12
        sizes = np.frombuffer(payload, "<u8", n_levels, at).astype(np.int64)
        at += 8 * n_levels
        self.ends = np.frombuffer(payload, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for n in sizes.tolist():
            words = -(-n // 64)
            counts = -(-words // (STRIDE // 64))
            self.levels.append((np.frombuffer(payload, np.uint8, n, at), np.frombuffer(payload, "<u8", words, at + n),
                                np.frombuffer(payload, "<u8", counts, at + n + 8 * words)))
            at += n + 8 * (words + counts)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``, in any order, each by its own way through the levels."""
        places = np.asarray(places, np.int64)
        out, open_ = np.zeros(len(places), np.uint32), np.arange(len(places))
        for level, (chunks, words, counts) in enumerate(self.levels):
            out[open_] |= chunks[places].astype(np.uint32) << np.uint32(8 * level)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            on = (words[word] >> bit) & np.uint64(1) == 1
            open_, places, word, bit = open_[on], places[on], word[on], bit[on]
            if not len(open_):
                break
            rank = counts[word // (STRIDE // 64)].astype(np.int64)
            first = word // (STRIDE // 64) * (STRIDE // 64)
            for k in range(STRIDE // 64):   # whole words between the directory's count and the bit
                inside = first + k < word
                rank += np.where(inside, np.bitwise_count(words[np.minimum(first + k, len(words) - 1)]), 0)
            places = rank + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return out

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: one rank a level, then straight reading."""
        low, size = start, stop - start
        out, open_ = np.zeros(max(size, 0), np.uint32), np.arange(max(size, 0))
        for level, (chunks, words, counts) in enumerate(self.levels):
            if not len(open_):
                break
            out[open_] |= chunks[low:low + len(open_)].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(words[low >> 6:(low + len(open_) + 63 >> 6)].view(np.uint8), bitorder="little")
            on = bits[low & 63:(low & 63) + len(open_)].astype(bool)
            word = low >> 6
            first = word // (STRIDE // 64) * (STRIDE // 64)
            rank = int(counts[word // (STRIDE // 64)]) if word < len(words) else 0
            rank += int(np.bitwise_count(words[first:word]).sum()) + int(bits[:low & 63].sum())
            low, open_ = rank, open_[on]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    # a task has one core; the library's own threads would only wait for it
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    specials = tuple(t.content for t in made.get_added_tokens_decoder().values())
    return made, specials


@lru_cache(maxsize=1)
def _factors(size: int) -> np.ndarray:
    """Odd 64-bit numbers, one for each place in a word."""
    return np.random.default_rng(9).integers(0, 1 << 64, size, np.uint64) | np.uint64(1)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the bytes of words that start at ``starts``, one word after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ends[i]:ends[i + 1] of ``data``: the sum of its bytes, each times its place's factor."""
    sizes = np.diff(ends)
    longest = int(sizes.max(initial=1))
    inside = np.arange(int(ends[0]), int(ends[-1])) - np.repeat(ends[:-1], sizes)
    sums = np.zeros(len(inside) + 1, np.uint64)
    np.cumsum((data[int(ends[0]):int(ends[-1])].astype(np.uint64) + np.uint64(1)) * _factors(1 << longest.bit_length())[inside], out=sums[1:])
    return sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]


class WordCache:
    """Ids of words by a 64-bit hash and their bytes, in arrays: some thirty bytes a word.

    Words are given as bytes one after another and the ends of each, and handled all at once.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.id_ends, self.data, self.ends = np.zeros(0, "<u2"), np.zeros(1, np.int32), bytearray(), np.zeros(1, np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, words: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1; words with one hash are told apart by their bytes."""
        slot = np.full(len(hashes), -1)
        if not len(self.hashes):
            return slot
        order = np.argsort(hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
        met = self.hashes[at] == hashes[order]
        slot[order[met]] = self.slots[at[met]]
        known = np.flatnonzero(slot >= 0)
        sizes, own = np.diff(ends)[known], slot[known]
        same = sizes == self.ends[own + 1] - self.ends[own]
        slot[known[~same]] = -1
        known, sizes, own = known[same], sizes[same], own[same]
        data = np.frombuffer(self.data, np.uint8)
        wrong = np.flatnonzero(data[_places(self.ends[own], sizes)] != words[_places(ends[known], sizes)])
        if len(wrong):
            slot[known[np.searchsorted(np.cumsum(sizes), wrong, "right")]] = -1
        return slot

    def add(self, words: list[bytes], hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Puts words in, with their ids one after another and the number of each; gives their slots."""
        slots = np.arange(len(words), dtype=np.int32) + len(self.ends) - 1
        self.data += b"".join(words)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, words), np.int32, len(words)), dtype=np.int32)])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(hashes, kind="stable")
        place = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slots = np.insert(self.hashes, place, hashes[order]), np.insert(self.slots, place, slots[order])
        return slots


@lru_cache(maxsize=2)
def _cache(tokenizer_path: str) -> WordCache:
    """The cache of a Python worker, for all of its tasks: a task's function brings copies of the module's values, not of its functions."""
    return WordCache()


def _encode_each(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words by the library, one after another, and the number of each."""
    ids = [done.ids for done in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    return np.fromiter(chain.from_iterable(ids), "<u2"), np.array([len(x) for x in ids])


def _encode_lines(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``_encode_each`` for words that are not white space, as the lines of one text.

    The library cuts at a line end, so that what it does once for a text is not done for every word.
    Where it does not give as many lines back (one may be part of a special token), words go one by one.
    """
    ids, end = (np.array(done.ids, "<u2") for done in tokenizer.encode_batch_fast(["\n".join(words), "\n"], add_special_tokens=False))
    at = np.flatnonzero(ids == end[0])
    if len(end) != 1 or len(at) != len(words) - 1:
        return _encode_each(tokenizer, words)
    return np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1


def _encode_pack(tokenizer_path: str, words: pa.Array, cache: WordCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by the library, and of each word of a pack the first place and the number of its ids in them."""
    tokenizer, _ = _tokenizer(tokenizer_path)
    coded = words.dictionary_encode()
    found = coded.dictionary
    if len(cache) + len(found) > CACHE_WORDS:
        cache.clear()
    ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8) if len(found) else np.zeros(0, np.uint8)
    hashes = word_hashes(data, ends)
    slots = cache.find(data, ends, hashes)
    new = np.flatnonzero(slots < 0)
    if len(new):
        values = bytes_of(found.take(pa.array(new)))
        # a word that is white space ends with it: a character up to the space or, beyond ASCII, a byte from 128
        last = data[np.maximum(ends[new + 1] - 1, 0)] if len(data) else np.zeros(len(new), np.uint8)
        blank = np.zeros(len(new), bool)
        maybe = np.flatnonzero((last <= 32) | (last >= 128))
        blank[maybe] = [values[k].decode().isspace() for k in maybe.tolist()]
        parts = []
        for group, encoded in ((np.flatnonzero(~blank), _encode_lines), (np.flatnonzero(blank), _encode_each)):
            for a in range(0, len(group), LINES):   # the library's results are large; few are held at once
                some = group[a:a + LINES]
                parts.append((some, *encoded(tokenizer, [values[k].decode() for k in some.tolist()])))
        some, flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        slots[new[some]] = cache.add([values[k] for k in some.tolist()], hashes[new[some]], flat, sizes)
    slots = slots[coded.indices.to_numpy()]
    return cache.ids, cache.id_ends[slots], cache.id_ends[slots + 1] - cache.id_ends[slots]


def _binaries(data: bytes, ends: np.ndarray) -> pa.Array:
    """Slices of ``data`` that end at ``ends``, as a binary column."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _key(doc_id: int | None, tie: int) -> tuple[bool, int, int]:
    """The order of documents: a null id first, equal ids by the hash of their text."""
    return doc_id is not None, doc_id or 0, tie


def part_bounds(docs: DataFrame, text: str, doc_id: str, part_bytes: int) -> list[tuple[bool, int, int]]:
    """The least keys of parts of about ``part_bytes`` text bytes, ascending; from ids, hashes and lengths alone."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.octet_length(text).alias("n"))
    parts = min(MAX_PARTS, int((slim.agg(F.sum("n")).first()[0] or 0) // part_bytes) + 1)
    if parts == 1:
        return []
    dealt = slim.select("doc_id", "tie").repartitionByRange(parts, "doc_id", "tie").withColumn("part", F.spark_partition_id())
    return sorted(_key(*r["least"]) for r in dealt.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("least")).collect())


def tokenized(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0,
              bounds: tuple = ()) -> DataFrame:
    """(doc_id, tie, part, n_tokens, ids): the library's ids and the end id, as u16 or u32 little-endian binary.

    The library cuts a text into words and encodes each by itself, so that
    distinct words of a pack are encoded once. A text that holds a special token
    of the vocabulary goes to the library whole.
    """
    def run(batch: pa.RecordBatch):
        tokenizer, specials = _tokenizer(tokenizer_path)
        cache = _cache(tokenizer_path)
        texts = batch.column("_text")
        special = np.zeros(len(texts), bool)
        for s in specials:
            special |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        for a, b, words, rows in packs(texts, PATTERN, PACK):
            flat, first, sizes = _encode_pack(tokenizer_path, words, cache)
            # the end id of each document is a word of its own behind its words
            end = len(flat)
            flat = np.append(flat.astype(np.int64 if end_id > 65_535 else flat.dtype), [end_id])
            sizes, first = np.insert(sizes, rows[1:], 1), np.insert(first, rows[1:], end)
            at = offsets_of(sizes)
            out = np.repeat((first - at[:-1]).astype(np.int32), sizes)
            out += np.arange(len(out), dtype=np.int32)
            ids = flat[out]
            ends = at[rows[1:] + np.arange(1, len(rows))]
            for k in np.flatnonzero(special[a:b]):   # seldom
                own = tokenizer.encode(texts[a + int(k)].as_py(), add_special_tokens=False).ids
                low, high = int(ends[k - 1]) if k else 0, int(ends[k])
                ids = np.concatenate([ids[:low], own, [end_id], ids[high:]])
                ends[k:] += len(own) + 1 - (high - low)
            kind = "<u2" if int(ids.max(initial=0)) < 65_536 else "<u4"
            keys = [batch.column(c).slice(a, b - a) for c in ("doc_id", "tie")]
            part = [max(0, bisect_right(bounds, _key(*k)) - 1) for k in zip(*[c.to_pylist() for c in keys])]
            yield pa.RecordBatch.from_arrays([
                *keys, pa.array(part, pa.int32()), pa.array(np.diff(ends, prepend=0)),
                _binaries(ids.astype(kind).tobytes(), ends * int(kind[-1]))], ["doc_id", "tie", "part", "n_tokens", "ids"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("_text"))
    return map_batches(source, run, T.StructType.fromDDL("doc_id bigint, tie bigint, part int, n_tokens bigint, ids binary"))


def write_files(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0,
                file_tokens: int = FILE_TOKENS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Files (part, inside, doc_ids, n_tokens, payload) in ascending doc_id order, as a stored table.

    ``inside`` is the number of ids before the file in its part. Payloads are written without
    compression, so that an id lies at a known place.
    """
    # bounds first: a range partitioning of the ids themselves would tokenize twice, for bounds and for rows
    bounds = part_bounds(docs, text, doc_id, part_bytes)
    sorted_ids = (tokenized(docs, tokenizer_path, text, doc_id, end_id, bounds)
                  .repartitionById(len(bounds) or 1, "part").sortWithinPartitions("part", "doc_id", "tie"))

    def run(batches):
        waiting, held, inside, part = [], 0, 0, None

        def flush():
            nonlocal waiting, held, inside
            ends = np.cumsum([len(x) for _, x in waiting])
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([inside], pa.int64()), pa.array([[i for i, _ in waiting]], pa.list_(pa.int64())),
                pa.array([int(ends[-1])], pa.int64()),
                pa.array([encode_ids(np.concatenate([x for _, x in waiting]), ends)], pa.binary())],
                ["part", "inside", "doc_ids", "n_tokens", "payload"])
            waiting, held, inside = [], 0, inside + int(ends[-1])
            return row

        for batch in batches:
            for i, n, data, p in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "part")], strict=True):
                if p != part:
                    if waiting:
                        yield flush()
                    part, inside = p, 0
                waiting.append((i, np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")))
                held += n
                if held >= file_tokens:
                    yield flush()
        if waiting:
            yield flush()

    return stored(sorted_ids.mapInArrow(run, T.StructType.fromDDL(
        "part int, inside bigint, doc_ids array<bigint>, n_tokens bigint, payload binary")), "token_files", compression="uncompressed")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): each document read from its file.

    Of the payloads nothing is shuffled: a file knows its place in its part, and where a part
    starts comes from one number a part. In every file some ids are read by random access too,
    and must agree.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # a row for each partition, not each file
    bases = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if fits(parts, BROADCAST_PARTS):
        bases = F.broadcast(bases)
    placed = files.join(bases, F.col("part") == F.col("_part")).select(
        "doc_ids", "payload", (F.col("base") + F.col("inside")).cast("bigint").alias("first"))

    def run(batch: pa.RecordBatch):
        for k in range(batch.num_rows):
            file, first, ids = TokenFile(batch.column("payload")[k].as_py()), batch.column("first")[k].as_py(), batch.column("doc_ids")[k]
            starts = np.concatenate([[0], file.ends[:-1]])
            whole = file.span(0, len(file)).astype("<u4")
            some = np.linspace(0, len(whole) - 1, min(len(whole), PROBES)).astype(np.int64)
            if not (file.at(some) == whole[some]).all():
                raise ValueError("random access and straight reading disagree")
            data = memoryview(whole.tobytes())
            yield pa.RecordBatch.from_arrays([
                ids.values, pa.array(starts + first), pa.array(file.ends - starts),
                pa.array([zlib.crc32(data[4 * x:4 * y]) for x, y in zip(starts.tolist(), file.ends.tolist())], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(placed, run, T.StructType.fromDDL("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(write_files(docs, public_tokenizers.path("byte_bpe_50k.json")))
