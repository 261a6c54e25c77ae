"""Cuts texts into the words that a byte-level BPE encodes one by one.

The usual split pattern is done with character classes over whole arrays: a word
is a run of letters, of numbers or of other characters, with one space before it
if there is one; white space before it is a word of its own; an apostrophe with
s, t, re, ve, m, ll or d after it is one too. Other patterns go through a regular
expression, text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PACK_BYTES = 8 << 20     # text bytes of a pack, unless one text alone has more
# fixed values: the code points with the property White_Space
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE, WS, LETTER, NUMBER, OTHER = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    points = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        found = "".join(regex.findall(rf"\p{{{name}}}+", points))
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    kinds[list(WHITE_SPACE)] = WS
    kinds[32] = SPACE
    return kinds


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def bytes_of(words: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls; slices of its data, several times as fast as ``to_pylist``."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes() if words.buffers()[2] is not None else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def split_runs(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of the texts in ``data`` (text i is ends[i]:ends[i + 1]), and each text's first word."""
    chars = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(chars)
    if n == len(data):
        at, texts = None, ends
    else:
        # a character starts at each byte that continues none
        at = np.append(np.flatnonzero(np.frombuffer(data, np.int8) >= -64), len(data))
        texts = np.searchsorted(at, ends)
    kind = character_classes()[chars]
    run = np.maximum(kind, WS)
    first = np.zeros(n + 1, bool)
    first[texts] = True
    cut = first.copy()
    cut[1:n] |= run[1:] != run[:-1]
    # a run that follows white space in its text: the last white space is cut off, and a space joins the run
    after = np.flatnonzero(cut[1:n] & (run[1:] != WS) & (run[:-1] == WS) & ~first[1:n]) + 1
    cut[after - 1] = True
    cut[after[kind[after - 1] == SPACE]] = False
    # an apostrophe alone, not after a space, before one of the endings
    marks = np.flatnonzero((chars == 39) & cut[:n])
    marks = marks[marks + 1 < n]
    marks = marks[cut[marks + 1] & ~first[marks + 1] & (run[marks + 1] == LETTER)]
    one = chars[marks + 1]
    second = np.minimum(marks + 2, n - 1)
    two = np.where((marks + 2 < n) & ~first[second], chars[second], 0)
    is_, code = np.isin, ord
    short = is_(one, [code(c) for c in "stmd"])
    long_ = ((is_(one, [code("r"), code("v")]) & (two == code("e"))) | ((one == code("l")) & (two == code("l"))))
    cut[marks[short | long_] + 1] = False
    cut[marks[short] + 2] = True
    cut[marks[long_] + 3] = True
    starts = np.flatnonzero(cut[:n])
    offsets = np.append(starts if at is None else at[starts], len(data))
    return offsets, np.searchsorted(starts, texts)


def cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to at most ``limit``, of one entry at least."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def packs(texts: pa.Array, pattern: str = PATTERN, pack_bytes: int = PACK_BYTES
          ) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(first row, end row, words as binary, word offsets of the rows) of each pack of a string column."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    for a, b in cuts(np.diff(starts), pack_bytes):
        ends = starts[a:b + 1] - starts[a]
        part = data[int(starts[a]):int(starts[b])].to_pybytes() if data is not None and ends[-1] else b""
        if pattern == PATTERN:
            offsets, rows = split_runs(part, ends)
        else:
            import regex

            found = [[w.encode() for w in regex.findall(pattern, part[x:y].decode())] for x, y in zip(ends, ends[1:])]
            part = b"".join([w for row in found for w in row])
            offsets = offsets_of(np.array([len(w) for row in found for w in row], np.int64))
            rows = offsets_of(np.array([len(row) for row in found], np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                      [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(part)])
        yield a, b, words, rows
