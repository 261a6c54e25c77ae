"""Records of text files by number, read by many tasks from one file: lines, JSON arrays, quoted CSV.

Spark cuts a file into byte ranges at a one-character separator that stands often enough ("}" in
JSON, the line feed in CSV), in any store it can read. Whether a range starts inside a record
cannot be seen in the range. A first pass says, for each state a range may start in, the state
it ends in and how many records it opens; a fold over these summaries, one entry a range, gives every
range its start and its first record's number. The second pass cuts the records; only pieces of
records that cross ranges are shuffled. Numbers do not depend on how the file was cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OUT_BYTES = 4 << 20      # text of records that leaves a task at once


class JsonArray:
    """Objects that stand directly in a top-level array. A state is (inside a string, depth)."""

    separator = "}"
    _MARKS = re.compile(r'\\.|["{}\[\]]', re.S)

    @classmethod
    def scan(cls, text: str, state: tuple[bool, int]) -> tuple[list[tuple[int, int, int]], tuple[bool, int]]:
        """Changes of depth as (place, before, after), and the state after the text."""
        inside, depth = state
        changes = []
        for mark in cls._MARKS.finditer(text):
            c = mark.group()
            if c == '"':
                inside = not inside
            elif not inside and c in "{[":
                changes.append((mark.start(), depth, depth + 1))
                depth += 1
            elif not inside and c in "}]":
                changes.append((mark.end(), depth, depth - 1))
                depth -= 1
        return changes, (inside, depth)

    @staticmethod
    def opened(changes) -> Counter:
        """Records that would open, by the depth that stands for that of the array."""
        return Counter(low for _, low, high in changes if high > low)

    @staticmethod
    def level(depth: int) -> int:
        """Of a range that starts at ``depth``: the relative depth of the array."""
        return 1 - depth

    @staticmethod
    def pieces(text: str, changes, state, after) -> list[tuple[str, bool, bool]]:
        """Parts of records as (text, opens, closes)."""
        out, start, opens = [], 0 if state[1] >= 2 else None, False
        for at, low, high in changes:
            if (low, high) == (1, 2):
                start, opens = at, True
            elif (low, high) == (2, 1) and start is not None:
                out.append((text[start:at], opens, True))
                start, opens = None, False
        if start is not None and after[1] >= 2:
            out.append((text[start:], opens, False))
        return out


class QuotedLines:
    """Lines, of which one goes on while a quote is open. A state is (inside quotes, 0)."""

    separator = "\n"

    @staticmethod
    def scan(text: str, state):
        after = state[0] ^ bool(text.count('"') & 1), 0
        return not state[0], after

    @staticmethod
    def opened(opens: bool) -> Counter:
        return Counter({0: int(opens)})

    @staticmethod
    def level(depth: int) -> int:
        return 0

    @staticmethod
    def pieces(text: str, opens: bool, state, after):
        return [(text if after[0] else text.removesuffix("\n").removesuffix("\r"), opens, not after[0])]


def _fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("final"),
        "value")


def _texts(batches, separator: str) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, start of the byte range), text with its separator); the file's last text has none."""
    held = None
    for batch in batches:
        for file, start, final, value in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "final", "value")], strict=True):
            if held:
                same = held[0] == (file, start)
                yield held[0], held[1] if held[2] and not same else held[1] + separator
            held = (file, start), value, final
    if held:
        yield held[0], held[1] if held[2] else held[1] + separator


def _starts(fragments: DataFrame, kind) -> dict[tuple[str, int], tuple[tuple[bool, int], int]]:
    """Of each byte range the state it starts in and the records opened before it."""
    def summarise(batches):
        key, states, counts = None, [], []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * 2), pa.array([key[1]] * 2, pa.int64()), pa.array([False, True]),
                 pa.array([s[0] for s in states]), pa.array([s[1] for s in states], pa.int64()),
                 pa.array([[list(x) for x in c.items()] for c in counts], pa.list_(pa.list_(pa.int64())))],
                ["file", "start", "inside", "ends_inside", "depth", "opened"])

        for at, text in _texts(batches, kind.separator):
            if at != key:
                if key:
                    yield row()
                key, states, counts = at, [(False, 0), (True, 0)], [Counter(), Counter()]
            for k in (0, 1):
                found, states[k] = kind.scan(text, states[k])
                counts[k] += kind.opened(found)
        if key:
            yield row()

    schema = "file string, start bigint, inside boolean, ends_inside boolean, depth bigint, opened array<array<bigint>>"
    ranges: dict[str, dict[int, dict[bool, tuple]]] = {}
    for r in fragments.mapInArrow(summarise, schema).collect():   # two rows a byte range
        ranges.setdefault(r["file"], {}).setdefault(r["start"], {})[r["inside"]] = (r["ends_inside"], r["depth"], dict(map(tuple, r["opened"])))
    out = {}
    for file, parts in ranges.items():
        inside, depth, number = False, 0, 0
        for start in sorted(parts):
            out[file, start] = (inside, depth), number
            ends_inside, change, opened = parts[start][inside]
            number += opened.get(kind.level(depth), 0)
            inside, depth = ends_inside, depth + change
    return out


def read_records(spark: SparkSession, path: str, kind=JsonArray) -> DataFrame:
    """(file, number, record): the records of the files at ``path``, numbered from 0 in each file.

    What stands outside of records is left out. A record that the file ends in is kept as it stands. A
    missing path raises ``AnalysisException``.
    """
    fragments = _fragments(spark, path, kind.separator)
    shared = spark.sparkContext.broadcast(_starts(fragments, kind))
    names = ["file", "number", "start", "record", "whole"]

    def cut(batches):
        rows, size, key, state, number, current = [], 0, None, None, 0, None

        def take():
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names)
            rows, size = [], 0
            return out

        def put(closes):
            nonlocal current, size
            opens, parts = current
            rows.append((*key[:1], number - 1, key[1], "".join(parts), opens and closes))
            size += len(rows[-1][3])
            current = None

        for at, text in _texts(batches, kind.separator):
            if at != key:
                if current:
                    put(False)
                key = at
                state, number = shared.value[at]
            found, after = kind.scan(text, state)
            for piece, opens, closes in kind.pieces(text, found, state, after):
                if opens:
                    number += 1
                if opens or current is None:
                    current = opens, []
                current[1].append(piece)
                if closes:
                    put(True)
            state = after
            if size >= OUT_BYTES:
                yield take()
        if current:
            put(False)
        if rows:
            yield take()

    pieces = fragments.mapInArrow(cut, "file string, number bigint, start bigint, record string, whole boolean")
    # a record in several pieces, one a byte range
    joined = (pieces.filter("NOT whole").groupBy("file", "number")
              .agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
              .select("file", "number", F.array_join(F.transform("p", lambda x: x["record"]), "").alias("record")))
    return pieces.filter("whole").select("file", "number", "record").unionByName(joined)


def numbered_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(file, number, value): the texts between separators, numbered from 0 in each file.

    Two scans: one counts the texts of each byte range, the other numbers them from there. Both cut the
    files alike, as they stand in one session under one setting.
    """
    lines = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), "value")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).select(
        "file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row a byte range
    return lines.join(F.broadcast(ranges), ["file", "start"]).select(
        "file", (F.col("base") + F.col("row") - F.col("first")).alias("number"), "value")
