"""Phrase collocations by vertically partitioned suffix subtrees.

The corpus is a string of words, cut into pieces by punctuation; every word starts a suffix,
truncated after MAX_WORDS words or at the end of its piece. The suffix tree of all is never
built as one. Vertical partitioning, one scan of the texts a prefix length:

1. words are counted; one that starts more than a quarter of ``budget`` suffixes is heavy;
2. pairs that start with a heavy word are estimated from SAMPLE_WORDS words, and may be heavy again;
3. every suffix goes to the group of its shortest prefix that is not heavy. Prefixes share
   groups, so that a group has about half the memory budget of suffixes.

A task sends a group's suffixes of a run of texts as one packed block of distinct suffixes
with counts. Each group's subtrees are built by a task of their own: the sorted distinct
suffixes are the leaves, a node is a range of leaves, and its count is a difference of running
leaf totals. The counts of a heavy pair's groups are added up. So the estimate of step 2 only says which
task counts what: every count is over all texts, and the same for any estimate.

Words stand as 64-bit hashes in blocks and nodes; the hash's seed is verified against all
words of the corpus (no two share a hash), else the next seed is taken. The budget grows once
the corpus would have over MAX_HEAVY heavy prefixes, so that their broadcast stays bounded.

Counts of the parts are joined to the candidates; parts that stand in over a HOT-th of all
words are broadcast, the others joined by key. The first ``top`` of each language are cut
in steps, over salted languages and then over what is left.

Defined results: a null text has no words; a null language is ``und``; texts of one language
count together, rows as often as they are repeated; phrases do not cross pieces. Very long texts
are read in slices that end at a piece, or at a word whose followers are read with it. No ties
remain: score, count and phrase order all rows. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import join_unique, stored, table
from notemill.llm.pretokenize import offsets_of

MIN_COUNT, COVER_PERCENT, TOP = 10, 50, 2_000
MAX_WORDS = 3
BUDGET = 1 << 21         # suffixes of a group, about
MAX_HEAVY = 1_000_000    # heavy prefixes of a length at most
SAMPLE_WORDS = 1 << 24   # words of the texts that heavy pairs are estimated from, about
PACK = 4 << 20           # text bytes that are counted before rows leave a task
HOT, SALTS = 1_000, (64, 4)
NO_LANG = "und"

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER + BREAKS + BLANKS, _UPPER.lower() + b"\n" * len(BREAKS) + b" " * len(BLANKS))
_NEXT = re.compile(rb"(?: *[^ \n]+){0,%d}" % (MAX_WORDS - 1))
_STOP = re.compile(rb"[ \n]")


def slices(data: bytes, limit: int = PACK) -> Iterator[tuple[bytes, int]]:
    """(bytes, own bytes): translated text in parts; what follows the own bytes only ends their phrases."""
    a = 0
    while len(data) - a > limit:
        cut = data.rfind(b"\n", a + 1, a + limit)
        if cut < 0:
            cut = data.rfind(b" ", a + 1, a + limit)
        if cut < 0:
            stop = _STOP.search(data, a + limit)
            cut = stop.start() if stop else len(data)
        yield data[a:_NEXT.match(data, cut).end()], cut - a
        a = cut
    yield data[a:], len(data) - a


class Pack:
    """Words of some text of one language: distinct words, and codes of each word and its followers."""

    def __init__(self, parts: list[tuple[bytes, int]]):
        data = b"\n".join(p for p, _ in parts) + b"\n"
        chars = np.frombuffer(data, np.uint8)
        inside = (chars != 32) & (chars != 10)
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0))).astype(np.int32)
        starts, ends = edge[::2], edge[1::2]
        packed = chars[inside].tobytes()
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        piece = np.searchsorted(np.flatnonzero(chars == 10), starts).astype(np.int32)
        own = np.ones(len(starts), bool)
        at = 0
        for part, size in parts:
            if size < len(part):
                own[np.searchsorted(starts, at + size):np.searchsorted(starts, at + len(part))] = False
            at += len(part) + 1
        del data, chars, inside, packed, edge
        coded = words.dictionary_encode()
        self.text = coded.dictionary
        self.words: list[bytes] = coded.dictionary.to_pylist()
        # 0 stands for no word
        self.base = len(self.words) + 1
        first = coded.indices.to_numpy(zero_copy_only=False) + np.int32(1)
        follow = [first]
        for k in range(1, MAX_WORDS):
            code = np.zeros(len(first), np.int32)
            code[:-k or None][piece[k:] == piece[:-k]] = first[k:][piece[k:] == piece[:-k]]
            follow.append(code)
        self.codes = [c if own.all() else c[own] for c in follow]

    def hashes(self, seed: int) -> np.ndarray:
        """Of each distinct word, in order."""
        return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64).view(np.int64)

    def counted(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(keys, return_counts=True)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct truncated suffixes, sorted, as three codes, and their counts."""
        pair = self.codes[0].astype(np.int64)
        pair *= self.base
        pair += self.codes[1]
        if self.base ** 3 < 1 << 63:
            pair *= self.base
            pair += self.codes[2]
            key, n = self.counted(pair)
            pair, last = np.divmod(key, self.base)
        else:
            pairs, place = np.unique(pair, return_inverse=True)
            key, n = self.counted(place * self.base + self.codes[2])
            place, last = np.divmod(key, self.base)
            pair = pairs[place]
        return *(x.astype(np.int32) for x in (*np.divmod(pair, self.base), last)), n


def scan(docs: DataFrame, each, schema: str) -> DataFrame:
    """``each(lang, pack)`` (an iterator of record batches) over all text of columns lang and text."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                yield from each(lang, Pack(parts))
            held.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                for part in slices((text.as_py() or b"").translate(_TABLE)):
                    if size and size + len(part[0]) > PACK:
                        yield from flush()
                        size = 0
                    held.setdefault(lang, []).append(part)
                    size += len(part[0]) + 1
        yield from flush()

    return docs.mapInArrow(run, schema)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, f) of all words."""
    def each(lang, pack):
        n = np.bincount(pack.codes[0], minlength=pack.base)[1:]
        text = pc.cast(pack.text, options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), text, pa.array(pack.hashes(seed)),
                                          pa.array(n)], ["lang", "word", "h", "f"]).filter(pa.array(n > 0))

    rows = scan(docs, each, "lang string, word string, h bigint, f bigint")
    return rows.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def vocabulary(docs: DataFrame, hash_bits: int = 64) -> tuple[DataFrame, int]:
    """All words with counts, stored, and a seed under which no two of them share a hash."""
    seed = 0
    words = stored(word_counts(docs, seed), "words")
    while not (words.select("h", "word").distinct().groupBy("h").count().filter("count > 1").isEmpty()):
        seed += 1
        words = stored(word_counts(docs, seed), "words")
    return words, seed


def _sorted_by_lang(rows: DataFrame, *columns: str) -> dict[str, tuple[np.ndarray, ...]]:
    """Heavy prefixes, a bounded number, as arrays by language, sorted."""
    out: dict[str, list] = {}
    for r in rows.select("lang", *columns).collect():
        out.setdefault(r["lang"], []).append(tuple(r)[1:])
    return {lang: tuple(np.array(sorted(v), np.int64).T) for lang, v in out.items()}


def _places(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each of ``of`` its place in the distinct ``values``, or -1."""
    order = np.argsort(values)
    if not len(values):
        return np.full(len(of), -1)
    at = np.minimum(np.searchsorted(values, of, sorter=order), len(values) - 1)
    return np.where(values[order[at]] == of, order[at], -1)


def _mixed(seed, values: np.ndarray) -> np.ndarray:
    out = (values.view(np.uint64) ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def heavy_pairs(docs: DataFrame, seed: int, heavy: dict, least: float, fraction: float) -> DataFrame:
    """(lang, h1, h2) of the pairs that start with a heavy word and have more than about ``least`` places."""
    def each(lang, pack):
        if lang not in heavy:
            return
        h = pack.hashes(seed)
        on = np.concatenate([[False], np.isin(h, heavy[lang][0])])
        rows = on[pack.codes[0]] & (pack.codes[1] > 0)
        key, n = pack.counted(pack.codes[0][rows].astype(np.int64) * pack.base + pack.codes[1][rows])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(h[key // pack.base - 1]),
                                          pa.array(h[key % pack.base - 1]), pa.array(n)], ["lang", "h1", "h2", "f"])

    some = docs.sample(fraction, 7) if fraction < 1 else docs
    rows = scan(some, each, "lang string, h1 bigint, h2 bigint, f bigint")
    return rows.groupBy("lang", "h1", "h2").agg(F.sum("f").alias("f")).filter(F.col("f") > least * fraction).drop("f")


def blocks(docs: DataFrame, seed: int, words: dict, pairs: dict, groups: int) -> DataFrame:
    """(bin, lang, block): of each run of texts the distinct suffixes of a group with counts."""
    def each(lang, pack):
        a, b, c, n = pack.suffixes()
        if not len(a):
            return
        h = np.concatenate([[0], pack.hashes(seed)])
        level = np.ones(len(a), np.int8)
        if lang in words:
            level[np.isin(h[a], words[lang][0])] = 2
            if lang in pairs:
                first, second = (_places(h[1:], x) + 1 for x in pairs[lang])
                here = (first > 0) & (second > 0)
                level[np.isin(a.astype(np.int64) * pack.base + b, first[here] * pack.base + second[here])] = 3
        place = _mixed(np.uint64(xxhash.xxh3_64_intdigest(lang.encode())), h[a])
        for least, code in ((2, b), (3, c)):
            deep = np.flatnonzero(level >= least)
            place[deep] = _mixed(place[deep], h[code[deep]])
        bins = (place % np.uint64(groups)).astype(np.int64) * 3 + (level - 1)
        del place, level
        order = np.argsort(bins, kind="stable")
        cuts = np.flatnonzero(np.diff(bins[order], prepend=-1, append=-1))
        bodies = []
        for x, y in zip(cuts, cuts[1:]):
            rows = order[x:y]
            used, local = np.unique(np.concatenate([a[rows], b[rows], c[rows], [0]]), return_inverse=True)
            data = (struct.pack("<II", len(used), len(rows)) + h[used].astype("<i8").tobytes()
                    + local[:-1].astype("<u4").tobytes() + n[rows].astype("<u4").tobytes())
            bodies.append(struct.pack("<I", len(data)) + pa.compress(data, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(bins[order[cuts[:-1]]]), pa.array([lang] * len(bodies), pa.string()),
                                          pa.array(bodies, pa.binary())], ["bin", "lang", "block"])

    return scan(docs, each, "bin bigint, lang string, block binary")


def subtree_nodes(bodies: list[bytes], level: int, least: int) -> tuple[np.ndarray, ...]:
    """The nodes of two and three words of a group's subtrees: three hashes, words, count, and whether it is a part.

    Whole nodes have ``least`` places or more. Where prefixes have three words (``level``), a pair's
    other suffixes are in other groups, and its node here is a part.
    """
    pools, rows, counts = [], [], []
    for body in bodies:
        data = pa.decompress(body[4:], struct.unpack_from("<I", body)[0], "zstd", asbytes=True)
        used, m = struct.unpack_from("<II", data)
        pools.append(np.frombuffer(data, "<i8", used, 8))
        rows.append(np.frombuffer(data, "<u4", 3 * m, 8 + 8 * used).reshape(3, m))
        counts.append(np.frombuffer(data, "<u4", m, 8 + 8 * used + 12 * m))
    # entry 0 of a pool is no word; a word may have any hash
    words = np.unique(np.concatenate([p[1:] for p in pools]))
    base = len(words) + 1
    codes = np.concatenate([np.concatenate([[0], np.searchsorted(words, p[1:]) + 1])[r] for p, r in zip(pools, rows)], 1)
    pair, place = np.unique(codes[0] * base + codes[1], return_inverse=True)
    leaf, into = np.unique(place * base + codes[2], return_inverse=True)
    total = np.zeros(len(leaf) + 1, np.int64)       # running totals of the leaves, in order
    np.add.at(total, into + 1, np.concatenate(counts).astype(np.int64))
    total = np.cumsum(total)
    place, last = np.divmod(leaf, base)
    first, second = np.divmod(pair[place], base)
    pool = np.concatenate([[0], words])
    out = []
    for depth, key in ((2, place), (3, np.arange(len(leaf)))):
        part = depth < level
        cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        starts = cuts[:-1]
        f = total[cuts[1:]] - total[starts]
        keep = (part | (f >= least)) & ((second if depth == 2 else last)[starts] > 0)
        at = starts[keep]
        out.append((pool[first[at]], pool[second[at]], pool[last[at]] if depth == 3 else np.zeros(len(at), np.int64),
                    np.full(len(at), depth, np.int32), f[keep], np.full(len(at), part)))
    return tuple(np.concatenate(x) for x in zip(*out))


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, word, h, f) of all words, and (lang, h1, h2, h3, words, f) of longer phrases with ``least`` places.

    ``docs`` has the columns lang and text. h3 of a pair is 0.
    """
    vocab, seed = vocabulary(docs)
    total = vocab.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, 4 * total // MAX_HEAVY)
    words = _sorted_by_lang(vocab.filter(F.col("f") > budget // 4), "h")
    pairs = _sorted_by_lang(heavy_pairs(docs, seed, words, budget / 4, min(1.0, SAMPLE_WORDS / total)), "h1", "h2") if words else {}

    def build(key, group):
        level = key[0].as_py() % 3 + 1
        langs = group.column("lang")
        out = []
        for lang in langs.unique().to_pylist():
            nodes = subtree_nodes(group.filter(pc.equal(langs, lang)).column("block").to_pylist(), level, least)
            out.append(pa.table([pa.array([lang] * len(nodes[0]), pa.string()), *nodes], names=names))
        return pa.concat_tables(out)

    names = ["lang", "h1", "h2", "h3", "words", "f", "part"]
    # blocks go to their groups in the job that builds the subtrees; nodes are written
    sent = blocks(docs, seed, words, pairs, max(1, 2 * total // budget))
    built = sent.groupBy("bin").applyInArrow(build, "lang string, h1 bigint, h2 bigint, h3 bigint, words int, f bigint, part boolean")
    nodes = stored(built, "nodes")
    parts = nodes.filter("part").groupBy("lang", "h1", "h2", "h3", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return vocab, nodes.filter("NOT part").drop("part").unionByName(parts)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, top: int = TOP,
                 cover: int = COVER_PERCENT, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    The score is floor(1,000,000 a a / (l r)) at the cut of the phrase where it is lowest. A phrase
    that lies in a longer one with ``cover`` percent of its places is left out.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    vocab, nodes = phrase_counts(docs, least, budget)
    sizes = stored(vocab.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("f") * HOT > total
    words = vocab.filter(F.col("f") >= least)
    two, three = nodes.filter("words = 2"), nodes.filter("words = 3")

    def part(rows, facts, keys, value):
        """Adds the count ``value`` of the part whose words have the hashes ``keys``."""
        names = [f"h{i + 1}" for i in range(len(keys))] if len(keys) > 1 else ["h"]
        facts = facts.select("lang", *[F.col(n).alias(k) for n, k in zip(names, keys)], "f")
        given = rows.withColumnRenamed("f", "a")
        return (join_unique(given, facts, ["lang", *keys], hot, ["h1", "h2", "h3"])
                .withColumnRenamed("f", value).withColumnRenamed("a", "f"))

    def cut(left, right):
        # exact for counts below 10^15
        return F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST(f AS DECIMAL(15,0)) * CAST(f AS DECIMAL(15,0)) "
                      f"div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))")

    inside = (three.select("lang", "h1", "h2", "f").unionByName(three.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f"))
              .groupBy("lang", "h1", "h2").agg(F.max("f").alias("longer")))
    pairs = (two.join(inside, ["lang", "h1", "h2"], "left")
             .filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f"))).drop("longer"))
    pairs = part(part(pairs, words, ["h1"], "l"), words, ["h2"], "r").withColumn("score", cut("l", "r"))
    triples = part(part(three, words, ["h1"], "l1"), two, ["h2", "h3"], "r1")
    triples = part(part(triples, two, ["h1", "h2"], "l2"), words, ["h3"], "r2")
    triples = triples.withColumn("s1", cut("l1", "r1")).withColumn("s2", cut("l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    triples = (triples.withColumn("l", F.when(early, F.col("l1")).otherwise(F.col("l2")))
               .withColumn("r", F.when(early, F.col("r1")).otherwise(F.col("r2")))
               .withColumn("score", F.least("s1", "s2")))
    columns = ["lang", "h1", "h2", "h3", "words", "f", "l", "r", "score"]
    scored = stored(pairs.select(*columns).unionByName(triples.select(*columns)), "scored")

    def firsts(rows, order):
        """The first ``top`` rows of each language, with ``rank``."""
        few = rows
        for salts in SALTS:
            salted = few.withColumn("_salt", F.pmod(F.xxhash64("h1", "h2", "h3"), F.lit(salts)))
            few = (salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
                   .filter(F.col("_n") <= top).drop("_n", "_salt"))
        return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)

    best = [F.desc("score"), F.desc("f")]
    # the last row that can be among the first ones; ties with it wait for their words
    last = (firsts(scored, best).groupBy("lang").agg(F.max("rank").alias("_k"), F.min(F.struct("score", "f")).alias("_last"))
            .filter(F.col("_k") >= top).select("lang", "_last"))
    open_ = (scored.join(last, "lang", "left")
             .filter(F.col("_last").isNull() | (F.struct("score", "f") >= F.col("_last"))).drop("_last"))
    named = open_.select(*columns)
    for k in ("h1", "h2", "h3"):
        facts = words.select("lang", F.col("h").alias(k), F.col("word").alias(f"w_{k}"), F.col("f").alias("_f"))
        named = join_unique(named, facts, ["lang", k], F.col("_f") * HOT > total, ["h1", "h2", "h3"]).drop("_f")
    named = named.withColumn("phrase", F.concat_ws(" ", "w_h1", "w_h2", F.when(F.col("words") == 3, F.col("w_h3"))))
    ranked = firsts(named, [*best, F.asc("phrase")])
    return (ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase",
                                              F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("bigint").alias("score")))


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
tokens AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM worded),
runs AS (SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM tokens WINDOW p AS (PARTITION BY piece ORDER BY i)),
grams AS (SELECT lang, 1 AS k, w1 AS g FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
splits AS (SELECT c.*, s.c AS c, array_to_string(w[:s.c], ' ') AS g1, array_to_string(w[s.c + 1:], ' ') AS g2
  FROM cand c, (VALUES (1), (2)) AS s(c) WHERE s.c < k),
valued AS (SELECT s.lang, s.k, s.g, s.w, s.a, s.c, x.f AS l, y.f AS r,
    (1000000::HUGEINT * s.a * s.a) // (x.f::HUGEINT * y.f) AS score
  FROM splits s JOIN f x ON x.lang = s.lang AND x.g = s.g1 JOIN f y ON y.lang = s.lang AND y.g = s.g2),
low AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_pairs AS (SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS g FROM cand WHERE k = 3) GROUP BY 1, 2),
left_over AS (SELECT low.* FROM low LEFT JOIN inner_pairs i ON i.lang = low.lang AND i.g = low.g AND low.k = 2
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM left_over)
JOIN sizes USING (lang) WHERE rank <= 2000"""
