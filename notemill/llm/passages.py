"""Repeated passages: shared seeds, collinear chains, aligned.

Texts are words (ASCII lower case, ASCII white space). Seeds are minimizers: of every WINDOW k-mers in a
row the one with the least hash, of two lengths. Short seeds (K words) find fuzzy passages; long ones
(LONG_K words) stand only in texts that share a whole run of LONG_K + LONG_WINDOW - 1 words, so that the many texts
which quote a few words of a passage do not come between those that share all of it. Equal texts are
one node. Two texts are compared if they share a long seed, or two seeds that a chain can hold (the second begins up to MAX_GAP
words behind the first); no number of texts that share them is too large. Keys of up to COLD texts (a seed, or two seeds of
which one stands in more texts) link every two of their texts, and the matches of a pair are gathered. Texts
that share a key of more texts meet in blocks: every text goes to the key of it that most texts have, its home; the texts of two
homes that share such a key are compared there, every two that share one, once. A block holds the seeds and words of its texts
and gives a row a text, not one a pair, so that the work grows with the pairs but what is moved and written does not.
The seeds of a pair are chained: ordered on both sides, with a cost for gaps,
the best predecessor found. Chains are aligned word by
word; a passage has ``MIN_WORDS`` words and ``MIN_IDENTITY`` of them alike. ``collinear`` does both for many pairs at once.

Sure and likely: any two texts that share LONG_K + LONG_WINDOW - 1 equal words in a row share a long seed, and are compared. Two
texts that share two seeds near each other, or a long one, are compared whatever else stands in these texts. A fuzzy passage
without two common short seeds is not found; the tests measure how often, README states it.

Whole texts move once, spread by id; all else is slim. Hot seeds are partial
aggregates and joins that AQE can split.

Defined results: null, empty and short texts (under ``MIN_WORDS`` words) are alone;
copies of a longer text are of one class. Rows with a null id are left out;
repeated rows count once. Passages repeated only within one text do not count; equal scores take the first
anchor. Very long texts have seeds all along and are read whole. Other columns are not read. An empty table gives no
rows. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm import collinear
from notemill.llm.common import fits, map_batches, stored, table
from notemill.llm.decontaminate import rolling
from notemill.llm.pretokenize import cuts, offsets_of
from notemill.llm.simhash import components

K, WINDOW = 8, 16
LONG_K, LONG_WINDOW = 24, 24
MIN_WORDS, MIN_IDENTITY = 50, 0.8
COLD = 16                # texts of a seed, or of two seeds together, whose pairs are rows; those of more meet in blocks
BLOCK = 512              # texts on a side of a block, about
BLOCK_WORDS = 1 << 21    # and their words
BROADCAST_IDS = 1 << 20  # ids of texts of blocks that are sent to the documents; with more the documents are shuffled
MATCHES = 1 << 19        # matches of a block handled at once
MAX_GAP = 64             # words between two seeds of a chain, at most
MARGIN = 48              # words read beyond a chain's ends
SLICE = 256              # pairs handled at once in a task
PACK_BYTES = 1 << 20     # text bytes cut into words at once
DROP = 8                 # an end is extended until its score falls this far below its best


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _packs(batch: pa.RecordBatch, column: int):
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    texts = batch.column(column).to_pylist()
    for a, b in cuts(sizes, PACK_BYTES):
        rows = [_words(t) for t in texts[a:b]]
        coded = pa.array([w for r in rows for w in r], pa.large_binary()).dictionary_encode()
        ids = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        flat = ids[coded.indices.to_numpy()] if len(ids) else ids
        yield a, rows, flat, offsets_of(np.array([len(r) for r in rows], np.int64))


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts that are joined by single blanks as numbers, equal for equal words, and the offsets of the texts."""
    words = pc.split_pattern(texts.cast(pa.large_binary()), b" ")
    flat = words.flatten()
    sizes = np.diff(words.offsets.to_numpy().astype(np.int64))
    return flat.dictionary_encode().indices.to_numpy(), offsets_of(sizes)


def _text_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def seeded(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, t, h, pos): the hash of each text with enough words, and its minimizers with the first place of each.

    The place p of a long seed is given as -1 - p.
    """
    def run(batch: pa.RecordBatch):
        for start, rows, flat, ends in _packs(batch, 1):
            long_ = np.flatnonzero(np.diff(ends) >= MIN_WORDS)
            if not len(long_):
                continue
            kinds = []
            for size, window, mix in ((K, WINDOW, 0xBF58476D1CE4E5B9), (LONG_K, LONG_WINDOW, 0x94D049BB133111EB)):
                h = rolling(flat, size)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(mix)
                least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(len(h) - window + 1)
                kinds.append((h, least, size + window))
            pos, hashes = [], []
            for k in long_:
                a, b = int(ends[k]), int(ends[k + 1])
                own = []
                for h, least, span in kinds:
                    at = least[a:b - span + 2]
                    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                    values, first = np.unique(h[at], return_index=True)
                    own.append((values.view(np.int64), (at[first] - a).astype(np.int32)))
                # the places of long seeds stand below zero
                pos.append(np.concatenate([own[0][1], -1 - own[1][1]]))
                hashes.append(np.concatenate([own[0][0], own[1][0]]))
            lists = pa.array(offsets_of(np.array([len(p) for p in pos], np.int64)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(long_ + start)), pa.array([_text_hash(rows[k]) for k in long_], pa.int64()),
                pa.ListArray.from_arrays(lists, pa.array(np.concatenate(hashes))),
                pa.ListArray.from_arrays(lists, pa.array(np.concatenate(pos)))], ["doc_id", "t", "h", "pos"])

    return map_batches(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), text), run,
                       T.StructType.fromDDL("doc_id bigint, t bigint, h array<bigint>, pos array<int>"))


class Fenwick:
    """Prefix maxima of (score, index) over positions."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def up_to(self, i: int) -> tuple[float, int]:
        """The best over positions below ``i``."""
        found = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def short_seeds(pair: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed matches of pairs with each long one as the short ones that it consists of."""
    short, long_ = (left >= 0) & (right >= 0), (left < 0) & (right < 0)
    steps = np.arange(0, LONG_K - K + 1, K)
    spread = lambda x: np.concatenate([x[short], ((-1 - x[long_])[:, None] + steps).ravel()])
    return np.concatenate([pair[short], np.repeat(pair[long_], len(steps))]), spread(left), spread(right)


def chains(left: np.ndarray, right: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of anchors (left, right, length), best first, from seed matches of one pair.

    Seeds on one diagonal that overlap or touch within a window are one anchor. ``collinear.chains`` gives the same for many pairs.
    """
    order = np.lexsort((left, left - right))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(left - right) != 0) | (np.diff(left) > WINDOW)]))
    last = np.append(first[1:], len(left)) - 1
    return anchor_chains(sorted(zip(left[first].tolist(), right[first].tolist(), (left[last] - left[first] + K).tolist())))


def anchor_chains(anchors: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of ordered anchors.

    An anchor's best predecessor ends before it on both sides; the cost of a gap
    is its length (half a word each) and lengths add up along a chain, so that
    scores compare through one Fenwick tree over right ends.
    """
    out = []
    while anchors:
        stops = sorted({r + n for _, r, n in anchors})
        place = {r: i for i, r in enumerate(stops)}
        tree, score, back = Fenwick(len(stops)), [0.0] * len(anchors), [-1] * len(anchors)
        ended, done = sorted(range(len(anchors)), key=lambda i: anchors[i][0] + anchors[i][2]), 0
        for i, (a, b, n) in enumerate(anchors):
            # anchors that end at or before this one's start on the left come into the tree
            while done < len(ended) and anchors[ended[done]][0] + anchors[ended[done]][2] <= a:
                j = ended[done]
                x, y, m = anchors[j]
                tree.put(place[y + m], (score[j] + (x + m + y + m) / 2, j))
                done += 1
            low = int(np.searchsorted(stops, b, "right"))
            value, j = tree.up_to(low)
            score[i] = float(n)
            if j >= 0 and value - (a + b) / 2 > 0:
                x, y, m = anchors[j]
                if a - x - m <= MAX_GAP and b - y - m <= MAX_GAP:
                    score[i], back[i] = n + value - (a + b) / 2, j
        at, chain = max(range(len(anchors)), key=lambda i: (score[i], -i)), []
        while at >= 0:
            chain.append(at)
            at = back[at]
        picked = [anchors[i] for i in reversed(chain)]
        out.append(picked)
        a0, a1 = picked[0][0], picked[-1][0] + picked[-1][2]
        b0, b1 = picked[0][1], picked[-1][1] + picked[-1][2]
        anchors = [s for i, s in enumerate(anchors) if i not in set(chain)
                   and (s[0] >= a1 or s[0] + s[2] <= a0) and (s[1] >= b1 or s[1] + s[2] <= b0)]
    return out


def _edits(a: list, b: list) -> int:
    """Words of the longer side of a gap that are not matched in an alignment of the two."""
    if a == b:
        return 0
    row = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + np.array([w != v for v in b], np.int64)) if b else np.zeros(0, np.int64)
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def _extend(a: list, b: list) -> tuple[int, int]:
    """How far two sequences run on together, and with how many differences (one for one)."""
    best = score = length = wrong = errors = 0
    for n, (x, y) in enumerate(zip(a, b), 1):
        same = x == y
        score += 1 if same else -3
        errors += not same
        if score > best:
            best, length, wrong = score, n, errors
        if score < best - DROP:
            break
    return length, wrong


def align(left: list, right: list, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, float]:
    """The passage of a chain: start and length on both sides, and the share of alike words.

    ``collinear.align`` gives the same for many chains.
    """
    edits, (a, b, n) = 0, chain[0]
    for i, (x, y, m) in enumerate(chain):
        edits += sum(p != q for p, q in zip(left[x:x + m], right[y:y + m]))
        if i:
            edits += _edits(left[a + n:x], right[b + n:y])
        a, b, n = x, y, m
    back, wrong_back = _extend(left[:chain[0][0]][::-1], right[:chain[0][1]][::-1])
    on, wrong_on = _extend(left[a + n:], right[b + n:])
    a0, b0 = chain[0][0] - back, chain[0][1] - back
    la, lb = a + n + on - a0, b + n + on - b0
    return a0, la, b0, lb, 1 - (edits + wrong_back + wrong_on) / max(la, lb)


_CHAINS = "t bigint, rep bigint, a0 int, a1 int, b0 int, b1 int, anchors array<int>"


def _links(rows: DataFrame, key: str) -> DataFrame:
    """(t, rep, at, rep_at): every two texts of a key. ``rows`` are (t, key, at), a text and key once, of keys of at most COLD texts."""
    two = lambda x, y: F.struct(x["t"].alias("t"), y["t"].alias("rep"), x["at"].alias("at"), y["at"].alias("rep_at"))
    texts = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "at"))).alias("m"))
    return texts.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(
        F.slice("m", i + 2, F.lit(COLD)), lambda y: two(x, y))))).alias("link")).select("link.*")


def linked(seed_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, shared, hot): pairs (t, rep, m) of texts that share keys of at most COLD texts, t below rep, with the places of the
    common seeds (pos, rep_pos); the seeds (t, h, pos, n) that more than one text has; keys (t, k, n) of more than COLD texts.

    A pair without a common key of more texts has all its common seeds near each other in m.
    """
    sizes = seed_rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(seed_rows.join(sizes, "h"), "shared")   # a text has a seed once
    # a frequent seed and another one near it are a key that fewer texts have
    place = F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")).alias("place")
    own = shared.groupBy("t").agg(F.sort_array(F.collect_list(F.struct(place, "h", "pos", "n"))).alias("m"),
                                  F.max("n").alias("most")).filter(F.col("most") > COLD)
    reach = lambda x: x["place"] + MAX_GAP + F.when(x["pos"] < 0, LONG_K).otherwise(K)
    near = F.flatten(F.transform("m", lambda x, i: F.transform(
        # a place begins a short and a long seed at most
        F.filter(F.slice("m", i + 2, F.lit(2 * (MAX_GAP + LONG_K) + 1)), lambda y: (y["place"] <= reach(x)) & ((x["n"] > COLD) | (y["n"] > COLD))),
        lambda y: F.struct(F.struct(x["h"].alias("a"), y["h"].alias("b")).alias("hs"), F.array(x["pos"], y["pos"]).alias("at")))))
    twos = stored(own.select("t", F.explode(near).alias("two")).select("t", "two.*"), "two_seeds")
    met = stored(twos.join(twos.groupBy("hs").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "hs"), "shared_twos")
    few = F.col("n") <= COLD
    links = _links(shared.filter(few).select("t", "h", F.array("pos").alias("at")), "h").union(_links(met.filter(few), "hs"))
    matches = links.select("t", "rep", F.explode(F.transform("at", lambda v, i: F.struct(
        v.alias("pos"), F.get("rep_at", i).alias("rep_pos")))).alias("match"))
    pairs = matches.groupBy("t", "rep").agg(F.collect_set("match").alias("m")).filter(
        (F.size("m") > 1) | F.exists("m", lambda x: x["pos"] < 0))
    # two seeds of which one is long are no keys here: the long one is one itself
    hot = (shared.filter(~few & (F.col("pos") < 0)).select("t", F.xxhash64("h").alias("k"), "n")
           .union(met.filter(~few & (F.array_min("at") >= 0)).select("t", F.xxhash64("hs.a", "hs.b"), "n")))
    return pairs, shared, hot


def chained_pairs(pairs: DataFrame) -> DataFrame:
    """Chains of every two texts that ``linked`` gives as rows."""
    def run(batch: pa.RecordBatch):
        values = batch.column("m").flatten()
        pos, rep_pos = (values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        owner, _ = collinear.ragged(np.diff(batch.column("m").offsets.to_numpy()))
        found = collinear.chains(*short_seeds(owner, pos, rep_pos), K, WINDOW, MAX_GAP, anchor_chains)
        first, last = found.start[:-1], found.start[1:] - 1
        anchors = pa.ListArray.from_arrays(pa.array((3 * found.start).astype(np.int32)),
                                           pa.array(np.stack([found.a, found.b, found.n], 1).ravel().astype(np.int32)))
        ends = (found.a[first], found.a[last] + found.n[last], found.b[first], found.b[last] + found.n[last])
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(found.pair)) for c in ("t", "rep")],
                                         *[pa.array(e.astype(np.int32)) for e in ends], anchors], [c.split()[0] for c in _CHAINS.split(", ")])

    return map_batches(pairs, run, T.StructType.fromDDL(_CHAINS))


_LINKED = "id bigint, n_links bigint, longest int, root bigint"
_PASSAGES = "left_id bigint, right_id bigint, left_start int, left_words int, right_start int, right_words int, identity double"


def block_passages(block: np.ndarray, side: np.ndarray, keys: tuple, seeds: tuple, words: tuple):
    """Passages of every two texts of a block that share a key: arrays (left, right, left_start, left_words, right_start,
    right_words, identity) with left and right as places among the texts, a piece of the pairs at a time.

    Texts are ordered by ``block`` and hash; those of the same ``side`` of a block are not compared, unless it is below 0. ``keys``
    are (text, key), ``seeds`` (text, hash, place) and ``words`` the words of all texts and their offsets.
    """
    n = len(block)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    stop = np.append(first[1:], n)
    number = np.repeat(np.arange(len(first)), stop - first)
    # the pairs that share a key, as a matrix for each block
    shares, origin = [np.zeros((b - a, b - a), bool) for a, b in zip(first, stop)], first[number]
    owner, key = keys
    order = np.lexsort((owner, key, number[owner]))
    owner, key = owner[order], key[order]
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (number[owner[1:]] != number[owner[:-1]])]))
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(key)).tolist()):
        if b - a > 1:
            at = owner[a:b] - origin[owner[a]]
            shares[number[owner[a]]][np.ix_(at, at)] = True
    size = stop - first
    cell = np.cumsum(size * size) - size * size
    share = np.concatenate([x.ravel() for x in shares])
    text, h, place = seeds
    order = np.lexsort((text, h, number[text]))
    text, h, place = text[order], h[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (number[text[1:]] != number[text[:-1]])]))
    runs = np.diff(np.append(begin, len(h)))
    later = np.repeat(begin + runs, runs) - np.arange(len(h)) - 1   # seeds of the same hash in later texts of the block
    per_text = np.bincount(text, later, n)
    flat, offsets = words
    for x0, x1 in cuts(per_text, MATCHES):
        some = np.flatnonzero((text >= x0) & (text < x1) & (later > 0))
        run, at = collinear.ragged(later[some])
        one = some[run]
        two = one + 1 + at
        left, right = text[one], text[two]
        met = share[cell[number[left]] + (left - origin[left]) * size[number[left]] + right - origin[right]]
        met &= (side[left] < 0) | (side[left] != side[right])
        one, two = one[met], two[met]
        left, right = text[one], text[two]
        found = collinear.chains(*short_seeds(left * n + right, place[one], place[two]), K, WINDOW, MAX_GAP, anchor_chains)
        left, right = found.pair // n, found.pair % n
        keep, a, la, b, lb, alike = collinear.align(
            flat, offsets[left], offsets[left + 1] - offsets[left], offsets[right], offsets[right + 1] - offsets[right],
            found, MARGIN, DROP, MIN_WORDS)
        good = alike >= MIN_IDENTITY
        yield tuple(v[good] for v in (left[keep], right[keep], a, la, b, lb, alike))


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that links lead to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        for ends in (left, right):
            np.minimum.at(new, ends, least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def met_in_blocks(docs: DataFrame, reps: DataFrame, shared: DataFrame, hot: DataFrame, homes: DataFrame, whole: bool) -> DataFrame:
    """Every two texts that share a key of ``hot`` compared, each pair in one block.

    For each text of a block and its passages there a row (id, n_links, longest, root): the number of texts that it is linked with, the
    words of its longest passage, and the text of the block that stands for all that its links lead to. ``whole``: for each
    left text instead its passages, as arrays.
    """
    def own_words(batch: pa.RecordBatch):
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
        for start, stop in cuts(sizes, PACK_BYTES):
            part = batch.slice(start, stop - start)
            rows = [_words(x) for x in part.column(2).to_pylist()]
            # rows of one id may have several texts
            same = [i for i, (r, t) in enumerate(zip(rows, part.column(0).to_pylist())) if _text_hash(r) == t]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i).take(pa.array(same, pa.int64())) for i in (0, 1)], pa.array([len(rows[i]) for i in same], pa.int32()),
                 pa.array([b" ".join(rows[i]) for i in same], pa.binary())], ["t", "id", "size", "words"])

    wanted = stored(homes.join(reps, "t").select("t", F.col("rep_id").alias("_id")), "block_ids")
    if fits(wanted, BROADCAST_IDS):
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "_id").select("t", "_id", "_text")
    read = map_batches(texts, own_words, T.StructType.fromDDL("t bigint, id bigint, size int, words binary"))
    seeds = shared.join(homes.select("t"), "t").groupBy("t").agg(F.collect_list(F.struct("h", "pos")).alias("s"))
    payload = stored(read.groupBy("t").agg(F.first("id").alias("id"), F.first("size").alias("size"), F.first("words").alias("words"))
                     .join(seeds, "t").join(homes, "t").select("t", "id", "size", "words", "keys", F.col("s.h").alias("h"),
                                                               F.col("s.pos").alias("pos"), "home"), "block_texts")
    placed = hot.join(homes.select("t", "home"), "t").select("t", "k", "home")
    visits = placed.join(placed.select("k", F.col("home").alias("other")).distinct(), "k").select("t", "home", "other").distinct()
    visits = stored(visits.join(payload.select("t", "size"), "t"), "visits")
    parts = visits.groupBy("home", "other").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_WORDS)).alias("parts"))
    own_part = F.pmod(F.xxhash64("t"), F.col("parts"))
    dealt = visits.join(parts, ["home", "other"]).join(parts.select(F.col("home").alias("other"), F.col("other").alias("home"),
                                                                   F.col("parts").alias("others")), ["home", "other"])
    twin, low = F.col("home") == F.col("other"), F.col("home") < F.col("other")
    at = dealt.select("t", "home", "other", own_part.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)).alias("x"))
    blocks = at.select("t", F.least("home", "other").alias("g"), F.greatest("home", "other").alias("g2"),
                       F.when(twin, F.least("own", "x")).when(low, F.col("own")).otherwise(F.col("x")).alias("i"),
                       F.when(twin, F.greatest("own", "x")).when(low, F.col("x")).otherwise(F.col("own")).alias("j"),
                       F.when(twin, F.when(F.col("own") == F.col("x"), -1).when(F.col("own") < F.col("x"), 0).otherwise(1))
                       .when(low, 0).otherwise(1).alias("side")).select("t", "side", F.xxhash64("g", "g2", "i", "j").alias("block"))
    # most blocks are of a few texts: as many as make a large one go to Python together
    blocks = stored(blocks, "blocks")
    batches = blocks.count() // BLOCK + 1

    def lists(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
        columns = [table.column(c).combine_chunks() for c in names]
        owner, _ = collinear.ragged(np.diff(columns[0].offsets.to_numpy()))
        return owner, *[c.flatten().to_numpy().astype(np.int64) for c in columns]

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("t", "ascending")]).combine_chunks()
        ids, side, block = (table.column(c).to_numpy() for c in ("id", "side", "block"))
        found = list(block_passages(block, side, lists(table, "keys"), lists(table, "h", "pos"),
                                    _word_codes(table.column("words").combine_chunks())))
        left, right, a, la, b, lb, alike = (np.concatenate([f[i] for f in found]) for i in range(7))
        if whole:
            order = np.argsort(left, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(left[order]) != 0])) if len(order) else order
            starts = pa.array(np.append(first, len(order)).astype(np.int32))
            return pa.Table.from_arrays([pa.array(ids[left[order][first]]), *[pa.ListArray.from_arrays(starts, pa.array(v[order])) for v in (
                ids[right], *[v.astype(np.int32) for v in (a, la, b, lb)], alike)]], [c.split()[0] for c in _PASSAGES.split(", ")])
        n = len(ids)
        pairs = np.unique(left * n + right)
        links = np.bincount(pairs // n, minlength=n) + np.bincount(pairs % n, minlength=n)
        longest = np.zeros(n, np.int32)
        np.maximum.at(longest, left, la.astype(np.int32))
        np.maximum.at(longest, right, lb.astype(np.int32))
        some = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(v[some]) for v in (ids, links, longest, ids[_roots(n, left, right)])],
                                    [c.split()[0] for c in _LINKED.split(", ")])

    given = _PASSAGES.split(", ")
    schema = ", ".join([given[0], *[f"{c.split()[0]} array<{c.split()[1]}>" for c in given[1:]]]) if whole else _LINKED
    return stored(blocks.join(payload.drop("home", "size"), "t").groupBy(F.pmod("block", F.lit(batches)).alias("batch")).applyInArrow(compare, schema), "block_passages")


def compared(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members, pairs, met): members (doc_id, t, rep_id) of equal texts; pairs of their rep_ids with the aligned passage, of texts without
    a common key of more than COLD texts; what ``met_in_blocks`` gives for all others, None where no key has so many texts."""
    hashed = stored(seeded(docs, text, doc_id), "texts")
    # copies of a text have the same seeds, so that any row's will do; they fall together before the shuffle
    distinct = stored(hashed.groupBy("t").agg(F.min("doc_id").alias("rep_id"), F.first("h").alias("h"),
                                              F.first("pos").alias("pos")), "seeds")
    reps = distinct.select("t", "rep_id")
    members = hashed.select("doc_id", "t").join(reps, "t")
    source = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    rows, shared, hot = linked(distinct.select("t", F.explode(F.arrays_zip("h", "pos")).alias("seed")).select("t", "seed.h", "seed.pos"))
    hot = stored(hot, "frequent")
    # the home of a text is the key of it that most texts have
    homes = stored(hot.groupBy("t").agg(F.max(F.struct("n", "k"))["k"].alias("home"), F.collect_set("k").alias("keys")), "homes")
    met = None if homes.isEmpty() else met_in_blocks(source, reps, shared, hot, homes, whole)
    named = (chained_pairs(rows).join(reps.withColumnRenamed("rep_id", "left_id"), "t")
             .join(reps.select(F.col("t").alias("rep"), F.col("rep_id").alias("right_id")), "rep"))
    if met is not None:   # those that meet in a block are compared there
        keys = lambda t, c: homes.select(F.col("t").alias(t), F.col("keys").alias(c))
        named = named.join(keys("t", "_keys"), "t", "left").join(keys("rep", "_rep_keys"), "rep", "left").filter(
            ~F.coalesce(F.arrays_overlap("_keys", "_rep_keys"), F.lit(False))).drop("_keys", "_rep_keys")
    named = stored(named, "chains")
    # whole texts are spread by id, one for each representative that is in a chain
    wanted = named.select("left_id", "t").union(named.select("right_id", "rep")).distinct().toDF("_id", "_t")
    texts = source.join(wanted.select("_id").distinct(), "_id").groupBy("_id").agg(F.max("_text").alias("_text"))
    left = named.join(texts, named["left_id"] == texts["_id"])

    def cut(batch: pa.RecordBatch, column: str, start: str, stop: str, into: str) -> pa.RecordBatch:
        """The words of the text ``column`` around its passage, in place of it."""
        sliced, last, words = [], None, []
        for k, (t, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_id", start, stop)])):
            if t != last:   # rows of one text follow each other
                last, words = t, _words(batch.column(column)[k].as_py())
            sliced.append(b" ".join(words[max(0, a - MARGIN):b + MARGIN]))
        keep = [i for i, c in enumerate(batch.schema.names) if c not in (column, "_id")]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sliced, pa.binary())],
                                         [*[batch.schema.names[i] for i in keep], into])

    def left_side(whole: pa.RecordBatch):
        for k in range(0, whole.num_rows, SLICE):
            yield cut(whole.slice(k, SLICE), "_text", "a0", "a1", "left_words")

    def right_side(whole: pa.RecordBatch):
        # cut and aligned in one worker, not in two beside each other
        for k in range(0, whole.num_rows, SLICE):
            yield aligned(cut(whole.slice(k, SLICE), "_text", "b0", "b1", "right_words"))

    one = map_batches(left, left_side, T.StructType([*named.schema.fields, T.StructField("left_words", T.BinaryType())]))
    both = one.join(texts, one["right_id"] == texts["_id"])

    def aligned(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        codes, starts = _word_codes(pa.concat_arrays([batch.column(c) for c in ("left_words", "right_words")]))
        sizes, starts = np.diff(starts), starts[:-1]
        off = [np.maximum(batch.column(c).to_numpy().astype(np.int64) - MARGIN, 0) for c in ("a0", "b0")]
        anchors = batch.column("anchors")
        ends = (anchors.offsets.to_numpy().astype(np.int64) - anchors.offsets[0].as_py()) // 3
        owner, _ = collinear.ragged(np.diff(ends))
        x, y, m = anchors.flatten().to_numpy().astype(np.int64).reshape(-1, 3).T
        keep, a, la, b, lb, share = collinear.align(
            codes, starts[:n], sizes[:n], starts[n:], sizes[n:],
            collinear.Chains(np.arange(n), ends, x - off[0][owner], y - off[1][owner], m), MARGIN, DROP, MIN_WORDS)
        good = share >= MIN_IDENTITY
        of = keep[good]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c).take(pa.array(of)) for c in ("left_id", "right_id")],
             *[pa.array(v[good].astype(np.int32)) for v in (a + off[0][keep], la, b + off[1][keep], lb)], pa.array(share[good])],
            [c.split()[0] for c in _PASSAGES.split(", ")])

    return members, map_batches(both, right_side, T.StructType.fromDDL(_PASSAGES)), met


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (doc_id, t, rep_id) of equal texts; all pairs of their rep_ids with the aligned passage."""
    members, pairs, met = compared(docs, text, doc_id)
    if met is not None:
        names = met.columns
        pairs = pairs.union(met.select(names[0], F.explode(F.arrays_zip(*names[1:])).alias("p")).select(names[0], "p.*"))
    return members, pairs


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, longest): a row for each document.

    class_id is the least doc_id that repeated passages or copies lead to,
    n_links the number of other texts (copies counted once) that its text was linked with, n_copies the
    documents of the same text, longest the words of its longest passage.
    """
    members, pairs, met = compared(docs, text, doc_id, whole=False)
    pairs = stored(pairs, "passages")
    ends = pairs.select(F.col("left_id").alias("id"), F.col("right_id").alias("other"), F.col("left_words").alias("n")).union(
        pairs.select("right_id", "left_id", "right_words"))
    links = (ends.groupBy("id", "other").agg(F.max("n").alias("n"))
             .groupBy("id").agg(F.count(F.lit(1)).alias("n_links"), F.max("n").alias("longest")))
    edges = pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    if met is not None:   # a pair is in one block, or a row of pairs
        links = links.union(met.select("id", "n_links", "longest")).groupBy("id").agg(
            F.sum("n_links").alias("n_links"), F.max("longest").alias("longest"))
        edges = edges.union(met.select("id", "root"))
    roots = components(edges)
    copies = members.groupBy("rep_id").agg(F.countDistinct("doc_id").alias("n_copies"))
    classes = (copies.join(links, copies["rep_id"] == links["id"], "left").drop("id")
               .join(roots, copies["rep_id"] == roots["node"], "left").drop("node"))
    per_doc = members.join(classes, "rep_id").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "rep_id")).alias("class_id"), F.max("n_links").alias("n_links"),
        F.max("n_copies").alias("n_copies"), F.max("longest").alias("longest"))
    ids = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return ids.join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), zero("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"), zero("longest"))


def op8_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
