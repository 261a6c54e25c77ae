"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

Texts are cut into sentences, of which letters and digits are kept, in lower case, and one blank for
each gap between words; the gap between two characters that stand alone is left out, so that "i d i o t" and
"i-d-i-o-t" read like the word. Instances are windows of a sentence: every word, and the WINDOW
characters from its start on, which reach into the words behind it. The kernel of two windows counts their common
subsequences of three characters, each occurrence weighted by LAMBDA to the span it takes up (SPAN
at most) and divided by the windows' norms for their lengths, so that gaps and inserted characters only
weaken a match. Windows are mapped to their kernel values with landmarks of both classes, whitened
by the landmarks' own kernel matrix (Nystrom), and a linear machine with squared hinge is fitted. The toxic
window of a toxic document is not known: at first it is the word that most toxic and fewest clean
documents have, then, in turns, the window that the machine finds worst. All words of clean documents are
negatives, and their longer windows as the machine errs on them.

The decision is linear in a window's occurrences, so that scoring adds up one weight an occurrence from a
table over three characters; characters outside the ALPHABET most frequent ones take up
space but match nothing. A document has the score of its worst window, through a logistic curve fitted
on labelled documents that the machine has not seen.

The fit sees at most MAX_TRAIN labelled documents and MAX_CLASS_BYTES of text of each class, chosen by a hash
of the id before any text is moved; a document that would pass the bytes left is passed over.

Defined results: null or empty texts have the score of no evidence (the lowest); very long texts are read whole, long
words in parts that overlap by half; repeated labels of an id count once (the largest), repeated documents
of an id once in the fit (the shortest, then the first in order); equal decisions take the first window.
With labels of one class, or none, the score is the smoothed rate for all. An empty table gives no rows.
The columns ``keep`` are passed on whatever their names; ids, languages, sources and
labels are not inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import crc32_of_id, map_batches, spare, table
from notemill.llm.pretokenize import LETTER, NUMBER, character_classes, cuts, offsets_of
from notemill.llm.quality import train_ids

LAMBDA, SPAN, WINDOW, ALPHABET = 0.6, 6, 12, 95
LANDMARKS, TOXIC_LANDMARKS, ROUNDS, COST = 128, 96, 4, 4.0
MAX_TRAIN = 4_000            # labelled documents that the fit sees at most
MAX_CLASS_BYTES = 4 << 20    # text bytes of them of each class
SLICE = 1 << 19              # characters that are worked on at once
FLOOR = -2.0                 # decision of a text without a window, and the least of any
ENDS = ".!?\n"
NEWLINE = 10
BLANK = np.uint32(32)      # stands for a gap between words
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 if it is kept, 2 if it ends a sentence, else 0."""
    classes = character_classes()
    kinds = ((classes == LETTER) | (classes == NUMBER)).astype(np.uint8)
    kinds[[ord(c) for c in ENDS]] = 2
    return kinds


def _kept(kinds: np.ndarray) -> np.ndarray:
    """Places of the letters and digits, and of the first character of each gap between two of them in a sentence.

    A gap between two characters that stand alone is left out, so that spelled words are words.
    """
    on = kinds == 1
    place = np.flatnonzero(on)
    if len(place) < 2:
        return place
    joined = np.diff(place) == 1
    ended = np.cumsum(kinds == 2, dtype=np.int32)[place]
    alone = ~np.concatenate([[False], joined]) & ~np.concatenate([joined, [False]])
    gap = ~joined & (ended[1:] == ended[:-1]) & ~(alone[1:] & alone[:-1])
    return np.sort(np.concatenate([place, place[:-1][gap] + 1]))


def norm_of(sizes) -> np.ndarray:
    """Square root of a window's kernel with itself, where its subsequences differ from each other; by size."""
    top = int(np.max(sizes, initial=0)) + 1
    table = np.zeros(max(top, 4))
    for _, j in _GAPS:
        table += np.maximum(np.arange(len(table)) - j, 0) * LAMBDA ** (2 * (j + 1))
    return np.sqrt(np.maximum(table, table[3]))[sizes]


class Windows:
    """The kept characters of some texts, and their windows [first, last) with the text of each; words come first."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        chars = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
        kinds = _kinds()[chars]
        # a mark inside a word ends nothing
        kinds[:-1][(kinds[:-1] == 2) & (kinds[1:] == 1) & (chars[:-1] != NEWLINE)] = 0
        kept = _kept(kinds)
        self.chars = np.where(kinds[kept] == 1, chars[kept], BLANK)
        sentence = np.cumsum(kinds == 2, dtype=np.int32)[kept]
        text_starts = offsets_of(np.array([len(t) + 1 for t in lowered], np.int64))[:-1]
        edges = np.flatnonzero(np.diff(sentence, prepend=-1))
        self.sentence = np.repeat(np.arange(len(edges), dtype=np.int32), np.diff(np.append(edges, len(kept))))
        blank = self.chars == BLANK
        fresh = ~blank
        fresh[1:] &= blank[:-1] | (sentence[1:] != sentence[:-1])
        starts = np.flatnonzero(fresh)
        stop = blank.copy()
        stop[edges] = True
        stops = np.append(np.flatnonzero(stop), len(kept))
        ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
        # a long word is read in parts that overlap by half
        parts = np.maximum(1, -(-(ends - starts - WINDOW) // (WINDOW // 2)) + 1)
        total = np.cumsum(parts)
        inner = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - parts, parts)
        first, end = np.repeat(starts, parts) + WINDOW // 2 * inner, np.repeat(ends, parts)
        sentence_end = np.append(edges[1:], len(kept))[self.sentence[first]] if len(first) else first
        near, far = np.minimum(first + WINDOW, end), np.minimum(first + WINDOW, sentence_end)
        more = far > near
        self.words = len(first)   # the first windows are the words themselves
        self.first, self.last = np.concatenate([first, first[more]]), np.concatenate([near, far[more]])
        owner = np.searchsorted(text_starts, kept[edges], "right") - 1 if len(edges) else edges
        self.owner = owner
        self.text = owner[self.sentence[self.first]] if len(first) else first

    def codes(self, alphabet: np.ndarray) -> np.ndarray:
        """Places of the characters in ``alphabet`` from 1 on, 0 for others."""
        at = np.minimum(np.searchsorted(alphabet, self.chars), max(len(alphabet) - 1, 0))
        return np.where(alphabet[at] == self.chars, at + 1, 0).astype(np.int32) if len(alphabet) else np.zeros(len(self.chars), np.int32)

    def sums(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each window the sum of ``weights`` over the occurrences inside it, each with its power of LAMBDA."""
        base, n = round(len(weights) ** (1 / 3)), len(codes)
        one, two = codes * np.int32(base * base), codes * np.int32(base)
        out = np.zeros(len(self.first))
        for span in range(2, SPAN):
            m = n - span
            if m <= 0:
                continue
            total = np.zeros(m, np.float32)
            for i, j in _GAPS:
                if j == span:
                    total += weights[one[:m] + two[i:i + m] + codes[j:j + m]]
            total[self.sentence[:m] != self.sentence[span:]] = 0
            run = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)]) * LAMBDA ** (span + 1)
            low = np.minimum(self.first, m)
            out += run[np.minimum(np.maximum(self.last - span, self.first), m)] - run[low]
        return out / norm_of(self.last - self.first)

    def worst(self, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``n`` texts its largest value and the window that has it (-1 without one)."""
        best, where = np.full(n, FLOOR), np.full(n, -1)
        if len(values):
            order = np.lexsort((np.arange(len(values)), -values, self.text))
            head = order[np.flatnonzero(np.diff(self.text[order], prepend=-1))]
            best[self.text[head]], where[self.text[head]] = np.maximum(values[head], FLOOR), head
        return best, where


def occurrences(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature map of one window: subsequences as numbers, and the summed weight of each."""
    ids, weights = [], []
    for i, j in _GAPS:
        m = len(codes) - j
        if m > 0:
            a, b, c = codes[:m].astype(np.int64), codes[i:i + m].astype(np.int64), codes[j:j + m].astype(np.int64)
            inside = (a > 0) & (b > 0) & (c > 0)
            ids.append(((a * base + b) * base + c)[inside])
            weights.append(np.full(int(inside.sum()), LAMBDA ** (j + 1)))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0)
    found, place = np.unique(np.concatenate(ids), return_inverse=True)
    return found, np.bincount(place, np.concatenate(weights), len(found)) / norm_of(np.array([len(codes)]))[0]


class Kernel:
    """Kernel values of windows with fixed landmarks, and the whitening of the landmarks' own values."""

    def __init__(self, landmarks: list[np.ndarray], base: int):
        self.base = base
        maps = [occurrences(x, base) for x in landmarks]
        self.ids = np.unique(np.concatenate([i for i, _ in maps]))
        self.table = np.zeros((len(self.ids), len(landmarks)), np.float32)
        for k, (i, w) in enumerate(maps):
            self.table[np.searchsorted(self.ids, i), k] = w
        own = self.against(landmarks)
        self.scale = float(np.sqrt(np.mean(np.diag(own)))) or 1.0
        values, vectors = np.linalg.eigh(own / self.scale ** 2)
        live = values > 1e-3 * max(values[-1], 1e-12)
        self.whiten = (vectors[:, live] / np.sqrt(values[live]) / self.scale ** 2).astype(np.float32)

    def against(self, windows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(windows), self.table.shape[1]), np.float32)
        for a in range(0, len(windows), 2048):
            part = windows[a:a + 2048]
            sizes = np.array([len(x) for x in part], np.int64)
            flat = np.concatenate(part).astype(np.int64) if len(part) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(part)), sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))   # characters from here to the window's end
            for i, j in _GAPS:
                at = np.flatnonzero(left > j)
                x, y, z = flat[at], flat[at + i], flat[at + j]
                ids = (x * self.base + y) * self.base + z
                place = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
                hit = (self.ids[place] == ids) & (x > 0) & (y > 0) & (z > 0) if len(self.ids) else np.zeros(len(ids), bool)
                rows = owner[at[hit]]
                if len(rows):
                    first = np.flatnonzero(np.diff(rows, prepend=-1))
                    out[a + rows[first]] += LAMBDA ** (j + 1) * np.add.reduceat(self.table[place[hit]], first, axis=0)
            out[a:a + len(part)] /= norm_of(sizes)[:, None]
        return out

    def map(self, windows: list[bytes]) -> np.ndarray:
        """Whitened values of windows given as codes in bytes."""
        out = np.empty((len(windows), self.whiten.shape[1]), np.float32)
        for a in range(0, len(windows), 8192):
            out[a:a + 8192] = self.against([_window(k) for k in windows[a:a + 8192]]) @ self.whiten
        return out

    def weights(self, w: np.ndarray) -> np.ndarray:
        """A weight for each subsequence, as a table over three characters."""
        out = np.zeros(self.base ** 3, np.float32)
        out[self.ids] = self.table @ (self.whiten @ w)
        return out


def fit_svm(z: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge by Newton steps over the ``rows`` of z; y is -1 or 1, ``weight`` the cost of a row.

    The sums of a step are taken in slices, so that the matrix is never copied whole.
    """
    d = z.shape[1]
    w, ridge = np.zeros(d + 1), np.eye(d + 1)
    ridge[-1, -1] = 1e-4
    for _ in range(steps):
        gradient, curvature = ridge @ w, ridge.copy()
        for a in range(0, len(rows), 8192):
            x = np.ones((min(8192, len(rows) - a), d + 1))
            x[:, :d] = z[rows[a:a + 8192]]
            slack = 1 - y[a:a + 8192] * (x @ w)
            on = slack > 0
            x = x[on]
            cost = weight[a:a + 8192][on, None] * x
            gradient -= cost.T @ (y[a:a + 8192][on] * slack[on])
            curvature += cost.T @ x
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _pieces(text: str):
    """A text in parts of about SLICE characters that end with a sentence; sentences are read whole."""
    a = 0
    while len(text) - a > SLICE:
        cut = text.rfind("\n", a, a + SLICE)
        cut = cut if cut >= 0 else max(text.rfind(c + " ", a, a + SLICE) for c in ENDS)
        if cut < 0:
            later = [k for c in ("\n", *[e + " " for e in ENDS]) if (k := text.find(c, a + SLICE)) >= 0]
            cut = min(later) if later else len(text) - 1
        yield text[a:cut + 1]
        a = cut + 1
    yield text[a:]


def _read(texts: list[str]):
    """(owner of each part, its windows) of runs of parts of texts, of about SLICE characters."""
    parts = [(k, p) for k, t in enumerate(texts) for p in _pieces(t)]
    for a, b in cuts(np.array([len(p) + 1 for _, p in parts], np.int64), SLICE):
        yield [k for k, _ in parts[a:b]], Windows([p for _, p in parts[a:b]])


def worst_windows(texts: list[str], alphabet: np.ndarray, weights: np.ndarray, bias: float
                  ) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Of each text the decision of its worst window, and that window's codes."""
    best, found = np.full(len(texts), FLOOR), [None] * len(texts)
    for owners, win in _read(texts):
        codes = win.codes(alphabet)
        values, where = win.worst(win.sums(codes, weights) + bias, len(owners))
        for k, value, at in zip(owners, values.tolist(), where.tolist()):
            if at >= 0 and (found[k] is None or value > best[k]):
                best[k], found[k] = value, codes[win.first[at]:win.last[at]].copy()
    return best, found


def words_of(texts: list[str], alphabet: np.ndarray, known: dict[bytes, bytes]) -> list[set[bytes]]:
    """Of each text its distinct words (parts of at most WINDOW characters), as codes in bytes; ``known`` holds each word once."""
    out: list[set[bytes]] = [set() for _ in texts]
    for owners, win in _read(texts):
        codes = win.codes(alphabet)
        for i, j, k in zip(win.first[:win.words].tolist(), win.last[:win.words].tolist(), win.text[:win.words].tolist()):
            if j - i >= 3:
                key = codes[i:j].tobytes()
                out[owners[k]].add(known.setdefault(key, key))
    return out


def _window(key: bytes) -> np.ndarray:
    return np.frombuffer(key, np.int32)


def spread(windows: list[np.ndarray], n: int, base: int) -> list[np.ndarray]:
    """``n`` windows that share little with each other: each next one is the least alike to those chosen."""
    windows = windows[:3 * n]
    if len(windows) <= n:
        return windows
    kernel = Kernel(windows, base)
    own = kernel.against(windows)
    size = np.sqrt(np.maximum(np.diag(own), 1e-12))
    alike = own / size[:, None] / size[None, :]
    chosen, near = [0], alike[0].copy()
    while len(chosen) < n:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, alike[chosen[-1]])
    return [windows[k] for k in chosen]


def fit(texts: list[str], labels: np.ndarray) -> dict:
    """Alphabet, weights of subsequences, bias and logistic curve from labelled documents."""
    rate = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
    flat = {"alphabet": np.zeros(0, np.uint32), "weights": np.zeros(1, np.float32), "bias": 0.0, "slope": 0.0,
            "shift": float(np.log(rate / (1 - rate)))}
    if not len(labels) or labels.min() == labels.max():
        return flat
    points = np.zeros(0x110000, np.int64)
    for _, win in _read(texts):
        points += np.bincount(win.chars, minlength=len(points))
    frequent = np.argsort(-points, kind="stable")[:ALPHABET]
    alphabet = np.sort(frequent[points[frequent] > 0]).astype(np.uint32)
    base = len(alphabet) + 1
    # every fourth document of a class is kept for the logistic curve
    order = np.concatenate([np.flatnonzero(labels == y) for y in (0, 1)])
    rank = np.concatenate([np.arange(int((labels == y).sum())) for y in (0, 1)])
    kept_back = np.zeros(len(labels), bool)
    kept_back[order[rank % 4 == 3]] = True
    toxic, clean = ([texts[k] for k in np.flatnonzero((labels == y) & ~kept_back)] for y in (1, 0))
    learn = [*toxic, *clean]
    once: dict[bytes, bytes] = {}
    bags, others = words_of(toxic, alphabet, once), words_of(clean, alphabet, once)
    stands_in, toxic_in = Counter(k for bag in others for k in bag), Counter(k for bag in bags for k in bag)
    # all words of clean documents are negatives, and their longer windows as the machine errs on them
    negatives = dict.fromkeys(k for bag in others for k in sorted(bag))
    # for a start, a toxic document's witness is the word that most toxic and fewest clean documents have
    lead = {k: n / len(toxic) - 3 * (stands_in[k] + 0.5) / len(clean) for k, n in toxic_in.items()}
    times = Counter(k for k in (max(bag, key=lambda k: (lead[k], k)) for bag in bags if bag) if lead[k] > 0)
    del bags, others, lead, toxic_in, once
    kernel = model = None
    for turn in range(ROUNDS):
        # a window that clean documents have too must be much oftener in toxic ones
        picked = [k for k, n in sorted(times.items(), key=lambda x: (-x[1], x[0]))
                  if n / len(toxic) > 3 * stands_in.get(k, k in negatives) / len(clean)]
        chosen = set(picked)
        rest = [k for k in negatives if k not in chosen]
        if not picked or not rest:
            break
        if turn < 2:
            hard = sorted(rest, key=lambda k: (-stands_in[k], k)) if model is None else [k for k, _ in worst_clean.most_common()]
            kernel = Kernel([*spread([_window(k) for k in picked], TOXIC_LANDMARKS, base),
                             *[_window(k) for k in hard[:LANDMARKS - TOXIC_LANDMARKS]]], base)
            place: dict[bytes, int] = {}
            # rows for the words, and for what the turns may add to them
            z = np.empty((len(negatives) + len(picked) + ROUNDS * len(learn), kernel.whiten.shape[1]), np.float32)
        if not len(kernel.ids):
            break
        fresh = [k for k in (*picked, *rest) if k not in place]
        place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
        z[len(place) - len(fresh):len(place)] = kernel.map(fresh)
        y = np.concatenate([np.ones(len(picked)), -np.ones(len(rest))])
        cost = np.concatenate([[min(times[k], 20) for k in picked], np.ones(len(rest))]) * COST
        w, bias = fit_svm(z, np.array([place[k] for k in (*picked, *rest)]), y, cost)
        weights = kernel.weights(w)
        model = flat | {"alphabet": alphabet, "weights": weights, "bias": bias}
        values, worst = worst_windows(learn, alphabet, weights, bias)
        keys = [x.tobytes() if x is not None and len(x) >= 3 else None for x in worst]
        mine, against = values[:len(toxic)], values[len(toxic):]
        worst_clean = Counter(keys[k] for k in np.argsort(-against, kind="stable") + len(toxic) if keys[k])
        negatives.update(dict.fromkeys(worst_clean))
        # a toxic document whose worst window is like those of clean ones says nothing
        times = Counter(keys[k] for k in np.flatnonzero(mine > np.median(against)) if keys[k])
    if model is None:
        return flat
    held = np.flatnonzero(kept_back)
    if labels[held].min(initial=1) == labels[held].max(initial=0):   # too few for a part of their own
        held = np.arange(len(labels))
    values, _ = worst_windows([texts[k] for k in held], alphabet, weights, bias)
    return model | dict(zip(("slope", "shift"), logistic(values, labels[held])))


def logistic(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from decisions to labels, by Newton steps."""
    x, beta = np.stack([values, np.ones(len(values))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - labels) + 1e-3 * beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def score_texts(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                into: str = "score") -> DataFrame:
    """The columns ``keep`` and the toxicity score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    body = spare(docs, "_text")

    def run(batch: pa.RecordBatch):
        m = sent.value
        texts = batch.column(len(keep))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        scores = np.empty(len(sizes))
        for a, b in cuts(sizes, 2 * SLICE):
            values, _ = worst_windows([t or "" for t in texts.slice(a, b - a).to_pylist()], m["alphabet"], m["weights"], m["bias"])
            scores[a:b] = 1 / (1 + np.exp(-np.clip(m["slope"] * values + m["shift"], -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(scores)], [*keep, into])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(into, T.DoubleType())])
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body)), run, schema)


def labelled_texts(docs: DataFrame, labels: DataFrame, learn_from, label: str, text: str, max_train: int,
                   class_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample: ids by a hash, then lengths, then only the texts that are fitted."""
    known = labels.filter(learn_from & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    ids = train_ids(known.filter("_y = 1"), max_train // 2).unionByName(train_ids(known.filter("_y = 0"), max_train // 2))
    slim = docs.select("doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    sizes = (slim.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_y", "_order").agg(F.min(F.octet_length("_t")).alias("n"))
             .orderBy("_y", "_order", "doc_id").collect())    # max_train rows at most
    room, chosen = {0: class_bytes, 1: class_bytes}, []
    for r in sizes:
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            chosen.append((r["doc_id"], r["_y"], r["n"], len(chosen)))
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, _y int, _n int, _place int")
    rows = (slim.join(F.broadcast(picked), "doc_id").filter(F.octet_length("_t") == F.col("_n"))
            .groupBy("_place", "_y").agg(F.min("_t").alias("_t")).collect())
    return [(r["_t"], r["_y"]) for r in sorted(rows, key=lambda r: r["_place"])]


def train(docs: DataFrame, labels: DataFrame, learn_from, label: str = "toxic", text: str = "text",
          max_train: int = MAX_TRAIN, class_bytes: int = MAX_CLASS_BYTES) -> dict:
    """Fit on a bounded sample of labelled documents, as many toxic as clean ones where there are enough."""
    found = labelled_texts(docs, labels, learn_from, label, text, max_train, class_bytes)
    marks = np.array([y for _, y in found], np.float64)
    model = fit([t for t, _ in found], marks)
    # the sample is balanced; the shift returns to the true rate of label 1
    counts = (labels.filter(learn_from & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
              .groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect())
    n = {r[label]: r["n"] for r in counts}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if ones and zeros and 0 < marks.sum() < len(marks):
        model["shift"] += float(np.log(ones / zeros) - np.log(marks.sum() / (len(marks) - marks.sum())))
    return model


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of_id("doc_id") % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
