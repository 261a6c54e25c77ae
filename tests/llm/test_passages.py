"""Passages among short quotes, on hot seeds, and at several degrees of change."""

import numpy as np
import pytest

from notemill.llm import passages


def _fresh(rng, n):
    return [f"v{x}" for x in rng.integers(0, 10 ** 9, n)]


def _classes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in passages.repeated_passages(docs).collect()}


def test_whole_passages_among_short_quotes(spark):
    """Fourteen pairs share 70 words, each among 96 texts that quote 24 of them; and one seed stands in all texts."""
    rng = np.random.default_rng(3)
    rows, pairs, at = [], [], 0
    common = _fresh(rng, 20)
    for _ in range(14):
        shared = _fresh(rng, 70)
        pairs.append((at, at + 1))
        for _ in range(2):
            rows.append((at, " ".join(_fresh(rng, 30) + shared + common + _fresh(rng, 25))))
            at += 1
        for _ in range(96):
            k = int(rng.integers(0, 47))
            rows.append((at, " ".join(_fresh(rng, 30) + shared[k:k + 24] + _fresh(rng, 20) + common)))
            at += 1
    got = _classes(spark, rows)
    assert sum(got[a][0] == got[b][0] for a, b in pairs) == 14
    heads = {a for pair in pairs for a in pair}
    assert all(got[i] == (i, 0) for i in range(at) if i not in heads)   # short quotes are no passages


@pytest.mark.parametrize("every, least", [(0, 1.0), (25, 0.9), (16, 0.7), (12, 0.5)])
def test_recall_of_changed_passages(spark, every, least):
    """Passages of 120 words with one word in ``every`` changed, against pairs known by construction."""
    rng = np.random.default_rng(every)
    rows = []
    for k in range(25):
        shared = _fresh(rng, 120)
        other = [w if not every or rng.integers(0, every) else f"x{i}" for i, w in enumerate(shared)]
        rows += [(2 * k, " ".join(_fresh(rng, 40) + shared)), (2 * k + 1, " ".join(_fresh(rng, 60) + other + _fresh(rng, 10)))]
    got = _classes(spark, rows)
    linked = sum(got[2 * k][0] == got[2 * k + 1][0] for k in range(25)) / 25
    print("one word in", every, "changed:", linked)
    assert linked >= least
    assert len({got[2 * k][0] for k in range(25)}) == 25


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    text = _fresh(rng, 60)
    rows = [(1, " ".join(text)), (1, " ".join(text)), (2, " ".join(text).upper()), (None, " ".join(text)), (3, None), (4, ""),
            (5, " ".join(text[:49])), (6, " ".join(_fresh(rng, 40_000) + text))]
    got = _classes(spark, rows)
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (1, 1)}
    assert _classes(spark, []) == {}


def test_changed_passages_are_met_whoever_stands_for_a_seed(spark):
    """A passage of 120 words and its copy with one word in 30 changed, among 500 texts that quote 24 words of either,
    so that each seed is in more than COLD texts."""
    rng = np.random.default_rng(500)
    shared = _fresh(rng, 120)
    other = [w if i % 30 != 29 else f"x{w}" for i, w in enumerate(shared)]
    rows = [" ".join(_fresh(rng, 40) + shared), " ".join(_fresh(rng, 60) + other + _fresh(rng, 10))]
    for i in range(500):
        k = int(rng.integers(0, 97))
        rows.append(" ".join(_fresh(rng, 30) + (shared, other)[i % 2][k:k + 24] + _fresh(rng, 20)))
    got = _classes(spark, list(enumerate(rows)))
    assert got[0] == got[1] == (0, 1)
    assert all(got[i] == (i, 0) for i in range(2, len(rows)))


def test_right_sides_are_cut_and_aligned_in_one_worker(spark):
    """A task holds a Python worker for each step on batches between two shuffles: one for left sides, one for right sides."""
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(80)) + f" end{k}") for k in range(3)], "doc_id bigint, text string")
    members, pairs = passages.passages(docs)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert {(r["left_id"], r["right_id"]) for r in pairs.collect()} <= {(a, b) for a in range(3) for b in range(3) if a != b}
    assert pairs.count() == 3


def _brute(rows):
    """(id, id) of every two texts whose longest common run of words is that of a passage, and the links of each id."""
    words = {i: text.split() for i, text in rows}
    found = set()
    for i in words:
        for j in words:
            if i < j:
                runs = {tuple(words[i][k:k + passages.MIN_WORDS]) for k in range(len(words[i]) - passages.MIN_WORDS + 1)}
                if any(tuple(words[j][k:k + passages.MIN_WORDS]) in runs for k in range(len(words[j]) - passages.MIN_WORDS + 1)):
                    found.add((i, j))
    return found, {i: sum(i in pair for pair in found) for i in words}


def test_every_two_texts_of_a_frequent_seed_are_compared(spark):
    """One passage in 40 texts, another in 30, 10 of them in both, among 40 that quote 24 words of the first."""
    rng = np.random.default_rng(11)
    first, second = _fresh(rng, 70), _fresh(rng, 60)
    rows = []
    for i in range(60):
        own = (first if i < 40 else []) + _fresh(rng, 15) + (second if i >= 30 else [])
        rows.append((i, " ".join(_fresh(rng, 20) + own + _fresh(rng, 20))))
    rows += [(60 + i, " ".join(_fresh(rng, 40) + first[i:i + 24] + _fresh(rng, 30))) for i in range(40)]
    found, links = _brute(rows)
    assert sorted(links.values()) == [0] * 40 + [29] * 20 + [39] * 30 + [59] * 10
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert all(r["class_id"] == (0 if i < 60 else i) for i, r in got.items())
    # texts with both passages, 15 words between them, share one of 145
    assert all(r["longest"] == (0 if i >= 60 else 60 if i >= 40 else 145 if i >= 30 else 70) for i, r in got.items())
    _, pairs = passages.passages(docs)
    assert sorted(tuple(sorted((r["left_id"], r["right_id"]))) for r in pairs.collect()) == sorted(found)


def test_blocks_of_few_texts_give_the_same(spark, monkeypatch):
    """Fuzzy copies of three texts, cut into blocks of five texts, and all pairs of them as rows."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(3):
        shared = _fresh(rng, 150)
        rows += [(30 * k + i, " ".join(_fresh(rng, 10) + [w if rng.integers(0, 25) else f"x{i}" for w in shared])) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    seen = lambda: {tuple(r) for r in passages.repeated_passages(docs).collect()}
    whole = seen()
    assert sum(r[2] for r in whole) >= 0.85 * 3 * 25 * 24   # each two differ in one word of 12
    monkeypatch.setattr(passages, "BLOCK", 5)
    assert seen() == whole
    monkeypatch.setattr(passages, "COLD", 1000)
    assert seen() == whole


def test_chains_and_alignments_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(13)
    texts, p, left, right = [], [], [], []
    for k in range(60):
        one = rng.integers(0, 10 ** 9, int(rng.integers(60, 400)))
        cut = int(rng.integers(0, 60))
        two = np.concatenate([one[cut:], rng.integers(0, 10 ** 9, 30), one[:cut + 20]])
        two = np.where(rng.integers(0, 10 + k, len(two)) == 0, rng.integers(0, 10 ** 9, len(two)), two)
        two = two[rng.integers(0, 60, len(two)) > 0]
        places = {tuple(one[i:i + passages.K]): i for i in range(len(one))}
        met = [(places[w], j) for j in range(len(two) - passages.K + 1) if (w := tuple(two[j:j + passages.K])) in places and rng.integers(0, 3) == 0]
        p += [k] * len(met)
        left += [i for i, _ in met]
        right += [j for _, j in met]
        texts += [one, two]
    p, left, right = np.array(p), np.array(left), np.array(right)
    found = passages.collinear.chains(p, left, right, passages.K, passages.WINDOW, passages.MAX_GAP, passages.anchor_chains)
    many = [(int(k), tuple(zip(*(v[a:b].tolist() for v in (found.a, found.b, found.n)))))
            for k, a, b in zip(found.pair, found.start[:-1], found.start[1:])]
    each = [(k, tuple(c)) for k in range(60) if (p == k).any() for c in passages.chains(left[p == k], right[p == k])
            if len(c) > 1 or c[0][2] > passages.K]
    assert sorted(many) == sorted(each) and any(len(c) > 3 for _, c in many)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = passages.collinear.align(np.concatenate(texts), ends[2 * found.pair], ends[2 * found.pair + 1] - ends[2 * found.pair],
                                   ends[2 * found.pair + 1], ends[2 * found.pair + 2] - ends[2 * found.pair + 1], found,
                                   passages.MARGIN, passages.DROP, passages.MIN_WORDS)
    want = []
    for c, (k, chain) in enumerate(many):
        (x, y, _), (u, v, n) = chain[0], chain[-1]
        a, b = max(0, x - passages.MARGIN), max(0, y - passages.MARGIN)
        la, lb = texts[2 * k][a:u + n + passages.MARGIN].tolist(), texts[2 * k + 1][b:v + n + passages.MARGIN].tolist()
        s, m, t, o, alike = passages.align(la, lb, [(i - a, j - b, w) for i, j, w in chain])
        if min(m, o) >= passages.MIN_WORDS:
            want.append((c, s + a, m, t + b, o, alike))
    assert list(zip(*(v.tolist() for v in got))) == want and len(want) > 40
