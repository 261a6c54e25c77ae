"""Chunk recipes, whitening and phrases against plain versions, on small tables with every odd case."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import phrases, recipes, whitening

LONG = "".join(f"Sentence number {i} ends here. " for i in range(3000))


@pytest.fixture(scope="module")
def copies(spark):
    rows = [(1, LONG), (2, LONG), (3, LONG + "x"), (4, None), (5, ""), (6, "a"), (None, "a"), (7, "a "), (8, "z" * 9000),
            (9, "z" * 9000), (9, "z" * 9000), (10, "z" * 8999), (None, "no id"), (None, "no id"), (-3, "é\U0001F600" * 3000),
            (-3, "é\U0001F600" * 3000), (-4, "é\U0001F600" * 3000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'s' AS source", "-1 AS _row", "-1 AS keep_id")


def test_chunks_join_to_the_text_and_follow_the_content(spark):
    texts = [LONG, "z" * 9000, "a\nb", "\n" * 2000, "é\U0001F600" * 5000, "word " * 5000, "One. " * 3000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(recipes.chunks(F.col("t")).alias("c"))
    cut = [r["c"] for r in frame.collect()]
    assert ["".join(c) for c in cut] == texts
    assert all(len(x) <= recipes.MAX_CHUNK for c in cut for x in c)
    # an insertion at the front changes few chunks
    moved = spark.createDataFrame([("Some new words. " + LONG,)], "t string").select(recipes.chunks(F.col("t")).alias("c")).first()["c"]
    assert len(set(cut[0]) - set(moved)) < len(cut[0]) / 4


@pytest.mark.parametrize("bits, width", [(64, 2), (2, 1)])
def test_equal_texts_are_grouped(copies, bits, width):
    """With hashes of two bits identifiers must be widened until contents differ."""
    if bits == 2:
        assert recipes.verified_width(copies, width=1, bits=2) > 1
    done = recipes.exact_groups(copies, bits=bits, width=width)
    assert done.columns == ["doc_id", "source", "_row", "keep_id", "group_size", "kept", "text_sha256"]
    groups = defaultdict(list)
    for r in copies.collect():
        groups[hashlib.sha256((r["text"] or "").encode()).hexdigest()].append(r["doc_id"])
    rows = done.collect()
    assert len(rows) == copies.count()
    stay = defaultdict(int)
    for r in rows:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"]) == (max(known) if known else None, len(ids))
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        stay[r["text_sha256"]] += r["kept"]
    assert set(stay.values()) == {1} and sum(stay.values()) == len(groups)


def test_bytes_that_are_no_text_are_compared_as_bytes(spark):
    rows = spark.createDataFrame([(1, b"a\xff"), (2, b"a\xfe"), (3, b"a\xff")], "doc_id bigint, b binary")
    done = recipes.exact_groups(rows.select("doc_id", F.col("b").cast("string").alias("text"))).collect()
    assert {r["doc_id"]: r["keep_id"] for r in done} == {1: 3, 2: 2, 3: 3}


def test_text_moves_once_and_verdicts_without_it(copies):
    plan = recipes.exact_groups(copies)._jdf.queryExecution().toString()
    assert "ArrowPython" not in plan and "MapIn" not in plan
    assert recipes.exact_groups(copies.filter("false")).collect() == []


def plain_whitening(vectors, components=4):
    """Exact covariance by fractions, then eigh."""
    usable = [v for v in vectors if v is not None and all(e is not None and np.isfinite(e) and abs(e * 256) < 2 ** 62 for e in v)]
    xs = [tuple(int(np.floor(float(e) * 256)) for e in v) for v in usable]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = np.array([[float(sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fit) / n)
                     for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    white = (np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)] for x in xs]) @ axes) / np.sqrt(values)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    return n, deviation, white, values / np.trace(cov)


@pytest.mark.parametrize("size", [1.0, 2.0 ** 21, 2.0 ** 45])
def test_whitening(spark, size):
    """Also where squares need two, three and more limbs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) * size + 3 * size
    vectors = [*x.tolist(), x[0].tolist(), x[0].tolist(), None, [float("nan"), *x[1][1:].tolist()], [None, *x[1][1:].tolist()],
               [float("inf"), *x[1][1:].tolist()], [1e300, *x[1][1:].tolist()], [1.0, 2.0], []]
    rows = spark.createDataFrame([(i, v, "s") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, n string")
    got = defaultdict(dict)
    for r in whitening.whiten(rows.repartition(3)).collect():
        got[r["vec_id"]][r["component"]] = r
    n, deviation, white, explained = plain_whitening(vectors[:-2])
    assert sorted(got) == list(range(62)) and n == 60
    for i in got:
        for c in range(1, 5):
            r = got[i][c]
            assert r["n"] == n and r["deviation"] == (deviation[i] if deviation[i] < 2 ** 63 else None)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9) and r["identity_error"] < 1e-9
    for c in range(4):
        have = np.array([got[i][c + 1]["whitened"] for i in range(62)])
        sign = np.sign(have @ white[:, c])
        assert np.allclose(have * sign, white[:, c], atol=1e-8)


def test_squares_are_exact_in_any_size():
    rng = np.random.default_rng(9)
    for top in (1, 1 << 20, 1 << 30, 1 << 52, (1 << 62) - 1):
        values = rng.integers(-top, top, (700, 3), endpoint=True)
        total = np.zeros((whitening.LIMBS, 3), np.int64)
        for _ in range(3):
            whitening.add_squares(total, values)
        whitening.add_squares(total, values.astype(object) * (1 << 15))
        want = [sum(int(v) ** 2 for v in values[:, k]) * (3 + (1 << 30)) for k in range(3)]
        assert [sum(int(total[k, j]) << (26 * k) for k in range(whitening.LIMBS)) for j in range(3)] == want


def test_whitening_of_few_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {
        (i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}


def plain_phrases(rows, least, top, cover):
    counts = defaultdict(Counter)
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        kept = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * candidates[h] >= cover * a
                   and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h in candidates):
                continue
            score, _, left, right = min((10 ** 6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, g, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, g.decode(), -a, left, right, n, -score))
    return out


@pytest.fixture(scope="module")
def sentences(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(30)] + ["É", "ß,", "the", "\U0001F600", "x" * 40]
    odds = np.r_[np.full(34, 0.6 / 34), 0.4][[*range(32), 34, 32, 33]]
    rows = []
    for i in range(150):
        text = "".join(str(w) + str(rng.choice([" ", " ", "\t", ". ", "\n"], p=[.7, .1, .1, .05, .05]))
                       for w in rng.choice(words, rng.integers(0, 60), p=odds / odds.sum()))
        rows.append((["en", "de", None, ""][i % 4], text if i % 3 else text + " Fixed phrase here"))
    rows += [("en", None), (None, None), ("en", ""), ("en", "the " * 5000), ("en", "the " * 5000), ("xx", " \t\n")]
    return rows


@pytest.mark.parametrize("budget, top, pack", [(1 << 21, 2000, 6 << 20), (600, 40, 6 << 20), (40, 2000, 900)])
def test_phrases(spark, sentences, monkeypatch, budget, top, pack):
    """With a small budget words and pairs are heavy; with small packs long texts are read in slices."""
    monkeypatch.setattr(phrases, "PACK", pack)
    monkeypatch.setattr(phrases.slices, "__defaults__", (pack,))
    rows = spark.createDataFrame(sentences, "lang string, text string").withColumn("h1", F.lit(1)).repartition(3)
    got = {tuple(r) for r in phrases.collocations(rows, least=5, top=top, budget=budget).collect()}
    assert got == plain_phrases(sentences, 5, top, 50)


def test_heavy_prefixes_are_split(spark, sentences):
    docs = spark.createDataFrame(sentences, "lang string, text string").fillna("und", ["lang"])
    vocab, nodes = phrases.phrase_counts(docs, 5, 600)
    counts = {(r["lang"], r["h1"], r["h2"], r["h3"]): r["f"] for r in nodes.collect()}
    plain = {(r["lang"], r["h1"], r["h2"], r["h3"]): r["f"] for r in phrases.phrase_counts(docs, 5, 1 << 21)[1].collect()}
    assert counts == plain and nodes.count() == len(counts)
    assert vocab.filter("f > 150").count() > 1


def test_no_phrases(spark):
    schema = "lang string, text string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b")], schema)).collect() == []


def test_slices_lose_and_repeat_nothing():
    data = (b"ab cd e\nfgh " * 40 + b"i" * 90 + b" j k l " * 30).translate(phrases._TABLE)
    own = [p[:n] for p, n in phrases.slices(data, 32)]
    assert b"".join(own) == data and all(p.startswith(o) for o, (p, _) in zip(own, phrases.slices(data, 32)))
