"""Kernels, fits, dictionaries and stages on odd rows, against plain versions."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from notemill.llm import bpe, decontaminate, quality, revisits, simhash, toxicity

P = pytest.importorskip("public_tokenizers")


# --- the dictionary of folded words ------------------------------------------

def test_words_of_several_packs_are_folded_once(spark):
    rows = [(i, "zzqxzq wubbledub " + ("oncely" * (i + 1))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = P.path("byte_bpe_50k.tiktoken")
    pieces = bpe.load_ranks(path)
    known = bpe.fold_dictionary(docs, pieces, P.PATTERN, "text", pack_bytes=20)
    words = [known.word(k) for k in range(len(known))]
    assert known.places([*words, b"nowhere", b""]).tolist() == [*range(len(words)), -1, -1]
    assert b" wubbledub" in words and not any(b"onceryoncely" in w for w in words)
    ranks = {p: i for i, p in enumerate(pieces)}
    for k, w in enumerate(words):
        assert known.flat[known.id_ends[k]:known.id_ends[k + 1]].tolist() == bpe.heap_merges(w, ranks)
    assert len(bpe.fold_dictionary(docs, pieces, P.PATTERN, "text", pack_bytes=20, max_words=0)) == 0
    plan = bpe.encode(docs, path, P.PATTERN)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan
    some = bpe.encode(docs, path, P.PATTERN, max_words=1).select("doc_id", "ids").collect()
    assert sorted(map(tuple, some)) == sorted(map(tuple, bpe.encode(docs, path, P.PATTERN, fold="arrays").select("doc_id", "ids").collect()))


def test_rank_map_is_two_flat_arrays():
    """What the driver sends and tasks read is one number a pair, not arrays in arrays; left id 0 meets no empty place."""
    pieces = tuple([bytes([b]) for b in range(6)] + [b"\x00\x01", b"\x01\x02", b"\x00\x01\x02", b"\x05\x05", b"\x02\x00", b"\x00\x05\x05"])
    shift, table = (json.loads(x) for x in bpe._rank_map(pieces))
    assert not any(isinstance(x, list) for x in (*shift, *table))
    ranks = {p: i for i, p in enumerate(pieces)}
    for left, right in itertools.product(range(len(pieces)), repeat=2):
        at = shift[left] + right
        entry = table[at] if 0 <= at < len(table) else None
        found = None if entry is None or entry ^ left * (bpe.EDGE + 1) >= bpe.EDGE else entry ^ left * (bpe.EDGE + 1)
        assert found == ranks.get(pieces[left] + pieces[right])


def test_fold_of_random_words_is_the_heap(spark):
    pieces = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    ranks, rng = {p: i for i, p in enumerate(pieces)}, np.random.default_rng(5)
    words = [b"!", b"!!!!!", b"!a!!b", *[bytes(rng.choice(list(b"!!aei therzq\xc3\xa9"), rng.integers(1, 20)).tolist()) for _ in range(300)]]
    rows = spark.createDataFrame([(k, [ranks[bytes([b])] for b in w]) for k, w in enumerate(words)], "k int, raw array<bigint>")
    got = dict(map(tuple, rows.select("k", F.get(bpe.fold_merges(F.array("raw"), pieces), F.lit(0))).collect()))
    assert [got[k] for k in range(len(words))] == [bpe.heap_merges(w, ranks) for w in words]


# --- the string kernel ---------------------------------------------------------

def plain_kernel(x, y):
    """Weighted common subsequences of three characters, by all triples of both strings."""
    def features(s):
        out = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + toxicity.LAMBDA ** (k - i + 1)
        return out
    a, b = features(x), features(y)
    size = lambda s: np.sqrt(sum(toxicity.LAMBDA ** (2 * (k - i + 1)) for i, j, k in itertools.combinations(range(max(len(s), 3)), 3)
                                 if k - i < toxicity.SPAN))
    return sum(a[t] * b.get(t, 0) for t in a) / size(x) / size(y)


def test_kernel_is_the_plain_one():
    rng = np.random.default_rng(1)
    alphabet = np.sort(np.frombuffer("abcde ".encode("utf-32-le"), np.uint32))
    words = ["".join(rng.choice(list("abcde "), rng.integers(1, 12))) for _ in range(14)] + ["aaaa", "ab", ""]
    code = lambda w: (np.searchsorted(alphabet, np.frombuffer(w.encode("utf-32-le"), np.uint32)) + 1).astype(np.int32)
    kernel = toxicity.Kernel([code(w) for w in words[:9]], len(alphabet) + 1)
    got = kernel.against([code(w) for w in words])
    assert np.allclose(got, [[plain_kernel(w, v) for v in words[:9]] for w in words], atol=1e-5)


def test_decisions_of_whole_texts_are_those_of_their_windows():
    rng = np.random.default_rng(2)
    texts = ["", "...", "one", "You i d i o t! i-d-i-o-t, idi ot", "x" * 70 + " end", "Same words. same words", "É\u00df \U0001F600 ok\nnext line"]
    texts += [" ".join("".join(rng.choice(list("abcd"), rng.integers(1, 20))) for _ in range(30)) for _ in range(4)]
    alphabet = np.sort(np.unique(np.frombuffer("".join(texts).lower().replace("\n", " ").encode("utf-32-le"), np.uint32)))[:20]
    base = len(alphabet) + 1
    weights = rng.normal(size=base ** 3).astype(np.float32)
    weights.reshape(base, base, base)[0] = weights.reshape(base, base, base)[:, 0] = weights.reshape(base, base, base)[:, :, 0] = 0
    values, worst = toxicity.worst_windows(texts, alphabet, weights, 0.25)
    for k, text in enumerate(texts):
        win = toxicity.Windows([text])
        codes = win.codes(alphabet)
        each = []
        for a, b in zip(win.first, win.last):
            ids, w = toxicity.occurrences(codes[a:b], base)
            each.append(float(w @ weights[ids]) + 0.25)
        assert values[k] == pytest.approx(max([toxicity.FLOOR, *each]), abs=1e-3)
        assert (worst[k] is None) == (not each)
    words = lambda t: ["".join(map(chr, w.chars[a:b])) for w in [toxicity.Windows([t])] for a, b in zip(w.first[:w.words], w.last[:w.words])]
    assert words(texts[3]) == ["you", "idiot", "idiot", "idi", "ot"]
    assert words("a b. c-d, eff i.d.i") == ["ab", "cd", "eff", "idi"] and words("x" * 20) == ["x" * 12, "x" * 12, "x" * 8]


def test_long_texts_are_cut_at_sentences(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 50)
    text = "word here. " * 30 + "y" * 200 + "! tail"
    parts = list(toxicity._pieces(text))
    assert "".join(parts) == text and all(p[-1] in ".!" for p in parts[:-1])


def test_toxicity_learns_spelled_and_gapped_words(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 9)))
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        words = [word() for _ in range(25)]
        if bad:
            words[7] = ["grumpkwaz", "g-r-u-m-p-k-w-a-z", "grum-pkwaz", "GRUMPKWAZ!!"][i // 4 % 4]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(600, None), (601, "x" * 6_000_000), (0, "another row of one id")]
    labels += [(601, 0), (600, 1), (0, 0), (None, 1), (602, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_text", F.lit(1))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["_s"] for r in toxicity.score_texts(docs, model, keep=("doc_id", "_text"), into="_s").collect() if r["doc_id"]}
    held = [i for i in range(3, 500, 3)]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.95
    ask = spark.createDataFrame([(1, "a grumpkwaz"), (2, "g r u m p k w a z"), (3, "grumxpkwaz"), (4, "lemon tree"), (5, "")], "doc_id bigint, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_texts(ask, model).collect()}
    assert min(score[1], score[2]) > 0.5 and score[3] > 3 * score[4] and score[5] <= score[4]


def test_one_class_and_bounded_samples(spark, documents):
    ones = spark.createDataFrame([(i, 1, 1) for i in range(1, 9)], "doc_id bigint, quality int, toxic int")
    score = {r["score"] for r in quality.classify(documents, ones, F.lit(True)).collect()}
    assert len(score) == 1 and 0.8 < score.pop() < 1
    score = {round(r["score"], 6) for r in toxicity.score_texts(documents, toxicity.train(documents, ones, F.lit(True))).collect()}
    assert len(score) == 1 and 0.8 < score.pop() < 1
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("_y"))
    assert quality.train_ids(many, 100).count() == 100 and quality.train_ids(many, 4000).count() == 4000


def test_trees_split_and_walk_like_plain_ones():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.fit_trees(x, y)

    def walk(row):
        total = float(model["base"])
        for t in range(len(model["feature"])):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + (2 if row[model["feature"][t, at]] > model["cut"][t, at] else 1)
            total += model["value"][t, at]
        return 1 / (1 + np.exp(-total))

    got = quality.score_trees(model, x)
    assert np.allclose(got, [walk(r) for r in x]) and np.mean((got > 0.5) == y) > 0.97
    # the first split is the best of all cuts that the bins allow
    p = y.mean()
    grad, hess = np.full(400, (y.sum() + 1) / 402) - y, np.full(400, (y.sum() + 1) / 402 * (1 - (y.sum() + 1) / 402))
    gain = lambda m: sum(grad[s].sum() ** 2 / (hess[s].sum() + quality.RIDGE) for s in (m, ~m))
    best = max(gain(x[:, f] <= c) for f in range(4) for c in np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1]).astype(np.float32)
               if quality.LEAST_LEAF <= (x[:, f] <= c).sum() <= 400 - quality.LEAST_LEAF)
    assert gain(x[:, model["feature"][0, 0]] <= model["cut"][0, 0]) == pytest.approx(best) and 0 < p < 1


# --- fingerprints, tiles, revisits -----------------------------------------------

def test_components_of_copies_nulls_and_chains(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base), (None, base), (9, base + " x"), (8, None), (2, ""), (None, " \t"), (7, "alone in the world of words"), (7, "alone in the world of words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("mine"), "h": F.lit(1)})
    got = simhash.near_duplicates(docs, keep=("h",)).collect()
    prints = {}
    for doc_id, text in rows:
        hashes = simhash._hashes((text or "").encode(), 3)
        bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
        prints.setdefault(doc_id, []).append(sum(1 << b for b in range(64) if bits[b]) if hashes else 0)
    assert sorted(str((r["doc_id"], r["fp"] & (1 << 64) - 1)) for r in got) == sorted(str((i, f)) for i, fs in prints.items() for f in fs)
    least = {}
    flat = [(i, f) for i, fs in prints.items() for f in fs]
    for i, f in flat:
        group, grown = {f}, True
        while grown:
            more = {g for _, g in flat if any(bin(g ^ h).count("1") <= 2 for h in group)}
            grown, group = more != group, more
        least[i, f] = min((j for j, g in flat if g in group and j is not None), default=None)
    assert all(r["component_id"] == least[r["doc_id"], r["fp"] & (1 << 64) - 1] and r["h"] == 1 for r in got)


def test_stars_do_not_nest_in_a_plan(spark, monkeypatch):
    """The driver holds the plans of its jobs; one star over another one stood six times in a plan."""
    plans, write = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name, **o: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name, **o))
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == dict.fromkeys(range(1, 21), 0) | {51: 50}
    assert max(p.count("Join ") for p in plans) <= 3


def test_hubs_and_long_chains(spark):
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (5, 0)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 400)) and all(got[1000 + i] == 1000 for i in range(1, 41))


def test_repeated_record_ids_keep_their_urls(spark):
    rows = spark.createDataFrame([
        (1, "a.com/x", 10, "response", "e"), (1, "b.com/y", 10, "response", "f"), (1, "b.com/y", 10, "response", "f"),
        (2, "a.com/x", 20, "revisit", "e"), (2, "b.com/y", 20, "revisit", "f"), (2, "b.com/y", 20, "revisit", "f")],
        "record_id bigint, url string, ts bigint, kind string, etag string").selectExpr(
        "*", "CAST(NULL AS string) AS digest", "CAST(NULL AS string) AS last_modified", "map('U', url) AS headers")
    got = sorted((r["record_id"], r["response_id"], r["outcome"], r["headers"]["u"]) for r in revisits.resolve(rows).collect())
    assert got == [(2, 1, "resolved", "a.com/x"), (2, 1, "resolved", "b.com/y"), (2, 1, "resolved", "b.com/y")]
    assert revisits.resolve(rows.filter("false")).collect() == []


def plain_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    used_d, used_i, covered = set(), set(), 0
    while True:
        best = []
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_d and b + n not in used_i:
                    n += 1
                best.append((n, a, b))
        top = max((n for n, _, _ in best), default=0)
        if top < least:
            return covered
        for n, a, b in best:
            if n == top and not (used_d & set(range(a, a + n)) or used_i & set(range(b, b + n))):
                used_d |= set(range(a, a + n))
                used_i |= set(range(b, b + n))
                covered += n


def test_tiling_covers_what_a_plain_one_covers(spark):
    rng = np.random.default_rng(4)
    docs, items, wanted = [], [], {}
    for k in range(12):
        item = [f"t{x}" for x in rng.integers(0, 12, 24)]
        doc = [f"t{x}" for x in rng.integers(0, 12, 40)]
        doc[3:15], doc[20:28] = item[10:22], item[:8]
        docs.append((k, " ".join(doc)))
        items.append((k, " ".join(item)))
        wanted[k] = plain_tiles(doc, item, decontaminate.MIN_MATCH)
    got = {r["doc_id"]: r["covered"] for r in decontaminate.tiled_pairs(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
        .filter("doc_id = item_id").collect()}
    assert got == {k: n for k, n in wanted.items() if n}


# --- the pipeline -----------------------------------------------------------------

@pytest.fixture
def odd(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (None, base), (2, "first text without id twin"), (None, "one"), (None, "two other words"), (4, "same id"), (4, "same id"),
            (4, "another text under it"), (5, None), (6, ""), (7, "a b c leaked passage of the benchmark item number one here d e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars", "7 AS _text", "8 AS _toxicity", "9 AS _id", "10 AS n_lines", "11 AS _kept")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "leaked passage of the benchmark item number one here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, odd), name)
        assert docs.columns == columns
        own = docs.select("_text", "_toxicity", "_id", "n_lines", "_kept").distinct().collect()
        assert [tuple(r) for r in own] == [(7, 8, 9, 10, 11)]
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    # copies and the repeated row are one each, the leak is gone, rows without an id and both texts of id 4 stay
    assert left == [(False, 1, docs.filter("doc_id = 1").first()["text"]), (False, 2, "first text without id twin"),
                    (False, 4, "another text under it"), (False, 4, "same id"), (False, 5, ""), (True, 0, "one"), (True, 0, "two other words")]
    coded = cp.encode(spark, docs, odd)
    assert coded.count() == len(left)


def test_an_empty_table_goes_through(spark, odd, tmp_path):
    none = spark.read.parquet(f"{odd}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        none = cp.stored(stage(spark, none, odd), "none")
    assert none.collect() == []


def test_pipeline_folds_words_by_functions(spark, sf_dir, monkeypatch):
    """The pipeline encodes through the ranked fold, with the ids that the arrays give."""
    import public_tokenizers as P

    folds, fold = [], bpe.fold_merges
    monkeypatch.setattr(bpe, "fold_merges", lambda *a: folds.append(1) or fold(*a))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(["zyxwvut qqqq zyxwvut", "", "no fold qjqjq"])],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.encode(spark, docs, sf_dir)
    assert folds
    wanted = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, fold="arrays").select("doc_id", "ids")
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {r["doc_id"]: r["ids"] for r in wanted.collect()}
