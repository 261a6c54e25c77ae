"""Each operator against a brute-force version on small tables with nulls, copies, ties and clashing columns."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notemill.llm import bpe, decontaminate, hosts, lines, passages, pretokenize, quality, revisits, simhash, token_files, toxicity

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def test_words_are_those_of_the_pattern():
    import regex

    texts = ["", "it's 'stop 'rex y'all''d", "a  b\t\nc  \n", "  x　", "1½٣ x\U0001F600 é'd", "\x1c a", "'s's", "a's\n's"]
    data = [t.encode() for t in texts]
    ends = pretokenize.offsets_of(np.array([len(d) for d in data]))
    offsets, rows = pretokenize.split_runs(b"".join(data), ends)
    whole = b"".join(data)
    got = [[whole[a:b].decode() for a, b in zip(offsets[x:y], offsets[x + 1:y + 1])] for x, y in zip(rows, rows[1:])]
    assert got == [regex.findall(P.PATTERN, t) for t in texts]


@pytest.mark.parametrize("fold", ["table", "arrays", "functions"])
def test_ids_are_those_of_the_library(spark, documents, fold):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = bpe.decode(bpe.encode(documents.withColumn("ids", F.lit("mine")), RANKS, P.PATTERN, fold=fold, pack_bytes=40), RANKS)
    assert done.columns == [*documents.columns, "ids", "decoded"]
    rows = done.collect()
    assert len(rows) == 10
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_tables(spark, documents):
    none = documents.filter("false")
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert hosts.host_rules(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert token_files.read_documents(token_files.write_files(none, JSON)).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(documents, items).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.classify(documents, labels, F.lit(True)).collect()} == {0.5}
    model = toxicity.train(documents, labels, F.lit(True))
    assert {r["score"] for r in toxicity.score_texts(documents, model).collect()} == {0.5}


def test_lines_of_three_documents_stay_in_the_last(documents):
    got = {r["doc_id"]: r for r in lines.dedup_lines(documents).collect()}
    assert got[5]["n_dropped"] == 0 and got[3]["kept_text"] == "short" and got[3]["n_dropped"] == 2
    assert got[4]["kept_text"] == "other" and got[None]["kept_text"] == "no id"
    assert got[1]["kept_text"] is None and got[1]["n_lines"] == 1 and got[2]["kept_text"] == ""


def test_columns_with_the_names_of_helpers_and_results(documents):
    own = ["_lines", "_words", "_windows", "_sorted", "_host", "_drop", "_drop_id", "_drop_hash", "_hash", "_LINES_"]
    clash = documents
    for name in own + ["n_words", "n_lines", "n_dropped", "host_rate", "kept"]:
        clash = clash.withColumn(name, F.lit(-7))
    ids = lambda rows, *cs: sorted(((r["doc_id"] is not None, r["doc_id"] or 0), *[r[c] for c in cs]) for r in rows.collect())
    for run, results in ((lambda d: lines.dedup_lines(d), ("n_lines", "n_dropped")),
                         (lambda d: hosts.host_rules(d), ("n_words", "n_repeat_words", "host_rate", "kept"))):
        done = run(clash)
        assert ids(done, *results) == ids(run(documents), *results) and set(own) <= set(done.columns)
        assert done.select(*own).distinct().count() == 1


def test_document_counts(documents):
    got = {r["doc_id"]: r for r in hosts.host_rules(documents).collect()}
    assert (got[8]["n_words"], got[8]["n_repeat_words"], got[8]["base_failed"], got[8]["kept"]) == (4000, 4000, True, False)
    assert (got[1]["n_words"], got[1]["n_dup_lines"]) == (0, 0) and got[3]["n_dup_lines"] == 1
    assert got[6]["word_chars"] == len("é" * 30 + "don'tstop12,5it'sx")


def test_trie_pairs_are_all_pairs_within_the_budget():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    near = base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (60, 6), np.uint64))
    fp = np.unique(np.concatenate([base, near.ravel(), [np.uint64(0)]]))
    x, y = simhash.walk(fp, fp, True, 2, block=50)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if np.bitwise_count(fp[i] ^ fp[j]) <= 2}
    assert got == want and len(x) == len(got)


def test_fingerprints_across_subtrees_link(spark):
    values = [0, 1, 3, 1 << 62, (1 << 62) | 4, -1, 5 << 40]
    pairs = simhash.close_pairs(spark.createDataFrame([(v,) for v in values], "fp bigint"), 2, subtree=1).collect()
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert {tuple(sorted((r["a"], r["b"]))) for r in pairs} == {
        tuple(sorted((a, b))) for i, a in enumerate(values) for b in values[i + 1:] if bits(a, b) <= 2}


def test_tiles_cover_reordered_passages_on_both_ways(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 9 + words[20:] + ["y"] + words[:20])), (2, " ".join(words[:15])), (3, None)],
                                 "doc_id bigint, text string")
    items = spark.createDataFrame([(5, " ".join(words)), (6, None), (7, "w3 w4")], "item_id bigint, text string")
    for bound in (decontaminate.MAX_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"]): (r["covered"], r["leaked"])
               for r in decontaminate.tiled_pairs(docs, items, max_seeds=bound).collect()}
        assert got == {(1, 5): (40, True), (2, 5): (15, False), (1, 7): (2, True), (2, 7): (2, True)}


def test_fuzzy_passages_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    shared = fresh(90)
    fuzzy = [w if i not in (30, 61) else "changed" for i, w in enumerate(shared)]
    docs = spark.createDataFrame([(1, " ".join(fresh(40) + shared + fresh(30))), (2, " ".join(fresh(70) + fuzzy)),
                                  (3, " ".join(fresh(200))), (4, " ".join(shared[:30] + fresh(100))), (5, None),
                                  (6, " ".join(["same"] * 300)), (7, " ".join(["same"] * 300))], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in passages.repeated_passages(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (6, 0)}


def test_random_access_and_files(spark, documents):
    ids = np.random.default_rng(1).integers(0, 70_000, 5000).astype(np.uint32)
    file = token_files.TokenFile(token_files.encode_ids(ids, np.array([0, 1200, 5000])))
    places = np.random.default_rng(2).permutation(5000)
    assert (file.at(places) == ids[places]).all() and len(file) == 5000
    assert (file.document(2) == ids[1200:]).all() and len(file.document(0)) == 0
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(JSON), 0
    rows = {(r["doc_id"], r["start"]): r for r in token_files.read_documents(token_files.write_files(documents, JSON, file_tokens=50, part_bytes=2_000)).collect()}
    texts = sorted(((r["doc_id"], r["text"] or "") for r in documents.collect()), key=lambda r: -1 if r[0] is None else r[0])
    for doc_id, text in texts:
        own = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        row = rows[doc_id, start]
        assert (row["n_tokens"], row["ids_crc32"]) == (len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_classifiers_learn(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [word() for _ in range(30)]
        if bad:
            words[5] = ["zzqxzq", "zzq-xzq", "zzqaxzq"][i % 9 // 3]
        rows.append((i, " ".join(words) + ("###" * 9 if bad else "")))
        labels.append((i, int(not bad), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    learn = F.col("doc_id") % 2 == 0
    for scored, bound, want in ((quality.classify(docs, marks, learn), 0.5, lambda i: i % 3 != 0),
                                (toxicity.score_texts(docs, toxicity.train(docs, marks, learn)), 0.3, lambda i: i % 3 == 0)):
        held = [r for r in scored.collect() if r["doc_id"] % 2]
        assert np.mean([(r["score"] >= bound) == want(r["doc_id"]) for r in held]) > 0.95


def test_revisits(spark):
    h = "map('Server', 's', 'Date', 'd{}') AS headers"
    rows = spark.createDataFrame([
        (1, "http://A.com/x/", 10, "response", "e1"), (2, "https://www.a.com/x#f", 20, "revisit", "W/e1"),
        (3, "http://a.com/x?utm_a=1", 30, "revisit", "e2"), (4, "http://b.com", 5, "revisit", None),
        (5, None, 5, "revisit", "e1"), (6, "http://a.com/x", 40, "revisit", None), (7, "a.com/x", 10, "revisit", "e1")],
        "record_id bigint, url string, ts bigint, kind string, etag string").selectExpr(
        "*", "CAST(NULL AS string) AS digest", "CAST(NULL AS string) AS last_modified",
        "map('Server', kind, 'Date', CAST(ts AS string)) AS headers")
    del h
    got = {r["record_id"]: (r["response_id"], r["outcome"], dict(r["headers"])) for r in revisits.resolve(rows).collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        2: (1, "resolved"), 3: (1, "etag_mismatch"), 4: (None, "no_response"), 5: (None, "no_response"),
        6: (1, "unverified"), 7: (1, "resolved")}
    assert got[2][2] == {"server": "response", "date": "20"}


def test_pipeline_decisions(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.columns
    for name, stage in cp.STAGES[:-1]:
        after = cp.stored(stage(spark, docs, sf_dir), name)
        assert after.columns == before and after.count() <= docs.count()
        docs = after
    near = simhash.near_duplicates(docs)
    assert near.filter("doc_id <> component_id").count() == 0
    assert decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    coded = cp.encode(spark, docs, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in coded)


def test_values_of_sliced_words():
    words = pa.array([b"aa", b"", b"b", "é".encode()], pa.large_binary())
    assert pretokenize.bytes_of(words) == words.to_pylist() and pretokenize.bytes_of(words.slice(1, 2)) == [b"", b"b"]
    assert pretokenize.bytes_of(words.slice(0, 0)) == [] and pretokenize.bytes_of(pa.array([b""], pa.large_binary())) == [b""]


def test_words_go_to_the_library_as_lines(monkeypatch):
    plain, _ = token_files._tokenizer(JSON)
    words = ["'s", " '", "'", " l'", "é", " 12", "\u2028", "\n", " ", "\n\n ", "\x1c", "don", "ß\u200d", "<|", "z" * 300, *(f" w{k:x}q" for k in range(1000))]
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    monkeypatch.setattr(token_files, "_tokenizer", lambda path: (Counted(), ()))
    monkeypatch.setattr(token_files, "LINES", 100, raising=False)
    flat, first, sizes = token_files._encode_pack(JSON, pa.array([w.encode() for w in words], pa.large_binary()), token_files.WordCache())
    assert [flat[a:a + n].tolist() for a, n in zip(first, sizes)] == [plain.encode(w, add_special_tokens=False).ids for w in words]
    assert len(given) < 100   # of 1015 words

    class Joining:   # gives too few lines back
        def encode_batch_fast(self, texts, **options):
            return plain.encode_batch_fast([t.replace("a\nb", "ab") for t in texts], **options)

    ids, sizes = token_files._encode_lines(Joining(), ["a", "b", "cd"])
    assert (ids.tolist(), sizes.sum()) == (sum((plain.encode(w, add_special_tokens=False).ids for w in ("a", "b", "cd")), []), len(ids))


def test_cache_finds_words_of_several_packs():
    cache = token_files.WordCache()
    for part in ([b"a", b" wubbledub", b"a"], [b" wubbledub", b"zq", b""], []):
        flat, first, sizes = token_files._encode_pack(JSON, pa.array(part, pa.large_binary()), cache)
        wanted = [token_files._tokenizer(JSON)[0].encode(w.decode(), add_special_tokens=False).ids for w in part]
        assert [flat[a:a + n].tolist() for a, n in zip(first, sizes)] == wanted
    assert len(cache) == 4


def test_words_of_one_hash_are_told_apart_all_at_once(monkeypatch):
    monkeypatch.setattr(token_files, "word_hashes", lambda data, ends: np.full(len(ends) - 1, 7, np.uint64))
    cache = token_files.WordCache()
    for part in ([b"ab"], [b"ab", b"ba", b"abc", b"a", b""], [b"ab"]):
        flat, first, sizes = token_files._encode_pack(JSON, pa.array(part, pa.large_binary()), cache)
        wanted = [token_files._tokenizer(JSON)[0].encode(w.decode(), add_special_tokens=False).ids for w in part]
        assert [flat[a:a + n].tolist() for a, n in zip(first, sizes)] == wanted


def test_word_hashes_are_those_of_any_pack():
    words = [b"a", b"", b"ba", b"ab", "é\u2028".encode(), b"z" * 5000, b"\x00", b"\x00\x00"]
    hashed = lambda some: token_files.word_hashes(np.frombuffer(b"?" + b"".join(some), np.uint8), 1 + pretokenize.offsets_of(np.array([len(w) for w in some], np.int64)))
    together = hashed(words)
    assert len(set(together.tolist())) == len(words)
    assert [hashed([w])[0] for w in words] == together.tolist()


def test_cache_stays_for_all_tasks_of_a_worker(spark, monkeypatch):
    """The function of a task is pickled by value; what it keeps must not be."""
    from pyspark import cloudpickle

    token_files._cache.cache_clear()
    docs, made = spark.createDataFrame([(1, "wubbledub zqzq")], "doc_id bigint, text string"), []
    monkeypatch.setattr(token_files, "map_batches", lambda df, fn, schema: made.append(fn))
    token_files.tokenized(docs, JSON)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "tie": [0], "_text": ["wubbledub zqzq"]})
    sizes = []
    for _ in range(2):
        list(cloudpickle.loads(cloudpickle.dumps(made[0]))(batch))
        sizes.append(len(token_files._cache(JSON)))
    assert sizes == [2, 2]


def test_digests_without_written_ids(spark, documents, monkeypatch):
    """The query's digests are made where documents are put together: words and packs are written, ids are not."""
    wanted = bpe.round_trip(bpe.encode(documents, RANKS, P.PATTERN, fold="arrays"), RANKS, keep=("source",))
    written, stored = [], bpe.stored
    monkeypatch.setattr(bpe, "stored", lambda df, name, **options: written.append(name) or stored(df, name, **options))
    got = bpe.encode(documents, RANKS, P.PATTERN, drop_text=True, pack_bytes=40, then=bpe.digests(spark, RANKS, keep=("source",)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    monkeypatch.setattr(bpe, "table", lambda *a: documents)
    assert bpe.op1_byte_bpe(spark, "").count() == documents.count()
    assert set(written) == {"words", "packs"}


def test_words_are_counted_over_tasks_and_hand_overs(spark, monkeypatch):
    docs = spark.createDataFrame([(f"zzqxzq wubbledub {'oncely' * (i + 2)}",) for i in range(6)], "text string").repartition(3)
    pieces = bpe.load_ranks(RANKS)
    whole = bpe.fold_dictionary(docs, pieces, P.PATTERN, "text", pack_bytes=20)
    monkeypatch.setattr(bpe, "TASK_WORDS", 1)
    monkeypatch.setattr(bpe, "SLICE", 2)   # the dictionary is put in order in steps of two words
    again = bpe.fold_dictionary(docs, pieces, P.PATTERN, "text", pack_bytes=20)
    assert len(whole) and [whole.word(k) for k in range(len(whole))] == [again.word(k) for k in range(len(again))]
    assert whole.flat.tolist() == again.flat.tolist() and whole.id_ends.tolist() == again.id_ends.tolist()


def test_the_driver_sends_words_and_ids_and_no_index(spark, monkeypatch):
    """The dictionary reaches the driver a partition at a time; what finds a word is made in the tasks."""
    docs = spark.createDataFrame([(i, f"zzqxzq wubbledub {'oncely' * (i + 2)}") for i in range(6)], "doc_id int, text string").repartition(3)
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or broadcast(value))
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.collect", lambda df, collect=type(docs).collect: [r for r in collect(df) if "words" not in r])
    bpe.encode(docs, RANKS, P.PATTERN, pack_bytes=20)
    words, ids = [x for x in sent if isinstance(x, bpe.Dictionary)]
    assert len(words) > 1 and len(ids.flat) > len(words) and not len(ids.data) and not len(words.flat)
    assert all(x.itemsize <= 2 for d in (words, ids) for x in vars(d).values() if hasattr(x, "itemsize"))
    assert words.places([words.word(1), b"nowhere"]).tolist() == [1, -1]
