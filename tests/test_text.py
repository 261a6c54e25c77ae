"""Golden rows of the capture grammar, normalisation and cleaning."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.operators import notes as nt

LINES = [
    ("#learning_insight #ml learned that vector embeddings work better than tf-idf for semantic search "
     "//important discovery @2025-01-27T10:30:00",
     ["learning_insight", "ml"], "important discovery @2025-01-27T10:30:00", "2025-01-27T10:30:00",
     "learned that vector embeddings work better than tf-idf for semantic search"),
    ("#resource_link #ml https://arxiv.org/abs/1706.03762 - Attention is All You Need //seminal paper "
     "@2025-01-27T14:20:00",
     ["resource_link", "ml"],
     "arxiv.org/abs/1706.03762 - Attention is All You Need //seminal paper @2025-01-27T14:20:00",
     "2025-01-27T14:20:00", "https:"),
    ("#ml #mlops deploy it @2025-13-45T99:00:00", ["ml", "mlops"], None, "2025-13-45T99:00:00", "ops deploy it"),
    ("#a //only comment", ["a"], "only comment", None, ""),
    ("plain   text x", [], None, None, "plain text x"),
    ("#x body\r//c" + chr(0x2028) + "d", ["x"], "c" + chr(0x2028) + "d", None, "body"),
    ("#ml #ml dup // @2025-01-27T10:30:00", ["ml"], "@2025-01-27T10:30:00", "2025-01-27T10:30:00", "dup //"),
    ("#a.b (x)", ["a"], None, None, ".b (x)"),
    (r"#q quote \E and \Q //a\Eb", ["q"], r"a\Eb", None, r"quote \E and \Q"),
]


def test_grammar_golden_rows(spark):
    df = spark.createDataFrame([(i, line[0]) for i, line in enumerate(LINES)], "note_id int, raw_text string")
    rows = nt.parse_capture(df, run_ts="2025-01-31T00:00:00").orderBy("note_id").collect()
    for row, (_, tags, comment, ts, body) in zip(rows, LINES):
        assert row["tags"] == tags
        assert row["comment"] == comment
        assert row["body"] == body
        assert row["timestamp"] == (ts or "2025-01-31T00:00:00")
        assert row["metadata"] == ({} if ts else {"auto_timestamped": "true"})
    assert [r["valid"] for r in rows] == [True, True, False, False, True, True, True, True, True]
    assert rows[2]["issues"] == ["Invalid timestamp format: 2025-13-45T99:00:00"]
    assert rows[3]["issues"] == ["Body is required but empty"]


def test_grammar_limits(spark):
    many = " ".join(f"#t{i}" for i in range(12)) + " body"
    long = "x" * 1001 + " //" + "c" * 201
    df = spark.createDataFrame([(0, many), (1, long)], "note_id int, raw_text string")
    first, second = nt.parse_capture(df).orderBy("note_id").collect()
    assert first["issues"] == ["Too many tags: 12 > 10"] and first["quality"] == 0.8
    assert second["valid"] and len(second["warnings"]) == 2 and second["quality"] == 0.8


def test_fan_out(spark):
    df = spark.createDataFrame([(0, "#a #b x"), (1, "y")], "note_id int, raw_text string")
    rows = nt.fan_out(nt.parse_capture(df)).orderBy("note_id", "tag").collect()
    assert [(r["note_id"], r["tag"]) for r in rows] == [(0, "a"), (0, "b"), (1, "untagged")]


def test_normalize_golden_rows(spark):
    cases = [("  Hello   \"World\"!  It's ", "hello world. its"), ("A ' B", "a  b"),
             ("What?! Yes, no.", "what?. yes, no."), ("a" + chr(0x1C) + chr(0xA0) + chr(0x2003) + "b", "a b")]
    df = spark.createDataFrame(cases, "t string, want string")
    for row in df.select("want", tx.normalize_text(F.col("t")).alias("got")).collect():
        assert row["got"] == row["want"]


def test_whitespace_is_pythons(spark):
    chars = [c for c in map(chr, range(1, 0x3100)) if not 0xD800 <= ord(c) < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    out = df.select("c", (tx.squeeze_ws(F.concat(F.lit("a"), "c", F.lit("b"))) == "a b").alias("run"),
                    (tx.strip_ws(F.col("c")) == "").alias("strip")).collect()
    for row in out:
        assert row["run"] == row["strip"] == row["c"].isspace(), hex(ord(row["c"]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("aB!'\" \t\n#/@_x1" + chr(0xA0) + chr(0xE9)), max_size=30),
                min_size=1, max_size=40))
def test_text_matches_python(spark, texts):
    """Whole batches of random texts per Spark job, against plain Python."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tx.normalize_text(F.col("t")).alias("n"), tx.word_count(F.col("t")).alias("w"),
        tx.extract_tags(F.col("t")).alias("tags")).collect()
    for r in rows:
        t = r["t"]
        want = " ".join(t.split()).lower().replace('"', "").replace("'", "").replace("!", ".").strip()
        assert r["n"] == want
        assert r["w"] == len(t.split())
        assert r["tags"] == list(dict.fromkeys(re.findall(r"#([a-zA-Z_][a-zA-Z0-9_]*)", t)))


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([("abcdefghij" * 5,), ("",), ("abc",)], "t string")
    a, b, c = (r[0] for r in df.select(tx.chunks(F.col("t"), 20, 5)).collect())
    assert a[0] == ("abcdefghij" * 2) and a[0][:15] + a[1][:15] + a[2] == "abcdefghij" * 5
    assert b == [] and c == ["abc"]


def test_cleaning(spark):
    df = spark.createDataFrame([("<b>Hi</b>  <script>x()</script> me@site.org 10.0.0.1 +49 170 1234567",)], "t string")
    row = df.select(tx.clean_text(F.col("t"), lowercase=True).alias("c"), tx.redact_pii(F.col("t")).alias("p"),
                    tx.sanitize_content(F.col("t")).alias("s"), tx.fix_content(F.lit("<i>ab</i>")).alias("f")).first()
    assert row["c"] == "hi x() me@site.org 10.0.0.1 +49 170 1234567"
    assert "[EMAIL] [IP] [PHONE]" in row["p"]
    assert "script" not in row["s"] and "&lt;b&gt;Hi" in row["s"]
    assert row["f"] == "ab [Content too short]"


def test_tag_list(spark):
    tags = ["ML", "ml", "a b", "x" * 51, *[f"t{i}" for i in range(20)]]
    got = spark.createDataFrame([(tags,)], "t array<string>").select(tx.normalize_tag_list(F.col("t"))).first()[0]
    assert got == ["ml", *[f"t{i}" for i in range(9)]]


def test_keep_first_and_language(spark):
    rows = [(3, "same"), (1, "same"), (2, "other")]
    kept = nt.deduplicate_notes(spark.createDataFrame(rows, "note_id int, text string")).collect()
    assert sorted((r["note_id"], r["text"]) for r in kept) == [(1, "same"), (2, "other")]
    words = {"en": ["the", "and"], "de": ["der", "und"]}
    texts = spark.createDataFrame([("the cat and the dog",), ("der hund und die katze",), ("xyz",)], "text string")
    assert [r["language"] for r in nt.detect_language(texts, words).collect()] == ["en", "de", "en"]
