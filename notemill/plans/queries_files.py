"""Registered queries over files: the given tables through the sinks and back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.plans import inputs as inp
from notemill.runtime import scratch_path
from notemill.sources import ontology as on
from notemill.sources import readers as rd
from notemill.sources import writers as wr

QUERIES = {}
ORACLE = {}
NL = "chr(10)"
STRIPPED = inp.sql_strip("text")


def _query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn
    return register


def _counted(notes, column="text"):
    """Digests of whole texts and how often each stands there."""
    return notes.groupBy(F.md5(column).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def _counted_sql(pieces: str, text: str, keep: str = "true") -> str:
    return f"""WITH pieces AS (SELECT unnest({pieces}) AS piece FROM documents),
bare AS (SELECT {inp.sql_strip('piece')} AS s FROM pieces)
SELECT md5({text}) AS digest, count(*) AS n FROM bare WHERE s <> '' AND {keep} GROUP BY 1"""


@_query("csv_notes", f"""SELECT doc_id::VARCHAR AS note_id, lang AS timestamp, md5(s) AS original, md5({inp.sql_normalize('s')}) AS digest
FROM (SELECT doc_id, lang, {STRIPPED} AS s FROM documents) WHERE s <> ''""")
def csv_notes(spark, sf):
    path = scratch_path(spark, "csv")
    wr.write_csv(inp.table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return rd.read_csv_notes(spark, path, "text", "doc_id", "lang").select(
        "note_id", "timestamp", F.md5("original_text").alias("original"), F.md5("text").alias("digest"))


@_query("labelled_csv", f"""SELECT doc_id::VARCHAR AS note_id, source AS true_tag, md5(coalesce({STRIPPED}, '')) AS digest FROM documents""")
def labelled_csv(spark, sf):
    path = scratch_path(spark, "labelled")
    wr.write_csv(inp.table(spark, sf, "documents").select(
        F.col("doc_id").alias("note_id"), "text", F.lit(inp.RUN_TS).alias("timestamp"), F.col("source").alias("true_tag")), path)
    return rd.read_labelled_notes(spark, path).select(
        "note_id", "true_tag", F.md5(F.coalesce(tx.strip_ws(F.col("text")), F.lit(""))).alias("digest"))


@_query("text_notes", _counted_sql(f"string_split(text, {NL})", inp.sql_normalize("s")))
def text_notes(spark, sf):
    path = scratch_path(spark, "text")
    wr.write_lines(inp.table(spark, sf, "documents").select("text"), path)
    return _counted(rd.read_text_notes(spark, path, run_ts=inp.RUN_TS))


@_query("markdown_paragraphs", _counted_sql(f"string_split('# title' || {NL} || {NL} || text, {NL} || {NL})",
                                            inp.sql_normalize("s"), "NOT starts_with(s, '#')"))
def markdown_paragraphs(spark, sf):
    path = scratch_path(spark, "markdown")
    wr.write_lines(inp.table(spark, sf, "documents").select(F.concat(F.lit("# title\n\n"), "text", F.lit("\n")).alias("value")), path)
    return _counted(rd.read_markdown_notes(spark, path, run_ts=inp.RUN_TS))


@_query("json_notes", _counted_sql("[text]", inp.sql_normalize("s")))
def json_notes(spark, sf):
    path = scratch_path(spark, "json")
    wr.write_report(inp.table(spark, sf, "documents").select("doc_id", "text"), path)
    return _counted(rd.read_json_notes(spark, path, run_ts=inp.RUN_TS, lines=True))


@_query("json_array_notes", ORACLE["json_notes"])
def json_array_notes(spark, sf):
    """One file that is an array of all documents, cut at byte ranges."""
    path = scratch_path(spark, "json_array")
    wr.write_json_arrays(inp.table(spark, sf, "documents").select(
        "doc_id", F.array(F.struct(F.col("text").alias("[}"))).alias("nested"), "text"), path)
    return _counted(rd.read_json_notes(spark, path, run_ts=inp.RUN_TS))


@_query("csv_one_file", ORACLE["csv_notes"])
def csv_one_file(spark, sf):
    """Large quoted CSV files with line feeds in their values, cut at byte ranges: one, or one for each part of bounded bytes."""
    path = scratch_path(spark, "csv_one")
    docs = inp.table(spark, sf, "documents").select("doc_id", "text", "lang")
    wr.write_large_csv(docs, path)
    return rd.read_csv_notes(spark, path, "text", "doc_id", "lang").select(
        "note_id", "timestamp", F.md5("original_text").alias("original"), F.md5("text").alias("digest"))


@_query("note_folder", f"""WITH lines AS (SELECT 'lang=' || coalesce(lang, 'none') AS category, unnest(string_split(coalesce(text, ''), {NL})) AS line FROM documents)
SELECT category, md5(line) AS digest, count(*) AS n, true AS named FROM lines GROUP BY 1, 2""")
def note_folder(spark, sf):
    path = scratch_path(spark, "folder")
    docs = inp.table(spark, sf, "documents").select(
        F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("value"))
    docs.write.option("maxRecordsPerFile", 200).partitionBy("lang").text(path)
    notes = rd.read_note_folder(spark, path)
    named = (F.startswith("title", F.lit("part-")) & (F.col("note_id") == F.sha2("source_file", 256))).alias("named")
    # a file is written with a line feed at its end
    lines = notes.select("category", named, F.explode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("category", F.md5("line").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.bool_and("named").alias("named"))


@_query("capture_file", f"""WITH {inp.SQL_LINES},
pieces AS (SELECT unnest(string_split_regex(raw_text, '\\r\\n|\\r|\\n')) AS piece FROM lines)
SELECT md5(s) AS digest, count(*) AS n FROM (SELECT {inp.sql_strip('piece')} AS s FROM pieces) WHERE s <> '' GROUP BY 1""")
def capture_file(spark, sf):
    path = scratch_path(spark, "capture")
    wr.write_lines(inp.capture_lines(spark, sf).select("raw_text"), path)
    return _counted(rd.read_capture_lines(spark, path), "raw_text")


def _source_tags(spark, sf):
    """An ontology of the sources of the documents, written and loaded."""
    path = scratch_path(spark, "tags.parquet")
    (inp.table(spark, sf, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("tag"))
     .agg(F.concat(F.lit(" notes of "), F.first("source"), F.lit(" ")).alias("description"),
          F.array_sort(F.collect_set("lang")).alias("examples"), (F.count("text") / F.count(F.lit(1))).alias("confidence_threshold"),
          F.min("lang").alias("parent_tag")).write.parquet(path))
    return on.load_tags(spark, path)


SQL_TAGS = """tags AS (SELECT source AS tag, 'notes of ' || source AS description, list_sort(list_distinct(list(lang))) AS examples,
  count(text) / count(*) AS confidence_threshold, min(lang) AS parent_tag FROM documents WHERE source IS NOT NULL GROUP BY 1)"""


@_query("load_tags", f"""WITH {SQL_TAGS} SELECT tag, description, array_to_string(examples, ',') AS examples,
  round(confidence_threshold, 9) AS confidence_threshold, parent_tag FROM tags""")
def load_tags(spark, sf):
    return _source_tags(spark, sf).select("tag", "description", F.array_join("examples", ",").alias("examples"),
                                          F.round("confidence_threshold", 9).alias("confidence_threshold"), "parent_tag")


@_query("tag_names", f"WITH {SQL_TAGS} SELECT tag FROM tags")
def tag_names(spark, sf):
    return on.tag_names(_source_tags(spark, sf))


@_query("tag_by_name", f"WITH {SQL_TAGS} SELECT tag, description, parent_tag FROM tags WHERE tag = 'src0'")
def tag_by_name(spark, sf):
    return on.tag_by_name(_source_tags(spark, sf), "src0").select("tag", "description", "parent_tag")


@_query("first_notes", "SELECT doc_id, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 10")
def first_notes(spark, sf):
    docs = inp.table(spark, sf, "documents")
    return rd.first_notes(docs.select("doc_id", F.md5("text").alias("digest")), "doc_id", 10)


@_query("notes_by_category", "SELECT doc_id, md5(text) AS digest FROM documents WHERE lang = 'en'")
def notes_by_category(spark, sf):
    docs = inp.table(spark, sf, "documents").withColumnRenamed("lang", "category")
    return rd.notes_by_category(docs, "en", created="doc_id").select("doc_id", F.md5("text").alias("digest"))


@_query("get_note", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id = 42")
def get_note(spark, sf):
    return rd.get_note(inp.table(spark, sf, "documents"), 42, "doc_id").select("doc_id", F.md5("text").alias("digest"))
