"""The tag ontology as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.runtime import broadcast_if_small

TAG_SCHEMA = (
    "tag string, description string, examples array<string>, confidence_threshold double, parent_tag string"
)
REQUIRED = ("tag", "description", "examples", "confidence_threshold")

# The default ontology (tag, description, examples, threshold, parent).
DEFAULT_TAGS = [
    ("reuse_candidate",
     "A note that suggests that an idea, tool, or structure could be reused in other contexts or projects.",
     ["could use the pcc as platform for all projs",
      "this script might generalize to other cases",
      "reuse my spotify classifier as base for new projects"], 0.7, "development_ideas"),
    ("learning_insight",
     "A note that captures a key learning, realization, or insight from studying, experimenting, or working on "
     "something.",
     ["learned that vector embeddings work better than tf-idf for semantic search",
      "realized that the bottleneck was in the data preprocessing step",
      "insight: most bugs come from edge cases I didn't consider"], 0.75, "knowledge"),
    ("todo_item",
     "A note that represents a task, action item, or something that needs to be done in the future.",
     ["need to fix the authentication bug in the login flow",
      "todo: implement caching for the API responses",
      "should refactor the database schema to support versioning"], 0.8, "actions"),
    ("research_question",
     "A note that poses a question, hypothesis, or area that needs investigation or research.",
     ["how does attention mechanism work in transformers?",
      "what's the best way to handle imbalanced datasets?",
      "research: compare different graph neural network architectures"], 0.7, "inquiry"),
    ("code_snippet",
     "A note that contains code, algorithms, or technical implementation details that might be useful later.",
     ["def quick_sort(arr): return sorted(arr) if len(arr) <= 1 else ...",
      "docker run -p 8080:8080 my-app:latest",
      "SELECT * FROM users WHERE created_at > NOW() - INTERVAL '7 days'"], 0.85, "technical"),
    ("resource_link",
     "A note that contains links, references, or pointers to external resources, papers, or tools.",
     ["https://arxiv.org/abs/1706.03762 - Attention is All You Need",
      "check out this tool: https://github.com/streamlit/streamlit",
      "paper: BERT: Pre-training of Deep Bidirectional Transformers"], 0.9, "references"),
    ("meeting_note",
     "A note that captures discussion points, decisions, or outcomes from meetings or conversations.",
     ["team decided to use React for the frontend, backend in Python",
      "meeting with client: they want the MVP by end of month",
      "discussed architecture: microservices vs monolith"], 0.7, "collaboration"),
    ("idea_brainstorm",
     "A note that contains creative ideas, brainstorming, or conceptual thinking about potential projects or "
     "solutions.",
     ["idea: build a semantic search engine for personal notes",
      "what if we could automatically tag emails by content?",
      "brainstorm: ways to improve user onboarding flow"], 0.65, "creativity"),
]


def default_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_TAGS, TAG_SCHEMA).coalesce(1)  # eight rows, one task


def load_tags(spark: SparkSession, path: str) -> DataFrame:
    """Ontology from JSON (array or lines) or Parquet; a required column that is missing is an error."""
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path, multiLine=True)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"tag table lacks {', '.join(missing)}")
    parent = F.col("parent_tag") if "parent_tag" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        "tag", F.trim("description").alias("description"), "examples",
        F.col("confidence_threshold").cast("double").alias("confidence_threshold"), parent.alias("parent_tag"))


def tags_from_config(spark: SparkSession, config: list[dict]) -> DataFrame:
    """Ontology from an already parsed configuration list (e.g. YAML)."""
    rows = [(c["tag"], c["description"].strip(), list(c["examples"]), float(c["confidence_threshold"]),
             c.get("parent_tag")) for c in config]
    return spark.createDataFrame(rows, TAG_SCHEMA)


def tag_by_name(tags: DataFrame, name: str) -> DataFrame:
    return tags.filter(F.col("tag") == name).limit(1)


def tag_names(tags: DataFrame) -> DataFrame:
    return tags.select("tag")


def roll_up_to_parent(routed: DataFrame, tags: DataFrame, tag: str = "routed_tag") -> DataFrame:
    """Routed notes per parent tag; a tag without a parent counts for itself.

    Notes are counted per tag first, so only one row per tag is joined.
    """
    counts = routed.groupBy(F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    parents = broadcast_if_small(tags.select("tag", "parent_tag"))
    return counts.join(parents, "tag", "left").groupBy(
        F.coalesce("parent_tag", "tag").alias("parent_tag")).agg(F.sum("n").alias("count"))
