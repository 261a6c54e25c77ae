"""Reproducible labelled notes from templates with slots, for tests and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notes from a house with a garden and a workshop; pass other tables for other data.
TEMPLATES = {
    "garden": ["the {plant} by the fence wants water", "moved one {plant} into the {place}", "slugs on the {plant} again",
               "cut the {plant} back before {season}", "sow a second {plant} next to the {place}"],
    "kitchen": ["soup with {food}, less salt next time", "we are out of {food}, buy two bags", "{food} keeps for a week in the {place}",
                "try the {food} from the market", "soaked {food} overnight, works well"],
    "workshop": ["the {part} squeaks again", "sanded the {part} and left it in the {place}", "ordered a new {part}",
                 "the {part} fits after a little filing", "glue on the {part} needs a day"],
    "weather": ["frost on the {plant} this morning", "wind all day, closed the {place}", "first warm evening of {season}",
                "rain came through the {place} roof", "the {season} light is back"],
    "errand": ["call about the {part} before noon", "bring {food} to the neighbours", "return the ladder to the {place}",
               "pick up {food} on the way home", "pay for the {part} by Friday"],
    "question": ["does a {plant} grow in the {place}?", "how long does {food} take?", "who made this {part}?",
                 "why does the {plant} drop leaves in {season}?", "is the {place} dry enough for {food}?"],
    "idea": ["a shelf for {food} in the {place}", "grow {plant} along the wall", "turn the old {part} into a lamp",
             "a small feast in {season}", "paint the {place} before {season}"],
    "record": ["{season}: two baskets of {food}", "the {plant} is a hand taller", "measured the {part}, twelve by forty",
               "counted nine bags of {food} in the {place}", "the {place} was at ten degrees"],
}
SLOTS = {
    "plant": ["rosemary", "young plum", "bean row", "quince"],
    "place": ["shed", "cellar", "glasshouse", "porch"],
    "food": ["lentils", "rye flour", "walnuts", "barley"],
    "part": ["door hinge", "bench leg", "pump wheel", "window latch"],
    "season": ["spring", "harvest", "winter", "early summer"],
}


def _pick(options: list[str], row: Column, salt: str, seed: int) -> Column:
    at = F.pmod(F.xxhash64(row, F.lit(salt), F.lit(seed)), F.lit(len(options))).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), at)


def generate_notes(spark: SparkSession, n: int, seed: int = 42, until: str = "2025-01-31T00:00:00",
                   templates: dict[str, list[str]] = TEMPLATES, slots: dict[str, list[str]] = SLOTS) -> DataFrame:
    """``n`` rows (note_id, text, timestamp, true_tag) within the 30 days before ``until``."""
    row = F.col("id")
    pairs = F.array(*[F.struct(F.lit(tag).alias("tag"), F.array(*[F.lit(t) for t in texts]).alias("texts"))
                      for tag, texts in templates.items()])
    at = lambda salt, size: F.pmod(F.xxhash64(row, F.lit(salt), F.lit(seed)), size).cast("int")
    notes = spark.range(n).withColumn("_c", F.get(pairs, at("tag", F.lit(len(templates)))))
    text = F.get("_c.texts", at("template", F.size("_c.texts")))
    for name, options in slots.items():
        text = F.replace(text, F.lit("{" + name + "}"), _pick(options, row, name, seed))
    minutes_back = F.pmod(F.xxhash64(row, F.lit("time"), F.lit(seed)), F.lit(30 * 24 * 60)).cast("int")
    ts = F.to_timestamp(F.lit(until)) - F.make_dt_interval(mins=minutes_back)
    return notes.select(
        F.md5(F.concat(row.cast("string"), F.lit(f":{seed}"))).alias("note_id"), text.alias("text"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("_c.tag").alias("true_tag"))
