"""Quality rules by host: failures of documents, shrunk per host, joined back. DataFrame functions only.

Base rules look at one document; a host fails if its share of failing documents,
shrunk towards all hosts by a beta prior fitted to the hosts' own rates, reaches
``max_rate``. Statistics per document are written once; hosts are a partial
aggregate of them, and the verdicts come back over the slim table.

Defined results: a null text has no words, symbols or lines and fails; a null
host is a host of its own; repeated rows count as often as they stand there;
without hosts the prior is flat; a column with the name of a result is replaced
by it. Windows are compared by a 64-bit hash within
one document. Very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import ASCII_WS, fits, spare, stored, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_RATE = 0.5           # a host with this shrunk failure rate fails
FLAT = (1.0, 1.0)        # the prior where the hosts' rates do not fix one
BROADCAST_HOSTS = 100_000


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    words, lines, windows, ordered = (spare(docs, n) for n in ("_words", "_lines", "_windows", "_sorted"))
    body = F.coalesce(F.col(text), F.lit(""))
    blank = "".join(map(chr, (32, *range(9, 14))))
    # each step is a projection of its own, so that no later expression repeats an earlier one
    step = docs.withColumn(words, F.array_remove(F.split(body, f"[{ASCII_WS}]+"), ""))
    step = step.withColumn(lines, F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(blank)) != ""))
    step = step.withColumn(windows, F.when(F.size(words) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(F.col(words), i), F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)))))
    step = step.withColumn(ordered, F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def place(x, j):
        same = (F.get(F.col(ordered), j - 1)["h"] == x["h"]) | (F.get(F.col(ordered), j + 1)["h"] == x["h"])
        return F.when(same, F.array(x["i"], x["i"] + 1, x["i"] + 2)).otherwise(F.array().cast("array<int>"))

    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col(ordered).isNull(), 0).otherwise(
            F.size(F.array_distinct(F.flatten(F.transform(ordered, place)))))}
    return step.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in counts],
                       *[c.cast("bigint").alias(name) for name, c in counts.items()])


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Method of moments over the hosts' failure rates (columns n, failed); one row comes to the driver."""
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).first()
    if row["m"] is None or not row["v"] or row["v"] >= row["m"] * (1 - row["m"]):
        return FLAT
    size = row["m"] * (1 - row["m"]) / row["v"] - 1
    return row["m"] * size, (1 - row["m"]) * size


def host_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE,
               keep_text: bool = False) -> DataFrame:
    """Document counts, base_failed, the host's shrunk rate (``host_rate``) and kept."""
    counted = document_counts(docs, text).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    base = stored((counted if keep_text else counted.drop(text)).drop("host_rate"), "base")
    key = spare(base, "_host")
    hosts = (base.groupBy(F.col(host).alias(key))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("int")).alias("failed")))
    alpha, beta = beta_prior(hosts)
    rates = hosts.select(key, ((F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))).alias("host_rate"))
    if fits(rates, BROADCAST_HOSTS):
        rates = F.broadcast(rates)
    return (base.join(rates, F.col(host).eqNullSafe(F.col(key)), "left").drop(key)
            .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") < max_rate)))


def op4_host_rules(spark, sf_dir: str) -> DataFrame:
    judged = host_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


OP4_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)),
again AS (SELECT doc_id, k FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS c
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN again USING (doc_id, k)) GROUP BY 1),
lined AS (SELECT doc_id, count(*) - count(DISTINCT l) AS d
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (
  SELECT a.doc_id, source, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM worded a LEFT JOIN covered USING (doc_id) LEFT JOIN lined USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY 1),
moments AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts),
prior AS (SELECT CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (m * (1 - m) / v - 1) ELSE 1.0 END AS a,
                 CASE WHEN v > 0 AND v < m * (1 - m) THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1.0 END AS b FROM moments)
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (f + a) / (n + a + b) < 0.5 AS kept
FROM judged j JOIN hosts h ON j.source IS NOT DISTINCT FROM h.source, prior"""
