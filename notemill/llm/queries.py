"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from notemill.llm import (bpe, decontaminate, hosts, lines, passages, phrases, quality, recipes, revisits, simhash,
                          token_files, toxicity, whitening)

QUERIES = {f.__name__: f for f in (
    bpe.op1_byte_bpe, revisits.op2_revisits, toxicity.op3_toxicity, hosts.op4_host_rules, lines.op5_line_dedup,
    decontaminate.op6_decontaminate, simhash.op7_simhash, passages.op8_passages, token_files.op9_token_files,
    quality.op10_quality_trees, recipes.op11_chunk_recipes, whitening.op12_whitening, phrases.op13_phrases)}
ORACLE = {"op2_revisits": revisits.OP2_SQL, "op4_host_rules": hosts.OP4_SQL, "op5_line_dedup": lines.OP5_SQL,
          "op11_chunk_recipes": recipes.OP11_SQL, "op13_phrases": phrases.OP13_SQL}
