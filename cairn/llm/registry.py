"""Queries of this package and the SQL that repeats them."""

from __future__ import annotations

from cairn.llm import decontamination, line_dedup, mixing, neighbours, ngram_join, secrets, sharding, toxicity, url_filters, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_warc": warc.op3_warc,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_mixing": mixing.op7_mixing,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_sharding": sharding.op9_sharding,
    "op10_url_filters": url_filters.op10_url_filters,
}
ORACLE_SQL = {
    "op1_secrets": secrets.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_warc": warc.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
