"""Queries and SQL that ``__spark_entry__`` adds."""

from edgeloom.llm import queries as q
from edgeloom.llm.oracles import SQL

QUERIES = {f.__name__: f for f in (q.op1_simhash_dedup, q.op2_packing, q.op3_url_filter, q.op4_license_scan, q.op5_mixing, q.op6_toxicity, q.op7_quality_rules, q.op8_line_dedup, q.op9_lm_scoring, q.op10_topk_search)}

__all__ = ["QUERIES", "SQL"]
