"""Imports every module of the subpackage that registers queries."""

from paraspark.llm import chat_rotation, exact_dedup, hard_negatives, html_mincut, lexical_search, mixing, near_dedup, packing, secret_scan, substring_dedup, token_output, topk_search, toxicity  # noqa: F401
