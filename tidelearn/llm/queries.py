"""Importing the operators' modules fills the registry."""

import corpus_pipeline
from tidelearn.llm import bpe, chat, decontaminate, licenses, merkle, mixing, near_join, quality, repair, rules, tokens, urls, warc  # noqa: F401
from tidelearn.llm.registry import QUERIES, SQL, register

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["QUERIES", "SQL"]
