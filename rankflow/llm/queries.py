"""All queries of the corpus operators."""

from . import q_bpe, q_dedup, q_language, q_mixing, q_packing, q_resampling, q_simhash, q_trie, q_vectors, q_warc  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
