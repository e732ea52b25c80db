"""Imports every query module so the registry is complete."""

from tessera.plans import registry
from tessera.plans import (corpus_queries, embed_queries, eval_queries, model_queries,  # noqa: F401
                           resample_queries, sample_queries, search_queries, source_queries, text_queries,
                           tfidf_queries, word_vector_queries)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
HEADLINE = registry.HEADLINE
