"""The queries of all training-data operators, and the SQL of those that SQL can express."""

from . import decontaminate, divergence, kmeans, language_id, licenses, media, mixing, packing, simhash, substring_dedup, suffix_dedup, token_store, toxicity

MODULES = [licenses, token_store, toxicity, language_id, media, decontaminate, mixing, simhash, substring_dedup, suffix_dedup, packing, kmeans, divergence]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in MODULES for k, sql in getattr(m, "ORACLES", {}).items()}
