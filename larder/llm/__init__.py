"""Training-data operators: packing, extraction, dedup, language, PII, quality, toxicity.

Each module holds one operator with its own general interface; ``queries``
registers the ten numbered queries over the given tables.
"""
