"""Training-data operators: fingerprints, shards, scanners, dedup, language, tokens, models.

Nothing outside this subpackage imports it.
"""
