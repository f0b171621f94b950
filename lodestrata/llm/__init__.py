"""Training-data operators: dedup, quality, licences, language, tokens, mixing, sharding, media.

Nothing outside this subpackage imports it.
"""
