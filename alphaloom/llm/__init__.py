"""Training-data operators: dedup, tokens, media, privacy, quality, packing.

Nothing outside this subpackage imports it.
"""
