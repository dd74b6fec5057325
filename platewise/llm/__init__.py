"""Operators of a training-data pipeline (WARC, tokenizers, dedup, sharding, quality,
packing, search, language ID).  Nothing outside this subpackage imports it."""
