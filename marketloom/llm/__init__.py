"""Training-data operators: packing, language, licences, quality, extraction, dedup, secrets, URLs, contamination.

Nothing outside this subpackage imports it.
"""
