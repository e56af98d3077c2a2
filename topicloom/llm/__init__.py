"""Training-data operators: deduplication, filtering, tokenisation, scoring and archives.

Nothing outside this subpackage imports it.
"""
