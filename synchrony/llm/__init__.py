"""Training-data operators: search, scanning, de-duplication, mixing, filtering, tokenizing, sharding, revisits.

Nothing else in the library imports this subpackage; its queries are in :mod:`synchrony.llm.queries`.
"""
