"""Training-data operators: scoring, extraction, filtering, deduplication, tokenising.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
