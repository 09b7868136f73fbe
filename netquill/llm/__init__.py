"""Training-data pipeline operators (search, mixing, scoring, filtering, deduplication).

Nothing outside this subpackage imports it; it can be removed without touching the rest.
"""
