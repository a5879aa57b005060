"""Training-data operators: deduplication, mixing, archives, packing, rules, sharding, scoring, privacy.

Nothing outside this subpackage imports it.
"""
