"""Training-data operators: quality, dedup, secrets, mixing, tokenising, toxicity.

Nothing else in the library imports this subpackage.
"""
