"""Operators for preparing training corpora: tokenising, scoring, sharding, dedup, mixing, archives."""
