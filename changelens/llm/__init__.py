"""Operators for preparing a text corpus: personal data, packing, similarity
joins, URL rules, source mixing, sharding, passage and exact dedup, quality."""
