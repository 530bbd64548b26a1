"""Lodestone: exemplar search, detection evaluation and similarity analytics on Spark."""
