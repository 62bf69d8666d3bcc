"""Orrery: a retrieval engine whose requests compile to Spark DataFrame plans."""
