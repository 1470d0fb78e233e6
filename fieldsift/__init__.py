"""Corpus-scale field extraction from product documents on Spark."""
