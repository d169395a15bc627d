"""Lodestone: full-text search and ranking over documents and web pages, on Spark."""
