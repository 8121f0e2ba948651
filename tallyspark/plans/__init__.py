"""Whole pipelines and the catalogue of queries."""
