"""Whole plans, and the catalogue of queries with their SQL."""
