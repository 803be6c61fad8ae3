"""Operators on DataFrames: retrieval, ranking, spans, sampling, runs, cited answers."""
