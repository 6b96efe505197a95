"""Compositions of operators: whole jobs, and the queries that run them on the given tables."""
