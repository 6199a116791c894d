"""Operators chained into complete runs, and the queries over the test tables."""
