"""Whole jobs made of operators: diff and patch, and the queries over version pairs of the test tables."""
