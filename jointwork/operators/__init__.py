"""Relational operators: extract, counts, relations, network, reports, checks."""
