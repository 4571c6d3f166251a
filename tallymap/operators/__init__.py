"""Relational operators: diffs, statistics, audits, spatial joins, generalisation."""
