"""Relational operators: filters, joins, aggregates, windows, graphs and rule cascades over findings tables."""
