"""Relational operators: linkage, scoring, validation, sampling."""
