"""Relational operators of the study, each a DataFrame -> DataFrame function."""
