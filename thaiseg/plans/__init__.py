"""Queries over the tables, each beside its SQL."""
