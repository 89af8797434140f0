"""Queries of the engine and the SQL that states the same results."""
