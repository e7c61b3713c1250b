"""Whole queries: the engine's operators over the tables, each with the same query in SQL where SQL can say it."""
