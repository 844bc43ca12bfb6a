"""Queries and upkeep of linked Markdown notes on Spark."""
