"""Bulk extraction, translation bookkeeping and back-fill of text embedded in game data, on Spark."""
