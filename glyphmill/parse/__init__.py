"""Parsers and codecs in plain Python: no Spark here, so each can be tested alone and run inside Arrow batches."""
