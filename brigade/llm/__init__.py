"""Operators for training-data pipelines: dedup, decontamination, scoring, tokens, chat, shards."""
