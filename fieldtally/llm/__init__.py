"""Operators of a training-data pipeline: tokens, shards, personal data, quality, duplicates, mixing."""
