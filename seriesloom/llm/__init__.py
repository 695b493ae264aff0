"""Operators for training-data pipelines: dedup, archives, classifiers, privacy, chat, shards, search and mixing."""
