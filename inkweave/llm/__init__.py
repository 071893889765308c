"""Operators for training-data pipelines: repeats, near duplicates, mixing, privacy, quality, language, search, chat."""
