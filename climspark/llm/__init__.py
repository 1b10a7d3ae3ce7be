"""Operators of a training-data pipeline: licences, urls, benchmarks, shards, sequences, near copies, personal data,
languages, quality and token counts. Nothing else in the library imports this package."""
