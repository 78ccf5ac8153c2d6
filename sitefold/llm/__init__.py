"""Operators of a training-data pipeline: de-duplication, filters, search, mixing, sharding."""
