"""Operators of a training-data pipeline: scans, joins, models and samplers over whole corpora."""
