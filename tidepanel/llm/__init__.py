"""Operators of a training-data pipeline: documents in, token files and training sequences out."""
