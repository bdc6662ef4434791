"""Operators of a training-data pipeline: packing, deduplication, decontamination, scoring, filtering, archives."""
