"""Operators for training-data pipelines: mixing, scans, packing, sharding, media and de-duplication."""
