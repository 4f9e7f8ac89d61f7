"""Operators for training-data pipelines over `documents`, `benchmark`, `labels` and `pages`."""
