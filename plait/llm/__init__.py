"""Operators for training-data pipelines over text tables; nothing else in the library imports them."""
