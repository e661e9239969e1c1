"""Streaming forms of the profiles: an extension, as the batch operators have no streams."""
