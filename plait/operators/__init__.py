"""Operators over alignments, signatures, read lists and cluster graphs."""
